"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import wraps
from typing import Any

import pyarrow

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Callable[[Iterator[Any]], Iterator[Any]]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df less its columns of these names, which the operator's own columns replace."""
    gone = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in gone])


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.  A folder of our own is made only where none is set and Spark runs in one process.

    Raises ValueError on a cluster without one: a local folder would lose what other machines write.
    """
    context = spark.sparkContext
    # Checkpoints whose DataFrames are gone are deleted; without this they stay until somebody cleans up.
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that lost executors don't cost its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def swept(df: DataFrame) -> DataFrame:
    """cut(df); the shuffles and checkpoints that made it go now if nothing else reads them.

    Otherwise they stay on disk until the driver happens to collect its garbage.
    """
    session, done = df.sparkSession, cut(df)
    del df
    session._jvm.System.gc()
    return done


class Scratch:
    """Parquet tables in the shared checkpoint folder, by name.

    ``drop`` deletes what nothing reads any more; the rest goes when the driver's JVM ends, as
    results that aren't computed yet may read it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self._at("").deleteOnExit(self._path(""))

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _at(self, name: str) -> Any:
        return self._path(name).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._at(name).delete(self._path(name), True)
        # The shuffles that made them stay on disk until the driver collects its garbage.
        self.spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


class Bitmap:
    """Which keys a table may hold, in a bitmap that is small enough to broadcast whatever the table.

    It has about 16 bits for each key, 2 ** LEAST_BITS at least and 2 ** MOST_BITS (32 MB) at
    most.  A key that the table holds is always marked; another may be marked too, so a mark is
    followed by an exact step, and a full bitmap costs time, never a result.
    """

    LEAST_BITS, MOST_BITS = 15, 28

    def __init__(self, df: DataFrame, keys: Sequence[str]) -> None:
        self.keys = list(keys)
        hashes = cut(df.select(F.xxhash64(*[col(k) for k in self.keys]).alias("hash")))
        wanted = max(1, 16 * hashes.count()).bit_length()
        self.bits = min(max(wanted, self.LEAST_BITS), self.MOST_BITS)
        slot = hashes.select(self._slot(F.col("hash")).alias("slot"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
        word = F.shiftright("slot", 6).alias("word")
        words = slot.groupBy(word).agg(F.bit_or(bit).alias("bits")).withColumn("bucket", F.shiftright("word", 9))
        held = F.map_from_entries(F.collect_list(F.struct(F.col("word").bitwiseAND(F.lit(511)).alias("at"), "bits")))
        dense = F.expr("transform(sequence(0L, 511L), i -> coalesce(held[i], 0L))")
        self.rows = cut(words.groupBy("bucket").agg(held.alias("held")).select("bucket", dense.alias("bitmap")))

    def _slot(self, hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(1 << self.bits))

    def mark(self, df: DataFrame, flag: str) -> DataFrame:
        """df, which has the keys under the same names, with the boolean column flag."""
        slot, bucket, bitmap = fresh(df, "slot", "bucket", "bitmap")
        rows = self.rows.toDF(bucket, bitmap)
        df = df.withColumn(slot, self._slot(F.xxhash64(*[col(k) for k in self.keys])))
        word = F.get(bitmap, F.shiftright(slot, 6).bitwiseAND(F.lit(511)).cast("int"))
        bit = F.getbit(word, F.col(slot).bitwiseAND(F.lit(63)).cast("int"))
        # At most 2 ** MOST_BITS / 32768 rows of 4 KB.
        joined = df.withColumn(bucket, F.shiftright(slot, 15)).join(F.broadcast(rows), bucket, "left")
        return joined.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(slot, bucket, bitmap)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that edges (a, b) link; the component is the least of its nodes.

    Each round every node takes the least node around it, labels are followed to their roots, and
    the edges are contracted to the roots: those within one go, those between the same two become
    one.  So what is joined shrinks from round to round, and a star or a chain takes one.  Nothing
    but whether anything is left comes to the driver.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = nodes.select("node", F.col("node").alias("component"))
    edges = edges.filter("a != b")
    while not edges.isEmpty():
        roots = _roots(edges.groupBy("b").agg(F.min("a").alias("root")))
        step = roots.select(F.col("b").alias("component"), "root")
        found = cut(found.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        left = edges.join(roots, "b").filter("a != root").select("a", F.col("root").alias("b")).distinct()
        left = left.join(roots.select(F.col("b").alias("a"), "root"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b")
        edges = cut(left.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return found


def _roots(labels: DataFrame) -> DataFrame:
    """(b, root) with the roots where labels that lead on to smaller ones end."""
    while True:
        up = labels.select(F.col("b").alias("root"), F.col("root").alias("above"))
        labels = cut(labels.join(up, "root", "left").select("b", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("on")))
        on = labels.filter("on")
        labels = labels.select("b", "root")
        if on.isEmpty():
            return labels


def released(function: Batches) -> Batches:
    """A function over batches that gives its memory back when a task ends, as Spark keeps its process."""

    @wraps(function)
    def run(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from function(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run
