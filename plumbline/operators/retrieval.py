"""Retrieval: BM25 and cosine arms, fused by reciprocal ranks.  All arms are DataFrame jobs.

Pages are rows of (page_id, summary, tags, body, ...); a query is a short string or vector
on the driver.  Tokens are runs of letters and digits, lower case.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the fields, the constants of BM25 and the offset of reciprocal ranks (fixed values).
FIELDS = {"summary": 3.0, "tags": 2.0, "body": 1.0}
K1, B, OFFSET = 1.2, 0.75, 60


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _is(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def bm25(pages: DataFrame, query: str, fields: dict[str, float] | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, score) of the pages that hold a word of the query.

    Only the query's words are counted in a page, so what is shuffled is a row of a few
    numbers per page that matches; lengths and frequencies come from the same pass.
    """
    words = sorted({w for w in re.split(r"[^\w]+|_", query.lower()) if w})
    fields = fields or FIELDS
    if not words:
        return pages.select(F.col(id_col), F.lit(0.0).alias("score")).limit(0)
    text = {f: tokens(F.concat_ws(" ", F.col(f)) if dict(pages.dtypes)[f].startswith("array") else F.col(f)) for f in fields}
    told = pages.select(id_col, *[text[f].alias(f"t_{f}") for f in fields])
    length = sum((F.size(f"t_{f}") * w for f, w in fields.items()), F.lit(0.0))
    counts = [sum((F.size(F.filter(f"t_{f}", _is(w))) * k for f, k in fields.items()), F.lit(0.0)).alias(f"n{i}") for i, w in enumerate(words)]
    counted = told.select(id_col, length.alias("length"), *counts)
    stats = counted.agg(F.count(F.lit(1)).alias("pages"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(words))]).first()
    score = F.lit(0.0)
    for i in range(len(words)):
        rarity = F.log1p((F.lit(float(stats["pages"])) - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        n = F.col(f"n{i}")
        score = score + rarity * n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("length") / (stats["mean"] or 1.0)))
    hit = [F.col(f"n{i}") > 0 for i in range(len(words))]
    any_hit = hit[0]
    for h in hit[1:]:
        any_hit = any_hit | h
    return counted.filter(any_hit).select(id_col, score.alias("score"))


def cosine(vectors: DataFrame, query: Sequence[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the vectors with a positive cosine to the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector_col, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.col(vector_col), F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    own = sum(float(x) ** 2 for x in query) ** 0.5
    return vectors.select(id_col, (dot / F.nullif(norm * own, F.lit(0.0))).alias("score")).filter("score > 0")


def _cut(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, which is set here only where none is."""
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        session.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-checkpoints-"))
    return df.checkpoint()


def ranked(arm: DataFrame, id_col: str) -> DataFrame:
    """All rows of an arm with ranks from 0, ties by id, without one task that sees all.

    Rows are dealt by ranges of (score, id) and sorted there; a row's number has its partition
    above bit 33 and its place in it below, so the rank is that place and the rows before the
    partition.  An arm is computed once: its scores are written, then ordered.
    """
    ordered = _cut(_cut(arm).orderBy(F.desc("score"), id_col).withColumn("_at", F.monotonically_increasing_id()))
    numbered = ordered.withColumn("_part", F.shiftright("_at", 33))
    # One row per partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = numbered.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + place).drop("_at", "_part", "_before")


def fuse(arms: Sequence[tuple[DataFrame, float]], id_col: str, eligible: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """(id, score): the sum over arms of weight / (60 + rank), ranks taken among all eligible rows; ``top``: only the best of the sums."""
    out = None
    for arm, weight in arms:
        arm = arm if eligible is None else arm.join(eligible.select(id_col), id_col, "left_semi")
        part = ranked(arm, id_col).select(id_col, (F.lit(float(weight)) / (OFFSET + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    fused = out.groupBy(id_col).agg(F.sum("part").alias("score"))
    return fused if top is None else fused.orderBy(F.desc("score"), id_col).limit(top)


def visible(pages: DataFrame, scope: str, tags: Sequence[str] = ("*",)) -> DataFrame:
    """Global pages and the scope's own, by tag; with a restrictive list untagged pages are hidden.

    A scope's page with the id of a global one annotates it and is no hit of its own.
    """
    mine = pages.filter((F.col("scope") == "global") | (F.col("scope") == scope))
    if "*" not in tags:
        mine = mine.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]).cast("array<string>")))
    notes = mine.filter(F.col("scope") != "global").select("page_id", F.col("body").alias("annotation"))
    base = mine.filter(F.col("scope") == "global").join(notes, "page_id", "left")
    own = mine.filter(F.col("scope") != "global").join(mine.filter(F.col("scope") == "global").select("page_id"), "page_id", "left_anti")
    return base.unionByName(own.withColumn("annotation", F.lit(None).cast("string")))


def caveats(hits: DataFrame, pages: DataFrame, most: int = 3, bound: str = "refs") -> DataFrame:
    """page_id and triggered_by of up to ``most`` caveat pages, by id: those bound to a definition that a hit is bound to, and no hits themselves.

    bound names the column of the definitions that a page is bound to; triggered_by are the shared ones, in order.
    """
    of_hits = hits.select(F.explode(bound).alias("ref")).distinct()
    each = pages.filter("is_caveat").select("page_id", F.explode(bound).alias("ref")).join(of_hits, "ref", "left_semi")
    told = each.groupBy("page_id").agg(F.sort_array(F.collect_set("ref")).alias("triggered_by"))
    return told.join(hits.select("page_id"), "page_id", "left_anti").orderBy("page_id").limit(most)
