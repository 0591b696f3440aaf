"""Mixing sources to target weights by pivotal dependent rounding.

A document's size is its number of words.  Sources take the weights in turn, in code
point order and null last, and share ``share`` times the size of everything by weight; a
target stops at ``cap`` times its source's size, and what is left over is shared by weight
among the others until no target is above.  A document then has target / source size
copies, of which the whole part is certain and the fraction is settled by rounding:

* Documents of a source meet in small groups.  In a group a carried document meets the
  others one by one; mass moves between the two, to the one or the other side at random so
  that the expectations stay, until one of them is whole.  Words, not documents, are what
  is moved, so the words that a source takes stay the same.
* What is left of each group, one fractional document, goes up to a group of the next
  level, until one document of the source is left, which is settled by a draw.

So a source misses its target by less than one document.  Draws are hashes of the
documents that meet: reruns agree.  Groups hold about ``fan`` documents however large the
source is, and only ids and sizes move, never texts.

Rows alike in id, source and text, ``rows`` of them, need no pairing among themselves: of the
``rows`` * fraction more that they are to be taken, the whole part is sure and one document with
the rest goes through the tree.  So ``ups`` of the rows are taken once more than the others.

Null texts and texts of white space have size 0 and are taken 0 times.  Columns of docs other
than id, source and text don't matter and may have any names.  Texts may be of any length; only
their number of words moves.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Bitmap, col, cut, fresh, uniform

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Documents that a group of the reduction tree holds, about.
FAN = 64
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of the text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame, order: str, rank: str, parts: int = 32) -> DataFrame:
    """sources with their rank from 0 in code point order, null last, without one task that sees all."""
    key = F.struct(F.col(order).isNull().alias("none"), F.coalesce(F.col(order), F.lit("")).alias("value"))
    dealt = cut(sources.withColumn("_key", key).repartitionByRange(parts, "_key").withColumn("_part", F.spark_partition_id()))
    own = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    counts = dealt.groupBy("_part").count()
    # One row per partition: at most ``parts`` rows.
    before = counts.withColumn(
        "_before",
        F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    joined = own.join(F.broadcast(before), "_part")
    return joined.withColumn(rank, (F.col("_before") + F.col("_place") - 1).cast("long")).drop(
        "_key", "_part", "_place", "_before"
    )


def _targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """sources (source_size, weight) with their targets; a pass over the sources for each resharing."""
    limit = F.col("source_size") * F.lit(cap)
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    weight = sources.filter("source_size > 0").agg(F.sum("weight")).first()[0]
    level, before = (total / weight if weight else 0.0), None
    while level != before:
        above = F.col("weight") * F.lit(level) >= limit
        full, free = sources.agg(
            F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if not free:
            level = float("inf")
            break
        before, level = level, max(level, (total - (full or 0)) / free)
    target = limit if level == float("inf") else F.least(limit, F.col("weight") * F.lit(level))
    return sources.withColumn("target", target.cast("double"))


#: A carried document i meets a document j: masses are words, p the fractions.  The words of
#: j that raise i to 1 or lower j to 0 are moved with such odds that expectations stay.
_MEET = """
aggregate(members, cast(null as struct<carry: {unit}, done: array<struct<key: {key}, up: int>>>), (s, j) ->
  if(s is null, struct(j as carry, cast(array() as array<struct<key: {key}, up: int>>) as done),
  transform(transform(array(struct(
      s.carry as i,
      least((1 - s.carry.p) * s.carry.mass, j.p * j.mass) as more,
      least(s.carry.p * s.carry.mass, (1 - j.p) * j.mass) as less)),
    v -> struct(v.i as i, v.more as more, v.less as less,
      pmod(xxhash64({seed}L, v.i.key, j.key), 4503599627370496) / 4503599627370496D * (v.more + v.less) < v.less as rise)),
    v -> case
      when v.rise and (1 - v.i.p) * v.i.mass <= j.p * j.mass then struct(
        named_struct('key', j.key, 'mass', j.mass, 'p', greatest(0D, j.p - v.more / j.mass)) as carry,
        s.done || array(struct(v.i.key as key, 1 as up)) as done)
      when v.rise then struct(
        named_struct('key', v.i.key, 'mass', v.i.mass, 'p', least(1D, v.i.p + v.more / v.i.mass)) as carry,
        s.done || array(struct(j.key as key, 0 as up)) as done)
      when v.i.p * v.i.mass <= (1 - j.p) * j.mass then struct(
        named_struct('key', j.key, 'mass', j.mass, 'p', least(1D, j.p + v.less / j.mass)) as carry,
        s.done || array(struct(v.i.key as key, 0 as up)) as done)
      else struct(
        named_struct('key', v.i.key, 'mass', v.i.mass, 'p', greatest(0D, v.i.p - v.less / v.i.mass)) as carry,
        s.done || array(struct(j.key as key, 1 as up)) as done)
    end)[0]))
"""


def _rounded(units: DataFrame, key_type: str, fan: int, seed: int) -> DataFrame:
    """units (source, groups, group, key, mass, p) settled: (key, up), a row for each."""
    unit = f"struct<key: {key_type}, mass: double, p: double>"
    meet = F.expr(_MEET.format(unit=unit, key=key_type, seed=seed))
    most = units.agg(F.max("groups")).first()[0]
    settled = None
    while most:
        member = F.struct(F.xxhash64(F.lit(seed), "key").alias("order"), "key", "mass", "p")
        folded = units.groupBy("source", "groups", "group").agg(F.array_sort(F.collect_list(member)).alias("members"))
        members = F.expr(f"transform(members, x -> cast(named_struct('key', x.key, 'mass', x.mass, 'p', x.p) as {unit}))")
        folded = cut(folded.withColumn("members", members).select("source", "groups", "group", meet.alias("s")))
        done = folded.select(F.explode("s.done").alias("d")).select("d.key", "d.up")
        settled = done if settled is None else settled.unionByName(done)
        draw = uniform(F.lit(seed), F.lit("last"), F.col("s.carry.key")) < F.col("s.carry.p")
        last = folded.filter("groups = 1").select("s.carry.key", draw.cast("int").alias("up"))
        settled = settled.unionByName(last)
        units = folded.filter("groups > 1").select(
            "source",
            F.ceil(F.col("groups") / fan).cast("long").alias("groups"),
            F.floor(F.col("group") / fan).cast("long").alias("group"),
            "s.carry.*",
        )
        most = -(-most // fan) if most > 1 else 0
    return settled if settled is not None else units.select("key", F.lit(0).alias("up"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    fan: int = FAN,
    seed: int = 0,
) -> DataFrame:
    """What the mix takes: id, source, size, content, rows, source_size, target, base and ups.

    One row for each group of rows alike in id, source and text (``content`` is a hash of
    the text, ``rows`` their number); each of these rows is to be taken ``base`` times, and
    ``ups`` of them once more.
    """
    read = docs.select(
        col(id_col).alias("id"),
        col(source_col).cast("string").alias("source"),
        words(col(text_col)).alias("size"),
        F.xxhash64(col(text_col)).alias("content"),
    )
    units = cut(read.groupBy("id", "source", "size", "content").agg(F.count(F.lit(1)).alias("rows")))
    sources = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("units")
    )
    order = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut(
        ranked(sources, "source", "rank").withColumn(
            "weight", F.element_at(order, (F.col("rank") % len(weights) + 1).cast("int"))
        )
    )
    shares = cut(_targets(sources, share, cap).select(F.col("source").alias("name"), "source_size", "target", "units"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = units.join(shares, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    known = known.withColumn("base", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("int"))
    more = F.when(F.col("size") > 0, F.col("rows") * (rate - F.floor(rate))).otherwise(0.0)
    known = known.withColumn("sure", F.least(F.floor(more), "rows")).withColumn("p", more - F.floor(more))
    open_ = F.col("p") > 0
    kept = ["id", "size", "content", "rows", "source", "source_size", "target", "base", "sure"]
    groups = F.ceil(F.col("units") / fan).cast("long")
    fractional = known.filter(open_).select(
        "source",
        groups.alias("groups"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("group"), "id", "content"), groups).alias("group"),
        F.struct(*kept).alias("key"),
        F.col("size").cast("double").alias("mass"),
        "p",
    )
    key_type = fractional.schema["key"].dataType.simpleString()
    settled = _rounded(fractional, key_type, fan, seed).select("key.*", "up")
    both = known.filter(~open_).select(*kept, F.lit(0).alias("up")).unionByName(settled)
    return both.withColumn("ups", F.col("sure") + F.col("up")).drop("sure", "up")


#: Parts that rows alike in id, source and text are dealt to, to be numbered.
PARTS = 256


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    mine = docs.columns
    i, s, c, base, ups, rows, maybe = names = fresh(docs, "i", "s", "c", "base", "ups", "rows", "maybe")
    taken = mix(docs, id_col, text_col, source_col, **options).filter("base > 0 or ups > 0")
    taken = taken.select(*[F.col(x).alias(y) for x, y in zip(("id", "source", "content", "base", "ups", "rows"), names[:6])])
    same = (
        col(id_col).eqNullSafe(F.col(i))
        & col(source_col).cast("string").eqNullSafe(F.col(s))
        & (F.xxhash64(col(text_col)) == F.col(c))
    )
    taken = cut(taken)
    alike = (F.col(ups) == 0) | (F.col(ups) == F.col(rows))
    copies = F.col(base) + (F.col(ups) > 0).cast("int")
    out = docs.join(taken.filter(alike), same).withColumn(rows, copies)
    # Of rows that are alike some are taken once more: they are numbered, in parts, so that no task numbers a large group.
    # A bitmap tells the few rows that this may be about, so the others aren't joined again.
    some = taken.filter(~alike)
    marked = Bitmap(some, [c]).mark(docs.withColumn(c, F.xxhash64(col(text_col))), maybe).filter(maybe).drop(c, maybe)
    met = marked.join(some, same)
    part, place, before = fresh(met, "part", "place", "before")
    unlike = met.withColumn(part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PARTS)))
    unlike = cut(unlike)
    key = [i, s, c]
    earlier = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = unlike.groupBy(*key, part).count().select(*key, part, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    at = unlike.withColumn(place, F.row_number().over(Window.partitionBy(*key, part).orderBy(F.lit(0))))
    i2, s2, c2, part2 = fresh(at.withColumn(before, F.lit(0)), "i2", "s2", "c2", "part2")
    sizes = sizes.toDF(i2, s2, c2, part2, before)
    match = F.col(i).eqNullSafe(F.col(i2)) & F.col(s).eqNullSafe(F.col(s2)) & (F.col(c) == F.col(c2)) & (F.col(part) == F.col(part2))
    numbered = at.join(sizes, match).withColumn(rows, F.col(base) + (F.col(before) + F.col(place) <= F.col(ups)).cast("int"))
    every = out.select(*[col(x) for x in mine], rows).unionByName(numbered.select(*[col(x) for x in mine], rows)).filter(F.col(rows) > 0)
    return every.withColumn(rows, F.explode(F.sequence(F.lit(1).cast("long"), F.col(rows).cast("long")))).select(*[col(x) for x in mine])
