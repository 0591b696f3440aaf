"""Exact percentiles without holding a group in one task.

Spark's exact percentile keeps every distinct value of a group in one buffer.  Here a
sketch first tells, for each group, two values that the percentile must lie between (its
rank error is bounded); then the values below are only counted, and the few in between are
counted by value and added up.  What one task sees of a group is a small share of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's rank error is at most rows / ACCURACY.
ACCURACY = 10_000


def exact_percentile(rows: DataFrame, by: list[str], value: str, q: float, out: str, nearest_rank: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """by and out: the percentile of value at q, interpolated, or the least value with a cumulated share of at least q.

    Null values don't count; a group without any has a null percentile, or no row for a nearest rank.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    slim = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col(value).alias("v"))
    # The sketch's error, and two rows more, which are less than that again where a band is used.
    edge = 4 / accuracy
    sketch = F.percentile_approx("v", [max(0.0, q - edge), min(1.0, q + edge)], accuracy)
    told = slim.groupBy(*keys).agg(F.count("v").alias("n"), sketch.alias("band"), F.min("v").alias("least"), F.max("v").alias("most"))
    # Groups of few rows need no band; at the ends of the range it is open.
    few = F.col("n") <= accuracy
    low = F.when(few | F.lit(q - edge <= 0), F.col("least")).otherwise(F.col("band")[0])
    high = F.when(few | F.lit(q + edge >= 1), F.col("most")).otherwise(F.col("band")[1])
    groups = told.select(*[F.col(k).alias(f"g{k}") for k in keys], "n", low.alias("low"), high.alias("high"))

    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"g{k}"))
    counted = slim.filter("v is not null").join(groups, same) if keys else slim.filter("v is not null").join(F.broadcast(groups))
    inside = F.when(F.col("v") >= F.col("low"), F.col("v"))
    # Below the band everything is one row for each group, with a null value.
    counts = counted.filter(F.col("v") <= F.col("high")).groupBy(*keys, inside.alias("v"), "n").agg(F.count(F.lit(1)).alias("c"))
    reach = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    summed = counts.withColumn("reach", reach).filter("v is not null")
    place = F.lit(q) * (F.col("n") - 1)
    if nearest_rank:
        found = summed.groupBy(*keys).agg(F.min(F.when(F.col("reach") / F.col("n") >= q, F.col("v"))).alias(out))
        return found.select(*[F.col(k).alias(b) for k, b in zip(keys, by)], out)
    ends = summed.groupBy(*keys, "n").agg(
        F.min(F.when(F.col("reach") > F.floor(place), F.col("v"))).alias("a"), F.min(F.when(F.col("reach") > F.ceil(place), F.col("v"))).alias("b")
    )
    between = F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))
    found = ends.select(*[F.col(k).alias(f"f{k}") for k in keys], between.alias(out))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"g{k}").eqNullSafe(F.col(f"f{k}"))
    whole = groups.join(found, same, "left") if keys else groups.join(F.broadcast(found), how="left")
    return whole.select(*[F.col(f"g{k}").alias(b) for k, b in zip(keys, by)], out)


def nearest_ranks(rows: DataFrame, value: str, quantiles: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """One row, a column for each name: the least value with a cumulated share of at least its quantile; null without values.

    All bands come from one pass and are counted in a second one.  What lies between two bands is
    one row, placed before the values of the band above it.
    """
    edge, names = 4 / accuracy, list(quantiles)
    marks = [max(0.0, min(1.0, q + side)) for q in quantiles.values() for side in (-edge, edge)]
    slim = rows.select(F.col(value).alias("v")).filter("v is not null")
    told = slim.agg(F.count("v").alias("n"), F.percentile_approx("v", marks, accuracy).alias("band"), F.min("v").alias("least"), F.max("v").alias("most"))
    few = F.col("n") <= accuracy
    lows = [F.when(few | F.lit(q - edge <= 0), F.col("least")).otherwise(F.col("band")[2 * i]).alias(f"low{i}") for i, q in enumerate(quantiles.values())]
    highs = [F.when(few | F.lit(q + edge >= 1), F.col("most")).otherwise(F.col("band")[2 * i + 1]).alias(f"high{i}") for i, q in enumerate(quantiles.values())]
    met = slim.join(F.broadcast(told.select("n", *lows, *highs)))
    inside, part = F.lit(False), F.lit(0)
    for i in range(len(names)):
        inside = inside | F.col("v").between(F.col(f"low{i}"), F.col(f"high{i}"))
        part = part + (F.col("v") > F.col(f"high{i}")).cast("int")
    counts = met.groupBy(part.alias("part"), F.when(inside, F.col("v")).alias("v"), "n").agg(F.count(F.lit(1)).alias("c"))
    order = Window.orderBy("part", F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    reach = counts.withColumn("reach", F.sum("c").over(order)).filter("v is not null")
    return reach.agg(*[F.min(F.when(F.col("reach") / F.col("n") >= q, F.col("v"))).alias(name) for name, q in quantiles.items()])
