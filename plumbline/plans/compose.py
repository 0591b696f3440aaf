"""Many leaves, one table: each metric keeps its own grain, absent values stay null.

Leaves alike in all but measures are aggregated once.  The aggregated leaves are then
stacked, each with nulls for the others' metrics, and folded by their dimensions.  That is
one exchange of rows that are already aggregated, whatever the number of leaves; grouping
takes null dimensions as equal, so no null-safe joins against a spine are needed.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.leaf import Leaf

#: Leaves of these kinds carry all columns of their source, so their rows serve other measures.
_SHARED = {"single", "distinct"}


def fuse(leaves: list[Leaf]) -> list[Leaf]:
    out: dict[tuple, Leaf] = {}
    for i, leaf in enumerate(leaves):
        key = leaf.key if leaf.key[0] in _SHARED else (*leaf.key, i)
        if key in out:
            out[key] = replace(out[key], aggregates=[*out[key].aggregates, *leaf.aggregates])
        else:
            out[key] = leaf
    return list(out.values())


def stack(leaves: list[Leaf], by: list[str], metrics: list[str]) -> DataFrame:
    """The leaves' metrics by the dimensions, and is_final if any leaf has it."""
    final = any(leaf.final for leaf in leaves)
    keys = [*by, "is_final"] if final else by
    parts = [leaf.aggregated() for leaf in leaves]
    if final:
        parts = [p if leaf.final else p.withColumn("is_final", F.lit(True)) for p, leaf in zip(parts, leaves)]
    if len(parts) == 1:
        return parts[0].select(*keys, *metrics)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.groupBy(*keys).agg(*[F.first(m, ignorenulls=True).alias(m) for m in metrics])


def ratio(numerator: Column, denominator: Column, on_zero: str) -> Column:
    """Division after aggregation, in doubles: integers never truncate."""
    n, d = numerator.cast("double"), denominator.cast("double")
    if on_zero == "error":
        return n / d
    out = n / F.nullif(d, F.lit(0.0))
    return F.coalesce(out, F.lit(0.0)) if on_zero == "zero" else out
