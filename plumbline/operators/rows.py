"""Row-choosing operators: one row per key, by aggregation rather than by sorting windows.

Both pick with min_by / max_by, so tasks reduce their own rows before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row_per_grain(rows: DataFrame, grain: list[str], order: list[str]) -> DataFrame:
    """For each grain its first row by the order columns, nulls last.

    Columns that are neither are functions of the grain, so any row's will do.
    """
    rest = [c for c in rows.columns if c not in (*grain, *order)]
    made = [F.any_value(F.col(f"`{c}`")).alias(c) for c in rest]
    if not order:
        return rows.groupBy(*grain).agg(*made) if made else rows.select(*grain).distinct()
    parts = [p for c in order for p in (F.col(c).isNull().alias(f"null_{c}"), F.col(c))]
    first = rows.groupBy(*grain).agg(F.min(F.struct(*parts)).alias("__first"), *made)
    return first.select(*grain, *[F.col(f"__first.{c}").alias(c) for c in order], *[F.col(f"`{c}`") for c in rest])


def collapse_edges(rows: DataFrame, keys: list[str], at: str, edge: str) -> DataFrame:
    """For each key the row with the last (or first) value of ``at``, null values after all others.

    Ties are broken by the other columns, so reruns agree.
    """
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    if edge == "last":
        chosen = F.max_by(packed, F.struct(F.col(at), packed))
    else:
        chosen = F.min_by(packed, F.struct(F.col(at).isNull(), F.col(at), packed))
    kept = rows.groupBy(*keys).agg(chosen.alias("__row"), F.count(F.lit(1)).alias("__n"))
    return kept.where("__n > 0").select(*keys, *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(rest)])
