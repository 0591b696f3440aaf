"""Exact deduplication by progressive refinement.

Documents are grouped by length, then by a hash of their first characters, then by a
hash of the whole text.  Each level looks only at documents of groups that the level
before left with more than one row.  What a level leaves is sent to the next as a bitmap
of bounded size, so no text is shuffled to find out whether a document can have a copy; a
full bitmap costs time, never a result.

Texts are equal when identical after lower-casing A-Z.  Null texts count as empty.  Of
equal texts the row with the largest id stays; null ids are smaller than any other.
Rows that repeat both id and text share one decision in ``exact_dedup``; ``drop_copies``
keeps one of them.  Input columns named like a result column are replaced.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Bitmap, ascii_lower, col, fresh, without

#: Characters that the second level hashes.
PREFIX = 64
RESULT = ("keep_id", "group_size", "kept")


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has."""
    return df.groupBy(*keys).count().filter("count > 1").select(*keys)


def _refined(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, str, str, str]:
    """docs with its length, its prefix hash and whether its text may have a copy; these columns' names."""
    n, prefix, full, maybe, first = fresh(docs, "n", "prefix", "full", "maybe", "first")
    text = col(text_col)
    sized = docs.withColumn(n, F.octet_length(F.coalesce(text, F.lit(""))))
    by_length = Bitmap(_repeated(sized, n), [n])
    marked = by_length.mark(sized, first)
    marked = marked.withColumn(
        prefix, F.when(F.col(first), F.xxhash64(normalised(F.substring(text, 1, PREFIX))))
    )
    by_prefix = Bitmap(_repeated(marked.filter(first), n, prefix), [n, prefix])
    marked = by_prefix.mark(marked, maybe).withColumn(maybe, F.col(first) & F.col(maybe)).drop(first)
    return marked, n, prefix, full, maybe


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id (id of the row that stays), group_size and kept."""
    docs = without(docs, [c for c in RESULT if c not in (id_col, text_col)])
    marked, n, prefix, full, maybe = _refined(docs, text_col)
    copies = marked.filter(maybe).withColumn(full, digest(col(text_col)))
    same, keep, size = fresh(copies, "same", "keep", "size")
    groups = (
        copies.groupBy(n, prefix, full)
        .agg(F.max(col(id_col)).alias(keep), F.count(F.lit(1)).alias(size))
        .filter(F.col(size) > 1)
        .select(F.col(full).alias(same), keep, size)
    )
    # Joined by the hash alone: both sides are dealt anew, so a large group can be split between tasks.
    joined = copies.join(groups, F.col(full) == F.col(same), "left")
    found = F.col(size).isNotNull()
    mine = [col(c) for c in docs.columns]
    result = joined.select(
        *mine,
        F.when(found, F.col(keep)).otherwise(col(id_col)).alias("keep_id"),
        F.coalesce(F.col(size), F.lit(1).cast("long")).alias("group_size"),
    )
    alone = marked.filter(~F.col(maybe)).select(
        *mine, col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    )
    return alone.unionByName(result).withColumn("kept", col(id_col).eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts; the columns are those of docs."""
    marked, n, prefix, full, maybe = _refined(docs, text_col)
    copies = marked.filter(maybe).withColumn(full, digest(col(text_col)))
    (row,) = fresh(copies, "row")
    packed = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    # Null ids are smaller than any other; Spark's max_by skips null orderings.
    order = F.struct(col(id_col).isNotNull(), col(id_col))
    kept = copies.groupBy(n, prefix, full).agg(F.max_by(packed, order).alias(row))
    kept = kept.select(*[F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    return marked.filter(~F.col(maybe)).select(*[col(c) for c in docs.columns]).unionByName(kept)
