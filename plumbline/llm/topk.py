"""Exact top-k search by columnar branch and bound.

Vectors are turned into integers, floor(256 * x).  Candidates lie in blocks in vertical
layout, a row for each dimension.  For each query the inner products of a block are
accumulated a few dimensions at a time, the query's heaviest dimensions first; after each
step a candidate's product so far plus the most that its remaining mass can add (the
product of the norms of what is left of both vectors) is held against the k-th best score
so far, and the arrays are compacted to the candidates that can still reach it.

Queries are a stated share of the rows.  They go to the executors in rounds of about
``round_size`` vectors; each round reads all candidates, keeps at most k rows for each query
and task, and is written before the next begins, so what the driver holds and sends is one
round's vectors however many there are.

Vectors that are null or hold a null or non-finite component take no part; neither do
rows without an id.  Of vectors of different lengths the shorter counts as filled up with
zeros.  Ties go to the smaller id; rows that repeat an id are candidates of their own,
save those with the query's id, and one query, with the least of their vectors.  Scores beyond
64 bits are held at the limits.  A table without queries or without candidates gives an empty
result; vectors may be of any length; columns other than id and vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, cut, released

SCALE = 256
#: Query vectors of a round, and candidates of a block.
ROUND, BLOCK = 16384, 8192
#: Dimensions that are accumulated before candidates are held against the bound.
STEP = 8
SCHEMA = "query_id long, vec_id long, score long"
_LOW, _HIGH = -(2**63), 2**63 - 1


def quantised(vectors: pd.Series, dims: int = 0) -> np.ndarray:
    """A row of integers for each vector, filled up with zeros; of Python's integers where 64 bits could overflow."""
    dims = max(dims, max((len(v) for v in vectors), default=0))
    floats = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        floats[i, : len(v)] = v
    floats = np.floor(floats * SCALE)
    if floats.size and np.abs(floats).max() ** 2 * max(dims, 1) >= 2.0**61:
        return np.array([[int(x) for x in row] for row in floats], dtype=object).reshape(floats.shape)
    return floats.astype(np.int64)


class _Query:
    """A query's dimensions, heaviest first, and the norm of what is left after each step."""

    def __init__(self, vector: np.ndarray) -> None:
        self.order = np.argsort(-np.abs(vector.astype(float)), kind="stable")
        self.values = vector[self.order]
        squares = self.values.astype(float)[::-1] ** 2
        self.left = np.sqrt(np.cumsum(squares)[::-1])


def search_block(queries: list[tuple[int, _Query]], ids: np.ndarray, vectors: np.ndarray, best: dict, k: int) -> None:
    """Updates best: for each query's place, its k best (score, id) so far."""
    columns = np.ascontiguousarray(vectors.T)
    dims = len(columns)
    norms = (columns.astype(float) ** 2).sum(axis=0)
    for place, (query_id, q) in enumerate(queries):
        scores, kept = best.get(place, (np.zeros(0, vectors.dtype), np.zeros(0, np.int64)))
        bar = float(scores[-1]) if len(scores) == k else -np.inf
        alive = np.flatnonzero(ids != query_id)
        so_far = np.zeros(len(alive), vectors.dtype)
        mass = norms[alive]
        for at in range(0, dims, STEP):
            if not len(alive):
                break
            now = q.order[at : at + STEP]
            block = columns[now][:, alive] if len(alive) < columns.shape[1] // 2 else columns[now].take(alive, axis=1)
            so_far = so_far + q.values[at : at + STEP] @ block
            if bar > -np.inf and at + STEP < dims and vectors.dtype != object:
                mass = mass - (block.astype(float) ** 2).sum(axis=0)
                most = so_far.astype(float) + q.left[at + STEP] * np.sqrt(np.maximum(mass, 0))
                # A little slack: floats round, and equal scores must stay.
                live = most >= bar - 1e-6 * (1 + abs(bar)) - 1e-9 * np.abs(most)
                if not live.all():
                    alive, so_far, mass = alive[live], so_far[live], mass[live]
        if len(alive):
            own = ids[alive]
            if len(alive) > 4 * k:
                high = so_far >= np.partition(so_far, len(so_far) - k)[len(so_far) - k]
                own, so_far = own[high], so_far[high]
            scores, kept = np.concatenate([scores, so_far]), np.concatenate([kept, own])
            first = np.lexsort((kept, -scores.astype(object) if scores.dtype == object else -scores))[:k]
            best[place] = (scores[first], kept[first])


def _searcher(query_ids: np.ndarray, query_rows: np.ndarray, k: int, block: int):
    @released
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        queries: dict[int, list] = {}

        def look(ids: list, rows: list) -> None:
            vectors = quantised(pd.Series(rows), query_rows.shape[1])
            own = query_rows
            largest = float(np.abs(vectors.astype(float)).max(initial=0)) * float(np.abs(own.astype(float)).max(initial=0))
            if object in (vectors.dtype, own.dtype) or largest * vectors.shape[1] >= 2.0**61:
                vectors, own = vectors.astype(object), own.astype(object)
            wide = (vectors.shape[1], own.dtype.kind)
            if wide not in queries:
                filled = np.zeros((len(own), wide[0]), own.dtype)
                filled[:, : own.shape[1]] = own
                queries[wide] = [(i, _Query(v)) for i, v in zip(query_ids, filled)]
            search_block(queries[wide], np.array(ids, np.int64), vectors, best, k)

        ids, rows = [], []
        for batch in batches:
            ids += batch["vec_id"].tolist()
            rows += batch["vector"].tolist()
            while len(ids) >= block:
                look(ids[:block], rows[:block])
                ids, rows = ids[block:], rows[block:]
        if ids:
            look(ids, rows)
        for place, (scores, kept) in best.items():
            held = [min(max(int(s), _LOW), _HIGH) for s in scores]
            yield pd.DataFrame({"query_id": query_ids[place], "vec_id": kept, "score": np.array(held, np.int64)})

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    round_size: int = ROUND,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows but its own."""
    vector = col(vector_col).cast("array<double>")
    sound = F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )
    read = vectors.select(col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), is_query.alias("is_query"))
    read = read.filter(sound & F.col("vec_id").isNotNull())
    asked = read.filter("is_query").select("vec_id", "vector")
    candidates = read.select("vec_id", "vector")
    rounds = max(1, -(-asked.count() // round_size))
    found = None
    for n in range(rounds):
        own = asked.filter(F.pmod(F.xxhash64(F.lit("round"), "vec_id"), F.lit(rounds)) == n) if rounds > 1 else asked
        # About round_size rows: a round's queries, not the corpus.
        rows = own.groupBy("vec_id").agg(F.min("vector").alias("vector")).toPandas().sort_values("vec_id")
        if rows.empty:
            continue
        search = _searcher(rows["vec_id"].to_numpy(np.int64), quantised(rows["vector"]), k, block)
        part = candidates.mapInPandas(search, SCHEMA)
        if rounds > 1:
            part = cut(_best(part, k).drop("rank"))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = candidates.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score"))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
