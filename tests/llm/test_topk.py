import math
import random

from pyspark.sql import functions as F

from plumbline.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(rows, k):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: min(v for j, v in sound if j == i) for i, _ in sound if i % 5 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)[:k]
        out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def search(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0, **options).select("query_id", "rank", "vec_id", "score").collect()))


def test_matches_brute_force(spark):
    dice = random.Random(1)
    rows = [(i, [dice.gauss(0, 0.2) for _ in range(64)], "x") for i in range(400)]
    rows += [(1000 + i, rows[3][1], "x") for i in range(90)]
    rows += [(2000, None, "x"), (2001, [None] * 64, "x"), (2002, [float("nan")] * 64, "x"), (2005, [float("inf")] * 64, "x"), (2010, [0.5] * 7, "x"), (2011, [], "x"), (None, [0.1] * 64, "x")]
    assert search(spark, rows) == brute(rows, 5)
    assert search(spark, rows, round_size=20, block=32, k=3) == brute(rows, 3)


def test_few_rows_and_none(spark):
    assert search(spark, [(0, [1.0, 2.0], "x"), (1, [0.5, -1.0], "x")]) == brute([(0, [1.0, 2.0], "x"), (1, [0.5, -1.0], "x")], 5)
    assert search(spark, [(0, [1.0], "x")]) == []
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 5 == 0).count() == 0


def test_large_numbers_and_repeated_ids(spark):
    rows = [(0, [1e12, 1.0], "x"), (1, [1e15, 2.0], "x"), (2, [-3e14, 0.0], "x"), (5, [0.0, 1e-3], "x"), (5, [0.0, 1e-3], "x")]
    assert search(spark, rows) == brute(rows, 5)
