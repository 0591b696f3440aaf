import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm.mixing import mix, ranked, take
from plumbline.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, source string, copies string"


def brute_targets(sizes):
    """sizes: source -> size; resharing done literally."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, targets, free = 1.5 * sum(sizes.values()), dict.fromkeys(names, 0.0), [s for s in names if sizes[s]]
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > 2 * sizes[s]]
        if not above:
            targets |= {s: unit * weight[s] for s in free}
            break
        for s in above:
            targets[s] = 2.0 * sizes[s]
            left -= targets[s]
        free = [s for s in free if s not in above]
    return targets


def rows():
    made = []
    for i in range(900):
        source = None if i % 50 == 7 else "s0" if i % 3 == 0 else f"s{i % 11}"
        made.append((i, " ".join(["w"] * (1 + i * 7919 % 97)), source, "x"))
    return made + [(900, None, "s1", "x"), (901, " \n", "s1", "x"), (5, made[5][1], made[5][2], "x"), (902, None, "empty", "x")]


def test_targets_and_words(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = [r.asDict() for r in mix(docs).collect()]
    sizes = {}
    for _, text, source, _ in rows():
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert sum(r["rows"] for r in got) == len(rows())
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * (1 + targets[r["source"]])
        assert 0 <= r["base"] and 0 <= r["ups"] <= r["rows"] and r["base"] + (r["ups"] > 0) <= 2
        taken[r["source"]] += (r["base"] * r["rows"] + r["ups"]) * r["size"]
    for source, words in taken.items():
        assert abs(words - targets[source]) <= 2 * 97, (source, words, targets[source])


def test_reruns_agree_however_rows_lie(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    first = sorted(map(tuple, mix(docs).select("id", "content", "base", "ups").collect()), key=str)
    again = sorted(map(tuple, mix(docs.repartition(7, F.rand(3))).select("id", "content", "base", "ups").collect()), key=str)
    assert first == again


def test_expectations_stay(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "a" if i < 40 else "b", "x") for i in range(60)], SCHEMA)
    means = [0.0] * 60
    for seed in range(12):
        for r in mix(docs, fan=4, seed=seed).collect():
            means[r["id"]] += (r["base"] + r["ups"]) / 12
    rate = {s: next(r["target"] / r["source_size"] for r in mix(docs).collect() if r["source"] == s) for s in "ab"}
    assert abs(sum(means[:40]) / 40 - rate["a"]) < 0.12
    assert max(abs(m - rate["a" if i < 40 else "b"]) for i, m in enumerate(means)) < 0.75


def test_take_repeats_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    wanted = {}
    for r in mix(docs).collect():
        wanted[r.id] = wanted.get(r.id, 0) + r.base * r.rows + r.ups
    got = {r.doc_id: r["count"] for r in take(docs).groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in wanted.items() if v}
    assert take(docs).columns == docs.columns


@pytest.mark.parametrize("n, words", [(10, 100), (1000, 3), (1, 7)])
def test_a_source_of_equal_rows(spark, n, words):
    # The others' excess leaves this source a share between once and twice its size.
    text = "w " * words
    data = [(1, text, "a", "x")] * n + [(i, text, "b", "x") for i in range(2, 2 + 2 * n)]
    docs = spark.createDataFrame(data, SCHEMA)
    target = brute_targets({"a": n * words, "b": 2 * n * words})
    taken = {r.source: r.words for r in take(docs).groupBy("source").agg((F.count(F.lit(1)) * words).alias("words")).collect()}
    for source in "ab":
        assert abs(taken[source] - target[source]) <= words
    each = take(docs.filter("source = 'a'").withColumn("n", F.monotonically_increasing_id())).groupBy("n").count().collect()
    assert max(r["count"] for r in each) - min(r["count"] for r in each) <= 1 and max(r["count"] for r in each) <= 2


def test_the_registered_query(spark, tmp_path):
    docs = spark.createDataFrame(rows() + [(7, "a b", "s1", "x")] * 9, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.asDict() for r in QUERIES["op8_mixing"](spark, str(tmp_path)).collect()]
    assert sorted(r["doc_id"] for r in got) == sorted(r.doc_id for r in docs.collect())
    by_source = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        one = by_source.setdefault(r["source"], [0, 0, r["target"]])
        one[0] += r["taken"]
        one[1] += r["size"]
    targets = brute_targets({s: x[1] for s, x in by_source.items()})
    assert all(abs(x[0] - targets[s]) <= 97 and abs(x[2] - targets[s]) < 1e-6 * (1 + targets[s]) for s, x in by_source.items())


def test_ranks(spark):
    names = ["b", None, "é", "B", "", "a", "z", "\U0001f600", "ab"]
    df = spark.createDataFrame([(x,) for x in names], "source string")
    got = [r.source for r in sorted(ranked(df, "source", "rank").collect(), key=lambda r: r.rank)]
    assert got == sorted([x for x in names if x is not None]) + [None]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mix(docs).count() == 0 and take(docs).count() == 0
    assert mix(spark.createDataFrame([(1, None, None, "x")], SCHEMA)).first()[-2:] == (0, 0)
