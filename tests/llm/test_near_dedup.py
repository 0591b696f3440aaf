import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.llm import near_dedup
from plumbline.llm.common import components
from plumbline.llm.near_dedup import bags, bands, drop_near_copies, expanded, forest, near_classes, overlap, overlaps, signatures

SCHEMA = "doc_id long, text string, th string"


def bag(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def alike(a, b):
    common = sum((a & b).values())
    both = sum(a.values()) + sum(b.values()) - common
    return common / both if both else 1.0


def brute(texts):
    bags_ = [bag(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if alike(bags_[i], bags_[j]) >= 0.8:
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(i)
    return sorted(map(tuple, groups.values()))


def made(seed=0):
    dice = random.Random(seed)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(3))
    texts = []
    for g in range(25):
        base = [word() for _ in range(dice.choice([3, 8, 60, 150, 300]))]
        if g % 4 == 0:
            base = base[:20] * 6
        for _ in range(dice.choice([1, 1, 2, 6, 25])):
            copy = list(base)
            for _ in range(dice.choice([0, 1, 2, 4])):
                copy[dice.randrange(len(copy))] = word()
            texts.append(dice.choice([" ", "  ", "\n"]).join(copy))
    return texts + [None, "", " \t", "one", "One", "ONE two"]


@pytest.mark.parametrize("small, block", [(16, 1024), (2, 3)])
def test_classes_are_those_of_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = made(small)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    out = near_classes(docs).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(tuple(sorted(g)) for g in groups.values()) == brute(texts)
    assert all(min(groups[r.class_id]) == r.class_id and len(groups[r.class_id]) == r.class_size for r in out)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_chains_and_buckets_of_several_classes(spark):
    # Each text differs a little from the one before: one class, though its ends have nothing in common.
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 200]) for i in range(0, 200, 20)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    assert {r.class_id for r in near_classes(docs).collect()} == {0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=40), min_size=1, max_size=8))
def test_bags(texts):
    of, shingle, count = bags(texts)
    sets = [expanded(shingle[of == i], count[of == i]) for i in range(len(texts))]
    wanted = [bag(t) for t in texts]
    for i in range(len(texts)):
        assert sorted(count[of == i].tolist()) == sorted(wanted[i].values())
        for j in range(i):
            assert abs(overlap(sets[i], sets[j]) - alike(wanted[i], wanted[j])) < 1e-12
    every = overlaps(sets, columns=3)
    assert all(abs(every[i, j] - alike(wanted[i], wanted[j])) < 1e-6 for i in range(len(texts)) for j in range(len(texts)))


def test_forest():
    alike = np.zeros((6, 6), bool)
    for a, b in ((0, 1), (1, 2), (0, 2), (4, 5)):
        alike[a, b] = alike[b, a] = True
    edges = list(forest(alike))
    assert len(edges) == 3 and all(alike[a, b] for a, b in edges)


def test_registers_agree_with_the_similarity():
    dice = random.Random(5)
    base = [f"w{dice.randrange(40)}" for _ in range(300)]
    base += ["x y z u v"] * 60
    texts = [" ".join(base), " ".join(base[:-25]), " ".join(base[40:])]
    of, shingle, count = bags(texts)
    times = signatures(of, shingle, count, 3, 4000)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        real = alike(bag(texts[i]), bag(texts[j]))
        assert abs((times[i] == times[j]).mean() - real) < 0.035
    assert bands(times, 1000, 4).shape == (3, 1000)
    assert np.isfinite(times).all()


def test_odd_rows(spark):
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (7, "a b c d e f", "y"), (8, "q", "x"), (8, "q", "x"), (8, "r", "x"), (9, "w " * 50_000, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sorted((str(r.doc_id), r.class_id, r.class_size) for r in near_classes(docs).collect())
    assert out == [("7", 7, 3), ("8", 8, 1), ("8", 8, 2), ("8", 8, 2), ("9", 9, 1), ("None", 7, 3), ("None", 7, 3)]
    assert sorted(tuple(r)[:2] for r in drop_near_copies(docs).collect()) == [(7, "a b c d e f"), (8, "q"), (8, "r"), (9, "w " * 50_000)]
    assert near_classes(docs.limit(0)).count() == 0 and drop_near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(df).collect()}
    assert found == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}
    assert components(df.limit(0)).count() == 0
    assert components(df.select("a", F.col("a").alias("b"))).filter("node != component").count() == 0


def test_edges_of_a_large_bucket_are_fewer_than_its_classes(spark, monkeypatch):
    # One family of n texts of two classes and some strays: what comes out grows with the classes, not with n.
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    dice = random.Random(2)
    base = [f"w{dice.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base[:60] + [f"x{i}"] + base[60:]) for i in range(100)] + [" ".join(base[40:] + [f"y{i}"]) for i in range(20)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA).select(F.col("doc_id").alias("id"), "text")
    nodes = near_dedup._sign(docs, 20, 4).select("key", "th", "n", "id").cache()
    apart = nodes.withColumn("band", F.lit(7).cast("long")).withColumn("component", F.first("key").over(Window.partitionBy(F.col("id") >= 100).orderBy("id")))
    largest = nodes.filter("id = 0").first()["key"]
    edges = near_dedup._in_large(apart.withColumn("largest", F.lit(largest)), nodes, docs, 0.7).collect()
    assert len(edges) == 1
    apart = nodes.withColumn("band", F.lit(7).cast("long")).withColumn("component", F.col("key"))
    edges = near_dedup._in_large(apart.withColumn("largest", F.lit(largest)), nodes, docs, 0.7)
    assert components(edges).select("component").distinct().count() == 1


def test_shuffles_go_once_what_they_made_is_written(spark):
    # Those of 60 steps used to stay on disk until the driver collected its garbage.
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    shuffles = lambda: {int(n) for n in re.findall(r"shuffle_(\d+)_", files())}
    before = max(shuffles(), default=-1)
    out = near_classes(spark.createDataFrame([(i, t, "x") for i, t in enumerate(made())], SCHEMA))
    end = time.time() + 20
    while len(left := {n for n in shuffles() if n > before}) > 15 and time.time() < end:
        time.sleep(0.2)
    assert len(left) <= 15 and out.count() == len(made())
