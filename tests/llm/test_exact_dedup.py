import hashlib

from plumbline.llm.common import Bitmap
from plumbline.llm.exact_dedup import digest, drop_copies, exact_dedup
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, keep_id string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    texts = [None, "", "a", "A", "É", "é", "ÉA", "Éa", "x" * 100 + "1", "x" * 100 + "2", "X" * 100 + "1", "w " * 60_000, "W " * 60_000, "ß", "SS", "İ", "ab", "ba"]
    made = [(i * 10 + j, t, "old", "n") for i, t in enumerate(texts) for j in range(1 + i % 3)]
    return made + [(None, "a", "old", "n"), (None, "alone", "old", "n"), (5000, "twice", "old", "n"), (5000, "twice", "old", "n")]


def brute():
    groups = {}
    for i, t, *_ in rows():
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return {k: (max((x for x in v if x is not None), default=None), len(v)) for k, v in groups.items()}


def check(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    out = exact_dedup(docs.withColumn("sha", digest(F.col("text")))).collect()
    assert len(out) == len(rows())
    for r in out:
        same = (r.text or "").translate(LOWER)
        assert (r.keep_id, r.group_size) == brute()[same]
        assert r.kept == (r.doc_id == r.keep_id) and r.n == "n"
        assert r.sha == hashlib.sha256(same.encode()).hexdigest()
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(keep) for keep, _ in brute().values())


def test_groups(spark):
    check(spark)


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(Bitmap, "MOST_BITS", 0)
    check(spark)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(docs).count() == 0 and drop_copies(docs).count() == 0
