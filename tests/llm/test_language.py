import re
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from plumbline.llm.language import Classifier, held_out, identify, learn, learn_from, normalised
from plumbline.llm.registry import QUERIES

SCHEMA = "doc_id long, text string, lang string, language string"
WORDS = {"en": "the of and to in is that it was for with".split(), "de": "der die und das nicht mit auf ist für ein zu".split(), "fr": "le la les des est une que pour dans avec été".split()}


def sentence(lang, n):
    words = WORDS[lang]
    return " ".join(words[(n * 7 + i * i + i * n) % len(words)] for i in range(8 + n % 30))


def rows():
    return [(i, sentence(lang, i), lang, "x") for i in range(150) for lang in WORDS if i % 3 == sorted(WORDS).index(lang)]


def test_held_out_documents(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    found = identify(docs, learn_from(docs))
    out = found.select("doc_id", "lang", held_out().alias("held"), F.col("_language.lang_pred").alias("pred"), F.col("_language.score").alias("score")).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(0 <= r.score <= 1 for r in out)
    own = [r for r in out if r.held]
    assert own and sum(r.pred == r.lang for r in own) / len(own) > 0.97


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs, learn_from(docs)).filter(held_out()).select("lang", "language.*").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.96
    assert sum(r.accepted for r in out) / len(out) > 0.98


def test_odd_rows(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    known = learn_from(docs)
    odd = [(1, None, None, "x"), (2, "", None, "x"), (3, "12 !? ___", None, "x"), (None, "mit auf ist für ein zu der nicht", None, "x"), (None, "mit auf ist für ein zu der nicht", None, "x"), (5, " ".join(sentence("en", i) for i in range(2500)), None, "x"), (6, "the " * 60_000, None, "x")]
    out = identify(spark.createDataFrame(odd, SCHEMA), known).select("doc_id", "_language.*", held_out().alias("held")).collect()
    assert [r.lang_pred for r in out[:6]] == ["und", "und", "und", "de", "de", "en"]
    assert [r.accepted for r in out[:6]] == [False, False, False, True, True, True]
    # One word over and over takes each dictionary the same few bytes.
    assert out[6].lang_pred in WORDS and out[6].score <= 1
    assert not out[3].held
    assert identify(docs.limit(0), known).count() == 0
    assert [r.lang_pred for r in identify(docs, {}).select("_language.*").take(1)] == ["und"]
    assert learn_from(docs.limit(0)) == {}


def brute(dictionaries, text):
    """Language and score by plain calls of zstandard, a compressor for each block."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    letters = "".join(c if c.isalnum() and not c.isdecimal() else " " for c in text.lower())
    data, sizes = re.sub(" +", " ", letters).encode(), []
    for lang, content in dictionaries.items():
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.precompute_compress(level=12)
        size = lambda b: len(zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))
        first = max(0, size(content[-256:] + data[:2048]) - size(content[-256:]))
        sizes.append((first + sum(size(data[i : i + 2048]) for i in range(2048, len(data), 2048)), lang))
    sizes.sort()
    return sizes[0][1], 1 / (1 + 2.0 ** -min(sizes[1][0] - sizes[0][0], 60))


def test_the_registered_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    assert any(r.text and len(r.text) < 250 for r in rows)
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    known = [(order[r.doc_id], r) for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    dictionaries = {}
    for lang in {r.lang for _, r in known}:
        own = sorted((not any(c.isalpha() for c in r.text[:1000]), h, r.text[:1000]) for h, r in known if r.lang == lang)[:256]
        dictionaries[lang] = b"".join(normalised(x[2]).encode() + b" " for x in own)[: 1 << 16]
    got = {r.doc_id: r for r in QUERIES["op5_language"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        lang, score = brute(dictionaries, r.text)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].held_out) == (lang, zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert abs(got[r.doc_id].score - score) < 1e-12


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame(rows() * 5, SCHEMA)
    known = learn(docs, samples=4, per_document=50, dictionary=90, languages=2)
    assert len(known) == 2 and all(len(v) <= 90 for v in known.values())


def test_every_label_is_learned(spark):
    labels = [f"l{i:02}" for i in range(80)]
    own = {x: [f"{a}{b}" * 2 for a in (chr(0x4E00 + 40 * i), chr(0x4E11 + 40 * i)) for b in map(chr, range(0x4E20 + 40 * i, 0x4E26 + 40 * i))] for i, x in enumerate(labels)}
    text = {x: " ".join(own[x]) for x in labels}
    docs = [(100 * i + j, "12 34 " * j if i < 70 and j < 5 else text[x], x, "x") for i, x in enumerate(labels) for j in range(7 if i < 70 else 2)]
    df = spark.createDataFrame(docs, SCHEMA)
    known = learn(df, samples=2, dictionary=500)
    assert sorted(known) == labels and all(0 < len(v) <= 400 for v in known.values())
    told = Classifier(learn(df))
    assert [told.predict(text[x])[0] for x in labels] == labels


def test_narrow_margins_are_rejected(spark):
    known = {"a": b"same words in both ", "b": b"same words in both "}
    assert Classifier(known).predict("same words")[::2] == ("a", 0.0)
    docs = spark.createDataFrame([(1, "same words", None, "x")], SCHEMA)
    assert identify(docs, known).first()["_language"].accepted is False


@pytest.mark.parametrize("text", ["é", "日本", "a"])
def test_a_letter_is_enough(text):
    assert Classifier({"x": b"abc", "y": b"def"}).predict(text)[0] in "xy"
