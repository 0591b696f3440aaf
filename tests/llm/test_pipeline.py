import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm.language import LEAST_MARGIN, Classifier, learn_from
from plumbline.llm.mixing import mix
from test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact", "near", "mixing", "tokens"]

    def step(name, docs):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, out.collect()

    rows = docs.collect()
    classifier = Classifier(learn_from(docs))
    wanted = {r.doc_id for r in rows if classifier.predict(r.text)[2] >= LEAST_MARGIN}
    docs, rows = step("language", docs)
    assert {r.doc_id for r in rows} == wanted and docs.columns == columns

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        last[(r.text or "").translate(lower)] = r.doc_id
    docs, rows = step("exact", docs)
    assert {r.doc_id for r in rows} == set(last.values()) and len(rows) == len(last) and docs.columns == columns

    rows.sort(key=lambda r: r.doc_id)
    wanted = {rows[group[0]].doc_id for group in brute([r.text for r in rows])}
    docs, rows = step("near", docs)
    assert {r.doc_id for r in rows} == wanted and len(rows) == len(wanted) and docs.columns == columns

    # Texts differ by now, so each document is a row of its own.
    copies = {r.id: r.base + r.ups for r in mix(docs).collect()}
    docs, rows = step("mixing", docs)
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in copies.items() if n} and docs.columns == columns

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = sorted((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in rows)
    _, rows = step("tokens", docs)
    assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == [w[:2] for w in wanted]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {
        (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode())) for i, ids, text in wanted
    }

    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == [w[0] for w in wanted]


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
