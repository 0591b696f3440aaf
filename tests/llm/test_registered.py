"""The registered queries over the smallest tables: against SQL where there is some, else against brute force."""

import base64
import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm.registry import ORACLE_SQL, QUERIES
from test_line_dedup import tokens
from test_near_dedup import brute as near_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_in_sql(spark, name):
    session = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        session.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    asked = session.execute(ORACLE_SQL[name])
    names = [c[0] for c in asked.description]
    got = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(repr, asked.fetchall()))


def test_op3(spark, documents):
    lines = [(r.doc_id, n, line) for r in sorted(documents, key=lambda r: r.doc_id) for n, line in enumerate((r.text or "").split("\n"))]
    first, holders = {}, defaultdict(list)
    for i, n, line in lines:
        if (s := tokens(line)) and s not in first:
            first[s] = (i, n)
            for x in s:
                holders[x].append(s)
    links = {s: {t for x in s for t in holders[x] if t is not s and len(s & t) * 5 >= len(s | t) * 4} for s in first}
    wanted = {}
    for i, n, line in lines:
        s = tokens(line)
        wanted[i, n] = (len(links[s]), min(first[t] for t in (s, *links[s])) < (i, n)) if s else (0, False)
    got = QUERIES["op3_line_dedup"](spark, SF).collect()
    assert len(got) == len(lines) and {(r.doc_id, r.line_no): (r.n_links, r.removed) for r in got} == wanted
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(tokens(next(x for x in [(next(d.text for d in documents if d.doc_id == r.doc_id) or "").split("\n")[r.line_no]])))
    assert all(len(sets) == 1 for sets in classes.values()) and len(classes) == len(first) + any(not tokens(line) for _, _, line in lines)


def test_op7(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = set()
    for r in documents:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        wanted.add((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_bpe"](spark, SF).collect()} == wanted


def test_op9(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op9_warc"](spark, SF).collect()
    assert sorted((r.page_id, r.kind) for r in got) == sorted((i, k) for i in pages for k in ("metadata", "conversion"))
    for r in got:
        page = pages[r.page_id]
        assert r.target_uri == page.url and r.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(page.html.encode()).digest()).decode()


def test_op10(spark, documents):
    rows = sorted(documents, key=lambda r: r.doc_id)
    wanted = {rows[i].doc_id: (rows[g[0]].doc_id, len(g), i == g[0]) for g in near_groups([r.text for r in rows]) for i in g}
    assert {r.doc_id: (r.class_id, r.class_size, r.kept) for r in QUERIES["op10_near_dedup"](spark, SF).collect()} == wanted
