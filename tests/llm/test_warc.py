import base64
import gzip
import hashlib
import html.parser
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.warc import build, page_text, read_warc, records_of, unzipped, write_warc

SCHEMA = "page_id long, url string, html string, kind string"


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("a &amp; b", "a & b"),
        ("<html><head><title>t</title></head><body><p>one<p>two <b>bold</b></body>", "one\ntwo bold"),
        ("x<script>var t='</p>';if(a<b){}</script>y", "x\ny"),
        ("<!-- a > b -->x<br>y<br/>z", "x\ny\nz"),
        ("<p title='a>b'>q</p>", "q"),
        ("<head>no end<body>b", "b"),
        ("a < b", "a < b"),
        ("<script>never ends", ""),
        ("<p", ""),
    ],
)
def test_text(page, text):
    assert page_text(page) == text


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="<>/!-p&;'\" abscript=", max_size=60))
def test_any_string_has_a_text(page):
    assert "\n\n" not in page_text(page)


class Brute(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def test_pages_of_the_tables(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = build(pages)
    rows = made.collect()
    assert len(rows) == 2 * pages.count()
    source = {str(r.page_id): r for r in pages.collect()}
    by_id = {r.record_id: r for r in rows}
    assert len(by_id) == len(rows)
    for r in rows:
        _, status, head, block = next(records_of((r.record + "\r\n\r\n").encode()))
        assert status == "whole"
        assert block.decode() == r.block and head["warc-type"] == r.kind and head["warc-refers-to"] == r.refers_to
        assert head["warc-block-digest"] == sha1(r.block) and head["warc-source-digest"] == sha1(source[r.source_id].html)
        assert by_id[r.concurrent_to].refers_to == r.refers_to and by_id[r.concurrent_to].kind != r.kind
        if r.kind == "conversion":
            brute = Brute()
            brute.feed(source[r.source_id].html)
            assert "".join(r.block.split()) == "".join("".join(brute.words).split())
        else:
            assert f"conversion: {r.concurrent_to}" in r.block
    write_warc(made, str(tmp_path / "out"))
    read = read_warc(spark, str(tmp_path / "out/part-*"))
    assert {(r.headers["warc-record-id"], r.block) for r in read.collect()} == {(r.record_id, r.block) for r in rows}
    assert read.count() == len(rows) and read.filter("status != 'whole'").count() == 0


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "http://a\r\nX: y", "<p>" + "w " * 100_000, "x")]
    out = build(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6
    assert sorted(r.content_length for r in out if r.kind == "conversion") == [0, 0, 199_999]
    assert all("\r\nX: y" not in r.record for r in out)
    assert build(spark.createDataFrame([], SCHEMA)).count() == 0


def told(data):
    return [(status, block) for _, status, _, block in records_of(data)]


def test_broken_files(spark, tmp_path):
    assert told(b"") == [] and told(b"WARC/1.0\r\nno end") == [("cut header", b"")] and told(b"\r\n\r\n") == []
    odd = b"junk WARC/1.0\r\nContent-Length: x\r\n\r\nWARC/1.1\r\nContent-Length: 2\r\n\r\nabcd"
    assert told(odd) == [("no record", b"junk "), ("bad length", b""), ("whole", b"ab"), ("no record", b"cd")]
    whole = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nWARC/1.1\n\r\n\r\n"
    assert told(whole * 2) == [("whole", b"WARC/1.1\n")] * 2 and told(whole[:-6]) == [("cut", b"WARC/1.")]
    zipped = gzip.compress(whole) * 3
    assert unzipped(zipped) == whole * 3 and unzipped(zipped, 7) == whole * 3
    (tmp_path / "a.warc.gz").write_bytes(zipped[:-12])
    (tmp_path / "b.warc").write_bytes(odd)
    (tmp_path / "c.warc.gz").write_bytes(b"\x1f\x8bnot gzip")
    rows = read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.status for r in rows) == ["bad length", "no record", "no record", "whole", "whole", "whole"] or sorted(r.status for r in rows) == ["bad length", "cut", "no record", "no record", "whole", "whole", "whole"]


@pytest.mark.parametrize("page", ['<a ' * 10**6 + '"', '<a b="' * 10**5, "<head>" * 10**5, "<!--" * 10**5, "<script>" * 10**5, "<" * 10**6, "&" * 10**6, "<p x='" * 10**5, "<title>" * 10**5])
def test_pages_are_read_in_one_pass(page):
    began = time.time()
    page_text(page)
    assert time.time() - began < 10


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "http://a", "<p>one"), (None, "http://a", "<p>two"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace(", kind string", "")).selectExpr("*", "'x' as record_id", "'x' as source_id", "'x' as body", "'x' as uri")
    ids = [r.record_id for r in build(df).filter("kind = 'conversion'").collect()]
    assert len(ids) == 4 and len(set(ids)) == 3


def test_headers_are_kept(spark):
    df = spark.createDataFrame([("<urn:uuid:1>", "http://a", "<p>x", "2024-01-02T03:04:05Z", "Server: s\r\nContent-Type: text/html")], "i string, u string, b string, d string, h string")
    out = {r.kind: r for r in build(df, "i", "u", "b", "d", "h").collect()}
    assert "source-server: s\r\nsource-content-type: text/html\r\n" in out["metadata"].block
    assert out["conversion"].refers_to == "<urn:uuid:1>" and "WARC-Date: 2024-01-02T03:04:05Z" in out["conversion"].record
