"""WARC derivatives: metadata and plain-text conversion records of responses.

For each response two records are made, both with ``WARC-Refers-To`` the response's id and
with its target URI and date: a *metadata* record (application/warc-fields) that carries the
source's digests, length, type and headers and the id of the conversion, and a *conversion*
record (text/plain) with the page's text.  Ids are name-based UUIDs of the response's id and
the kind, digests are ``sha1:`` and base32 over the record's block; the same response always
gives the same records, also after a lost executor.

Text: comments and the content of the elements in HIDDEN are dropped, those in BLOCKS end
lines, entities are resolved, white space is collapsed in lines, empty lines go.  Pages are
read by a tolerant tokenizer in one pass: any string gives a result, however long it is and
whatever isn't closed in it.

Null pages count as empty and give records with empty text; null URIs leave the URI header
out.  A null id is replaced by the URI and the page's digest, so different pages have
different records.  Rows that repeat give records that repeat.  Other columns than those
named aren't read.  An empty table gives an empty result.

``read_warc`` gives a row for whatever is in a file, with a status: ``whole``, ``cut`` (the
block ends early), ``cut header``, ``bad length`` or ``no record`` (bytes between records).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import col, released

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
END = "\r\n\r\n"
# Elements whose content is no text.
HIDDEN = ("script", "style", "noscript", "template", "head", "svg", "iframe", "textarea")
# Elements that begin and end lines.
BLOCKS = (
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul"
).split()
# Attribute values in quotes may hold what closes a tag.  Possessive: no character is read twice.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)""", re.S
)
_HEAD_END = re.compile(r"</head\s*>|(?=<body[\s>])", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
SCHEMA = (
    "source_id string, kind string, record_id string, refers_to string, concurrent_to string, "
    "target_uri string, block_digest string, source_digest string, content_length long, block string, record string"
)


def page_text(html: str) -> str:
    """The visible text of a page."""
    out, at, endless_head = [], 0, False
    while tag := _TAG.search(html, at):
        out.append(unescape(html[at : tag.start()]))
        at = tag.end()
        name = (tag[2] or "").lower()
        if name in HIDDEN and not tag[1] and not tag[3].endswith("/"):
            if name == "head":
                # A head that isn't closed ends where the body begins; one look tells for all that follow.
                end = None if endless_head else _HEAD_END.search(html, at)
                endless_head, at = end is None, end.end() if end else at
            else:
                end = _CLOSE[name].search(html, at)
                at = end.end() if end else len(html)
            out.append("\n")
        elif name in BLOCKS:
            out.append("\n")
    out.append(unescape(html[at:]))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def field(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


def record(headers: list[tuple[str, str]], block: str) -> str:
    """A record less the two line ends that close it."""
    lines = [VERSION, *(f"{name}: {field(value)}" for name, value in headers), f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(lines) + END + block


def derivatives(source_id: str | None, uri: str | None, date: str | None, headers: str | None, body: str) -> list[dict]:
    """The metadata and the conversion record of a response; headers are its HTTP header lines."""
    source, text = body.encode(), page_text(body)
    if source_id is None:
        response = record_id("no id", uri or "", digest(source), "response")
    else:
        response = source_id if source_id.startswith("<urn:") else record_id(source_id, "response")
    ids = {kind: record_id(response, kind) for kind in ("metadata", "conversion")}
    facts = [("source-digest", digest(source)), ("source-length", str(len(source))), ("conversion", ids["conversion"]), ("conversion-digest", digest(text.encode()))]
    facts += [(f"source-{name.strip().lower()}", field(value)) for name, _, value in (x.partition(":") for x in (headers or "").splitlines()) if value]
    blocks = {"metadata": "".join(f"{name}: {value}\r\n" for name, value in facts), "conversion": text}
    made = []
    for kind, block in blocks.items():
        other = ids["metadata" if kind == "conversion" else "conversion"]
        head = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind])]
        head += [("WARC-Target-URI", uri)] if uri else []
        head += [("WARC-Date", date or DATE), ("WARC-Refers-To", response)]
        head += [("WARC-Refers-To-Target-URI", uri)] if uri else []
        head += [("WARC-Concurrent-To", other)] if kind == "metadata" else []
        head += [("WARC-Block-Digest", digest(block.encode())), ("WARC-Source-Digest", digest(source))]
        head += [("Content-Type", "application/warc-fields" if kind == "metadata" else "text/plain; charset=utf-8")]
        made.append(
            {
                "source_id": source_id, "kind": kind, "record_id": ids[kind], "refers_to": response,
                "concurrent_to": other, "target_uri": uri, "block_digest": digest(block.encode()),
                "source_digest": digest(source), "content_length": len(block.encode()), "block": block,
                "record": record(head, block),
            }
        )
    return made


def build(responses: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", date_col: str | None = None, headers_col: str | None = None) -> DataFrame:
    """Two rows for each response: its metadata and its conversion record."""
    extra = {"date": date_col, "headers": headers_col}
    read = responses.select(
        col(id_col).cast("string").alias("source_id"),
        col(uri_col).alias("uri"),
        F.coalesce(col(body_col), F.lit("")).alias("body"),
        *[(col(name) if name else F.lit(None)).cast("string").alias(k) for k, name in extra.items()],
    )
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @released
    def derive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["source_id"], batch["uri"], batch["date"], batch["headers"], batch["body"])
            yield pd.DataFrame([x for row in rows for x in derivatives(*row)], columns=names)

    return read.mapInPandas(derive, SCHEMA)


def write_warc(records: DataFrame, path: str) -> None:
    """Writes the records (column record) as WARC files, one for each partition."""
    records.select("record").write.option("lineSep", END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, place (of the record in the file, before compression), status, headers (map, names in lower case) and block.

    For uncompressed or gzipped WARC files, one file to a task.  Blocks are read as UTF-8.
    """

    @released
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                data = unzipped(content) if content[:2] == b"\x1f\x8b" else bytes(content)
                rows: list[tuple] = []
                held = 0
                for place, status, head, block in records_of(data):
                    rows.append((name, place, status, head, block.decode("utf-8", "replace")))
                    held += len(block)
                    if held > 1 << 24:
                        yield pd.DataFrame(rows, columns=_READ)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=_READ)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, place long, status string, headers map<string, string>, block string")


_READ = ["file", "place", "status", "headers", "block"]


def unzipped(content: bytes, step: int = 1 << 16) -> bytes:
    """What gzip members hold; a member that is cut or broken gives what can be read of it, and ends the rest."""
    out, at, reader = [], 0, zlib.decompressobj(31)
    while at < len(content):
        piece = content[at : at + step]
        try:
            out.append(reader.decompress(piece))
        except zlib.error:
            break
        at += len(piece) - len(reader.unused_data)
        if reader.eof:
            reader = zlib.decompressobj(31)
    return b"".join(out)


def records_of(data: bytes) -> Iterator[tuple[int, str, dict[str, str], bytes]]:
    """place, status, headers and block of all that is in the data."""
    at = 0
    while at < len(data):
        start = data.find(b"WARC/", at)
        between = data[at : start if start >= 0 else len(data)]
        if between.strip(b"\r\n"):
            yield at, "no record", {}, between
        if start < 0:
            return
        end = data.find(b"\r\n\r\n", start)
        lines = data[start : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")[1:]
        head = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        if end < 0:
            yield start, "cut header", head, b""
            return
        at, length = end + 4, head.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield start, "bad length", head, b""
            continue
        block = data[at : at + int(length)]
        yield start, "whole" if len(block) == int(length) else "cut", head, block
        at += len(block)
