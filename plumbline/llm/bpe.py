"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text marks chunk ends, so a passage that several
documents share falls into the same chunks wherever it stands.  A chunk's body reaches from
its first to its last sure place: one where the tokenizer's words part whatever stands
around, such as the white space after a word.  Bodies are encoded once for each task, in a
cache of bounded size; it goes with the task, as idle workers would hold it beside others.  What lies between the last sure place of a
chunk and the first of the next, the join, is encoded anew; where a chunk has no sure place
the join widens over it until it meets one or the text's end.  At a sure place what was
encoded on either side agrees exactly with the whole text's encoding, so body and join ids in
order are the ids of the whole text.

The tokenizer is a byte-level BPE in the JSON format of the ``tokenizers`` library, whose
path is a parameter; it is read once, on the driver.  Words are merged by rank with
``tiktoken``, which gives the same ids.  Added tokens inside texts are encoded as such;
truncation and padding don't apply.  Ids are packed as little-endian unsigned 32-bit
integers.  Null texts count as empty and have no ids; texts may be of any length.  Rows that
repeat give rows that repeat; an empty table gives an empty result.  Columns of docs named
``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, fresh, released, without

#: A chunk's mean length in bytes, and the bytes that the rolling hash sees.
CHUNK, WINDOW = 1024, 16
#: Bytes of pieces that a worker keeps encoded, and of text that it handles at once.
CACHE, SLICE = 24 << 20, 1 << 20
# The word pattern of byte-level BPE (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_json(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        before, model = spec["pre_tokenizer"], spec["model"]
        plain = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if spec["normalizer"] or not plain or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without a normalizer is read")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or any(c.isspace() for t in self.added for c in t):
            raise ValueError("added tokens must be plain and hold no white space")
        byte = _byte_of()
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.added}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        table = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.added.items()}
        self.lengths = np.zeros(max(table) + 1, np.int64)
        for i, b in table.items():
            self.lengths[i] = len(b)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(self.lengths))), np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.held = 0

    def piece(self, piece: bytes) -> bytes:
        """The packed ids of a piece, from the cache if they are there."""
        if (ids := self.cache.get(piece)) is None:
            ids = self.core.encode_to_numpy(piece.decode(), allowed_special="all").astype("<u4").tobytes()
            if self.held > CACHE:
                self.forget()
            self.cache[piece] = ids
            self.held += len(piece) + len(ids) + 150
        return ids

    def forget(self) -> None:
        self.cache.clear()
        self.held = 0

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of each text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, n = at + 1, len(texts[at])
            while end < len(texts) and n + len(texts[end]) < SLICE:
                n += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        whole = b"\n".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        cuts = chunk_ends(np.frombuffer(whole, np.uint8))
        of = np.searchsorted(ends, cuts, "right")
        cuts = cuts[(of < len(texts)) & (cuts - starts[np.minimum(of, len(texts) - 1)] >= WINDOW)]
        of = np.searchsorted(ends, cuts, "right")
        safe = safe_places(np.frombuffer(whole, np.uint8))
        after = np.searchsorted(safe, cuts, "right")
        padded = np.concatenate([[-1], safe, [len(whole)]])
        left = np.maximum(padded[after], starts[of])
        right = np.minimum(padded[after + 1], ends[of])
        marks = np.unique(np.concatenate([starts, ends, left, right]))
        first, last = np.searchsorted(marks, starts), np.searchsorted(marks, ends)
        marks = marks.tolist()
        return [
            b"".join([self.piece(whole[marks[i] : marks[i + 1]]) for i in range(a, b)])
            for a, b in zip(first.tolist(), last.tolist())
        ]

    def decode(self, packed: list[bytes]) -> list[str]:
        """The text of each list of packed ids; what isn't UTF-8 becomes U+FFFD."""
        out: list[str] = []
        at = 0
        while at < len(packed):
            end, n = at + 1, len(packed[at])
            while end < len(packed) and n + len(packed[end]) < SLICE:
                n += len(packed[end])
                end += 1
            ids = np.frombuffer(b"".join(packed[at:end]), "<u4").astype(np.int64)
            lengths = self.lengths[ids]
            reach = np.cumsum(lengths)
            raw = self.flat[np.repeat(self.starts[ids] - (reach - lengths), lengths) + np.arange(lengths.sum())].tobytes()
            tokens = np.cumsum([len(p) // 4 for p in packed[at:end]])
            bounds = np.concatenate([[0], reach])[tokens].tolist()
            out += [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *bounds], bounds)]
            at = end
        return out


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Places whose last WINDOW bytes hash to 0 modulo CHUNK."""
    spread = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolled, width = (spread ^ (spread >> np.uint64(29))).astype(np.uint32)[data], 1
    while width < WINDOW:
        more = rolled.copy()
        more[width:] += rolled[:-width] * np.uint32(pow(0x01000193, width, 1 << 32))
        rolled, width = more, width * 2
    return np.flatnonzero((rolled >> np.uint32(12)) % np.uint32(CHUNK) == 0) + 1


# Last bytes of white space that takes several bytes in UTF-8 (fixed values).
_WIDE = np.array([0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F], np.uint8)
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that end a word for sure: visible ASCII, and bytes from 0x80 on that end no white space.
_SOLID = (np.arange(256) > 32) & (np.arange(256) != 127) & ~np.isin(np.arange(256), _WIDE)


def safe_places(data: np.ndarray) -> np.ndarray:
    """Places of ASCII white space behind a character that is none: a word ends there, whatever follows."""
    return np.flatnonzero(_WHITE[data[1:]] & _SOLID[data[:-1]]) + 1


@lru_cache(2)
def loaded(source: str) -> Bpe:
    return Bpe(source)


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with ids (packed) and decoded (the text of these ids); columns so named are replaced."""
    source = tokenizer_json(path)

    @released
    def made_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(source)
        for texts in batches:
            packed = bpe.encode([(t or "").encode() for t in texts])
            yield pd.DataFrame({"ids": packed, "decoded": bpe.decode(packed)})
        bpe.forget()

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return made_of(batches)

    docs = without(docs, [c for c in ("ids", "decoded") if c != text_col])
    (made,) = fresh(docs, "made")
    return docs.withColumn(made, both(col(text_col))).select(*[col(c) for c in docs.columns], f"{made}.ids", f"{made}.decoded")


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with decoded, the text of the packed ids; null ids count as none."""
    source = tokenizer_json(path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series(loaded(source).decode([bytes(x or b"") for x in ids]))

    return encoded.withColumn("decoded", text(col(ids_col)))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what encode returns, and more of its columns."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
        *more,
    )
