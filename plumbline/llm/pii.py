"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in a text: at-signs, ``://``, digits, plus signs
and words that announce an identifier.  Each kind has a local parser that goes left and
right from an anchor as far as its characters reach, and validates what it found.  Nothing
away from an anchor is looked at, and a text is read once whatever the number of kinds.

Base kinds, each the leftmost non-overlapping matches of a pattern, those that fail their
test dropped without another try:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, each part at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 13 to 19 digits that pass the Luhn test
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

Added kinds:

* url: ``http``, ``https`` or ``ftp``, then ``://`` and what is no white space, quote or angle
  bracket, less closing punctuation
* account: after one of CUES and one to four of ``:="'`` and white space a run of at least 6
  letters, digits and ``-_`` with a digit in it
* key: after one of KEYS, which begins no longer run, as many of its characters as it takes
* iban: two capitals, two digits and 11 to 30 capitals and digits, in one run or in fours parted
  by spaces, not within a longer run, with the checksum modulo 97
* ssn: digits in threes, twos and fours parted by hyphens, not within a longer chain, that may
  have been given out

Cues count in upper and lower case alike.  Spans count code points, ends exclusive; those of one
kind don't overlap.  Null texts count as empty and have no spans.  Rows that repeat give rows that
repeat; other columns than id and text aren't read; an empty table gives an empty result.  A text
may be as long as a string can be: it is read a few times, whatever is in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, released

Span = tuple[int, int]
BASE, ADDED = ("email", "ip", "card", "phone"), ("url", "account", "key", "iban", "ssn")
# Words that announce an identifier.
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "iban", "account", "ssn", "passport")
SCHEMES = ("http", "https", "ftp")
# How the keys of public services begin, and how many letters, digits and -_ follow at least (fixed values).
KEYS = {"AKIA": 16, "ASIA": 16, "AIza": 35, "ghp_": 36, "gho_": 36, "ghs_": 36, "github_pat_": 22, "glpat-": 20, "sk-": 20, "sk_live_": 16, "xoxb-": 20, "xoxp-": 20, "npm_": 36, "eyJ": 30}
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LABEL = LETTERS | DIGITS | {"-"}
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOCAL = LABEL | frozenset("._%+")
DIALLED = DIGITS | frozenset(" ().-")
ACCOUNT = LABEL | {"_"}
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", ["@"]), (":", ["://"]), ("0", sorted(DIGITS)), ("+", ["+"])):
        for word in words:
            found.add_word(word, (kind, len(word)))
    for word in (*CUES, *map(str.lower, KEYS)):
        found.add_word(word, ("key" if word not in CUES else "cue", len(word)))
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset) -> int:
    """The first place from at on whose character isn't allowed."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def emails(text: str, anchors: list[int]) -> list[Span]:
    found, last = [], 0
    for at in anchors:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        end = _run(text, at + 1, LABEL)
        if start == at or end == at + 1:
            continue
        host = end
        while text[end : end + 1] == "." and (more := _run(text, end + 1, LABEL)) > end + 1:
            end = more
        if end > host:
            found.append((start, end))
            last = end
    return found


def digit_runs(anchors: list[int]) -> list[Span]:
    """Anchors are the places of digits, in order; the spans of digits that follow one another."""
    runs: list[Span] = []
    start = before = None
    for at in anchors:
        if before is None or at != before + 1:
            if start is not None:
                runs.append((start, before + 1))
            start = at
        before = at
    if start is not None:
        runs.append((start, before + 1))
    return runs


def chains(text: str, runs: list[Span], joints: str) -> Iterator[list[Span]]:
    """Runs that one of the joints, a single character, links to the next."""
    chain: list[Span] = []
    for run in runs:
        if chain and run[0] == chain[-1][1] + 1 and text[run[0] - 1] in joints:
            chain.append(run)
        else:
            if chain:
                yield chain
            chain = [run]
    if chain:
        yield chain


def ips(text: str, runs: list[Span]) -> list[Span]:
    found = []
    for chain in chains(text, runs, "."):
        for i in range(0, len(chain) - 3, 4):
            parts = (text[a:b].lstrip("0") for a, b in chain[i : i + 4])
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                found.append((chain[i][0], chain[i + 3][1]))
    return found


def luhn(digits: str) -> bool:
    values = [int(x) for x in reversed(digits)]
    return (sum(values[::2]) + sum(2 * x - 9 * (x > 4) for x in values[1::2])) % 10 == 0


def cards(text: str, runs: list[Span]) -> list[Span]:
    found = []
    for chain in chains(text, runs, " -"):
        n = sum(b - a for a, b in chain)
        if 13 <= n <= 19 and luhn("".join(text[a:b] for a, b in chain)):
            found.append((chain[0][0], chain[-1][1]))
    return found


def phones(text: str, anchors: list[int]) -> list[Span]:
    found = []
    for at in anchors:
        if text[at + 1 : at + 2] not in DIGITS:
            continue
        end = _run(text, at + 2, DIALLED)
        while end > at + 3 and text[end - 1] not in DIGITS:
            end -= 1
        if end > at + 3 and 9 <= sum(x in DIGITS for x in text[at:end]) <= 15:
            found.append((at, end))
    return found


def urls(text: str, anchors: list[int]) -> list[Span]:
    found, last = [], 0
    for at in anchors:
        start = at
        while start > last and text[start - 1] in LETTERS:
            start -= 1
        scheme = text[start:at].lower()
        known = next((x for x in sorted(SCHEMES, key=len, reverse=True) if scheme.endswith(x)), None)
        if not known or at < last:
            continue
        end = at + 3
        while end < len(text) and not text[end].isspace() and text[end] not in "\"'<>":
            end += 1
        while end > at + 3 and text[end - 1] in ".,;:!?)]}":
            end -= 1
        if end > at + 3:
            found.append((at - len(known), end))
            last = end
    return found


def accounts(text: str, cues: list[int]) -> list[Span]:
    """Cues are the places after the words that announce an identifier."""
    found, last = [], 0
    for at in cues:
        start = at
        while start < min(at + 4, len(text)) and (text[start] in ":=\"'" or text[start].isspace()):
            start += 1
        if start == at or start < last:
            continue
        end = _run(text, start, ACCOUNT)
        if end - start >= 6 and not DIGITS.isdisjoint(text[start:end]):
            found.append((start, end))
            last = end
    return found


def keys(text: str, starts: list[int]) -> list[Span]:
    """Starts are the places of what may be a key's beginning, in any case."""
    found, last = [], 0
    for at in sorted(starts):
        if at < last or at and text[at - 1] in ACCOUNT:
            continue
        for begin in sorted(KEYS, key=len, reverse=True):
            if text.startswith(begin, at):
                end = _run(text, at + len(begin), ACCOUNT)
                if end - at - len(begin) >= KEYS[begin]:
                    found.append((at, end))
                    last = end
                break
    return found


def iban(text: str) -> bool:
    """The checksum: letters count from 10 to 35, and the number leaves 1 modulo 97."""
    moved = text[4:] + text[:4]
    return int("".join(str(int(x, 36)) for x in moved)) % 97 == 1


def ibans(text: str, runs: list[Span]) -> list[Span]:
    found, last, known = [], 0, CAPITALS | DIGITS
    for at, _ in runs:
        start = at - 2
        if start < last or text[at - 1] not in CAPITALS or text[start] not in CAPITALS or start and text[start - 1] in LABEL:
            continue
        end = _run(text, at, known)
        if end - start == 4:
            # Fours, and a last part of one to four.
            while end - start < 50 and text[end : end + 1] == " " and (more := _run(text, end + 1, known) - end - 1):
                end += 1 + min(more, 4)
                if more != 4:
                    break
        packed = text[start:end].replace(" ", "")
        whole = text[end : end + 1] not in LABEL or end == len(text)
        if whole and text[at + 1 : at + 2] in DIGITS and 15 <= len(packed) <= 34 and iban(packed):
            found.append((start, end))
            last = end
    return found


def ssns(text: str, runs: list[Span]) -> list[Span]:
    found = []
    for chain in chains(text, runs, "-"):
        a, b = chain[0][0], chain[-1][1]
        parts = [text[x:y] for x, y in chain]
        given = [len(x) for x in parts] == [3, 2, 4] and parts[0] not in ("000", "666") and parts[0][0] != "9" and parts[1] != "00" and parts[2] != "0000"
        if given and not (a and text[a - 1] in ACCOUNT) and (b == len(text) or text[b] not in ACCOUNT):
            found.append((a, b))
    return found


def lowered(text: str) -> str:
    """text with A-Z in lower case, place by place; other letters may change, too, but into none that a cue has."""
    small = text.lower()
    # These two change the length, or into an ASCII letter.
    return small if len(small) == len(text) and "\u212a" not in text else text.translate(_LOWER)


def spans(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[Span]]:
    at: dict[str, list[int]] = {"@": [], ":": [], "0": [], "+": [], "cue": [], "key": []}
    for end, (kind, n) in anchors.iter(lowered(text)):
        at[kind].append(end + 1 if kind == "cue" else end + 1 - n)
    runs = digit_runs(at["0"])
    return {
        "email": emails(text, at["@"]),
        "ip": ips(text, runs),
        "card": cards(text, runs),
        "phone": phones(text, at["+"]),
        "url": urls(text, at[":"]),
        "account": accounts(text, at["cue"]),
        "key": keys(text, at["key"]),
        "iban": ibans(text, runs),
        "ssn": ssns(text, runs),
    }


def joined(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, the number of spans of each base kind, the digest of these, and all spans."""

    @released
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for batch in batches:
            found = [spans(text or "", anchors) for text in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"]}
                | {f"n_{kind}": [len(x[kind]) for x in found] for kind in BASE}
                | {
                    "base_sha256": [hashlib.sha256(joined(x, BASE).encode()).hexdigest() for x in found],
                    "spans": [joined(x, BASE + ADDED) for x in found],
                }
            )

    read = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text"))
    return read.mapInPandas(find, SCHEMA)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in the text replaced by its kind in brackets; overlaps are merged."""

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        anchors = automaton()
        return texts.map(lambda text: _hidden(text, spans(text, anchors)) if text else text)

    return docs.withColumn(text_col, hide(col(text_col)))


def _hidden(text: str, found: dict[str, list[Span]]) -> str:
    out, last = [], 0
    for start, end, kind in sorted((a, b, kind) for kind, those in found.items() for a, b in those):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])
