import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.pii import CUES, KEYS, automaton, find_pii, joined, luhn, redact, spans
from plumbline.llm.registry import QUERIES

ANCHORS = automaton()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(text):
    return re.sub("[^0-9]", "", text)


TESTS = {
    "email": lambda s: True,
    "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
    "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)),
    "phone": lambda s: 9 <= len(digits(s)) <= 15,
}


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if TESTS[k](m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab@.-+ 0159()é_%:/", max_size=60) | st.text(alphabet="0159.- +", max_size=60))
def test_base_kinds_are_the_patterns(text):
    found = spans(text, ANCHORS)
    assert {k: found[k] for k in PATTERNS} == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4785380592391139", "+1 (555) 010-9999", "10.0.0.255", "a.b@c.de", " ", "\n", "x", "-", ".", "256.1.1.1", "é"]), max_size=12))
def test_base_kinds_of_real_shapes(parts):
    text = "".join(parts)
    found = spans(text, ANCHORS)
    assert {k: found[k] for k in PATTERNS} == brute(text)


def test_added_kinds():
    text = 'See https://a.example/x?y=1, and token = "24be64439e3e", password: hunter22.'
    found = spans(text, ANCHORS)
    assert [text[a:b] for a, b in found["url"]] == ["https://a.example/x?y=1"]
    assert [text[a:b] for a, b in found["account"]] == ["24be64439e3e", "hunter22"]


def apart(found):
    out, last = [], 0
    for a, b in found:
        if a >= last:
            out.append((a, b))
            last = b
    return out


def mod97(s):
    left = 0
    for c in s[4:] + s[:4]:
        left = int(str(left) + str(int(c, 36))) % 97
    return left == 1


def brute_added(text):
    """The added kinds by patterns."""
    out = {}
    cues = sorted({m.end(1) for c in CUES for m in re.finditer(f"(?=({re.escape(c)}))", text, re.I | re.A)})
    after = [m for m in (re.compile(r"[:=\"'\s]{1,4}([A-Za-z0-9_-]{6,})").match(text, end) for end in cues) if m and re.search("[0-9]", m[1])]
    out["account"] = apart([m.span(1) for m in after])
    shape = "|".join(f"{re.escape(k)}[A-Za-z0-9_-]{{{n},}}" for k, n in sorted(KEYS.items(), key=lambda x: -len(x[0])))
    out["key"] = apart([m.span() for m in re.finditer(rf"(?<![A-Za-z0-9_-])(?:{shape})", text)])
    shape = r"(?<![A-Za-z0-9-])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9-])"
    found = [m.span() for m in re.finditer(shape, text)]
    out["iban"] = [(a, b) for a, b in found if 15 <= len(text[a:b].replace(" ", "")) <= 34 and mod97(text[a:b].replace(" ", ""))]
    # A chain of digits and single hyphens as a whole.
    found = [m for m in re.finditer(r"[0-9]+(?:-[0-9]+)*", text) if re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", m[0])]
    out["ssn"] = [m.span() for m in found if not re.search(r"[A-Za-z0-9_-]\Z", text[: m.start()]) and not re.match(r"[A-Za-z0-9_-]", text[m.end() :])]
    return out


PARTS = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013001", "123-45-6789", "000-45-6789", "12-123-45-6789", "token", "Password", "IBAN", ": ", "=", '"', "abc123", "x-9_y77",
         "AKIA" + "A1" * 8, "ghp_" + "a" * 36, "sk-" + "0" * 19, "sk_live_" + "b2" * 9, " ", "  ", "\n", ".", "-", "_", "é", "X", "7", "4 "]


@settings(max_examples=3000, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9))
def test_added_kinds_are_the_patterns(parts):
    text = "".join(parts)
    found = spans(text, ANCHORS)
    assert {k: found[k] for k in ("account", "key", "iban", "ssn")} == brute_added(text)


def test_the_registered_query_against_the_patterns(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        base, added = brute(r.text or ""), brute_added(r.text or "")
        own = got.pop(r.doc_id)
        assert (own.n_email, own.n_ip, own.n_card, own.n_phone) == tuple(len(base[k]) for k in PATTERNS)
        assert own.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in base[k]).encode()).hexdigest()
        listed = [x.split(":") for x in own.spans.split(",") if x]
        assert {k: [(int(a), int(b)) for kind, a, b in listed if kind == k] for k in added} == added
    assert not got


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "mail a@b.co now", "x"), (3, "mail a@b.co now", "x"), (None, "é" * 200_000 + "1.2.3.4", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.spans) for r in find_pii(docs).collect()}
    assert got == {(1, ""), (2, ""), (3, "email:5:11"), (None, "ip:200000:200007")}
    assert find_pii(docs).count() == 5
    assert find_pii(docs.limit(0)).count() == 0
    assert redact(docs.filter("doc_id = 3")).first().text == "mail [email] now"


def test_very_long_texts():
    for part in ("token", "a1", "AB12 ", "1-", "sk-", "://", "@", "+1", "eyJ", "AKIA", "ghp_x ", "DE89 3704 "):
        began = time.time()
        spans(part * 200_000, ANCHORS)
        assert time.time() - began < 10, part


def test_joined_orders_kinds_then_places():
    found = spans("1.2.3.4 a@b.co c@d.co", ANCHORS)
    assert joined(found, ("email", "ip", "card", "phone")) == "email:8:14,email:15:21,ip:0:7"
