import hashlib

from pyspark.sql import functions as F

from plumbline.llm.chat import digests, escaped, format_trees, from_turns, paths, read_back, unescaped

TURNS = "conv_id long, turn long, role string, text string, leaf string"
TREE = "tree long, node long, parent long, role string, text string, score double"
ODD = ["", "\\", "###", "####", "#", "##", "a\\", "\\### Assistant: </turn> ok", "</turn>", "<\\/turn>", "<</turn>>", "</turn", "### user: x</turn>\n", "\\\\###\\", "é\n\n###é"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").withColumn("e", escaped(F.col("t"))).withColumn("u", unescaped(F.col("e")))
    for r in df.collect():
        assert r.u == r.t and "###" not in r.e and "</turn>" not in r.e


def test_conversations_are_read_back(spark):
    rows = [(c, t, ["user", "assistant", "system", "a: b", None][(c + t) % 5], ODD[(c * 7 + t * 3) % len(ODD)], "x") for c in range(8) for t in range(c + 1)]
    rows += [(None, 0, "assistant", None, "x"), (None, 1, "assistant", "y", "x"), (50, None, "user", "first", "x"), (50, 1, "assistant", "same", "x"), (50, 1, "assistant", "same", "x")]
    rows += [(60, i, "assistant" if i % 2 else "user", f"t{i} ###", "x") for i in range(300)]
    out = {r.conv_id: r for r in digests(format_trees(from_turns(spark.createDataFrame(rows, TURNS)))).collect()}
    wanted = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(c, []).append((role or "", text or ""))
    assert set(out) == set(wanted)
    for c, turns in wanted.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), sha(loss))


def tree(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", 1.0),
        (1, 4, 3, "user", "more", 5.0), (1, 5, 2, "user", "less", 1.0), (1, 6, 4, "assistant", "end", None),
        (2, 1, 99, "user", "parent is gone", 1.0), (3, 1, 2, "user", "circle", 1.0), (3, 2, 1, "user", "circle", 1.0), (3, 3, 2, "user", "below", 1.0),
        (4, 1, None, "user", "twice", 1.0), (4, 1, None, "user", "twice", 1.0), (5, 1, 1, "user", "itself", 1.0),
    ]
    return spark.createDataFrame(rows, TREE)


def test_branches(spark):
    found = {}
    for r in paths(tree(spark), None).collect():
        found.setdefault((r.tree, r.leaf, r.score), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {(1, 6, 6.0): [1, 3, 4, 6], (1, 5, 3.0): [1, 2, 5], (2, 1, 1.0): [1], (4, 1, 1.0): [1]}
    out = {r.tree: r for r in read_back(format_trees(tree(spark))).collect()}
    assert set(out) == {1, 2, 4}
    assert out[1].formatted == "### user: root</turn>\n### assistant: bad</turn>\n### user: more</turn>\n### assistant: end</turn>\n"
    assert [out[1].formatted[s.start : s.end] for s in out[1].mask] == ["bad", "end"] and out[1].loss == "badend"
    assert format_trees(tree(spark), branches=2).filter("tree = 1").count() == 2


def test_empty(spark):
    assert digests(format_trees(from_turns(spark.createDataFrame([], TURNS)))).count() == 0


def test_very_long_roles_and_texts(spark):
    long = "role: \\ # </turn> " * 60_000
    rows = [(1, 0, long, "a", "x"), (1, 1, "assistant", long + "é", "x")]
    (r,) = digests(format_trees(from_turns(spark.createDataFrame(rows, TURNS)))).collect()
    assert r.n_turns == 2 and r.turns_sha256 == sha(f"{long}\na\nassistant\n{long}é\n")
    assert (r.loss_chars, r.loss_sha256) == (len(long) + 1, sha(long + "é"))
