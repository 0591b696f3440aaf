"""Chat formatting of reply trees.

Messages form trees: each has a parent, or none.  Iterative self-joins enumerate the paths
from roots to leaves: in round k every message learns its ancestor 2 ** k steps up by
joining the table with itself, so rounds grow with the logarithm of the depth.  Sums over
ancestors are doubled along, which scores every branch before any path is written out; the
best branches of each tree are chosen, and only their paths are enumerated, by the same
jump tables.  Each chosen path becomes one conversation.

Template: ``### role: text</turn>`` and a line end for each turn.  In texts and roles a
backslash is doubled, ``#`` before two more of it becomes ``#\\`` and ``</turn>`` becomes
``<\\/turn>``; in roles ``:`` becomes ``\\:``.  So neither ``###`` nor ``</turn>`` is found in
an escaped text, and dropping each backslash that has a character after it undoes it.  The loss
mask covers the escaped texts of assistants: spans of code points, ends exclusive.

Null texts and roles count as empty.  A message whose parent isn't there is a root.  Messages
in or below a circle of parents have no root and are left out.  Messages that repeat a key
(tree and id) count once, with the least of their contents.  Roles and texts may be as long as
a string can be.  Other columns than those named aren't read, whatever they are called.  An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import col, cut

END = "</turn>"


def escaped(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, "#(?=##)", r"#\\"), F.lit(END), F.lit(r"<\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def from_turns(rows: DataFrame, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of tables that list conversations by turn: each row replies to the one before.

    Null turns come first; rows of the same turn are ordered by role and text.
    """
    read = rows.select(
        col(tree).alias("tree"), col(order).alias("order"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.asc_nulls_first("order"), "role", "text")).cast("long")
    placed = read.withColumn("node", place)
    return placed.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, node, depth, score) of each message on the chosen branches; branches None: all.

    A branch's score is the sum of its messages' scores; ties go to the smaller leaf.
    """
    slim = messages.select(F.struct("tree").alias("tree"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    slim = cut(slim.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.min("score").alias("score")))
    keys = slim.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    known = (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n"))
    jump = cut(slim.join(keys, known, "left").select("tree", "node", F.col("n").alias("up"), "score", F.lit(1).cast("long").alias("steps")))
    jumps = []
    # A path without a circle has at most so many steps; what still goes up then is in or below a circle.
    limit = slim.count()
    while (1 << len(jumps)) <= 2 * limit and not jump.filter("up is not null").isEmpty():
        jumps.append(jump)
        # Only what still goes up joins; most messages are done after a few rounds.
        going = jump.filter("up is not null")
        above = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("steps").alias("further"))
        known = (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n"))
        higher = going.join(above, known).select(
            "tree", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("steps") + F.col("further")).alias("steps")
        )
        jump = cut(jump.filter("up is null").unionByName(higher))
    parents = (jumps[0] if jumps else jump).filter("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = jump.filter("up is null").join(parents, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "score", "steps")
    if branches is not None:
        best = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
        leaves = leaves.withColumn("rank", best).filter(F.col("rank") <= branches).drop("rank")
    found = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.col("steps").alias("depth"), "score")
    for k in reversed(range(len(jumps))):
        up = jumps[k].filter("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        higher = found.join(up, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
        higher = higher.select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"), "score")
        found = cut(found.unionByName(higher))
    return found.select("tree.tree", "leaf", "node", "depth", "score")


def format_trees(messages: DataFrame, branches: int | None = 1, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, leaf, score, formatted and mask (spans of the learned roles' texts) of each chosen branch."""
    chosen = paths(messages, branches).select(F.struct("tree").alias("t"), "leaf", F.col("node").alias("n"), "depth", F.col("score").alias("total"))
    content = messages.groupBy(F.struct("tree").alias("tree"), "node").agg(F.min(F.struct("role", "text")).alias("content"))
    turns = chosen.join(content, (F.col("t") == F.col("tree")) & (F.col("n") == F.col("node")))
    role = F.coalesce("content.role", F.lit(""))
    head = F.concat(F.lit("### "), F.replace(escaped(role), F.lit(":"), F.lit(r"\:")), F.lit(": "))
    turns = turns.select(
        "tree", "leaf", "total", "depth", head.alias("head"), escaped(F.col("content.text")).alias("body"), role.isin(*learned).alias("learned")
    )
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "leaf", "total").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("start", start.cast("long"))
    span = F.when(F.col("learned"), F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    listed = turns.groupBy("tree", "leaf", "total").agg(
        F.array_sort(F.collect_list(F.struct("depth", "turn", span.alias("span")))).alias("turns")
    )
    return listed.select(
        "tree.tree",
        "leaf",
        F.col("total").alias("score"),
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns (array of role and text) and loss (the text under the mask), from the output alone."""
    # Each block is a turn less its end; the end is found nowhere else.
    blocks = F.split("formatted", f"{END}\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    # Possessive: it never goes back, so a role may be as long as a text.
    head = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): "
    parsed = F.transform(
        F.col("blocks"),
        lambda b: F.struct(
            unescaped(F.regexp_extract(b, head, 1)).alias("role"), unescaped(F.regexp_replace(b, head, "")).alias("text")
        ),
    )
    split = formatted.withColumn("blocks", blocks)
    # Where each block starts, to read the mask's spans without going through the whole string for each.
    at = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    flat = split.select(F.struct("tree").alias("tree"), "leaf", F.posexplode("blocks").alias("place", "block"))
    flat = flat.withColumn("from", F.coalesce(F.sum(F.length("block") + len(END) + 1).over(at), F.lit(0)))
    spans = split.select(F.struct("tree").alias("t"), F.col("leaf").alias("l"), F.explode("mask").alias("span"))
    # A span's block is the one with its start; both are numbered along the string by the spans before.
    flat = flat.withColumn("head", F.length(F.regexp_extract("block", head, 0)))
    inside = flat.join(spans, (F.col("tree") == F.col("t")) & (F.col("leaf") == F.col("l")) & (F.col("from") + F.col("head") == F.col("span.start")))
    text = F.substring(F.col("block"), (F.col("span.start") - F.col("from") + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int"))
    loss = inside.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("place", unescaped(text).alias("text")))).alias("parts")
    )
    loss = loss.select(F.col("tree").alias("t"), F.col("leaf").alias("l"), F.array_join("parts.text", "").alias("loss"))
    whole = split.withColumn("turns", parsed).drop("blocks")
    joined = whole.join(loss, (F.struct("tree") == F.col("t")) & (F.col("leaf") == F.col("l")), "left")
    return joined.withColumn("loss", F.coalesce("loss", F.lit(""))).drop("t", "l")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
