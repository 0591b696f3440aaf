"""Near-duplicate detection with BagMinHash.

A text's words (lower case, parted by ASCII white space) make shingles of five words; a
text of fewer words is one shingle.  Shingles count as often as they occur.  Two texts are
linked when their multisets of shingles overlap in at least 0.8 (weighted Jaccard); classes
are what links join, directly or over others.

* Signatures.  Each shingle has a Poisson process over the registers for every weight level.
  Levels are discretised to whole occurrences and grouped into spans [0,1), [1,2), [2,4),
  [4,8)...; a span is one process whose points are given a level each, so a heavy shingle
  costs the logarithm of its weight.  Points come in order of time, and a shingle stops when
  its next point is later than every register, as in BagMinHash; registers agree with the
  probability of the weighted Jaccard similarity.
* Texts with equal multisets become one node.  Bands of registers put nodes into buckets.
* Verification.  In each bucket every node is compared with one hub.  Then what is not yet
  joined is compared: in buckets that still hold several classes, the nodes outside the
  largest class with every node of another class; in buckets of more than SMALL nodes block
  by block, with a product of incidence matrices, from which only a spanning forest of the
  classes comes out: fewer edges than classes.  Nodes of the largest class never meet one
  another.  So a bucket of n copies that the hub joins costs n comparisons, no link between
  classes of a bucket is left out, and all comparisons are of whole multisets.

With 20 bands of 4 registers a link of similarity 0.8 shares no bucket with probability
3e-5, one of 0.9 with 2e-10.

Null texts count as empty; texts without a word are copies of one another.  A class's id is
the least id in it (nulls aside).  Rows that repeat are members like others.  Texts may be of
any length; columns other than id and text aren't read, whatever they are called.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Bitmap, col, components, fresh, released, swept

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
#: Buckets of more nodes are settled in blocks of so many nodes and shingles.
SMALL, BLOCK, BLOCK_MASS = 16, 512, 1 << 19
#: Bytes of text, and texts, that a worker handles at once.
SLICE, TEXTS = 1 << 20, 4095
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number, and those of its inverse, modulo 2 ** 64."""
    if len(_powers.get("p", ())) < n:
        for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["p"][:n], _powers["q"][:n]


def bags(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of all texts: text, 52-bit hash and count of each, ordered by text and hash."""
    parts = [t.lower().encode() for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    visible = np.concatenate([[False], (data != 0x20) & ((data < 9) | (data > 13))])
    edges = np.flatnonzero(visible[1:] != visible[:-1])
    starts, stops = edges[::2], edges[1::2]
    power, inverse = _power(len(data))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(data.astype(_U) * power, dtype=_U)])
    word = mixed((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(_U))
    of = np.searchsorted(ends, starts, "right")
    n = np.bincount(of, minlength=len(texts))
    factors = [_U(pow(_P, 2 * j + 3, 1 << 64)) for j in range(words)]
    found_of, found = [], []
    if len(word) >= words:
        within = of[: len(of) - words + 1] == of[words - 1 :]
        total = sum(word[j : len(word) - words + 1 + j] * f for j, f in enumerate(factors))
        found_of.append(of[: len(total)][within])
        found.append(mixed(total[within]))
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        first = np.cumsum(n) - n
        total = n[short].astype(_U)
        for j in range(words - 1):
            has = n[short] > j
            total = total + np.where(has, word[np.minimum(first[short] + j, len(word) - 1)] * factors[j], _U(0))
        found_of.append(short)
        found.append(mixed(total))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    keys = np.sort((np.concatenate(found_of).astype(_U) << _U(52)) | (np.concatenate(found) >> _U(12)))
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    return (keys >> _U(52)).astype(np.int64), keys & _U((1 << 52) - 1), counts


def signatures(of: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """Arrival times, a row for each text and a column for each register; infinite for texts without shingles."""
    least = np.full(texts * registers, np.inf)
    owner, element, span, weight = [of], [shingle], [np.zeros(len(of), np.int64)], [count]
    level = 1
    while len(more := np.flatnonzero(count > 1 << (level - 1))):
        owner.append(of[more])
        element.append(shingle[more])
        span.append(np.full(len(more), level))
        weight.append(count[more])
        level += 1
    owner, element, span, weight = map(np.concatenate, (owner, element, span, weight))
    width = np.where(span == 0, 1, 1 << np.maximum(span - 1, 0))
    base = np.where(span == 0, 0, width)
    seed = mixed(element + span.astype(_U) * _U(0xD1342543DE82EF95))
    time, number = np.zeros(len(owner)), 0
    while len(owner):
        number += 1
        draw = mixed(seed + _U(number * 0xA0761D6478BD642F & (1 << 64) - 1))
        time = time - np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53) / (registers * width)
        other = mixed(draw ^ _U(0xE7037ED1A0B428DB))
        register = (other & _U(0xFFFFFFFF)) % _U(registers)
        counts = base + ((other >> _U(32)) % width.astype(_U)).astype(np.int64) < weight
        place = owner * registers + register.astype(np.int64)
        np.minimum.at(least, place[counts], time[counts])
        latest = least.reshape(texts, registers).max(axis=1)
        on = time < latest[owner]
        owner, seed, width, base, weight, time = owner[on], seed[on], width[on], base[on], weight[on], time[on]
    return least.reshape(texts, registers)


def bands(times: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """A hash for each text and band."""
    bits = np.ascontiguousarray(times).view(_U).reshape(len(times), n_bands, rows)
    out = np.broadcast_to(np.arange(1, n_bands + 1, dtype=_U) * _U(0x8EBC6AF09C88C6E3), bits.shape[:2])
    for j in range(rows):
        out = mixed(out * _U(_P) + bits[:, :, j])
    return out.view(np.int64)


def expanded(shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A set as large as the multiset: a number for each occurrence, ordered."""
    again = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(np.where(nth == 0, shingle[again], mixed(shingle[again] + nth.astype(_U) * _U(_P)) | _U(1 << 63)))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two expanded multisets."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 1.0


def sliced(texts: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and end - at < TEXTS and n + len(texts[end]) < SLICE:
            n += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def _signed(texts: list[str], n_bands: int, rows: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
    """For each text a key of its multiset, the multiset's size and the bands."""
    for part in sliced(texts):
        of, shingle, count = bags(part)
        edges = np.searchsorted(of, np.arange(len(part) + 1)).tolist()
        sizes = np.bincount(of, weights=count, minlength=len(part)).astype(np.int64).tolist()
        own = bands(signatures(of, shingle, count, len(part), n_bands * rows), n_bands, rows)
        counts = count.astype(np.uint32)
        for i, n in enumerate(sizes):
            a, b = edges[i], edges[i + 1]
            key = hashlib.blake2b(shingle[a:b].tobytes(), digest_size=16)
            key.update(counts[a:b].tobytes())
            yield key.digest(), n, own[i] if n else own[i][:0]


def text_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def _sign(docs: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """id, th (a hash of the text), key, n and bands of each row of (id, text)."""

    @released
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = list(_signed([t or "" for t in batch["text"]], n_bands, rows))
            key, n, own = zip(*made) if made else ((), (), ())
            yield pd.DataFrame({"id": batch["id"], "th": batch["th"], "key": key, "n": n, "bands": own})

    read = docs.select("id", text_hash(F.col("text")).alias("th"), "text")
    return read.mapInPandas(sign, "id long, th binary, key binary, n long, bands array<long>")


def _bags(keys: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, bag) of the nodes with these keys, the bag expanded and packed; reads their texts again."""
    wanted = swept(keys.distinct().join(nodes, "key").select("key", "th"))
    texts = Bitmap(wanted, ["th"]).mark(docs.select(text_hash(F.col("text")).alias("th"), "text"), "maybe").filter("maybe")
    one = texts.groupBy("th").agg(F.first("text").alias("text")).join(wanted, "th").select("key", "text")

    @released
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = []
            for part in sliced([t or "" for t in batch["text"]]):
                of, shingle, count = bags(part)
                edges = np.searchsorted(of, np.arange(len(part) + 1))
                sets += [expanded(shingle[a:b], count[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
            yield pd.DataFrame({"key": batch["key"], "bag": sets})

    return swept(one.mapInPandas(expand, "key binary, bag binary"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose multisets overlap enough."""
    bag = _bags(pairs.select(F.explode(F.array("a", "b")).alias("key")), nodes, docs)

    @released
    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = zip(batch["bag_a"], batch["bag_b"])
            yield batch.loc[[overlap(np.frombuffer(x, _U), np.frombuffer(y, _U)) >= threshold for x, y in both], ["a", "b"]]

    left, right = (bag.select(F.col("key").alias(x), F.col("bag").alias(f"bag_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.mapInPandas(alike, "a binary, b binary")


def _fits(x: str, y: str, threshold: float) -> Column:
    """Whether sizes x and y let two multisets overlap enough."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(threshold - 1e-9)


def _in_small(apart: DataFrame, first: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links between classes of buckets of at most SMALL nodes, pair by pair."""
    x = apart.filter("component != largest").select("band", *[F.col(c).alias(f"x_{c}") for c in ("key", "n", "component")])
    pairs = x.join(apart, "band").filter(
        (F.col("x_component") != F.col("component"))
        & _fits("x_n", "n", threshold)
        & ((F.col("component") == F.col("largest")) | (F.col("x_key") < F.col("key")))
    )
    pairs = pairs.select(F.least("x_key", "key").alias("a"), F.greatest("x_key", "key").alias("b")).distinct()
    # A hub is the least of its bucket, so these are ordered alike.
    return _verified(swept(pairs.join(first, ["a", "b"], "left_anti")), nodes, docs, threshold)


def _joined(links: DataFrame, joined: DataFrame | None = None) -> DataFrame:
    """(node, component) of nodes that links join, on top of the classes that are known."""
    if joined is None:
        return components(links)
    for end in "ab":
        at = joined.select(F.col("node").alias(end), F.col("component").alias("to"))
        links = links.join(at, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    wider = components(links)
    step = wider.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = joined.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # Nodes that were alone until now; the others are classes that are in old under their least node.
    new = wider.join(joined.select("node"), "node", "left_anti")
    return swept(old.unionByName(new))


def _in_large(apart: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links between classes of larger buckets: in each group of blocks a forest over the classes, not all pairs.

    A bucket's nodes are dealt to blocks of bounded size, those outside its largest class and
    those of it apart.  A block of the former meets every other block, and itself; blocks of the
    latter don't meet one another.  All overlaps of a group come from a product of incidence
    matrices.
    """
    outside = F.col("component") != F.col("largest")
    apart = apart.withColumn("outside", outside)
    sizes = apart.groupBy("band", "outside").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("mass") / BLOCK_MASS)).cast("int")
    sizes = sizes.groupBy("band").agg(
        F.max(F.when(F.col("outside"), blocks)).alias("outer"), F.coalesce(F.max(F.when(~F.col("outside"), blocks)), F.lit(0)).alias("inner")
    )
    dealt = apart.join(sizes.select(F.xxhash64("band").alias("at"), "outer", "inner"), F.xxhash64("band") == F.col("at"))
    # Blocks of outside nodes are 0, 1, ..., those of the largest class -1, -2, ...
    hashed = F.xxhash64("key", "band")
    own = F.when(F.col("outside"), F.pmod(hashed, "outer")).otherwise(-1 - F.pmod(hashed, F.greatest("inner", F.lit(1)))).cast("int")
    others = F.when(F.col("outside"), F.sequence(-F.col("inner"), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") - 1))
    met = dealt.withColumn("own", own).withColumn("other", F.explode(others))
    met = met.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "component")
    bag = _bags(apart.select("key"), nodes, docs)

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("component", kind="stable", ignore_index=True)
        alike = overlaps([np.frombuffer(x, _U) for x in rows["bag"]]) >= threshold - 1e-12
        if (own := rows["own"].to_numpy()).min() != own.max():
            alike &= own[:, None] != own[None, :]
        # Nodes to classes, which lie side by side.
        first = np.flatnonzero(rows["component"].ne(rows["component"].shift()))
        between = np.logical_or.reduceat(np.logical_or.reduceat(alike, first, axis=0), first, axis=1)
        classes = rows["component"].iloc[first].tolist()
        made = [(classes[a], classes[b]) for a, b in forest(between)]
        return pd.DataFrame([(min(x), max(x)) for x in made], columns=["a", "b"])

    return met.join(bag, "key").groupBy("band", "i", "j").applyInPandas(link, "a binary, b binary").distinct()


def overlaps(sets: list[np.ndarray], columns: int = 1024) -> np.ndarray:
    """Weighted Jaccard similarity of every two expanded multisets."""
    sizes = np.array([len(s) for s in sets], float)
    row = np.repeat(np.arange(len(sets)), sizes.astype(int))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # What only one multiset has is in no overlap.
    place = np.cumsum(times > 1) - 1
    row, column = row[times[column] > 1], place[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[row[a:b], column[a:b] - at] = 1
        common += block @ block.T
    both = sizes[:, None] + sizes[None, :] - common
    alike = np.divide(common, both, out=np.ones_like(both), where=both > 0)
    np.fill_diagonal(alike, 1)
    return alike


def forest(alike: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a graph given by its adjacency matrix."""
    new = np.ones(len(alike), bool)
    for root in range(len(alike)):
        if not new[root]:
            continue
        new[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            for other in np.flatnonzero(alike[at] & new).tolist():
                new[other] = False
                queue.append(other)
                yield at, other


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    n_bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, th (a hash of the text), class_id, class_size and class_key of each row."""
    docs = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    signed = swept(_sign(docs, n_bands, rows))
    nodes = swept(
        signed.groupBy("key").agg(
            F.min("th").alias("th"), F.first("n").alias("n"), F.first("bands").alias("bands"),
            F.min("id").alias("first"), F.count(F.lit(1)).alias("members"),
        )
    )
    buckets = nodes.select(F.explode("bands").alias("band"), F.struct("key", "n").alias("node"))
    hubs = buckets.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size"))
    # The key is hashed anew, so that both sides are dealt anew and a large bucket can be split.
    hubs = hubs.filter("size > 1").select(F.xxhash64("band").alias("at"), "hub")
    shared = buckets.join(hubs, F.xxhash64("band") == F.col("at"))
    shared = swept(shared.select("band", "node.key", "node.n", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n")))
    first = shared.filter((F.col("key") != F.col("hub")) & _fits("n", "hub_n", threshold))
    first = swept(first.select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct())
    links = swept(_verified(first, nodes, docs, threshold))
    joined = _joined(links)

    # What shares a bucket and isn't joined yet; pairs with the hub are settled.
    rest = shared.filter(F.col("key") != F.col("hub"))
    placed = rest.join(joined, F.col("key") == F.col("node"), "left")
    placed = swept(placed.select("band", "key", "n", F.coalesce("component", "key").alias("component")))
    counted = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n"))
    most = F.max(F.struct("count", "component"))["component"]
    several = counted.groupBy("band").agg(
        F.count(F.lit(1)).alias("classes"), most.alias("largest"), F.sum("count").alias("size"), F.sum("n").alias("mass")
    )
    several = several.filter("classes > 1").select(F.xxhash64("band").alias("at"), "largest", "size", "mass")
    apart = swept(placed.join(several, F.xxhash64("band") == F.col("at")).drop("at"))
    few, many = apart.filter(F.col("size") <= SMALL), apart.filter(F.col("size") > SMALL)
    # No name is kept for what is swept: it would keep its shuffles, too.
    joined = _joined(swept(_in_small(few, first, nodes, docs, threshold).unionByName(_in_large(many, nodes, docs, threshold))), joined)

    own = nodes.select("key", "first", "members")
    summed = own.join(joined, F.col("key") == F.col("node")).groupBy("component")
    summed = summed.agg(F.min("first").alias("class_id"), F.sum("members").alias("class_size"))
    classes = joined.join(summed, "component")
    each = own.join(classes, F.col("key") == F.col("node"), "left")
    alone = F.col("node").isNull()
    each = each.select(
        F.base64("key").alias("at"),
        F.coalesce("component", "key").alias("class_key"),
        F.when(alone, F.col("first")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("members")).otherwise(F.col("class_size")).alias("class_size"),
    )
    out = signed.select("id", "th", "key").join(each, F.base64("key") == F.col("at"))
    return out.select(F.col("id").alias("doc_id"), "th", "class_id", "class_size", "class_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one of each class, that of the least id; rows without copies aren't shuffled."""
    th, maybe, row, class_of, at = fresh(docs, "th", "maybe", "row", "class", "at")
    found = near_classes(docs, id_col, text_col, **options).filter("class_size > 1")
    several = swept(found.groupBy(F.col("th").alias(th)).agg(F.first("class_key").alias(class_of)))
    marked = Bitmap(several, [th]).mark(docs.withColumn(th, text_hash(col(text_col))), maybe)
    mine = [col(c) for c in docs.columns]
    packed = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(mine)])
    order = F.struct(col(id_col).isNull(), col(id_col), F.col(th))
    known = several.select(F.base64(th).alias(at), class_of)
    joined = marked.filter(maybe).join(known, F.base64(th) == F.col(at), "left")
    kept = joined.filter(F.col(at).isNotNull()).groupBy(class_of).agg(F.min_by(packed, order).alias(row))
    kept = kept.select(*[F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    alone = marked.filter(~F.col(maybe)).select(*mine)
    return alone.unionByName(joined.filter(F.col(at).isNull()).select(*mine)).unionByName(kept)
