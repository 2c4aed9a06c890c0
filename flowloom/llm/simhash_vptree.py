"""Operator 4: SimHash near-duplicates found with vantage-point trees.

Fingerprints are made where the texts are and only (id, fingerprint) moves on. Distinct
fingerprints are partitioned by Hamming distance to vantage points: two that differ in at most 3 of
64 bits differ in at most 1 bit of the upper or of the lower half, so two trees partition on the
distance of one half each with radius 1. At a node with vantage point v and median m a fingerprint
x lives on the side of d(v, x) <= m; by the triangle inequality its partners can only be on the
other side if d(v, x) is within the radius of m, and then x also visits that side. A shard holds
its own fingerprints and the visitors of its boundary; in it a deeper tree of the same kind prunes
the search, and every remaining pair is compared in full. A part that the half distance cannot
split is split by the distance of all 64 bits with radius 3.

A shard returns no pairs but a spanning forest of its links (at most a row for each fingerprint);
components over all shards come from alternating large-star and small-star steps.

Defined results: texts without words (null, empty, blank) have fingerprint zero and are linked like
any other; equal fingerprints share a component; a null id never names a component unless all its
ids are null; repeated rows are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_files, least_hashes, map_text, materialize

SHINGLE = 3
SEED = 42
BITS = 3
#: Distinct fingerprints that choose the vantage points of the shards; every fingerprint is indexed.
SAMPLE = 32_768
#: Fingerprints at home in a shard, about.
SHARD = 16_384
#: Fingerprints of a leaf inside a shard, compared without further pruning.
LEAF = 256

FULL = 0xFFFFFFFFFFFFFFFF
HALVES = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF)

_LANES = np.zeros(256, np.uint64)
for _v in range(256):
    _LANES[_v] = np.array([_v >> (7 - _k) & 1 for _k in range(8)], np.uint8).view("<u8")[0]


def fingerprint(text: str) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats counted."""
    from xxhash import xxh64_digest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        digests = [xxh64_digest(joined, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        start = end - size
        digests = [xxh64_digest(joined[a:b], SEED) for a, b in zip(start[: n - SHINGLE + 1].tolist(), end[SHINGLE - 1 :].tolist(), strict=True)]
    lanes = _LANES[np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)]
    m = len(digests)  # eight counters of a byte each in a lane, summed before they can overflow
    counts = np.add.reduceat(lanes, np.arange(0, m, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > m).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp long``: the fingerprint's bits as a signed integer."""

    def make():
        return lambda texts: {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    return map_text(docs, make, "fp long", id_col, text_col)


@dataclass
class Node:
    """Inside: d <= limit. Without a side it is a leaf, number ``leaf``."""

    leaf: int = -1
    rows: np.ndarray | None = None
    point: int = 0
    mask: int = 0
    radius: int = 0
    limit: int = 0
    inside: Node | None = None
    outside: Node | None = None


def distance(x: np.ndarray, point: int, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(point)) & np.uint64(mask)).astype(np.int16)


def build(x: np.ndarray, mask: int, most: int, tries: int = 6, seed: int = 1) -> Node:
    """A vantage-point tree over ``x`` whose leaves hold at most ``most``, or what no distance splits."""
    random = np.random.default_rng(seed)
    leaves = 0
    root = Node()
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        best = None
        if len(rows) > most:
            for m, radius in ((mask, 1), (FULL, BITS)):
                for at in random.integers(0, len(rows), tries):
                    point = int(x[rows[at]])
                    d = distance(x[rows], point, m)
                    counts = np.bincount(d, minlength=66)
                    upto = np.cumsum(counts)
                    middle = int(np.searchsorted(upto, len(rows) / 2))
                    for limit in (middle - 1, middle):
                        if limit >= 0 and 0 < (left := int(upto[limit])) < len(rows):
                            # rows each side is asked for, its visitors included
                            low, high = int(upto[min(limit + radius, 65)]), len(rows) - (int(upto[limit - radius]) if limit >= radius else 0)
                            cost = left * low + (len(rows) - left) * high
                            if best is None or cost < best[0]:
                                best = (cost, point, m, radius, limit, d <= limit)
                if best:
                    break
        if best is None:
            node.leaf, node.rows = leaves, rows
            leaves += 1
        else:
            _, node.point, node.mask, node.radius, node.limit, left = best
            node.inside, node.outside = Node(), Node()
            todo += [(node.inside, rows[left]), (node.outside, rows[~left])]
    return root


def visits(root: Node, x: np.ndarray):
    """For each leaf that has any: (leaf, indices of ``x`` that can have partners there, who is at home there)."""
    todo = [(root, np.arange(len(x)), np.ones(len(x), bool))]
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if node.inside is None:
            yield node, rows, home
            continue
        d = distance(x[rows], node.point, node.mask)
        a, b = d <= node.limit + node.radius, d > node.limit - node.radius
        todo += [(node.inside, rows[a], (home & (d <= node.limit))[a]), (node.outside, rows[b], (home & (d > node.limit))[b])]


def roots(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of ``n`` over the links (i, j) and those in ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up


def link(x: np.ndarray, home: np.ndarray, mask: int) -> np.ndarray:
    """For each of the sorted distinct ``x`` the smallest index it is linked to, through members at home."""
    own = np.flatnonzero(home)
    label = np.arange(len(x))
    tree = build(x[own], mask, LEAF, tries=2)
    for node, rows, _ in visits(tree, x):
        mine = own[node.rows]
        for k in range(0, len(mine), LEAF):  # what no distance splits is compared in blocks
            part = mine[k : k + LEAF]
            for s in range(0, len(rows), 4096):
                some = rows[s : s + 4096]
                p, q = np.nonzero(np.bitwise_count(x[part][:, None] ^ x[some][None, :]) <= BITS)
                p, q = part[p], some[q]
                new = label[p] != label[q]
                if new.any():
                    label = roots(len(x), p[new], q[new], label)
    return label


def shard_links(distinct: DataFrame, n: int) -> DataFrame:
    """``a, b``: a spanning forest of each shard's links between distinct fingerprints ``fp``."""
    sample = np.array([r.fp for r in least_hashes(distinct.select("fp"), "fp", SAMPLE).collect()], np.int64).view(np.uint64)
    most = max(1, int(len(sample) * SHARD / max(n, 1)))
    trees = [build(sample, m, most) for m in HALVES]

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            x = fp.view(np.uint64)
            for t, tree in enumerate(trees):
                for node, rows, home in visits(tree, x):
                    yield pa.RecordBatch.from_pydict({"shard": np.full(len(rows), node.leaf * 2 + t), "fp": fp[rows], "home": home})

    def join(group: pa.Table) -> pa.Table:
        t = group.column("shard")[0].as_py() % 2
        raw = group.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(raw)
        x, home = raw[order], group.column("home").to_numpy()[order]
        label = link(x, home, HALVES[t])
        moved = label != np.arange(len(x))
        return pa.table({"a": x[moved].view(np.int64), "b": x[label[moved]].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(join, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of the undirected ``edges (a, b)``.

    Minima are combined before they are shuffled, and a node with very many links is only one side
    of a plain equi-join, which adaptive execution splits; no group is gathered anywhere.
    """

    def both(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e):  # every node's neighbours point to the least of them and itself
        least = e.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        return e.join(least, "a")

    def state(e):
        return e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = state(now)
    while last.n:
        large = star(both(now)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        is_same = (s := state(new)) == last
        drop_files(now)
        now, last = new, s
        if is_same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` (16 lowercase hex digits) ``, component_id`` (the smallest id of its component)."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fps = materialize(fingerprints(ids, "id", "text"))
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("least")))
    joined = components(shard_links(distinct, distinct.count()))
    rooted = distinct.join(joined, distinct.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("of_fp"), "component_id")
    return fps.join(of, fps.fp == of.of_fp).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less near-duplicates: of each component the row with the
    smallest id stays (null ids last, the first of repeated rows)."""
    n = docs.groupBy(id_col).count().agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count(id_col).alias("known")).first()
    if n.n == n.rows == n.known:
        near = near_duplicates(docs, id_col, text_col)
        return docs.join(near.where(F.col(id_col) == F.col("component_id")).select(id_col), id_col, "left_semi").select(*docs.columns)
    numbered = materialize(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    key = F.struct(F.col(f"doc.{id_col}").isNull().alias("unknown"), F.col(f"doc.{id_col}").alias("id"), F.col("row").alias("row"))
    near = near_duplicates(numbered.select(key.alias("key"), F.col(f"doc.{text_col}").alias("text")), "key", "text")
    kept = near.where(F.col("key") == F.col("component_id")).select(F.col("key.row").alias("row"))
    return numbered.join(kept, "row", "left_semi").select("doc.*")
