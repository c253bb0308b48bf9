"""SimHash near-duplicates by a binary-trie self-join.

Fingerprint: A-Z lower-cased, words split at ASCII white space, 3-word shingles (repeats count; fewer words: the whole
sequence), each hashed by XXH64 with seed 42; a bit is 1 if it is set in over half of the hashes.

Join: the distinct fingerprints, each with its number of documents, are the leaves of a binary trie, traversed against itself:
a pair of nodes starts at the root with itself, its children are paired at the next bit, differing bits add up, and a pair
is dropped as soon as its errors exceed the budget. A pair within ``budget`` has at most half of it among the first 32 bits, or
less than half among the last 32, so the trie is walked in both orders of the halves, with that much for the leading one; the second
walk keeps only pairs that the first can't have. The upper part of the trie, down to nodes of at most ``LEAVES`` fingerprints, is walked on
the driver by node counts (of at most ``MOST`` nodes times partners); each pair of nodes left there is a shard, to which the fingerprints
of both go, and a task walks on from it. Nodes that are still too large are counted and split again, as deep as need be.
Links between different fingerprints are all found; copies of one fingerprint are never expanded into pairs.

Components: minimum labels are spread over the links by alternating large-star and small-star rounds, each written to
the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other; a null doc_id counts as a document
but never names a component unless all of it are null; repeated rows are documents of their own; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pick, shuffle_partitions

SHINGLE = 3
SEED = 42
BUDGET = 2
LEAVES = 1 << 14
MOST = 1 << 22
STEP = 4  # bits by which a node too large is split again
PIECE = 200_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = b" \t\n\x0b\x0c\r"


def shingle_hashes(text: str | None) -> list[int]:
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    grams = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= SHINGLE else [b" ".join(w)] if w else []
    return list(map(xxhash.xxh64_intdigest, grams, repeat(SEED)))


_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes. Eight byte-wide counters share each 64-bit lane, 255 hashes at a time."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    cuts = np.arange(0, n, 255)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, cuts)
        counts[shift::8] = lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, h, fp``: a hash of the text, which tells rows of one doc_id or of none apart, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py())
                out.append(majority(np.array(hashes, np.uint64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "h", "fp"])

    rows = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


class Trie:
    """Sorted runs of fingerprints as binary tries: a run of equal leading bits is a node.

    ``starts``: where each run begins. A node [lo, hi) with equal bits above ``bit`` is split at the one place where neighbours first differ at it.
    """

    def __init__(self, fp: np.ndarray, starts: np.ndarray):
        self.fp = fp
        apart = fp[1:] ^ fp[:-1]
        top = np.full(len(apart), -1, np.int16)
        for bit in range(64):
            top[(apart >> np.uint64(bit)) != 0] = bit
        top[starts[(starts > 0) & (starts < len(fp))] - 1] = -1
        order = np.argsort(top, kind="stable")
        cuts = np.searchsorted(top[order], np.arange(65))
        self.flips = [order[cuts[b] : cuts[b + 1]] + 1 for b in range(64)]

    def split(self, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """Where ``bit`` turns from 0 to 1 in each node."""
        flips = self.flips[bit]
        at = np.searchsorted(flips, lo, "right")
        found = np.append(flips, len(self.fp) + 1)[at]
        ones = (self.fp[lo] >> np.uint64(bit)) & np.uint64(1) == 1
        return np.where(found < hi, found, np.where(ones, lo, hi))


def walk(trie: Trie, roots: dict[int, np.ndarray], leading: int, budget: int, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions i, j of every pair below the roots that differs in 1 to ``budget`` bits, at most ``leading`` of them among the first 32.

    ``roots``: by the next bit, rows of node pairs (a0, a1, b0, b1, errors); a node with itself gives each pair once. ``seen`` counts node pairs.
    """
    fp = trie.fp
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    stack = [x for x in roots.items() if len(x[1])]
    while stack:
        bit, nodes = stack.pop()
        if len(nodes) > PIECE:
            stack += [(bit, nodes[i : i + PIECE]) for i in range(0, len(nodes), PIECE)]
            continue
        a0, a1, b0, b1, err = nodes.T
        small = ((a1 - a0) * (b1 - b0) <= 4) | (bit < 0)
        if small.any():  # the leaves themselves
            s = nodes[small]
            size = (s[:, 1] - s[:, 0]) * (s[:, 3] - s[:, 2])
            at = np.repeat(np.arange(len(s)), size)
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            width = (s[:, 3] - s[:, 2])[at]
            i, j = s[at, 0] + k // width, s[at, 2] + k % width
            ok = i < j
            i, j = i[ok], j[ok]
            apart = fp[i] ^ fp[j]
            ok = (apart > 0) & (np.bitwise_count(apart) <= budget) & (np.bitwise_count(apart >> np.uint64(32)) <= leading)
            left.append(i[ok])
            right.append(j[ok])
            a0, a1, b0, b1, err = nodes[~small].T
        if seen is not None:
            seen["compared"] += int(small.sum())
            seen["split"] += len(a0)
        if not len(a0):
            continue
        am, bm = trie.split(a0, a1, bit), trie.split(b0, b1, bit)
        other = a0 != b0
        nodes = np.concatenate([np.stack(x, 1) for x in (
            (a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am[other], a1[other], b0[other], bm[other], err[other] + 1)
        )])
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3])]
        within = nodes[:, 4] <= (leading if bit >= 32 else budget)
        if seen is not None:
            seen["pruned"] += int((~within).sum())
        nodes = nodes[within & ((nodes[:, 0] != nodes[:, 2]) | (nodes[:, 1] - nodes[:, 0] > 1))]  # but a leaf with itself
        if len(nodes):
            stack.append((bit - 1, nodes))
    return np.concatenate(left), np.concatenate(right)


def trie_pairs(fp: np.ndarray, budget: int = BUDGET, leading: int | None = None, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a sorted array of different fingerprints within ``budget`` bits, found from its one root."""
    root = np.array([[0, len(fp), 0, len(fp), 0]], np.int64)
    return walk(Trie(fp, np.zeros(1, np.int64)), {63: root if len(fp) > 1 else root[:0]}, budget if leading is None else leading, budget, seen)


def _prefix(fp, depth: int):
    return F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("long")


class Shards:
    """The pairs of trie nodes that the walk reaches at nodes of at most ``leaves`` fingerprints: ``start`` and ``depth`` of each node, ``left`` and ``right`` of each pair."""

    def __init__(self, distinct: DataFrame, n: int, leading: int, budget: int, leaves: int):
        spark = distinct.sparkSession
        deepest = max(d for d in range(31) if sum(comb(d, e) for e in range(leading + 1)) << d <= MOST)
        leaves = max(leaves, n >> deepest << 1)
        depth = max(0, (n - 1) // leaves).bit_length()
        start, count = self._count(distinct, 0, depth, None) if depth else (np.zeros(1, np.uint64), np.array([n]))
        i, j = trie_pairs(start, leading, leading)
        own = np.arange(len(start))
        pairs = np.stack([start[np.r_[own, i]], start[np.r_[own, j]]], 1)
        depths = np.full(len(pairs), depth)
        depths = np.stack([depths, depths], 1)
        done = [(start, np.full(len(start), depth), count)]
        while depth < 64 and (hot := done[-1][0][done[-1][2] > leaves]).size:
            deeper = min(64, depth + STEP)
            parents = spark.createDataFrame([(int(x >> np.uint64(64 - depth)) if depth else 0,) for x in hot.tolist()], "parent long")
            start, count = self._count(distinct, depth, deeper, parents)
            above = start & np.uint64(((1 << depth) - 1) << (64 - depth))
            for side in (0, 1):  # pairs with a node that was split get a pair for each of its children
                low, high = (np.searchsorted(above, pairs[:, side], s) for s in ("left", "right"))
                split = (depths[:, side] == depth) & np.isin(pairs[:, side], hot)
                times = np.where(split, high - low, 1)
                row = np.repeat(np.arange(len(pairs)), times)
                k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                pairs, depths = pairs[row], depths[row]
                split = split[row]
                pairs[split, side] = start[(low[row] + k)[split]]
                depths[split, side] = deeper
            errors, first = self._errors(pairs, depths)
            own = (depths[:, 0] == depths[:, 1]) & (pairs[:, 0] > pairs[:, 1])  # met the other way round
            keep = (errors <= budget) & (first <= leading) & ~own
            pairs, depths = pairs[keep], depths[keep]
            done.append((start, np.full(len(start), deeper), count))
            depth = deeper
        self.leading, self.budget = leading, budget
        split = [s[(c <= leaves) | (d == 64)] for s, d, c in done[:-1]] + [done[-1][0]]
        self.start = np.concatenate(split)
        self.start.sort()
        self.left, self.right = (np.searchsorted(self.start, pairs[:, side]) for side in (0, 1))
        self.bit = 63 - depths.min(1)
        self.errors = self._errors(pairs, depths)[0]

    @staticmethod
    def _errors(pairs: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differing bits that both nodes of a pair have, and those among the first 32."""
        known = depths.min(1)
        apart = np.where(known > 0, (pairs[:, 0] ^ pairs[:, 1]) >> (64 - np.maximum(known, 1)).astype(np.uint64), np.uint64(0))
        beyond = np.maximum(known - 32, 0).astype(np.uint64)
        return np.bitwise_count(apart).astype(int), np.bitwise_count(apart >> beyond).astype(int)

    @staticmethod
    def _count(distinct: DataFrame, depth: int, deeper: int, parents: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of fingerprints of the nodes at ``deeper``, below ``parents`` if given."""
        rows = distinct.select("fp") if parents is None else distinct.select("fp", _prefix(F.col("fp"), depth).alias("parent")).join(parents, "parent", "left_semi")
        found = rows.groupBy(_prefix(F.col("fp"), deeper).alias("p")).count().toArrow()
        p = found.column("p").to_numpy().view(np.uint64) << np.uint64(64 - deeper)
        order = np.argsort(p)
        return p[order], found.column("count").to_numpy()[order]

    def spread(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row ``shard, side, fp`` for every shard of a fingerprint's node; a node with itself is one side."""
        n = len(self.left)
        two = self.left != self.right
        node = np.r_[self.left, self.right[two]]
        shard, side = np.r_[np.arange(n), np.flatnonzero(two)], np.r_[np.zeros(n, np.int32), np.ones(two.sum(), np.int32)]
        order = np.argsort(node, kind="stable")
        shard, side = shard[order], side[order]
        begin = np.searchsorted(node[order], np.arange(len(self.start) + 1))
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            own = np.searchsorted(self.start, fp, "right") - 1
            times = begin[own + 1] - begin[own]
            at = np.repeat(begin[own], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array(side[at]), pa.array(np.repeat(fp, times).view(np.int64))], names=["shard", "side", "fp"])

    def pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        shard, side, fp = (table.column(c).to_numpy() for c in ("shard", "side", "fp"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, side, shard))
        shard, side, fp = shard[order], side[order], np.ascontiguousarray(fp[order])
        starts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (side[1:] != side[:-1])])
        ends = np.r_[starts[1:], len(fp)]
        of, which = shard[starts], side[starts]
        alone = (self.left == self.right)[of]
        first = np.flatnonzero((which == 0) & (alone | (np.append(of[1:], -1) == of)))  # both sides are there
        second = np.where(alone[first], first, first + 1)
        rows = np.stack([starts[first], ends[first], starts[second], ends[second], self.errors[of[first]]], 1).astype(np.int64)
        bits = self.bit[of[first]]
        i, j = walk(Trie(fp, starts), {int(b): rows[bits == b] for b in np.unique(bits)}, self.leading, self.budget)
        yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["a", "b"])


def _turned(fp):
    return F.shiftleft(fp, 32).bitwiseOR(F.shiftrightunsigned(fp, 32))


def links(distinct: DataFrame, budget: int = BUDGET, leaves: int = LEAVES) -> DataFrame:
    """``a, b`` with a < b as signed longs: every pair of distinct fingerprints that differ in at most ``budget`` bits."""
    n = distinct.count()
    half = budget // 2
    found = []
    for turn, leading in ((False, half), (True, budget - half - 1)):
        if leading < 0 or n < 2:
            continue
        fp = _turned(F.col("fp")) if turn else F.col("fp")
        rows = distinct.select(fp.alias("fp"))
        shards = Shards(rows, n, leading, budget, leaves)
        parts = min(len(shards.left), max(shuffle_partitions(distinct.sparkSession), n * len(shards.left) // len(shards.start) // leaves // 64))
        spread = rows.mapInArrow(shards.spread, "shard int, side int, fp long").repartitionById(parts, "shard")
        pairs = spread.mapInArrow(shards.pairs, "a long, b long")
        if turn:  # the first walk has the others
            last = F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit((1 << 32) - 1)))
            pairs = pairs.where(last > half).select(_turned(F.col("a")).alias("a"), _turned(F.col("b")).alias("b"))
        found.append(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    if not found:
        return distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    return found[0].union(found[1]) if len(found) > 1 else found[0]


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component, for every node that has an edge (a, b)."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large star: each node's larger neighbours join the smallest of its neighbourhood
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node and its smaller neighbours join the smallest of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "edges")
        same = new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty()
        discard(now)
        now = new
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, budget: int = BUDGET, leaves: int = LEAVES) -> DataFrame:
    """``doc_id, h, fp, n_near, root, component_id`` for every row: other documents linked directly, the component's smallest fingerprint, and the smallest doc_id reachable."""
    rows = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "distinct")
    pairs = materialize(links(distinct.select("fp"), budget, leaves), "links")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(distinct.select(F.col("fp").alias("b"), "n", "first"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    roots = components(pairs)
    named = distinct.join(roots, distinct.fp == roots.node, "left").join(linked, distinct.fp == linked.a, "left")
    named = named.select("fp", "n", "first", F.coalesce("root", "fp").alias("root"), F.coalesce("others", F.lit(0)).alias("others"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(named.join(least, "root").select("fp", (F.col("n") - 1 + F.col("others")).cast("long").alias("n_near"), "root", "component_id"), "classes")
    for table in (distinct, pairs, roots):
        discard(table)
    return rows.join(classes, "fp").select("doc_id", "h", "fp", "n_near", "root", "component_id")


def drop_copies(docs: DataFrame, budget: int = BUDGET, leaves: int = LEAVES) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each component: that of the smallest doc_id (null last), then text hash.

    Of repeated rows one stays. Rows without a doc_id are told apart by their texts.
    """
    found = near_duplicates(docs, budget, leaves)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("k"), "h")).alias("s")).select("s.*")
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))  # other columns may have clashing names
    own, text = (F.col(f"_c{names.index(c)}") for c in ("doc_id", "text"))
    keyed = plain.withColumn("none", own.isNull()).withColumn("k", F.coalesce(own, F.lit(0))).withColumn("h", F.xxhash64(text))
    kept = keyed.join(stay.hint("shuffle_hash"), ["none", "k", "h"], "left_semi").dropDuplicates(["none", "k", "h"])
    return kept.select(*plain.columns).toDF(*names)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns: the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
