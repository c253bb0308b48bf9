"""Byte-level BPE encoding and decoding.

Two-tier lookup. Tier one: a minimal perfect hash (hash-and-displace: one slot per vocabulary entry, no empty
slots) resolves a whole pre-token that is itself a vocabulary entry. Tier two, for the rest: pair merging with a
priority queue over a doubly linked list of byte pieces, O(n log n) in the length of the pre-token. Resolved
pre-tokens are remembered per task in a dictionary of bounded size.

Defined cases: a null text encodes like the empty text (no ids, empty bytes); a null or repeated doc_id is carried
through row by row; an empty table gives an empty result; other columns are not read. Texts of any length are
encoded whole; one enormous pre-token costs O(n log n). The vocabulary (a ranks file, at most
``MAX_VOCABULARY_BYTES``) is the only thing shipped to every task.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import sys
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import pick

MAX_VOCABULARY_BYTES = 16 << 20
MEMO_ENTRIES = 700_000
_K = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken-style file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class PerfectHash:
    """A minimal perfect hash over byte strings: n keys, n slots, and one displacement for each bucket of about four keys."""

    def __init__(self, ranks: dict[bytes, int], seed: int = 0):
        keys = list(ranks)
        self.n, self.nb, self.seed = len(keys), max(1, len(keys) // 4), seed
        h = np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, self.n)
        bucket = (h % np.uint64(self.nb)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.nb)
        ends = np.cumsum(sizes)
        free = np.ones(self.n, bool)
        slot_of = np.zeros(self.n, np.int64)
        disp = [0] * self.nb
        step = 256
        for b in np.argsort(-sizes, kind="stable").tolist():
            members = order[ends[b] - sizes[b] : ends[b]]
            if len(members) < 2:
                break
            hs = h[members]
            for first in range(1, 1 << 30, step):
                d = np.arange(first, first + step, dtype=np.uint64)[:, None]
                slots = self._slots(hs[None, :], d)
                fits = free[slots].all(1)
                if len(members) > 1:
                    s = np.sort(slots, 1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(1)
                if fits.any():
                    i = int(fits.argmax())
                    disp[b], slot_of[members] = first + i, slots[i]
                    free[slots[i]] = False
                    break
        rest = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(sizes == 1).tolist():  # a lone key takes any free slot, named by a negative displacement
            slot = next(rest)
            disp[b] = -slot - 1
            slot_of[order[ends[b] - 1]] = slot
        self.disp = disp
        self.keys: list[bytes] = [b""] * self.n
        self.ids = [0] * self.n
        for k, s in zip(keys, slot_of.tolist()):
            self.keys[s], self.ids[s] = k, ranks[k]

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ (d * np.uint64(_K))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(20)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int | None:
        """The id of ``key``, or None."""
        if not self.n:
            return None
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.disp[h % self.nb]
        slot = -d - 1 if d < 0 else ((((h ^ (d * _K & _M)) * 0xBF58476D1CE4E5B9) & _M) >> 20) % self.n
        return self.ids[slot] if self.keys[slot] == key else None


def merge_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """For each pair of entries that join to an entry, ``left << 32 | right`` to that entry's id."""
    pairs, get = {}, ranks.get
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            if (left := get(token[:cut])) is not None and (right := get(token[cut:])) is not None:
                pairs[left << 32 | right] = rank
    return pairs


def merge(piece: bytes, byte_ids: list[int], pairs: dict[int, int]) -> tuple[int, ...]:
    """Pairs merged in the order of their ranks, leftmost first: a heap over linked bytes.

    ``after`` and ``before`` link the pieces that are left, each known by where it begins. ``joint[i]`` is what piece i
    and the next would become; a heap entry, rank and place in one integer, is stale if ``joint`` has changed there.
    """
    n, get = len(piece), pairs.get
    ids = [byte_ids[b] for b in piece]
    joint = [get(a << 32 | b) for a, b in zip(ids, ids[1:])]
    bits = n.bit_length()
    heap = [r << bits | i for i, r in enumerate(joint) if r is not None]
    if not heap:
        return tuple(ids)
    heapify(heap)
    low = (1 << bits) - 1
    joint.append(None)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        x = heappop(heap)
        i, r = x & low, x >> bits
        if joint[i] != r:
            continue
        gone = after[i]
        ids[i], after[i], joint[gone], joint[i] = r, (end := after[gone]), None, None
        if end < n:
            before[end] = i
            if (q := get(r << 32 | ids[end])) is not None:
                joint[i] = q
                heappush(heap, q << bits | i)
        if (j := before[i]) >= 0:
            joint[j] = q = get(ids[j] << 32 | r)
            if q is not None:
                heappush(heap, q << bits | j)
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return tuple(out)


def _ranges(property_: str) -> str:
    """The members of a property below U+10000, as the inside of a character class."""
    match, out, first = regex.compile(property_).match, [], None
    for c in range(0x10001):
        inside = c < 0x10000 and match(chr(c)) is not None
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\u{first:04x}-\\u{c - 1:04x}")
            first = None
    return "".join(out)


def plain_pattern(pattern: str) -> str:
    """The pattern with L, N and white space spelled out, for the faster matcher of texts without astral characters."""
    inside = {r"\p{L}": _ranges(r"\p{L}"), r"\p{N}": _ranges(r"\p{N}"), r"\s": _ranges(r"\s")}
    inside[r"\S"] = "^" + inside[r"\s"]
    out, depth, i = [], False, 0
    while i < len(pattern):
        token = next((t for t in inside if pattern.startswith(t, i)), pattern[i])
        if token in "[]":
            depth = token == "["
        elif token == r"\S" and depth:
            raise ValueError("\\S within a class isn't handled")
        out.append(token if token not in inside else inside[token] if depth else f"[{inside[token]}]")
        i += len(token)
    return "".join(out)


class Encoder(dict):
    """Pre-token to ids; itself the memo of bounded size."""

    def __init__(self, table: PerfectHash, pattern: str, plain: str):
        super().__init__()
        self.find, self.find_plain, self.whole = regex.compile(pattern).findall, re.compile(plain).findall, table.get
        self.vocabulary = dict(zip(table.ids, table.keys))
        ranks = dict(zip(table.keys, table.ids))
        self.bytes, self.pairs = [ranks.get(bytes([b])) for b in range(256)], merge_table(ranks)
        self.decimal = {i: str(i) for i in table.ids}

    def __missing__(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8", "surrogatepass")
        whole = self.whole(raw)
        ids = self[token] = merge(raw, self.bytes, self.pairs) if whole is None else (whole,)
        return ids

    def encode(self, text: str | None) -> list[int]:
        if len(self) > MEMO_ENTRIES:
            self.clear()
        if not text:
            return []
        astral = len(text.encode("utf-16-le", "surrogatepass")) != 2 * len(text)
        find = self.find if astral else self.find_plain
        return list(chain.from_iterable(map(self.__getitem__, find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def _worker_encoder(table: PerfectHash, pattern: str, plain: str) -> Encoder:
    """One encoder for each Python worker process, so that later tasks find what earlier ones resolved."""
    kept = sys.__dict__.setdefault("_codeloom_encoders", {})
    key = (table.n, hashlib.sha256(b"\0".join(table.keys)).digest(), pattern)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(table, pattern, plain)
    return kept[key]


def _map(docs: DataFrame, ranks_path: str, pattern: str, fields: str, columns, carry: dict[str, str] | None = None) -> DataFrame:
    """A vocabulary of the bound above is the only thing sent to every task. ``carry``: further columns to keep, as alias: name."""
    rows = pick(docs, text="text", doc_id="doc_id", **(carry or {}))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]] + [fields])
    names = rows.columns[1:] + [f.split()[0] for f in fields.split(", ")]
    table, plain = PerfectHash(read_ranks(ranks_path)), plain_pattern(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(table, pattern, plain)
        gc.disable()  # the memo has no cycles, and is long to walk
        try:
            for batch in batches:
                if batch.num_rows:
                    texts = batch.column(0)
                    yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns(encoder, (t.as_py() for t in texts))], names=names)
        finally:
            gc.enable()

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, carry: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, carried columns, ``n_tokens, ids array<int>``: the ids of each text, special tokens being ordinary text."""

    def columns(encoder, texts):
        ids = [encoder.encode(t) for t in texts]
        return [pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))]

    return _map(docs, ranks_path, pattern, "n_tokens long, ids array<int>", columns, carry)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, bytes binary``: what the ids of :func:`encode` stand for. A null list gives empty bytes."""
    vocabulary = {i: k for k, i in read_ranks(ranks_path).items()}

    def run(batches):
        for batch in batches:
            out = [b"".join(map(vocabulary.__getitem__, x.as_py() or ())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return pick(encoded, doc_id="doc_id", ids="ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` in one pass: encodes, then decodes the ids. The ids never leave the worker."""

    def columns(encoder, texts):
        n, a, b = [], [], []
        for text in texts:
            ids = encoder.encode(text)
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(encoder.decimal.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _map(docs, ranks_path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)
