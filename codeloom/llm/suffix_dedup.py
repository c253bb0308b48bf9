"""Suffix-array dedup of passages: each byte that a ``WINDOW``-byte string covers goes, if that string also starts in a
document of smaller doc_id. Strings are judged on the input; matches never cross documents.

The suffix array is sparse: each window names one suffix, the one at its minimizer (the leftmost smallest hash of its
``GRAM``-byte strings, a choice that depends on the window's bytes alone). Equal windows thus name suffixes with equal
leading bytes, at equal places, and neighbouring windows mostly name the same suffix, about one for 15 bytes. A suffix has two
leading tokens: its lead (a 48-bit hash of its first ``GRAM`` bytes) and its run (a 64-bit hash of all bytes of the windows that name it).

1. Splitters are drawn from a sample of the suffixes in the order (lead, run, doc_id, text hash). Each task lists its suffixes, keeps one copy
   of each run (the smallest doc_id's; others are settled there) and range-partitions them by the splitters, as packed arrays.
2. A bucket sorts its suffixes by these tokens; of equal runs all but the smallest document's are settled. Of the rest, only suffixes whose lead has
   further, different runs in other documents can share single windows; they are sorted by their bytes:
3. a lead of up to ``HOT`` such suffixes within one bucket is range-partitioned as a whole, by its bytes; each partition sorts its windows by
   multikey quicksort over 8-byte symbols and settles equal ones by the smallest doc_id.
4. A lead that is hotter, or that a splitter cuts, goes on as single windows, range-partitioned by (bytes, doc_id, text hash, place), so that even one window
   can spread over many partitions. Each partition settles its windows but for those equal to its first; the first and last windows
   of all partitions are then compared across the boundaries, and the smallest doc_id found there settles the rest.
5. The settled runs meet the texts by bucket of document.

Buckets hold ``bucket_bytes`` of text each, however large the input or frequent a suffix; the sample decides their bounds, never a result. Runs (steps 1 and 2) are compared
by 112 hash bits, windows (steps 3 and 4) by their bytes. A group of copies costs one row for each task that has seen it, not one for each copy.

Defined cases: a null text is empty (no bytes, none removed); a null doc_id counts as larger than any other; rows of one
doc_id, told apart by a 64-bit hash of their texts, never remove from each other, and repeated rows get equal results; an empty table gives an empty result; other columns are
not read. Texts of any length are read whole, in overlapping segments.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pick, trim

WINDOW, GRAM = 50, 22
OFFSETS = WINDOW - GRAM + 1  # where in its window a minimizer can be
SEGMENT, BUFFER, FLUSH = 1 << 19, 1 << 17, 1_000_000
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 1 << 18  # their splitters go to all tasks: 8 MB; beyond 2 TB of text buckets grow
HOT = 1 << 16  # suffixes of one lead that are compared in one partition, some 10 MB
SAMPLE = 48  # suffixes for each splitter
LOW48 = np.uint64((1 << 48) - 1)
LAST = (1 << 63) - 1
FIRST = np.int64(-1 << 63)  # key and tag of a splitter at the beginning of its lead
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    m = 1
    while m < n:
        k = min(m, n - m)
        out[m : m + k] = out[:k] * np.uint64(pow(base, m, 1 << 64))
        m += k
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Minimizers:
    """The runs of windows of a buffer of texts, by the suffix that each window names."""

    def __init__(self):
        n = 2 * SEGMENT + WINDOW
        self.up, self.down = _powers(_BASE, n + 1), _powers(pow(_BASE, -1, 1 << 64), n + 1)
        symbol = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.symbol = _mix(symbol ^ (symbol >> np.uint64(31))) | np.uint64(1)

    def runs(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """For texts that end at ``ends``: lead hash, run hash, text, first window, end of last window, suffix."""
        a = np.frombuffer(data, np.uint8)
        n = len(a)
        none = np.empty(0, np.int64)
        if n < WINDOW:
            return none.view(np.uint64), none.view(np.uint64), none, none, none, none
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.symbol[a] * self.up[:n], out=sums[1:])
        lead = _mix((sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1])
        mask = np.uint64((1 << 22) - 1)
        least = (lead & ~mask) | np.arange(len(lead), dtype=np.uint64)  # ties fall to the leftmost
        width = 1
        while width * 2 <= OFFSETS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < OFFSETS:
            least = np.minimum(least[: width - OFFSETS], least[OFFSETS - width :])
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, np.maximum(np.r_[0, ends[:-1]], ends - (WINDOW - 1)), 1)
        np.add.at(inside, ends, -1)
        window = np.flatnonzero(np.cumsum(inside[: len(least)]) == 0)
        if not len(window):
            return none.view(np.uint64), none.view(np.uint64), none, none, none, none
        suffix = (least[window] & mask).astype(np.int64)
        new = np.flatnonzero(suffix[1:] != suffix[:-1]) + 1
        first, last = window[np.r_[0, new]], window[np.r_[new - 1, len(window) - 1]] + WINDOW
        at = suffix[np.r_[0, new]]
        whole = _mix((sums[last] - sums[first]) * self.down[first])
        return lead[at], whole, np.searchsorted(ends, at, "right"), first, last, at


class Runs(NamedTuple):
    """Runs of windows as arrays: whose (key, tag), where, and maybe the place of the suffix in them and its tokens."""

    key: np.ndarray
    tag: np.ndarray
    first: np.ndarray
    size: np.ndarray
    skip: np.ndarray | None = None
    lead: np.ndarray | None = None
    whole: np.ndarray | None = None

    def at(self, index) -> Runs:
        return Runs(*(None if x is None else x[index] for x in self))

    def plain(self) -> Runs:
        return Runs(*self[:4])

    def asked(self) -> Runs:
        return Runs(*self[:5])

    def __len__(self) -> int:  # rows, not columns
        return self.key.size


def _join(parts: list[Runs]) -> Runs:
    return Runs(*(None if x[0] is None else np.concatenate(x) for x in zip(*parts)))


_WIDTHS = {"lead": 6, "whole": 8}


def _packs(runs: Runs, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Runs, ordered by bucket, document and place, as bytes for each bucket: places as differences, compressed; tokens as they are.

    There are as many of these as tasks times buckets, so each costs a few slices only.
    """
    key, tag, first, size = runs[:4]
    n = len(key)
    head = np.r_[True, bucket[1:] != bucket[:-1]]
    new = head | np.r_[True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])]
    step = np.diff(first, prepend=0)
    step[new] = first[new]
    docs, heads = np.flatnonzero(new), np.flatnonzero(head)
    cuts, doc_cuts = [*heads.tolist(), n], [*np.searchsorted(docs, heads).tolist(), len(docs)]
    more = (runs.skip is not None) + (runs.lead is not None)
    by_doc = [(x.itemsize, memoryview(x.tobytes())) for x in (key[docs].astype(np.int64), tag[docs].astype(np.int64), np.diff(np.r_[docs, n]).astype(np.int32))]
    by_run = [(x.itemsize, memoryview(x.tobytes())) for x in (step.astype(np.int64), size.astype(np.int32), *([runs.skip.astype(np.uint8)] if more else []))]
    tokens = [(w, memoryview(np.ascontiguousarray(getattr(runs, c).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]).tobytes())) for c, w in _WIDTHS.items()] if more > 1 else []
    compress = zstandard.ZstdCompressor(level=1).compress
    for j, b in enumerate(bucket[heads].tolist()):
        x, y, u, v = cuts[j], cuts[j + 1], doc_cuts[j], doc_cuts[j + 1]
        packed = compress(b"".join((struct.pack("<3q", y - x, v - u, more), *(m[w * u : w * v] for w, m in by_doc), *(m[w * x : w * y] for w, m in by_run))))
        yield b, b"".join((len(packed).to_bytes(8, "little"), packed, *(m[w * x : w * y] for w, m in tokens)))


def _by_place(runs: Runs) -> np.ndarray:
    return np.lexsort((runs.first, runs.tag, runs.key))


def _pack(runs: Runs) -> bytes:
    runs = runs.at(_by_place(runs))
    return next(_packs(runs, np.zeros(len(runs), np.int64)))[1]


def _unpack(*blobs: bytes) -> Runs:
    """The runs of blobs of one kind."""
    decompress = zstandard.ZstdDecompressor().decompress
    columns: list[list] = [[] for _ in range(8)]
    more = 0
    for blob in blobs:
        view = memoryview(blob)
        cut = 8 + int.from_bytes(view[:8], "little")
        plain = memoryview(decompress(view[8:cut]))
        n, d, more = struct.unpack_from("<3q", plain)
        at = 24
        for column, wide in zip(columns, (8 * d, 8 * d, 4 * d, 8 * n, 4 * n, n if more else 0)):
            column.append(plain[at : at + wide])
            at += wide
        if more > 1:
            for column, w in zip(columns[6:], _WIDTHS.values()):
                column.append(view[cut : cut + w * n])
                cut += w * n
    key, tag, count, step, size = (np.frombuffer(b"".join(x), kind) for x, kind in zip(columns, (np.int64, np.int64, np.int32, np.int64, np.int32)))
    total = np.cumsum(step, dtype=np.int64)
    begins = np.cumsum(count) - count
    base = total[begins] - step[begins]
    found = [np.repeat(key, count), np.repeat(tag, count), total - np.repeat(base, count), size.astype(np.int64)]
    if more:
        found.append(np.frombuffer(b"".join(columns[5]), np.uint8).astype(np.int64))
    if more > 1:
        for column, w in zip(columns[6:], _WIDTHS.values()):
            wide = np.zeros((len(size), 8), np.uint8)
            wide[:, :w] = np.frombuffer(b"".join(column), np.uint8).reshape(-1, w)
            found.append(wide.view("<u8").ravel().astype(np.uint64))
    return Runs(*found)


def _token_order(runs: Runs) -> np.ndarray:
    """Order by (lead, whole, key, tag); most leads are unique, only the others need the rest."""
    order = np.argsort(runs.lead)
    lead = runs.lead[order]
    same = lead[1:] == lead[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    rows = order[tied]
    order[tied] = rows[np.lexsort((runs.tag[rows], runs.key[rows], runs.whole[rows], lead[tied]))]
    return order


def _bucket_of(key: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return (_mix(key.astype(np.uint64) * np.uint64(_BASE) ^ tag.astype(np.int64).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


# Packed runs. By bucket of leads: TOKENS; by bucket of documents: GONE (settled), ASK_LEADS and ASK_WINDOWS (to compare);
# by partition of windows: OPEN (equal to its first window) and EDGE (its first and last window).
TOKENS, GONE, ASK_LEADS, ASK_WINDOWS, OPEN, EDGE = range(6)
RUNS = "bucket int, kind int, data binary"
_NAMES = ["bucket", "kind", "data"]


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], names=_NAMES)


def _documents(runs: Runs, kind: int, buckets: int) -> list[tuple[int, int, bytes]]:
    if not len(runs):
        return []
    order = _by_place(runs)
    bucket = _bucket_of(runs.key, runs.tag, buckets)
    order = order[np.argsort(bucket[order], kind="stable")]
    return [(b, kind, data) for b, data in _packs(runs.at(order), bucket[order])]


def _segments(batches: Iterator[pa.RecordBatch], minimizers: Minimizers) -> Iterator[Runs]:
    """The runs of all texts, a buffer at a time."""
    units: list[tuple[int, int, int, bytes]] = []
    size = 0

    def measure() -> Runs:
        data = [u[3] for u in units]
        ends = np.cumsum([len(x) for x in data])
        lead, whole, unit, first, last, at = minimizers.runs(b"".join(data), ends)
        key, tag, base = (np.array([u[i] for u in units], np.int64) for i in range(3))
        shift = base - (ends - [len(x) for x in data])
        units.clear()
        return Runs(key[unit], tag[unit], first + shift[unit], last - first, at - first, lead & LOW48, whole)

    for batch in batches:
        for key, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = text.as_py()
            if not data or len(data) < WINDOW:
                continue
            for at in range(0, len(data) - WINDOW + 1, SEGMENT):
                part = data[at : at + SEGMENT + WINDOW - 1]
                if size + len(part) > 2 * SEGMENT:
                    yield measure()
                    size = 0
                units.append((key, tag, at, part))
                size += len(part)
            if size >= BUFFER:  # small, so that arrays stay in the cache
                yield measure()
                size = 0
    if units:
        yield measure()


TOKEN_COLUMNS = "lead long, whole long, k long, tag long"


def _draw(thin: int):
    """About one in ``thin`` suffixes, by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _segments(batches, Minimizers()):
            drawn = _mix(runs.whole ^ (runs.key.astype(np.uint64) * np.uint64(_BASE)) + runs.first.astype(np.uint64)) % np.uint64(thin) == 0
            some = runs.at(np.flatnonzero(drawn))
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (some.lead, some.whole, some.key, some.tag)], names=[f.split()[0] for f in TOKEN_COLUMNS.split(", ")])

    return run


class Splitters(NamedTuple):
    """Bounds of the buckets of leads: bucket b holds the suffixes from splitter b - 1 on and before splitter b.

    A splitter goes to the beginning of its lead, unless that fills about half a bucket or more.
    """

    lead: np.ndarray
    whole: np.ndarray
    key: np.ndarray
    tag: np.ndarray

    @staticmethod
    def of(lead: np.ndarray, whole: np.ndarray, key: np.ndarray, tag: np.ndarray, buckets: int) -> Splitters:
        order, some = np.lexsort((tag, key, whole, lead)), lead
        pick_ = order[np.unique(np.linspace(0, len(order), buckets + 1).astype(int)[1:-1])] if len(order) else order
        found = np.unique(np.stack([lead[pick_], whole[pick_], key[pick_].view(np.uint64), tag[pick_].view(np.uint64)], 1), axis=0) if len(pick_) else np.empty((0, 4), np.uint64)
        lead, whole, key, tag = found[:, 0], found[:, 1], found[:, 2].view(np.int64), found[:, 3].view(np.int64)
        drawn = np.sort(some)
        few = np.searchsorted(drawn, lead, "right") - np.searchsorted(drawn, lead) < SAMPLE // 2
        found = np.unique(np.stack([lead, *(np.where(few, least, x).view(np.uint64) for x, least in ((whole, np.uint64(0)), (key, FIRST), (tag, FIRST)))], 1), axis=0)
        lead, whole, key, tag = found[:, 0], found[:, 1], found[:, 2].view(np.int64), found[:, 3].view(np.int64)
        order = np.lexsort((tag, key, whole, lead))
        return Splitters(*(np.ascontiguousarray(x[order]) for x in (lead, whole, key, tag)))

    def cuts(self, runs: Runs) -> np.ndarray:
        """Where each splitter cuts sorted runs: the first that isn't smaller."""
        low, high = (np.searchsorted(runs.lead, self.lead, side) for side in ("left", "right"))
        for j in np.flatnonzero(high > low):
            a, b = low[j], high[j]
            for column, value in ((runs.whole, self.whole[j]), (runs.key, self.key[j]), (runs.tag, self.tag[j])):
                a, b = (a + np.searchsorted(column[a:b], value, side) for side in ("left", "right"))
            low[j] = a
        return low

    def cut_leads(self, bucket: int) -> np.ndarray:
        """The leads of a bucket that others may have too."""
        near = slice(max(0, bucket - 1), bucket + 1)
        return self.lead[near][(self.whole[near] != 0) | (self.key[near] != FIRST) | (self.tag[near] != FIRST)]


def _list_runs(splitters: Splitters, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minimizers = Minimizers()
        held: list[Runs] = []

        def flush() -> pa.RecordBatch:
            runs = _join(held)
            held.clear()
            if not len(runs):
                return _rows([])
            order = _token_order(runs)
            runs = runs.at(order)
            new = np.r_[True, (runs.lead[1:] != runs.lead[:-1]) | (runs.whole[1:] != runs.whole[:-1])]
            gone = runs.key > runs.key[new][np.cumsum(new) - 1]
            rows = _documents(runs.at(gone).plain(), GONE, buckets)
            runs, order = runs.at(~gone), order[~gone]
            bucket = np.repeat(np.arange(len(splitters.lead) + 1), np.diff(np.r_[0, splitters.cuts(runs), len(runs)]))
            place = np.argsort(bucket << 32 | order)  # as listed: by document and place
            rows += [(b, TOKENS, data) for b, data in _packs(runs.at(place), bucket[place])]
            return _rows(rows)

        for runs in _segments(batches, minimizers):
            held.append(runs)
            if sum(map(len, held)) >= FLUSH:
                yield flush()
        if held:
            yield flush()
        del minimizers
        trim()

    return run


def _settle(splitters: Splitters, buckets: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, bucket = [], 0
        for batch in batches:
            rows = []
            for b, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if kind == TOKENS:
                    bucket = b
                    parts.append(data.as_py())
                else:
                    rows.append((b, kind, data.as_py()))
            if rows:
                yield _rows(rows)
        if parts:
            runs = _unpack(*parts)
            parts.clear()
            runs = runs.at(_token_order(runs))
            new_lead = np.r_[True, runs.lead[1:] != runs.lead[:-1]]
            new = new_lead | np.r_[True, runs.whole[1:] != runs.whole[:-1]]
            gone = runs.key > runs.key[new][np.cumsum(new) - 1]
            heads = np.flatnonzero(new_lead)
            cut = np.isin(runs.lead[heads], splitters.cut_leads(bucket))  # other buckets may have more of it
            differ = cut | ((np.minimum.reduceat(runs.key, heads) != np.maximum.reduceat(runs.key, heads)) & (np.add.reduceat(new, heads) > 1))
            single = cut | (np.add.reduceat(~gone, heads) > hot)
            group = np.cumsum(new_lead) - 1
            yield _rows(_documents(runs.at(gone).plain(), GONE, buckets))
            for kind, chosen in ((ASK_LEADS, differ & ~single), (ASK_WINDOWS, differ & single)):
                yield _rows(_documents(runs.at(~gone & chosen[group]).asked(), kind, buckets))
            del runs, new_lead, new, gone, heads, group
        trim()

    return run


MIXED = "bucket int, kind int, doc_id long, k long, tag long, data binary"  # texts have kind -1
SUFFIXES = "sort binary, single boolean, k long, tag long, first long, skip int, run binary"
_SUFFIX_KINDS = (pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs to compare: a row for each suffix, by its lead, or for each single window."""
    texts, asked = {}, []
    for batch in batches:
        for kind, k, tag, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "k", "tag", "data"))):
            if kind < 0:
                texts[k, tag] = data
            else:
                asked.append((kind == ASK_WINDOWS, data))
    unpack = zstandard.ZstdDecompressor().decompress
    names = [f.split()[0] for f in SUFFIXES.split(", ")]
    out: list[list] = [[] for _ in names]
    owner, whole = None, b""
    runs = [(single, _unpack(*some)) for single in (False, True) if (some := [data for s, data in asked if s == single])]
    asked.clear()
    flat = sorted((k, tag, first, size, skip, single) for single, r in runs for k, tag, first, size, skip in zip(*(x.tolist() for x in r[:5])))
    runs.clear()
    for k, tag, first, size, skip, single in flat:
        if owner != (k, tag):
            owner = (k, tag)
            whole = unpack(texts[owner])
        text = whole[first : first + size]
        found = [(text[i : i + WINDOW], True, k, tag, first + i, 0, None) for i in range(size - WINDOW + 1)] if single else [(text[skip : skip + GRAM], False, k, tag, first, skip, text)]
        for row in found:
            for column, value in zip(out, row):
                column.append(value)
        if len(out[0]) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SUFFIX_KINDS)], names=names)
            out = [[] for _ in names]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _SUFFIX_KINDS)], names=names)
    del texts, flat, out, whole
    trim()


def multikey_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of symbols in lexicographic order, and for each but the first whether it equals the one before.

    Multikey quicksort with wide symbols: rows are parted by their first symbol; only parts of several rows go on to the
    next one.
    """
    order = np.argsort(symbols[:, 0])
    same = symbols[order[1:], 0] == symbols[order[:-1], 0]
    for level in range(1, symbols.shape[1]):
        open_ = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        if not len(open_):
            break
        part = np.cumsum(~np.r_[False, same])[open_]
        rows = order[open_]
        order[open_] = rows[np.lexsort((symbols[rows, level], part))]
        same &= symbols[order[1:], level] == symbols[order[:-1], level]
    return order, same


def _symbols(windows: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(windows), -(-WINDOW // 8) * 8), np.uint8)
    padded[:, :WINDOW] = windows
    return padded.view(">u8").astype(np.uint64)


def _merged(runs: Runs) -> Runs:
    """Overlapping and touching runs of a document become one."""
    if not len(runs):
        return runs
    runs = runs.at(np.lexsort((runs.first, runs.tag, runs.key)))
    k, t, place = runs[:3]
    new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (place[1:] > place[:-1] + WINDOW)]  # windows, all of one size
    heads = np.flatnonzero(new)
    ends = place[np.r_[heads[1:] - 1, len(place) - 1].astype(int)] + WINDOW
    return Runs(k[heads], t[heads], place[heads], ends - place[heads])


def _windows(key, tag, place) -> Runs:
    return Runs(key, tag, place, np.full(len(key), WINDOW))


def _compare_leads(table: pa.Table) -> Runs:
    """The windows of suffixes with equal leads that a smaller document has too."""
    key, tag, first, skip = (table.column(c).to_numpy().astype(np.int64) for c in ("k", "tag", "first", "skip"))
    runs = table.column("run").to_pylist()
    size = np.array([len(r) for r in runs])
    begin = np.cumsum(size) - size
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(runs), np.uint8), WINDOW)
    hits = [(np.empty(0, np.int64),) * 2]
    for offset in range(OFFSETS):  # equal windows have their suffix at the same place
        own = np.flatnonzero((skip >= offset) & (skip - offset + WINDOW <= size))
        if len(own) < 2:
            continue
        at = skip[own] - offset
        order, same = multikey_order(_symbols(view[begin[own] + at]))
        new = np.r_[True, ~same]
        k = key[own][order]
        hit = k > np.minimum.reduceat(k, np.flatnonzero(new))[np.cumsum(new) - 1]
        hits.append((own[order][hit], at[order][hit]))
    row, at = (np.concatenate(x) for x in zip(*hits))
    return _windows(key[row], tag[row], first[row] + at)


def _compare_windows(table: pa.Table) -> tuple[Runs, Runs, bytes]:
    """Of single windows, in a partition: those that a smaller document has too; those equal to the partition's first; and its edges."""
    key, tag, place = (table.column(c).to_numpy().astype(np.int64) for c in ("k", "tag", "first"))
    windows = np.frombuffer(b"".join(table.column("sort").to_pylist()), np.uint8).reshape(-1, WINDOW)
    order, same = multikey_order(_symbols(windows))
    heads = np.flatnonzero(np.r_[True, ~same])
    k = key[order]
    least = np.minimum.reduceat(k, heads)
    group = np.cumsum(np.r_[True, ~same]) - 1
    hit = order[(group > 0) & (k > least[group])]
    open_ = order[group == 0]
    head = min(zip(*(x[open_].tolist() for x in (key, tag, place))))
    edge = [windows[order[0]].tobytes().hex(), *head, int(least[0]), windows[order[-1]].tobytes().hex(), int(least[-1])]
    return _windows(key[hit], tag[hit], place[hit]), _windows(key[open_], tag[open_], place[open_]), json.dumps(edge).encode()


def _compare(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        single = table.column("single")
        leads, windows = table.filter(pc.invert(single)), table.filter(single)
        if len(leads):
            yield _rows(_documents(_merged(_compare_leads(leads)), GONE, buckets))
        if len(windows):
            gone, open_, edge = _compare_windows(windows)
            part = TaskContext.get().partitionId()
            yield _rows([*_documents(_merged(gone), GONE, buckets), (part, OPEN, _pack(open_)), (part, EDGE, edge)])
        del table, leads, windows, found
        trim()

    return run


def carry(edges: list[tuple[int, bytes]]) -> dict[int, int]:
    """For each partition of windows, in their order, the smallest document with its first window, there or before."""
    rows = sorted((bytes.fromhex(first), k, tag, place, least, bytes.fromhex(last), last_least, part) for part, (first, k, tag, place, least, last, last_least) in ((p, json.loads(e)) for p, e in edges))
    out: dict[int, int] = {}
    window, smallest = b"", LAST
    for first, _, _, _, least, last, last_least, part in rows:
        out[part] = min(least, smallest) if first == window else least
        window, smallest = last, out[part] if first == last else last_least
    return out


def _close(smallest: dict[int, int], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = _unpack(data.as_py())
                yield _rows(_documents(_merged(runs.at(runs.key > smallest[part]).plain()), GONE, buckets))

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<bigint>, kept binary, kept_sha256 string"
_RESULT_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string())


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts = [], []
        for batch in batches:
            for kind, doc_id, k, tag, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "doc_id", "k", "tag", "data"))):
                docs.append((doc_id, k, tag, data)) if kind < 0 else parts.append(data)
        spans: dict[tuple[int, int], tuple] = {}
        if parts:
            runs = _unpack(*parts)
            parts.clear()
            runs = runs.at(np.lexsort((runs.tag, runs.key)))
            cuts = np.flatnonzero(np.r_[True, (runs.key[1:] != runs.key[:-1]) | (runs.tag[1:] != runs.tag[:-1])])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(runs)]):
                spans[int(runs.key[a]), int(runs.tag[a])] = (runs.first[a:b], runs.size[a:b])
        unpack = zstandard.ZstdDecompressor().decompress
        names = [f.split()[0] for f in RESULT.split(", ")]
        out: list[list] = [[] for _ in names]
        held = 0
        for doc_id, k, tag, packed in docs:
            data = kept = unpack(packed)
            removed: list[int] = []
            if (own := spans.get((k, tag))) is not None:
                cover = np.zeros(len(data) + 1, np.int32)
                np.add.at(cover, own[0], 1)
                np.add.at(cover, own[0] + own[1], -1)
                gone = np.cumsum(cover) > 0
                removed = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0)).tolist()
                kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
            for column, value in zip(out, (doc_id, len(data), len(data) - len(kept), removed, kept if with_text else None, hashlib.sha256(kept).hexdigest())):
                column.append(value)
            held += with_text * len(kept) + 200
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, _RESULT_KINDS)], names=names)
                out, held = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, _RESULT_KINDS)], names=names)
        del out, spans, docs
        trim()

    return run


def _packed(docs: DataFrame, buckets: int) -> DataFrame:
    """The texts, compressed, with their bucket of documents."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            doc_id, k, tag, text = batch.columns
            bucket = _bucket_of(k.to_numpy(), tag.to_numpy(), buckets)
            packed = [pack(t.as_py() or b"") for t in text]
            kind = np.full(len(bucket), -1, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind), doc_id, k, tag, pa.array(packed, pa.binary())], names=[f.split()[0] for f in MIXED.split(", ")])

    return docs.select("doc_id", "k", "tag", "data").mapInArrow(run, MIXED)


def dedup(docs: DataFrame, with_text: bool = True, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept, kept_sha256`` of every row; spans are flat (start, end) of maximal removed runs in bytes, kept the bytes that are left (null unless ``with_text``)."""
    rows = pick(docs, doc_id="doc_id", text="text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, n_bytes // bucket_bytes + 1)
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("k"), F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("data"))
    texts = rows.select("k", "tag", "data")

    per_splitter = n_bytes // buckets // 15  # suffixes
    one_in = max(1, min(128, per_splitter // (16 * SAMPLE)))
    some = texts.where(F.pmod(F.xxhash64("k", "tag", F.lit(7)), F.lit(one_in)) == 0) if buckets > 1 else texts.limit(0)
    drawn = some.mapInArrow(_draw(max(1, per_splitter // one_in // SAMPLE)), TOKEN_COLUMNS).toArrow()
    splitters = Splitters.of(*(drawn.column(c).to_numpy().view(t) for c, t in (("lead", np.uint64), ("whole", np.uint64), ("k", np.int64), ("tag", np.int64))), buckets)

    listed = texts.mapInArrow(_list_runs(splitters, buckets), RUNS)
    settled = materialize(listed.repartitionById(buckets, "bucket").mapInArrow(_settle(splitters, buckets, hot), RUNS), "runs")
    packed = _packed(rows, buckets)

    def with_texts(runs: DataFrame) -> DataFrame:
        none = F.lit(None).cast("long")
        return packed.union(runs.select("bucket", "kind", none, none, none, "data")).repartitionById(buckets, "bucket")

    asked = settled.where(F.col("kind").isin(ASK_LEADS, ASK_WINDOWS))
    suffixes = materialize(with_texts(asked).mapInArrow(_fetch, SUFFIXES), "suffixes")
    single = lambda c: F.when(F.col("single"), F.col(c)).otherwise(0)
    ranged = suffixes.repartitionByRange(buckets, "single", "sort", single("k"), single("tag"), single("first"))
    compared = materialize(ranged.mapInArrow(_compare(buckets), RUNS), "compared")
    discard(suffixes)
    smallest = carry([(r.bucket, r.data) for r in compared.where(F.col("kind") == EDGE).collect()])  # a row for each partition
    closed = compared.where(F.col("kind") == OPEN).select("bucket", "data").mapInArrow(_close(smallest, buckets), RUNS)
    gone = settled.where(F.col("kind") == GONE).union(compared.where(F.col("kind") == GONE)).union(closed)
    return with_texts(gone).mapInArrow(_remove(with_text), RESULT)


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs, False).select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


# Bytes as hexadecimal digits; windows are cut from blocks of 256, since substr counts from the start of its text.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT r, k, j, substr(h, 2 * j + 1, {2 * (255 + WINDOW)}) AS h FROM (SELECT r, k, h, unnest(range(0, len(h) // 2 - {WINDOW - 1}, 256)) AS j FROM d)),
w AS (SELECT r, k, j + i AS i, substr(h, 2 * i + 1, {2 * WINDOW}) AS s FROM (SELECT r, k, j, h, unnest(range(0, len(h) // 2 - {WINDOW - 1})) AS i FROM block)),
least_ AS (SELECT s, min(k) AS m FROM w GROUP BY s),
hit AS (SELECT r, i FROM w JOIN least_ USING (s) WHERE k > m),
isle AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT r, g, min(i) AS a, max(i) + {WINDOW} AS b FROM isle GROUP BY r, g),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM span),
kept AS (SELECT r, count(*) AS n, sum(b - a) AS gone, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS h FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
