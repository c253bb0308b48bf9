"""Secret scanning: named patterns, and a battery of randomness tests with length-aware false-discovery control.

Base kinds (spans are whole matches, in code points): ``assign``, ``access``, ``hex`` as in :data:`ASSIGN`,
:data:`ACCESS`, :data:`HEX`. The method adds kind ``random``: runs of at least ``LEAST`` characters of
``A-Za-z0-9+/_=-`` in what the base spans leave, cut at inner ``=``. A run with separators (``+/`` or ``_-``) is taken as
a whole, if one alphabet holds it, and as its parts between separators of either kind and of both; of the parts that
are found, longer ones come first and others that overlap them are left out. For each, the smallest fitting encoding is inferred (digits, hexadecimal,
base 32, lower or upper alphanumeric, alphanumeric, base 64) and three tests are made:

* chi-squared uniformity over that alphabet. Its p-value is that of so even a token among tokens of the same length and
  alphabet made of ordinary writing (:data:`WRITING`), by the normal approximation of the statistic's mean and variance;
* runs about the middle of the alphabet, and lag-1 serial correlation: a token that departs from chance by more than
  ``Z_GATE`` deviations in either isn't taken (its p-value is 1).

Benjamini-Hochberg at level ``Q`` runs over all candidates of the corpus within each length stratum, on a histogram of
p-values of fixed size, each bin counted at its upper edge (so the level holds).

Defined cases: a null text is empty (no spans); a null doc_id is carried through; repeated rows each get their result and
each count in the control; no candidates, no discoveries; other columns are not read; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
VALUE = re.compile(r"[^=]+(?:=+\Z)?")  # padding stays with the last
PARTS = tuple(re.compile(rf"[^{x}]+") for x in ("+/", "_-", "+/_-"))
KINDS = ("assign", "access", "hex", "random")
LEAST, Z_GATE, Q = 20, 3.0, 0.01
STRATA = (20, 28, 40, 64)  # least lengths
BINS, DEPTH = 400, 40.0  # bins of -log10 p, up to this depth

_HEXMAP = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))
_HEXRUN = b"1" * 24
ALPHABETS = (
    "0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
#: Relative frequencies of letters in ordinary writing; a capital has a thirtieth of its letter's, a digit or sign 0.3.
WRITING = dict(zip("etaoinsrhldcumfpgwybvkxjqz", (12.0, 9.1, 8.1, 7.7, 7.3, 7.0, 6.3, 6.0, 5.9, 4.3, 4.0, 2.9, 2.7, 2.6, 2.3, 1.8, 2.0, 2.1, 2.1, 1.5, 1.1, 0.7, 0.2, 0.1, 0.1, 0.1)))


def _moments() -> list[tuple[frozenset, dict, float, float, float, float]]:
    out = []
    for alphabet in ALPHABETS:
        size = len(alphabet)
        only_capitals = not any(c.islower() for c in alphabet)
        q = np.array([WRITING.get(c) or (WRITING[c.lower()] / (1 if only_capitals else 30) if c.lower() in WRITING else 0.3) for c in alphabet])
        q = q / q.sum()
        d = q - 1 / size
        spread, bent = float((q * (1 - q)).sum()), float((d * d).sum())
        lean = float((q * d * d).sum() - (q * d).sum() ** 2)
        out.append((frozenset(alphabet), {c: i for i, c in enumerate(alphabet)}, float(size), spread, bent, lean))
    return out


MOMENTS = _moments()


def p_value(token: str) -> float:
    """How likely ordinary writing of this length and alphabet is so even; 1 if runs or serial correlation speak against chance."""
    token = token.rstrip("=")
    n, used = len(token), set(token)
    found = next((m for m in MOMENTS if used <= m[0]), None)
    if found is None or n < 8:
        return 1.0
    _, index, size, spread, bent, lean = found
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    x2 = size / n * sum(v * v for v in counts.values()) - n
    mean = size * spread + n * size * bent
    sd = math.sqrt(max(1.0, 4 * n * size * size * lean + 2 * (size - 1)))
    p = 0.5 * math.erfc((mean - x2) / sd / math.sqrt(2))
    if p > 0.2:
        return p
    codes = [index[c] for c in token]
    up = [2 * c >= size for c in codes]
    high = sum(up)
    if not 0 < high < n:
        return 1.0
    runs = 1 + sum(a != b for a, b in zip(up, up[1:]))
    expected = 1 + 2 * high * (n - high) / n
    var = (expected - 1) * (expected - 2) / (n - 1)
    if abs(runs - expected) > Z_GATE * math.sqrt(max(var, 1e-9)):
        return 1.0
    middle = sum(codes) / n
    square = sum((c - middle) ** 2 for c in codes)
    if square == 0 or abs(sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:])) / square + 1 / n) * math.sqrt(n) > Z_GATE:
        return 1.0
    return p


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, by start and then kind. Cheap necessary conditions come first."""
    spans = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEXRUN in text.encode("utf-8", "surrogatepass").translate(_HEXMAP):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    return spans


def uncovered(a: int, b: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the base spans, ordered by start, leave of (a, b)."""
    for x, _, y in base:
        if x < b and a < y:
            if a < x:
                yield a, x
            a = y
    if a < b:
        yield a, b


def tokens(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The places of the tokens of ``LEAST`` or more characters in a run (a, b)."""
    for v in VALUE.finditer(text[a:b]):
        value, at = v.group(), a + v.start()
        if len(value) < LEAST:
            continue
        plain, safe = "+" in value or "/" in value, "_" in value or "-" in value
        places = set() if plain and safe else {(0, len(value))}
        if plain or safe:
            places |= {m.span() for p in PARTS for m in p.finditer(value)}
        yield from ((at + x, at + y) for x, y in sorted(places) if y - x >= LEAST)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin of p) of the tokens that the battery is run on."""
    out = []
    for m in CANDIDATE.finditer(text):
        for run in uncovered(*m.span(), base):
            for a, b in tokens(text, *run):
                p = p_value(text[a:b])
                stratum = sum(b - a >= s for s in STRATA) - 1
                out.append((a, b, stratum, min(BINS - 1, int(-math.log10(max(p, 1e-300)) * BINS / DEPTH))))
    return out


def apart(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the places that overlap none longer, or as long and further left."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        if all(b <= x or y <= a for x, y in out):
            out.append((a, b))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id, n (array by base kind), base, candidates``: one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, bases, cands = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                ns.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
                bases.append([x for s in base for x in s])
                cands.append([x for c in candidates(text, base) for x in c])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.list_(pa.int64())), pa.array(bases, pa.list_(pa.int64())), pa.array(cands, pa.list_(pa.int64()))], names=["doc_id", "n", "base", "candidates"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, n array<bigint>, base array<bigint>, candidates array<bigint>")


def thresholds(judged: DataFrame, q: float = Q) -> list[int]:
    """For each stratum the least bin that is a discovery (``BINS`` if none), from at most strata x bins counts."""
    at = F.explode(F.sequence(F.lit(0), (F.size("candidates") / 4).cast("int") - 1)).alias("i")
    flat = judged.where(F.size("candidates") > 0).select("candidates", at)
    counts = flat.groupBy(F.get("candidates", (F.col("i") * 4 + 2).cast("int")).alias("s"), F.get("candidates", (F.col("i") * 4 + 3).cast("int")).alias("b")).count().collect()
    table = np.zeros((len(STRATA), BINS), np.int64)
    for r in counts:
        table[r.s, r.b] += r["count"]
    out = []
    for row in table:
        total, best = row.sum(), BINS
        above = np.cumsum(row[::-1])[::-1]
        for b in range(BINS - 1, -1, -1):
            if above[b] and 10 ** (-b * DEPTH / BINS) * total <= q * above[b]:
                best = b
        out.append(int(best))
    return out


def find(docs: DataFrame, q: float = Q) -> DataFrame:
    """``doc_id, n, base, spans``: flat (start, kind, end) triples of the base kinds, and of all kinds, by start."""
    judged = materialize(judge(docs), "secrets")
    least = thresholds(judged, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, cand in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                spans = list(zip(base[::3], base[1::3], base[2::3]))
                spans += [(a, 3, b) for a, b in apart([(a, b) for a, b, s, p in zip(cand[::4], cand[1::4], cand[2::4], cand[3::4]) if p >= least[s]])]
                out.append([x for s in sorted(spans) for x in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "n", "base", "spans"])

    return judged.mapInArrow(run, "doc_id long, n array<bigint>, base array<bigint>, spans array<bigint>")


def _joined(flat):
    """kind:start:end, comma-joined, of flat triples."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda i: F.concat_ws(":", F.get(names, F.get(flat, i * 3 + 1).cast("int")), F.get(flat, i * 3).cast("string"), F.get(flat, i * 3 + 2).cast("string"))
    return F.when(F.size(flat) > 0, F.array_join(F.transform(F.sequence(F.lit(0), (F.size(flat) / 3).cast("int") - 1), one), ",")).otherwise(F.lit(""))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of :func:`find`."""
    n = [F.get("n", F.lit(i)).alias(f"n_{KINDS[i]}") for i in range(3)]
    return find(docs).select("doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
