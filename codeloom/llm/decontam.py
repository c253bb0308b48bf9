"""Benchmark decontamination by one Aho-Corasick automaton.

Every benchmark item gives windows of ``WINDOW`` consecutive words (an item of fewer words, but not none, is one
window). The windows of all items form one automaton, which reads each normalised document once; a hit is mapped back
to words and, where asked for, to code-point offsets of the original text.

Words: A-Z lower-cased, then runs of characters outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F``.

Defined cases: a null or empty document or item has no words; a null doc_id is carried through; repeated rows each get
their own result; repeated items are items of their own if their ids differ, a null item_id is left out of the items'
list but its windows count as hits; an empty benchmark hits nothing; other columns are not read. The benchmark is the
stated query set: it is sent to the tasks in blocks of at most ``BLOCK_BYTES``, one automaton each; with several blocks
the hits of a row are united by a shuffle of hits alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

WINDOW = 10
BLOCK_BYTES = 32 << 20
#: A-Z to lower case; what is no part of a word to a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # before lower-casing, hence A-Z too


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows(item: str | None, size: int = WINDOW) -> set[bytes]:
    w = words(item)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def automaton(items: list[tuple[int | None, str | None]], size: int = WINDOW):
    """The automaton over all windows; a pattern's value is (number of words, characters, item ids)."""
    owners: dict[bytes, set] = {}
    for item_id, text in items:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item_id)
    found = ahocorasick.Automaton()
    for w, ids in owners.items():
        key = f" {w.decode('latin-1')} "
        found.add_word(key, (w.count(b" ") + 1, len(key), tuple(i for i in ids if i is not None)))
    found.make_automaton()
    return found


def scan(machine, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Maximal runs of hit words, as (first, end), and the items with occurring windows."""
    if not len(machine) or not w:
        return [], set()
    line = f" {b' '.join(w).decode('latin-1')} "
    hits = list(machine.iter(line))
    if not hits:
        return [], set()
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    starts = np.searchsorted(blanks, [end - v[1] + 1 for end, v in hits]).tolist()
    spans, items = [], set()
    for first, (_, (n, _, ids)) in sorted(zip(starts, hits), key=lambda x: x[0]):
        items.update(ids)
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], first + n))
        else:
            spans.append((first, first + n))
    return spans, items


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark's items, a block of bounded size at a time."""
    block, size = [], 0
    for row in pick(benchmark, item_id="item_id", text="text").toLocalIterator():
        block.append((row.item_id, row.text))
        size += 64 + len(row.text or "")
        if size >= most:
            yield block
            block, size = [], 0
    yield block


SCHEMA = "doc_id long, text_hash long, n_words long, spans array<bigint>, items array<bigint>"


def hits(docs: DataFrame, items: list[tuple[int | None, str | None]], size: int = WINDOW) -> DataFrame:
    """A row for each document: its number of words, hit runs (first, end, first, end ...) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items, size)
        for batch in batches:
            n, spans, found = [], [], []
            for text in batch.column(2):
                w = words(text.as_py())
                s, i = scan(machine, w)
                n.append(len(w))
                spans.append([x for p in s for x in p])
                found.append(sorted(i))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "n_words", "spans", "items"])

    rows = pick(docs, doc_id="doc_id", text="text")
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, SCHEMA)


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, spans, items`` for every row of ``docs``; spans are united over the blocks of the benchmark."""
    parts = [hits(docs, block, size) for block in blocks(benchmark, block_bytes)]
    if len(parts) == 1:
        return parts[0]
    one = parts[0].select("doc_id", "text_hash", "n_words", F.lit(None).cast("array<bigint>").alias("spans"), F.lit(None).cast("array<bigint>").alias("items"))
    all_ = one
    for p in parts:
        all_ = all_.unionByName(p.where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"]).withColumn("n_words", F.lit(None).cast("long")))
    grouped = all_.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def unite(batches):
        for batch in batches:
            out = []
            for flat in batch.column(3).to_pylist():
                runs: list[int] = []
                for a, b in sorted(zip(flat[::2], flat[1::2])):
                    if runs and a <= runs[-1]:
                        runs[-1] = max(runs[-1], b)
                    else:
                        runs += [a, b]
                out.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.list_(pa.int64())), batch.column(4)], names=["doc_id", "text_hash", "n_words", "spans", "items"])

    each = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", "text_hash", "n_words", "spans", "items")
    return each.mapInArrow(unite, SCHEMA)


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code-point offsets of the original text."""
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def locate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, start, end, passage``: each hit run of each document, in code points of its original text."""

    def run_for(items):
        def run(batches):
            machine = automaton(items, size)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s, _ = scan(machine, words(text))
                    rows += [(doc_id, a, b, text[a:b]) for a, b in original_offsets(text or "", s)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "start", "end", "passage"])

        return run

    rows = pick(docs, doc_id="doc_id", text="text")
    parts = [rows.mapInArrow(run_for(b), "doc_id long, start long, end long, passage string") for b in blocks(benchmark, block_bytes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that no window of the benchmark occurs in. Texts are never shuffled."""
    names = docs.columns
    place = names.index("text")
    docs = docs.toDF(*(f"_c{i}" for i in range(len(names))))  # other columns may have clashing names

    def run_for(items):
        def run(batches):
            machine = automaton(items, size)
            for batch in batches:
                yield batch.filter(pa.array([not scan(machine, words(t.as_py()))[0] for t in batch.column(place)], pa.bool_()))

        return run

    for block in blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(run_for(block), docs.schema)
    return docs.toDF(*names)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of :func:`find`."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.when(i % 2 == 1, F.get("spans", i)).otherwise(-F.get("spans", i)))
    n_hit = F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return find(docs, benchmark).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM bi),
di AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size),
dw AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM di),
h AS (SELECT r, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""


def sha(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
