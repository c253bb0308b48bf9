"""Quality selection by importance resampling.

Two hashed n-gram models (word unigrams and bigrams, ``BUCKETS`` buckets, add-``SMOOTH``) are estimated: the target's from
up to ``TARGET`` labelled documents of quality 1 (the first by a hash of doc_id; the only sampling), the raw one's from
every document. A document's log weight is the sum over its n-grams of log target - log raw; to it a Gumbel variate is
added, drawn from a hash of doc_id and text, and the top k keys are the sample without replacement. k is ``share`` of
the documents; by default the share of quality 1 among the labels.

Defined cases: null and empty texts have weight 0; a null doc_id competes like any other; repeated rows have equal keys
and are kept or left together unless the last place falls among them, in which case equal rows are indistinguishable; without labels
the target is the raw model; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

TARGET, BUCKETS, SMOOTH, BINS = 5000, 1 << 16, 1.0, 1024
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    """Token to hash; a memo of bounded size."""

    MOST = 500_000

    def __missing__(self, token: str) -> int:
        h = self[token] = xxhash.xxh32_intdigest(token)
        return h

    def grams(self, text: str | None) -> np.ndarray:
        """The bucket of each unigram, then of each bigram."""
        if len(self) > self.MOST:
            self.clear()
        one = np.array(list(map(self.__getitem__, TOKEN.findall((text or "").lower()))), np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(29)
        return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def counts(texts: DataFrame) -> np.ndarray:
    """The n-grams of all texts by bucket: partitions count, a shuffle of at most ``BUCKETS`` rows a partition adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(total, buckets.grams(t.as_py()), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def ratios(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log target - log raw by bucket, and the share of quality 1 among the labels."""
    known = pick(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    chosen = known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET).select("doc_id")
    rows = pick(docs, doc_id="doc_id", text="text")
    raw = counts(rows.select("text"))
    target = counts(rows.join(F.broadcast(chosen), "doc_id").select("text"))  # at most TARGET ids
    if not target.sum():
        return np.zeros(BUCKETS), share if share is not None else 1.0
    log = lambda n: np.log(n + SMOOTH) - np.log(n.sum() + SMOOTH * BUCKETS)
    return log(target) - log(raw), share


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``doc_id, log_weight, gumbel_key`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            w, g = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                w.append(float(ratio[buckets.grams(text)].sum()))
                u = (xxhash.xxh64_intdigest(f"{doc_id}\0{text}".encode("utf-8", "surrogatepass"), 8) + 0.5) / 2**64
                g.append(w[-1] - float(np.log(-np.log(min(u, 1 - 2**-53)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64()), pa.array(g, pa.float64())], names=["doc_id", "log_weight", "gumbel_key"])

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, log_weight double, gumbel_key double")


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of largest key, by counting in ever narrower bins: no sort of the table, no row but the last bin's leaves the executors."""
    low, high = rows.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    if low is None or k <= 0:
        return rows.limit(0)
    above = 0  # rows with keys beyond high
    while True:
        width = (high - low) / BINS
        if width <= abs(high) * 1e-15 or width == 0:
            break
        inside = rows.where(F.col("gumbel_key").between(low, high))
        found = {r.b: r.n for r in inside.groupBy(F.least(F.floor((F.col("gumbel_key") - low) / width), F.lit(BINS - 1)).alias("b")).agg(F.count("*").alias("n")).collect()}
        b = BINS - 1
        while b > 0 and above + found.get(b, 0) < k:
            above += found.get(b, 0)
            b -= 1
        cut = inside.where(F.least(F.floor((F.col("gumbel_key") - low) / width), F.lit(BINS - 1)) == b)
        if found.get(b, 0) <= 1000:
            edge = cut.orderBy(F.col("gumbel_key").desc()).select("gumbel_key").limit(max(1, k - above)).collect()
            low = edge[-1][0] if edge else low
            break
        low, high = cut.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    over = rows.where(F.col("gumbel_key") > low)
    ties = rows.where(F.col("gumbel_key") == low).orderBy("doc_id").limit(max(0, k - over.count()))
    return over.union(ties)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The kept documents: ``doc_id, log_weight, gumbel_key``."""
    ratio, known = ratios(docs, labels)
    scored = materialize(weights(docs, ratio), "quality")
    return top(scored, round(scored.count() * (known if share is None else share)))
