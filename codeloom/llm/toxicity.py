"""Toxicity by non-negative positive-unlabelled learning.

Training rows: up to ``POSITIVES`` confirmed toxic documents and up to ``UNLABELLED`` documents of the labelled
population whose labels are hidden, both the first by a hash of doc_id. These two bounds are the only sampling; every
document is scored. Rows whose crc32(doc_id as text) mod 5 is 0 are held out: their labels are never read.

Features of a text are its distinct words (A-Z lower-cased, split at ASCII signs) and their byte ``GRAM``-grams with word
ends marked, hashed to ``BITS`` bits; those that occur in at least ``MIN_DF`` positives and ``MIN_SHARE`` of them are
ranked by how much likelier they are there than among the unlabelled, and the first ``FEATURES`` are kept. A linear classifier is trained in numpy with the non-negative risk
``prior * R_p+ + max(0, R_u- - prior * R_p-)``, whose gradient is reversed when the bracket is negative. The prior is the share of
toxic rows among the training labels.

Defined cases: a null or empty text has no words and gets the score of the bias alone; a null doc_id is scored, never
trained on; repeated rows score alike; without positives every score is the clipped prior; an empty table gives an empty
result; doc_id, lang, source, labels and other columns are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, pick
from .decontam import words

POSITIVES, UNLABELLED = 4000, 8000
MIN_DF, MIN_SHARE, FEATURES = 3, 0.02, 4000
EPOCHS, RATE, DECAY = 1000, 0.1, 1e-5
FOLDS = 5
GRAM, BITS = 5, 30


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """``doc_id, text, kind`` (1 positive, 0 unlabelled) of the bounded sample, and the class prior."""
    known = pick(labels, doc_id="doc_id", toxic="toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg("toxic")).first()[0]
    order = [F.xxhash64("doc_id"), "doc_id"]
    positive = known.where("toxic = 1").orderBy(*order).limit(POSITIVES).select("doc_id", F.lit(1).alias("kind"))
    hidden = known.orderBy(*order).limit(UNLABELLED).select("doc_id", F.lit(0).alias("kind"))
    chosen = positive.union(hidden)  # at most POSITIVES + UNLABELLED ids: small enough to send to every task
    return pick(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id"), min(0.5, max(0.01, prior or 0.0))


def word_features(word: bytes) -> list[int]:
    """The hashed features of one word: itself and its byte n-grams, ends marked."""
    marked = b"^" + word + b"$"
    own = [xxhash.xxh32_intdigest(marked) >> (32 - BITS)]
    return own + [xxhash.xxh32_intdigest(marked[i : i + GRAM], 1) >> (32 - BITS) for i in range(len(marked) - GRAM + 1)]


def features(rows: DataFrame) -> DataFrame:
    """``kind, features``: the distinct hashed features of each training row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [sorted({f for w in set(words(t.as_py())) for f in word_features(w)}) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["kind", "features"])

    return rows.select("text", "kind").mapInArrow(run, "kind int, features array<int>")


def select(found: DataFrame) -> tuple[np.ndarray, int, int]:
    """The chosen features, best first, and the numbers of positives and unlabelled rows."""
    n = {r.kind: r.n for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = n.get(1, 0), n.get(0, 0)
    if not n_p or not n_u:
        return np.empty(0, np.int64), n_p, n_u
    df = found.select("kind", F.explode("features").alias("f")).groupBy("f").agg(F.sum("kind").alias("p"), F.sum(1 - F.col("kind")).alias("u"))
    lift = F.log((F.col("p") + 0.5) / (n_p + 1)) - F.log((F.col("u") + 0.5) / (n_u + 1))
    best = df.where(F.col("p") >= max(MIN_DF, MIN_SHARE * n_p)).withColumn("lift", lift).where(F.col("lift") > float(np.log(2)))
    top = best.orderBy((F.col("p") * F.col("lift")).desc(), "f").limit(FEATURES).select("f").collect()
    return np.array([r.f for r in top], np.int64), n_p, n_u


def design(found: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The training rows in coordinates: (row, column) of each chosen feature that occurs, and the kind of each row."""
    order = np.argsort(chosen)
    ranked = chosen[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f in batch.column(1):
                f = f.values.to_numpy()
                at = np.searchsorted(ranked, f)
                out.append(order[at[ranked[np.minimum(at, len(ranked) - 1)] == f]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["kind", "columns"])

    got = found.mapInArrow(run, "kind int, columns array<int>").toArrow()
    lists = got.column(1).combine_chunks()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy(), got.column(0).to_numpy()


def train(rows: np.ndarray, cols: np.ndarray, kind: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights by column, and the bias."""
    bias = float(np.log(prior / (1 - prior)))
    is_p = kind == 1
    n_p, n_u, n = is_p.sum(), (~is_p).sum(), len(kind)
    w, b = np.zeros(size), bias
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    for step in range(1, EPOCHS + 1):
        z = np.bincount(rows, w[cols], n) + b
        s = sigmoid(z)  # the logistic loss of class 0 has the slope s, that of class 1 s - 1
        loss_neg = np.logaddexp(0, z)
        bracket = loss_neg[~is_p].mean() - prior * loss_neg[is_p].mean()
        slope = np.zeros(n)
        if bracket >= 0:
            slope[is_p] = prior * (s[is_p] - 1) / n_p - prior * s[is_p] / n_p
            slope[~is_p] = s[~is_p] / n_u
        else:  # ascend on the bracket alone
            slope[is_p] = prior * s[is_p] / n_p
            slope[~is_p] = -s[~is_p] / n_u
        g = np.r_[np.bincount(cols, slope[rows], size) + DECAY * w, slope.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(0, w - move[:-1]), b - move[-1]  # a word is evidence for the class, or none
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float]:
    """Hashed feature to weight, and the bias."""
    rows, prior = training_rows(docs, labels)
    found = materialize(features(rows), "toxicity")
    chosen, n_p, n_u = select(found)
    if not len(chosen):
        discard(found)
        return {}, float(np.log(prior / (1 - prior)))
    w, bias = train(*design(found, chosen), len(chosen), prior)
    discard(found)
    return {f: x for f, x in zip(chosen.tolist(), w.tolist()) if x > 0}, bias


class Scores(dict):
    """Word to its weighted features; a memo of bounded size."""

    MOST = 400_000

    def __init__(self, weights: dict[int, float], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        own = self[word] = tuple([f for f in word_features(word) if f in self.weights])
        return own

    def of(self, text: str | None) -> float:
        if len(self) > self.MOST:
            self.clear()
        present = set(chain.from_iterable(map(self.__getitem__, set(words(text)))))
        return self.bias + sum(map(self.weights.__getitem__, sorted(present)))


def score(docs: DataFrame, model: tuple[dict[int, float], float], carry: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, score`` for every row; ``carry`` names further columns as alias: name."""
    weights, bias = model
    rows = pick(docs, doc_id="doc_id", text="text", **(carry or {}))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text" or carry] + ["score double"])
    drop = not carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Scores(weights, bias).of
        for batch in batches:
            z = np.array([of(t.as_py()) for t in batch.column(1)], float)
            out = pa.array(0.5 * (1 + np.tanh(z / 2)))
            kept = [c for i, c in enumerate(batch.columns) if i != 1 or not drop]
            yield pa.RecordBatch.from_arrays([*kept, out], names=[n for i, n in enumerate(batch.schema.names) if i != 1 or not drop] + ["score"])

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
