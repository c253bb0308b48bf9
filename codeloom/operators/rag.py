"""Chunks, embedding upkeep and vector search (V1-V13, S25). V1 is :func:`codeloom.operators.upserts.chunk_rules`.

``target`` is "code" or "memory". An embedder is anything with ``name``, ``dimensions`` and ``embed(list[str]) -> array``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..graph import Graph, cut
from .deletes import delete_stale_memory_chunks
from .merge import first_rows, merge
from .upserts import memory_chunks

TABLE = {"code": "code_chunk", "memory": "memory_chunk"}
MIN_CAPACITY, HEADROOM, METRIC, SCALAR = 8192, 2, "cos", "f16"


class Embedder(Protocol):
    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Words hashed to signed dimensions, normalised. A stand-in for tests: it knows spelling, not meaning."""

    def __init__(self, dimensions: int = 64):
        self.name, self.dimensions = f"hash-{dimensions}", dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                out[i, int.from_bytes(h[:4], "little") % self.dimensions] += 1 if h[4] & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def is_stale(model: str, dimensions: int) -> Column:
    """V2: has text, and is dirty or has no embedding of this model and size."""
    return F.col("text").isNotNull() & (
        F.coalesce(F.col("embedding_dirty"), F.lit(False)) | F.col("embedding").isNull() | F.coalesce(F.col("embedding_model") != model, F.lit(True)) | F.coalesce(F.col("embedding_dimensions") != dimensions, F.lit(True))
    )


def mark_stale(chunks: DataFrame, model: str, dimensions: int) -> DataFrame:
    return chunks.withColumn("embedding_dirty", F.when(is_stale(model, dimensions), True).otherwise(F.col("embedding_dirty")))


def is_obsolete(model: str, dimensions: int) -> Column:
    """V4: an embedding without or with another model or size, or such a stamp without an embedding."""
    m, d = F.col("embedding_model"), F.col("embedding_dimensions")
    other_m, other_d = F.coalesce(m != model, F.lit(False)), F.coalesce(d != dimensions, F.lit(False))
    return (F.col("embedding").isNotNull() & (m.isNull() | d.isNull())) | other_m | other_d


def clear_obsolete(chunks: DataFrame, model: str, dimensions: int) -> DataFrame:
    gone = is_obsolete(model, dimensions)
    chunks = chunks.withColumn("_gone", gone)
    for c in ("embedding", "embedding_model", "embedding_dimensions"):
        chunks = chunks.withColumn(c, F.when(~F.col("_gone"), F.col(c)))
    return chunks.withColumn("embedding_dirty", F.when(F.col("_gone"), True).otherwise(F.col("embedding_dirty"))).drop("_gone")


def counts(chunks: DataFrame, model: str, dimensions: int) -> DataFrame:
    """V3 and the counting half of V2 and V4: ``chunks, dirty, stale, obsolete``."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(n(F.col("embedding_dirty")), F.lit(0)).alias("dirty"), F.coalesce(n(is_stale(model, dimensions)), F.lit(0)).alias("stale"), F.coalesce(n(is_obsolete(model, dimensions)), F.lit(0)).alias("obsolete"))


def refresh_dirty(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """V5, V6: embeds every dirty chunk that has text, a batch of Arrow rows at a time, and stamps it; other rows pass."""
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [t or "" for t in batch.column(names.index("text")).to_pylist()]
            vectors = embedder.embed(own).astype(np.float32)
            columns = dict(zip(names, batch.columns))
            columns["embedding"] = pa.array(list(vectors), pa.list_(pa.float32()))
            columns["embedding_model"] = pa.array([embedder.name] * len(own), pa.string())
            columns["embedding_dimensions"] = pa.array([embedder.dimensions] * len(own), pa.int32())
            columns["embedding_dirty"] = pa.array([False] * len(own), pa.bool_())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    todo = F.coalesce(F.col("embedding_dirty"), F.lit(False)) & F.col("text").isNotNull()
    return chunks.where(~todo).unionByName(chunks.where(todo).mapInArrow(run, chunks.schema))


def failure_details(chunks: DataFrame) -> DataFrame:
    """V7: where a chunk came from, and how its text begins."""
    place = [c for c in ("path", "start_line", "end_line") if c in chunks.columns]
    return chunks.select("id", "source_label", "source_id", *place, F.length("text").alias("text_length"), tx.preview(F.col("text")).alias("text_preview"))


def project_token(project: str) -> str:
    """The project's part of index names: a slug of at most 48 characters and 12 digits of its hash."""
    slug = "".join(c if c.isalnum() and c.isascii() else "_" for c in project.lower()).strip("_")[:48]
    return f"p_{slug}_{hashlib.sha256(project.encode()).hexdigest()[:12]}"


def index_info(g: Graph, project: str, target: str, embedder: Embedder) -> DataFrame:
    """V8, V9: the index that a search needs: its names, size and metric. Search itself is exact, so this is a description."""
    token = project_token(project)
    n = getattr(g, TABLE[target]).agg(F.count("*").alias("n"))
    return n.select(
        F.lit(target).alias("target"), F.lit(f"{target}_chunk_{token}").alias("index_name"), F.lit(f"{target.title()}Chunk_{token}").alias("index_label"),
        F.lit(embedder.dimensions).alias("dimensions"), F.greatest(F.lit(MIN_CAPACITY), F.col("n") * HEADROOM).cast("long").alias("capacity"), F.lit(METRIC).alias("metric"), F.lit(SCALAR).alias("scalar_kind"),
    )


def refresh(g: Graph, project: str, target: str, embedder: Embedder, dirty_only: bool = False) -> Graph:
    """With ``dirty_only`` and a current state only dirty chunks are embedded; otherwise obsolete ones are cleared and stale ones marked first."""
    name = TABLE[target]
    chunks = getattr(g, name)
    state = g.embedding_state.where((F.col("target") == target) & (F.col("model") == embedder.name) & (F.col("dimensions") == embedder.dimensions))
    if not dirty_only or state.isEmpty():
        chunks = mark_stale(clear_obsolete(chunks, embedder.name, embedder.dimensions), embedder.name, embedder.dimensions)
    chunks = cut(refresh_dirty(chunks, embedder), name)
    new = index_info(g, project, target, embedder).select("target", F.lit(embedder.name).alias("model"), "dimensions", "index_name", "index_label", "metric", "scalar_kind")
    rest = [c for c in new.columns if c != "target"]
    return g.replace(**{name: chunks}, embedding_state=merge(g.embedding_state, new, ["target"], rest))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, in doubles; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def search(chunks: DataFrame, query: list[float], k: int, before: Column | None = None, after: Column | None = None, min_score: float | None = None, places: int | None = None) -> DataFrame:
    """The k most similar rows with ``score``, best first, ties by id. ``before`` filters candidates, ``after`` what was found.

    With ``places`` scores are rounded before they are compared, so that what is equal as shown is a tie. The query vector is a literal, so this is one scan that keeps k rows in each task.
    """
    rows = chunks.where(F.col("embedding").isNotNull())
    rows = rows if before is None else rows.where(before)
    vector = F.lit([float(x) for x in query]).cast("array<double>")
    score = cosine(F.col("embedding"), vector)
    found = rows.withColumn("score", score if places is None else F.round(score, places)).where("score is not null").orderBy(F.col("score").desc(), "id").limit(k)
    found = found if after is None else found.where(after)
    found = found if min_score is None else found.where(F.col("score") >= min_score)
    return found.orderBy(F.col("score").desc(), "id")


def search_all(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best chunks (``id, embedding``) for every row of ``queries`` (``query_id, query``), as ``query_id, rank, id, score``.

    Scores that are equal to 12 places are ties, by id; vectors without a length are never found and find nothing. Queries go in blocks to all rows; each block keeps k rows a query and partition before the shuffle.
    """
    block, n = 256, k
    out = None
    held: list = []

    def flush(qs):
        ids, q = [r.query_id for r in qs], np.array([r.query for r in qs], np.float64)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)

        def run(batches):
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                if not batch.num_rows:
                    continue
                m = np.array(batch.column(1).to_pylist(), np.float64)
                size = np.linalg.norm(m, axis=1)
                own = np.flatnonzero(size > 0)
                if not len(own):
                    continue
                keys = [batch.column(0)[int(j)].as_py() for j in own]
                s = np.round(q @ (m[own] / size[own, None]).T, 12)
                for i, row in enumerate(s):
                    top = np.argsort(-row, kind="stable")[: n + 64]
                    best[i] = sorted(best[i] + [(-float(row[j]), keys[j]) for j in np.flatnonzero(row >= row[top[-1]])])[:n]
            rows = [(ids[i], key, -score) for i, b in enumerate(best) for score, key in b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["query_id", "id", "score"])

        kind = dict(chunks.dtypes)["id"]
        return chunks.where("embedding is not null").select("id", "embedding").mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, score double")

    for row in queries.where("query is not null and exists(query, x -> x <> 0)").select("query_id", "query").toLocalIterator():
        held.append(row)
        if len(held) == block:
            part = flush(held)
            out = part if out is None else out.union(part)
            held = []
    if held or out is None:
        part = flush(held) if held else chunks.limit(0).selectExpr("cast(null as long) query_id", "id", "cast(null as double) score")
        out = part if out is None else out.union(part)
    return first_rows(out, ["query_id"], [F.col("score").desc(), "id"], k).select("query_id", F.col("_rank").alias("rank"), "id", "score")


def code_chunks(g: Graph, texts: DataFrame) -> DataFrame:
    """The chunks of files (``path, text``): one for the file, one for each type and member it defines.

    A text is split once for its file, and its lines meet what the file defines in one join; the excerpts are cut from the lines.
    """
    files = texts.join(g.file.select("path", "language"), "path").select("path", "language", F.split("text", "\n", -1).alias("lines"))
    own_types = g.defines.where(F.col("label").isin(*schema.TYPE_LABELS)).join(g.type_node.select("label", F.col("fqn").alias("key"), "name", "kind"), ["label", "key"])
    own_methods = g.defines.where("label = 'Method'").join(g.method.select(F.col("signature").alias("key"), "name", "owner_fqn", "kind", "start_line", "end_line", "is_synthetic"), "key")
    own_fields = g.defines.where("label = 'Field'").join(g.field.select(F.col("fqn").alias("key"), "name", "kind"), "key")
    plain = own_methods.where("kind in ('method', 'function')")
    typed = own_types.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", "name", "kind"))), lambda t: F.struct(t["name"].alias("name"), t["kind"].alias("kind"))).alias("types"))
    named = plain.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "key", "name"))), lambda t: t["name"]).alias("methods"))
    none_t, none_m = F.array().cast("array<struct<name:string,kind:string>>"), F.array().cast("array<string>")
    no = F.lit("")
    file_rows = files.join(typed, "path", "left").join(named, "path", "left").select(
        F.lit("File").alias("source_label"), F.col("path").alias("source_id"), "language", "path", no.alias("owner_fqn"), no.alias("signature"),
        F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("file").alias("kind"), F.lit("file").alias("rag_role"), F.lit(1).alias("start_line"),
        F.size("lines").alias("end_line"), F.lit(False).alias("is_synthetic"), tx.summary(F.coalesce("types", none_t), F.coalesce("methods", none_m)).alias("defines"), "lines",
    )
    role = F.when(F.col("is_synthetic"), "synthetic").otherwise("primary")
    members = own_types.select(
        "path", F.col("label").alias("source_label"), F.col("key").alias("source_id"), F.col("key").alias("owner_fqn"), no.alias("signature"), "name", "kind",
        F.lit("primary").alias("rag_role"), F.lit(1).alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(False).alias("is_synthetic"),
    ).unionByName(own_methods.select(
        "path", F.lit("Method").alias("source_label"), F.col("key").alias("source_id"), "owner_fqn", F.col("key").alias("signature"), "name", "kind",
        role.alias("rag_role"), F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce("end_line", F.lit(0)).alias("end_line"), F.coalesce("is_synthetic", F.lit(False)).alias("is_synthetic"),
    )).unionByName(own_fields.select(
        "path", F.lit("Field").alias("source_label"), F.col("key").alias("source_id"), F.regexp_replace("key", "[#.][^#.]*$", "").alias("owner_fqn"), no.alias("signature"), "name", "kind",
        F.lit("secondary").alias("rag_role"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.lit(False).alias("is_synthetic"),
    ))
    member_rows = members.join(files, "path").withColumn("end_line", F.coalesce("end_line", F.size("lines"))).withColumn("defines", no)  # a type's chunk ends with the file
    rows = tx.with_excerpt(file_rows.unionByName(member_rows), "_body").drop("lines")
    text = tx.chunk_text(F.col("source_id"), F.col("owner_fqn"), F.col("name"), F.col("kind"), F.col("defines"), F.col("_body"))
    out = rows.withColumn("text", text).withColumn("id", tx.chunk_id(F.col("source_label"), F.col("source_id"))).drop("_body", "defines")
    return out.withColumn("text_hash", F.sha2("text", 256))


def memory_sources(g: Graph) -> DataFrame:
    """The items of the memory root with their chunk and references."""
    items = g.memory_item.join(g.has_item.select("label", "id").distinct(), ["label", "id"], "left_semi")
    chunk = g.has_rag_chunk.join(g.memory_chunk.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").groupBy(F.col("source_label").alias("label"), F.col("source_key").alias("id")).agg(F.min("chunk_id").alias("existing_chunk_id"))
    refs = g.refers_to.groupBy("label", "id").agg(F.array_sort(F.collect_set(F.concat("target_type", F.lit(" "), "key"))).alias("code_refs"))
    return items.join(chunk, ["label", "id"], "left").join(refs, ["label", "id"], "left")


def memory_chunk_rows(sources: DataFrame) -> DataFrame:
    """The chunk of each memory source."""
    strip = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    head = F.concat("label", F.lit(": "), F.when(strip("title") != "", strip("title")).otherwise(F.col("id")), F.lit("\n"), tx.field("ID", F.col("id")))
    parts = [tx.field(c.title(), strip(c)) for c in schema.MEMORY_FIELDS if c != "title"]
    refs = F.array_join(F.array_sort(F.filter(F.coalesce("code_refs", F.array().cast("array<string>")), lambda r: F.trim(r) != "")), ", ")
    text = F.regexp_replace(F.concat(head, *parts, tx.field("CodeRefs", refs)), r"^\s+|\s+$", "")
    rows = sources.select(tx.memory_chunk_id(F.col("existing_chunk_id"), F.col("label"), F.col("id")).alias("id"), F.col("label").alias("source_label"), F.col("id").alias("source_id"), text.alias("text"))
    return rows.withColumn("text_hash", F.sha2("text", 256))


def refresh_memory_chunks(g: Graph) -> Graph:
    """Chunks of all memory items made anew, and stale ones dropped."""
    return delete_stale_memory_chunks(memory_chunks(g, memory_chunk_rows(memory_sources(g))))
