"""Project memory (Q22-Q28): items, their allowed fields and values, references and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph
from .merge import add_edges, merge, without
from .rag import memory_chunk_rows, memory_sources, search
from .upserts import memory_chunks

FIELDS: dict[str, tuple[str, ...]] = {
    "Decision": ("title", "topic", "status", "rationale", "consequences"),
    "ADR": ("number", "title", "status", "context", "decision", "consequences"),
    "Rule": ("title", "topic", "severity", "description"),
    "Context": ("title", "topic", "content", "source"),
    "Finding": ("title", "topic", "type", "status", "summary", "evidence"),
    "Task": ("title", "status", "priority", "description"),
    "Risk": ("title", "topic", "severity", "status", "mitigation"),
    "Question": ("title", "status", "answer"),
    "Idea": ("title", "topic", "status", "notes"),
}
VALUES: dict[tuple[str, str], tuple[str, ...]] = {
    ("Decision", "status"): ("proposed", "accepted", "rejected", "superseded"),
    ("ADR", "status"): ("draft", "proposed", "accepted", "rejected", "superseded"),
    ("Rule", "severity"): ("hard", "soft", "recommendation"),
    ("Finding", "type"): ("bug", "perf", "constraint", "security"),
    ("Finding", "status"): ("open", "resolved", "obsolete"),
    ("Task", "status"): ("todo", "doing", "done", "blocked", "cancelled"),
    ("Risk", "severity"): ("low", "medium", "high", "critical"),
    ("Risk", "status"): ("open", "mitigated", "accepted", "obsolete"),
    ("Question", "status"): ("open", "answered", "obsolete"),
    ("Idea", "status"): ("proposed", "accepted", "rejected", "obsolete"),
}
OPEN = {"Finding": ("open",), "Task": ("todo", "doing", "blocked"), "Question": ("open",), "Risk": ("open",)}


def schema_table(g: Graph) -> DataFrame:
    """``label, field, allowed``: the fields of each kind of item, and their values where these are fixed."""
    rows = [(l, f, ",".join(VALUES.get((l, f), ())) or None) for l, fs in FIELDS.items() for f in fs]
    return g.spark.createDataFrame(rows, "label string, field string, allowed string")


def violations(items: DataFrame) -> DataFrame:
    """``label, id, field, value``: fields that an item's kind doesn't have, and values that aren't allowed."""
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in schema.MEMORY_FIELDS if f in items.columns)))
    rows = items.select("label", "id", cells.alias("c")).select("label", "id", "c.field", "c.value").where("value is not null")
    bad = ~F.col("label").isin(*schema.MEMORY_LABELS)
    for label, fields in FIELDS.items():
        bad = bad | ((F.col("label") == label) & ~F.col("field").isin(*fields))
    for (label, name), values in VALUES.items():
        bad = bad | ((F.col("label") == label) & (F.col("field") == name) & ~F.col("value").isin(*values))
    return rows.where(bad)


def orientation(g: Graph) -> DataFrame:
    """Q22: rules, and findings, tasks, questions and risks that are open."""
    keep = F.col("label") == "Rule"
    for label, values in OPEN.items():
        keep = keep | ((F.col("label") == label) & F.col("status").isin(*values))
    return g.memory_item.where(keep).select("label", "id", "title", "status", "severity")


def find(g: Graph, query: list[float], k: int = 5, places: int | None = None) -> DataFrame:
    """Q23."""
    return search(g.memory_chunk, query, k, places=places).select("id", "source_label", "source_id", "score")


def get(g: Graph, label: str, id_: str) -> DataFrame:
    """Q24: the item and its references with what they resolve to."""
    item = g.memory_item.where((F.col("label") == label) & (F.col("id") == id_))
    refs = g.refers_to.join(g.resolves_to, ["target_type", "key"], "left").groupBy("label", "id").agg(F.array_sort(F.collect_set(F.struct("target_type", "key", F.col("target_key").isNotNull().alias("resolved")))).alias("code_refs"))
    return item.join(refs, ["label", "id"], "left")


def upsert(g: Graph, rows: DataFrame, check: bool = True) -> Graph:
    """Q25: items (``label, id`` and fields). Fields the batch doesn't name stay; wrong fields or values raise ``ValueError``."""
    if check and (bad := violations(rows).take(5)):
        raise ValueError(f"not allowed: {[tuple(b) for b in bad]}")
    given = [c for c in schema.MEMORY_FIELDS if c in rows.columns]
    rules = {c: F.coalesce(F.col(f"n_{c}"), F.col(f"o_{c}")) for c in given}
    edges = rows.select(F.concat(F.lit("HAS_"), F.upper("label")).alias("rel"), "label", "id")
    keep = [c for c in rows.columns if c in ("label", "id", "ordinal") or c in given]
    return g.replace(memory_item=merge(g.memory_item, rows.select(*keep), ["label", "id"], rules=rules), has_item=add_edges(g.has_item, edges))


def update_status(g: Graph, rows: DataFrame) -> Graph:
    """Q25: ``label, id, status`` of items that exist."""
    known = rows.join(g.memory_item.select("label", "id"), ["label", "id"], "left_semi").select("label", "id", "status")
    return upsert(g, known)


def delete(g: Graph, rows: DataFrame) -> Graph:
    """Q26: items (``label, id``) with their chunks, and references that nothing else makes."""
    rows = rows.select("label", "id").distinct()
    chunks = g.has_rag_chunk.join(rows.select(F.col("label").alias("source_label"), F.col("id").alias("source_key")), ["source_label", "source_key"], "left_semi")
    refers = without(g.refers_to, rows, label="label", id="id")
    touched = g.refers_to.join(rows, ["label", "id"], "left_semi").select("target_type", "key").distinct()
    orphans = touched.join(refers.select("target_type", "key").distinct(), ["target_type", "key"], "left_anti")
    return g.replace(
        memory_item=without(g.memory_item, rows, label="label", id="id"), has_item=without(g.has_item, rows, label="label", id="id"), refers_to=refers,
        code_ref=without(g.code_ref, orphans, target_type="target_type", key="key"), resolves_to=without(g.resolves_to, orphans, target_type="target_type", key="key"),
        memory_chunk=without(g.memory_chunk, chunks, id="chunk_id"), has_rag_chunk=without(g.has_rag_chunk, chunks, chunk_id="chunk_id"),
        memory_link=without(without(g.memory_link, rows, src="id"), rows, dst="id"),
    )


def link_ref(g: Graph, rows: DataFrame) -> Graph:
    """Q27: ``label, id, target_type, key``; the item must exist and the type be supported."""
    rows = rows.where(F.col("target_type").isin(*schema.REF_TYPES)).join(g.memory_item.select("label", "id"), ["label", "id"], "left_semi")
    return g.replace(code_ref=add_edges(g.code_ref, rows), refers_to=add_edges(g.refers_to, rows))


def refresh_chunks(g: Graph, rows: DataFrame | None = None) -> Graph:
    """Q28: the chunks of some items (``label, id``) or of all, from what the items are now."""
    sources = memory_sources(g)
    return memory_chunks(g, memory_chunk_rows(sources if rows is None else sources.join(rows.select("label", "id").distinct(), ["label", "id"], "left_semi")))
