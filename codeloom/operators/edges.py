"""Edge upserts (E1-E10). Phantom endpoints are made before or after the other endpoint is looked for, as each says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .merge import add_edges, merge, within, without


def _phantoms(g: Graph, rows: DataFrame, label: str, key: str) -> DataFrame:
    """Type nodes of the rows' targets: known ones keep what they have, new ones are external."""
    new = rows.select(
        F.lit(label).alias("label"), F.col(key).alias("fqn"), F.col("target_name").alias("name"), F.col("target_package").alias("package_name"),
        F.col("language"), F.lit(True).alias("is_external"), *([F.col("ordinal")] if "ordinal" in rows.columns else []),
    )
    return merge(g.type_node, new, ["label", "fqn"], reference=["name", "package_name", "language", "is_external"], last=False)


def extends(g: Graph, rows: DataFrame, label: str = "Class") -> Graph:
    """``child, target, target_name, target_package, language``. Parents are made even for a missing child."""
    edge = within(rows, g.type_node.where(F.col("label") == label), child="fqn")
    edge = edge.select(F.lit(label).alias("label"), "child", F.col("target").alias("parent"))
    return g.replace(type_node=_phantoms(g, rows, label, "target"), extends=add_edges(g.extends, edge))


def implements(g: Graph, rows: DataFrame) -> Graph:
    """The child must be a class."""
    edge = within(rows, g.type_node.where("label = 'Class'"), child="fqn").select("child", F.col("target").alias("parent"))
    return g.replace(type_node=_phantoms(g, rows, "Interface", "target"), implements=add_edges(g.implements, edge))


def _owners(g: Graph) -> DataFrame:
    return g.type_node.select(F.col("label").alias("owner_label"), F.col("fqn").alias("owner_key")).unionByName(
        g.field.select(F.lit("Field").alias("owner_label"), F.col("fqn").alias("owner_key"))
    )


def annotate(g: Graph, rows: DataFrame, label: str | None = None) -> Graph:
    """``owner, target ...``. The owner is a type or field of that label, or of any of the four."""
    owners = _owners(g)
    owners = owners if label is None else owners.where(F.col("owner_label") == label)
    edge = rows.join(owners, F.col("owner") == F.col("owner_key")).select("owner_label", "owner_key", F.col("target").alias("annotation"))
    return g.replace(type_node=_phantoms(g, rows, "Annotation", "target"), annotated_with=add_edges(g.annotated_with, edge))


def annotate_methods(g: Graph, rows: DataFrame) -> Graph:
    """``signature, target ...``."""
    edge = within(rows, g.method, signature="signature").select(F.lit("Method").alias("owner_label"), F.col("signature").alias("owner_key"), F.col("target").alias("annotation"))
    return g.replace(type_node=_phantoms(g, rows, "Annotation", "target"), annotated_with=add_edges(g.annotated_with, edge))


def calls(g: Graph, rows: DataFrame) -> Graph:
    """``caller, callee, count``. Counts of the batch are added up and replace stored ones; a missing callee is made without a line."""
    found = within(rows, g.method, caller="signature").groupBy("caller", "callee").agg(F.sum(F.coalesce("count", F.lit(1))).cast("long").alias("count"))
    table = merge(g.calls, found, ["caller", "callee"], ["count"])
    phantom = without(found.select(F.col("callee").alias("signature")).distinct(), g.method, signature="signature")
    return g.replace(calls=table, method=g.method.unionByName(phantom, allowMissingColumns=True))


def add_calls(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Counts added to stored ones: partial sums run before the one shuffle."""
    return stored.unionByName(new.select("caller", "callee", F.col("count").cast("long").alias("count"))).groupBy("caller", "callee").agg(F.sum("count").alias("count"))


def add_pending(stored: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["caller_signature", "callee_owner_fqn", "callee_name"]
    return merge(stored, new, keys, ["count", "allow_name_only"])


def declared(g: Graph) -> DataFrame:
    """``owner_fqn, name, signature``: methods by the types that declare them."""
    return g.declares.where("member_label = 'Method'").select("owner_fqn", F.col("member_key").alias("signature")).distinct().join(g.method.select("signature", "name"), "signature")


def calls_by_name(g: Graph, rows: DataFrame) -> Graph:
    """``caller_signature, callee_owner_fqn, callee_name, count``. One method of that name: its calls grow; none: a pending call; several: nothing."""
    keys = ["caller_signature", "callee_owner_fqn", "callee_name"]
    found = within(rows, g.method, caller_signature="signature").groupBy(*keys).agg(F.sum(F.coalesce("count", F.lit(1))).cast("long").alias("count"))
    known = declared(g).groupBy(F.col("owner_fqn").alias("callee_owner_fqn"), F.col("name").alias("callee_name")).agg(F.countDistinct("signature").alias("n"), F.min("signature").alias("callee"))
    found = found.join(known, ["callee_owner_fqn", "callee_name"], "left")
    sure = found.where("n = 1").select(F.col("caller_signature").alias("caller"), "callee", "count")
    open_ = found.where("n is null").select(*keys, "count", F.lit(False).alias("allow_name_only"))
    return g.replace(calls=add_calls(g.calls, sure), pending_call=add_pending(g.pending_call, open_))


def pending_calls(g: Graph, rows: DataFrame) -> Graph:
    """Counts added up, the name-only flag if any row has it; the caller must exist."""
    keys = ["caller_signature", "callee_owner_fqn", "callee_name"]
    found = within(rows, g.method, caller_signature="signature").groupBy(*keys).agg(F.sum(F.coalesce("count", F.lit(1))).cast("long").alias("count"), F.max(F.coalesce("allow_name_only", F.lit(False))).alias("allow_name_only"))
    return g.replace(pending_call=add_pending(g.pending_call, found))


def sources(g: Graph) -> DataFrame:
    """``source_label, source_key`` of every node that code chunks can describe."""
    return (
        g.file.select(F.lit("File").alias("source_label"), F.col("path").alias("source_key"))
        .unionByName(g.type_node.select(F.col("label").alias("source_label"), F.col("fqn").alias("source_key")))
        .unionByName(g.method.select(F.lit("Method").alias("source_label"), F.col("signature").alias("source_key")))
        .unionByName(g.field.select(F.lit("Field").alias("source_label"), F.col("fqn").alias("source_key")))
    )


def link_chunks(g: Graph, rows: DataFrame, label: str | None = None) -> Graph:
    """``id, source_label, source_id`` of chunks, linked to the nodes they describe (of one label, or all six)."""
    rows = rows if label is None else rows.where(F.col("source_label") == label)
    rows = within(rows, g.code_chunk, id="id").select("source_label", F.col("source_id").alias("source_key"), F.col("id").alias("chunk_id"))
    return g.replace(has_rag_chunk=add_edges(g.has_rag_chunk, rows.join(sources(g), ["source_label", "source_key"], "left_semi")))
