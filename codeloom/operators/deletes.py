"""Deletes and clean-up (D1-D24), all of them anti-joins of snapshots.

New definition sets come as rows ``path, label, key``. Retained files come as a frame of ``path``; None means that any file
counts as retained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph, cut
from .merge import within, without

NODE_LABELS = (*schema.TYPE_LABELS, "Method", "Field")
_NODE = ["label", "key"]


def detach(g: Graph, nodes: DataFrame) -> Graph:
    """Removes type, method and field nodes (``label, key``) and every edge at them."""
    nodes = cut(nodes.select("label", "key").distinct(), "detached")  # read once for each table below
    method, field, types = (nodes.where(F.col("label") == "Method"), nodes.where(F.col("label") == "Field"), nodes.where(F.col("label").isin(*schema.TYPE_LABELS)))
    classes, interfaces, annotations = (nodes.where(F.col("label") == l) for l in schema.TYPE_LABELS)
    calls = without(without(g.calls, method, caller="key"), method, callee="key")
    extends = without(without(g.extends, types, label="label", child="key"), types, label="label", parent="key")
    return g.replace(
        type_node=without(g.type_node, types, label="label", fqn="key"),
        method=without(g.method, method, signature="key"),
        field=without(g.field, field, fqn="key"),
        contains=without(g.contains, types, dst_label="label", dst_key="key"),
        defines=without(g.defines, nodes, label="label", key="key"),
        calls=calls,
        extends=extends,
        implements=without(without(g.implements, classes, child="key"), interfaces, parent="key"),
        declares=without(without(g.declares, types, owner_label="label", owner_fqn="key"), nodes, member_label="label", member_key="key"),
        annotated_with=without(without(g.annotated_with, nodes, owner_label="label", owner_key="key"), annotations, annotation="key"),
        resolves_to=without(g.resolves_to, nodes, target_type="label", key="key"),
        has_rag_chunk=without(g.has_rag_chunk, nodes, source_label="label", source_key="key"),
    )


def stale_definitions(g: Graph, paths: DataFrame, new: DataFrame, moved: bool = True) -> tuple[DataFrame, DataFrame]:
    """The stale ``defines`` edges of the files, and the nodes that nothing defines without them.

    An edge is stale if its node isn't in the file's new set, or is a member of a stale owner that the file also defines.
    With ``moved`` a node that is in the new set of any file of the batch stays (D2, D6); without, only files that are
    left count (D1, D5).
    """
    own = within(g.defines, paths, path="path")
    direct = without(own, new, path="path", label="label", key="key")
    owners = direct.where(F.col("label").isin(*schema.TYPE_LABELS)).select("path", F.col("label").alias("owner_label"), F.col("key").alias("owner_fqn"))
    members = owners.join(g.declares, ["owner_label", "owner_fqn"]).select("path", F.col("member_label").alias("label"), F.col("member_key").alias("key"))
    edges = cut(direct.unionByName(members.join(own, ["path", "label", "key"], "left_semi")).distinct(), "stale")
    left = without(g.defines, edges, path="path", label="label", key="key").select(*_NODE)
    if moved:
        left = left.union(new.select(*_NODE))
    return edges, edges.select(*_NODE).distinct().join(left.distinct(), _NODE, "left_anti")


def delete_stale_definitions(g: Graph, paths: DataFrame, new: DataFrame, moved: bool = True) -> Graph:
    """D1 (one file, ``moved=False``) and D2 (a batch)."""
    edges, nodes = stale_definitions(g, paths, new, moved)
    kept = g.replace(defines=without(g.defines, edges, path="path", label="label", key="key"))
    return detach(kept, nodes)


def deleted_method_names(g: Graph, paths: DataFrame, new: DataFrame, moved: bool = True) -> DataFrame:
    """``name`` of the methods that :func:`delete_stale_definitions` would delete."""
    nodes = stale_definitions(g, paths, new, moved)[1].where("label = 'Method'")
    return within(g.method, nodes, signature="key").select("name").distinct()


def unretained(g: Graph, candidates: DataFrame, retained: DataFrame | None, new: DataFrame | None = None, batch: DataFrame | None = None) -> DataFrame:
    """Candidates (``path, label, key``) that no other retained file defines.

    A file of the batch counts only for what its new set still has. The definers of a node are counted, not paired with
    each other, so a node that very many files define costs no more than its edges.
    """
    definers = g.defines if retained is None else within(g.defines, retained, path="path")
    if batch is not None and new is not None:
        definers = without(definers, batch, path="path").unionByName(within(within(definers, batch, path="path"), new, path="path", label="label", key="key"))
    count = definers.groupBy(*_NODE).agg(F.count("*").alias("_n"), F.min("path").alias("_one"))
    return candidates.join(count, _NODE, "left").where("_n is null or (_n = 1 and _one = path)").select(*candidates.columns)


def stale_relation_nodes(g: Graph, paths: DataFrame, new: DataFrame, retained: DataFrame | None = None) -> DataFrame:
    """``label, key, own``: nodes whose outgoing relations are to be made anew; ``own`` if the file defined the node before."""
    known = g.type_node.select("label", F.col("fqn").alias("key")).unionByName(g.method.select(F.lit("Method").alias("label"), F.col("signature").alias("key"))).unionByName(g.field.select(F.lit("Field").alias("label"), F.col("fqn").alias("key")))
    before = within(g.defines, paths, path="path").select("path", "label", "key", F.lit(True).alias("own"))
    named = within(new, paths, path="path").select("path", "label", "key").join(known, _NODE, "left_semi").withColumn("own", F.lit(False))
    candidates = before.unionByName(named).groupBy("path", "label", "key").agg(F.max("own").alias("own"))
    return unretained(g, candidates, retained, new, paths).groupBy(*_NODE).agg(F.max("own").alias("own"))


def delete_stale_relations(g: Graph, paths: DataFrame, new: DataFrame, retained: DataFrame | None = None) -> Graph:
    """Outgoing calls, annotations and heritage of the nodes go, incoming ones stay; pending calls go for the files' own methods."""
    nodes = cut(stale_relation_nodes(g, paths, new, retained), "relations")
    method, types = nodes.where("label = 'Method'"), nodes.where(F.col("label").isin(*schema.TYPE_LABELS))
    return g.replace(
        calls=without(g.calls, method, caller="key"),
        annotated_with=without(g.annotated_with, nodes, owner_label="label", owner_key="key"),
        extends=without(g.extends, types, label="label", child="key"),
        implements=without(g.implements, nodes.where("label = 'Class'"), child="key"),
        pending_call=without(g.pending_call, method.where("own"), caller_signature="key"),
    )


def _missing(g: Graph, paths: DataFrame, language: str | None, retained: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    files = g.file if language is None else g.file.where(F.col("language") == language)
    own = within(g.defines.where(F.col("label").isin(*labels)), within(files, paths, path="path"), path="path")
    kept = within(g.defines, retained, path="path")
    return own.select(*_NODE).distinct().join(kept.select(*_NODE).distinct(), _NODE, "left_anti")


def missing_method_names(g: Graph, paths: DataFrame, language: str | None, retained: DataFrame) -> DataFrame:
    """D7."""
    return within(g.method, _missing(g, paths, language, retained, ("Method",)), signature="key").select("name").distinct()


def delete_missing_members(g: Graph, paths: DataFrame, language: str | None, retained: DataFrame) -> Graph:
    """D8."""
    return detach(g, _missing(g, paths, language, retained, ("Method", "Field")))


def delete_missing_owners(g: Graph, paths: DataFrame, language: str | None, retained: DataFrame) -> Graph:
    """D9."""
    return detach(g, _missing(g, paths, language, retained, schema.TYPE_LABELS))


def delete_missing_pending(g: Graph, paths: DataFrame, language: str | None, retained: DataFrame) -> Graph:
    """D10."""
    return g.replace(pending_call=without(g.pending_call, _missing(g, paths, language, retained, ("Method",)), caller_signature="key"))


def delete_missing_files(g: Graph, paths: DataFrame, language: str | None = None) -> Graph:
    """D11; D13 with one path and no language."""
    gone = within(g.file if language is None else g.file.where(F.col("language") == language), paths, path="path").select("path")
    contains = g.contains.where("dst_label <> 'File'").unionByName(without(g.contains.where("dst_label = 'File'"), gone, dst_key="path"))
    chunks = g.has_rag_chunk.where("source_label <> 'File'").unionByName(without(g.has_rag_chunk.where("source_label = 'File'"), gone, source_key="path"))
    return g.replace(file=without(g.file, gone, path="path"), defines=without(g.defines, gone, path="path"), contains=contains, has_rag_chunk=chunks)


def delete_chunks(g: Graph, paths: DataFrame, except_ids: DataFrame | None = None) -> Graph:
    """The chunks of files, but for some ids."""
    gone = within(g.code_chunk, paths, path="path").select("id")
    gone = gone if except_ids is None else without(gone, except_ids, id="id")
    return g.replace(code_chunk=without(g.code_chunk, gone, id="id"), has_rag_chunk=without(g.has_rag_chunk, gone, chunk_id="id"))


def delete_empty_packages(g: Graph) -> Graph:
    """D14."""
    full = g.contains.where("src_label = 'Package'")
    gone = without(g.package, full, name="src_key").select("name")
    contains = g.contains.where("dst_label <> 'Package'").unionByName(without(g.contains.where("dst_label = 'Package'"), gone, dst_key="name"))
    return g.replace(package=within(g.package, full, name="src_key"), contains=contains)


def delete_phantom_methods(g: Graph) -> Graph:
    """Methods without a line, and the calls to them."""
    return detach(g, g.method.where("start_line is null").select(F.lit("Method").alias("label"), F.col("signature").alias("key")))


def delete_pending_for_files(g: Graph, paths: DataFrame, retained: DataFrame | None = None) -> Graph:
    """Unless another retained file defines the caller."""
    own = within(g.defines.where("label = 'Method'"), paths, path="path")
    return g.replace(pending_call=without(g.pending_call, unretained(g, own, retained), caller_signature="key"))


def delete_legacy_links(g: Graph) -> Graph:
    """A file's edge from the Code of another language or of none."""
    links = g.contains.where("src_label = 'Code' and dst_label = 'File'")
    bad = links.join(g.file.select(F.col("path").alias("dst_key"), F.col("language").alias("_l")), "dst_key").where("src_key is null or src_key <> _l")
    keep = links.join(bad.select("src_key", "dst_key").distinct().withColumnRenamed("src_key", "_s").withColumnRenamed("dst_key", "_d"), F.expr("src_key <=> _s and dst_key = _d"), "left_anti")
    return g.replace(contains=g.contains.where("not (src_label = 'Code' and dst_label = 'File')").unionByName(keep))


def stale_module_owners(g: Graph, path: str, module: str, language: str) -> DataFrame:
    """Types of a file that are neither its module nor within it."""
    own = g.type_node.where((F.col("language") == language) | F.col("language").isNull()).where((F.col("fqn") != module) & ~F.col("fqn").startswith(module + "."))
    return own.join(g.defines.where(F.col("path") == path).select("label", F.col("key").alias("fqn")), ["label", "fqn"], "left_semi").select("label", F.col("fqn").alias("key"))


def delete_stale_module(g: Graph, path: str, module: str, language: str) -> Graph:
    """Such owners and their members."""
    owners = stale_module_owners(g, path, module, language)
    members = g.declares.join(owners.select(F.col("label").alias("owner_label"), F.col("key").alias("owner_fqn")), ["owner_label", "owner_fqn"], "left_semi")
    return detach(g, owners.unionByName(members.select(F.col("member_label").alias("label"), F.col("member_key").alias("key"))))


_CODE = ("language", "code", "package", "file", "type_node", "method", "field", "pending_call", "code_chunk", "contains", "defines", "extends", "implements", "declares", "calls", "annotated_with", "resolves_to")
_MEMORY = ("memory_item", "memory_chunk", "code_ref", "has_item", "refers_to", "resolves_to", "memory_link")


def wipe_code(g: Graph) -> Graph:
    """D19."""
    return _wipe(g, _CODE).replace(has_rag_chunk=g.has_rag_chunk.where(F.col("source_label").isin(*schema.MEMORY_LABELS)))


def wipe_memories(g: Graph) -> Graph:
    """D20."""
    return _wipe(g, _MEMORY).replace(has_rag_chunk=g.has_rag_chunk.where(~F.col("source_label").isin(*schema.MEMORY_LABELS)))


def wipe_rag(g: Graph, code: bool = True, memory: bool = True) -> Graph:
    """Chunks only."""
    out = g
    if code:
        out = out.replace(code_chunk=schema.empty(g.spark, "code_chunk"), has_rag_chunk=out.has_rag_chunk.where(F.col("source_label").isin(*schema.MEMORY_LABELS)))
    if memory:
        out = out.replace(memory_chunk=schema.empty(g.spark, "memory_chunk"), has_rag_chunk=out.has_rag_chunk.where(~F.col("source_label").isin(*schema.MEMORY_LABELS)))
    return out


def _wipe(g: Graph, tables: tuple[str, ...]) -> Graph:
    return Graph(g.spark, {k: v for k, v in g.tables.items() if k not in tables})


def delete_stale_memory_chunks(g: Graph) -> Graph:
    """Chunks whose source is no longer an item of the memory root."""
    linked = g.has_rag_chunk.join(g.has_item.select(F.col("label").alias("source_label"), F.col("id").alias("source_key")), ["source_label", "source_key"], "left_semi")
    gone = without(g.memory_chunk, linked, id="chunk_id").select("id")
    return g.replace(memory_chunk=within(g.memory_chunk, linked, id="chunk_id"), has_rag_chunk=without(g.has_rag_chunk, gone, chunk_id="id"))


def sharing_files(g: Graph, missing: DataFrame, retained: DataFrame) -> DataFrame:
    """Retained files that define something a missing file defines too."""
    nodes = within(g.defines, missing, path="path").select(*_NODE).distinct()
    return within(g.defines, retained, path="path").join(nodes, _NODE, "left_semi").select("path").distinct()
