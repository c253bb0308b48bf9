"""Node upserts (U1-U14). Each takes a graph and a batch of rows and returns the graph with the rows merged in.

Rows whose anchor (file, package or owner) isn't in the graph are dropped, as a join with the anchors demands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph
from .merge import add_edges, merge, one_row, within, without

_TYPE = ("name", "package_name", "is_abstract", "visibility", "is_enum", "is_record", "is_final", "is_external", "language", "kind", "module_path", "framework")
_NO_FLAGS = {"Class": (), "Interface": ("is_enum", "is_record"), "Annotation": ("is_abstract", "is_enum", "is_record", "is_final")}
_METHOD = ("name", "return_type", "is_static", "visibility", "start_line", "end_line", "owner_fqn", "owner_display_name", "language", "kind", "is_synthetic")
_FIELD = ("name", "type", "is_static", "visibility", "language", "kind")


def project_root(g: Graph, project: str) -> Graph:
    """The edge from the project to its memory root; the nodes themselves are implied by the store's folder."""
    row = g.spark.createDataFrame([("Project", project, "Memory", project)], schema.struct("contains"))
    return g.replace(contains=add_edges(g.contains, row))


def project(g: Graph, rows: DataFrame, now: int) -> Graph:
    """``language, language_name, source_root``. The root is appended where it is absent; last_ingested becomes ``now``."""
    new = rows.groupBy("language").agg(F.max("language_name").alias("language_name"), F.array_sort(F.collect_set("source_root")).alias("source_roots"))
    old_roots = F.coalesce(F.col("o_source_roots"), F.array().cast("array<string>"))
    roots = F.when(F.col("in_batch"), F.array_union(old_roots, F.col("n_source_roots"))).otherwise(F.col("o_source_roots"))
    code = merge(g.code, new, ["language"], ["language_name"], rules={"source_roots": roots, "last_ingested": F.when(F.col("in_batch"), F.lit(now)).otherwise(F.col("o_last_ingested"))})
    language = merge(g.language, new.select(F.col("language_name").alias("name"), F.col("language").alias("graph_name")), ["name"], ["graph_name"])
    return g.replace(code=code, language=language)


def files(g: Graph, rows: DataFrame) -> Graph:
    """File rows; the retained token is set only where it isn't empty; the file leaves the Code of any other language."""
    rows = within(rows, g.code, language="language")
    token = F.when(F.coalesce(F.col("n_retained_source_token"), F.lit("")) != "", F.col("n_retained_source_token")).otherwise(F.col("o_retained_source_token"))
    new = one_row(rows, ["path"])
    table = merge(g.file, new, ["path"], ["last_modified", "language", "analysis_cache_key"], rules={"retained_source_token": token})
    link = new.select(F.lit("Code").alias("src_label"), F.col("language").alias("src_key"), F.lit("File").alias("dst_label"), F.col("path").alias("dst_key"))
    moved = g.contains.where("src_label = 'Code' and dst_label = 'File'").join(new.select(F.col("path").alias("dst_key"), F.col("language").alias("_l")), "dst_key").where("src_key <> _l")
    kept = without(g.contains, moved, src_label="src_label", src_key="src_key", dst_label="dst_label", dst_key="dst_key")
    return g.replace(file=table, contains=add_edges(kept, link))


def packages(g: Graph, rows: DataFrame) -> Graph:
    """U4: ``name, language``; needs the Code of the language."""
    rows = within(rows.select("name", "language").distinct(), g.code, language="language")
    link = rows.select(F.lit("Code").alias("src_label"), F.col("language").alias("src_key"), F.lit("Package").alias("dst_label"), F.col("name").alias("dst_key"))
    return g.replace(package=add_edges(g.package, rows), contains=add_edges(g.contains, link))


def types(g: Graph, rows: DataFrame, label: str) -> Graph:
    """Classes, interfaces or annotations; needs the package and the file."""
    rows = within(within(rows, g.package, package_name="name", language="language"), g.file, path="path")
    rows = rows.withColumn("label", F.lit(label)).withColumn("is_external", F.lit(False))
    overwrite = [c for c in _TYPE if c not in _NO_FLAGS[label]]
    table = merge(g.type_node, schema_with(rows, "type_node", "path"), ["label", "fqn"], overwrite)
    contains = rows.select(F.lit("Package").alias("src_label"), F.col("package_name").alias("src_key"), F.lit(label).alias("dst_label"), F.col("fqn").alias("dst_key"))
    defines = rows.select("path", "label", F.col("fqn").alias("key"))
    return g.replace(type_node=table, contains=add_edges(g.contains, contains), defines=add_edges(g.defines, defines))


def schema_with(rows: DataFrame, table: str, *extra: str) -> DataFrame:
    """The rows in the table's columns, and the order of the batch."""
    keep = [c for c in rows.columns if c in schema.columns(table) or c == "ordinal"]
    return rows.select(*keep)


def _owners(g: Graph, rows: DataFrame, label: str | None, first_only: bool) -> DataFrame:
    """The rows with ``owner_label``: of one label, or of any (of several, only the first by label rank if ``first_only``)."""
    rank = F.when(F.col("label") == "Class", 0).when(F.col("label") == "Interface", 1).otherwise(2)
    types_ = g.type_node if label is None else g.type_node.where(F.col("label") == label)
    if first_only:
        owner = types_.groupBy("fqn").agg(F.min_by("label", rank).alias("owner_label"))
    else:
        owner = types_.select("fqn", F.col("label").alias("owner_label"))
    return rows.join(owner.withColumnRenamed("fqn", "_owner"), F.col("owner") == F.col("_owner")).drop("_owner")


def methods(g: Graph, rows: DataFrame, label: str | None = None) -> Graph:
    """U8: ``path, owner, signature ...``. With a label the owner is a node of that label (U8a-c); without, one node of any (U8d)."""
    rows = _owners(g, within(rows, g.file, path="path"), label, first_only=True)
    rows = rows.withColumn("owner_fqn", F.col("owner"))
    table = merge(g.method, schema_with(rows, "method"), ["signature"], [c for c in _METHOD if c in rows.columns])
    return g.replace(method=table, **_member_edges(g, rows, "Method", "signature"))


def fields(g: Graph, rows: DataFrame, label: str | None = None) -> Graph:
    """``path, owner, fqn ...``. Without a label every node of the owner's name declares the field (U9d)."""
    rows = _owners(g, within(rows, g.file, path="path"), label, first_only=False)
    table = merge(g.field, schema_with(rows, "field"), ["fqn"], [c for c in _FIELD if c in rows.columns])
    return g.replace(field=table, **_member_edges(g, rows, "Field", "fqn"))


def _member_edges(g: Graph, rows: DataFrame, label: str, key: str) -> dict[str, DataFrame]:
    declares = rows.select("owner_label", F.col("owner").alias("owner_fqn"), F.lit(label).alias("member_label"), F.col(key).alias("member_key"))
    defines = rows.select("path", F.lit(label).alias("label"), F.col(key).alias("key"))
    return {"declares": add_edges(g.declares, declares), "defines": add_edges(g.defines, defines)}


def chunk_rules() -> dict:
    """V1: a new or changed hash clears the embedding and makes the chunk dirty; an unchanged one without embedding is dirty."""
    touched = F.col("in_batch")
    changed = touched & (F.col("o_text_hash").isNull() | ~F.col("o_text_hash").eqNullSafe(F.col("n_text_hash")))
    keep = lambda c: F.when(changed, F.lit(None)).otherwise(F.col(f"o_{c}"))
    dirty = F.when(changed | (touched & F.col("o_embedding").isNull()), True).when(touched & ~F.coalesce(F.col("o_embedding_dirty"), F.lit(False)), False).otherwise(F.col("o_embedding_dirty"))
    return {"embedding": keep("embedding"), "embedding_model": keep("embedding_model"), "embedding_dimensions": keep("embedding_dimensions"), "embedding_dirty": dirty}


def code_chunks(g: Graph, rows: DataFrame) -> Graph:
    """U10."""
    columns = [c for c in schema.columns("code_chunk") if c != "id" and not c.startswith("embedding")]
    return g.replace(code_chunk=merge(g.code_chunk, schema_with(rows, "code_chunk"), ["id"], columns, rules=chunk_rules()))


def memory_chunks(g: Graph, rows: DataFrame) -> Graph:
    """Upserts, and links each chunk to its source only."""
    table = merge(g.memory_chunk, schema_with(rows, "memory_chunk"), ["id"], ["source_label", "source_id", "text", "text_hash"], rules=chunk_rules())
    links = one_row(rows, ["id"]).join(g.memory_item.select(F.col("label").alias("source_label"), F.col("id").alias("source_id")), ["source_label", "source_id"], "left_semi")
    links = links.select("source_label", F.col("source_id").alias("source_key"), F.col("id").alias("chunk_id"))
    return g.replace(memory_chunk=table, has_rag_chunk=add_edges(without(g.has_rag_chunk, rows, chunk_id="id"), links))


def backfill_owners(g: Graph) -> Graph:
    """Methods without owner columns get them from the type that declares them."""
    owner = g.declares.where("member_label = 'Method'").join(g.type_node.select(F.col("label").alias("owner_label"), F.col("fqn").alias("owner_fqn"), F.col("name").alias("_name")), ["owner_label", "owner_fqn"])
    owner = owner.groupBy(F.col("member_key").alias("signature")).agg(F.min(F.struct(F.col("owner_fqn").alias("f"), F.col("_name").alias("n"))).alias("_o"))
    both = g.method.join(owner, "signature", "left")
    both = both.withColumn("owner_fqn", F.coalesce("owner_fqn", "_o.f")).withColumn("owner_display_name", F.coalesce("owner_display_name", "_o.n"))
    return g.replace(method=both.select(*g.method.columns))


def retain(g: Graph, paths: DataFrame) -> DataFrame:
    """The files that a run keeps, as a frame to semi-join with; nothing is stored."""
    return within(g.file, paths, path="path").select("path")


def members(g: Graph, rows: DataFrame) -> DataFrame:
    """Rows with ``owner, owner_kind`` and the node they belong to, by one join on (label, fqn) in place of a dispatch."""
    label = F.when(F.col("owner_kind").isin("interface", "type"), "Interface").when(F.col("owner_kind") == "annotation", "Annotation").otherwise("Class")
    types_ = g.type_node.select(F.col("label").alias("owner_label"), F.col("fqn").alias("owner"))
    return rows.withColumn("owner_label", label).join(types_, ["owner_label", "owner"])
