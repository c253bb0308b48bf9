"""Queries of the forms of an operator that :mod:`queries` and :mod:`change_queries` hold only one of."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph, Store, shared_dir
from ..operators import deletes, edges, upserts
from .change_queries import _sizes
from .projection import Tables
from .queries import _BATCH, _E45, _E45_NODES, _FIELD_COLUMNS, _FIELDS_SQL, _METHOD_COLUMNS, _STORED, _batch, _e45, _fields, _stored, add, dump, dump_sql, merge_sql

# ---- members of annotations and interfaces


def _annotation_methods(g: Graph, t: Tables) -> DataFrame:
    """The classes whose number ends in 4 are annotations of the same name too, and declare as such."""
    twin = g.type_node.where("label = 'Class' and fqn like '%4'").withColumn("label", F.lit("Annotation"))
    rows = _batch(g.method, "signature").withColumn("owner", F.regexp_extract("signature", r"^[a-z]+\.[0-9]+", 0)).drop("owner_fqn").crossJoin(g.file.agg(F.min("path").alias("path")))
    base = g.replace(type_node=g.type_node.unionByName(twin), method=_stored(g.method, "signature"), declares=g.declares.where("false"), defines=g.defines.where("false"))
    out = upserts.methods(base, rows, "Annotation")
    return dump(method=(out.method, ["signature"], [c for c in _METHOD_COLUMNS if c != "signature"]), declares=(out.declares, ["owner_label", "owner_fqn", "member_key"], []))


_OWNER = r"regexp_extract(signature, '^[a-z]+\.[0-9]+')"
_CHANGED = {"visibility": "'second'", "owner_fqn": _OWNER}
add("u8c_upsert_annotation_methods", _annotation_methods, dump_sql(method=("me", ["signature"], _METHOD_COLUMNS[1:]), declares=("ba", ["'Annotation'", "owner_fqn", "signature"], [])),
    f"st AS (SELECT * FROM method WHERE {_STORED('signature')}), ba AS (SELECT {', '.join(f'{_CHANGED.get(c, c)} AS {c}' for c in _METHOD_COLUMNS)} FROM method WHERE {_BATCH('signature')} AND {_OWNER} LIKE 'supplier%4'), me AS ({merge_sql('st', 'ba', _METHOD_COLUMNS, ['signature'], _METHOD_COLUMNS[1:])})")
add("u9b_upsert_interface_fields", _fields("Interface"), dump_sql(field=("me", ["fqn"], _FIELD_COLUMNS[1:]), declares=("(SELECT 'Interface' AS l, o, fqn FROM de)", ["l", "o", "fqn"], [])),
    _FIELDS_SQL.format("").replace(_BATCH("name"), f"{_BATCH('name')} AND split_part(fqn, '#', 1) LIKE '%4'"))

# ---- annotations of types

for _label in ("Class", "Interface"):
    add(f"e4_{_label.lower()}_annotated_with", _e45(_label), dump_sql(node=(_E45_NODES, ["fqn"], ["is_external"]), edge=(f"(SELECT DISTINCT label, owner, a FROM rows_ JOIN own ON owner = fqn WHERE label = '{_label}')", ["label", "owner", "a"], [])), _E45)


def _annotated_annotations(g: Graph, t: Tables) -> DataFrame:
    rows = g.type_node.select(F.col("fqn").alias("owner"), F.lit("anno.meta").alias("target"), F.lit("anno.meta").alias("target_name"), F.lit("p").alias("target_package"), F.lit("java").alias("language"))
    return edges.annotate(g.replace(annotated_with=g.annotated_with.where("false")), rows, "Annotation").annotated_with


add("e4_annotation_annotated_with", _annotated_annotations, "SELECT 'Annotation' AS owner_label, fqn AS owner_key, 'anno.meta' AS annotation FROM type_node WHERE label = 'Annotation'")

# ---- links and clean-up of chunks

_KEYS = {"File": ("file", "path"), "Class": ("type_node", "fqn"), "Interface": ("type_node", "fqn"), "Annotation": ("type_node", "fqn"), "Method": ("method", "signature"), "Field": ("field", "fqn")}


def _links(label: str):
    def run(g: Graph, t: Tables) -> DataFrame:
        table, key = _KEYS[label]
        nodes = getattr(g, table) if table != "type_node" else g.type_node.where(F.col("label") == label)
        row = nodes.agg(F.max(key).alias("source_id"))
        chunks = g.code_chunk.select("id", F.when(F.col("id").endswith("0"), "Other").otherwise(label).alias("source_label"))
        rows = chunks.crossJoin(row).withColumn("source_id", F.when(F.col("id").endswith("1"), "no such node").otherwise(F.col("source_id")))  # one row beside all chunks
        return edges.link_chunks(g, rows, label).has_rag_chunk

    return run


for _label, (_table, _key) in _KEYS.items():
    _where = f" WHERE label = '{_label}'" if _table == "type_node" else ""
    add(f"e10_link_{_label.lower()}_chunks", _links(_label), f"SELECT '{_label}' AS source_label, (SELECT max({_key}) FROM {_table}{_where}) AS source_key, id AS chunk_id FROM code_chunk WHERE id NOT LIKE '%0' AND id NOT LIKE '%1'")
add("d12_delete_chunks_of_files", lambda g, t: deletes.delete_chunks(g, g.code_chunk.where("path like '%7.md'")).code_chunk.select("id"), "SELECT id FROM code_chunk WHERE path NOT LIKE '%7.md'")
add("d12_delete_chunks_of_file", lambda g, t: deletes.delete_chunks(g, g.code_chunk.agg(F.min("path").alias("path"))).code_chunk.select("id"), "SELECT id FROM code_chunk WHERE path <> (SELECT min(path) FROM code_chunk)")

# ---- the whole store


def _wiped(g: Graph, t: Tables) -> DataFrame:
    """A stored project before and after everything is dropped."""
    store = Store(g.spark, f"{shared_dir(g.spark)}/wipe-{uuid.uuid4().hex}")
    before = _sizes(store.commit("demo", Graph(g.spark, {"package": g.package, "type_node": g.type_node})), "package", "type_node").withColumn("at", F.lit("before")).collect()
    store.drop()
    after = _sizes(store.read("demo"), "package", "type_node").withColumn("at", F.lit("after"))
    return g.spark.createDataFrame(before, after.schema).unionByName(after)


add("d22_g2_wipe_all", _wiped, "SELECT 'package' AS tbl, count(*) AS rows, 'before' AS at FROM package UNION ALL SELECT 'type_node', count(*), 'before' FROM type_node UNION ALL SELECT 'package', 0, 'after' UNION ALL SELECT 'type_node', 0, 'after'")
add("g1_schema_duplicates", lambda g, t: schema.duplicates(g.method.unionByName(g.method.where("signature like '%(R)'")), "method").select("signature", "rows"), "SELECT signature, count(*) + 1 AS rows FROM method WHERE signature LIKE '%(R)' GROUP BY 1")
