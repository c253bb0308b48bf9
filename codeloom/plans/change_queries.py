"""Queries of deletes, resolution, embedding upkeep, metrics and the analytic surface; see :mod:`queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text as tx
from ..graph import Graph
from ..operators import analytics, calls, deletes, hierarchy, memory, metrics, rag, refs
from ..operators.merge import within
from .projection import Tables
from .queries import _TARGETS, add, dump, dump_sql

# ---- deletes: the changed files are those whose order ends in 3; their new sets lack what ends in (R) or an even digit


def _change(g: Graph) -> tuple[DataFrame, DataFrame]:
    paths = g.file.where(r"path rlike '3[.][a-z]+$'").select("path")
    new = within(g.defines, paths, path="path").where(r"not key rlike '[(]R[)]$|[02468]$'")
    moved = g.defines.where("label = 'Method' and key like '%7(R)'").groupBy("label", "key").agg(F.lit(0).alias("z")).join(paths.agg(F.min("path").alias("path"))).select("path", "label", "key")
    return paths, new.unionByName(moved).distinct()


_CHANGE = """paths AS (SELECT path FROM file WHERE regexp_matches(path, '3[.][a-z]+$')),
new_ AS (SELECT * FROM defines WHERE path IN (SELECT path FROM paths) AND NOT regexp_matches(key, '[(]R[)]$|[02468]$') UNION SELECT (SELECT min(path) FROM paths), label, key FROM defines WHERE label = 'Method' AND key LIKE '%7(R)'),
own AS (SELECT * FROM defines WHERE path IN (SELECT path FROM paths)),
direct AS (SELECT * FROM own EXCEPT SELECT * FROM new_),
stale AS (SELECT * FROM direct UNION SELECT o.* FROM direct d JOIN declares x ON x.owner_label = d.label AND x.owner_fqn = d.key JOIN own o ON o.path = d.path AND o.label = x.member_label AND o.key = x.member_key WHERE d.label IN ('Class', 'Interface', 'Annotation')),
left_ AS (SELECT * FROM defines EXCEPT SELECT * FROM stale),
dead AS (SELECT DISTINCT label, key FROM stale s WHERE NOT EXISTS (SELECT 1 FROM left_ l WHERE l.label = s.label AND l.key = s.key){moved})"""
_MOVED = " AND NOT EXISTS (SELECT 1 FROM new_ n WHERE n.label = s.label AND n.key = s.key)"


def _left(g: Graph) -> DataFrame:
    return dump(method=(g.method, ["signature"], []), field=(g.field, ["fqn"], []), type=(g.type_node, ["label", "fqn"], []), defines=(g.defines, ["path", "label", "key"], []), calls=(g.calls, ["caller", "callee"], ["count"]), declares=(g.declares, ["owner_fqn", "member_key"], []), annotated=(g.annotated_with, ["owner_key", "annotation"], []))


def _left_sql(dead: str = "dead", defines: str = "left_") -> str:
    gone = lambda label, c: f"NOT EXISTS (SELECT 1 FROM {dead} x WHERE x.label = {label} AND x.key = {c})"
    return dump_sql(
        method=(f"method WHERE {gone(chr(39) + 'Method' + chr(39), 'signature')}", ["signature"], []), field=(f"field WHERE {gone(chr(39) + 'Field' + chr(39), 'fqn')}", ["fqn"], []),
        type=(f"type_node t WHERE {gone('t.label', 'fqn')}", ["t.label", "fqn"], []), defines=(f"{defines} d WHERE {gone('d.label', 'd.key')}", ["path", "d.label", "d.key"], []),
        calls=(f"calls WHERE {gone(chr(39) + 'Method' + chr(39), 'caller')} AND {gone(chr(39) + 'Method' + chr(39), 'callee')}", ["caller", "callee"], ["count"]),
        declares=(f"declares WHERE {gone('owner_label', 'owner_fqn')} AND {gone('member_label', 'member_key')}", ["owner_fqn", "member_key"], []),
        annotated=(f"annotated_with WHERE {gone('owner_label', 'owner_key')}", ["owner_key", "annotation"], []),
    )


for _name, _moved in (("d1_stale_definitions", False), ("d2_stale_definitions_batch", True)):
    add(_name, lambda g, t, m=_moved: _left(deletes.delete_stale_definitions(g, *_change(g), m)), _left_sql(), _CHANGE.replace("{moved}", _MOVED if _moved else ""))
for _name, _moved in (("d5_deleted_method_names", False), ("d6_deleted_method_names_batch", True)):
    add(_name, lambda g, t, m=_moved: deletes.deleted_method_names(g, *_change(g), m), "SELECT DISTINCT name FROM method JOIN dead ON label = 'Method' AND key = signature", _CHANGE.replace("{moved}", _MOVED if _moved else ""))

_RELATIONS = _CHANGE.replace("{moved}", "") + """, known_ AS (SELECT label, fqn AS key FROM type_node UNION SELECT 'Method', signature FROM method UNION SELECT 'Field', fqn FROM field),
cand AS (SELECT path, label, key, bool_or(own_) AS own_ FROM (SELECT path, label, key, true AS own_ FROM own UNION ALL SELECT path, n.label, n.key, false FROM new_ n JOIN known_ k ON k.label = n.label AND k.key = n.key) GROUP BY 1, 2, 3),
definer AS (SELECT d.* FROM defines d JOIN file f ON f.path = d.path WHERE {kept} AND (d.path NOT IN (SELECT path FROM paths) OR EXISTS (SELECT 1 FROM new_ n WHERE n.path = d.path AND n.label = d.label AND n.key = d.key))),
loose AS (SELECT c.label, c.key, bool_or(own_) AS own_ FROM cand c WHERE NOT EXISTS (SELECT 1 FROM definer d WHERE d.label = c.label AND d.key = c.key AND d.path <> c.path) GROUP BY 1, 2)"""


def _relations(retained: bool):
    def run(g: Graph, t: Tables) -> DataFrame:
        keep = g.file.where("retained_source_token = 'run1'").select("path") if retained else None
        o = deletes.delete_stale_relations(g, *_change(g), keep)
        return dump(calls=(o.calls, ["caller", "callee"], ["count"]), annotated=(o.annotated_with, ["owner_key", "annotation"], []), extends=(o.extends, ["child", "parent"], []), implements=(o.implements, ["child", "parent"], []), pending=(o.pending_call, calls.KEYS, ["count"]))

    return run


_RELATIONS_SQL = dump_sql(
    calls=("calls WHERE NOT EXISTS (SELECT 1 FROM loose WHERE label = 'Method' AND key = caller)", ["caller", "callee"], ["count"]),
    annotated=("annotated_with a WHERE NOT EXISTS (SELECT 1 FROM loose l WHERE l.label = a.owner_label AND l.key = a.owner_key)", ["owner_key", "annotation"], []),
    extends=("extends e WHERE NOT EXISTS (SELECT 1 FROM loose l WHERE l.label = e.label AND l.key = e.child)", ["child", "parent"], []),
    implements=("implements WHERE NOT EXISTS (SELECT 1 FROM loose WHERE label = 'Class' AND key = child)", ["child", "parent"], []),
    pending=("pending_call WHERE NOT EXISTS (SELECT 1 FROM loose WHERE own_ AND label = 'Method' AND key = caller_signature)", calls.KEYS, ["count"]),
)
add("d3_stale_relations", _relations(False), _RELATIONS_SQL, _RELATIONS.replace("{kept}", "true"))
add("d4_stale_relations_retained", _relations(True), _RELATIONS_SQL, _RELATIONS.replace("{kept}", "retained_source_token = 'run1'"))


def _missing(g: Graph) -> tuple[DataFrame, str, DataFrame]:
    return g.file.where(r"path rlike '[26][.]py$'").select("path"), "python", g.file.where("retained_source_token = 'run1'").select("path")


_MISSING = """gonepaths AS (SELECT path FROM file WHERE regexp_matches(path, '[26][.]py$') AND language = 'python'), keptnode AS (SELECT DISTINCT label, key FROM defines WHERE path IN (SELECT path FROM file WHERE retained_source_token = 'run1')),
lost AS (SELECT label, key FROM defines WHERE path IN (SELECT path FROM gonepaths) EXCEPT SELECT label, key FROM keptnode),
deadm AS (SELECT * FROM lost WHERE label IN ('Method', 'Field')), deado AS (SELECT * FROM lost WHERE label NOT IN ('Method', 'Field'))"""
add("d7_missing_method_names", lambda g, t: deletes.missing_method_names(g, *_missing(g)), "SELECT DISTINCT name FROM method JOIN lost ON label = 'Method' AND key = signature", _MISSING)
add("d8_missing_members", lambda g, t: _left(deletes.delete_missing_members(g, *_missing(g))), _left_sql("deadm", "defines"), _MISSING)
add("d9_missing_owners", lambda g, t: _left(deletes.delete_missing_owners(g, *_missing(g))), _left_sql("deado", "defines"), _MISSING)
add("d10_missing_pending", lambda g, t: deletes.delete_missing_pending(g, *_missing(g)).pending_call.select(*calls.KEYS), f"SELECT {', '.join(calls.KEYS)} FROM pending_call WHERE caller_signature NOT IN (SELECT key FROM lost WHERE label = 'Method')", _MISSING)
add("d11_missing_files", lambda g, t: (lambda o: dump(file=(o.file, ["path"], []), defines=(o.defines, ["path", "key"], []), contains=(o.contains, ["src_key", "dst_key"], [])))(deletes.delete_missing_files(g, *_missing(g)[:2])),
    dump_sql(file=("file WHERE path NOT IN (SELECT path FROM gonepaths)", ["path"], []), defines=("defines WHERE path NOT IN (SELECT path FROM gonepaths)", ["path", "key"], []), contains=("contains WHERE NOT (dst_label = 'File' AND dst_key IN (SELECT path FROM gonepaths))", ["src_key", "dst_key"], [])), _MISSING)
add("d12_delete_chunks_except", lambda g, t: deletes.delete_chunks(g, g.code_chunk.where("path like '%7.md'"), g.code_chunk.where("rag_role = 'primary'").select("id")).code_chunk.select("id"), "SELECT id FROM code_chunk WHERE NOT (path LIKE '%7.md' AND rag_role <> 'primary')")
add("d13_delete_file", lambda g, t: deletes.delete_missing_files(g, g.file.agg(F.min("path").alias("path"))).defines, "SELECT * FROM defines WHERE path <> (SELECT min(path) FROM file)")
add("d14_empty_packages", lambda g, t: deletes.delete_empty_packages(g).package, "SELECT * FROM package WHERE name IN (SELECT src_key FROM contains WHERE src_label = 'Package')")
add("d15_phantom_methods", lambda g, t: (lambda o: dump(method=(o.method, ["signature"], []), calls=(o.calls, ["caller", "callee"], [])))(deletes.delete_phantom_methods(g.replace(method=g.method.withColumn("start_line", F.expr("case when signature not like '%5(N)' then start_line end"))))),
    dump_sql(method=("method WHERE signature NOT LIKE '%5(N)'", ["signature"], []), calls=("calls WHERE caller NOT LIKE '%5(N)' AND callee NOT LIKE '%5(N)'", ["caller", "callee"], [])))
add("d16_pending_for_files", lambda g, t: deletes.delete_pending_for_files(g, _change(g)[0]).pending_call.select(*calls.KEYS),
    f"SELECT {', '.join(calls.KEYS)} FROM pending_call WHERE caller_signature NOT IN (SELECT key FROM defines d WHERE label = 'Method' AND regexp_matches(path, '3[.][a-z]+$') AND NOT EXISTS (SELECT 1 FROM defines o WHERE o.label = 'Method' AND o.key = d.key AND o.path <> d.path))")
add("d17_legacy_links", lambda g, t: deletes.delete_legacy_links(g).contains.select("src_label", "src_key", "dst_key"), "SELECT src_label, src_key, dst_key FROM contains c LEFT JOIN file ON dst_label = 'File' AND path = dst_key WHERE dst_label <> 'File' OR src_key = language")
add("d18_stale_module_owners", lambda g, t: deletes.stale_module_owners(g.replace(defines=g.type_node.select(F.lit("f").alias("path"), "label", F.col("fqn").alias("key"))), "f", "supplier.1", "js"), "SELECT label, fqn AS key FROM type_node WHERE language = 'js' AND fqn <> 'supplier.1' AND fqn NOT LIKE 'supplier.1.%'")


def _sizes(g: Graph, *tables: str) -> DataFrame:
    out = None
    for x in tables:
        part = getattr(g, x).agg(F.count("*").alias("rows")).select(F.lit(x).alias("tbl"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


add("d19_wipe_code", lambda g, t: _sizes(deletes.wipe_code(g), "method", "file", "memory_item"), "SELECT 'method' AS tbl, 0 AS rows UNION ALL SELECT 'file', 0 UNION ALL SELECT 'memory_item', count(*) FROM memory_item")
add("d20_wipe_memories", lambda g, t: _sizes(deletes.wipe_memories(g), "memory_item", "code_ref", "method"), "SELECT 'memory_item' AS tbl, 0 AS rows UNION ALL SELECT 'code_ref', 0 UNION ALL SELECT 'method', count(*) FROM method")
add("d21_wipe_rag", lambda g, t: _sizes(deletes.wipe_rag(g), "code_chunk", "memory_chunk", "file"), "SELECT 'code_chunk' AS tbl, 0 AS rows UNION ALL SELECT 'memory_chunk', 0 UNION ALL SELECT 'file', count(*) FROM file")
add("d23_stale_memory_chunks", lambda g, t: (lambda b: deletes.delete_stale_memory_chunks(b.replace(has_item=b.has_item.where("label <> 'Task'"))).memory_chunk.select("id"))(rag.refresh_memory_chunks(g)), "SELECT 'MCH-' || label || '-' || id AS id FROM has_item WHERE label <> 'Task'")
add("d24_sharing_files", lambda g, t: deletes.sharing_files(g, _missing(g)[0], _missing(g)[2]), "SELECT DISTINCT path FROM defines WHERE path IN (SELECT path FROM file WHERE retained_source_token = 'run1') AND (label, key) IN (SELECT (label, key) FROM defines WHERE path IN (SELECT path FROM gonepaths))", _MISSING)
add("g1_schema_uniqueness", lambda g, t: schema.duplicates(g.method, "method").select("signature", "rows").unionByName(schema.duplicates(g.type_node, "type_node").select(F.col("fqn").alias("signature"), "rows")), "SELECT signature, count(*) AS rows FROM method GROUP BY 1 HAVING count(*) > 1")

# ---- references

add("r1_r8_resolve_refs", lambda g, t: refs.resolve(g.replace(resolves_to=g.code_ref.select("target_type", "key", F.lit("old").alias("target_key")))).resolves_to, "SELECT target_type, key, key AS target_key FROM resolves UNION ALL SELECT target_type, key, 'old' FROM code_ref WHERE target_type = 'Widget'", _TARGETS)
add("r1s_r8s_resolve_refs_scoped", lambda g, t: refs.resolve(g.replace(resolves_to=g.code_ref.select("target_type", "key", F.lit("old").alias("target_key"))), g.code_ref.where("key like '%1' or key like '%9'")).resolves_to,
    "SELECT target_type, key, key AS target_key FROM resolves WHERE (key LIKE '%1' OR key LIKE '%9') UNION ALL SELECT target_type, key, 'old' FROM code_ref WHERE target_type = 'Widget' OR NOT (key LIKE '%1' OR key LIKE '%9')", _TARGETS)
add("r9_drop_unsupported_refs", lambda g, t: refs.drop_unsupported(g.replace(resolves_to=g.code_ref.select("target_type", "key", F.col("key").alias("target_key")))).resolves_to, "SELECT target_type, key, key AS target_key FROM code_ref WHERE target_type <> 'Widget'")
add("r_refresh_scoped", lambda g, t: refs.refresh(g.replace(resolves_to=g.code_ref.where("key like '%2'").select("target_type", "key", F.lit("old").alias("target_key"))), g.code_ref.where("key like '%1'")).resolves_to,
    "SELECT target_type, key, key AS target_key FROM resolves WHERE key NOT LIKE '%2' UNION ALL SELECT target_type, key, 'old' FROM code_ref WHERE key LIKE '%2' AND target_type <> 'Widget'", _TARGETS)

# ---- calls

_TIERS = """known AS (SELECT x.owner_fqn, name, count(DISTINCT signature) AS n, min(signature) AS one FROM declares x JOIN method ON member_label = 'Method' AND member_key = signature GROUP BY 1, 2),
up(start, node, depth) AS (SELECT child, parent, 1 FROM extends WHERE label = 'Class' UNION SELECT up.start, e.parent, depth + 1 FROM up JOIN extends e ON e.label = 'Class' AND e.child = up.node),
iup(start, node) AS (SELECT fqn, fqn FROM type_node WHERE label = 'Interface' UNION SELECT iup.start, e.parent FROM iup JOIN extends e ON e.label = 'Interface' AND e.child = iup.node),
p AS (SELECT * FROM pending_call WHERE caller_signature IN (SELECT signature FROM method){scope}),
t1 AS (SELECT p.*, n, one FROM p JOIN known k ON k.owner_fqn = callee_owner_fqn AND name = callee_name),
t2 AS (SELECT * EXCLUDE (rn) FROM (SELECT p.*, n, one, row_number() OVER (PARTITION BY caller_signature, callee_owner_fqn, callee_name ORDER BY depth, node) AS rn FROM p JOIN up ON start = callee_owner_fqn JOIN known k ON k.owner_fqn = node AND name = callee_name WHERE NOT EXISTS (SELECT 1 FROM t1 WHERE t1.caller_signature = p.caller_signature AND t1.callee_owner_fqn = p.callee_owner_fqn AND t1.callee_name = p.callee_name)) WHERE rn = 1),
t12 AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2),
cls AS (SELECT fqn AS start, fqn AS node FROM type_node WHERE label = 'Class' UNION SELECT start, node FROM up),
ifs AS (SELECT DISTINCT cls.start, iup.node FROM cls JOIN implements i ON i.child = cls.node JOIN iup ON iup.start = i.parent),
cand3 AS (SELECT DISTINCT 0 AS l, start, node FROM ifs UNION ALL SELECT DISTINCT 1, start, node FROM iup WHERE start <> node),
t3 AS (SELECT p.caller_signature, p.callee_owner_fqn, p.callee_name, any_value(p.count) AS count, any_value(allow_name_only) AS allow_name_only, count(DISTINCT l || m.signature) AS n, min(m.signature) AS one FROM p JOIN cand3 ON start = callee_owner_fqn JOIN declares x ON x.owner_fqn = node AND x.member_label = 'Method' JOIN method m ON m.signature = x.member_key AND m.name = callee_name
  WHERE NOT EXISTS (SELECT 1 FROM t12 WHERE t12.caller_signature = p.caller_signature AND t12.callee_owner_fqn = p.callee_owner_fqn AND t12.callee_name = p.callee_name) GROUP BY 1, 2, 3),
t4 AS (SELECT p.caller_signature, p.callee_owner_fqn, p.callee_name, any_value(p.count) AS count, true AS allow_name_only, count(*) AS n, min(m.signature) AS one FROM p JOIN method m ON m.name = callee_name AND m.start_line IS NOT NULL AND m.signature <> caller_signature WHERE callee_owner_fqn = '' AND allow_name_only GROUP BY 1, 2, 3),
sure AS (SELECT * FROM ({tiers}) WHERE n = 1),
calls_out AS (SELECT caller, callee, sum(count) AS n FROM (SELECT * FROM calls UNION ALL SELECT caller_signature, one, count FROM sure) GROUP BY 1, 2),
pending_out AS (SELECT * FROM pending_call q WHERE NOT EXISTS (SELECT 1 FROM sure s WHERE s.caller_signature = q.caller_signature AND s.callee_owner_fqn = q.callee_owner_fqn AND s.callee_name = q.callee_name))"""
_ALL = "SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3 UNION ALL SELECT * FROM t4"
_CALLS_SQL = dump_sql(calls=("calls_out", ["caller", "callee"], ["n"]), pending=("pending_out", calls.KEYS, ["count", "allow_name_only"]))
_SCOPE = """ AND (caller_signature IN (SELECT signature FROM method WHERE name LIKE '%1') OR callee_owner_fqn IN (SELECT * FROM affected) OR (callee_owner_fqn = '' AND allow_name_only AND callee_name IN (SELECT name FROM method WHERE name LIKE '%2')))"""
_AFFECTED = """changed AS (SELECT label, fqn FROM type_node WHERE fqn IN ('supplier.3', 'supplier.7', 'nation.3', 'nation.11')),
cdown(root, node) AS (SELECT fqn, fqn FROM type_node WHERE label = 'Class' UNION SELECT root, e.child FROM cdown JOIN extends e ON e.label = 'Class' AND e.parent = node),
idown(root, node) AS (SELECT fqn, fqn FROM type_node WHERE label = 'Interface' UNION SELECT root, e.child FROM idown JOIN extends e ON e.label = 'Interface' AND e.parent = node),
affected AS (SELECT node FROM cdown WHERE root IN (SELECT fqn FROM changed) UNION SELECT node FROM idown WHERE root IN (SELECT fqn FROM changed)
  UNION SELECT c.node FROM idown i JOIN implements m ON m.parent = i.node JOIN cdown c ON c.root = m.child WHERE i.root IN (SELECT fqn FROM changed))"""


def _calls(g: Graph) -> DataFrame:
    return dump(calls=(g.calls, ["caller", "callee"], ["count"]), pending=(g.pending_call, calls.KEYS, ["count", "allow_name_only"]))


def _changed(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    owners = g.type_node.where("fqn in ('supplier.3', 'supplier.7', 'nation.3', 'nation.11')").select("fqn")
    return g.method.where("name like '%1'").select("signature"), owners, g.method.where("name like '%2'").select("name")


_STORED_P = ("method", "pending_call", "type_node", "extends", "implements")
add("p1_resolve_direct", lambda g, t: _calls(calls.resolve_direct(g)), _CALLS_SQL, _TIERS.replace("{scope}", "").replace("{tiers}", "SELECT * FROM t1"), stored=_STORED_P)
add("p2_resolve_pending_calls", lambda g, t: _calls(calls.resolve_pending(g)), _CALLS_SQL, _TIERS.replace("{scope}", "").replace("{tiers}", _ALL), stored=_STORED_P)
add("p1s_resolve_direct_scoped", lambda g, t: _calls(calls.resolve_direct(g, calls.scope(g, *_changed(g)))), _CALLS_SQL, _AFFECTED + ", " + _TIERS.replace("{scope}", _SCOPE).replace("{tiers}", "SELECT * FROM t1"), stored=_STORED_P)
add("p2s_resolve_pending_scoped", lambda g, t: _calls(calls.resolve_pending(g, _changed(g))), _CALLS_SQL, _AFFECTED + ", " + _TIERS.replace("{scope}", _SCOPE).replace("{tiers}", _ALL), stored=_STORED_P)
add("hierarchy_closure", lambda g, t: hierarchy.ancestors(g.extends, "Class"), "SELECT start, node, CAST(depth AS INT) AS depth FROM up", "up(start, node, depth) AS (SELECT child, parent, 1 FROM extends WHERE label = 'Class' UNION SELECT up.start, e.parent, depth + 1 FROM up JOIN extends e ON e.label = 'Class' AND e.child = up.node)")

# ---- chunks and vectors

_STALE = "text IS NOT NULL AND (coalesce(embedding_dirty, false) OR embedding IS NULL OR coalesce(embedding_model <> 'm1', true) OR coalesce(embedding_dimensions <> 64, true))"
_OBSOLETE = "((embedding IS NOT NULL AND (embedding_model IS NULL OR embedding_dimensions IS NULL)) OR coalesce(embedding_model <> 'm1', false) OR coalesce(embedding_dimensions <> 64, false))"
add("v2_mark_stale", lambda g, t: rag.mark_stale(g.code_chunk, "m1", 64).select("id", "embedding_dirty"), f"SELECT id, CASE WHEN {_STALE} THEN true ELSE embedding_dirty END AS embedding_dirty FROM code_chunk")
add("v3_chunk_counts", lambda g, t: rag.counts(g.code_chunk, "m1", 64), f"SELECT count(*) AS chunks, count(*) FILTER (embedding_dirty) AS dirty, count(*) FILTER ({_STALE}) AS stale, count(*) FILTER ({_OBSOLETE}) AS obsolete FROM code_chunk")
add("v4_clear_obsolete", lambda g, t: rag.clear_obsolete(g.code_chunk, "m1", 64).select("id", F.col("embedding").isNotNull().alias("has"), "embedding_model", "embedding_dimensions", "embedding_dirty"),
    f"SELECT id, embedding IS NOT NULL AND NOT o AS has, CASE WHEN NOT o THEN embedding_model END AS embedding_model, CAST(CASE WHEN NOT o THEN embedding_dimensions END AS INT) AS embedding_dimensions, CASE WHEN o THEN true ELSE embedding_dirty END AS embedding_dirty FROM (SELECT *, {_OBSOLETE} AS o FROM code_chunk)")
add("v5_v6_refresh_embeddings", lambda g, t: rag.refresh_dirty(g.code_chunk, rag.HashEmbedder(64)).select("id", F.size("embedding").alias("size"), "embedding_model", "embedding_dirty"),
    "SELECT id, CAST(CASE WHEN embedding_dirty THEN 64 WHEN embedding IS NOT NULL THEN len(embedding) END AS INT) AS size, CASE WHEN embedding_dirty THEN 'hash-64' ELSE embedding_model END AS embedding_model, false AS embedding_dirty FROM code_chunk")
add("v7_failure_details", lambda g, t: rag.failure_details(g.code_chunk).select("id", "path", "text_preview"), "SELECT id, path, substr(text, 1, 240) AS text_preview FROM code_chunk")
add("v8_v9_index_info", lambda g, t: rag.index_info(g, "demo", "code", rag.HashEmbedder(64)).select("target", "dimensions", "capacity", "metric"), "SELECT 'code' AS target, CAST(64 AS INT) AS dimensions, greatest(8192, 2 * count(*)) AS capacity, 'cos' AS metric FROM code_chunk")
add("v10_refresh_controller", lambda g, t: rag.refresh(g, "demo", "code", rag.HashEmbedder(64)).code_chunk.groupBy("embedding_model", "embedding_dimensions", "embedding_dirty").agg(F.count("*").alias("rows")), "SELECT 'hash-64' AS embedding_model, CAST(64 AS INT) AS embedding_dimensions, false AS embedding_dirty, count(*) AS rows FROM code_chunk")


def _query_vector(t: Tables) -> list[float]:
    return [float(x) for x in t.embeddings.where("vec_id = 0").select("embedding").first()[0]]


def _vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


_COSINE = "SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 4) AS score, label FROM embeddings"
add("v11_vector_search", lambda g, t: rag.search(_vectors(t), _query_vector(t), 20, places=4).select("id", "score"), f"SELECT id, score FROM ({_COSINE}) ORDER BY score DESC, id LIMIT 20")
add("v11_vector_search_filter_after", lambda g, t: rag.search(_vectors(t), _query_vector(t), 20, after=F.col("label") == 1, places=4).select("id", "score"), f"SELECT id, score FROM (SELECT * FROM ({_COSINE}) ORDER BY score DESC, id LIMIT 20) WHERE label = 1")
add("v11_vector_scores", lambda g, t: _vectors(t).select("id", F.round(rag.cosine(F.col("embedding"), F.lit(_query_vector(t)).cast("array<double>")), 4).alias("score")), f"SELECT id, score FROM ({_COSINE})")


def _search_all(t: Tables, chunks: DataFrame, k: int) -> DataFrame:
    """The search of every row of embeddings whose id is divisible by 20."""
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("query"))
    return rag.search_all(chunks, queries, k)


add("v11_vector_search_all", lambda g, t: _search_all(t, _vectors(t), 20))
add("v11_vector_search_filter_after_all", lambda g, t: _search_all(t, _vectors(t), 20).join(_vectors(t).where("label = 1").select("id"), "id", "left_semi"))
add("q5_code_search_all", lambda g, t: _search_all(t, g.code_chunk.where("rag_role in ('file', 'primary')"), 25))
add("q23_memory_search_all", lambda g, t: _search_all(t, t.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding"), 15))
add("v12_code_chunk_text", lambda g, t: rag.code_chunks(g.replace(file=g.code_chunk.select("path", "language"), defines=g.defines.where("false"), type_node=g.type_node.where("false")), g.code_chunk.select("path", "text")).select("id", "path", "name", "rag_role", "start_line", "end_line", F.length("text").cast("long").alias("chars")),
    """SELECT 'CCH-file-' || substr(sha256(path), 1, 16) AS id, path, name, 'file' AS rag_role, CAST(1 AS INT) AS start_line, CAST(end_line AS INT) AS end_line,
  length(regexp_replace(regexp_replace('Name: ' || name || chr(10) || 'Kind: file' || chr(10) || CASE WHEN w <> '' THEN 'Words: ' || w || chr(10) ELSE '' END || 'Source excerpt:' || chr(10) || array_to_string(string_split(text, chr(10))[1:80], chr(10)), '^\\s+', ''), '\\s+$', '')) AS chars
  FROM (SELECT *, array_to_string(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 3), ' ') AS w FROM code_chunk)""")  # fmt: skip


def _every_chunk(g: Graph, t: Tables) -> DataFrame:
    """V12 over all that the files define; a file of the graph has the text of a document that its path picks, a document's own file its own."""
    n = t.documents.agg(F.max("doc_id")).first()[0] or 0
    given = g.file.select("path", F.pmod(F.xxhash64("path"), F.lit(n + 1)).alias("doc_id")).join(t.documents.select("doc_id", "text"), "doc_id").select("path", "text")
    own = g.code_chunk.select("path", "language", "text")
    files = g.file.select("path", "language").unionByName(own.select("path", "language"))
    return rag.code_chunks(g.replace(file=files), given.unionByName(own.select("path", "text")))


add("v12_code_chunk_text_all", lambda g, t: _every_chunk(g, t).select("id", "source_label", "source_id", "path", "name", "rag_role", "start_line", "end_line", F.length("text").cast("long").alias("chars"), "text_hash"))
_WORDS = "list_filter(string_split_regex(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 3)"
add("f_identifier_words", lambda g, t: t.documents.select("doc_id", tx.identifier_words(F.col("text")).alias("words")), f"SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1])[1:32], ' ') AS words FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
add("f_names_hashes_previews", lambda g, t: g.method.select("signature", tx.method_name(F.col("signature")).alias("method_name"), tx.simple_name(F.col("owner_fqn")).alias("owner"), tx.package_name(F.col("owner_fqn")).alias("package"), tx.chunk_id(F.lit("Method"), F.col("signature")).alias("chunk_id"), tx.preview(F.col("signature"), 12).alias("preview")),
    "SELECT signature, split_part(split_part(signature, '(', 1), '.', -1) AS method_name, split_part(coalesce(owner_fqn, ''), '.', -1) AS owner, CASE WHEN owner_fqn IS NULL THEN '' ELSE regexp_replace(owner_fqn, '\\.[^.]*$', '') END AS package, 'CCH-method-' || substr(sha256(signature), 1, 16) AS chunk_id, substr(signature, 1, 12) AS preview FROM method")
add("v13_memory_chunk_ids", lambda g, t: rag.memory_chunk_rows(rag.memory_sources(g)).select("id", "source_label", "source_id"), "SELECT 'MCH-' || label || '-' || id AS id, label AS source_label, id AS source_id FROM has_item")

# ---- metrics

add("m1_m16_metrics", lambda g, t: metrics.metrics(refs.refresh(g)).select("metric", "value"),
    """SELECT 'files' AS metric, count(*) AS value FROM file UNION ALL SELECT 'packages', count(*) FROM package UNION ALL SELECT 'classes.internal', count(*) FROM type_node WHERE label = 'Class' AND is_external = false UNION ALL SELECT 'classes.external', count(*) FROM type_node WHERE label = 'Class' AND is_external
UNION ALL SELECT 'interfaces', count(*) FROM type_node WHERE label = 'Interface' UNION ALL SELECT 'annotations', count(*) FROM type_node WHERE label = 'Annotation' UNION ALL SELECT 'methods', count(*) FROM method WHERE NOT is_synthetic UNION ALL SELECT 'methods.synthetic', count(*) FROM method WHERE is_synthetic
UNION ALL SELECT 'fields', count(*) FROM field UNION ALL SELECT 'calls', CAST(coalesce(sum(count), 0) AS BIGINT) FROM calls UNION ALL SELECT 'extends', count(*) FROM extends UNION ALL SELECT 'implements', count(*) FROM implements UNION ALL SELECT 'annotated_with', count(*) FROM annotated_with
UNION ALL SELECT 'pending_calls', count(*) FROM pending_call UNION ALL SELECT 'pending_calls.name_only', count(*) FROM pending_call WHERE callee_owner_fqn = '' UNION ALL SELECT 'resolved_code_refs', count(*) FROM resolves""", _TARGETS)  # fmt: skip

# ---- analytics

add("q1_server_status", lambda g, t: analytics.server_status(g), "SELECT 'graph' AS section, 'file' AS name, count(*) AS value FROM file UNION ALL SELECT 'graph', 'package', count(*) FROM package UNION ALL SELECT 'graph', 'type_node', count(*) FROM type_node UNION ALL SELECT 'graph', 'method', count(*) FROM method UNION ALL SELECT 'graph', 'field', count(*) FROM field UNION ALL SELECT 'graph', 'calls', count(*) FROM calls UNION ALL SELECT 'graph', 'pending_call', count(*) FROM pending_call UNION ALL SELECT 'graph', 'code_chunk', count(*) FROM code_chunk UNION ALL SELECT 'memory', label, count(*) FROM memory_item GROUP BY 2")
_LEN = "end_line - start_line + 1"
add("q2_code_quality_stats", lambda g, t: analytics.quality_stats(g), f"SELECT count(*) AS methods, count({_LEN}) AS measured, CAST(sum({_LEN}) AS BIGINT) AS lines, CAST(max({_LEN}) AS BIGINT) AS longest, count(*) FILTER ({_LEN} > 50) AS over_50_lines, count(DISTINCT owner_fqn) AS owners, (SELECT count(*) FROM calls) AS call_edges, (SELECT CAST(sum(count) AS BIGINT) FROM calls) AS call_sites FROM described WHERE NOT is_test")
for _s, _sql in (
    ("fanIn", "SELECT callee AS name, count(*) AS score FROM calls JOIN described ON signature = callee WHERE NOT is_test GROUP BY 1"), ("fanOut", "SELECT caller AS name, count(*) AS score FROM calls JOIN described ON signature = caller WHERE NOT is_test GROUP BY 1"),
    ("longestMethods", f"SELECT signature AS name, CAST({_LEN} AS BIGINT) AS score FROM described WHERE NOT is_test"), ("typeSize", "SELECT owner_fqn AS name, count(*) AS score FROM declares GROUP BY 1"),
):
    add(f"q3_hot_paths_{_s.lower()}", lambda g, t, s=_s: analytics.hot_paths(g, s, limit=50), f"SELECT '{_s}' AS section, name, score FROM ({_sql}) ORDER BY score DESC, name LIMIT 50")
for _s, _sql in (
    ("languages", "SELECT language AS name, count(*) AS value FROM file GROUP BY 1"), ("packages", "SELECT package_name AS name, count(*) AS value FROM type_node GROUP BY 1"), ("largestTypes", "SELECT owner_fqn AS name, count(*) AS value FROM declares GROUP BY 1"),
    ("crossOwnerCalls", "SELECT a.owner_fqn || ' -> ' || b.owner_fqn AS name, count(*) AS value FROM calls JOIN method a ON a.signature = caller JOIN method b ON b.signature = callee WHERE a.owner_fqn <> b.owner_fqn GROUP BY 1"),
):
    add(f"q4_orientation_{_s.lower()}", lambda g, t, s=_s: analytics.orientation(g, s), f"SELECT '{_s}' AS section, name, value FROM ({_sql})")
add("q5_code_search", lambda g, t: analytics.search(g, _query_vector(t), 25, places=4, rag_roles=("file", "primary")).select("id", "path", "score"),
    "SELECT id, path, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 4) AS score FROM code_chunk WHERE embedding IS NOT NULL AND rag_role IN ('file', 'primary') ORDER BY score DESC, id LIMIT 25")
add("q6_code_text_search", lambda g, t: analytics.text_search(g, "the license", any_terms=("rights", "work"), limit=None).select("id", "path", "term_matches"),
    "SELECT * FROM (SELECT id, path, CAST(contains(x, 'the') AS INT) + CAST(contains(x, 'license') AS INT) + CAST(contains(x, 'rights') AS INT) + CAST(contains(x, 'work') AS INT) AS term_matches FROM (SELECT id, path, lower(text || chr(10) || path || chr(10) || source_id) AS x FROM code_chunk) WHERE contains(x, 'rights') OR contains(x, 'work'))")


def _method_chunks(g: Graph, which: str = "name like 'part1%'") -> Graph:
    return g.replace(code_chunk=schema.conform(g.method.where(which).select(F.col("signature").alias("id"), F.lit("Method").alias("source_label"), F.col("signature").alias("source_id"), F.lit("m").alias("path"), F.lit("primary").alias("rag_role"), F.col("signature").alias("text")), "code_chunk"))


add("q7_discovery_context", lambda g, t: (lambda b: analytics.discovery_context(b, b.code_chunk, 3))(_method_chunks(g)),
    "SELECT anchor, side, signature, count FROM (SELECT *, row_number() OVER (PARTITION BY anchor, side ORDER BY count DESC, signature) AS r FROM (SELECT callee AS anchor, 'caller' AS side, caller AS signature, count FROM calls UNION ALL SELECT caller, 'callee', callee, count FROM calls) WHERE anchor IN (SELECT signature FROM method WHERE name LIKE 'part1%')) WHERE r <= 3")
add("q7_discovery_context_all", lambda g, t: (lambda b: analytics.discovery_context(b, b.code_chunk, 3))(_method_chunks(g, "true")))
add("q8_flow_context", lambda g, t: analytics.flow_context(g.replace(code_chunk=schema.conform(g.defines.where("label = 'Method'").select(F.concat("path", F.lit("#"), "key").alias("id"), "path", F.col("key").alias("text")), "code_chunk")), "part17 (R)", limit_files=100).select("path", "lexical", "inner_calls", "outer_calls"),
    """SELECT h.path, lexical, coalesce(i, 0) AS inner_calls, coalesce(o, 0) AS outer_calls FROM (SELECT path, CAST(max(CAST(contains(lower(key || chr(10) || path), 'part17') AS INT) + CAST(contains(lower(key || chr(10) || path), '(r)') AS INT)) AS DOUBLE) AS lexical FROM defines WHERE label = 'Method' AND (contains(lower(key), 'part17') OR contains(lower(key), '(r)')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100) h
LEFT JOIN (SELECT path, count(*) FILTER (a = b) AS i, count(*) FILTER (a <> b) AS o FROM (SELECT a, b, unnest(CASE WHEN a = b THEN [a] ELSE [a, b] END) AS path FROM (SELECT x.path AS a, y.path AS b FROM calls JOIN described x ON x.signature = caller JOIN described y ON y.signature = callee WHERE x.path IS NOT NULL AND y.path IS NOT NULL)) GROUP BY 1) e ON e.path = h.path""")  # fmt: skip
add("q9_lookup_type", lambda g, t: analytics.lookup_type(g, fqn="supplier.7"), "SELECT label, fqn, name, kind, visibility, (SELECT count(*) FROM declares WHERE owner_label = label AND owner_fqn = fqn) AS members FROM type_node WHERE fqn = 'supplier.7'")
add("q10_lookup_methods", lambda g, t: analytics.lookup_methods(g, "supplier.7", skip=5, limit=40, include_tests=True).select("owner_match", "signature", "path"), "SELECT CAST(coalesce(owner_fqn = 'supplier.7' OR split_part(owner_fqn, '.', -1) IN ('supplier', '7'), false) AS INT) AS owner_match, signature, path FROM described WHERE contains(signature, 'supplier.7') ORDER BY owner_match DESC, signature LIMIT 40 OFFSET 5")
add("q11_lookup_field", lambda g, t: analytics.lookup_field(g, "f10", limit=None), "SELECT fqn, name, type FROM field WHERE contains(fqn, 'f10') OR contains(name, 'f10')")
add("q12_lookup_file", lambda g, t: analytics.lookup_file(g, limit=None), "SELECT path, language, (SELECT count(*) FROM defines d WHERE d.path = f.path) AS definitions, (SELECT count(*) FROM code_chunk c WHERE c.path = f.path) AS chunks FROM file f")
add("q13_file_context", lambda g, t: analytics.file_context(g, ["src/m7/"], symbols=3, limit_files=None).select("path", "language", "definitions", F.array_join("symbols", ";").alias("symbols")),
    "SELECT f.path, language, coalesce(n, 0) AS definitions, s AS symbols FROM file f LEFT JOIN (SELECT path, count(*) AS n FROM defines GROUP BY 1) d ON d.path = f.path LEFT JOIN (SELECT path, string_agg(key, ';' ORDER BY l, key) AS s FROM (SELECT path, key, coalesce(start_line, 0) AS l, row_number() OVER (PARTITION BY path ORDER BY coalesce(start_line, 0), key) AS r FROM defines LEFT JOIN method ON label = 'Method' AND key = signature) WHERE r <= 3 GROUP BY 1) x ON x.path = f.path WHERE contains(f.path, 'src/m7/')")
_HOP = "c.count, m.owner_fqn AS owner, m.name, m.path, m.start_line, m.end_line"
add("q14_code_callers", lambda g, t: analytics.callers(g), f"SELECT c.callee, c.caller, {_HOP} FROM calls c JOIN described m ON m.signature = c.caller")
add("q14_code_callees", lambda g, t: analytics.callees(g), f"SELECT c.caller, c.callee, {_HOP} FROM calls c JOIN described m ON m.signature = c.callee")
add("q15_method_context", lambda g, t: analytics.method_context(g, methods=None).select("signature", "n_callers", "n_callees", F.array_join("callers", ";").alias("callers")),
    "SELECT m.signature, coalesce(a.n, 0) AS n_callers, coalesce(b.n, 0) AS n_callees, s AS callers FROM method m LEFT JOIN (SELECT callee, count(*) AS n, string_agg(caller, ';' ORDER BY count DESC, caller) FILTER (r <= 5) AS s FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY count DESC, caller) AS r FROM calls) GROUP BY 1) a ON a.callee = m.signature LEFT JOIN (SELECT caller, count(*) AS n FROM calls GROUP BY 1) b ON b.caller = m.signature")
add("q16_code_impact", lambda g, t: analytics.impact(g, g.method.where("name like 'part17%'").select("signature")),
    """SELECT i.target, i.caller, CAST(i.depth AS INT) AS depth, c.path, c.is_test, c.path IS DISTINCT FROM g.path AS crosses_file, ct.package_name IS DISTINCT FROM gt.package_name AS crosses_package FROM (SELECT target, caller, min(d) AS depth FROM (
  SELECT callee AS target, caller, 1 AS d FROM calls WHERE callee IN (SELECT signature FROM method WHERE name LIKE 'part17%') UNION ALL SELECT a.callee, b.caller, 2 FROM calls a JOIN calls b ON b.callee = a.caller WHERE a.callee IN (SELECT signature FROM method WHERE name LIKE 'part17%')) WHERE caller <> target GROUP BY 1, 2) i
JOIN described c ON c.signature = i.caller JOIN described g ON g.signature = i.target LEFT JOIN type_node ct ON ct.fqn = c.owner_fqn LEFT JOIN type_node gt ON gt.fqn = g.owner_fqn""")  # fmt: skip
add("q16_impact_files", lambda g, t: analytics.impact_files(analytics.impact(g, g.method.where("name = 'part17'").select("signature"))),
    """SELECT path, count(DISTINCT caller) AS callers, CAST(min(depth) AS INT) AS depth FROM (SELECT target, caller, min(d) AS depth FROM (SELECT callee AS target, caller, 1 AS d FROM calls JOIN method ON signature = callee WHERE name = 'part17' UNION ALL SELECT a.callee, b.caller, 2 FROM calls a JOIN calls b ON b.callee = a.caller JOIN method ON signature = a.callee WHERE name = 'part17') WHERE caller <> target GROUP BY 1, 2) JOIN described ON signature = caller GROUP BY 1""")  # fmt: skip
add("q16_code_impact_all", lambda g, t: analytics.impact(g, g.method.select("signature")))
add("q16_impact_files_all", lambda g, t: analytics.impact_files(analytics.impact(g, g.method.select("signature"))))
add("q17_operation_hot_paths", lambda g, t: analytics.operation_hot_paths(g, ("part1", "init"), limit=None), "SELECT caller, count(*) AS sinks, CAST(sum(count) AS BIGINT) AS sites FROM calls JOIN method m ON m.signature = callee JOIN method c ON c.signature = caller WHERE m.name LIKE 'part1%' OR m.name LIKE 'init%' GROUP BY 1")
add("q18_resource_risk_scan", lambda g, t: analytics.risk_scan(t.pages.select("page_id", F.concat_ws(" ", F.lit("MATCH (a)-[*1..]->(b)"), "html", F.lit("DETACH DELETE a")).alias("text")), "page_id"), "SELECT page_id, 1::BIGINT AS unbounded_traversal, 0::BIGINT AS repeated_subquery, 0::BIGINT AS optional_per_row, 1::BIGINT AS broad_write, 0::BIGINT AS write_in_loop, 2::BIGINT AS risk FROM pages")
add("q19_test_context", lambda g, t: analytics.test_context(g, production_limit=None), "SELECT caller AS test, a.path AS test_path, callee, b.path AS production_path, count FROM calls JOIN described a ON a.signature = caller JOIN described b ON b.signature = callee WHERE a.is_test AND NOT b.is_test")
add("q20_hierarchy", lambda g, t: analytics.hierarchy(g), "SELECT start AS fqn, CASE WHEN depth = 1 THEN 'parent' ELSE 'ancestor' END AS relation, node AS other, CAST(depth AS INT) AS depth FROM up UNION ALL SELECT parent, 'child', child, 1 FROM extends UNION ALL SELECT child, 'interface', parent, 1 FROM implements UNION ALL SELECT parent, 'implementor', child, 1 FROM implements",
    "up(start, node, depth) AS (SELECT child, parent, 1 FROM extends UNION SELECT up.start, e.parent, depth + 1 FROM up JOIN extends e ON e.child = up.node)")
add("q21_raw_read", lambda g, t: analytics.raw_read(g, "SELECT label, count(*) AS n FROM type_node GROUP BY label"), "SELECT label, count(*) AS n FROM type_node GROUP BY label")
add("q22_memory_orientation", lambda g, t: memory.orientation(g), "SELECT label, id, title, status, severity FROM memory_item WHERE label = 'Rule' OR (label = 'Task' AND status IN ('todo', 'doing', 'blocked')) OR (label = 'Finding' AND status = 'open')")
add("q23_memory_search", lambda g, t: memory.find(g.replace(memory_chunk=schema.conform(t.embeddings.select(F.col("vec_id").cast("string").alias("id"), F.lit("Task").alias("source_label"), "embedding"), "memory_chunk")), _query_vector(t), 15, 4).select("id", "score"), f"SELECT CAST(id AS VARCHAR) AS id, score FROM ({_COSINE}) ORDER BY score DESC, CAST(id AS VARCHAR) LIMIT 15")
add("q24_memory_get", lambda g, t: memory.get(refs.refresh(g), "Context", "B7").select("label", "id", F.array_join(F.transform("code_refs", lambda r: F.concat(r["target_type"], F.lit(" "), r["key"], F.lit(" "), r["resolved"].cast("string"))), ";").alias("code_refs")),
    "SELECT 'Context' AS label, 'B7' AS id, string_agg(r.target_type || ' ' || r.key || ' ' || CASE WHEN v.key IS NULL THEN 'false' ELSE 'true' END, ';' ORDER BY r.target_type, r.key) AS code_refs FROM refers_to r LEFT JOIN resolves v ON v.target_type = r.target_type AND v.key = r.key WHERE r.id = 'B7'", _TARGETS)
add("q25_memory_update_status", lambda g, t: memory.update_status(g, g.memory_item.where("label = 'Task'").select("label", "id", F.lit("done").alias("status"))).memory_item.select("label", "id", "title", "status"), "SELECT label, id, title, CASE WHEN label = 'Task' THEN 'done' ELSE status END AS status FROM memory_item")
add("q25_memory_upsert", lambda g, t: (lambda o: dump(item=(o.memory_item, ["label", "id"], ["title", "status"]), edge=(o.has_item, ["rel", "id"], [])))(memory.upsert(g, g.memory_item.where("label = 'Finding'").select("label", F.concat("id", F.lit("x")).alias("id"), "title", F.lit("open").alias("status")).unionByName(g.memory_item.where("label = 'Finding'").select("label", "id", F.lit("new").alias("title"), F.lit(None).cast("string").alias("status"))))),
    dump_sql(item=("(SELECT label, id, CASE WHEN label = 'Finding' THEN 'new' ELSE title END AS title, status FROM memory_item UNION ALL SELECT label, id || 'x', title, 'open' FROM memory_item WHERE label = 'Finding')", ["label", "id"], ["title", "status"]), edge=("(SELECT rel, id FROM has_item UNION SELECT 'HAS_FINDING', unnest([id, id || 'x']) FROM memory_item WHERE label = 'Finding')", ["rel", "id"], [])))
add("q25_memory_violations", lambda g, t: memory.violations(g.memory_item), "SELECT label, id, 'nothing' AS field, 'nothing' AS value FROM memory_item WHERE false")
add("q26_delete_memory", lambda g, t: (lambda o: dump(item=(o.memory_item, ["label", "id"], []), ref=(o.code_ref, ["target_type", "key"], []), refers=(o.refers_to, ["id", "key"], [])))(memory.delete(g, g.memory_item.where("label = 'Context' and id like 'B_'"))),
    dump_sql(item=("memory_item WHERE NOT (label = 'Context' AND id LIKE 'B_')", ["label", "id"], []), ref=("code_ref c WHERE EXISTS (SELECT 1 FROM refers_to r WHERE r.target_type = c.target_type AND r.key = c.key AND r.id NOT IN (SELECT id FROM memory_item WHERE label = 'Context' AND id LIKE 'B_'))", ["target_type", "key"], []), refers=("refers_to WHERE id NOT IN (SELECT id FROM memory_item WHERE label = 'Context' AND id LIKE 'B_')", ["id", "key"], [])))
add("q27_link_code_ref", lambda g, t: memory.link_ref(g, g.memory_item.where("label = 'Rule'").select("label", "id", F.lit("Class").alias("target_type"), F.lit("supplier.1").alias("key"))).refers_to, "SELECT * FROM refers_to UNION SELECT 'Rule', id, 'Class', 'supplier.1' FROM memory_item WHERE label = 'Rule'")
add("q28_refresh_chunk", lambda g, t: memory.refresh_chunks(g, g.memory_item.where("label = 'Rule'")).memory_chunk.select("id"), "SELECT 'MCH-Rule-' || id AS id FROM has_item WHERE label = 'Rule'")
add("q29_classes", lambda g, t: analytics.classes(g), "SELECT fqn, name, visibility FROM type_node WHERE label = 'Class'")
add("q29_public_api", lambda g, t: analytics.public_api(g, "supplier.7"), "SELECT signature, return_type FROM method JOIN declares d ON member_label = 'Method' AND member_key = signature WHERE d.owner_fqn = 'supplier.7' AND visibility = 'public'")
add("q29_open_tasks", lambda g, t: analytics.memories(g, "Task", status="todo"), "SELECT label, id, title FROM memory_item WHERE label = 'Task' AND status = 'todo'")
add("q29_memory_for_class", lambda g, t: analytics.memories_of(g, "Class", "supplier.9"), "SELECT label, id, title FROM memory_item m WHERE EXISTS (SELECT 1 FROM refers_to r WHERE r.label = m.label AND r.id = m.id AND target_type = 'Class' AND key = 'supplier.9')")
