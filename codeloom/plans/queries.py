"""One query for each operator of the survey over the projected graph, with its oracle.

A query that changes the graph returns the tables it changed, as text rows ``tbl, k, v``. Batches for upserts and change sets
for deletes are made from whole tables by the rules below, mirrored in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph
from ..operators import analytics, calls, deletes, edges, hierarchy, memory, metrics, rag, refs, upserts
from ..operators.merge import within
from ..sources import discovery, scans
from . import projection
from .projection import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, build: Callable[[Graph, Tables], DataFrame], sql: str | None = None, extra: str = "", stored: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(projection.graph(spark, sf_dir, stored), Tables(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = oracle(sql, extra)


def text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("~"))


def dump(**tables: tuple[DataFrame, list[str], list[str]]) -> DataFrame:
    """``tbl, k, v`` of frames, given as (frame, key columns, value columns)."""
    parts = [df.select(F.lit(t).alias("tbl"), F.concat_ws("|", *map(text, k)).alias("k"), F.concat_ws("|", *map(text, v)).alias("v") if v else F.lit("").alias("v")) for t, (df, k, v) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def dump_sql(**tables: tuple[str, list[str], list[str]]) -> str:
    join = lambda cs: " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cs) or "''"
    return " UNION ALL ".join(f"SELECT '{t}' AS tbl, {join(k)} AS k, {join(v)} AS v FROM {source}" for t, (source, k, v) in tables.items())


def merge_sql(stored: str, batch: str, columns: list[str], keys: list[str], definition: list[str] = [], reference: list[str] = [], rules: dict[str, str] = {}) -> str:  # noqa: B006
    """The merge rules in SQL, over a stored table o and a batch n of one row a key."""
    out = []
    for c in columns:
        if c in rules:
            out.append(f"{rules[c]} AS {c}")
        elif c in keys or c in reference:
            out.append(f"coalesce(o.{c}, n.{c}) AS {c}")
        elif c in definition:
            out.append(f"CASE WHEN n.{keys[0]} IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}")
        else:
            out.append(f"o.{c} AS {c}")
    return f"SELECT {', '.join(out)} FROM {stored} o FULL JOIN {batch} n ON " + " AND ".join(f"o.{k} = n.{k}" for k in keys)


# ---- sources and scans

def _odd() -> Column:
    """Paths in folders that are left out, in capitals, or with another ending."""
    k, path = F.col("k"), F.col("path")
    return F.when(k % 7 == 0, F.concat(F.lit("node_modules/"), path)).when(k % 7 == 1, F.concat(F.lit("vendor/"), path)).when(k % 7 == 2, F.upper(path)).when(k % 7 == 3, F.concat(path, F.lit(".txt"))).otherwise(path)


def _discover(g: Graph, t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    found = t.orders.select(k.alias("k"), projection.order_path(k, F.col("o_custkey")).alias("path")).select(_odd().alias("relative"))
    return discovery.assign(found.select(F.col("relative").alias("path"), "relative")).select("path", "adapter", "language")


add("s1_s6_discover_files", _discover, """SELECT DISTINCT path, adapter, CASE WHEN adapter = 'ctags' THEN 'go' ELSE adapter END AS language FROM (
  SELECT path, CASE WHEN path LIKE '%.java' THEN 'java' WHEN lower(path) LIKE '%.js' THEN 'js' WHEN lower(path) LIKE '%.py' THEN 'python' WHEN lower(path) LIKE '%.go' AND path NOT LIKE 'vendor/%' THEN 'ctags' END AS adapter FROM (
    SELECT CASE o_orderkey % 7 WHEN 0 THEN 'node_modules/' || path WHEN 1 THEN 'vendor/' || path WHEN 2 THEN upper(path) WHEN 3 THEN path || '.txt' ELSE path END AS path
    FROM (SELECT o_orderkey, """ + projection._PATH + """ AS path FROM orders))
  WHERE path NOT LIKE 'node_modules/%') WHERE adapter IS NOT NULL""")  # fmt: skip
add("s16_files_in_source_root", lambda g, t: scans.files_in_root(g, "src/m7"), "SELECT path FROM file WHERE path = 'src/m7' OR path LIKE 'src/m7/%'")
add("s17_files_in_root_by_language", lambda g, t: scans.files_in_root(g, "src/m7", "python"), "SELECT path FROM file WHERE path LIKE 'src/m7/%' AND language = 'python'")
add("s18_files_outside_root", lambda g, t: scans.files_outside_root(g, "src/m7"), "SELECT path FROM file WHERE NOT (path = 'src/m7' OR path LIKE 'src/m7/%')")
add("s19_module_mtimes", lambda g, t: scans.last_modified(g, g.file.select("path"), "js", "k1"), "SELECT path, last_modified FROM file f WHERE language = 'js' AND analysis_cache_key = 'k1' AND EXISTS (SELECT 1 FROM defines d JOIN type_node n ON n.label = 'Class' AND n.fqn = d.key AND n.kind = 'module' AND n.language = 'js' WHERE d.label = 'Class' AND d.path = f.path)")
add("s20_java_mtimes", lambda g, t: scans.last_modified(g, g.file.select("path"), "java", "k0"), "SELECT path, last_modified FROM file WHERE language = 'java' AND analysis_cache_key = 'k0'")
add("s21_paths_missing_chunks", lambda g, t: scans.missing_chunks(g, g.file.select("path").union(g.code_chunk.select("path"))), "SELECT DISTINCT path FROM (SELECT path FROM file UNION SELECT path FROM code_chunk) p WHERE path NOT IN (SELECT path FROM code_chunk)")
add("s22_root_hints_python", lambda g, t: scans.root_hints(g, "python"), "SELECT path, min(module_path) AS source_root_hint FROM defines d JOIN type_node n ON n.label = d.label AND n.fqn = d.key WHERE n.language = 'python' AND module_path <> '' GROUP BY 1")
add("s22_root_hints_java", lambda g, t: scans.root_hints(g, "java"), "SELECT path, min(src_key) AS source_root_hint FROM defines d JOIN type_node n ON n.label = d.label AND n.fqn = d.key JOIN contains c ON c.src_label = 'Package' AND c.dst_label = n.label AND c.dst_key = n.fqn JOIN package p ON p.name = c.src_key WHERE n.language = 'java' GROUP BY 1")
add("s23_languages_in_root", lambda g, t: scans.languages_in_root(g, "src/m7"), "SELECT DISTINCT f.language, c.language_name FROM file f JOIN code c ON c.language = f.language WHERE path LIKE 'src/m7/%'")

_TARGETS = """targets AS (SELECT 'Code' AS target_type, language AS key FROM code UNION ALL SELECT 'Package', language || ':' || name FROM package UNION ALL SELECT 'File', path FROM file
  UNION ALL SELECT label, fqn FROM type_node UNION ALL SELECT 'Method', signature FROM method UNION ALL SELECT 'Field', fqn FROM field),
resolves AS (SELECT r.* FROM code_ref r JOIN targets USING (target_type, key))"""
add("s24_unresolved_code_refs", lambda g, t: refs.unresolved(refs.refresh(g)), "SELECT target_type, key FROM code_ref WHERE target_type <> 'Widget' AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.target_type = code_ref.target_type AND t.key = code_ref.key)", _TARGETS)
add("s25_memory_sources", lambda g, t: rag.memory_sources(g).select("label", "id", "title", F.array_join("code_refs", ";").alias("code_refs")),
    "SELECT m.label, m.id, m.title, code_refs FROM memory_item m JOIN has_item h ON h.label = m.label AND h.id = m.id LEFT JOIN (SELECT label, id, string_agg(DISTINCT target_type || ' ' || key, ';' ORDER BY target_type || ' ' || key) AS code_refs FROM refers_to GROUP BY 1, 2) r ON r.label = m.label AND r.id = m.id")

# ---- node upserts: what is stored lacks the rows whose number ends in 3, 6 or 9; the batch changes those that end in 5 to 9


def _stored(df: DataFrame, c: str) -> DataFrame:
    return df.where(~F.col(c).rlike(r"[369](\(.*)?$"))


_STORED = lambda c: f"NOT regexp_matches({c}, '[369](\\(.*)?$')"
_BATCH = lambda c: f"regexp_matches({c}, '[56789](\\(.*)?$')"


def _batch(df: DataFrame, c: str) -> DataFrame:
    """Two rows for each changed key, told apart by ordinal and by visibility."""
    rows = df.where(F.col(c).rlike(r"[56789](\(.*)?$"))
    return rows.withColumn("ordinal", F.lit(1)).withColumn("visibility", F.lit("first")).unionByName(rows.withColumn("ordinal", F.lit(2)).withColumn("visibility", F.lit("second")))


_FILE_OF = "SELECT key, min(path) AS path FROM defines WHERE label = '{}' GROUP BY 1"


def _paths(g: Graph, label: str) -> DataFrame:
    return g.defines.where(F.col("label") == label).groupBy("key").agg(F.min("path").alias("path"))


def _u2(g: Graph, t: Tables) -> DataFrame:
    base = g.replace(code=g.code.where("language <> 'go'").withColumn("source_roots", F.array(F.lit("src/m1"))))
    rows = g.file.select("language", F.regexp_extract("path", "^src/m[0-9]+", 0).alias("source_root")).distinct().join(g.code.select("language", "language_name"), "language")
    out = upserts.project(base, rows, 7)
    return dump(code=(out.code.withColumn("roots", F.array_join(F.array_sort("source_roots"), ",")), ["language"], ["language_name", "roots", "last_ingested"]))


add("u2_upsert_project", _u2, dump_sql(code=("roots", ["language"], ["language_name", "roots", "7"])),
    "roots AS (SELECT language, any_value(language_name) AS language_name, string_agg(DISTINCT root, ',' ORDER BY root) AS roots FROM (SELECT f.language, language_name, regexp_extract(path, '^src/m[0-9]+') AS root FROM file f JOIN code USING (language) UNION SELECT language, language_name, 'src/m1' FROM code WHERE language <> 'go') GROUP BY 1)")


def _u1(g: Graph, t: Tables) -> DataFrame:
    out = upserts.project_root(g, "demo")
    return out.contains.where("src_label = 'Project'").select("src_key", "dst_label")


add("u1_project_root", _u1, "SELECT 'demo' AS src_key, 'Memory' AS dst_label")


def _u3(g: Graph, t: Tables) -> DataFrame:
    base = g.replace(file=g.file.where("path not like '%3.go'"), code=g.code.where("language <> 'js'"))
    rows = g.file.withColumn("last_modified", F.col("last_modified") + 1)
    out = upserts.files(base, rows)
    return dump(file=(out.file, ["path"], ["last_modified", "language", "retained_source_token"]), contains=(out.contains.where("dst_label = 'File'"), ["src_key", "dst_key"], []))


add("u3_upsert_file", _u3, dump_sql(file=("f3", ["path"], ["last_modified", "language", "token"]), contains=("c3", ["src_key", "dst_key"], [])),
    """f3 AS (SELECT path, last_modified + CASE WHEN language <> 'js' THEN 1 ELSE 0 END AS last_modified, language, CASE WHEN retained_source_token <> '' THEN retained_source_token WHEN path LIKE '%3.go' THEN NULL ELSE '' END AS token FROM file),
c3 AS (SELECT c.src_key, c.dst_key FROM contains c JOIN file f ON f.path = c.dst_key WHERE dst_label = 'File' AND (f.language = 'js' OR c.src_key = f.language) UNION SELECT language, path FROM file WHERE language <> 'js')""")  # fmt: skip
add("u4_upsert_package", lambda g, t: (lambda o: dump(package=(o.package, ["name", "language"], []), contains=(o.contains.where("dst_label = 'Package'"), ["src_key", "dst_key"], [])))(upserts.packages(g.replace(package=g.package.where("name <> 'region.2'")), g.package.unionByName(g.package.withColumn("language", F.lit("cobol"))))),
    dump_sql(package=("package", ["name", "language"], []), contains=("package", ["language", "name"], [])))

_TYPE_COLUMNS = schema.columns("type_node")


def _types(label: str):
    def run(g: Graph, t: Tables) -> DataFrame:
        own = g.type_node.where(F.col("label") == label)
        base = g.replace(type_node=_stored(own, "fqn"), package=g.package.where("name <> 'region.4'").unionByName(g.spark.createDataFrame([("segment", "java")], "name string, language string")), contains=g.contains.where("false"))
        first = g.file.agg(F.min("path").alias("p"))
        path = F.when(F.col("fqn").endswith("7"), "no/such/file").otherwise(F.col("p"))
        rows = _batch(own, "fqn").crossJoin(first).withColumn("path", path).withColumn("language", F.lit("java")).drop("label", "p")
        out = upserts.types(base, rows, label)
        shown = [c for c in _TYPE_COLUMNS if c not in ("label", "fqn")]
        return dump(node=(out.type_node, ["label", "fqn"], shown), contains=(out.contains, ["src_key", "dst_key"], []))

    return run


def _types_sql(label: str) -> tuple[str, str]:
    change = {"visibility": "'second'", "is_external": "false", "language": "'java'"}
    skip = upserts._NO_FLAGS[label]
    columns = ", ".join(f"{change.get(c, c)} AS {c}" for c in _TYPE_COLUMNS)
    extra = f"""own AS (SELECT * FROM type_node WHERE label = '{label}'), st AS (SELECT * FROM own WHERE {_STORED('fqn')}),
ba AS (SELECT {columns} FROM own WHERE {_BATCH('fqn')} AND fqn NOT LIKE '%7' AND package_name <> 'region.4'),
me AS ({merge_sql('st', 'ba', _TYPE_COLUMNS, ['label', 'fqn'], [c for c in _TYPE_COLUMNS if c not in ('label', 'fqn', *skip)])})"""
    return dump_sql(node=("me", ["label", "fqn"], [c for c in _TYPE_COLUMNS if c not in ("label", "fqn")]), contains=("ba", ["package_name", "fqn"], [])), extra


for _n, _l in (("u5_upsert_classes", "Class"), ("u6_upsert_interfaces", "Interface"), ("u7_upsert_annotations", "Annotation")):
    add(_n, _types(_l), *_types_sql(_l))

_METHOD_COLUMNS = schema.columns("method")


def _methods(label: str | None):
    def run(g: Graph, t: Tables) -> DataFrame:
        owner = F.regexp_extract("signature", r"^[a-z]+\.[0-9]+", 0)
        first = g.file.agg(F.min("path").alias("path"))
        rows = _batch(g.method, "signature").withColumn("owner", owner).drop("owner_fqn").crossJoin(first)
        base = g.replace(method=_stored(g.method, "signature"), declares=g.declares.where("false"), defines=g.defines.where("false"))
        out = upserts.methods(base, rows, label)
        return dump(method=(out.method, ["signature"], [c for c in _METHOD_COLUMNS if c != "signature"]), declares=(out.declares, ["owner_label", "owner_fqn", "member_key"], []))

    return run


def _methods_sql(label: str | None) -> tuple[str, str]:
    change = {"visibility": "'second'", "owner_fqn": "regexp_extract(signature, '^[a-z]+\\.[0-9]+')"}
    columns = ", ".join(f"{change.get(c, c)} AS {c}" for c in _METHOD_COLUMNS)
    where = "" if label is None else f" AND signature LIKE '{'supplier' if label == 'Class' else 'nation'}%'"
    extra = f"st AS (SELECT * FROM method WHERE {_STORED('signature')}), ba AS (SELECT {columns} FROM method WHERE {_BATCH('signature')}{where}), me AS ({merge_sql('st', 'ba', _METHOD_COLUMNS, ['signature'], _METHOD_COLUMNS[1:])}), de AS (SELECT CASE WHEN signature LIKE 'nation%' THEN 'Interface' ELSE 'Class' END AS l, owner_fqn, signature FROM ba)"
    return dump_sql(method=("me", ["signature"], _METHOD_COLUMNS[1:]), declares=("de", ["l", "owner_fqn", "signature"], [])), extra


for _n, _l in (("u8a_upsert_class_methods", "Class"), ("u8b_upsert_interface_methods", "Interface"), ("u8d_upsert_methods", None)):
    add(_n, _methods(_l), *_methods_sql(_l))
_FIELD_COLUMNS = schema.columns("field")


def _fields(label: str | None):
    def run(g: Graph, t: Tables) -> DataFrame:
        rows = _batch(g.field, "name").withColumn("owner", F.substring_index("fqn", "#", 1)).crossJoin(g.file.agg(F.min("path").alias("path")))
        twin = g.type_node.where("label = 'Class' and fqn like '%4'").withColumn("label", F.lit("Interface"))
        out = upserts.fields(g.replace(type_node=g.type_node.unionByName(twin), field=_stored(g.field, "name"), declares=g.declares.where("false"), defines=g.defines.where("false")), rows, label)
        return dump(field=(out.field, ["fqn"], _FIELD_COLUMNS[1:]), declares=(out.declares, ["owner_label", "owner_fqn", "member_key"], []))

    return run


_FIELDS_SQL = f"st AS (SELECT * FROM field WHERE {_STORED('name')}), ba AS (SELECT * REPLACE ('second' AS visibility) FROM field WHERE {_BATCH('name')}), me AS ({merge_sql('st', 'ba', _FIELD_COLUMNS, ['fqn'], _FIELD_COLUMNS[1:])}), de AS (SELECT 'Class' AS l, split_part(fqn, '#', 1) AS o, fqn FROM ba{{}})"
add("u9a_upsert_class_fields", _fields("Class"), dump_sql(field=("me", ["fqn"], _FIELD_COLUMNS[1:]), declares=("de", ["l", "o", "fqn"], [])), _FIELDS_SQL.format(""))
add("u9d_upsert_fields", _fields(None), dump_sql(field=("me", ["fqn"], _FIELD_COLUMNS[1:]), declares=("de", ["l", "o", "fqn"], [])), _FIELDS_SQL.format(" UNION ALL SELECT 'Interface', split_part(fqn, '#', 1), fqn FROM ba WHERE split_part(fqn, '#', 1) LIKE '%4'"))


def _u10(g: Graph, t: Tables) -> DataFrame:
    c = g.code_chunk
    rows = c.where("id not like '%0'").select(*[x for x in c.columns if not x.startswith("embedding")]).withColumn("text_hash", F.when(F.col("id").endswith("5"), "changed").otherwise(F.col("text_hash")))
    out = upserts.code_chunks(g.replace(code_chunk=c.where("id not like '%3'")), rows)
    return dump(chunk=(out.code_chunk.withColumn("has", F.col("embedding").isNotNull()), ["id"], ["text_hash", "has", "embedding_model", "embedding_dimensions", "embedding_dirty"]))


add("u10_v1_upsert_code_chunks", _u10, dump_sql(chunk=("ch", ["id"], ["h", "has", "m", "d", "dirty"])),
    """ch AS (SELECT id, CASE WHEN id LIKE '%5' THEN 'changed' ELSE text_hash END AS h, embedding IS NOT NULL AND NOT gone AS has, CASE WHEN NOT gone THEN embedding_model END AS m, CASE WHEN NOT gone THEN embedding_dimensions END AS d,
  CASE WHEN gone THEN true WHEN id LIKE '%0' THEN embedding_dirty WHEN embedding IS NULL THEN true ELSE embedding_dirty END AS dirty FROM (SELECT *, id LIKE '%3' OR id LIKE '%5' AS gone FROM code_chunk))""")  # fmt: skip
add("u11_v13_upsert_memory_chunks", lambda g, t: (lambda o: dump(chunk=(o.memory_chunk, ["id"], ["source_label", "text_hash", "embedding_dirty"]), link=(o.has_rag_chunk, ["source_label", "source_key", "chunk_id"], [])))(rag.refresh_memory_chunks(g)),
    dump_sql(chunk=("mc", ["id"], ["label", "h", "true"]), link=("mc", ["label", "source", "id"], [])),
    """mc AS (SELECT 'MCH-' || m.label || '-' || m.id AS id, m.label, m.id AS source, sha256(regexp_replace(m.label || ': ' || CASE WHEN trim(coalesce(title, ''), E' \\t\\n\\r') <> '' THEN trim(title, E' \\t\\n\\r') ELSE m.id END || chr(10) || 'ID: ' || m.id || chr(10)
  || CASE WHEN status IS NOT NULL THEN 'Status: ' || status || chr(10) ELSE '' END || CASE WHEN severity IS NOT NULL THEN 'Severity: ' || severity || chr(10) ELSE '' END || CASE WHEN trim(coalesce(content, ''), E' \\t\\n\\r') <> '' THEN 'Content: ' || trim(content, E' \\t\\n\\r') || chr(10) ELSE '' END
  || CASE WHEN trim(coalesce(description, ''), E' \\t\\n\\r') <> '' THEN 'Description: ' || trim(description, E' \\t\\n\\r') || chr(10) ELSE '' END || CASE WHEN trim(coalesce(summary, ''), E' \\t\\n\\r') <> '' THEN 'Summary: ' || trim(summary, E' \\t\\n\\r') || chr(10) ELSE '' END
  || coalesce('CodeRefs: ' || code_refs || chr(10), ''), '\\s+$', '')) AS h
  FROM memory_item m JOIN has_item i ON i.label = m.label AND i.id = m.id LEFT JOIN (SELECT label, id, string_agg(DISTINCT target_type || ' ' || key, ', ' ORDER BY target_type || ' ' || key) AS code_refs FROM refers_to GROUP BY 1, 2) r ON r.label = m.label AND r.id = m.id)""")  # fmt: skip
add("u12_backfill_owners", lambda g, t: upserts.backfill_owners(g).method.select("signature", "owner_fqn", "owner_display_name"), "SELECT signature, coalesce(m.owner_fqn, d.owner_fqn) AS owner_fqn, coalesce(owner_display_name, n.name) AS owner_display_name FROM method m LEFT JOIN declares d ON d.member_label = 'Method' AND d.member_key = signature LEFT JOIN type_node n ON n.label = d.owner_label AND n.fqn = d.owner_fqn")
add("u13_retained_files", lambda g, t: upserts.retain(g, g.defines.where("label = 'Field'")), "SELECT path FROM file WHERE path IN (SELECT path FROM defines WHERE label = 'Field')")
add("u14_owner_kind_dispatch", lambda g, t: upserts.members(g, g.declares.select(F.col("owner_fqn").alias("owner"), F.when(F.col("owner_label") == "Interface", "interface").otherwise("class").alias("owner_kind"), "member_key")).select("owner_label", "owner", "member_key"), "SELECT owner_label, owner_fqn AS owner, member_key FROM declares")

# ---- edge upserts


def _relation(df: DataFrame, child: str, target: str) -> DataFrame:
    return df.select(child, F.col(target).alias("target"), F.concat(F.lit("N:"), target).alias("target_name"), F.lit("pkg").alias("target_package"), F.lit("java").alias("language"))


def _e12(label: str, size: int):
    def run(g: Graph, t: Tables) -> DataFrame:
        own = g.extends.where(F.col("label") == label).withColumn("parent", F.when(F.col("child").endswith("5"), F.concat("parent", F.lit("x"))).otherwise(F.col("parent")))
        base = g.replace(type_node=g.type_node.where("fqn not like '%7'"), extends=g.extends.where("false"))
        out = edges.extends(base, _relation(own, "child", "parent"), label)
        return dump(node=(out.type_node, ["label", "fqn"], ["name", "is_external"]), edge=(out.extends, ["label", "child", "parent"], []))

    return run


def _e12_sql(label: str) -> tuple[str, str]:
    extra = f"""kn AS (SELECT * FROM type_node WHERE fqn NOT LIKE '%7'), rel AS (SELECT child, CASE WHEN child LIKE '%5' THEN parent || 'x' ELSE parent END AS parent FROM extends WHERE label = '{label}'),
ph AS (SELECT DISTINCT '{label}' AS label, parent AS fqn FROM rel WHERE parent NOT IN (SELECT fqn FROM kn WHERE label = '{label}')),
nodes AS (SELECT label, fqn, name, CASE WHEN is_external IS NULL AND label = '{label}' AND fqn IN (SELECT parent FROM rel) THEN true ELSE is_external END AS is_external FROM kn UNION ALL SELECT label, fqn, 'N:' || fqn, true FROM ph)"""
    return dump_sql(node=("nodes", ["label", "fqn"], ["name", "is_external"]), edge=(f"(SELECT DISTINCT * FROM rel WHERE child IN (SELECT fqn FROM kn WHERE label = '{label}'))", [f"'{label}'", "child", "parent"], [])), extra


add("e1_class_extends", _e12("Class", 4), *_e12_sql("Class"))
add("e2_interface_extends", _e12("Interface", 2), *_e12_sql("Interface"))
add("e3_implements", lambda g, t: (lambda o: dump(node=(o.type_node.where("label = 'Interface'"), ["fqn"], ["name"]), edge=(o.implements, ["child", "parent"], [])))(edges.implements(g.replace(type_node=g.type_node.where("fqn not like '%7'"), implements=g.implements.where("false")), _relation(g.implements, "child", "parent"))),
    dump_sql(node=("(SELECT fqn, name FROM type_node WHERE label = 'Interface' AND fqn NOT LIKE '%7' UNION SELECT parent, 'N:' || parent FROM implements WHERE parent LIKE '%7')", ["fqn"], ["name"]), edge=("(SELECT * FROM implements WHERE child NOT LIKE '%7')", ["child", "parent"], [])))


def _e45(label: str | None):
    def run(g: Graph, t: Tables) -> DataFrame:
        rows = g.declares.where("member_label = 'Field'").select(F.col("member_key").alias("owner"), F.concat(F.lit("anno."), F.substring("member_key", -1, 1)).alias("a"))
        rows = rows.union(g.extends.select("child", F.lit("anno.type")))
        out = edges.annotate(g.replace(annotated_with=g.annotated_with.where("false")), rows.select("owner", F.col("a").alias("target"), F.col("a").alias("target_name"), F.lit("p").alias("target_package"), F.lit("java").alias("language")), label)
        return dump(node=(out.type_node.where("label = 'Annotation'"), ["fqn"], ["is_external"]), edge=(out.annotated_with, ["owner_label", "owner_key", "annotation"], []))

    return run


_E45 = "rows_ AS (SELECT fqn AS owner, 'anno.' || right(fqn, 1) AS a FROM field UNION ALL SELECT child, 'anno.type' FROM extends), own AS (SELECT label, fqn FROM type_node UNION ALL SELECT 'Field', fqn FROM field)"
_E45_NODES = "(SELECT fqn, is_external FROM type_node WHERE label = 'Annotation' UNION SELECT a, true FROM rows_)"
add("e4_field_annotated_with", _e45("Field"), dump_sql(node=(_E45_NODES, ["fqn"], ["is_external"]), edge=("(SELECT DISTINCT label, owner, a FROM rows_ JOIN own ON owner = fqn WHERE label = 'Field')", ["label", "owner", "a"], [])), _E45)
add("e5_annotated_with", _e45(None), dump_sql(node=(_E45_NODES, ["fqn"], ["is_external"]), edge=("(SELECT DISTINCT label, owner, a FROM rows_ JOIN own ON owner = fqn)", ["label", "owner", "a"], [])), _E45)
add("e6_method_annotated_with", lambda g, t: edges.annotate_methods(g.replace(annotated_with=g.annotated_with.where("false"), method=g.method.where("name not like '%7'")), g.annotated_with.select(F.col("owner_key").alias("signature"), F.col("annotation").alias("target"), F.col("annotation").alias("target_name"), F.lit("p").alias("target_package"), F.lit("java").alias("language"))).annotated_with,
    "SELECT a.* FROM annotated_with a JOIN method ON signature = owner_key WHERE name NOT LIKE '%7'")


def _e7(g: Graph, t: Tables) -> DataFrame:
    rows = g.calls.where("callee not like '%(R)'")
    base = g.replace(method=g.method.where("name not like '%7'"), calls=g.calls.withColumn("count", F.col("count") + 100))
    out = edges.calls(base, rows.unionByName(rows.withColumn("count", F.lit(None).cast("long"))))
    return dump(calls=(out.calls, ["caller", "callee"], ["count"]), phantom=(out.method.where("start_line is null"), ["signature"], []))


add("e7_upsert_calls", _e7, dump_sql(calls=("c7", ["caller", "callee"], ["n"]), phantom=("(SELECT DISTINCT callee FROM b7 WHERE callee NOT IN (SELECT signature FROM m7))", ["callee"], [])),
    """m7 AS (SELECT signature FROM method WHERE name NOT LIKE '%7'), b7 AS (SELECT * FROM calls WHERE callee NOT LIKE '%(R)' AND caller IN (SELECT signature FROM m7)),
c7 AS (SELECT caller, callee, CASE WHEN callee NOT LIKE '%(R)' AND caller IN (SELECT signature FROM m7) THEN count + 1 ELSE count + 100 END AS n FROM calls)""")  # fmt: skip
_NAMED = "known AS (SELECT owner_fqn, name, count(DISTINCT signature) AS n, min(signature) AS one FROM declares JOIN method ON member_label = 'Method' AND member_key = signature GROUP BY ALL)".replace("owner_fqn, name, count", "declares.owner_fqn, name, count")
add("e8_calls_by_name", lambda g, t: (lambda o: dump(calls=(o.calls, ["caller", "callee"], ["count"]), pending=(o.pending_call, calls.KEYS, ["count", "allow_name_only"])))(edges.calls_by_name(g.replace(pending_call=g.pending_call.where("false")), g.pending_call.where("callee_owner_fqn <> ''"))),
    dump_sql(calls=("(SELECT caller, callee, sum(count) AS n FROM (SELECT * FROM calls UNION ALL SELECT caller_signature, one, p.count FROM pending_call p JOIN known k ON k.owner_fqn = callee_owner_fqn AND name = callee_name WHERE n = 1) GROUP BY 1, 2)", ["caller", "callee"], ["n"]),
             pending=("(SELECT p.* FROM pending_call p WHERE callee_owner_fqn <> '' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.owner_fqn = callee_owner_fqn AND name = callee_name))", ["caller_signature", "callee_owner_fqn", "callee_name"], ["count", "false"])), _NAMED)
add("e9_pending_calls", lambda g, t: (lambda o: dump(pending=(o.pending_call, calls.KEYS, ["count", "allow_name_only"])))(edges.pending_calls(g.replace(method=g.method.where("name not like '%7'"), pending_call=g.pending_call.where("callee_owner_fqn = ''")), g.pending_call.unionByName(g.pending_call.withColumn("allow_name_only", F.lit(True))))),
    dump_sql(pending=("(SELECT p.*, EXISTS (SELECT 1 FROM method WHERE signature = caller_signature AND name NOT LIKE '%7') AS has FROM pending_call p) WHERE has OR callee_owner_fqn = ''", ["caller_signature", "callee_owner_fqn", "callee_name"], ["CASE WHEN has THEN count * 2 ELSE count END", "true"])))
add("e10_link_chunks", lambda g, t: edges.link_chunks(g, g.code_chunk.select("id", "source_label", F.lit("src").alias("x")).join(g.file.select(F.min("path").alias("source_id"))).drop("x")).has_rag_chunk, "SELECT 'File' AS source_label, (SELECT min(path) FROM file) AS source_key, id AS chunk_id FROM code_chunk")
