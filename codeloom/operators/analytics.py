"""Structural queries over a graph (Q1-Q21, Q29).

Rankings that are ours: hot paths rank by degree or length, text search by the number of query terms found, risk by the
sum of features; all ties go by name. A path is a test's if it has ``test`` or ``tests`` as a segment, or a file name that begins
or ends with ``test``. ``limit`` pages are top-k sorts over total orders (``offset`` skips rows).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import simple_name
from ..graph import Graph
from . import rag
from .hierarchy import closure
from .merge import first_rows, within

SINKS = ("run", "query", "write", "read", "save", "delete", "execute", "insert", "update", "send", "load", "store", "fetch", "flush")


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)tests?(/|$)") | F.lower(F.element_at(F.split(path, "/"), -1)).rlike(r"^test|tests?(\.[a-z0-9]+)?$")


def page(df: DataFrame, order: list, limit: int | None, offset: int = 0) -> DataFrame:
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def method_paths(g: Graph) -> DataFrame:
    """``signature, path``: one defining file for each method, the first by name."""
    return g.defines.where("label = 'Method'").groupBy(F.col("key").alias("signature")).agg(F.min("path").alias("path"))


def described(g: Graph) -> DataFrame:
    """Methods with owner, place and test flag."""
    m = g.method.select("signature", "name", "owner_fqn", "start_line", "end_line", "language").join(method_paths(g), "signature", "left")
    return m.withColumn("is_test", F.coalesce(is_test(F.col("path")), F.lit(False)))


def server_status(g: Graph) -> DataFrame:
    """Q1: ``section, name, value``."""
    count = lambda df, section, name: df.agg(F.count("*").cast("long").alias("value")).select(F.lit(section).alias("section"), name.alias("name") if isinstance(name, Column) else F.lit(name).alias("name"), "value")
    parts = [count(getattr(g, t), "graph", t) for t in ("file", "package", "type_node", "method", "field", "calls", "pending_call", "code_chunk")]
    items = g.memory_item.groupBy("label").agg(F.count("*").cast("long").alias("value")).select(F.lit("memory").alias("section"), F.col("label").alias("name"), "value")
    index = g.embedding_state.select(F.lit("index").alias("section"), F.col("index_name").alias("name"), F.col("dimensions").cast("long").alias("value"))
    out = items.unionByName(index)
    for p in parts:
        out = out.unionByName(p)
    return out


def quality_stats(g: Graph, include_tests: bool = False) -> DataFrame:
    """Q2: one row of sizes and shares over all methods and types."""
    m = described(g)
    m = m if include_tests else m.where(~F.col("is_test"))
    length = F.col("end_line") - F.col("start_line") + 1
    sizes = m.agg(
        F.count("*").alias("methods"), F.count(length).alias("measured"), F.coalesce(F.sum(length), F.lit(0)).cast("long").alias("lines"),
        F.coalesce(F.max(length), F.lit(0)).cast("long").alias("longest"), F.coalesce(F.sum(F.when(length > 50, 1).otherwise(0)), F.lit(0)).cast("long").alias("over_50_lines"),
        F.countDistinct("owner_fqn").alias("owners"),
    )
    calls = g.calls.agg(F.count("*").alias("call_edges"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("call_sites"))
    return sizes.crossJoin(calls)  # one row each


def hot_paths(g: Graph, section: str = "fanIn", limit: int | None = 5, include_tests: bool = False) -> DataFrame:
    """Q3: ``section, name, score`` by fanIn, fanOut, longestMethods or typeSize."""
    if section == "typeSize":
        rows = g.declares.groupBy(F.col("owner_fqn").alias("name")).agg(F.count("*").cast("long").alias("score"))
    else:
        m = described(g)
        m = m if include_tests else m.where(~F.col("is_test"))
        if section == "longestMethods":
            rows = m.where("start_line is not null and end_line is not null").select(F.col("signature").alias("name"), (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("score"))
        else:
            side = "callee" if section == "fanIn" else "caller"
            rows = g.calls.groupBy(F.col(side).alias("signature")).agg(F.count("*").cast("long").alias("score")).join(m.select("signature"), "signature").select(F.col("signature").alias("name"), "score")
    return page(rows.select(F.lit(section).alias("section"), "name", "score"), [F.col("score").desc(), "name"], limit)


def orientation(g: Graph, section: str, limit: int | None = None) -> DataFrame:
    """Q4: ``section, name, value`` by languages, packages, largestTypes or crossOwnerCalls (distinct calls between two owners, as ``a -> b``)."""
    n = F.count("*").cast("long").alias("value")
    if section == "languages":
        rows = g.file.groupBy(F.col("language").alias("name")).agg(n)
    elif section == "packages":
        rows = g.type_node.where("package_name is not null").groupBy(F.col("package_name").alias("name")).agg(n)
    elif section == "largestTypes":
        rows = g.declares.groupBy(F.col("owner_fqn").alias("name")).agg(n)
    else:
        owner = g.method.select("signature", "owner_fqn")
        both = g.calls.join(owner.select(F.col("signature").alias("caller"), F.col("owner_fqn").alias("a")), "caller").join(owner.select(F.col("signature").alias("callee"), F.col("owner_fqn").alias("b")), "callee")
        rows = both.where("a <> b").groupBy(F.concat("a", F.lit(" -> "), "b").alias("name")).agg(n)
    return page(rows.select(F.lit(section).alias("section"), "name", "value"), [F.col("value").desc(), "name"], limit)


def chunk_filter(kinds=None, path_prefixes=None, path_contains=None, owner_fragment=None, rag_roles=("file", "primary"), include_tests: bool = False) -> Column:
    keep = F.lit(True) if rag_roles is None else F.col("rag_role").isin(*rag_roles)
    if kinds:
        keep = keep & F.col("kind").isin(*kinds)
    if path_prefixes:
        any_ = F.lit(False)
        for p in path_prefixes:
            any_ = any_ | F.col("path").startswith(p)
        keep = keep & any_
    if path_contains:
        keep = keep & F.col("path").contains(path_contains)
    if owner_fragment:
        keep = keep & F.col("owner_fqn").contains(owner_fragment)
    return keep if include_tests else keep & ~F.coalesce(is_test(F.col("path")), F.lit(False))


def search(g: Graph, query: list[float], limit: int = 5, min_score: float | None = None, places: int | None = None, **filters) -> DataFrame:
    """Q5: the most similar chunks, one for each distinct (path, name, kind). With ``places`` scores are rounded before they are compared."""
    rows = g.code_chunk.where(F.col("embedding").isNotNull()).where(chunk_filter(**filters))
    score = rag.cosine(F.col("embedding"), F.lit([float(x) for x in query]).cast("array<double>"))
    scored = rows.withColumn("score", score if places is None else F.round(score, places)).where("score is not null")
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    best = scored.groupBy("path", "name", "kind").agg(F.max_by(F.struct("id", "owner_fqn", "start_line", "end_line", "score"), F.struct("score", "id")).alias("b"))
    best = best.select("b.id", "kind", F.col("b.owner_fqn").alias("owner"), "name", "path", "b.start_line", "b.end_line", "b.score")
    return page(best, [F.col("score").desc(), "id"], limit)


def text_search(g: Graph, query: str = "", all_terms: tuple[str, ...] = (), any_terms: tuple[str, ...] = (), path_contains: str | None = None, limit: int | None = 10) -> DataFrame:
    """Q6: chunks by how many distinct query terms their text, path or source id has (as parts of words, whatever the case)."""
    terms = tuple(dict.fromkeys(t.lower() for t in (*query.split(), *all_terms, *any_terms)))
    where = F.lower(F.concat_ws("\n", "text", "path", "source_id"))
    n = sum((where.contains(t).cast("int") for t in terms), F.lit(0))
    rows = g.code_chunk.withColumn("term_matches", n).where("term_matches > 0")
    for t in all_terms:
        rows = rows.where(where.contains(t.lower()))
    if any_terms:
        hit = F.lit(False)
        for t in any_terms:
            hit = hit | where.contains(t.lower())
        rows = rows.where(hit)
    if path_contains:
        rows = rows.where(F.col("path").contains(path_contains))
    return page(rows.select("id", "kind", "name", "path", "term_matches"), [F.col("term_matches").desc(), "id"], limit)


def discovery_context(g: Graph, anchors: DataFrame, neighbours: int = 3) -> DataFrame:
    """Q7: ``anchor, side, signature, count`` of at most ``neighbours`` callers and callees of each anchor (``id`` of a method's chunk)."""
    m = g.code_chunk.where("source_label = 'Method'").select("id", F.col("source_id").alias("anchor")).join(anchors.select("id"), "id")
    sides = m.join(g.calls.select(F.col("callee").alias("anchor"), F.col("caller").alias("signature"), "count"), "anchor").withColumn("side", F.lit("caller"))
    sides = sides.unionByName(m.join(g.calls.select(F.col("caller").alias("anchor"), F.col("callee").alias("signature"), "count"), "anchor").withColumn("side", F.lit("callee")))
    return first_rows(sides, ["anchor", "side"], [F.col("count").desc(), "signature"], neighbours).select("anchor", "side", "signature", "count")


def flow_context(g: Graph, query: str, vector: list[float] | None = None, limit_files: int = 3) -> DataFrame:
    """Q8: ``path, lexical, semantic, inner_calls, outer_calls``: files by their anchors, and the calls that touch them."""
    lexical = text_search(g, query, limit=None).groupBy("path").agg(F.max("term_matches").cast("double").alias("lexical"))
    rows = lexical.withColumn("semantic", F.lit(0.0))
    if vector is not None:
        semantic = search(g, vector, 50).groupBy("path").agg(F.max("score").alias("semantic"))
        rows = lexical.join(semantic, "path", "full").na.fill(0.0, ["lexical", "semantic"])
    files = page(rows, [(F.col("lexical") + F.col("semantic")).desc(), "path"], limit_files)
    p = method_paths(g)
    edges = g.calls.join(p.select(F.col("signature").alias("caller"), F.col("path").alias("a")), "caller").join(p.select(F.col("signature").alias("callee"), F.col("path").alias("b")), "callee")
    ends = edges.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("path"), (F.col("a") == F.col("b")).alias("inner"))
    count = ends.groupBy("path").agg(F.sum(F.col("inner").cast("long")).alias("inner_calls"), F.sum((~F.col("inner")).cast("long")).alias("outer_calls"))
    return files.join(count, "path", "left").na.fill(0, ["inner_calls", "outer_calls"])


def lookup_type(g: Graph, name: str | None = None, fqn: str | None = None, members: bool = False, limit: int | None = 10) -> DataFrame:
    """Q9."""
    rows = g.type_node.where((F.col("name") == name) if fqn is None else (F.col("fqn") == fqn))
    rows = page(rows.select("label", "fqn", "name", "kind", "visibility"), ["fqn", "label"], limit)
    own = within(g.declares, rows, owner_label="label", owner_fqn="fqn").groupBy(F.col("owner_label").alias("label"), F.col("owner_fqn").alias("fqn"))
    count = own.agg(F.count("*").alias("members"), *([F.array_sort(F.collect_list("member_key")).alias("member_keys")] if members else []))  # the members of one type, if asked for
    return rows.join(count, ["label", "fqn"], "left").withColumn("members", F.coalesce("members", F.lit(0)))


def lookup_methods(g: Graph, fragment: str, skip: int = 0, limit: int | None = 10, include_tests: bool = False) -> DataFrame:
    """Q10: methods whose signature has the fragment; those whose owner is a term of it come first."""
    terms = [t for t in re.split(r"[\s.#()]+", fragment) if t]
    m = described(g).where(F.col("signature").contains(fragment))
    m = m if include_tests else m.where(~F.col("is_test"))
    exact = (F.col("owner_fqn") == fragment) | simple_name(F.col("owner_fqn")).isin(*(terms or [""]))
    rows = m.select(F.coalesce(exact, F.lit(False)).cast("int").alias("owner_match"), F.col("owner_fqn").alias("owner"), "name", "signature", "path", "start_line", "end_line")
    return page(rows, [F.col("owner_match").desc(), "signature"], limit, skip)


def lookup_field(g: Graph, fragment: str, limit: int | None = 10) -> DataFrame:
    """Q11."""
    return page(g.field.where(F.col("fqn").contains(fragment) | F.col("name").contains(fragment)).select("fqn", "name", "type"), ["fqn"], limit)


def lookup_file(g: Graph, fragment: str = "", limit: int | None = 10) -> DataFrame:
    """Q12: files by path fragment with their numbers of definitions and chunks."""
    d = g.defines.groupBy("path").agg(F.count("*").alias("definitions"))
    c = g.code_chunk.groupBy("path").agg(F.count("*").alias("chunks"))
    rows = g.file.where(F.col("path").contains(fragment)).select("path", "language").join(d, "path", "left").join(c, "path", "left").na.fill(0, ["definitions", "chunks"])
    return page(rows, ["path"], limit)


def file_context(g: Graph, fragments: list[str], symbols: int = 8, limit_files: int | None = 5) -> DataFrame:
    """Q13: the outline of files: chunk counts by role, and their first symbols by line and name."""
    hit = F.lit(False)
    for f in fragments:
        hit = hit | F.col("path").contains(f)
    files = page(g.file.where(hit).select("path", "language"), ["path"], limit_files)
    roles = g.code_chunk.groupBy("path").pivot("rag_role", ["file", "primary", "secondary", "synthetic"]).count()
    own = g.defines.join(files.select("path"), "path").join(g.method.select(F.lit("Method").alias("label"), F.col("signature").alias("key"), "start_line"), ["label", "key"], "left")
    first = first_rows(own, ["path"], [F.coalesce("start_line", F.lit(0)), "key"], symbols).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("_rank", "key"))).alias("s"))
    rows = files.join(roles, "path", "left").join(first, "path", "left").join(own.groupBy("path").agg(F.count("*").alias("definitions")), "path", "left").na.fill(0)
    return rows.select("path", "language", "definitions", "file", "primary", "secondary", "synthetic", F.transform("s", lambda x: x["key"]).alias("symbols"))


def callers(g: Graph, fragment: str = "", limit: int | None = None, offset: int = 0, include_tests: bool = True) -> DataFrame:
    """Q14: the callers of methods whose signature has the fragment."""
    return _one_hop(g, "callee", "caller", fragment, limit, offset, include_tests)


def callees(g: Graph, fragment: str = "", limit: int | None = None, offset: int = 0, include_tests: bool = True) -> DataFrame:
    return _one_hop(g, "caller", "callee", fragment, limit, offset, include_tests)


def _one_hop(g: Graph, at: str, other: str, fragment: str, limit, offset, include_tests) -> DataFrame:
    m = described(g).select(F.col("signature").alias(other), F.col("owner_fqn").alias("owner"), "name", "path", "start_line", "end_line", "is_test")
    rows = g.calls.where(F.col(at).contains(fragment)).join(m, other)
    rows = rows if include_tests else rows.where(~F.col("is_test"))
    rows = rows.select(at, other, "count", "owner", "name", "path", "start_line", "end_line")
    return rows if limit is None and not offset else page(rows, [at, F.col("count").desc(), other], limit, offset)


def method_context(g: Graph, fragment: str = "", methods: int | None = 5, neighbours: int = 5) -> DataFrame:
    """Q15: methods with their first callers and callees by count."""
    m = lookup_methods(g, fragment, limit=methods, include_tests=True).select("signature", "owner", "name")
    out = m
    for at, other in (("callee", "caller"), ("caller", "callee")):
        own = g.calls.join(m.select(F.col("signature").alias(at)), at).select(F.col(at).alias("signature"), other, "count")
        best = first_rows(own, ["signature"], [F.col("count").desc(), other], neighbours).groupBy("signature").agg(F.array_sort(F.collect_list(F.struct("_rank", other))).alias("t"))
        side = own.groupBy("signature").agg(F.count("*").alias(f"n_{other}s")).join(best, "signature")
        side = side.select("signature", F.transform("t", lambda x: x[other]).alias(f"{other}s"), f"n_{other}s")  # noqa: B023
        out = out.join(side, "signature", "left")
    return out.na.fill(0, ["n_callers", "n_callees"])


def impact(g: Graph, targets: DataFrame, depth: int = 2, include_tests: bool = True) -> DataFrame:
    """Q16: ``target, caller, depth, path, is_test, crosses_file, crosses_package``: everything that reaches a target (``signature``) in ``depth`` calls."""
    edges = g.calls.select("callee", "caller").where("callee is not null and caller is not null")  # said here, so that all uses are one shuffle
    level = within(edges, targets, callee="signature").select(F.col("callee").alias("target"), F.col("caller").alias("node"))
    seen = level.withColumn("depth", F.lit(1))
    for d in range(2, depth + 1):
        level = level.join(edges, F.col("node") == F.col("callee")).select("target", F.col("caller").alias("node"))
        level = level.distinct() if d < depth else level  # of the last level the minimum below makes one row each
        seen = seen.unionByName(level.withColumn("depth", F.lit(d)))
    found = seen.where("target <> node").groupBy("target", "node").agg(F.min("depth").alias("depth")).withColumnRenamed("node", "caller")
    m = described(g).join(g.type_node.groupBy(F.col("fqn").alias("owner_fqn")).agg(F.min("package_name").alias("package")), "owner_fqn", "left")
    found = found.join(m.select(F.col("signature").alias("caller"), "path", "package", "is_test"), "caller").join(m.select(F.col("signature").alias("target"), F.col("path").alias("p"), F.col("package").alias("k")), "target")
    found = found if include_tests else found.where(~F.col("is_test"))
    return found.select("target", "caller", "depth", "path", "is_test", (~F.col("path").eqNullSafe(F.col("p"))).alias("crosses_file"), (~F.col("package").eqNullSafe(F.col("k"))).alias("crosses_package"))


def impact_files(found: DataFrame, limit: int | None = None) -> DataFrame:
    """The files view of :func:`impact`."""
    rows = found.groupBy("path").agg(F.countDistinct("caller").alias("callers"), F.min("depth").alias("depth"))
    return page(rows, [F.col("callers").desc(), "path"], limit)


def operation_hot_paths(g: Graph, sinks: tuple[str, ...] = SINKS, owner_fragment: str = "", limit: int | None = 10) -> DataFrame:
    """Q17: callers by their calls into methods that are named like operations."""
    sink = F.lit(False)
    for s in sinks:
        sink = sink | F.lower("name").startswith(s)
    m = g.method.where(sink).select(F.col("signature").alias("callee"))
    rows = g.calls.join(m, "callee").join(g.method.select(F.col("signature").alias("caller"), "owner_fqn"), "caller").where(F.coalesce("owner_fqn", F.lit("")).contains(owner_fragment))
    rows = rows.groupBy("caller").agg(F.count("*").alias("sinks"), F.sum("count").alias("sites"))
    return page(rows, [F.col("sites").desc(), "caller"], limit)


RISKS = {
    "unbounded_traversal": r"(?i)\*\d*\.\.(?!\d)|with\s+recursive",
    "repeated_subquery": r"(?i)call\s*\{|\(\s*select\b",
    "optional_per_row": r"(?i)optional\s+match|left\s+(outer\s+)?join\s+lateral",
    "broad_write": r"(?i)detach\s+delete|delete\s+from\s+\w+\s*(;|$)|update\s+\w+\s+set\b(?![\s\S]*\bwhere\b)",
    "write_in_loop": r"(?i)foreach\s*\([\s\S]*?\b(set|create|merge|delete)\b|unwind[\s\S]*?\b(merge|create)\b",
}


def risk_scan(rows: DataFrame, key: str, text: str = "text", limit: int | None = None) -> DataFrame:
    """Q18: counts of five patterns in query texts; rows are leads, not findings. ``repeated_subquery`` counts beyond the first."""
    cols = [F.regexp_count(F.col(text), F.lit(p)).cast("long").alias(n) for n, p in RISKS.items()]
    found = rows.select(key, *cols).withColumn("repeated_subquery", F.greatest(F.col("repeated_subquery") - 1, F.lit(0)))
    found = found.withColumn("risk", sum((F.col(n) for n in RISKS), F.lit(0)))
    return page(found.where("risk > 0"), [F.col("risk").desc(), key], limit)


def test_context(g: Graph, fragment: str = "", production_limit: int | None = 5) -> DataFrame:
    """Q19: test methods with the fragment and the production methods they call."""
    m = described(g)
    tests = m.where(F.col("is_test") & F.col("signature").contains(fragment)).select(F.col("signature").alias("caller"), F.col("path").alias("test_path"))
    rows = g.calls.join(tests, "caller").join(m.where(~F.col("is_test")).select(F.col("signature").alias("callee"), F.col("path").alias("production_path")), "callee")
    rows = rows.select(F.col("caller").alias("test"), "test_path", "callee", "production_path", "count")
    return page(rows, ["test", F.col("count").desc(), "callee"], production_limit)


def hierarchy(g: Graph, fqn: str | None = None) -> DataFrame:
    """Q20: ``fqn, relation, other, depth``: parents and ancestors, interfaces, children and implementors of one type or of all."""
    extends = g.extends.select("child", "parent")
    one = lambda df: df if fqn is None else df.where(F.col("fqn") == fqn)
    starts = None if fqn is None else g.spark.createDataFrame([(fqn,)], "start string")
    up = closure(extends, starts, "hierarchy")
    rows = up.select(F.col("start").alias("fqn"), F.when(F.col("depth") == 1, "parent").otherwise("ancestor").alias("relation"), F.col("node").alias("other"), "depth")
    one_step = lambda df, name, a, b: one(df.select(F.col(a).alias("fqn"), F.lit(name).alias("relation"), F.col(b).alias("other"), F.lit(1).alias("depth")))
    rows = rows.unionByName(one_step(extends, "child", "parent", "child")).unionByName(one_step(g.implements, "interface", "child", "parent"))
    return rows.unionByName(one_step(g.implements, "implementor", "parent", "child")).distinct()


_WRITES = re.compile(r"(?i)\b(insert|create|drop|alter|delete|update|merge|truncate|set|cache|refresh|add|load|msck|use|grant|revoke)\b")


def raw_read(g: Graph, query: str, limit: int = 200) -> DataFrame:
    """Q21: a read-only query over views named as the tables. Only SELECT and WITH are taken, one statement, ``limit`` rows."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'", "''", query)
    if not re.match(r"(?is)\s*(select|with)\b", bare) or ";" in bare or _WRITES.search(bare):
        raise ValueError("only a single read-only SELECT is allowed")
    g.views()
    return g.spark.sql(query).limit(limit)


# Q29: the common questions.


def classes(g: Graph) -> DataFrame:
    return g.type_node.where("label = 'Class'").select("fqn", "name", "visibility")


def public_api(g: Graph, fqn: str) -> DataFrame:
    own = g.declares.where((F.col("owner_fqn") == fqn) & (F.col("member_label") == "Method"))
    return within(g.method.where("visibility = 'public'"), own, signature="member_key").select("signature", "return_type")


def memories(g: Graph, label: str, **values: str) -> DataFrame:
    """Items of a kind with given field values: accepted decisions, open tasks, hard rules."""
    rows = g.memory_item.where(F.col("label") == label)
    for c, v in values.items():
        rows = rows.where(F.col(c) == v)
    return rows.select("label", "id", "title")


def memories_of(g: Graph, target_type: str, key: str) -> DataFrame:
    """Memory that refers to a file, class or other node."""
    refs = g.refers_to.where((F.col("target_type") == target_type) & (F.col("key") == key))
    return g.memory_item.join(refs.select("label", "id"), ["label", "id"], "left_semi").select("label", "id", "title")
