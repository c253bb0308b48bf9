"""Operators on small graphs: the cases that decide resolution, counts, deletes and references."""

import pytest

from codeloom import schema
from codeloom.functions import names
from codeloom.graph import Graph
from codeloom.operators import calls, deletes, edges, hierarchy, memory, metrics, upserts
from codeloom.sources import ctags


def graph(spark, **tables):
    made = {}
    for name, rows in tables.items():
        columns = schema.columns(name)
        made[name] = spark.createDataFrame([tuple(r.get(c) for c in columns) if isinstance(r, dict) else r for r in rows], schema.struct(name))
    return Graph(spark, made)


def method(sig, owner, line=1):
    return {"signature": sig, "name": sig.split("(")[0].rpartition(".")[2], "owner_fqn": owner, "start_line": line}


def got(df):
    return sorted(tuple(r) for r in df.collect())


def pending(caller, owner, name, n=1, loose=False):
    return (caller, owner, name, n, loose)


@pytest.fixture(scope="module")
def family(spark):
    kinds = [{"label": "Class", "fqn": f} for f in ("Base", "Middle", "Leaf", "Other")] + [{"label": "Interface", "fqn": f} for f in ("I", "J")]
    methods = [method("Base.refresh()", "Base"), method("Middle.refresh()", "Middle"), method("Leaf.load()", "Leaf"), method("J.only()", "J"), method("Other.two(a)", "Other"), method("Other.two(b)", "Other"), method("Other.lone()", "Other")]
    return {
        "type_node": kinds, "method": methods, "declares": [("Interface" if m["owner_fqn"] in "IJ" else "Class", m["owner_fqn"], "Method", m["signature"]) for m in methods],
        "extends": [("Class", "Leaf", "Middle"), ("Class", "Middle", "Base"), ("Class", "Base", "Leaf"), ("Interface", "I", "J")], "implements": [("Middle", "I")],
        "pending_call": [pending("Leaf.load()", "Leaf", "refresh", 2), pending("Leaf.load()", "Leaf", "only"), pending("Leaf.load()", "Other", "two"), pending("Leaf.load()", "", "lone"), pending("Other.lone()", "", "lone", 1, True), pending("Base.refresh()", "", "lone", 1, True)],
    }


def test_tiers(spark, family):
    out = calls.resolve_pending(graph(spark, **family))  # the heritage has a cycle on purpose
    assert got(out.calls) == [("Base.refresh()", "Other.lone()", 1), ("Leaf.load()", "J.only()", 1), ("Leaf.load()", "Middle.refresh()", 2)]
    assert got(out.pending_call.select("caller_signature", "callee_name")) == [("Leaf.load()", "lone"), ("Leaf.load()", "two"), ("Other.lone()", "lone")]


def test_scope_has_descendants_and_implementors(spark, family):
    g = graph(spark, **(family | {"extends": family["extends"][:2] + family["extends"][3:]}))
    none = lambda c: spark.createDataFrame([], f"{c} string")
    found = calls.scope(g, none("signature"), spark.createDataFrame([("J",)], "fqn string"), none("name"))
    assert {r.callee_owner_fqn for r in found.collect()} == {"Leaf"}


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(105)] + [("n105", "n0")], "child string, parent string")
    found = hierarchy.closure(edges, spark.createDataFrame([("n0",)], "start string"))
    assert got(found) == sorted([("n0", f"n{i}", i) for i in range(1, 106)] + [("n0", "n0", 106)])


def test_counts_replace_and_add(spark):
    g = graph(spark, method=[method("A.a()", "A"), method("B.b()", "B")], declares=[("Class", "B", "Method", "B.b()")])
    rows = spark.createDataFrame([("A.a()", "B.b()", None), ("A.a()", "B.b()", 1), ("A.a()", "X.x()", 1), ("no", "B.b()", 1)], "caller string, callee string, count int")
    once = edges.calls(g, rows)
    assert got(edges.calls(once, rows).calls) == got(once.calls) == [("A.a()", "B.b()", 2), ("A.a()", "X.x()", 1)]
    assert [r.signature for r in once.method.where("start_line is null").collect()] == ["X.x()"]
    named = spark.createDataFrame([("A.a()", "B", "b", 1), ("A.a()", "C", "c", 1)], "caller_signature string, callee_owner_fqn string, callee_name string, count int")
    more = edges.calls_by_name(once, named)
    assert ("A.a()", "B.b()", 3) in got(more.calls) and got(more.pending_call.select("callee_name")) == [("c",)]
    assert not got(deletes.delete_phantom_methods(more).calls.where("callee = 'X.x()'"))


def test_moved_definition_survives(spark):
    g = graph(spark, file=[{"path": "a"}, {"path": "b"}], method=[method("moved()", ""), method("caller()", "")], defines=[("a", "Method", "moved()"), ("c", "Method", "caller()")], calls=[("caller()", "moved()", 1)])
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    new = spark.createDataFrame([("b", "Method", "moved()")], schema.struct("defines"))
    out = deletes.delete_stale_definitions(g, paths, new)
    assert got(out.calls) == [("caller()", "moved()", 1)] and got(out.defines) == [("c", "Method", "caller()")]
    assert not got(deletes.delete_stale_definitions(g, paths, new, moved=False).calls)


def test_last_row_wins_and_anchors(spark):
    g = graph(spark, file=[{"path": "a"}], package=[("p", "java")])
    rows = spark.createDataFrame([("a", "p", "p.X", "first", 1), ("a", "p", "p.X", "second", 2), ("a", "q", "q.Y", "n", 1), ("z", "p", "p.Z", "n", 1)], "path string, package_name string, fqn string, name string, ordinal int").selectExpr("*", "'java' language")
    out = upserts.types(g, rows, "Class")
    assert got(out.type_node.select("fqn", "name", "is_external")) == [("p.X", "second", False)]


def test_memory_values(spark):
    g = Graph(spark)
    good = spark.createDataFrame([("Task", "T1", "todo")], "label string, id string, status string")
    g = memory.upsert(g, good)
    assert got(memory.orientation(g).select("id")) == [("T1",)]
    with pytest.raises(ValueError):
        memory.upsert(g, spark.createDataFrame([("Task", "T1", "maybe")], "label string, id string, status string"))
    with pytest.raises(ValueError):
        memory.upsert(g, spark.createDataFrame([("Task", "T1", "x")], "label string, id string, rationale string"))


def test_names_and_tags():
    assert names.module_fqn("python", "pkg/service.py") == "python.pkg.service$2e$py" and names.java_fqn("a.b.Outer.Inner") == "a.b.Outer$Inner" and names.language("C++") == "cpp"
    tags = [{"name": "Service", "kind": "struct", "scope": "main"}, {"name": "main", "kind": "package"}, {"name": "NewService", "kind": "function", "scope": "main", "signature": "(a int)"}]
    found = {r.get("fqn"): r for r in ctags.records("cmd/app.go", "go", tags) if r["record"] == "type"}
    main = next(f for f, r in found.items() if r["name"] == "main")
    assert f"{main}.Service" in found


def test_metric_table():
    table = metrics.table([("files", 3), ("calls", 1200)])
    assert metrics.same_table(table, table.replace("  ", " ")) and not metrics.same_table(table, metrics.table([("files", 4)]))


def test_excerpts_split_a_text_once(spark):
    """A text split in a lambda is split for each line."""
    from pyspark.sql import functions as F

    from codeloom.functions import text as tx

    text = "/* a\n b */\n\nint f() {\n}\n# x\n\n\ng"
    df = spark.createDataFrame([(text, 4, 5), (text, 9, 0), (text, 0, 0), (text, 40, 99), (text, 1, 3)], "text string, start_line int, end_line int").withColumn("lines", F.split("text", "\n", -1))
    found = tx.with_excerpt(df, "body", 6)
    assert [r.body for r in found.collect()] == ["/* a\n b */\n\nint f() {\n}", "# x\n\n\ng", "/* a", "# x\n\n\ng", "/* a\n b */\n"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 1
