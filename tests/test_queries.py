"""Registered queries against their oracles in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from codeloom.plans import projection

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ("q14_code_callers", "q16_code_impact", "v11_vector_search", "u5_upsert_classes", "e8_calls_by_name", "r1_r8_resolve_refs", "m1_m16_metrics", "d2_stale_definitions_batch")

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the tables aren't here")


def rows(cursor, columns):
    names = [d[0] for d in cursor.description]
    return sorted(str([r[names.index(c)] for c in columns]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = rows(con.execute(__spark_entry__.oracle_sql()[name]), columns)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want and want


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_searches(spark):
    found = {r.vec_id: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    roles = {r.id: (r.rag_role, r.embedding) for r in projection.graph(spark, SF).code_chunk.where("embedding is not null").collect()}
    vectors = {i: r.embedding for i, r in found.items()}
    tried = {
        "v11_vector_search_all": (vectors, 20, lambda i: True), "v11_vector_search_filter_after_all": (vectors, 20, lambda i: found[i].label == 1),
        "q5_code_search_all": ({i: e for i, (role, e) in roles.items() if role in ("file", "primary")}, 25, lambda i: True), "q23_memory_search_all": ({str(i): e for i, e in vectors.items()}, 15, lambda i: True),
    }
    for name, (rows_, k, after) in tried.items():
        keys, m = list(rows_), np.array(list(rows_.values()), np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        want = set()
        for q in (i for i in found if i % 20 == 0):
            v = np.array(found[q].embedding, np.float64)
            best = sorted(zip((-np.round(m @ v / np.linalg.norm(v), 12)).tolist(), keys))[:k]
            want |= {(q, rank, i) for rank, (_, i) in enumerate(best, 1) if after(i)}
        got = __spark_entry__.queries()[name](spark, SF).collect()
        assert {(r.query_id, r["rank"], r.id) for r in got} == want and len(got) == len(want) and want


def test_all_anchors_and_targets(spark):
    edges = [(r.caller, r.callee, r["count"]) for r in projection.graph(spark, SF).calls.collect()]
    callers, sides = {}, {}
    for a, b, n in edges:
        callers.setdefault(b, set()).add(a)
        sides.setdefault((b, "caller"), []).append((-n, a))
        sides.setdefault((a, "callee"), []).append((-n, b))
    want = {(*k, s, -n) for k, v in sides.items() for n, s in sorted(v)[:3]}
    got = __spark_entry__.queries()["q7_discovery_context_all"](spark, SF).collect()
    assert {(r.anchor, r.side, r.signature, r["count"]) for r in got} == want and len(got) == len(want)
    want = {}
    for target, near in callers.items():
        for far in (y for x in near for y in callers.get(x, ())):
            want[target, far] = 2
        want |= {(target, x): 1 for x in near}
        want.pop((target, target), None)
    got = __spark_entry__.queries()["q16_code_impact_all"](spark, SF).collect()
    assert {(r.target, r.caller): r.depth for r in got} == want and len(got) == len(want)
    files = {}
    for r in got:
        files.setdefault(r.path, []).append((r.caller, r.depth))
    found = __spark_entry__.queries()["q16_impact_files_all"](spark, SF).collect()
    assert {r.path: (r.callers, r.depth) for r in found} == {p: (len({c for c, _ in v}), min(d for _, d in v)) for p, v in files.items()}


def test_all_chunks(spark):
    g = projection.graph(spark, SF)
    got = __spark_entry__.queries()["v12_code_chunk_text_all"](spark, SF).select("source_label", "source_id", "path").collect()
    want = [(r.label, r.key, r.path) for r in g.defines.collect()] + [("File", r.path, r.path) for r in g.file.select("path").union(g.code_chunk.select("path")).collect()]
    assert sorted(tuple(r) for r in got) == sorted(want) and {"Method", "Field", "Class", "File"} <= {r.source_label for r in got}


def test_search_ties_are_those_of_the_rounded_score(spark, tmp_path):
    """Scores that SQL shows as equal are ties by id, however their further places differ."""
    near = [[1.0, 1e-6 * (40 - i)] for i in range(40)]  # the later, the nearer to the query; all round to 1
    spark.createDataFrame([(i, v, i % 2) for i, v in enumerate([[1.0, 0.0], *near])], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    for t in set(TABLES) - {"embeddings"}:
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'embeddings' else ''}'")
    for name in ("v11_vector_search", "v11_vector_search_filter_after", "q5_code_search", "q23_memory_search"):
        df = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = rows(con.execute(__spark_entry__.oracle_sql()[name]), df.columns)
        assert sorted(str([r[c] for c in df.columns]) for r in df.collect()) == want and want, name


def _written(spark):
    from codeloom.graph import shared_dir

    return {f for f in os.listdir(shared_dir(spark).removeprefix("file://")) if f.startswith("graph-")}


def test_a_query_writes_only_what_it_reads_in_several_jobs(spark):
    """Tables of the graph are plans; a table that is read once, or not at all, isn't stored."""
    before = _written(spark)
    for name in ("q1_server_status", "u9b_upsert_interface_fields", "q17_operation_hot_paths", "q15_method_context"):
        __spark_entry__.queries()[name](spark, SF).collect()
    assert _written(spark) == before
    plan = projection.defines(projection.Tables(spark, SF))
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning(") <= 2  # line items and orders, by order


def test_calls_are_resolved_without_writing_them(spark):
    """Neither tier reads calls: what both settle is added in one aggregation, and no table of calls is written."""
    before = _written(spark)
    df = __spark_entry__.queries()["p2_resolve_pending_calls"](spark, SF)
    assert not [f for f in _written(spark) - before if f.startswith("graph-calls-")] and df.count()
