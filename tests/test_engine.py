"""End to end: small source trees into a graph, again, changed, and watched."""

import os
import time

import pytest

from codeloom import schema
from codeloom.engine import Engine
from codeloom.graph import Graph, Store
from codeloom.operators import rag
from codeloom.sources import discovery, python_ast, records
from codeloom.streaming.watch import Watch, changes

BASE = "class Base:\n    def refresh(self):\n        pass\n\n\ndef helper():\n    return 1\n"
SERVICE = """from pkg.base import Base, helper
import pkg.base as base


@decorate
class Service(Base):
    # documented
    limit = 3

    def __init__(self):
        self.name = helper()

    def run(self):
        helper()
        helper()
        self.refresh()
        return self.stop()

    def stop(self):
        return base.helper()
"""
JAVA = "package com.example;\n\nimport java.util.List;\n\n/** A widget. */\npublic class Widget implements Describable {\n    private int size;\n\n    public String describe(List<String> names) {\n        return make(size);\n    }\n\n    static String make(int n) { return new Widget().toString(); }\n}\n"


def tree(root, **files):
    for name, text in files.items():
        path = os.path.join(root, name.replace("__", "/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)


def write(root, name, text):
    tree(root, **{name: text})


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ingest_again_and_change(spark, tmp_path):
    root, store = str(tmp_path / "src"), f"file://{tmp_path / 'store'}"
    tree(root, **{"pkg__base.py": BASE, "pkg__service.py": SERVICE, "com__Widget.java": JAVA, "bad.py": "def (", "node_modules__x.py": BASE})
    engine = Engine(spark, store, "demo", rag.HashEmbedder(16))
    assert engine.ingest(root) == {"ingested": 3, "skipped": 0, "failed": 1, "removed": 0}
    g = engine.graph
    service, base = "python.pkg.service$2e$py", "python.pkg.base$2e$py"
    assert (f"{service}.Service", f"{base}.Base") in {(c, p) for _, c, p in rows(g.extends)}
    got = {(a, b): n for a, b, n in rows(g.calls)}
    assert got[f"{service}.Service.run()", f"{base}.helper()"] == 2
    assert got[f"{service}.Service.run()", f"{base}.Base.refresh()"] == 1  # found in the superclass
    assert got[f"{service}.Service.run()", f"{service}.Service.stop()"] == 1
    assert got[f"{service}.Service.stop()", f"{base}.helper()"] == 1
    assert got["com.example.Widget.describe(List)", "com.example.Widget.make(int)"] == 1
    assert {f"{service}.Service#name", f"{service}.Service#limit", "com.example.Widget#size"} <= {r.fqn for r in g.field.collect()}
    assert ("com.example.Widget", "Describable") in rows(g.implements)
    assert all(r.embedding is not None and not r.embedding_dirty for r in g.code_chunk.collect())
    text = {r.name: r.text for r in g.code_chunk.where("source_label = 'Method'").collect()}
    assert text["describe"].startswith("Name: describe\nKind: method\nOwner: Widget\nWords: describe widget\nSource excerpt:")
    os.remove(os.path.join(root, "bad.py"))
    os.remove(os.path.join(root, "pkg/service.py"))
    assert engine.ingest(root) == {"ingested": 0, "skipped": 2, "failed": 0, "removed": 1}
    g = engine.graph
    assert not [r for r in g.method.collect() if r.signature.startswith(service)]
    assert not [r for r in g.calls.collect() if r.caller.startswith(service)]
    assert {r.metric: r.value for r in engine.metrics().collect()}["files"] == 2


def test_store_writes_what_changed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path / 'store'}")
    file = lambda *names: spark.createDataFrame([(n, 1, "python", "", "") for n in names], schema.struct("file"))
    package = spark.createDataFrame([("p", "java")], schema.struct("package"))
    first = store.commit("demo", Graph(spark, {"file": file("a"), "package": package}))
    folders = store._folders("demo", 1)
    second = store.commit("demo", first.replace(file=file("a", "b")))
    assert store._folders("demo", 2)["package"] == folders["package"] and store._folders("demo", 2)["file"] != folders["file"]
    assert store.read("demo", 1).file.count() == 1 and second.file.count() == 2 and second.package.count() == 1
    store.version = lambda project: 1  # a writer that doesn't know of the second snapshot
    with pytest.raises(RuntimeError):
        store.commit("demo", first)
    del store.version
    assert store.read("demo").file.count() == 2
    third = store.commit("demo", second.replace(file=file("c")))
    assert [r.path for r in third.file.collect()] == ["c"] and store._versions("demo") == [2, 3] and third.package.count() == 1
    assert folders["file"] not in os.listdir(tmp_path / "store/demo/tables") and folders["package"] in os.listdir(tmp_path / "store/demo/tables")
    store.drop()
    assert store.version("demo") == 0 and not store.read("demo").tables


def test_listed_tree_is_as_the_walked_one(spark, tmp_path):
    root = str(tmp_path / "src")
    tree(root, **{"pkg__base.py": BASE, "pkg__service.py": SERVICE, "build__x.py": BASE})
    a, b = (discovery.assign(discovery.find(spark, r)) for r in (root, f"file://{root}"))
    assert rows(a) == rows(b) and a.count() == 2
    texts = [rows(discovery.read_texts(f, r)) for f, r in ((a, root), (b, f"file://{root}"))]
    assert texts[0] == texts[1] and {t[1] for t in texts[0]} == {BASE, SERVICE}
    found = records.with_files(discovery.read_texts(a, root).join(a.select("path", "relative"), "path"), a, python_ast.asked_files)
    assert {r.relative: r.files for r in found.collect()} == {"pkg/base.py": None, "pkg/service.py": ["pkg/base.py"]}


def test_watch_of_deleted_files_alone(spark, tmp_path):
    root = str(tmp_path / "src")
    os.makedirs(root)
    engine = Recorder(spark)
    gone = os.path.join(root, "gone.py")
    engine.files = [(gone, 1, "python", "", "")]
    removed = []
    engine.remove_files = lambda paths: removed.extend(paths) or {"ingested": 0, "skipped": 0, "failed": 0, "removed": len(paths)}
    watch = Watch(spark, engine, root)
    watch.apply()  # the recorder's first batch fails
    assert removed == [gone] and watch.results == [{"ingested": 0, "skipped": 0, "failed": 0, "removed": 1}] and not watch.pending


class Recorder:
    """An engine that notes what it is asked to do, and fails at first."""

    def __init__(self, spark):
        self.spark, self.asked, self.files = spark, [], []

    @property
    def graph(self):
        return Graph(self.spark, {"file": self.spark.createDataFrame(self.files, schema.struct("file"))})

    def ingest_changed_files(self, root, paths):
        self.asked.append([os.path.relpath(p, root) for p in paths])
        if len(self.asked) == 1:
            raise RuntimeError("not yet")
        self.files = [(p, os.stat(p).st_mtime_ns // 1_000_000, "python", "", "") for p in paths if os.path.exists(p)]
        return {"ingested": len(self.files), "skipped": 0, "failed": 0, "removed": len(paths) - len(self.files)}


def test_watch_tries_again(spark, tmp_path):
    root = str(tmp_path / "src")
    tree(root, **{"pkg__base.py": BASE})
    watch = Watch(spark, Recorder(spark), root)
    query = watch.start(trigger="100 milliseconds", checkpoint=str(tmp_path / "check"))
    for _ in range(300):
        if len(watch.results) > 1:
            break
        time.sleep(0.1)
    query.stop()
    assert watch.engine.asked[:2] == [["pkg/base.py"], ["pkg/base.py"]] and watch.results[:2] == [{"failed": 1}, {"ingested": 1, "skipped": 0, "failed": 0, "removed": 0}]
    os.remove(os.path.join(root, "pkg/base.py"))
    watch.apply()
    assert watch.results[-1]["removed"] == 1 and not watch.pending


def test_changes(spark):
    a = spark.createDataFrame([("x", 1), ("y", 1)], "path string, last_modified long")
    b = spark.createDataFrame([("y", 2), ("z", 1)], "path string, last_modified long")
    assert rows(changes(a, b)) == [("x", "deleted"), ("y", "modified"), ("z", "created")]
