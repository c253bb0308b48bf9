"""The engine: full and incremental ingest of a source tree into a project's graph, wipes, embeddings, watch."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.names import language as normal_language
from .graph import Graph, Store, cut
from .operators import calls, deletes, edges, metrics, rag, refs, upserts
from .operators.merge import within, without
from .sources import discovery, java_decl, python_ast, records, scans

NAMES = {"java": "Java", "js": "JavaScript", "python": "Python"}
PARSERS = {"python": python_ast.parse, "java": java_decl.parse}


class _Settler:
    """Writes the tables that an operator changed to the shared folder, so that plans stay short whatever the number of operators."""

    def __init__(self, g: Graph):
        self.known = {id(df) for df in g.tables.values()}
        self.kept = list(g.tables.values())

    def __call__(self, g: Graph) -> Graph:
        out = {}
        for name, df in g.tables.items():
            if id(df) not in self.known:
                df = cut(schema.conform(df, name), name)
                self.known.add(id(df))
                self.kept.append(df)
            out[name] = df
        return Graph(g.spark, out)


class Engine:
    """``Engine(spark, store_dir, project).ingest(root)``; results are summaries of what was done.

    A run reads the last snapshot, applies records of changed files as frames, and commits a new snapshot as a whole. Files
    that can't be parsed are reported and change nothing, neither by upserts nor by deletes. Languages without a parser here
    enter as ready-made records (``extra``), whose ``path`` must be among the discovered files.
    """

    def __init__(self, spark: SparkSession, store_dir: str, project: str, embedder: rag.Embedder | None = None):
        self.spark, self.project, self.embedder = spark, project, embedder
        self.store = Store(spark, store_dir)
        self.stats = metrics.RunStats()

    @property
    def graph(self) -> Graph:
        return self.store.read(self.project)

    def wipe(self, code: bool = False, memories: bool = False, code_rag: bool = False, memory_rag: bool = False) -> None:
        g = self.graph
        if code:
            g = deletes.wipe_code(g)
        if memories:
            g = deletes.wipe_memories(g)
        g = deletes.wipe_rag(g, code_rag, memory_rag)
        self.store.commit(self.project, g)

    def ingest(self, root: str, extra: DataFrame | None = None, incremental: bool = True) -> dict[str, int]:
        """Discovery, skip test, extraction, write, missing files, resolution, references, chunks."""
        with self.stats.phase("discover"):
            files = cut(discovery.assign(discovery.find(self.spark, root)), "files")
        g = self.graph
        todo = without(files, scans.unchanged(g, files), path="path") if incremental else files
        prefix = files.select(F.min(F.expr("substring(path, 1, length(path) - length(relative) - 1)")).alias("root")).first().root
        stored = g.file.where(scans.in_root(prefix)) if prefix else g.file.limit(0)
        missing = without(stored, files, path="path").select("path")
        return self._apply(g, files, todo, missing, extra, root)

    def ingest_changed_files(self, root: str, paths: list[str], extra: DataFrame | None = None) -> dict[str, int]:
        """The same for given paths: those that exist are read anew, those that don't are removed."""
        files = cut(discovery.assign(discovery.find(self.spark, root)), "files")
        named = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return self._apply(self.graph, files, within(files, named, path="path"), without(named, files, path="path"), extra, root)

    def remove_files(self, paths: list[str]) -> dict[str, int]:
        """Removes files and what only they define; nothing is read or resolved anew."""
        g = self.graph
        gone = within(g.file, self.spark.createDataFrame([(p,) for p in paths], "path string"), path="path").select("path")
        gone = cut(gone, "missing")
        self.store.commit(self.project, self.remove(g, gone, without(g.file, gone, path="path").select("path")))
        return {"ingested": 0, "skipped": 0, "failed": 0, "removed": gone.count()}

    def _apply(self, g: Graph, files: DataFrame, todo: DataFrame, missing: DataFrame, extra: DataFrame | None, root: str) -> dict[str, int]:
        todo, missing = cut(todo, "todo"), cut(missing, "missing")
        with self.stats.phase("extract"):
            texts = cut(discovery.read_texts(todo, root).join(todo.select("path", "relative", "language"), "path"), "texts")
            own = {l: texts.where(F.col("language") == l) for l in PARSERS}
            own["python"] = records.with_files(own["python"], files, python_ast.asked_files)
            found = [records.extract(own[l], parse) for l, parse in PARSERS.items()]
            if extra is not None:
                found.append(extra.select(*found[0].columns))
            recs = found[0]
            for f in found[1:]:
                recs = recs.unionByName(f)
            recs = cut(recs, "records")
        failed = recs.where("record = 'failed'").select("path").distinct()
        good = cut(without(todo, failed, path="path"), "good")
        recs = within(recs, good, path="path").where("record <> 'failed'")
        with self.stats.phase("write"):
            g = self.write(g, good, recs, texts)
        with self.stats.phase("missing"):
            gone = failed.isEmpty() and not missing.isEmpty()
            if gone:
                g = self.remove(g, missing, without(g.file, missing, path="path").select("path"))
        with self.stats.phase("resolve"):
            settle = _Settler(g)
            if not g.pending_call.isEmpty():
                g = settle(calls.resolve_direct(g))
                g = settle(calls.resolve(g))
            g = settle(deletes.delete_empty_packages(deletes.delete_phantom_methods(g)))
            g = settle(refs.refresh(g))
        if self.embedder is not None:
            with self.stats.phase("embed"):
                g = rag.refresh(g, self.project, "code", self.embedder, dirty_only=True)
        with self.stats.phase("commit"):
            self.store.commit(self.project, g)
        n = good.count()
        return {"ingested": n, "skipped": files.count() - todo.count(), "failed": failed.count(), "removed": missing.count() if gone else 0}

    def remove(self, g: Graph, paths: DataFrame, retained: DataFrame) -> Graph:
        """D10, D12, D8, D9, D11, D14 for files that are gone."""
        settle = _Settler(g)
        g = settle(deletes.delete_missing_pending(g, paths, None, retained))
        g = settle(deletes.delete_chunks(g, paths))
        g = settle(deletes.delete_missing_members(g, paths, None, retained))
        g = settle(deletes.delete_missing_owners(g, paths, None, retained))
        return settle(deletes.delete_empty_packages(deletes.delete_missing_files(g, paths)))

    def write(self, g: Graph, files: DataFrame, recs: DataFrame, texts: DataFrame) -> Graph:
        """All records of a batch, structure before calls: stale relations and definitions first, so counts are made anew."""
        settle, paths = _Settler(g), files.select("path")
        types = recs.where("record in ('module', 'type')")
        members = recs.where("record = 'member'")
        definitions = types.select("path", "label", F.col("fqn").alias("key")).unionByName(members.select("path", "label", F.coalesce("signature", "fqn").alias("key"))).distinct()
        definitions = cut(definitions, "definitions")
        kinds = {(r.record, r.kind) for r in recs.groupBy("record", F.coalesce("relation", "label", "owner_kind").alias("kind")).agg(F.count("*")).collect()}  # a few dozen
        has = lambda record, *which: any(r == record and (not which or k in which) for r, k in kinds)
        if not g.file.isEmpty():
            g = settle(deletes.delete_stale_relations(g, paths, definitions))
            g = settle(deletes.delete_stale_definitions(g, paths, definitions))
        langs = files.select("language").distinct().withColumn("source_root", F.lit("."))
        named = F.coalesce(F.element_at(F.create_map(*(x for k, v in NAMES.items() for x in (F.lit(k), F.lit(v)))), F.col("language")), F.initcap("language"))
        g = settle(upserts.project_root(g, self.project))
        g = settle(upserts.project(g, langs.withColumn("language_name", named), int(time.time() * 1000)))
        g = settle(upserts.files(g, files.select("path", "last_modified", "language", F.lit("").alias("analysis_cache_key"), F.lit("").alias("retained_source_token"))))
        g = settle(upserts.packages(g, types.select(F.col("package").alias("name"), "language").where("name is not null")))
        rows = types.withColumnRenamed("package", "package_name").withColumn("module_path", F.col("module"))
        for label in ("Class", "Interface", "Annotation"):
            if has("type", label) or has("module", label):
                g = settle(upserts.types(g, rows.where(F.col("label") == label), label))
        relation = recs.where("record = 'relation'").select("child", "target", "target_name", F.regexp_replace("target", r"\.?[^.]*$", "").alias("target_package"), "language", "relation")
        if has("relation", "classExtends"):
            g = settle(edges.extends(g, relation.where("relation = 'classExtends'"), "Class"))
        if has("relation", "interfaceExtends"):
            g = settle(edges.extends(g, relation.where("relation = 'interfaceExtends'"), "Interface"))
        if has("relation", "implements"):
            g = settle(edges.implements(g, relation.where("relation = 'implements'")))
        if has("member", "Method"):
            g = settle(upserts.methods(g, members.where("label = 'Method'").withColumn("return_type", F.col("type"))))
        if has("member", "Field"):
            g = settle(upserts.fields(g, members.where("label = 'Field'")))
        notes = recs.where("record = 'annotation'").select("owner", F.col("annotation").alias("target"), F.col("name").alias("target_name"), F.regexp_replace("annotation", r"\.?[^.]*$", "").alias("target_package"), "language", "owner_kind")
        if has("annotation"):
            g = settle(edges.annotate(g, notes.where("owner_kind <> 'method'")))
        if has("annotation", "method"):
            g = settle(edges.annotate_methods(g, notes.where("owner_kind = 'method'").withColumnRenamed("owner", "signature")))
        if has("call"):
            g = settle(edges.calls(g, recs.where("record = 'call'").select("caller", "callee", F.lit(1).alias("count"))))
        by_name = recs.where("record = 'callByName'").select(F.col("caller").alias("caller_signature"), F.col("callee_owner").alias("callee_owner_fqn"), "callee_name", F.lit(1).alias("count"), "allow_name_only")
        if has("callByName"):
            g = settle(edges.calls_by_name(g, by_name.where("callee_owner_fqn <> ''")))
        if has("callByName"):
            g = settle(edges.pending_calls(g, by_name.where("callee_owner_fqn = ''")))
        chunks = cut(rag.code_chunks(g, within(texts, files, path="path").where("text is not null").select("path", "text")), "chunks")
        if not g.code_chunk.isEmpty():
            g = settle(deletes.delete_chunks(g, paths, chunks.select("id")))
        g = settle(upserts.code_chunks(g, chunks))
        g = settle(edges.link_chunks(g, chunks.select("id", "source_label", "source_id")))
        return g

    def refresh_embeddings(self, target: str = "code", dirty_only: bool = False) -> None:
        if self.embedder is None:
            raise ValueError("the engine has no embedder")
        g = self.graph
        if target == "memory":
            g = rag.refresh_memory_chunks(g)
        self.store.commit(self.project, rag.refresh(g, self.project, target, self.embedder, dirty_only))

    def metrics(self) -> DataFrame:
        return metrics.metrics(self.graph).orderBy("position").select("metric", "value")


__all__ = ["Engine", "normal_language"]
