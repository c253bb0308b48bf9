"""A project's graph: named frames that operators replace, and the versioned store that keeps them."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from . import schema


class Graph:
    """Immutable mapping of table to frame. ``g.method`` reads a table; ``g.replace(method=df)`` is a new graph."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None):
        unknown = set(tables or ()) - set(schema.TABLES)
        if unknown:
            raise ValueError(f"no such table: {sorted(unknown)}")
        self.spark, self.tables = spark, dict(tables or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in schema.TABLES:
            raise AttributeError(name)
        if name not in self.tables:
            self.tables[name] = schema.empty(self.spark, name)
        found = self.tables[name]
        if callable(found):  # a table that is built when it is first read
            found = self.tables[name] = found()
        return found

    def replace(self, **tables: DataFrame) -> Graph:
        return Graph(self.spark, self.tables | tables)

    def views(self) -> None:
        """Registers every table as a temporary view, for read-only SQL."""
        for name in schema.TABLES:
            getattr(self, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: ends a loop's lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/graph-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Snapshots of projects. ``<root>/<project>/snapshots/<N>.json`` names the folder of each table, ``tables/<table>-<id>`` hold them.

    A commit writes the tables that changed since the snapshot that the graph was read from, then renames its list to the next number, which
    either happens or doesn't: readers see the last whole snapshot, a failed run leaves the old one, and a second writer that comes to the same number fails.
    The last two snapshots stay readable.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _versions(self, project: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.root}/{project}/snapshots") if n.endswith(".json") and n[:-5].isdigit())

    def version(self, project: str) -> int:
        return max(self._versions(project), default=0)

    def _folders(self, project: str, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.root}/{project}/snapshots/{version}.json").first()[1])

    def read(self, project: str, version: int | None = None) -> Graph:
        folders = self._folders(project, self.version(project) if version is None else version)
        tables = {t: self.spark.read.schema(schema.struct(t)).parquet(f"{self.root}/{project}/tables/{f}") for t, f in folders.items() if t in schema.TABLES}
        for t, df in tables.items():
            df._folder = (self.root, project, folders[t])  # what a commit need not write again
        return Graph(self.spark, tables)

    def commit(self, project: str, graph: Graph) -> Graph:
        base, version = f"{self.root}/{project}", self.version(project) + 1
        folders = {}
        for name in list(graph.tables):
            df = getattr(graph, name)
            kept = getattr(df, "_folder", None)
            if kept and kept[:2] == (self.root, project):
                folders[name] = kept[2]
            else:
                folders[name] = f"{name}-{uuid.uuid4().hex}"
                schema.conform(df, name).write.parquet(f"{base}/tables/{folders[name]}")
        temporary, final = self._path(f"{base}/snapshots/{uuid.uuid4().hex}.tmp"), self._path(f"{base}/snapshots/{version}.json")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise RuntimeError(f"another run has written snapshot {version} of {project}")
        versions = self._versions(project)
        used = {f for v in versions[-2:] for f in self._folders(project, v).values()}
        gone = {f for v in versions[:-2] for f in self._folders(project, v).values()} - used
        for v in versions[:-2]:
            self._fs.delete(self._path(f"{base}/snapshots/{v}.json"), False)
        for f in gone:
            self._fs.delete(self._path(f"{base}/tables/{f}"), True)
        return self.read(project)

    def drop(self, project: str | None = None) -> None:
        """Drops one project, or everything."""
        self._fs.delete(self._path(self.root if project is None else f"{self.root}/{project}"), True)
