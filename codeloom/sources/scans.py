"""Scans of stored state (S16-S23); S24 is :func:`codeloom.operators.refs.unresolved`, S25 :func:`codeloom.operators.rag.memory_sources`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph
from ..operators.merge import within, without


def in_root(root: str):
    return (F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/")


def files_in_root(g: Graph, root: str, language: str | None = None) -> DataFrame:
    """Files at or below a source root, by path."""
    rows = g.file.where(in_root(root))
    rows = rows if language is None else rows.where(F.col("language") == language)
    return rows.select("path").orderBy("path")


def files_outside_root(g: Graph, root: str) -> DataFrame:
    """S18."""
    return g.file.where(~in_root(root)).select("path")


def last_modified(g: Graph, paths: DataFrame, language: str, cache_key: str = "") -> DataFrame:
    """Stored times of files of a language analysed with the same key; but for Java, only of files that define a module."""
    rows = within(g.file.where((F.col("language") == language) & (F.coalesce("analysis_cache_key", F.lit("")) == cache_key)), paths, path="path")
    if language != "java":
        modules = g.type_node.where((F.col("label") == "Class") & (F.col("kind") == "module") & (F.col("language") == language))
        rows = within(rows, within(g.defines.where("label = 'Class'"), modules, key="fqn"), path="path")
    return rows.select("path", "last_modified")


def missing_chunks(g: Graph, paths: DataFrame) -> DataFrame:
    """Paths without a chunk, in order."""
    return without(paths.select("path").distinct(), g.code_chunk, path="path").orderBy("path")


def root_hints(g: Graph, language: str) -> DataFrame:
    """For each file the smallest module path of what it defines; for Java the smallest name of a package that contains it."""
    own = g.defines.where(F.col("label").isin(*schema.TYPE_LABELS)).join(g.type_node.where(F.col("language") == language).select("label", F.col("fqn").alias("key"), "module_path"), ["label", "key"])
    if language == "java":
        packages = within(g.contains.where("src_label = 'Package'"), g.package.where("language = 'java'"), src_key="name")
        own = own.join(packages.select(F.col("dst_label").alias("label"), F.col("dst_key").alias("key"), F.col("src_key").alias("hint")), ["label", "key"])
    else:
        own = own.where("module_path <> ''").withColumn("hint", F.col("module_path"))
    return own.groupBy("path").agg(F.min("hint").alias("source_root_hint"))


def root_hint(g: Graph, path: str, language: str) -> DataFrame:
    return root_hints(g, language).where(F.col("path") == path).select("source_root_hint")


def languages_in_root(g: Graph, root: str) -> DataFrame:
    """S23."""
    own = g.file.where(in_root(root)).select("language").distinct()
    return own.join(g.code, "language").join(g.language.select(F.col("name").alias("language_name")), "language_name", "left_semi").select("language", "language_name").orderBy("language")


def unchanged(g: Graph, files: DataFrame) -> DataFrame:
    """Files (``path, last_modified``) whose stored time is equal and positive and that have chunks: those a run can skip."""
    stored = g.file.where("last_modified > 0").select("path", "last_modified")
    return within(files.join(stored, ["path", "last_modified"], "left_semi"), g.code_chunk, path="path").select("path")
