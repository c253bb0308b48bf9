"""Discovery of source files (S1-S6, S8): a frame of paths, the adapter that takes each, and its language."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "site-packages", ".tox", ".mypy_cache", ".pytest_cache", ".idea",
    ".gradle", ".next", "build", "dist", "target", "out", "coverage",
)
JS_EXTENSIONS = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts")
PYTHON_EXTENSIONS = ("py", "pyi")
#: Languages that only tags describe, by extension.
TAG_LANGUAGES = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "fs": "fsharp", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "kt": "kotlin",
    "scala": "scala", "swift": "swift", "lua": "lua", "pl": "perl", "r": "r", "sh": "sh", "sql": "sql", "ex": "elixir", "erl": "erlang", "hs": "haskell", "jl": "julia", "dart": "dart",
}
ADAPTERS = ("java", "js", "python", "ctags")  # the first that accepts a file has it
SOURCE_ROOTS = ("src/main/java", "src/test/java", "main/java", "test/java")


def extension(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.instr(name, ".") > 1, F.element_at(F.split(name, r"\."), -1)).otherwise(F.lit(""))


def in_skipped(relative: Column, names: tuple[str, ...] = SKIPPED) -> Column:
    """A folder on the way from the root is one of those left out."""
    parts = F.split(relative, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)))


def accepts(adapter: str, relative: Column) -> Column:
    """Whether an adapter takes a file by its path from the root. Java's test is case-sensitive."""
    low = F.lower(extension(relative))
    if adapter == "java":
        return relative.endswith(".java")
    if adapter == "js":
        return low.isin(*JS_EXTENSIONS) & ~in_skipped(relative)
    if adapter == "python":
        return low.isin(*PYTHON_EXTENSIONS)
    return low.isin(*TAG_LANGUAGES) & ~F.arrays_overlap(F.split(relative, "/"), F.array(F.lit("vendor")))


def language(adapter: Column, path: Column) -> Column:
    known = F.create_map(*(x for k, v in TAG_LANGUAGES.items() for x in (F.lit(k), F.lit(v))))
    return F.when(adapter == "ctags", F.element_at(known, F.lower(extension(path)))).otherwise(adapter)


def assign(files: DataFrame) -> DataFrame:
    """``path, relative`` with ``adapter`` and ``language``; files that no adapter takes, or in folders left out, go. One row a path, by path."""
    which = F.lit(None).cast("string")
    for a in reversed(ADAPTERS):
        which = F.when(accepts(a, F.col("relative")), F.lit(a)).otherwise(which)
    rows = files.where(~in_skipped(F.col("relative"))).withColumn("adapter", which).where("adapter is not null").dropDuplicates(["path"])
    return rows.withColumn("language", language(F.col("adapter"), F.col("path"))).orderBy("path")


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``path, relative, last_modified, size`` under a local folder, folders that are left out not entered."""
    base, rows = Path(root).resolve(), []
    for folder, folders, names in os.walk(base):
        folders[:] = sorted(f for f in folders if f not in SKIPPED)
        for n in sorted(names):
            p = Path(folder, n)
            try:
                s = p.stat()
                rows.append((str(p), p.relative_to(base).as_posix(), s.st_mtime_ns // 1_000_000, s.st_size))
            except OSError:
                rows.append((str(p), p.relative_to(base).as_posix(), -1, 0))
    return spark.createDataFrame(rows, "path string, relative string, last_modified long, size long")


def _plain(path: Column) -> Column:
    """A path without its scheme, from the root or the authority on."""
    return F.regexp_replace(path, r"^[a-z0-9]+:/*(?=/)", "")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """The same for any file system that Spark reads, listed by its executors; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    path, prefix = _plain(F.col("path")), root.split("://", 1)[-1].rstrip("/") + "/"
    prefix = prefix if prefix.startswith("/") else "/" + prefix
    return files.select(path.alias("path"), F.substring(path, F.lit(len(prefix) + 1), F.length(path)).alias("relative"), (F.unix_micros("modificationTime") / 1000).cast("long").alias("last_modified"), F.col("length").alias("size"))


def find(spark: SparkSession, root: str) -> DataFrame:
    """A local folder is walked; a root with a scheme is listed by Spark."""
    return listing(spark, root) if "://" in root else walk(spark, root)


def read_texts(files: DataFrame, root: str = "") -> DataFrame:
    """``path, text, error`` of each file, read by the executors; unreadable files of a local folder have a null text and an error."""
    if "://" in root:
        raw = files.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(_plain(F.col("path")).alias("path"), "content")
        text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\r\n"), F.lit("\n"))
        return raw.join(files.select("path"), "path", "left_semi").select("path", text.alias("text"), F.lit(None).cast("string").alias("error"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, errors = [], []
            for p in batch.column(0).to_pylist():
                try:
                    with open(p, encoding="utf-8", errors="replace", newline="") as f:
                        texts.append(f.read().replace("\r\n", "\n"))
                    errors.append(None)
                except OSError as e:
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.select("path").mapInArrow(run, "path string, text string, error string")


def java_roots(paths: list[str]) -> list[str]:
    """The folders that Java packages start from, found in paths of Java files."""
    found = set()
    for p in paths:
        for r in SOURCE_ROOTS:
            at = f"/{p}".find(f"/{r}/")
            if at >= 0:
                found.add(f"{p[:at]}{r}" if at == 0 else p[: at + len(r)])
                break
    return sorted(found)
