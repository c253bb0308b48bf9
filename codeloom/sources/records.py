"""Analysis records: what an extractor says about one file, in one nullable superset of columns.

``record`` is module, type, relation, member, annotation, call or callByName, or ``failed`` with an error. Records come from
:mod:`python_ast`, :mod:`java_decl` and :mod:`ctags`, or ready-made as JSON lines, which is how JavaScript and TypeScript
enter: no compiler for them is at hand here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = (
    "path", "language", "record", "package", "module", "label", "fqn", "name", "kind", "visibility", "owner", "owner_kind", "signature", "type", "relation", "child",
    "target", "target_name", "caller", "callee", "callee_owner", "callee_name", "annotation", "framework", "error",
)
FLAGS = ("is_abstract", "is_final", "is_enum", "is_record", "is_static", "is_synthetic", "allow_name_only")
NUMBERS = ("start_line", "end_line")
SCHEMA = ", ".join([f"{f} string" for f in FIELDS] + [f"{f} boolean" for f in FLAGS] + [f"{f} int" for f in NUMBERS])
_TYPES = {**dict.fromkeys(FIELDS, pa.string()), **dict.fromkeys(FLAGS, pa.bool_()), **dict.fromkeys(NUMBERS, pa.int32())}


def batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _TYPES.items()], names=list(_TYPES))


def with_files(texts: DataFrame, files: DataFrame, asked: Callable[[str, str], list[str]]) -> DataFrame:
    """``texts`` (``path, relative, text``) with ``files``: which of the paths that each text asks for are among ``files`` (``relative``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(path, name) for path, relative, text in zip(*(c.to_pylist() for c in b.columns)) if text is not None for name in asked(relative, text)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in range(2)], names=["path", "relative"])

    pairs = texts.select("path", "relative", "text").mapInArrow(run, "path string, relative string")
    found = pairs.join(files.select("relative"), "relative", "left_semi").groupBy("path").agg(F.collect_set("relative").alias("files"))  # no more than a text's imports
    return texts.join(found, "path", "left")


def extract(texts: DataFrame, parse: Callable[[str, str, dict], list[dict]]) -> DataFrame:
    """The records of each file (``path, relative, text`` and maybe ``files``, of :func:`with_files`). A file that can't be parsed gives one ``failed`` record, and no other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, relative, text, files in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    if text is None:
                        raise ValueError("unreadable")
                    rows = [r | {"path": path} for r in parse(relative, text, {"files": frozenset(files or ())})]
                except (ValueError, SyntaxError, RecursionError) as e:
                    rows = [{"path": path, "record": "failed", "error": f"{type(e).__name__}: {e}"}]
                yield batch(rows)

    files = F.col("files") if "files" in texts.columns else F.lit(None).cast("array<string>")
    return texts.select("path", "relative", "text", files.alias("files")).mapInArrow(run, SCHEMA)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Records from JSON lines; absent fields are null, unknown ones are left out, malformed lines are ``failed`` records."""
    raw = spark.read.schema(SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    record = F.when(F.col("_corrupt").isNotNull(), "failed").otherwise(F.col("record"))
    return raw.withColumn("record", record).withColumn("error", F.coalesce("_corrupt", "error")).drop("_corrupt")
