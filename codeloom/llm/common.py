"""Helpers shared by the corpus operators: column picking, shared-folder tables, Arrow mapping."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Worker functions travel by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact position as ``alias=name``; other columns, however named, cannot clash.

    ``pick(docs, doc_id="doc_id", text="text")`` works even if the frame also has ``TEXT`` or two
    columns called ``lang``. A missing name raises ``ValueError``.
    """
    names = df.columns
    plain = df.toDF(*(f"_c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"_c{names.index(n)}").alias(a) for a, n in columns.items()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table. Arrow batches are kept to a few MB, since texts can be very long."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset, a temporary one in local mode, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='codeloom-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete the tables written by :func:`materialize` that ``df`` reads, and that no later plan reads; others stay."""
    names = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    for path in [p for p in _made if p.rpartition("/")[2] in names]:
        _delete(df.sparkSession, path)
        _made.remove(path)


def tables() -> set[str]:
    """The tables that :func:`materialize` has written and nobody has deleted: a mark for :func:`release`."""
    return set(_made)


def release(spark: SparkSession, since: set[str] = frozenset(), keep: DataFrame | None = None) -> None:
    """Delete the tables written since a mark, but for those that ``keep`` reads.

    An operator's result is lazy and reads some of them, so this is for the caller, once the result is written or counted.
    """
    stay = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None else set()
    for path in [p for p in _made if p not in since and p.rpartition("/")[2] not in stay]:
        _delete(spark, path)
        _made.remove(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives a Python worker's freed memory back to the system: idle workers stay alive for a while beside busy ones."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
