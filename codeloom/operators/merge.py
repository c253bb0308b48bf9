"""The merge rules that all upserts share.

A batch is first reduced to one row for each key: the last row wins where columns are overwritten ("definition"), the first
where the stored value has precedence ("reference"). One full outer join then applies the column rules. Batches carry
their order in ``ordinal``; without it, ties are settled by the rows' values, so results don't depend on the run.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def one_row(batch: DataFrame, keys: Iterable[str], last: bool = True) -> DataFrame:
    """One row for each key, by ordinal."""
    keys = list(keys)
    rest = [c for c in batch.columns if c not in keys and c != "ordinal"]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_none"))
    rank = F.struct(F.col("ordinal"), row) if "ordinal" in batch.columns else row
    pick = F.max_by if last else F.min_by
    found = batch.groupBy(*keys).agg(pick(row, rank).alias("_row"))
    return found.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def merge(stored: DataFrame, batch: DataFrame, keys: Iterable[str], definition: Iterable[str] = (), reference: Iterable[str] = (), rules: dict[str, Column] | None = None, last: bool = True) -> DataFrame:
    """Stored rows with the batch merged in.

    ``definition`` columns are overwritten by the batch, ``reference`` columns keep the stored value if it isn't null,
    ``rules`` gives columns from expressions over ``o_<name>``, ``n_<name>`` and ``is_new`` / ``in_batch``. Other columns stay as stored.
    """
    keys, rules = list(keys), rules or {}
    definition, reference = set(definition), set(reference)
    new = one_row(batch, keys, last)
    old = stored.select(*(F.col(c).alias(f"o_{c}") for c in stored.columns), F.lit(True).alias("_old"))
    new = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns), F.lit(True).alias("_new"))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    both = old.join(new, on, "full").withColumn("is_new", F.col("_old").isNull()).withColumn("in_batch", F.col("_new").isNotNull())
    out = []
    for c in stored.columns:
        o, n = F.col(f"o_{c}"), F.col(f"n_{c}") if f"n_{c}" in both.columns else F.lit(None)
        if c in rules:
            value = rules[c]
        elif c in keys or c in reference:
            value = F.coalesce(o, n)
        elif c in definition:
            value = F.when(F.col("in_batch"), n).otherwise(o)
        else:
            value = o
        kind = stored.schema[c].dataType
        out.append((value if isinstance(kind, ArrayType) else value.cast(kind)).alias(c))
    return both.select(*out)


def first_rows(df: DataFrame, keys: Iterable[str], order: Iterable[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their ``_rank``. Each task keeps n rows of a key before the shuffle, so a hot key is never gathered."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n)


def add_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edges are sets: the union without repeats."""
    return stored.unionByName(new.select(*stored.columns)).distinct()


def without(df: DataFrame, keys: DataFrame, **on: str) -> DataFrame:
    """Rows of ``df`` whose columns (names) have no equal row among ``keys`` (values); null keys never match."""
    other = keys.select(*(F.col(v).alias(f"_{k}") for k, v in on.items())).distinct()
    return df.join(other, [F.col(k) == F.col(f"_{k}") for k in on], "left_anti")


def within(df: DataFrame, keys: DataFrame, **on: str) -> DataFrame:
    """The opposite of :func:`without`."""
    other = keys.select(*(F.col(v).alias(f"_{k}") for k, v in on.items())).distinct()
    return df.join(other, [F.col(k) == F.col(f"_{k}") for k in on], "left_semi")
