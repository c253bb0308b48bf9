"""Line dedup by distinct-site spread.

A line (its spaces at both ends cut off; blank lines never count) that occurs on ``SITES`` or more distinct sites, in as many different
texts, is boilerplate. The texts protect copies: a text's own lines don't become boilerplate by its copies on other sites. Each line hash (128 bits) has a HyperLogLog sketch of its sites, held as rows: one for each non-zero register,
merged by a plain maximum, so partial aggregation runs in the JVM before the shuffle and a hot line is never gathered
in one task. Lines whose estimate is between half the threshold and ``band`` above it get an exact distinct
count before anything is removed.

Boilerplate goes from every document except the one of smallest doc_id that has it, whatever its share of a text.

Defined cases: a null text has no lines and stays null; a null site counts for no line; a null doc_id is a document
like any other, but never the smallest unless all are null; repeated rows get equal results; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

SITES, REGISTERS = 10, 1024


def register(site: Column, registers: int = REGISTERS) -> tuple[Column, Column]:
    """The register of a site and the rank (leading zeros plus one) it sets there."""
    bits = registers.bit_length() - 1
    h = F.xxhash64(site)
    rest = F.shiftrightunsigned(h, bits)
    return F.when(site.isNotNull(), h.bitwiseAND(F.lit(registers - 1))), F.when(site.isNotNull(), F.lit(64 - bits + 1) - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest))))


def estimate(used: Column, inverse: Column, registers: int = REGISTERS) -> Column:
    """The HyperLogLog estimate from the number of non-zero registers and the sum of their 2^-rank; linear counting where small."""
    m = float(registers)
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.lit(m) - used + inverse)
    return F.when((raw <= 2.5 * m) & (used < m), F.lit(m) * F.log(F.lit(m) / (F.lit(m) - used))).otherwise(raw)


def keyed(docs: DataFrame, carry: dict[str, str] | None = None) -> DataFrame:
    """The documents with the key (k, h), which tells rows of one doc_id and different texts apart."""
    rows = pick(docs, doc_id="doc_id", text="text", site="source", **(carry or {}))
    return rows.withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))


def lines(rows: DataFrame, *columns: str) -> DataFrame:
    exploded = rows.select(*columns, F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    return exploded.select(*columns, "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))


def boilerplate(rows: DataFrame, sites: int = SITES, registers: int = REGISTERS) -> DataFrame:
    """``a, b, first``: the hash of each boilerplate line, on ``sites`` or more sites in as many different texts, and the smallest doc_id that has it."""
    bucket, rank = register(F.col("site"), registers)
    # the register is found once for a document, not for each line
    marked = lines(rows.withColumn("bucket", bucket).withColumn("rank", rank), "doc_id", "bucket", "rank")
    sketch = marked.groupBy("a", "b", "bucket").agg(F.max("rank").alias("rank"), F.min("doc_id").alias("first"))
    spread = sketch.groupBy("a", "b").agg(F.count("rank").alias("used"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("inverse"), F.min("first").alias("first"))
    band = max(1.0, 3 * 1.04 / math.sqrt(registers) * sites)
    low = min(sites - band, sites / 2)  # few sites lower the estimate in steps: each pair that shares a register takes one off it
    found = spread.withColumn("estimate", estimate(F.col("used"), F.col("inverse"), registers)).where(F.col("estimate") >= low)
    found = materialize(found.select("a", "b", "first", "estimate"), "lines")
    near = found.where(F.col("estimate") <= sites + band)
    exact = lines(rows.where("site is not null"), "site").join(near.select("a", "b", "first"), ["a", "b"]).groupBy("a", "b", "site").agg(F.min("first").alias("first"))
    exact = exact.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= sites)
    bad = found.where(F.col("estimate") > sites + band).select("a", "b", "first").union(exact.select("a", "b", "first"))
    bad = materialize(bad, "spread")
    apart = lines(rows.where("site is not null"), "h").join(bad.select("a", "b"), ["a", "b"]).select("a", "b", "h").distinct()
    return bad.join(apart.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= sites), ["a", "b"], "left_semi")


def strip(docs: DataFrame, sites: int = SITES, carry: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, text, kept, n_lines, n_removed`` and carried columns (alias: name): every row, ``kept`` being the text without boilerplate."""
    rows = keyed(docs, carry)
    bad = materialize(boilerplate(rows, sites), "boilerplate")
    hits = lines(rows, "doc_id", "k", "h").join(bad, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    hits = hits.groupBy("k", "h").agg(F.collect_set("at").alias("at"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "at")  # hashed: linear in the lines
    out = rows.join(hits.hint("shuffle_hash"), ["k", "h"], "left").withColumn("ls", F.split("text", "\n", -1))
    return out.select(
        "doc_id", "text", F.when(F.col("at").isNotNull(), F.array_join(F.transform(stay, lambda i: F.get("ls", i)), "\n")).otherwise(F.col("text")).alias("kept"),
        F.coalesce(F.size(F.filter("ls", lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_removed"), *(carry or {}),
    )


def report(docs: DataFrame) -> DataFrame:
    return strip(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, text, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
b AS (SELECT trim(line) AS t, min(doc_id) AS first FROM l WHERE trim(line) <> '' GROUP BY 1
  HAVING count(DISTINCT source) >= {SITES} AND count(DISTINCT text) FILTER (source IS NOT NULL) >= {SITES}),
h AS (SELECT r, list(i) AS at_ FROM l JOIN b ON trim(line) = t WHERE doc_id IS DISTINCT FROM first GROUP BY r)
SELECT doc_id, CAST(coalesce(len(list_filter(ls, lambda x: trim(x) <> '')), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(at_), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN at_ IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(at_, i)), chr(10)) END, '')) AS kept_sha256
FROM d LEFT JOIN h USING (r)
"""
