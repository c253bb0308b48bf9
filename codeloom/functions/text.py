"""Scalar functions as column expressions: identifier words, excerpts, summaries, ids and hashes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, WORD_LENGTH = 32, 3
EXCERPT_LINES, DOC_LINES = 80, 16
SUMMARY_NAMES = 10
#: Between aB, before the last capital of a run that a small letter follows, and at whatever is neither letter nor digit.
_BREAK = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+"


def identifier_words(*inputs: Column, most: int = WORDS) -> Column:
    """Distinct lower-case words of at least three characters, in order of first appearance, blank-separated."""
    words = F.flatten(F.array(*(F.split(F.coalesce(c, F.lit("")), _BREAK) for c in inputs)))
    return F.array_join(F.slice(F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: F.length(w) >= WORD_LENGTH)), 1, most), " ")


def chunk_id(label: Column, source_id: Column) -> Column:
    return F.concat(F.lit("CCH-"), F.lower(label), F.lit("-"), F.substring(F.sha2(source_id, 256), 1, 16))


def memory_chunk_id(existing: Column, label: Column, source_id: Column) -> Column:
    kept = F.trim(F.coalesce(existing, F.lit("")))
    return F.when(kept != "", kept).otherwise(F.concat(F.lit("MCH-"), label, F.lit("-"), source_id))


def field(label: str, value: Column) -> Column:
    """``label: value`` and a line end, or nothing if the value is null or blank."""
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"{label}: "), value, F.lit("\n"))).otherwise(F.lit(""))


def simple_name(fqn: Column) -> Column:
    return F.element_at(F.split(F.coalesce(fqn, F.lit("")), r"\."), -1)


def package_name(fqn: Column) -> Column:
    return F.when(F.instr(fqn, ".") > 0, F.regexp_replace(fqn, r"\.[^.]*$", "")).otherwise(F.lit(""))


def method_name(signature: Column) -> Column:
    """What stands between the last dot before the parenthesis and the parenthesis."""
    return F.element_at(F.split(F.split(signature, r"\(").getItem(0), r"\."), -1)


def preview(text: Column, n: int = 240) -> Column:
    return F.substring(text, 1, n)


def summary(types: Column, methods: Column) -> Column:
    """``A (class), B (enum); methods: x, y (+n more)`` of an array of (name, kind) and an array of names."""
    names = F.array_distinct(methods)
    type_part = F.array_join(F.transform(types, lambda t: F.concat(t["name"], F.lit(" ("), t["kind"], F.lit(")"))), ", ")
    more = F.when(F.size(names) > SUMMARY_NAMES, F.concat(F.lit(" (+"), (F.size(names) - SUMMARY_NAMES).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    method_part = F.when(F.size(names) > 0, F.concat(F.lit("methods: "), F.array_join(F.slice(names, 1, SUMMARY_NAMES), ", "), more)).otherwise(F.lit(""))
    return F.concat(type_part, F.when((type_part != "") & (method_part != ""), F.lit("; ")).otherwise(F.lit("")), method_part)


def type_names(defines: Column) -> Column:
    """The part of a summary before its methods."""
    d = F.coalesce(defines, F.lit(""))
    at = F.instr(d, "; methods:")
    return F.when(at > 0, F.substring(d, F.lit(1), at - 1)).when(d.startswith("methods:"), F.lit("")).otherwise(d)


def line_above(lines: Column, start: Column) -> Column:
    """The 1-based number of the last line before ``start`` that isn't blank, or null."""
    text = lambda i: F.trim(F.get(lines, i - 1))
    above = F.sequence(F.lit(1), F.greatest(start - 1, F.lit(1)))
    return F.when((start > 1) & (text(start - 1) != ""), start - 1).when(start > 1, F.array_max(F.filter(above, lambda i: (i < start) & (text(i) != ""))))


def documentation_start(lines: Column, start: Column, previous: Column | None = None) -> Column:
    """The 1-based line where the comment right above ``start`` begins (blank lines between don't count), else ``start``.

    A block comment is followed back to its opening, line comments (``//``, ``///``, ``#``) to the first of their run; both
    at most ``DOC_LINES`` lines beyond the comment's last line. ``previous`` is :func:`line_above`, if it is at hand as a column.
    """
    text = lambda i: F.trim(F.get(lines, i - 1))
    previous = line_above(lines, start) if previous is None else previous
    low = F.greatest(previous - DOC_LINES, F.lit(1))
    last = text(previous)
    is_line = lambda i: text(i).startswith("//") | text(i).startswith("#")
    near = F.sequence(low, F.greatest(previous, low))
    block = F.array_max(F.filter(near, lambda i: text(i).startswith("/*")))
    stop = F.array_max(F.filter(near, lambda i: ~is_line(i)))
    run = F.coalesce(stop + 1, low)
    return F.when(previous.isNull(), start).when(last.endswith("*/"), F.coalesce(block, start)).when(is_line(previous), run).otherwise(start)


def with_excerpt(rows: DataFrame, name: str, most: int = EXCERPT_LINES) -> DataFrame:
    """``name``: of an array of lines ``lines``, those from the documentation above ``start_line`` to ``end_line``, at most ``most``.

    Each step is a column of its own: an expression that repeats another, above all in a lambda, is computed again each time.
    """
    n = F.size("lines")
    rows = rows.withColumn("_first", F.when(F.col("start_line") <= 0, F.lit(1)).otherwise(F.least("start_line", n)))
    rows = rows.withColumn("_last", F.when(F.col("end_line") <= 0, F.col("_first")).otherwise(F.greatest("_first", F.least("end_line", n))))
    rows = rows.withColumn("_previous", line_above(F.col("lines"), F.col("_first")))
    rows = rows.withColumn("_doc", documentation_start(F.col("lines"), F.col("_first"), F.col("_previous")))
    until = F.least(F.col("_doc") + most - 1, F.col("_last"))
    rows = rows.withColumn(name, F.array_join(F.slice("lines", F.col("_doc"), F.greatest(until - F.col("_doc") + 1, F.lit(1))), "\n"))
    return rows.drop("_first", "_last", "_previous", "_doc")


def chunk_text(source_id: Column, owner_fqn: Column, name: Column, kind: Column, defines: Column, body: Column) -> Column:
    """The text of a code chunk."""
    owner = F.when(source_id == owner_fqn, F.lit("")).otherwise(simple_name(owner_fqn))
    about = F.when(kind == "file", type_names(defines)).otherwise(defines)
    text = F.concat(
        field("Name", name), field("Kind", kind), field("Owner", owner), field("Words", identifier_words(name, owner, about)), field("Defines", defines),
        F.lit("Source excerpt:\n"), body,
    )
    return F.regexp_replace(text, r"^\s+|\s+$", "")
