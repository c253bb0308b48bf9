"""Tables of the property graph: one frame for each kind of node or edge, and what identifies its rows.

A graph belongs to one project; the store keeps projects in partitions, so a project's graph is read by partition
pruning and its tables need no project column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMORY_FIELDS = (
    "title", "topic", "status", "severity", "type", "priority", "source", "number", "rationale", "consequences", "content",
    "description", "summary", "evidence", "mitigation", "answer", "notes", "context", "decision",
)
_EMBEDDING = "embedding array<float>, embedding_model string, embedding_dimensions int, embedding_dirty boolean"

#: Table to (columns, key).
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "language": ("name string, graph_name string", ("name",)),
    "code": ("language string, language_name string, source_roots array<string>, last_ingested long", ("language",)),
    "package": ("name string, language string", ("name", "language")),
    "file": ("path string, last_modified long, language string, analysis_cache_key string, retained_source_token string", ("path",)),
    "type_node": (
        "label string, fqn string, name string, package_name string, is_abstract boolean, visibility string, is_enum boolean, is_record boolean,"
        " is_final boolean, is_external boolean, language string, kind string, module_path string, framework string",
        ("label", "fqn"),
    ),
    "method": (
        "signature string, name string, return_type string, is_static boolean, visibility string, start_line int, end_line int, owner_fqn string,"
        " owner_display_name string, language string, kind string, is_synthetic boolean",
        ("signature",),
    ),
    "field": ("fqn string, name string, type string, is_static boolean, visibility string, language string, kind string", ("fqn",)),
    "pending_call": ("caller_signature string, callee_owner_fqn string, callee_name string, count long, allow_name_only boolean", ("caller_signature", "callee_owner_fqn", "callee_name")),
    "code_chunk": (
        "id string, source_label string, source_id string, language string, path string, owner_fqn string, signature string, name string, kind string,"
        f" rag_role string, start_line int, end_line int, is_synthetic boolean, text string, text_hash string, {_EMBEDDING}",
        ("id",),
    ),
    "memory_chunk": (f"id string, source_label string, source_id string, text string, text_hash string, {_EMBEDDING}", ("id",)),
    "memory_item": ("label string, id string, " + ", ".join(f"{f} string" for f in MEMORY_FIELDS), ("label", "id")),
    "code_ref": ("target_type string, key string", ("target_type", "key")),
    "contains": ("src_label string, src_key string, dst_label string, dst_key string", ("src_label", "src_key", "dst_label", "dst_key")),
    "defines": ("path string, label string, key string", ("path", "label", "key")),
    "extends": ("label string, child string, parent string", ("label", "child", "parent")),
    "implements": ("child string, parent string", ("child", "parent")),
    "declares": ("owner_label string, owner_fqn string, member_label string, member_key string", ("owner_label", "owner_fqn", "member_label", "member_key")),
    "calls": ("caller string, callee string, count long", ("caller", "callee")),
    "annotated_with": ("owner_label string, owner_key string, annotation string", ("owner_label", "owner_key", "annotation")),
    "has_item": ("rel string, label string, id string", ("rel", "label", "id")),
    "refers_to": ("label string, id string, target_type string, key string", ("label", "id", "target_type", "key")),
    "resolves_to": ("target_type string, key string, target_key string", ("target_type", "key")),
    "has_rag_chunk": ("source_label string, source_key string, chunk_id string", ("source_label", "source_key", "chunk_id")),
    "memory_link": ("src string, rel string, dst string", ("src", "rel", "dst")),
    "embedding_state": ("target string, model string, dimensions int, index_name string, index_label string, metric string, scalar_kind string", ("target",)),
}

TYPE_LABELS = ("Class", "Interface", "Annotation")
MEMORY_LABELS = ("Decision", "ADR", "Rule", "Context", "Finding", "Task", "Risk", "Question", "Idea")
REF_TYPES = ("Code", "Package", "File", "Class", "Interface", "Annotation", "Method", "Field")


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType())}


def struct(table: str) -> T.StructType:
    """Needs no session, unlike the DDL parser."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in TABLES[table][0].split(", "))])


def columns(table: str) -> list[str]:
    return struct(table).names


def key(table: str) -> tuple[str, ...]:
    return TABLES[table][1]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order and type; those that ``df`` lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(table)))


def duplicates(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows: empty for a sound table (G1)."""
    return df.groupBy(*key(table)).agg(F.count("*").alias("rows")).where("rows > 1")
