"""Resolution of code references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..graph import Graph
from .merge import within, without


def targets(g: Graph) -> DataFrame:
    """``target_type, key, target_key`` of everything a reference can name. A package is named ``language:name``, with no further colon."""
    one = lambda df, label, c: df.select(F.lit(label).alias("target_type"), F.col(c).alias("key"), F.col(c).alias("target_key"))
    package = g.package.where(~F.col("language").contains(":") & ~F.col("name").contains(":"))
    named = F.concat("language", F.lit(":"), "name")
    out = one(g.code, "Code", "language").unionByName(package.select(F.lit("Package").alias("target_type"), named.alias("key"), named.alias("target_key")))
    out = out.unionByName(one(g.file, "File", "path")).unionByName(one(g.method, "Method", "signature")).unionByName(one(g.field, "Field", "fqn"))
    return out.unionByName(g.type_node.select(F.col("label").alias("target_type"), F.col("fqn").alias("key"), F.col("fqn").alias("target_key")))


def resolve(g: Graph, keys: DataFrame | None = None, types: tuple[str, ...] = schema.REF_TYPES) -> Graph:
    """Edges of references to their targets, made anew; R1s-R8s with ``keys`` (target_type, key): others stay as they are."""
    refs = g.code_ref.where(F.col("target_type").isin(*types))
    if keys is not None:
        refs = within(refs, keys, target_type="target_type", key="key")
    found = refs.join(targets(g), ["target_type", "key"]).select("target_type", "key", "target_key").distinct()
    return g.replace(resolves_to=without(g.resolves_to, refs, target_type="target_type", key="key").unionByName(found))


def drop_unsupported(g: Graph) -> Graph:
    """R9."""
    return g.replace(resolves_to=g.resolves_to.where(F.col("target_type").isin(*schema.REF_TYPES)))


def unresolved(g: Graph) -> DataFrame:
    """Supported references without an edge, in order."""
    refs = g.code_ref.where(F.col("target_type").isin(*schema.REF_TYPES) & F.col("key").isNotNull())
    return without(refs, g.resolves_to, target_type="target_type", key="key").select("target_type", "key").orderBy("target_type", "key")


def refresh(g: Graph, changed: DataFrame | None = None) -> Graph:
    """All references; or the changed ones, then whatever is still without an edge. A stale reference that didn't change keeps its edge."""
    if changed is None:
        return drop_unsupported(resolve(g))
    g = resolve(g, changed)
    return drop_unsupported(resolve(g, unresolved(g)))
