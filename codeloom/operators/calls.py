"""Resolution of pending calls (P1, P2 and their scoped forms).

Candidates of a call come in tiers; the first tier that has any decides, and only if it has exactly one:

1. methods of the name that the owner declares;
2. those of the nearest superclass that declares the name (at equal depth the smallest name);
3. those of interfaces that the owner or a superclass implements, through the interfaces they extend, and of the owner's own
   super-interfaces if it is an interface (the two lists aren't merged);
4. for a call without owner that allows it: all methods of that name with a line, other than the caller.

All tiers are equi-joins on (owner, name); a hot pair is met by pending rows after both sides are grouped, never expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, cut
from .edges import add_calls, declared
from .hierarchy import ancestors, descendants, with_self
from .merge import within, without

KEYS = ["caller_signature", "callee_owner_fqn", "callee_name"]


def _grouped(known: DataFrame) -> DataFrame:
    """``owner_fqn, name, n, callee``: whether an owner declares one method of a name or several (n is 1 or 2), and the first."""
    ends = known.groupBy("owner_fqn", "name").agg(F.min("signature").alias("callee"), F.max("signature").alias("_last"))
    return ends.select("owner_fqn", "name", F.when(F.col("callee") == F.col("_last"), 1).otherwise(2).cast("long").alias("n"), "callee")


def direct(pending: DataFrame, grouped: DataFrame) -> DataFrame:
    """Tier 1: ``KEYS, tier, n, callee``."""
    found = grouped.select(F.col("owner_fqn").alias("callee_owner_fqn"), F.col("name").alias("callee_name"), "n", "callee")
    return pending.select(*KEYS).join(found, ["callee_owner_fqn", "callee_name"]).select(*KEYS, F.lit(1).alias("tier"), "n", "callee")


def resolved(pending: DataFrame, g: Graph, known: DataFrame | None = None, grouped: DataFrame | None = None) -> DataFrame:
    """``KEYS, tier, n, callee`` of the deciding tier of each pending call that has candidates; n is 1 if there is one. ``known`` is
    :func:`declared`, ``grouped`` its groups, where they are at hand."""
    pending = pending.select(*KEYS, "allow_name_only")
    wanted = pending.select("callee_owner_fqn", "callee_name").distinct()  # candidates depend on these two alone, but for tier 4
    known = cut(declared(g), "declared") if known is None else known
    grouped = _grouped(known) if grouped is None else grouped
    one = wanted.join(grouped.select(F.col("owner_fqn").alias("callee_owner_fqn"), F.col("name").alias("callee_name"), "n", "callee"), ["callee_owner_fqn", "callee_name"])
    owners = without(wanted, one, callee_owner_fqn="callee_owner_fqn", callee_name="callee_name")
    owners = cut(owners, "open")
    starts = owners.select(F.col("callee_owner_fqn").alias("start")).distinct()
    classes = starts.join(g.type_node.where("label = 'Class'").select(F.col("fqn").alias("start")), "start", "left_semi")
    interfaces = starts.join(g.type_node.where("label = 'Interface'").select(F.col("fqn").alias("start")), "start", "left_semi")
    up = ancestors(g.extends, "Class", classes)
    chain = owners.join(up, F.col("callee_owner_fqn") == F.col("start")).join(grouped, (F.col("node") == F.col("owner_fqn")) & (F.col("callee_name") == F.col("name")))
    two = chain.groupBy("callee_owner_fqn", "callee_name").agg(F.min_by(F.struct("n", "callee"), F.struct("depth", "node")).alias("b")).select("callee_owner_fqn", "callee_name", "b.n", "b.callee")
    still = without(owners, two, callee_owner_fqn="callee_owner_fqn", callee_name="callee_name")
    direct_interfaces = with_self(up, classes).join(g.implements, F.col("node") == F.col("child")).select("start", F.col("parent").alias("interface")).distinct()
    wider = ancestors(g.extends, "Interface", direct_interfaces.select(F.col("interface").alias("start")).unionByName(interfaces))
    reached = with_self(wider, direct_interfaces.select(F.col("interface").alias("start"))).select(F.col("start").alias("interface"), "node")
    implemented = direct_interfaces.join(reached, "interface").select("start", "node").distinct().withColumn("list", F.lit(0))
    extended = wider.join(interfaces, "start", "left_semi").select("start", "node", F.lit(1).alias("list"))
    found = still.join(implemented.unionByName(extended), F.col("callee_owner_fqn") == F.col("start"))
    found = found.join(known, (F.col("node") == F.col("owner_fqn")) & (F.col("callee_name") == F.col("name")))
    three = found.select("callee_owner_fqn", "callee_name", "list", "signature").distinct().groupBy("callee_owner_fqn", "callee_name").agg(F.count("*").alias("n"), F.min("signature").alias("callee"))
    owned = one.withColumn("tier", F.lit(1)).unionByName(two.withColumn("tier", F.lit(2))).unionByName(three.withColumn("tier", F.lit(3)))
    found = pending.join(owned, ["callee_owner_fqn", "callee_name"]).select(*KEYS, "tier", "n", "callee")
    # tier 4: the two smallest and the number of methods of a name are enough to leave the caller out
    named = g.method.where("start_line is not null").groupBy(F.col("name").alias("callee_name")).agg(F.count("*").alias("n"), F.min("signature").alias("low"), F.max("signature").alias("high"))
    loose = without(pending.where("callee_owner_fqn = '' and allow_name_only"), found, caller_signature="caller_signature", callee_owner_fqn="callee_owner_fqn", callee_name="callee_name").join(named, "callee_name")
    own = g.method.where("start_line is not null").select(F.col("signature").alias("caller_signature"), F.col("name").alias("callee_name"), F.lit(1).alias("self"))
    loose = loose.join(own, ["caller_signature", "callee_name"], "left").withColumn("n", F.col("n") - F.coalesce("self", F.lit(0))).where("n > 0")
    callee = F.when(F.col("low") == F.col("caller_signature"), F.col("high")).otherwise(F.col("low"))
    return found.unionByName(loose.select(*KEYS, F.lit(4).alias("tier"), "n", callee.alias("callee")))


def _sure(pending: DataFrame, found: DataFrame) -> DataFrame:
    """The pending calls that have one candidate, with it."""
    return cut(pending.join(found.where("n = 1").select(*KEYS, "callee"), KEYS), "resolved")


def _apply(g: Graph, sure: DataFrame) -> Graph:
    """Adds the counts of the calls that are sure, and takes them off the pending ones."""
    left = g.pending_call.join(sure.select(*KEYS), KEYS, "left_anti")
    return g.replace(calls=add_calls(g.calls, sure.select(F.col("caller_signature").alias("caller"), "callee", F.coalesce("count", F.lit(1)).alias("count"))), pending_call=left)


def _callable(g: Graph, scope: DataFrame | None) -> DataFrame:
    pending = within(g.pending_call, g.method, caller_signature="signature")
    return pending if scope is None else pending.join(scope.select(*KEYS).distinct(), KEYS, "left_semi")


def resolve_direct(g: Graph, scope: DataFrame | None = None) -> Graph:
    """P1, P1s."""
    return _apply(g, _sure(g.pending_call, direct(_callable(g, scope), _grouped(declared(g)))))


def resolve(g: Graph, scope: DataFrame | None = None) -> Graph:
    """P2, P2s."""
    return _apply(g, _sure(g.pending_call, resolved(_callable(g, scope), g)))


def scope(g: Graph, callers: DataFrame, owners: DataFrame, names: DataFrame) -> DataFrame:
    """The pending calls that a change can settle: of changed callers (``signature``); of changed owners (``fqn``), what extends them
    and what implements them; and name-only ones of changed method names (``name``)."""
    starts = owners.select(F.col("fqn").alias("start")).distinct()
    of = lambda label: starts.join(g.type_node.where(F.col("label") == label).select(F.col("fqn").alias("start")), "start", "left_semi")
    classes = with_self(descendants(g.extends, "Class", of("Class")), of("Class")).select("node")
    interfaces = with_self(descendants(g.extends, "Interface", of("Interface")), of("Interface")).select("node").distinct()
    direct_ = within(g.implements, interfaces, parent="node").select(F.col("child").alias("start")).distinct()
    implementors = with_self(descendants(g.extends, "Class", direct_), direct_).select("node")
    affected = classes.union(interfaces).union(implementors).distinct()
    pending = g.pending_call
    return (
        within(pending, callers, caller_signature="signature").select(*KEYS)
        .union(within(pending, affected, callee_owner_fqn="node").select(*KEYS))
        .union(within(pending.where("callee_owner_fqn = '' and allow_name_only"), names, callee_name="name").select(*KEYS))
        .distinct()
    )


def resolve_pending(g: Graph, changed: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> Graph:
    """P1, then P2 on what is left; within the scope of (callers, owners, names) if a change is given. Neither reads calls, so what both settle is added at once."""
    pending = _callable(g, None if changed is None else scope(g, *changed))
    pending, known = cut(pending, "pending"), cut(declared(g), "declared")
    grouped = cut(_grouped(known), "grouped")
    first = _sure(pending, direct(pending, grouped))
    left = cut(pending.join(first.select(*KEYS), KEYS, "left_anti"), "left")
    return _apply(g, first.unionByName(_sure(left, resolved(left, g, known, grouped))))
