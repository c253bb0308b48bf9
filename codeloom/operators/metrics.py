"""Graph metrics (M1-M18): one job of united aggregates, ``metric, value`` in a fixed order."""

from __future__ import annotations

import time
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .merge import within


def _known(g: Graph) -> DataFrame:
    return g.type_node.select("label", "fqn")


def metrics(g: Graph) -> DataFrame:
    """M1-M16. A null flag counts neither as true nor as false. Edges count if both ends are in the graph."""
    count = F.count("*")
    types = _known(g)
    extends = g.extends.join(types.select("label", F.col("fqn").alias("child")), ["label", "child"], "left_semi").join(types.select("label", F.col("fqn").alias("parent")), ["label", "parent"], "left_semi")
    implements = within(within(g.implements, types.where("label = 'Class'"), child="fqn"), types.where("label = 'Interface'"), parent="fqn")
    rows = (
        ("files", g.file, count), ("packages", g.package, count),
        ("classes.internal", g.type_node.where("label = 'Class' and is_external = false"), count),
        ("classes.external", g.type_node.where("label = 'Class' and is_external = true"), count),
        ("interfaces", g.type_node.where("label = 'Interface'"), count), ("annotations", g.type_node.where("label = 'Annotation'"), count),
        ("methods", g.method.where("is_synthetic = false"), count), ("methods.synthetic", g.method.where("is_synthetic = true"), count),
        ("fields", g.field, count), ("calls", g.calls, F.coalesce(F.sum(F.coalesce("count", F.lit(1))), F.lit(0))),
        ("extends", extends, count), ("implements", implements, count), ("annotated_with", g.annotated_with, count),
        ("pending_calls", g.pending_call, count), ("pending_calls.name_only", g.pending_call.where("callee_owner_fqn = ''"), count),
        ("resolved_code_refs", g.resolves_to, count),
    )
    parts = [df.agg(how.cast("long").alias("value")).select(F.lit(i + 1).alias("position"), F.lit(name).alias("metric"), "value") for i, (name, df, how) in enumerate(rows)]
    return reduce(DataFrame.unionByName, parts)


def table(rows: list[tuple[str, int]], heading: str = "Metrics") -> str:
    """An aligned Markdown table of metric rows."""
    cells = [("Metric", "Value"), *((n, f"{v}") for n, v in rows)]
    w, v = (max(len(c[i]) for c in cells) for i in (0, 1))
    lines = [f"| {n.ljust(w)} | {x.rjust(v)} |" for n, x in cells]
    return "\n".join([f"## {heading}", "", lines[0], f"|{'-' * (w + 2)}|{'-' * (v + 1)}:|", *lines[1:]]) + "\n"


def same_table(a: str, b: str) -> bool:
    """Whether two metric tables hold the same rows, whatever their spacing."""
    parse = lambda t: [tuple(c.strip() for c in line.strip("|").split("|")) for line in t.splitlines() if line.startswith("|") and "---" not in line]
    return parse(a) == parse(b)


class RunStats:
    """Counters and phase timers of one run."""

    def __init__(self):
        self.counters: dict[str, int] = {}
        self.seconds: dict[str, float] = {}

    def add(self, name: str, n: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + n

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def slowest(self, n: int = 5) -> list[tuple[str, float]]:
        return sorted(self.seconds.items(), key=lambda x: (-x[1], x[0]))[:n]
