"""Watching a source tree (W1-W7): a Structured Streaming job whose every trigger compares the tree with what was seen.

Spark's file source can't see deletions, so the stream is a clock (``rate-micro-batch`` or any given stream), and each
micro-batch lists the tree and hands created, changed and deleted paths to the engine. Paths of failed batches are kept in
``pending`` and tried again with the next change (a new watch finds them by comparing the tree with the stored graph); deletions are applied only in a batch without failures,
or alone if a batch of nothing but deleted files fails. Pending calls are
ordinary state of the graph and never expire, so no watermark is needed; only dirty chunks are embedded.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..sources import discovery

LOG = logging.getLogger(__name__)
DEBOUNCE = "500 milliseconds"


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """``path, change`` (created, modified or deleted) between two listings of ``path, last_modified``."""
    both = before.select("path", F.col("last_modified").alias("a")).join(now.select("path", F.col("last_modified").alias("b")), "path", "full")
    kind = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", kind.alias("change")).where("change is not null")


@dataclass
class Watch:
    """State of a watch; :meth:`apply` is the body of ``foreachBatch``."""

    spark: SparkSession
    engine: Engine
    root: str
    pending: set[str] = field(default_factory=set)
    results: list[dict] = field(default_factory=list)

    def apply(self, _batch: DataFrame | None = None, _epoch: int = 0) -> None:
        now = discovery.assign(discovery.find(self.spark, self.root))
        stored = self.engine.graph.file.select("path", "last_modified")
        found = {r.path: r.change for r in changes(stored, now).toLocalIterator()}
        todo = sorted(found.keys() | self.pending)
        if not todo:
            return
        try:
            result = self.engine.ingest_changed_files(self.root, todo)
        except Exception:
            LOG.exception("a watch batch failed; its files are tried again")
            if all(found.get(p) == "deleted" for p in todo):  # none of the files is there: what they were can still go
                try:
                    self.results.append(self.engine.remove_files(todo))
                    self.pending.clear()
                    return
                except Exception:
                    LOG.exception("so did the removal")
            self.pending |= set(todo)
            self.results.append({"failed": len(todo)})
            return
        self.pending = set(todo) if result["failed"] else set()
        self.results.append(result)

    def start(self, source: DataFrame | None = None, trigger: str = DEBOUNCE, checkpoint: str | None = None, available_now: bool = False):
        """Starts the query. A trigger's length is the debounce: what changes within one is one batch."""
        stream = source if source is not None else self.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        writer = stream.writeStream.foreachBatch(self.apply).trigger(**({"availableNow": True} if available_now else {"processingTime": trigger}))
        return (writer if checkpoint is None else writer.option("checkpointLocation", checkpoint)).start()
