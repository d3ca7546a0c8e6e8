"""Streams: quiet periods of file changes, incremental backfill, and windows over a growing log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def relevant(events: DataFrame) -> DataFrame:
    """Changes of markdown documents, not of generated views and tests."""
    p = F.col("path")
    return events.where(p.endswith(".md") & ~p.endswith("/INDEX.md") & (p != "INDEX.md") & ~p.endswith(".tests.md"))


def quiet_periods(events: DataFrame, gap: str = "30 seconds", late: str = "1 minute", keys: tuple[str, ...] = ()) -> DataFrame:
    """Bursts of events that end after a quiet ``gap``: (keys, start, end, n_events). Works on batches and streams.

    ``ts`` must be a timestamp with zone; rows without one are left out, an event later than a stream's
    watermark begins a burst of its own. In a batch, events within one span of ``gap`` belong together, so
    they are aggregated to one row before bursts are told apart: what is brought together, also without keys,
    is a row for each span that has events, not the events.
    """
    if events.isStreaming:
        # A stream's sessions need a key, and not a literal; without keys there is one session at a time.
        by = list(keys) or [F.pmod(F.xxhash64("ts"), F.lit(1)).alias("_all")]
        g = events.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
        return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
    length = F.expr(f"INTERVAL {gap}")
    spans = events.where(F.col("ts").isNotNull()).groupBy(*keys, F.window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("first")
    new = F.coalesce(F.col("first") > F.lag("last").over(order) + length, F.lit(True))
    numbered = spans.withColumn("_new", new.cast("int")).withColumn("_burst", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_burst").agg(F.min("first").alias("start"), (F.max("last") + length).alias("end"), F.sum("n").alias("n_events")).drop("_burst")


def on_each_batch(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, tolerant: bool = True) -> StreamingQuery:
    """Run an idempotent action for every micro-batch.

    If ``tolerant``, a failing action is reported and its batch counts as done: only for actions that make up
    for it later, as a backfill does. Else it ends the stream, and a start from the checkpoint runs the batch again.
    """

    def safe(df: DataFrame, epoch: int) -> None:
        try:
            act(df, epoch)
        except Exception as e:
            print(f"batch {epoch} failed: {e}")

    w = stream.writeStream.foreachBatch(safe if tolerant else act).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def merged(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, tries: int = 3) -> None:
    """Run an idempotent action for all that is there; after a failure again from the checkpoint, then the error is raised."""
    for left in range(tries - 1, -1, -1):
        try:
            on_each_batch(stream, act, checkpoint, tolerant=False).awaitTermination()
            return
        except StreamingQueryException:
            if not left:
                raise


def windowed_counts(log: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """(start, decided_source, n) in windows of event time ``at``."""
    e = log.withWatermark("at", late) if log.isStreaming else log
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return e.groupBy(w.alias("w"), F.coalesce("decided_source", F.lit("unknown")).alias("decided_source")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "decided_source", "n")
