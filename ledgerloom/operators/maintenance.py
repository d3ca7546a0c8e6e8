"""Set computations of a maintenance cycle over logs, files and links.

Rules of the workflow itself (which answer wins, when a page is accepted) are left to its users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.runtime import parallelism, written


def top_urls(log: DataFrame, topics: DataFrame, k: int = 3) -> DataFrame:
    """Per topic of ``topics`` its most frequent web URL, of the k topics with the most; ties by name."""
    url = F.col("probes.web.url")
    seen = log.where(url.isNotNull()).select(F.col("topic_hint").alias("topic"), url.alias("url")).join(topics.select("topic"), "topic", "left_semi")
    n = seen.groupBy("topic", "url").agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "url"))
    return n.withColumn("r", first).where("r = 1").drop("r").orderBy(F.desc("n"), "topic").limit(k)


def oldest(files: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """The n oldest files after the ``skip`` oldest, by mtime and path."""
    return files.select("path", "mtime").orderBy("mtime", "path").limit(n + skip).withColumn("rank", F.row_number().over(Window.orderBy("mtime", "path"))).where(F.col("rank") > skip)


def recurring(items: DataFrame, action: str, cycles: DataFrame, key: str = "cycle_id", least: int = 3) -> DataFrame:
    """Values of one action list that occur in at least ``least`` of the given cycles."""
    rows = items.where((F.col("action") == action) & (F.col("probe_no") < 0) & F.col("item_value").isNotNull())
    rows = rows.join(cycles.select(key), key, "left_semi")
    return rows.groupBy("item_value").agg(F.count_distinct(key).alias("n_cycles")).where(F.col("n_cycles") >= least)


def numbered_cycles(log: DataFrame, key: str = "cycle_id") -> DataFrame:
    """(key, n): distinct cycles numbered from 0 in their order.

    Ranges of the key are numbered each by itself; the driver adds up the sizes of the ranges, one number each.
    """
    spark = log.sparkSession
    ranges = log.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(parallelism(spark), key)
    rows = written(ranges.withColumn("_range", F.spark_partition_id()), "cycles")
    sizes = sorted((r["_range"], r["count"]) for r in rows.groupBy("_range").count().collect())
    before, total = [], 0
    for r, n in sizes:
        before += [F.lit(r), F.lit(total)]
        total += n
    if not sizes:
        return rows.select(key, F.lit(0).alias("n"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return rows.select(key, (F.element_at(F.create_map(*before), F.col("_range")) + within - 1).alias("n"))


def recurring_by_audit(items: DataFrame, log: DataFrame, actions: tuple[str, ...], key: str = "cycle_id", every: int = 10, least: int = 3) -> DataFrame:
    """(audit, action, item_value, n_cycles): the values that an audit after each ``every`` cycles finds in at least ``least`` of them."""
    cycles = numbered_cycles(log, key).select(key, F.floor(F.col("n") / every).cast("int").alias("audit"))
    rows = items.where(F.col("action").isin(*actions) & (F.col("probe_no") < 0) & F.col("item_value").isNotNull()).join(cycles, key)
    found = rows.groupBy("audit", "action", "item_value").agg(F.count_distinct(key).alias("n_cycles"))
    return found.where(F.col("n_cycles") >= least)


def unsettled(items: DataFrame, log: DataFrame, key: str = "cycle_id", every: int = 10) -> DataFrame:
    """(audit, n_transients, n_repairs, unsettled): whether more failures of an audit's cycles were passing than repaired."""
    cycles = numbered_cycles(log, key).select(key, F.floor(F.col("n") / every).cast("int").alias("audit"))
    n = lambda a: F.count_if((F.col("action") == a) & (F.col("probe_no") < 0))
    sums = cycles.join(items.select(key, "action", "probe_no"), key, "left").groupBy("audit").agg(n("transients").alias("n_transients"), n("quality_repairs").alias("n_repairs"))
    return sums.withColumn("unsettled", F.col("n_transients") > F.col("n_repairs"))


def since_last_cycle(log: DataFrame, cycles: DataFrame, at: str = "at") -> DataFrame:
    """Contested recalls and those without an answer from after the last cycle, as (all columns, finding); all if there was no cycle.

    Rows without a time are none. ``at`` is the time in both, as a number.
    """
    last = cycles.agg(F.max(at)).first()[0]
    kind = F.when(F.col("decided_source") == "contested", "contested").when(F.col("decided_source") == "none", "gap")
    rows = log.where(F.col(at).isNotNull() & kind.isNotNull()).withColumn("finding", kind)
    return rows if last is None else rows.where(F.col(at) > F.lit(last))


def last_cycles(log: DataFrame, n: int = 10, key: str = "cycle_id") -> DataFrame:
    return log.select(key).distinct().orderBy(F.desc(key)).limit(n)


def current(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no other file supersedes: those without a ``superseded_by`` edge of their own."""
    gone = edges.where((F.col("edge_type") == "frontmatter_superseded_by") & F.col("dst").isNotNull()).select(F.col("src").alias("path"))
    return files.join(gone, "path", "left_anti")


def still_split(log: DataFrame, least: int = 2, by: str = "question") -> DataFrame:
    """Questions (or other values of a column) whose recalls were decided as contested at least ``least`` times."""
    rows = log.where((F.col("decided_source") == "contested") & F.col(by).isNotNull())
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
