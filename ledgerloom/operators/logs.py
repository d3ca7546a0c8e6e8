"""The dashboard and the view of append-only logs."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCES = ("kb", "web", "weights", "none")
_ISO = r"^(\d{4}-\d{2}-\d{2}|\d{8})(?:[^0-9](\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d+)?)?)?)(?: ?(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?))?)?$"


def parse_window(s: str) -> timedelta:
    """``7d``, ``24h`` or ``2w``."""
    m = re.fullmatch(r"(\d+)([dhw])", s.strip().lower())
    if not m:
        raise ValueError(f"not a window: {s!r}")
    return timedelta(**{{"d": "days", "h": "hours", "w": "weeks"}[m[2]]: int(m[1])})


def since_of(window: str | None, since: str | None, now: datetime | None = None) -> datetime | None:
    """The start of a dashboard's window, or the absolute start that overrides it, whose clock time counts as UTC whatever its offset."""
    if since:
        return datetime.fromisoformat(since).replace(tzinfo=timezone.utc)
    return (now or datetime.now(timezone.utc)) - parse_window(window) if window else None


def view_since(since: str | None) -> datetime | None:
    """The start of a view: its offset holds, without one it is UTC; an unreadable start leaves nothing out."""
    try:
        t = datetime.fromisoformat(since.replace("Z", "+00:00")) if since else None
    except ValueError:
        return None
    return t if t is None or t.tzinfo else t.replace(tzinfo=timezone.utc)


def iso_micros(c: Column) -> Column:
    """Microseconds of an ISO time string; without offset it is UTC; null if it is none.

    Dates and times may be written with or without their marks, any one character may stand between them, minutes
    and seconds may be absent, and digits finer than a microsecond are cut off. Dates by week are none.
    """
    date, time, zone = (F.translate(F.regexp_extract(c, _ISO, i), marks, "") for i, marks in ((1, "-"), (2, ":"), (3, ":")))
    part = lambda s, at: F.coalesce(F.nullif(F.substring(s, at, 2), F.lit("")), F.lit("00"))
    clock = F.concat_ws(":", part(time, 1), part(time, 3), part(time, 5))
    fraction = F.rpad(F.regexp_extract(time, r"[.,](\d{1,6})", 1), 6, "0")
    day = F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))
    wall = F.unix_micros(F.when(date != "", F.concat(day, F.lit("T"), clock, F.lit("."), fraction, F.lit("Z"))).try_cast("timestamp"))
    seconds = part(zone, 2).try_cast("int") * 3600 + part(zone, 4).try_cast("int") * 60 + part(zone, 6).try_cast("int")
    east = F.when(zone.startswith("-"), -seconds).when(zone.startswith("+"), seconds).otherwise(0)
    return wall - east.cast("bigint") * 1_000_000


def _from(since: datetime) -> Column:
    return F.lit(round(since.timestamp() * 1_000_000))


def recent(log: DataFrame, since: datetime | None, keep_unknown: bool) -> DataFrame:
    """Rows from ``since`` on; rows without a readable ``ts`` stay for the dashboard and go for the view."""
    if since is None:
        return log
    return log.where(F.coalesce(iso_micros(F.col("ts")) >= _from(since), F.lit(keep_unknown)))


def totals(log: DataFrame) -> DataFrame:
    """One row: n, ingested, ingest_rate, hard_misses, mean_duration_ms (of durations that are not 0), web rate and its status."""
    n = F.count(F.lit(1))
    web = F.count_if(F.col("decided_source") == "web")
    agg = log.agg(
        n.alias("n"), F.count_if(F.coalesce("ingested", F.lit(False))).alias("ingested"), F.count_if(F.col("decided_source") == "none").alias("hard_misses"),
        F.coalesce(F.avg(F.when(F.col("duration_ms") != 0, F.col("duration_ms"))), F.lit(0.0)).alias("mean_duration_ms"), web.alias("n_web"),
    )
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    status = F.when(rate("n_web") < 0.20, "OK").when(rate("n_web") < 0.35, "WARN").otherwise("ALERT")
    return agg.select("n", "ingested", rate("ingested").alias("ingest_rate"), "hard_misses", "mean_duration_ms", rate("n_web").alias("web_rate"), status.alias("coverage"))


def counted(log: DataFrame, c: str, name: str) -> DataFrame:
    return log.groupBy(F.coalesce(c, F.lit("unknown")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def source_mix(log: DataFrame) -> DataFrame:
    """Counts and percentages of the four listed sources, in every case four rows."""
    spark = log.sparkSession
    names = spark.createDataFrame([(s,) for s in SOURCES], "decided_source string")
    found = log.groupBy("decided_source").agg(F.count(F.lit(1)).alias("n"))
    total = log.agg(F.count(F.lit(1)).alias("n")).first()[0]
    out = names.join(found, "decided_source", "left").na.fill(0, ["n"])
    return out.select("decided_source", "n", (F.col("n") * 100.0 / F.lit(float(max(total, 1)))).alias("pct"))


def pattern_top(log: DataFrame, order: str, k: int = 6) -> DataFrame:
    """The k most frequent patterns; ties in order of first appearance by ``order``."""
    g = log.groupBy(F.coalesce("reconciliation_pattern", F.lit("unknown")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(k).drop("first")


def fallback_top(log: DataFrame, order: str, k: int = 5) -> DataFrame:
    """The k topics most often answered from the web, with all their recalls."""
    topic = F.coalesce(F.nullif("topic_hint", F.lit("")), F.lit("unspecified"))
    web = F.col("decided_source") == "web"
    g = log.groupBy(topic.alias("topic")).agg(F.count_if(web).alias("fallbacks"), F.count(F.lit(1)).alias("recalls"), F.min(F.when(web, F.col(order))).alias("first"))
    return g.where("fallbacks > 0").orderBy(F.desc("fallbacks"), "first").limit(k).drop("first")


def last(log: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows in file order (all if n <= 0), in that order."""
    if n <= 0:
        return log.orderBy(order)
    return log.orderBy(F.desc(order)).limit(n).orderBy(order)


def recall_lines(log: DataFrame) -> DataFrame:
    """Rows as text: time, source, ingest mark, start of the question."""
    return log.select(F.format_string("%s  [%-8s] %s %s", F.substring(F.coalesce("ts", F.lit("?")), 1, 19), F.coalesce("decided_source", F.lit("?")), F.when(F.coalesce("ingested", F.lit(False)), "✓").otherwise(" "), F.substring(F.coalesce("question", F.lit("")), 1, 70)).alias("line"))


def action_sizes(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per record the number of items in each list, from flattened rows."""
    g = items.where("probe_no < 0").groupBy(*keys)
    n = lambda a: F.count_if(F.col("action") == a)
    return g.agg(n("coverage_ingests").alias("ingest"), n("quality_repairs").alias("repair"), n("staleness_supersedes").alias("supersede"), n("contested_resolved").alias("contested"), n("transients").alias("transient"))


def rising(log: DataFrame, order: str, n: int = 10) -> DataFrame:
    """Whether durations of the last n rows never fall: one row (rises)."""
    w = Window.orderBy(order)  # over at most n rows
    rows = log.orderBy(F.desc(order)).limit(n).withColumn("before", F.lag("duration_ms").over(w))
    return rows.agg(F.coalesce(F.bool_and(F.coalesce(F.col("duration_ms") >= F.col("before"), F.lit(True))), F.lit(True)).alias("rises"))


def followed(log: DataFrame, key: str, order: str, value: str, block: int = 100_000) -> DataFrame:
    """``log`` with ``next_value``: the value of the next row of the same ``key`` by ``order``, an integer unique in a key.

    Rows of a key are taken in blocks of ``block`` consecutive orders, so a key with very many rows is no single
    task's; the last row of a block looks up the first of the key's next block, of which there is one row each.
    A null key is a key of its own.
    """
    rows = log.withColumn("_block", F.floor(F.col(order) / block))
    inner = Window.partitionBy(key, "_block").orderBy(order)
    rows = rows.withColumns({"_next": F.lead(F.struct(F.col(value).alias("v"))).over(inner), "_last": F.lead(order).over(inner).isNull()})
    heads = rows.groupBy(F.col(key).alias("_key"), "_block").agg(F.min_by(F.struct(F.col(value).alias("v")), order).alias("_head"))
    after = Window.partitionBy("_key").orderBy("_block")
    heads = heads.withColumn("_after", F.lead("_head").over(after)).select("_key", F.col("_block").alias("_b"), "_after").where("_after is not null")
    joined = rows.join(heads, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_b")) & F.col("_last"), "left")
    return joined.withColumn("next_value", F.coalesce("_next", "_after")["v"]).drop("_block", "_next", "_last", "_key", "_b", "_after")
