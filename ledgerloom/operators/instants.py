"""Time strings in mixed notations, precisions and zones -> one UTC instant in microseconds.

Raw strings are reduced to a dictionary of distinct (source, raw, tz), each entry is parsed once by
built-in expressions, the dictionary is kept in a table that later runs only add to, and instants are
joined back to the rows.

Rules: an offset or zone in the value wins over the row's zone, which wins over UTC; the earlier instant
of a wall time that occurs twice; a skipped wall time is read with the offset before the change; digits
finer than a microsecond are cut off; a date alone is its midnight; with the year last the day comes
before a month given in figures. Bare digits count seconds (9-11 digits), milliseconds (12-14) or
microseconds (15-17). Anything else, also a value in a zone that is not in the zone database, has no
instant.
"""

from __future__ import annotations

import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.runtime import exists, hot_keys, temporary

# Month names in English, German, French and Spanish.
MONTHS = {
    1: ("january", "jan", "januar", "jänner", "janvier", "janv", "enero", "ene"),
    2: ("february", "feb", "februar", "février", "févr", "febrero"),
    3: ("march", "mar", "märz", "mär", "mrz", "maerz", "mars", "marzo"),
    4: ("april", "apr", "avril", "avr", "abril", "abr"),
    5: ("may", "mai", "mayo"),
    6: ("june", "jun", "juni", "juin", "junio"),
    7: ("july", "jul", "juli", "juillet", "juil", "julio"),
    8: ("august", "aug", "août", "aout", "agosto", "ago"),
    9: ("september", "sep", "sept", "septembre", "septiembre"),
    10: ("october", "oct", "oktober", "okt", "octobre", "octubre"),
    11: ("november", "nov", "novembre", "noviembre"),
    12: ("december", "dec", "dezember", "dez", "décembre", "déc", "diciembre", "dic"),
}

# Zone abbreviations in minutes east of UTC; where one has several meanings, that of the tables' zones.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630,
    "AWST": 480, "BRT": -180, "BRST": -120, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420,
}

SPACE = r"[\s  -​ 　﻿]"
TIME = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
ZONE_OFFSET = r"^(?:UTC|GMT)?([+\-−])(\d{1,2})(?::?(\d{2}))?(?:\[[^\]]*\])?$"


def zone_names(spark: SparkSession) -> list[str]:
    """Zones that both the JVM and the IANA database know."""
    names = zoneinfo.available_timezones()
    try:
        names &= set(spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    except (AttributeError, TypeError):  # no JVM gateway in the session
        pass
    return sorted(names)


def _int(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("0")).cast("int")


def parsed(df: DataFrame, zones: list[str]) -> DataFrame:
    """``df`` (raw, tz, ...) with ``utc_us`` (bigint or null), by built-in expressions only.

    One step is one projection, so no step's expression is written out again in the next.
    """
    kept = df.columns
    months = F.create_map(*[F.lit(x) for m, names in MONTHS.items() for name in names for x in (name, f"{m:02d}")])
    month = lambda c: F.coalesce(F.try_element_at(months, F.lower(c)), F.lit("00"))
    name = r"(\p{L}{3,10})"
    day_first = rf"^(?:\p{{L}}{{2,10}}\.?,? )?(\d{{1,2}})(?:\.|st|nd|rd|th)?[ -]{name}\.?,?[ -](\d{{4}})(?=$|[ ,T])(.*)$"
    month_first = rf"^(?:\p{{L}}{{2,10}}\.?,? )?{name}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?=$|[ ,T])(.*)$"
    dotted = r"^(\d{1,2})([./-])(\d{1,2})\2(\d{4})(?=$|[ ,T])(.*)$"
    basic = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(.*)$"
    basic_minutes = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(?=$|\D)(.*)$"
    digits = r"^(\d{9,17})(?:[.,](\d+))?$"
    s, g = F.col("_s"), lambda pattern, k: F.regexp_extract(F.col("_s"), pattern, k)

    # Every notation is written as year-month-day first; only the branch that applies is computed.
    iso = (
        F.when(s.rlike(r"^\d{4}-"), s)
        .when(s.rlike(basic), F.regexp_replace(s, basic, "$1-$2-$3 $4:$5:$6$7"))
        .when(s.rlike(basic_minutes), F.regexp_replace(s, basic_minutes, "$1-$2-$3 $4:$5$6"))
        .when(s.rlike(r"^\d{4}([/.])\d{1,2}\1\d"), F.regexp_replace(s, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3"))
        .when(s.rlike(dotted), F.regexp_replace(s, dotted, "$4-$3-$1$5"))
        .when(s.rlike(day_first), F.concat(g(day_first, 3), F.lit("-"), month(g(day_first, 2)), F.lit("-"), g(day_first, 1), g(day_first, 4)))
        .when(s.rlike(month_first), F.concat(g(month_first, 3), F.lit("-"), month(g(month_first, 1)), F.lit("-"), g(month_first, 2), g(month_first, 4)))
    )
    tail = r" ?(?:Uhr|h)?(?=$|[ \[+\-−\p{L}]) ?([AaPp]\.?[Mm]\.?(?=$| ))? ?(.*)$"
    timed = rf"^(\d{{4}}-\d{{1,2}}-\d{{1,2}})(?:,? |[Tt])({TIME}){tail}"
    dated = r"^(\d{4}-\d{1,2}-\d{1,2})(?=$|[ \[Zz+]) ?([^\d].*)?$"
    df = df.withColumn("_s", F.regexp_replace(F.regexp_replace("raw", f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+", " "))
    df = df.withColumn("_iso", iso)
    df = df.withColumn("_t", F.col("_iso").rlike(timed))
    pick = lambda t, d: F.when(F.col("_t"), F.regexp_extract("_iso", timed, t)).otherwise(F.regexp_extract("_iso", dated, d) if d else F.lit(""))
    df = df.withColumns({"_date": pick(1, 1), "_time": F.replace(pick(2, 0), F.lit(","), F.lit(".")), "_half": F.upper(F.substring(pick(3, 0), 1, 1)), "_zone": pick(4, 2)})
    time, half, zone = F.col("_time"), F.col("_half"), F.col("_zone")
    hour = _int(F.regexp_extract(time, r"^(\d{1,2})", 1))
    full = F.when(time == "", "00:00:00").when(time.rlike(r"^\d{1,2}:\d{2}$"), F.concat(time, F.lit(":00"))).otherwise(time)
    shift = F.when(half == "", 0).when((hour < 1) | (hour > 12) | (time == ""), None).when((half == "P") & (hour < 12), 12).when((half == "A") & (hour == 12), -12).otherwise(0)
    df = df.withColumns({"_wall": F.when(F.col("_date") != "", F.concat("_date", F.lit("T"), full, F.lit("Z")).try_cast("timestamp")), "_shift": shift.cast("bigint") * 3_600_000_000, "_offset": zone.rlike(ZONE_OFFSET)})

    named = F.regexp_replace(zone, r"^\[(.*)\]$", "$1")
    minutes = F.try_element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), F.upper(named))
    hh, mm = _int(F.regexp_extract(zone, ZONE_OFFSET, 2)), _int(F.regexp_extract(zone, ZONE_OFFSET, 3))
    offset = F.when((hh <= 18) & (mm < 60), F.when(F.regexp_extract(zone, ZONE_OFFSET, 1) == "+", 1).otherwise(-1) * (hh * 60 + mm))
    own = F.coalesce(F.nullif(F.trim("tz"), F.lit("")), F.lit("UTC"))
    df = df.withColumns({"_east": F.when(zone == "", F.when(own == "UTC", 0)).when(F.col("_offset"), offset).otherwise(minutes), "_region": F.when(zone == "", own).when(~F.col("_offset"), named), "_us": F.unix_micros("_wall") + F.col("_shift")})
    in_region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("_us"), F.col("_region")))
    us = F.when(F.col("_east").isNotNull(), F.col("_us") - F.col("_east").cast("bigint") * 60_000_000).when(F.col("_region").isin(*zones), in_region)

    # A count since 1970; digits after the point are cut to whole microseconds.
    n, fraction = g(digits, 1), g(digits, 2)
    finer = lambda k: F.substring(F.rpad(fraction, k, "0"), 1, k)
    count = F.when(F.length(n) <= 11, F.concat(n, finer(6))).when(F.length(n) <= 14, F.concat(n, finer(3))).otherwise(n).try_cast("bigint")
    return df.select(*kept, F.when(s.rlike(digits), count).otherwise(us).alias("utc_us"))


def stacked(*parts: tuple[DataFrame, str, str, Column, Column, Column]) -> DataFrame:
    """Rows (src_table, field, row_key, raw, tz) of several fields; parts are (df, table, field, key, raw, tz)."""
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(table).alias("src_table"), F.lit(field).alias("field"), key.cast("string").alias("row_key"), raw.alias("raw"), tz.alias("tz")).where(F.col("raw").isNotNull())
        for df, table, field, key, raw, tz in parts
    ])


class InstantDictionary:
    """Distinct (source, raw, tz) and their instants, kept as Parquet; ``update`` parses only what is new.

    Columns: source, raw, tz, utc_us (null if unreadable), n (rows seen when the entry was first met).
    Null raw strings are no entry. An update over an unchanged input adds nothing.
    """

    KEY = ("source", "raw", "tz")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.counted = False  # whether ``n`` counts the rows that are joined next

    def table(self) -> DataFrame:
        return self.spark.read.schema("source string, raw string, tz string, utc_us bigint, n bigint").parquet(self.path)

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def update(self, rows: DataFrame) -> DataFrame:
        """Add the distinct values of ``rows`` (source, raw, tz) that have no entry yet."""
        new = rows.where(F.col("raw").isNotNull()).groupBy(*self.KEY).agg(F.count(F.lit(1)).alias("n"))
        self.counted = not self.exists()
        if not self.counted:
            old = self.table().select(*[F.col(k).alias(f"_{k}") for k in self.KEY])
            new = new.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.KEY], "left_anti")
        zones = zone_names(self.spark)
        parsed(new, zones).select(*self.KEY, "utc_us", "n").write.mode("append").parquet(self.path)
        return self.table()

    def join(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``utc_us``; values that are no instant are left out.

        A value that many rows hold is looked up in a broadcast of such values (at most MOST_HOT of
        them), the rest by a shuffled join, so no task gets the rows of a hot value.
        """
        table = self.table().where(F.col("utc_us").isNotNull())
        if not self.counted:  # the dictionary is older than the rows, so these are counted anew
            now = rows.where(F.col("raw").isNotNull()).groupBy(*[F.col(k).alias(f"_{k}") for k in self.KEY]).agg(F.count(F.lit(1)).alias("_n"))
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.KEY]
            table = table.drop("n").join(now, same).select(*self.KEY, "utc_us", F.col("_n").alias("n"))
        total = table.agg(F.sum("n")).first()[0] or 0
        hot, limit = hot_keys(table, "n", total)
        cold = table.where(F.col("n") <= limit)
        take = lambda d: d.select(*[F.col(k).alias(f"_{k}") for k in self.KEY], "utc_us")
        on = [F.col("source") == F.col("_source"), F.col("raw") == F.col("_raw"), F.col("tz").eqNullSafe(F.col("_tz"))]
        drop = [f"_{k}" for k in self.KEY]
        out = rows.join(take(cold), on, "inner").drop(*drop)
        if hot.limit(1).count():
            out = out.unionByName(rows.join(F.broadcast(take(hot)), on, "inner").drop(*drop))
        return out


def normalised(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(src_table, field, row_key, utc_us) of ``stacked`` rows, without repeated rows."""
    spark = rows.sparkSession
    rows = rows.withColumn("source", F.concat_ws(".", "src_table", "field"))
    book = InstantDictionary(spark, path or temporary(spark, "instants"))
    book.update(rows.select("source", "raw", "tz"))
    return book.join(rows).select("src_table", "field", "row_key", "utc_us").distinct()

