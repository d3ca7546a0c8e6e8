import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from ledgerloom.operators import instants as I

EPOCH = datetime(1970, 1, 1)
NAMES = {n: m for m, names in I.MONTHS.items() for n in names}


def brute(raw, tz):
    """One value at a time, by datetime and zoneinfo."""
    if raw is None:
        return None
    s = " ".join(re.sub(r"[​﻿]", " ", raw).split())
    if m := re.fullmatch(r"(\d{9,17})(?:[.,](\d+))?", s):
        n, f = m[1], m[2] or ""
        if len(n) <= 11:
            return int(n + f.ljust(6, "0")[:6])
        return int(n + f.ljust(3, "0")[:3]) if len(n) <= 14 else int(n)
    time = r"(?:[ ,T]+(\d{1,2}):?(\d\d)(?::?(\d\d)(?:[.,](\d+))?)?(?: Uhr)?(?: ?([AP])M\b)?)?"
    zone = r" ?(\[?[A-Za-z+-][\w:/+-]*\]?)?"
    for order, pattern in (
        ("ymd", r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"),
        ("ymd", r"(\d{4})(\d\d)(\d\d)"),
        ("dmy", r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})"),
        ("dmy", r"(?:\w+, )?(\d{1,2})\.? ([^\W\d]+) (\d{4})"),
        ("mdy", r"([^\W\d]+) (\d{1,2}), (\d{4})"),
    ):
        m = re.fullmatch(pattern + time + zone, s.replace("t", "T") if s[:4].isdigit() and "/" not in s else s, re.I)
        if m:
            break
    else:
        return None
    part = dict(zip(order, m.groups()[:3]))
    month = NAMES.get(part["m"].lower(), 0) if not part["m"].isdigit() else int(part["m"])
    h, mi, sec, frac, half, z = m.groups()[3:]
    h = int(h or 0)
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half.upper() == "P" else 0)
    try:
        wall = datetime(int(part["y"]), month, int(part["d"]), h, int(mi or 0), int(sec or 0))
    except ValueError:
        return None
    us = int((frac or "").ljust(6, "0")[:6])
    z = (z or "").strip("[]") or (tz or "").strip() or "UTC"
    if z.upper() in I.ABBREVIATIONS:
        off = timedelta(minutes=I.ABBREVIATIONS[z.upper()])
    elif o := re.fullmatch(r"([+-])(\d\d):?(\d\d)?", z):
        off = timedelta(hours=int(o[2]), minutes=int(o[3] or 0)) * (1 if o[1] == "+" else -1)
    else:
        try:
            off = wall.replace(tzinfo=ZoneInfo(z), fold=0).utcoffset()
        except Exception:
            return None
    return (wall - off - EPOCH) // timedelta(microseconds=1) + us


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, tz string")


def test_each_notation_agrees_with_brute_force(spark):
    r = spark.read.parquet("/root/testdata/sf0.01/recall_log.parquet").select("ts", "tz")
    f = spark.read.parquet("/root/testdata/sf0.01/files.parquet")
    rows = {tuple(x) for d in (r, f.select("ingested_at", "tz"), f.select("last_modified_at", "tz")) for x in d.collect()}
    rows = sorted(rows, key=str)
    got = I.parsed(frame(spark, rows), I.zone_names(spark)).orderBy("i").collect()
    assert [(x.raw, x.tz, x.utc_us) for x in got] == [(r, t, brute(r, t)) for r, t in rows]


def test_clock_changes_and_precedence(spark):
    rows = {
        ("2025-10-26 02:30:00", "Europe/Berlin"): "2025-10-26T00:30:00",  # occurs twice: the earlier
        ("2025-03-30 02:30:00", "Europe/Berlin"): "2025-03-30T01:30:00",  # skipped: offset before the change
        ("2025-03-09 02:15", "America/New_York"): "2025-03-09T07:15:00",
        ("2025-06-01T12:00:00-05:00", "Asia/Tokyo"): "2025-06-01T17:00:00",
        ("2025-06-01T12:00:00[Asia/Tokyo]", "UTC"): "2025-06-01T03:00:00",
        ("2025-06-01T12:00:00+02:00[Asia/Tokyo]", "UTC"): "2025-06-01T10:00:00",
        ("06/01/2025 13:27", None): "2025-01-06T13:27:00",
        ("2025/03/30 02:49", None): "2025-03-30T02:49:00",
        ("6. März 2025, 04:29 Uhr", "UTC"): "2025-03-06T04:29:00",
        ("Jan 12, 2025 12:00:01 AM", "UTC"): "2025-01-12T00:00:01",
        ("2025-01-06T03:27:23.728165999Z", "UTC"): "2025-01-06T03:27:23.728165",
        ("2025-07-16", "Asia/Kolkata"): "2025-07-15T18:30:00",
        ("\t2025-01-12T16:06:39Z ", ""): "2025-01-12T16:06:39",
    }
    got = I.parsed(frame(spark, list(rows)), I.zone_names(spark)).orderBy("i").collect()
    want = [(datetime.fromisoformat(v) - EPOCH) // timedelta(microseconds=1) for v in rows.values()]
    assert [x.utc_us for x in got] == want


def test_unreadable_values_give_no_row(spark):
    bad = [None, "", " ", "pending", "2025-02-30", "2026-13-04 09:12", "0000-00-00", "25:61", "2026-05-T11:20:00Z", "~2026-05-14", "x" * 100_000, "2025-01-01T25:00:00Z", "2025-01-01 10:00:00 Nowhere/Land"]
    assert not [x for x in I.parsed(frame(spark, [(b, "UTC") for b in bad]), I.zone_names(spark)).collect() if x.utc_us is not None]


def test_dictionary_grows_by_new_values_only(spark, tmp_path):
    book = I.InstantDictionary(spark, str(tmp_path / "book"))
    one = spark.createDataFrame([("a", "2025-01-01", None)] * 3 + [("a", "junk", "UTC")], "source string, raw string, tz string")
    two = one.unionByName(spark.createDataFrame([("a", "2025-01-02", "UTC"), ("b", "2025-01-01", None)], one.schema))
    book.update(one)
    assert book.table().count() == 2
    book.update(two)
    assert book.table().count() == 4
    assert sorted((r.raw, r.n) for r in book.table().where("source = 'a'").collect()) == [("2025-01-01", 3), ("2025-01-02", 1), ("junk", 1)]
    joined = book.join(two.withColumn("extra", F.lit("raw"))).collect()
    assert len(joined) == 5 and all(r.utc_us for r in joined)


def test_hot_value_takes_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "hot_keys", lambda c, n, total: (c.where(F.col(n) > 5), 5))
    rows = spark.createDataFrame([("s", "2025-01-01", "UTC", i) for i in range(20)] + [("s", "2025-01-02", None, 99)], "source string, raw string, tz string, k int")
    book = I.InstantDictionary(spark, str(tmp_path / "book"))
    book.update(rows)
    assert book.join(rows).count() == 21
    later = I.InstantDictionary(spark, str(tmp_path / "book"))
    assert later.join(rows.unionByName(rows)).count() == 42


def test_empty_table_and_repeated_rows(spark):
    rows = spark.createDataFrame([("7", "2025-01-01", None), ("7", "2025-01-01", None)], "k string, v string, z string")
    part = lambda d: (d, "t", "f", F.col("k"), F.col("v"), F.col("z"))
    assert I.normalised(I.stacked(part(rows.limit(0)))).count() == 0
    assert [tuple(r) for r in I.normalised(I.stacked(part(rows))).collect()] == [("t", "f", "7", int(datetime(2025, 1, 1, tzinfo=timezone.utc).timestamp()) * 10**6)]
