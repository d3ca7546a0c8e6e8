"""Queries of the data-cleaning operators: p2 (instants), p4 (nested records), p6 (orphans)."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import instants
from ledgerloom.operators.instants import InstantDictionary, normalised, stacked
from ledgerloom.operators.nested import ACTIONS, flattened
from ledgerloom.operators.orphans import orphan_report, orphans
from ledgerloom.runtime import temporary, written


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    recall, files = table(spark, sf, "recall_log"), table(spark, sf, "files")
    return normalised(stacked(
        (recall, "recall_log", "ts", F.col("rec_id"), F.col("ts"), F.col("tz")),
        (files, "files", "ingested_at", F.col("path"), F.col("ingested_at"), F.col("tz")),
        (files, "files", "last_modified_at", F.col("path"), F.col("last_modified_at"), F.col("tz")),
    ))


def p2_by_days(spark: SparkSession, sf: str) -> DataFrame:
    """How many readable and unreadable values the dictionary has after the log's first days, and after the rest is added."""
    log = table(spark, sf, "recall_log")
    rows = log.where("ts is not null").select(F.lit("recall_log.ts").alias("source"), F.col("ts").alias("raw"), "tz", "log_day")
    book = InstantDictionary(spark, temporary(spark, "instants"))
    early = F.col("log_day") < F.lit("2025-07-01").cast("date")
    count = lambda step: book.table().groupBy(F.col("utc_us").isNotNull().alias("readable")).agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(step))
    book.update(rows.where(early))
    first = written(count(1), "step")
    book.update(rows)
    return first.unionByName(count(2)).select("step", "readable", "n")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "dream_log").select("cycle_id", "actions").distinct()
    return flattened(log, "actions", ["cycle_id"])


def _level(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "dream_log").select("cycle_id", "ts", "actions").distinct()
    return flattened(log, "actions", ["cycle_id", "ts"])


def p4_items(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf).where("probe_no < 0").select("cycle_id", "ts", "action", "item_no", F.col("item_value").alias("item"))


def p4_probes(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf).where("probe_no >= 0 and url_no < 0").select("cycle_id", "ts", "action", "item_no", "probe_no", F.col("item_value").alias("probe"))


def p4_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf).where("url_no >= 0").select("cycle_id", "ts", "action", "item_no", "probe_no", "url_no", F.col("item_value").alias("url"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans(table(spark, sf, "edges"), table(spark, sf, "files"))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(p6_found(spark, sf))


QUERIES = {f.__name__: f for f in (p2_found, p2_by_days, p4_found, p4_items, p4_probes, p4_urls, p6_found, p6_report)}

_ORPHANS = r"""
  SELECT DISTINCT e.src, e.dst, e.edge_type, strftime(e.seen_at, '%Y-%m') AS period,
    CASE WHEN count(f.key) = 0 THEN 'missing'
         WHEN bool_or(coalesce(f.indexed_at, TIMESTAMP '1900-01-01') <= e.seen_at AND coalesce(f.deleted_at, TIMESTAMP '9999-01-01') > e.seen_at) THEN ''
         WHEN bool_or(coalesce(f.indexed_at, TIMESTAMP '1900-01-01') <= e.seen_at) THEN 'deleted' ELSE 'late' END AS reason
  FROM (SELECT DISTINCT src, dst, edge_type, seen_at,
          CASE WHEN edge_type = 'wikilink' THEN 'w:' || trim(regexp_replace(dst, '[#|].*$', ''))
               ELSE 'p:' || url_decode(regexp_replace(regexp_replace(dst, '#.*$', ''), '^(\./)+', '')) END AS key
        FROM edges WHERE (edge_type IN ('md_link', 'wikilink') OR edge_type LIKE 'frontmatter\_%' ESCAPE '\') AND dst IS NOT NULL) e
  LEFT JOIN (SELECT DISTINCT 'p:' || path AS key, indexed_at, deleted_at FROM files WHERE path IS NOT NULL
             UNION ALL
             SELECT DISTINCT 'w:' || regexp_replace(regexp_replace(path, '^.*/', ''), '\.md$', ''), indexed_at, deleted_at FROM files WHERE path IS NOT NULL) f
    ON f.key = e.key
  GROUP BY e.src, e.dst, e.edge_type, e.seen_at
"""

# Lists of a JSON value: an array's elements, a text that holds an array read as one, a lone value as a list of one.
_TEXT = "json_extract_string({0}, '$')"
_LIST = (
    "CASE WHEN json_type({0}) = 'VARCHAR' AND trim(" + _TEXT + ") LIKE '[%' AND json_valid(" + _TEXT + ") THEN json_extract(trim(" + _TEXT + ")::JSON, '$[*]')"
    " WHEN json_type({0}) = 'ARRAY' THEN json_extract({0}, '$[*]') ELSE [{0}] END"
)
_VALUE = (
    "CASE WHEN json_type({0}) = 'VARCHAR' THEN json_extract_string({0}, '$') ELSE coalesce(" + ", ".join(f"CASE WHEN json_type({{0}}, '$.{k}') = 'VARCHAR' THEN json_extract_string({{0}}, '$.{k}') END" for k in ACTIONS.values) + ") END"
)


def _level_sql(source: str, keys: str, value: str, number: str) -> str:
    listed = f"(SELECT {keys}, unnest(range(len(l))) AS n, unnest(l) AS e FROM (SELECT {keys}, {_LIST.format(value)} AS l FROM {source} WHERE {value} IS NOT NULL))"
    return f"(SELECT {keys}, n::INT AS {number}, e FROM {listed} WHERE json_type(e) IN ('VARCHAR', 'OBJECT'))"


_NESTED = f"""
  WITH r AS (SELECT DISTINCT cycle_id, CASE WHEN json_valid(actions) THEN actions END AS a FROM dream_log),
  s AS (SELECT cycle_id, CASE WHEN json_type(a) = 'VARCHAR' THEN CASE WHEN json_valid({_TEXT.format('a')}) THEN {_TEXT.format('a')} END ELSE a END AS a FROM r WHERE a IS NOT NULL),
  o AS (SELECT cycle_id, action, json_extract(a, '$.' || action) AS v FROM s, (SELECT unnest([{', '.join(map(repr, ACTIONS.tops))}]) AS action) WHERE json_type(a) = 'OBJECT'),
  i AS {_level_sql('o', 'cycle_id, action', 'v', 'item_no')},
  p AS {_level_sql("(SELECT cycle_id, action, item_no, json_extract(e, '$.probes') AS v FROM i WHERE json_type(e) = 'OBJECT')", 'cycle_id, action, item_no', 'v', 'probe_no')},
  u AS {_level_sql("(SELECT cycle_id, action, item_no, probe_no, json_extract(e, '$.urls') AS v FROM p WHERE json_type(e) = 'OBJECT')", 'cycle_id, action, item_no, probe_no', 'v', 'url_no')}
"""

# ---- SQL of p2: the notations one after the other, offsets of a zone on the day before and after a wall time

_BLANK = r"[\s\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]"
_NAMED = r"(\p{L}{3,10})"
_REST = r"((?:[ ,T].*)?)$"
_DAY_FIRST = rf"^(?:\p{{L}}{{2,10}}\.?,? )?(\d{{1,2}})(?:\.|st|nd|rd|th)?[ -]{_NAMED}\.?,?[ -](\d{{4}}){_REST}"
_MONTH_FIRST = rf"^(?:\p{{L}}{{2,10}}\.?,? )?{_NAMED}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_REST}"
_DOTTED = r"^(\d{1,2})(?:\.(\d{1,2})\.|/(\d{1,2})/|-(\d{1,2})-)(\d{4})" + _REST
_BASIC = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})"
_TIMED = r"^(\d{4}-\d{1,2}-\d{1,2})(?:,? |[Tt])(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)"
_OFFSET = r"^(?:UTC|GMT)?([+\-−])(\d{1,2})(?::?(\d{2}))?(?:\[[^\]]*\])?$"


def _got(c: str, pattern: str, i: int) -> str:
    return f"regexp_extract({c}, '{pattern}', {i})"


def _case(c: str, pairs: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + " END"


def _instants(rows: str) -> str:
    """SQL of (src_table, field, row_key, utc_us) from rows with ``raw`` and ``tz``."""
    month = lambda c: f"coalesce({_case(f'lower({c})', {n: repr(f'{m:02d}') for m, names in instants.MONTHS.items() for n in names})}, '00')"
    ymd = lambda c, d, m, y, rest: f"{_got('s', c, y)} || '-' || {m} || '-' || {_got('s', c, d)} || {_got('s', c, rest)}"
    zones = ", ".join(f"'{z}'" for z in sorted(zoneinfo.available_timezones()))
    off = lambda us, tz: f"(epoch_us(timezone({tz}, make_timestamptz({us}))) - {us})"
    return rf"""
  WITH r AS ({rows}), a AS (SELECT *, regexp_replace(regexp_replace(raw, '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_BLANK}+', ' ', 'g') AS s FROM r WHERE raw IS NOT NULL),
  b AS (SELECT *, CASE WHEN regexp_matches(s, '^\d{{4}}-') THEN s
      WHEN regexp_matches(s, '{_BASIC}\d{{2}}') THEN regexp_replace(s, '{_BASIC}(\d{{2}})', '\1-\2-\3 \4:\5:\6')
      WHEN regexp_matches(s, '{_BASIC}(\D|$)') THEN regexp_replace(s, '{_BASIC}', '\1-\2-\3 \4:\5')
      WHEN regexp_matches(s, '^\d{{4}}(/\d{{1,2}}/|\.\d{{1,2}}\.)\d') THEN regexp_replace(s, '^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}})', '\1-\2-\3')
      WHEN regexp_matches(s, '{_DOTTED}') THEN {ymd(_DOTTED, 1, ' || '.join(_got('s', _DOTTED, i) for i in (2, 3, 4)), 5, 6)}
      WHEN regexp_matches(s, '{_DAY_FIRST}') THEN {ymd(_DAY_FIRST, 1, month(_got('s', _DAY_FIRST, 2)), 3, 4)}
      WHEN regexp_matches(s, '{_MONTH_FIRST}') THEN {ymd(_MONTH_FIRST, 2, month(_got('s', _MONTH_FIRST, 1)), 3, 4)} END AS iso FROM a),
  c AS (SELECT *, regexp_matches(iso, '{_TIMED}') AS t, regexp_replace(regexp_replace(iso, '{_TIMED}', ''), '^ ?(?:Uhr|h)?', '') AS after, regexp_replace(iso, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}', '') AS rest FROM b),
  d AS (SELECT *, CASE WHEN t AND regexp_matches(after, '^($|[ \[+\-−]|\p{{L}})') THEN {_got('iso', _TIMED, 1)}
      WHEN NOT t AND regexp_matches(iso, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}($|[ \[Zz+])') AND NOT regexp_matches(rest, '^ ?\d') THEN regexp_extract(iso, '^\d{{4}}-\d{{1,2}}-\d{{1,2}}') END AS day,
      CASE WHEN t THEN replace({_got('iso', _TIMED, 2)}, ',', '.') ELSE '' END AS clock, CASE WHEN t THEN regexp_replace(after, '^ ', '') ELSE regexp_replace(rest, '^ ', '') END AS tail FROM c),
  e AS (SELECT *, CASE WHEN t THEN upper(regexp_extract(tail, '^([AaPp])\.?[Mm]\.?(?: |$)', 1)) ELSE '' END AS half,
      CASE WHEN t THEN regexp_replace(tail, '^(?:[AaPp]\.?[Mm]\.?(?: |$))', '') ELSE tail END AS zone, string_split(day, '-') AS p, regexp_extract(clock, '^(\d{{1,2}})', 1) AS hh FROM d),
  f AS (SELECT *, epoch_us(TRY_CAST(p[1] || '-' || lpad(p[2], 2, '0') || '-' || lpad(p[3], 2, '0') || ' ' || CASE WHEN clock = '' THEN '00:00:00'
          ELSE lpad(hh, 2, '0') || regexp_extract(clock, ':\d{{2}}') || coalesce(nullif(regexp_extract(clock, ':\d{{2}}(:\d{{2}}(?:\.\d{{1,6}})?)', 1), ''), ':00') END AS TIMESTAMP))
        + CASE WHEN half = '' THEN 0 WHEN TRY_CAST(hh AS INT) NOT BETWEEN 1 AND 12 THEN NULL WHEN half = 'P' AND hh::INT < 12 THEN 12 WHEN half = 'A' AND hh::INT = 12 THEN -12 ELSE 0 END * 3600000000 AS w,
      regexp_matches(zone, '{_OFFSET}') AS o, regexp_replace(zone, '^\[(.*)\]$', '\1') AS named, coalesce(nullif(trim(tz), ''), 'UTC') AS own FROM e),
  g AS (SELECT *, CASE WHEN zone = '' THEN CASE WHEN own = 'UTC' THEN 0 END
        WHEN o THEN CASE WHEN {_got('zone', _OFFSET, 2)}::INT <= 18 AND coalesce(nullif({_got('zone', _OFFSET, 3)}, ''), '0')::INT < 60
          THEN CASE WHEN {_got('zone', _OFFSET, 1)} = '+' THEN 1 ELSE -1 END * ({_got('zone', _OFFSET, 2)}::INT * 60 + coalesce(nullif({_got('zone', _OFFSET, 3)}, ''), '0')::INT) END
        ELSE {_case('upper(named)', instants.ABBREVIATIONS)} END AS east,
      CASE WHEN zone = '' THEN own WHEN NOT o THEN named END AS region FROM f),
  h AS (SELECT *, CASE WHEN region IN ({zones}) THEN region ELSE 'UTC' END AS z, region IN ({zones}) AS known FROM g),
  k AS (SELECT *, {off('(w - 86400000000)', 'z')} AS o1, {off('(w + 86400000000)', 'z')} AS o2 FROM h),
  l AS (SELECT src_table, field, row_key, CASE WHEN regexp_matches(s, '^\d{{9,17}}(?:[.,]\d+)?$') THEN
        TRY_CAST(CASE WHEN length(n) <= 11 THEN n || substr(rpad(fr, 6, '0'), 1, 6) WHEN length(n) <= 14 THEN n || substr(rpad(fr, 3, '0'), 1, 3) ELSE n END AS BIGINT)
      WHEN east IS NOT NULL THEN w - east::BIGINT * 60000000
      WHEN known THEN CASE WHEN {off('(w - o1)', 'z')} = o1 THEN w - o1 WHEN {off('(w - o2)', 'z')} = o2 THEN w - o2 ELSE w - o1 END END AS utc_us
    FROM (SELECT *, regexp_extract(s, '^(\d{{9,17}})', 1) AS n, regexp_extract(s, '^\d{{9,17}}[.,](\d+)$', 1) AS fr FROM k))
  SELECT DISTINCT src_table, field, row_key, utc_us FROM l WHERE utc_us IS NOT NULL"""


_STAMPS = """SELECT 'recall_log' AS src_table, 'ts' AS field, rec_id::VARCHAR AS row_key, ts AS raw, tz FROM recall_log
    UNION ALL SELECT 'files', 'ingested_at', path, ingested_at, tz FROM files UNION ALL SELECT 'files', 'last_modified_at', path, last_modified_at, tz FROM files"""
# Entries of the dictionary by the first row of the log that has them.
_ENTRIES = """SELECT 'recall_log.ts' AS src_table, ts AS field, tz AS row_key, ts AS raw, tz FROM (SELECT DISTINCT ts, tz FROM recall_log WHERE ts IS NOT NULL {0})"""


def _readable(step: int, where: str) -> str:
    rows = _ENTRIES.format(where)
    return f"""SELECT {step} AS step, readable, count(*) AS n FROM (
      SELECT coalesce(y.utc_us, 0) <> 0 AS readable FROM (SELECT DISTINCT ts, tz FROM recall_log WHERE ts IS NOT NULL {where}) x
      LEFT JOIN ({_instants(rows)}) y ON y.field = x.ts AND y.row_key IS NOT DISTINCT FROM x.tz) GROUP BY readable"""


ORACLE = {
    "p2_found": _instants(_STAMPS),
    "p2_by_days": _readable(1, "AND log_day < DATE '2025-07-01'") + " UNION ALL " + _readable(2, ""),
    "p4_found": f"""{_NESTED} SELECT cycle_id, action, item_no, -1 AS probe_no, -1 AS url_no, {_VALUE.format('e')} AS item_value FROM i
      UNION ALL SELECT cycle_id, action, item_no, probe_no, -1, {_VALUE.format('e')} FROM p UNION ALL SELECT cycle_id, action, item_no, probe_no, url_no, {_VALUE.format('e')} FROM u""",
    "p4_items": f"{_NESTED} SELECT i.cycle_id, ts, action, item_no, {_VALUE.format('e')} AS item FROM i JOIN (SELECT DISTINCT cycle_id, ts FROM dream_log) t USING (cycle_id)",
    "p4_probes": f"{_NESTED} SELECT p.cycle_id, ts, action, item_no, probe_no, {_VALUE.format('e')} AS probe FROM p JOIN (SELECT DISTINCT cycle_id, ts FROM dream_log) t USING (cycle_id)",
    "p4_urls": f"{_NESTED} SELECT u.cycle_id, ts, action, item_no, probe_no, url_no, {_VALUE.format('e')} AS url FROM u JOIN (SELECT DISTINCT cycle_id, ts FROM dream_log) t USING (cycle_id)",
    "p6_found": f"SELECT * FROM ({_ORPHANS}) WHERE reason <> ''",
    "p6_report": f"SELECT edge_type, period, reason, count(*) AS n_orphans FROM ({_ORPHANS}) WHERE reason <> '' GROUP BY ALL",
}
