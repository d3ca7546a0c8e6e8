"""Queries of the operators on text and statistics: p1, p3, p5, p7, p8, p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import pairs
from ledgerloom.llm import percentiles as pct
from ledgerloom.llm import terms
from ledgerloom.llm.leakage import leaks
from ledgerloom.llm.mixing import Mix, _segments
from ledgerloom.llm.pairs import defects
from ledgerloom.llm.sentences import sentences
from ledgerloom.runtime import plain, written


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- p1: defective question-answer pairs


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return defects(table(spark, sf, "tests")).select("path", "id", "defect")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return p1_found(spark, sf).groupBy("defect").agg(F.count(F.lit(1)).alias("n_pairs"))


# ---- p3: percentiles of duration_ms

GROUP = ["topic_hint", "decided_source"]


def _durations(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "recall_log").where("duration_ms > 0")
    return log.select(plain("topic_hint").alias("topic_hint"), plain("decided_source").alias("decided_source"), "log_day", "rec_id", "duration_ms")


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """``err`` is the greatest error of a percentile's rank."""
    state = pct.merged(pct.states(_durations(spark, sf), GROUP, "duration_ms", ["rec_id"]), GROUP)
    q = pct.percentiles(state, GROUP, (0.5, 0.9, 0.95, 0.99))
    return q.select(*GROUP, "n", *[F.element_at("q", i + 1).alias(c) for i, c in enumerate(("p50", "p90", "p95", "p99"))], "err")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_percentiles(spark, sf).where("n >= 30 and p95 >= 8 * p50").select(*GROUP)


def p3_days(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles per source from states that were made per log day and then combined."""
    daily = pct.states(_durations(spark, sf).where("log_day is not null"), ["decided_source", "log_day"], "duration_ms", ["rec_id"])
    q = pct.percentiles(pct.merged(daily.drop("log_day"), ["decided_source"]), ["decided_source"], (0.5, 0.95))
    return q.select("decided_source", "n", F.element_at("q", 1).alias("p50"), F.element_at("q", 2).alias("p95"))


#: Values a buffer of ``p3_within`` holds: so few that its states collapse at every scale.
SMALL_K = 32


def p3_within(spark: SparkSession, sf: str) -> DataFrame:
    """Per source whether percentiles of collapsed states are within their stated error of the exact ranks."""
    shares, by = (0.5, 0.9, 0.99), ["decided_source"]
    rows = _durations(spark, sf).dropDuplicates([*by, "rec_id"]).where("decided_source is not null")
    q = written(pct.percentiles(pct.merged(pct.states(rows, by, "duration_ms", k=SMALL_K), by, SMALL_K), by, shares, SMALL_K), "percentiles")
    v = rows.join(q, "decided_source")
    below = [F.count_if(F.col("duration_ms") < F.element_at("q", i + 1)).alias(f"lt{i}") for i in range(len(shares))]
    upto = [F.count_if(F.col("duration_ms") <= F.element_at("q", i + 1)).alias(f"le{i}") for i in range(len(shares))]
    exact = v.groupBy("decided_source").agg(F.count(F.lit(1)).alias("n"), F.first("n").alias("said"), F.first("err").alias("err"), *below, *upto)
    fine = F.col("n") == F.col("said")
    for i, p in enumerate(shares):
        rank = F.ceil(F.round(F.col("n") * p, 9))
        fine = fine & (rank > F.col(f"lt{i}") - F.col("err")) & (rank <= F.col(f"le{i}") + F.col("err"))
    return exact.select("decided_source", "n", (F.col("err") > 0).alias("collapsed"), (F.col("err") <= F.greatest(F.lit(1.0), F.lit(0.5) * F.col("n"))).alias("bounded"), fine.alias("within"))


# ---- p5: frequency of every term


def _fields() -> dict:
    return {"topic_hint": terms.pieces("topic_hint"), "reconciliation_pattern": terms.whole("reconciliation_pattern"), "decided_source": terms.whole("decided_source")}


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "recall_log").select("rec_id", "topic_hint", "reconciliation_pattern", "decided_source", "log_day")


#: The days at the end of the log that come as a feed of their own.
LATE_DAYS = 30


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the log up to its last days, and the records of these days merged into them."""
    log = _records(spark, sf)
    last = log.agg(F.max("log_day")).first()[0]
    late = F.coalesce(F.col("log_day") > F.date_sub(F.lit(last).cast("date"), LATE_DAYS), F.lit(False))
    counts = terms.TermCounts(spark)
    for part in (~late, late):  # a record's repeated rows have one log_day, so they meet in one feed
        counts.apply(terms.delta(terms.signed(log.where(part).drop("log_day").distinct()), _fields()))
    return counts.marked()


def p5_by_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts, reached by three feeds: records up to mid 2025, a snapshot change, later records."""
    log = _records(spark, sf).distinct()
    late = F.coalesce(F.col("log_day") >= F.lit("2025-07-01").cast("date"), F.lit(False))
    early, rest = log.where(~late), log.where(late)
    wrong = early.withColumn("topic_hint", F.when(F.col("decided_source") == "web", F.lit("x|y,x")).otherwise(F.col("topic_hint")))
    counts = terms.TermCounts(spark).apply(terms.delta(terms.signed(wrong), _fields()))
    counts.apply(terms.delta(terms.changes(wrong, early, "rec_id"), _fields()))
    return counts.apply(terms.delta(terms.signed(rest), _fields())).marked()


# ---- p7: held-out passages in documents


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "heldout")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    return p7_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


# ---- p8: sources mixed to target weights

#: Weights over the training time; sources not named here are even.
CURRICULUM = {
    "curated_canon": ((0.0, 0.2), (0.6, 0.6), (1.0, 2.6)),
    "synthesis_briefs": ((0.0, 0.5), (1.0, 1.5)),
    "session_logs": ((0.0, 1.6), (0.5, 1.0), (1.0, 0.4)),
    "forum_threads": ((0.0, 1.4), (1.0, 0.6)),
}


def _mix(spark: SparkSession, sf: str) -> Mix:
    return Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), CURRICULUM)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).placed()


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report().where("short").select("source")


def p8_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """The mix with sizes in bytes, which SQL can count too: every copy and its position."""
    mix = Mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), CURRICULUM, measure=F.octet_length("text"))
    return mix.placed().select(F.round("position", 5).alias("position"), "doc_id", "source", "copy", F.col("n_tokens").alias("n_bytes"))


# ---- p9: sentence units


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(table(spark, sf, "documents")).distinct()


def p9_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Units and code points in units per document."""
    size = F.col("end_pos") - F.col("start_pos")
    return p9_found(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum(size).alias("n_chars"), F.max(size).alias("longest"))


def p9_planted(spark: SparkSession, sf: str) -> DataFrame:
    """Units of texts put together from the questions of the tests, so that every unit is known: a heading, a paragraph with
    the question twice (without a blank between where its script has none), and a list item."""
    q = F.col("q")
    asked = table(spark, sf, "tests").where(q.rlike(r"^[^\s\p{Ll}][^\n.!]*[?？]$")).select("q").distinct()
    text = F.concat(F.lit("# Title\n\n"), q, F.when(q.endswith("？"), F.lit("")).otherwise(F.lit(" ")), q, F.lit("\n\n- "), q)
    return sentences(asked.withColumn("text", text), keys=("q",))


_PLAIN = "nullif(lower(trim({0}, ' ')), '')"
_TERMS = f"""
  WITH r AS (SELECT DISTINCT rec_id, topic_hint, reconciliation_pattern, decided_source FROM recall_log),
  t AS (
    SELECT 'topic_hint' AS field, rec_id, {_PLAIN.format('p')} AS term FROM (SELECT rec_id, unnest(regexp_split_to_array(topic_hint, '[,;|]')) AS p FROM r)
    UNION ALL SELECT 'reconciliation_pattern', rec_id, {_PLAIN.format('reconciliation_pattern')} FROM r
    UNION ALL SELECT 'decided_source', rec_id, {_PLAIN.format('decided_source')} FROM r)
  SELECT field, term, count(*) AS n_occ, count(DISTINCT rec_id) AS n_rec,
    CASE WHEN count(DISTINCT rec_id) < 5 THEN 'rare' WHEN count(DISTINCT rec_id) * 20 > (SELECT count(DISTINCT rec_id) FROM r) THEN 'common' ELSE 'ok' END AS mark
  FROM t WHERE term IS NOT NULL GROUP BY field, term
"""
_DURATIONS = f"""
  SELECT DISTINCT rec_id, {_PLAIN.format('topic_hint')} AS topic_hint, {_PLAIN.format('decided_source')} AS decided_source, duration_ms
  FROM recall_log WHERE duration_ms > 0
"""

_FULL = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)).replace("'", "")
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
#: One form of a text: full-width forms, invisible characters, case and accents folded. The only quotes within are doubled.
_FORM = f"strip_accents(replace(lower(translate(regexp_replace(text, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '{_FULL}', '{_HALF}')), 'ß', 'ss'))"
_LEAKS = f"""
  WITH d AS (SELECT doc_id, regexp_extract_all({_FORM}, '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
  h AS (SELECT item_id, lang, regexp_extract_all({_FORM}, '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT DISTINCT item_id, lang, text FROM heldout WHERE text IS NOT NULL)),
  hw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM h WHERE lang NOT IN ('ja', 'zh')),
  dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM d),
  hc AS (SELECT item_id, unnest(list_transform(range(1, length(c) - 18), lambda i: c[i:i+19])) AS g FROM (SELECT item_id, array_to_string(w, '') AS c FROM h WHERE lang IN ('ja', 'zh'))),
  dc AS (SELECT doc_id, unnest(list_transform(range(1, length(c) - 18), lambda i: c[i:i+19])) AS g FROM (SELECT doc_id, array_to_string(w, '') AS c FROM d))
  SELECT DISTINCT doc_id, item_id FROM dw JOIN hw USING (g) UNION SELECT DISTINCT doc_id, item_id FROM dc JOIN hc USING (g)
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pairs_sql() -> str:
    """The defects by plain rules: what the votes are about, without rates; languages by script and function words only."""
    shown = lambda c: rf"regexp_replace(regexp_replace(replace(replace(coalesce({c}, ''), chr(10), ' '), chr(9), ' '), '[\p{{Cf}}\p{{Cc}}\p{{Zl}}\p{{Zp}}]+', '', 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    words = lambda c: f"regexp_extract_all(lower({c}), {_quoted(pairs._WORD)})"
    joined = lambda c: f"' ' || array_to_string({c}, ' ') || ' '"
    neg = _quoted(pairs.NEGATIVE_TEST)
    unwilling = pairs.UNWILLING.replace("(?= (?:on|about|from) )", " (?:on|about|from)").replace("|no comment(?= $)", "")
    said = lambda pattern, ja="": f"(regexp_matches(t, {_quoted(f' (?:{pattern}) ')})" + (f" OR kana AND regexp_matches(sa, {_quoted(ja)})" if ja else "") + ")"
    quoted = r"«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|‹[^‹›]*›|\"[^\"]*\""
    file = r"[\w./-]+\.(?:md|txt|html?|json|ya?ml|csv)\b|https?://\S+"
    bare_script = lambda c: rf"CASE WHEN regexp_matches({c}, '[\x{{3040}}-\x{{30FF}}]') THEN 'ja' WHEN length(regexp_replace(regexp_replace({c}, '\b\p{{Lu}}[\p{{L}}\p{{M}}]*', '', 'g'), '[^\p{{Cyrillic}}]', '', 'g')) > length(regexp_replace(regexp_replace({c}, '\b[A-Z][\p{{L}}\p{{M}}]*', '', 'g'), '[^a-zà-ÿ]', '', 'g')) THEN 'ru' ELSE 'latin' END"
    listed = ", ".join(f"({_quoted(l)}, {_quoted(w)})" for l, ws in pairs.FUNCTION_WORDS.items() for w in dict.fromkeys(ws))
    language = lambda c, name: rf"""{name} AS (SELECT path, id, qq, aa, CASE WHEN s <> 'latin' THEN s WHEN n1 > n2 THEN lang END AS lang FROM (
      SELECT path, id, qq, aa, s, lang, n AS n1, coalesce(lead(n) OVER w, 0) AS n2, row_number() OVER w AS r FROM (
        SELECT path, id, qq, aa, s, f.lang, count(f.lang) AS n FROM (SELECT path, id, coalesce(q, '') AS qq, coalesce(a, '') AS aa, {bare_script(c)} AS s, unnest(list_append({words(f"replace(replace({c}, '''', ' '), '’', ' ')")}, '')) AS w FROM d) LEFT JOIN f ON f.word = w GROUP BY ALL)
      WINDOW w AS (PARTITION BY path, id, qq, aa ORDER BY n DESC, lang)) WHERE r = 1)"""
    more = lambda a, b: f"length(translate(sa, '{a}', '')) < length(translate(sa, '{b}', ''))"
    return rf"""
  WITH f(lang, word) AS (VALUES {listed}),
  a AS (SELECT path, id, q, a, regexp_matches(coalesce(q, ''), {neg}) AS neg, {shown('a')} AS sa, regexp_replace({shown('q')}, {neg}, '') AS sq FROM (SELECT DISTINCT path, id, q, a FROM tests)),
  b AS (SELECT *, {words('sa')} AS w, {words('sq')} AS asked, {words("regexp_replace(sa, '^(?i:a|q|answer|question|antwort|réponse|respuesta|ответ|答え?)" + chr(92) + "s*[:：]" + chr(92) + "s*', '')")} AS said,
      regexp_replace(lower(sa), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS bare, regexp_matches(sa, '[\x{{3040}}-\x{{30FF}}]') AS kana FROM a),
  c AS (SELECT *, {joined('w')} AS t, len(w) = 0 OR bare IN ({', '.join(map(_quoted, pairs.PLACEHOLDERS))}) AS empty, regexp_replace(replace(bare, '''', ''), '[^a-z]+', '-', 'g') = 'dont-know' AS sentinel,
      len(asked) > 0 AND len(said) > 0 AND array_to_string(said, ' ') = rtrim(repeat(array_to_string(asked, ' ') || ' ', (len(said) // greatest(len(asked), 1))::INT)) AS copies,
      regexp_matches(sa, '[.!?。！？؟।]["''”’»」』）)\]*_]*$') AND NOT regexp_matches(sa, '(?:\.\.|…)[^\p{{L}}\p{{N}}]*$') AS ends,
      len(w) >= 4 OR (kana AND length(array_to_string(w, '')) >= 5) AS spoken, (len(w) > 1 AND w[-1] IN ({', '.join(sorted(set(map(_quoted, pairs.OPEN_WORDS))))})) OR (kana AND regexp_matches(bare, '(?:{'|'.join(pairs.JA_PARTICLES)})$')) AS dangling,
      {more('(（', ')）')} OR {more('[', ']')} OR {more('「', '」')} OR {more('«', '»')} AS opened,
      trim(regexp_replace(regexp_replace(sa, {_quoted(quoted)}, ' ', 'g'), {_quoted(file)}, ' ', 'g')) AS content, regexp_replace(sq, {_quoted(file)}, ' ', 'g') AS ask FROM b),
  d AS (SELECT *, empty OR sentinel OR copies AS other, {said(unwilling, pairs.UNWILLING_JA)} AND {said(pairs.ACTS, pairs.ACTS_JA)} AND (kana OR {said(pairs.SELF)}) AS declines FROM c),
  {language('ask', 'lq')}, {language('content', 'la')}
  SELECT path, id, 'empty' AS defect FROM d WHERE empty
  UNION SELECT path, id, 'copies_question' FROM d WHERE copies AND NOT empty
  UNION SELECT path, id, 'refusal' FROM d WHERE sentinel AND NOT neg OR NOT other AND declines
  UNION SELECT path, id, 'truncated' FROM d WHERE NOT other AND (NOT ends AND (spoken OR dangling) OR opened)
  UNION SELECT path, id, 'other_language' FROM (SELECT d.*, la.lang AS ll, lq.lang AS lk FROM d JOIN la ON la.path = d.path AND la.id = d.id AND la.qq = coalesce(d.q, '') AND la.aa = coalesce(d.a, '') JOIN lq ON lq.path = d.path AND lq.id = d.id AND lq.qq = coalesce(d.q, '') AND lq.aa = coalesce(d.a, ''))
    WHERE NOT other AND NOT declines AND regexp_matches(content, '\p{{Ll}}|\p{{Lo}}') AND (len({words('content')}) > 1 OR {bare_script('content')} <> 'latin') AND ll <> lk"""


def _mix_sql() -> str:
    pieces = ", ".join(str(x) for x in _segments([(s,) for s in CURRICULUM], CURRICULUM))
    return f"""
  WITH pieces(source, f0, f1, t0, t1, w0, w1) AS (SELECT c0, c1::DOUBLE, c2::DOUBLE, c3::DOUBLE, c4::DOUBLE, c5::DOUBLE, c6::DOUBLE FROM (VALUES {pieces}) v(c0, c1, c2, c3, c4, c5, c6)),
  d AS (SELECT DISTINCT doc_id, {_PLAIN.format('source')} AS source, coalesce(strlen(text), 0)::BIGINT AS n FROM documents),
  s AS (SELECT source, sum(n)::BIGINT AS supply FROM d GROUP BY source),
  g AS (SELECT source, supply, least(target_share * (SELECT sum(n) FROM d)::DOUBLE, (supply * max_repeats)::DOUBLE) AS take
        FROM (SELECT DISTINCT {_PLAIN.format('source')} AS source, target_share, max_repeats FROM mix_targets) JOIN s USING (source) WHERE source IS NOT NULL),
  o AS (SELECT d.*, supply, take, coalesce(sum(n) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id || '/0'), 1, 15))::BIGINT, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN g USING (source)),
  c AS (SELECT *, (copy * supply + before) / take AS f FROM (SELECT *, unnest(range(ceil(take / supply)::BIGINT)) AS copy FROM o WHERE take > 0) WHERE copy * supply + before < take),
  p AS (SELECT c.*, coalesce(f0, 0e0) AS f0, coalesce(t0, 0e0) AS t0, coalesce(t1, 1e0) AS t1, coalesce(w0, 1e0) AS w0, coalesce(w1, 1e0) AS w1 FROM c LEFT JOIN pieces ON pieces.source = c.source AND f >= pieces.f0 AND f < pieces.f1)
  SELECT round(t0 + least(t1 - t0, CASE WHEN f <= f0 THEN 0e0 ELSE 2 * (f - f0) / (w0 + sqrt(greatest(0e0, w0 * w0 + 2 * (w1 - w0) / (t1 - t0) * (f - f0)))) END), 5) AS position, doc_id, source, copy::INT AS copy, n AS n_bytes FROM p"""


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_percentiles, p3_days, p3_within, p5_found, p5_by_deltas, p7_found, p7_items, p8_found, p8_shares, p8_mix, p8_bytes, p9_found, p9_lengths, p9_planted)}

ORACLE = {
    "p1_found": _pairs_sql(),
    "p1_report": f"SELECT defect, count(*) AS n_pairs FROM ({_pairs_sql()}) GROUP BY defect",
    "p3_found": f"""
      SELECT topic_hint, decided_source FROM ({_DURATIONS}) WHERE topic_hint IS NOT NULL AND decided_source IS NOT NULL
      GROUP BY ALL HAVING count(*) >= 30 AND quantile_disc(duration_ms, 0.95) >= 8 * quantile_disc(duration_ms, 0.5)""",
    "p3_percentiles": f"""
      SELECT topic_hint, decided_source, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.9) AS p90,
        quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99, 0e0 AS err
      FROM ({_DURATIONS}) WHERE topic_hint IS NOT NULL AND decided_source IS NOT NULL GROUP BY ALL""",
    "p3_days": f"""
      SELECT decided_source, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95
      FROM (SELECT DISTINCT rec_id, {_PLAIN.format('decided_source')} AS decided_source, log_day, duration_ms FROM recall_log WHERE duration_ms > 0 AND log_day IS NOT NULL)
      WHERE decided_source IS NOT NULL GROUP BY decided_source""",
    "p3_within": f"""
      SELECT decided_source, count(*) AS n, count(*) >= {2 * SMALL_K} AS collapsed, true AS bounded, true AS within
      FROM ({_DURATIONS}) WHERE decided_source IS NOT NULL GROUP BY decided_source""",
    "p8_bytes": _mix_sql(),
    "p9_planted": r"""
      WITH t AS (SELECT DISTINCT q, length(q) AS n, CASE WHEN q LIKE '%？' THEN 0 ELSE 1 END AS gap FROM tests WHERE regexp_matches(q, '^[^\s\p{Ll}][^\n.!]*[?？]$'))
      SELECT q, 2 AS start_pos, 7 AS end_pos FROM t UNION ALL SELECT q, 9, 9 + n FROM t UNION ALL SELECT q, 9 + n + gap, 9 + 2 * n + gap FROM t
      UNION ALL SELECT q, 13 + 2 * n + gap, 13 + 3 * n + gap FROM t""",
    "p5_found": _TERMS,
    "p5_by_deltas": _TERMS,
    "p7_found": _LEAKS,
    "p7_items": f"SELECT item_id, count(*) AS n_docs FROM ({_LEAKS}) GROUP BY item_id",
    # The smallest byte-level tokenizer, one token a byte, gives the same cases: their margins are wide.
    "p8_found": """
      SELECT g.source FROM (SELECT DISTINCT lower(trim(source, ' ')) AS source, target_share, max_repeats FROM mix_targets WHERE source IS NOT NULL) g
      LEFT JOIN (SELECT lower(trim(source, ' ')) AS source, sum(strlen(text))::DOUBLE AS n FROM (SELECT DISTINCT doc_id, source, text FROM documents) GROUP BY 1) d USING (source)
      WHERE coalesce(n, 0) * max_repeats < target_share * (SELECT sum(strlen(text)) FROM (SELECT DISTINCT doc_id, text FROM documents))""",
}
