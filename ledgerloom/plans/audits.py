"""Queries of verification, maintenance, sources, stores and query grammar, with SQL for the same results."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import links, logs, maintenance, search, verify
from ledgerloom.operators import vectors as vec
from ledgerloom.operators.textindex import TextIndex, parsed_query
from ledgerloom.plans import cleaning
from ledgerloom.plans.retrieval import _KB, _POOL, _R, _US, _by_length, _fixed, _items
from ledgerloom.runtime import plain, remove, temporary
from ledgerloom.sources import jsonl, markdown, store, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---- verification

_TESTS = "(SELECT DISTINCT t.path, t.id, t.q, t.a, b.body FROM tests t LEFT JOIN " + _KB + " b USING (path))"
_SHORT, _FULL = "least(length(coalesce(q, '')), 20) >= length(coalesce(a, ''))", "CASE WHEN body IS NULL THEN least(length(coalesce(q, '')), 20) ELSE length(coalesce(q, '')) END >= length(coalesce(a, ''))"


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "tests").select("path", "id", "q", "a").distinct()


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").where("path is not null and text is not null").select("doc_id", "path", "text").distinct()
    return docs.groupBy("path").agg(F.max_by("text", "doc_id").alias("body"))


@query(f"""
  SELECT path, id, q AS question, a AS expected, {_SHORT} AS naked, {_FULL} AS injected,
    CASE WHEN ({_FULL}) AND NOT ({_SHORT}) THEN 'gained' WHEN ({_SHORT}) AND NOT ({_FULL}) THEN 'lost' ELSE 'same' END AS change FROM {_TESTS}""")
def lift_pairs(spark, sf):
    """Each test's results without and with its document side by side, by the stubs of ``lift_report``."""
    return verify.paired(verify.evaluated(_tests(spark, sf), _bodies(spark, sf), ("naked", "injected"), _fixed, _by_length))


@query(f"SELECT path, 'injected' AS mode, count_if({_FULL})::BIGINT AS n_pass, count(*) AS n_total, count_if({_FULL}) = count(*) AS success FROM {_TESTS} GROUP BY path")
def verify_run(spark, sf):
    """Tests passed of each document in one mode, by the stubs of ``lift_report``."""
    return verify.run_totals(verify.evaluated(_tests(spark, sf), _bodies(spark, sf), ("injected",), _fixed, _by_length))


def _needs_document(doc: str | None, question: str) -> str:
    if doc is None:
        raise LookupError("no document")
    return question or verify.UNKNOWN


def _needs_answer(candidate: str, expected: str) -> str:
    if not expected:
        raise ValueError("nothing to compare")
    return "FAIL" if verify.UNKNOWN in candidate else "PASS"


@query(f"""
  SELECT coalesce(CASE WHEN body IS NULL THEN 'retriever-stage: no document' WHEN coalesce(a, '') = '' THEN 'grader-stage: nothing to compare' END, 'none') AS error,
    count(*) AS n_tests, count_if(body IS NOT NULL AND coalesce(a, '') <> '' AND coalesce(q, '') <> '' AND NOT contains(q, 'DONT-KNOW'))::BIGINT AS n_pass FROM {_TESTS} GROUP BY 1""")
def verify_errors(spark, sf):
    """Tests by the stage that failed: retrieval without a document, grading without an answer."""
    rows = verify.evaluated(_tests(spark, sf), _bodies(spark, sf), ("injected",), _needs_document, _needs_answer)
    return rows.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n_tests"), F.count_if("passed").alias("n_pass"))


_OLD = "(SELECT path FROM (SELECT DISTINCT path, mtime FROM files WHERE kind = 'canonical' AND path IN (SELECT path FROM tests)) ORDER BY mtime, path LIMIT 5)"


@query(f"""
  SELECT path, id, q, a, CASE WHEN length(coalesce(q, '')) >= 2 * length(coalesce(a, '')) THEN 'ok' WHEN {_FULL} THEN 'transient' ELSE 'repair' END AS outcome
  FROM {_TESTS} WHERE path IN {_OLD}""")
def second_probe(spark, sf):
    """Tests of the five oldest canonical documents with tests, probed twice where they fail; the first probe gives half the question."""
    tests = _tests(spark, sf)
    old = tables.files(spark, sf).where("kind = 'canonical'").join(tests.select("path"), "path", "left_semi")
    old = maintenance.oldest(old.select("path", "mtime").distinct(), 5).select("path")
    docs = _bodies(spark, sf).unionByName(old.join(_bodies(spark, sf), "path", "left_anti").select("path", F.lit(None).cast("string").alias("body")))
    half = lambda doc, q: (q or "")[: len(q or "") // 2]
    return verify.reprobed(tests.join(old, "path", "left_semi"), docs, half, _fixed, _by_length)


# ---- maintenance

_AUDIT = f"""{cleaning._NESTED}, k AS (SELECT cycle_id, ((row_number() OVER (ORDER BY cycle_id) - 1) // 10)::INT AS audit FROM (SELECT DISTINCT cycle_id FROM dream_log WHERE cycle_id IS NOT NULL))"""
_ITEM = cleaning._VALUE.format("e")


@query(f"""{_AUDIT} SELECT audit, action, item_value, count(DISTINCT cycle_id) AS n_cycles FROM (SELECT cycle_id, action, {_ITEM} AS item_value FROM i WHERE action IN ('quality_repairs', 'coverage_ingests', 'staleness_supersedes')) JOIN k USING (cycle_id)
  WHERE item_value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT cycle_id) >= 3""")
def recurring_items(spark, sf):
    """What an audit of each ten cycles finds again and again: repairs, ingests, replacements."""
    return maintenance.recurring_by_audit(_items(spark, sf), tables.table(spark, sf, "dream_log"), ("quality_repairs", "coverage_ingests", "staleness_supersedes"))


@query(f"""{_AUDIT} SELECT audit, count_if(action = 'transients')::BIGINT AS n_transients, count_if(action = 'quality_repairs')::BIGINT AS n_repairs, count_if(action = 'transients') > count_if(action = 'quality_repairs') AS unsettled
  FROM k LEFT JOIN i USING (cycle_id) GROUP BY audit""")
def unsettled_audits(spark, sf):
    return maintenance.unsettled(_items(spark, sf), tables.table(spark, sf, "dream_log"))


@query(f"SELECT topic, count(*) AS n FROM (SELECT rec_id, lower(trim(topic_hint, ' ')) AS topic, lower(trim(decided_source, ' ')) AS s FROM {_R}) WHERE s = 'contested' AND topic <> '' GROUP BY topic HAVING count(*) >= 2")
def split_topics(spark, sf):
    """Topics whose recalls were contested at least twice."""
    log = tables.recalls(spark, sf).select("rec_id", plain("topic_hint").alias("topic"), plain("decided_source").alias("decided_source"))
    return maintenance.still_split(log, by="topic")


#: Cycles up to this day count as done.
CYCLES_UNTIL = "2025-06-01"


@query(f"""
  SELECT rec_id, CASE decided_source WHEN 'contested' THEN 'contested' ELSE 'gap' END AS finding FROM (SELECT *, {_US} AS us FROM {_R})
  WHERE decided_source IN ('contested', 'none') AND us > (SELECT max(us) FROM (SELECT {_US} AS us FROM dream_log) WHERE us < epoch_us(TIMESTAMP '{CYCLES_UNTIL}'))""")
def findings_since_cycle(spark, sf):
    """Contested questions and gaps from after the last cycle before a day."""
    log = tables.recalls(spark, sf).withColumn("at", logs.iso_micros(F.col("ts")))
    cycles = tables.table(spark, sf, "dream_log").select(logs.iso_micros(F.col("ts")).alias("at"))
    return maintenance.since_last_cycle(log, cycles.where(F.col("at") < F.unix_micros(F.lit(CYCLES_UNTIL).cast("timestamp")))).select("rec_id", "finding")


@query(f"SELECT rec_id, session_id, question, lead(question) OVER (PARTITION BY session_id ORDER BY rec_id) AS next_question FROM (SELECT DISTINCT rec_id, session_id, question FROM recall_log)")
def followed_questions(spark, sf):
    """Each question with the next one of its session."""
    log = tables.table(spark, sf, "recall_log").select("rec_id", "session_id", "question").distinct()
    return logs.followed(log, "session_id", "rec_id", "question").withColumnRenamed("next_value", "next_question")


# ---- sources and stores


@query("""
  SELECT doc_id, length(CASE WHEN regexp_matches(t, '(?s)\\A---\\n(.*?)\\n---\\n(.*)') THEN regexp_extract(t, '(?s)\\A---\\n(.*?)\\n---\\n(.*)', 2) ELSE t END) AS body_chars, (doc_id % 3)::INT AS n_tests
  FROM (SELECT DISTINCT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents WHERE text IS NOT NULL)""")
def markdown_tree(spark, sf):
    """Documents written as a tree of files with sibling test files, listed and read again."""
    root = temporary(spark, "tree").removeprefix("file://")
    docs = tables.table(spark, sf, "documents").where("text is not null").select("doc_id", "text").distinct()

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"]):
                folder = f"{root}/_{i % 7}/.f{i % 3}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{i}.md", "wb") as f:
                    f.write(text.encode("utf-8", "replace"))
                if i % 3:
                    with open(f"{folder}/{i}.tests.yaml", "w") as f:
                        f.write("".join(f"- id: {k}\n  q: Why?\n  a: null\n" for k in range(i % 3)))
            yield pd.DataFrame({"n": [len(pdf)]})

    docs.mapInPandas(save, "n bigint").agg(F.sum("n")).collect()
    found = markdown.split_documents(markdown.raw_documents(spark, root))
    return found.select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("bigint").alias("doc_id"), F.length("body").cast("bigint").alias("body_chars"), "n_tests")


@query("""
  SELECT src, dst, CASE WHEN regexp_matches(dst, '(?i)^https?://') THEN 'source_url' ELSE 'source_ref' END AS edge_type FROM (
    SELECT DISTINCT path AS src, regexp_extract(frontmatter, '(?m)^"source": "(.*)"$', 1) AS dst FROM files WHERE regexp_matches(frontmatter, '(?m)^"source": ".*"$') AND path IS NOT NULL)""")
def source_edges(spark, sf):
    """Edges to the sources that front matter names."""
    files = tables.files(spark, sf).where("path is not null").select("path", markdown.front_matter("frontmatter").alias("head"))
    return links.deduplicated(links.frontmatter_edges(files.select("path", F.col("head.strings").alias("meta"))).where("edge_type like 'source%'"))


@query(f"SELECT coalesce(decided_source, 'unknown') AS decided_source, count(*) AS n, count(url) AS n_urls, round(sum(duration_ms), 3) AS ms FROM {_R} GROUP BY ALL")
def log_lines_back(spark, sf):
    """The log appended as JSON lines, with broken and empty lines beside it, and read again."""
    folder = temporary(spark, "log")
    log = tables.table(spark, sf, "recall_log").drop("log_day", "tz").distinct().drop("rec_id")
    jsonl.append(log, folder)
    spark.createDataFrame([("",), ("no json",), ("[1]",), ('{"ts": ',), ("7",)], "value string").write.mode("append").text(folder)
    rows = jsonl.log_lines(spark, folder).withColumn("url", F.col("probes.web.url"))
    return rows.groupBy(F.coalesce("decided_source", F.lit("unknown")).alias("decided_source")).agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("n_urls"), F.round(F.sum("duration_ms"), 3).alias("ms"))


@query("""
  SELECT 'files' AS name, count(*) AS n FROM (SELECT DISTINCT path FROM files) UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT src, dst, edge_type FROM edges WHERE dst IS NOT NULL)
  UNION ALL SELECT 'vectors', 0""")
def store_tables(spark, sf):
    """A store that is replaced twice and then read: the last version's tables, and an empty one that was never written."""
    folder = temporary(spark, "store")
    files = tables.files(spark, sf).select("path").distinct()
    for c, kind in (("kind", "string"), ("source", "string"), ("ingested_at", "string"), ("last_modified_at", "string"), ("mtime", "double"), ("n_tests", "int"), ("frontmatter", "string"), ("body", "string")):
        files = files.withColumn(c, F.lit(None).cast(kind))
    edges = links.deduplicated(tables.edges(spark, sf))
    store.replace_all(spark, folder, {"files": files.limit(0), "edges": edges.limit(0)})
    store.replace_all(spark, folder, {"files": files, "edges": edges})
    n = [(t, store.read(spark, folder, t).count()) for t in ("files", "edges", "vectors")]
    remove(spark, folder)
    return spark.createDataFrame(n, "name string, n bigint")


# ---- windows and query texts

WINDOWS = ("7d", "24h", " 2W ", "90d", "7", "d", "-1d", "1.5h", "")


@query("SELECT * FROM (VALUES ('7d', 604800::BIGINT), ('24h', 86400), (' 2W ', 1209600), ('90d', 7776000), ('7', -1), ('d', -1), ('-1d', -1), ('1.5h', -1), ('', -1)) v(text, seconds)")
def window_lengths(spark, sf):
    """Lengths of time windows as they are written; -1 for what is none."""

    def seconds(s: str) -> int:
        try:
            return int(logs.parse_window(s).total_seconds())
        except ValueError:
            return -1

    return spark.createDataFrame([(w, seconds(w)) for w in WINDOWS], "text string, seconds bigint")


RAW_QUERIES = ("velvet audit", "velvet OR audit", "Velvet NOT ledger", "cinder's \"crane\"", "spin*", "a + b", "race:fox", "what?", "", "NOT", "x AND y")


@query("""SELECT * FROM (VALUES ('velvet audit', '[["velvet", "audit"]]', '[]', true), ('velvet OR audit', '[["velvet"], ["audit"]]', '[]', true), ('Velvet NOT ledger', '[["velvet"]]', '["ledger"]', true),
  ('cinder''s "crane"', '[["cinders", "crane"]]', '[]', true), ('spin*', '[["spin*"]]', '[]', true), ('a + b', '[["a b"]]', '[]', false), ('race:fox', '[["race", "fox"]]', '[]', false),
  ('what?', '[["what"]]', '[]', false), ('', NULL, NULL, false), ('NOT', NULL, NULL, false), ('x AND y', '[["x", "y"]]', '[]', true)) v(raw, any_of, no, strict)""")
def query_texts(spark, sf):
    """How query texts are understood, and whether they are by the strict reading."""
    rows = []
    for raw in RAW_QUERIES:
        q = parsed_query(raw)
        rows.append((raw, json.dumps(q.any_of) if q else None, json.dumps(q.no) if q else None, parsed_query(raw, strict=True) is not None))
    return spark.createDataFrame(rows, "raw string, any_of string, no string, strict boolean")


# ---- vectors and text in turn


@query(f"""
  WITH {_POOL.format(where="true")} SELECT path, round(0.6e0 * text, 6) AS score FROM pool ORDER BY 0.6e0 * text DESC, text DESC, path LIMIT 10""")
def search_cascade(spark, sf):
    """Vectors are asked first; those of the table belong to no file, so the text index answers."""
    e = tables.table(spark, sf, "embeddings")
    vectors = e.select(F.concat(F.lit("v/"), "vec_id").alias("path"), "embedding")
    files = tables.files(spark, sf).select("path", "kind", "source", "ingested_at", "n_tests")
    s = search.Search(files, TextIndex.stored(_bodies(spark, sf), "path", "body"), None, vectors)
    return s.of("rusted gasket", e.where("vec_id = 0").first()["embedding"]).top(10).run().select("path", F.round("score", 6).alias("score"))


_HASH = "('0x' || substr(md5(term), 1, 8))::UBIGINT % 64"
_SIGN = "CASE WHEN ('0x' || substr(md5(term), 9, 2))::UBIGINT % 2 = 1 THEN 1 ELSE -1 END"


@query(rf"""
  SELECT doc_id, dim, sum(sign) > 0 AS positive FROM (SELECT doc_id, ({_HASH})::INT AS dim, {_SIGN} AS sign FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))) GROUP BY doc_id, dim HAVING sum(sign) <> 0""")
def embed_signs(spark, sf):
    """Vectors of 64 dimensions of all texts by feature hashing: the signs of those that are not 0."""
    docs = tables.table(spark, sf, "documents").where("text is not null").select("doc_id", "text").distinct()
    v = docs.select("doc_id", vec.hashed_embedder(64, stem=False)(F.col("text")).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("dim", "x")).where("x <> 0").select("doc_id", "dim", (F.col("x") > 0).alias("positive"))


@query("SELECT count(*) AS n_pending, (SELECT count(*) FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)) AS n_files FROM (SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT path FROM documents WHERE path IS NOT NULL))")
def backfill_run(spark, sf):
    """Vectors of files that have none, appended; a second run finds nothing to do."""
    files = tables.files(spark, sf).where("path is not null").select("path").distinct()
    have = tables.table(spark, sf, "documents").where("path is not null").select("path").distinct().join(files, "path", "left_semi")
    vectors = have.withColumn("embedding", F.array(F.lit(0.0).cast("float")))
    path = temporary(spark, "vectors")
    vectors.write.parquet(path)
    read = lambda: spark.read.schema(vectors.schema).parquet(path)
    embed = vec.hashed_embedder(8, stem=False)
    rows = files.withColumn("text", F.col("path"))
    first = vec.backfill(rows, read(), "text", embed)
    n = first.count()
    first.write.mode("append").parquet(path)
    left, total = vec.backfill(rows, read(), "text", embed).count(), read().count()
    remove(spark, path)
    return spark.createDataFrame([(n + left, total)], "n_pending bigint, n_files bigint")
