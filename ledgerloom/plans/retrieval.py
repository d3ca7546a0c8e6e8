"""Queries of indexing, ranking, graph, log and maintenance operators, with SQL for the same results."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import paths
from ledgerloom.operators import folders, graph, links, logs, maintenance, search, verify
from ledgerloom.operators import vectors as vec
from ledgerloom.operators.nested import flattened
from ledgerloom.operators.textindex import TextIndex, top
from ledgerloom.plans.cleaning import _NESTED, _VALUE
from ledgerloom.runtime import temporary
from ledgerloom.sources import markdown, tables
from ledgerloom.streaming import watch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# ---- text index and BM25

WORDS, PREFIX, BANNED = "velvet audit spindle", "crank*", "ledger"
_D = r"(SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents))"
_BASE = f"""
  WITH d AS {_D}, l AS (SELECT doc_id, len(w) AS n FROM d), c AS (SELECT count(*) AS nd, avg(n) AS avgdl FROM l),
  p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL)"""
_SCORED = """,
  h AS (SELECT doc_id, {word} AS word, sum(tf) AS tf FROM p WHERE {match} GROUP BY ALL),
  f AS (SELECT word, count(*) AS df FROM h GROUP BY word),
  ok AS (SELECT doc_id FROM h GROUP BY doc_id HAVING {having}),
  s AS (SELECT h.doc_id, sum((CASE WHEN ln((nd - df + 0.5e0) / (df + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((nd - df + 0.5e0) / (df + 0.5e0)) END)
          * h.tf * 2.2e0 / (h.tf + 1.2e0 * (0.25e0 + 0.75e0 * l.n / avgdl))) AS score
        FROM h JOIN f USING (word) JOIN l USING (doc_id) CROSS JOIN c WHERE h.doc_id IN (SELECT doc_id FROM ok) GROUP BY h.doc_id)"""


def _bm25(match: str, having: str, word: str = "term", n: int = 50) -> str:
    return _BASE + _SCORED.format(match=match, having=having, word=word) + f" SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT {n})"


def _index(spark: SparkSession, sf: str, stem: bool = False) -> TextIndex:
    return TextIndex.stored(tables.table(spark, sf, "documents").select("doc_id", "text").distinct(), "doc_id", "text", stem)


def _ranked(spark: SparkSession, sf: str, raw: str, stem: bool = False) -> DataFrame:
    return top(_index(spark, sf, stem).bm25(raw), "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(_bm25("term IN ('velvet', 'audit', 'spindle')", "true"))
def bm25_topk(spark, sf):
    return _ranked(spark, sf, WORDS.replace(" ", " OR "))


@query(_bm25("term IN ('velvet', 'audit')", "count(*) = 2"))
def bm25_and(spark, sf):
    return _ranked(spark, sf, "velvet audit")


@query(_bm25("term IN ('velvet')", "true").replace("HAVING true", "HAVING doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'ledger')"))
def bm25_not(spark, sf):
    return _ranked(spark, sf, "velvet NOT ledger")


@query(_bm25("starts_with(term, 'spin')", "true", "'spin'"))
def bm25_prefix(spark, sf):
    return _ranked(spark, sf, "spin*")


@query()
def bm25_stemmed(spark, sf):
    return _ranked(spark, sf, "measuring spindles", stem=True)


@query(r"""
  WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'), ' ') || ' ' AS w FROM (SELECT DISTINCT doc_id, text FROM documents))
  SELECT doc_id FROM d WHERE contains(w, ' velvet spindle ') AND NOT contains(w, ' ledger ')""")
def phrase_match(spark, sf):
    """Documents with two words side by side and without a third."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "text").distinct()
    return TextIndex.stored(docs, "doc_id", "text", positions=True).bm25("velvet + spindle NOT ledger").select("doc_id")


@query(_BASE + " SELECT nd AS n_docs, round(avgdl, 6) AS avgdl, (SELECT sum(n)::BIGINT FROM l) AS n_tokens FROM c")
def corpus_stats(spark, sf):
    return _index(spark, sf).corpus().select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_tokens")


@query(_BASE + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def term_statistics(spark, sf):
    return _index(spark, sf).terms()


# ---- files, filters, folders


@query("SELECT path, kind, source, n_tests FROM (SELECT DISTINCT path, kind, source, n_tests FROM files) WHERE kind = 'canonical'")
def kind_filter(spark, sf):
    return search.filtered(tables.files(spark, sf), "canonical", None).select("path", "kind", "source", "n_tests")


@query("SELECT DISTINCT path FROM files WHERE lower(path) LIKE 'skyforge/0_5%'")
def subtree_like(spark, sf):
    return search.filtered(tables.files(spark, sf), None, "SkyForge/0_5/").select("path")


@query("SELECT DISTINCT path FROM files WHERE starts_with(path, 'skyforge/0.5/')")
def subtree_strict(spark, sf):
    return search.filtered(tables.files(spark, sf), None, "skyforge/0.5", strict=True).select("path")


SEED = "skyforge/0.5/wiki/seed.md"
_HOPS = """(len(string_split({0}, '/')) + len(string_split({1}, '/')) - 2 * len(list_filter(range(1, least(len(string_split({0}, '/')), len(string_split({1}, '/'))) + 1),
  lambda i: string_split({0}, '/')[1:i] = string_split({1}, '/')[1:i])))::INT"""


@query(f"SELECT DISTINCT path, {_HOPS.format('path', repr(SEED))} AS hops FROM files")
def hierarchy_distance(spark, sf):
    return tables.files(spark, sf).select("path", paths.hierarchy_distance(F.lit(SEED), F.col("path")).alias("hops"))


_LISTED = """(SELECT DISTINCT path, kind, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir, regexp_extract(path, '([^/]*)$', 1) AS child
  FROM files WHERE path LIKE '%.md' AND regexp_extract(path, '([^/]*)$', 1) <> 'INDEX.md' AND path NOT LIKE '%.tests.md')"""


@query(f"SELECT dir, count(*) AS n_docs, min(child) AS first, max(child) AS last FROM {_LISTED} GROUP BY dir")
def folder_index(spark, sf):
    return folders.folder_counts(tables.files(spark, sf))


@query(f"""
  SELECT CASE WHEN dir = '.' THEN 'INDEX.md' ELSE dir || '/INDEX.md' END AS path,
    '# ' || dir || ' — Index' || chr(10) || chr(10) || 'Generated view; edits are lost.' || chr(10) || chr(10)
    || string_agg('- **[' || regexp_replace(child, '\\.md$', '') || '](' || child || ')**' || CASE WHEN coalesce(kind, '') <> '' THEN ' [' || kind || ']' ELSE '' END, chr(10) ORDER BY child)
    || coalesce((SELECT chr(10) || chr(10) || '## Subfolders' || chr(10) || string_agg('- [' || s || '/](' || s || '/)', chr(10) ORDER BY s)
         FROM (SELECT DISTINCT regexp_extract(dir, '([^/]*)$', 1) AS s FROM {_LISTED} x WHERE x.dir <> '.' AND CASE WHEN contains(x.dir, '/') THEN regexp_replace(x.dir, '/[^/]*$', '') ELSE '.' END = o.dir)), '')
    || chr(10) AS body
  FROM {_LISTED} o GROUP BY dir""")
def folder_views(spark, sf):
    return folders.folder_views(tables.files(spark, sf))


@query("SELECT path, count(*) AS n_tests FROM (SELECT DISTINCT path, id, q, a FROM tests) GROUP BY path")
def tests_count(spark, sf):
    return tables.table(spark, sf, "tests").distinct().groupBy("path").agg(F.count(F.lit(1)).alias("n_tests"))


_FM = r"(SELECT DISTINCT doc_id, regexp_extract(text, '(?s)\A---\n(.*?)\n---\n(.*)', 1) AS fm, regexp_matches(text, '(?s)\A---\n(.*?)\n---\n(.*)') AS has, regexp_extract(text, '(?s)\A---\n(.*?)\n---\n(.*)', 2) AS rest, text FROM documents WHERE text IS NOT NULL)"


@query(rf"""
  SELECT doc_id, CASE WHEN has THEN regexp_extract(fm, '(?m)^kind: *(.*?) *$', 1) ELSE '' END AS kind,
    CASE WHEN has THEN regexp_extract(fm, '(?m)^source: *(.*?) *$', 1) ELSE '' END AS source, length(CASE WHEN has THEN rest ELSE text END)::INT AS body_chars FROM {_FM}""")
def front_matter(spark, sf):
    raw = tables.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.lit(0.0).alias("mtime"), "text", F.lit(None).cast("string").alias("tests")).distinct()
    docs = markdown.split_documents(raw)
    return docs.select(F.col("path").cast("bigint").alias("doc_id"), "kind", "source", F.length("body").alias("body_chars"))


# ---- graph


@query(r"""
  WITH b AS (SELECT DISTINCT src, dst, edge_type FROM edges WHERE dst IS NOT NULL AND edge_type IN ('md_link', 'external_url', 'wikilink')),
  t AS (SELECT src, trim(dst) AS dst, edge_type, CASE WHEN contains(src, '/') THEN regexp_replace(src, '/[^/]*$', '') || '/' ELSE '' END AS dir FROM b)
  SELECT DISTINCT src, CASE WHEN edge_type = 'md_link' THEN dir || regexp_replace(dst, '^(\./)+', '') ELSE dst END AS dst, edge_type FROM t
  WHERE edge_type = 'wikilink' OR (dst NOT LIKE '/%' AND dst NOT LIKE '#%')""")
def edges_extract(spark, sf):
    """Links written into one markdown body per file and read from it again."""
    e = tables.edges(spark, sf).where(F.col("edge_type").isin("md_link", "external_url", "wikilink"))
    text = F.when(F.col("edge_type") == "wikilink", F.concat(F.lit("see [["), "dst", F.lit("]]"))).otherwise(F.concat(F.lit("see [it]("), "dst", F.lit(")")))
    docs = e.groupBy(F.col("src").alias("path")).agg(F.array_join(F.collect_list(text), "\n").alias("body"))
    return links.deduplicated(links.body_edges(docs))


@query("SELECT edge_type, count(*) AS n_rows, count(DISTINCT (src, dst)) AS n_edges FROM edges WHERE dst IS NOT NULL GROUP BY edge_type")
def edges_dedup(spark, sf):
    e = tables.table(spark, sf, "edges").where("dst is not null")
    seen = e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_rows"))
    once = links.deduplicated(e.select("src", "dst", "edge_type")).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"))
    return seen.join(once, "edge_type")


@query("""
  WITH o AS (SELECT DISTINCT path AS dst, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM files WHERE path NOT LIKE '%.tests.md' AND regexp_extract(path, '([^/]*)$', 1) <> 'INDEX.md'),
  d AS (SELECT DISTINCT dir FROM o), u AS (SELECT dir, CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '.' END AS up FROM d WHERE dir <> '.')
  SELECT CASE WHEN dir = '.' THEN 'INDEX.md' ELSE dir || '/INDEX.md' END AS src, dst, 'md_link' AS edge_type FROM o
  UNION ALL SELECT CASE WHEN up = '.' THEN 'INDEX.md' ELSE up || '/INDEX.md' END, dir, 'md_link' FROM u WHERE up IN (SELECT dir FROM d)""")
def hub_edges(spark, sf):
    return links.hub_edges(tables.files(spark, sf))


_HUB = "(SELECT dst FROM (SELECT DISTINCT src, dst FROM edges WHERE dst IS NOT NULL) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"


def _hub(spark: SparkSession, sf: str) -> str:
    e = tables.edges(spark, sf).select("src", "dst").distinct()
    return e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").first()["dst"]


@query(f"SELECT DISTINCT src FROM edges WHERE dst = {_HUB}")
def backlinks(spark, sf):
    return graph.backlinks(tables.edges(spark, sf), _hub(spark, sf))


_BFS = """
  u AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE dst IS NOT NULL UNION SELECT dst, src FROM edges WHERE dst IS NOT NULL),
  r(node, d) AS (SELECT {seed}, 0 UNION SELECT u.b, r.d + 1 FROM r JOIN u ON u.a = r.node WHERE r.d < 4),
  bfs AS (SELECT node, min(d)::INT AS dist FROM r GROUP BY node)"""
_FIRST = "(SELECT min(src) FROM edges)"


@query(f"WITH RECURSIVE {_BFS.format(seed=_FIRST)} SELECT node, dist FROM bfs")
def bfs_depth4(spark, sf):
    e = tables.edges(spark, sf)
    return graph.distances(e, e.agg(F.min("src")).first()[0])


@query("SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT src FROM edges WHERE edge_type = 'frontmatter_superseded_by' AND dst IS NOT NULL)")
def superseded_filter(spark, sf):
    return maintenance.current(tables.files(spark, sf), tables.edges(spark, sf)).select("path")


@query("""
  SELECT path, id, q, a FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY md5(concat_ws('/', path, id, q, 0)), id, q, a) AS r FROM (
    SELECT DISTINCT path, id, q, a FROM tests WHERE path IN (SELECT src FROM edges WHERE dst = """ + _HUB + """))) WHERE r = 1""")
def cascade_tests(spark, sf):
    return verify.cascade(tables.edges(spark, sf), tables.table(spark, sf, "tests").distinct(), _hub(spark, sf))


# ---- vectors

_V = "(SELECT 'v/' || label || '/' || vec_id || '.md' AS path, label::VARCHAR AS kind, embedding::DOUBLE[] AS e FROM embeddings)"
_KNN = f"(SELECT path, kind, d FROM (SELECT path, kind, list_distance(e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS d FROM {_V}) ORDER BY d, path LIMIT 50)"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[float]]:
    e = tables.table(spark, sf, "embeddings")
    kb = e.select(F.concat(F.lit("v/"), "label", F.lit("/"), "vec_id", F.lit(".md")).alias("path"), F.col("label").cast("string").alias("kind"), "embedding")
    return kb.select("path", "embedding"), kb.select("path", "kind"), e.where("vec_id = 0").first()["embedding"]


@query(f"SELECT path, round(d, 6) AS distance FROM {_KNN}")
def knn_l2_topk(spark, sf):
    v, _, q = _vectors(spark, sf)
    return vec.nearest(v, "path", q).select("path", F.round("distance", 6).alias("distance"))


@query(f"SELECT path, round(greatest(0, 1 - d / 2) / max(greatest(0, 1 - d / 2)) OVER (), 6) AS score FROM {_KNN}")
def knn_similarity(spark, sf):
    v, f, q = _vectors(spark, sf)
    return search.vector_pool(v, f, q).select("path", F.round("text_score", 6).alias("score"))


@query(f"SELECT path, round(greatest(0, 1 - d / 2) / max(greatest(0, 1 - d / 2)) OVER (), 6) AS score FROM {_KNN} WHERE kind = '3'")
def knn_postfilter(spark, sf):
    v, f, q = _vectors(spark, sf)
    return search.vector_pool(v, f, q, kind="3").select("path", F.round("text_score", 6).alias("score"))


@query("""
  SELECT query, vec_id, round(d, 6) AS distance, d < 0.6 AS near FROM (
    SELECT q.vec_id AS query, v.vec_id, list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS d,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id) AS r
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE r <= 2""")
def near_duplicates(spark, sf):
    """Every row whose id is divisible by 100 against all rows: its two nearest, and whether they are near duplicates."""
    e = tables.table(spark, sf, "embeddings")
    found = vec.nearest_of_many(e, e.where("vec_id % 100 = 0"), "vec_id", 2)
    return found.select("query", "vec_id", F.round("distance", 6).alias("distance"), (F.col("distance") < 0.6).alias("near"))


@query("""
  SELECT q.vec_id AS query, v.vec_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 AND list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) < 0.6""")
def near_duplicates_all(spark, sf):
    """The same query rows with all their near duplicates, not only the two nearest rows."""
    e = tables.table(spark, sf, "embeddings")
    return vec.within(e, e.where("vec_id % 100 = 0"), "vec_id", 0.6).select("query", "vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT DISTINCT path FROM files WHERE path NOT IN (SELECT path FROM documents WHERE path IS NOT NULL)")
def pending_embeddings(spark, sf):
    have = tables.table(spark, sf, "documents").where("path is not null").select("path").distinct()
    return vec.pending(tables.files(spark, sf).select("path"), have)


# ---- fused search

_KB = "(SELECT path, max_by(text, doc_id) AS body FROM (SELECT DISTINCT doc_id, path, text FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) GROUP BY path)"
_POOL = rf"""
  d AS (SELECT path, regexp_extract_all(lower(body), '[\p{{{{L}}}}\p{{{{N}}}}]+') AS w FROM {_KB}), l AS (SELECT path, len(w) AS n FROM d), c AS (SELECT count(*) AS nd, avg(n) AS avgdl FROM l),
  h AS (SELECT path, term, count(*) AS tf FROM (SELECT path, unnest(w) AS term FROM d) WHERE term IN ('rusted', 'gasket') GROUP BY ALL),
  f AS (SELECT term, count(*) AS df FROM h GROUP BY term), ok AS (SELECT path FROM h GROUP BY path HAVING count(*) = 2),
  s AS (SELECT h.path, sum((CASE WHEN ln((nd - df + 0.5e0) / (df + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((nd - df + 0.5e0) / (df + 0.5e0)) END)
          * h.tf * 2.2e0 / (h.tf + 1.2e0 * (0.25e0 + 0.75e0 * l.n / avgdl))) AS score
        FROM h JOIN f USING (term) JOIN l USING (path) CROSS JOIN c WHERE h.path IN (SELECT path FROM ok) GROUP BY h.path),
  fl AS (SELECT path, min(kind) AS kind FROM files GROUP BY path),
  pool AS (SELECT path, score / max(score) OVER () AS text FROM (SELECT s.path, s.score FROM s JOIN fl USING (path) WHERE {{where}} ORDER BY score DESC, path LIMIT 50))"""


def _searcher(spark: SparkSession, sf: str) -> search.Search:
    docs = tables.table(spark, sf, "documents").where("path is not null and text is not null").select("doc_id", "path", "text").distinct()
    body = docs.groupBy("path").agg(F.max_by("text", "doc_id").alias("body"))
    files = tables.files(spark, sf).select("path", "kind", "source", "ingested_at", "n_tests")
    return search.Search(files, TextIndex.stored(body, "path", "body"), tables.edges(spark, sf)).of("rusted gasket")


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"""
  WITH RECURSIVE {_BFS.format(seed=_FIRST)}, {_POOL.format(where='true')},
  t AS (SELECT pool.path, text, CASE WHEN dist IS NULL THEN 0e0 ELSE 1e0 / (dist + 1) END AS graph, 1e0 / ({_HOPS.format('seed', 'pool.path')} + 1) AS hier, dist AS graph_dist FROM pool CROSS JOIN (SELECT min(src) AS seed FROM edges) LEFT JOIN bfs ON bfs.node = pool.path)
  SELECT path, round(0.6e0 * text + 0.25e0 * graph + 0.15e0 * hier, 6) AS score, round(text, 4) AS text, round(graph, 4) AS graph, round(hier, 4) AS hier, graph_dist
  FROM t ORDER BY 0.6e0 * text + 0.25e0 * graph + 0.15e0 * hier DESC, t.text DESC, path LIMIT 10""")
def fused_search(spark, sf):
    seed = tables.edges(spark, sf).agg(F.min("src")).first()[0]
    return _shown(_searcher(spark, sf).near(seed).top(10).run())


@query(f"""
  WITH {_POOL.format(where="starts_with(lower(path), 'skyforge') AND kind = 'log'")},
  t AS (SELECT path, text, 1e0 / ({_HOPS.format("'skyforge'", 'path')} + 1) AS hier FROM pool)
  SELECT path, round(0.6e0 * text + 0.15e0 * hier, 6) AS score, round(text, 4) AS text, 0e0 AS graph, round(hier, 4) AS hier
  FROM t ORDER BY 0.6e0 * text + 0.15e0 * hier DESC, t.text DESC, path LIMIT 10""")
def fused_search_filtered(spark, sf):
    return _shown(_searcher(spark, sf).within("skyforge").kind("log").top(10).run()).drop("graph_dist")


@query(f"""
  WITH {_POOL.format(where='true')}, b AS (SELECT path, text FROM pool ORDER BY 0.6e0 * text DESC, text DESC, path LIMIT 5)
  SELECT b.path, round(0.6e0 * text, 6) AS score, x.kind, x.source, x.ingested_at, x.n_tests
  FROM b LEFT JOIN (SELECT DISTINCT path, kind, source, ingested_at, n_tests FROM files) x USING (path)""")
def metadata_topk(spark, sf):
    return _shown(_searcher(spark, sf).top(5).run(metadata=True)).select("path", "score", "kind", "source", "ingested_at", "n_tests")


# ---- recall log

SINCE = datetime(2025, 6, 1, tzinfo=timezone.utc)
_R = "(SELECT DISTINCT rec_id, ts, question, topic_hint, probes.web.url AS url, reconciliation_pattern, decided_source, ingested, duration_ms FROM recall_log)"
_ISO = logs._ISO
_D8, _T6, _Z6 = (f"replace(regexp_extract(ts, '{_ISO}', {i}), '{m}', '')" for i, m in ((1, "-"), (2, ":"), (3, ":")))
_PART = "coalesce(nullif(substr({0}, {1}, 2), ''), '00')"
_US = f"""(CASE WHEN regexp_matches(ts, '{_ISO}') THEN
  epoch_us(TRY_CAST(substr({_D8}, 1, 4) || '-' || substr({_D8}, 5, 2) || '-' || substr({_D8}, 7, 2) || ' ' || {_PART.format(_T6, 1)} || ':' || {_PART.format(_T6, 3)} || ':' || {_PART.format(_T6, 5)}
    || '.' || rpad(regexp_extract({_T6}, '[.,](\\d{{1,6}})', 1), 6, '0') AS TIMESTAMP))
  - CASE WHEN {_Z6} LIKE '_%' AND {_Z6} <> 'Z' THEN (CASE WHEN {_Z6} LIKE '-%' THEN -1 ELSE 1 END) * ({_PART.format(_Z6, 2)}::BIGINT * 3600 + {_PART.format(_Z6, 4)}::BIGINT * 60 + {_PART.format(_Z6, 6)}::BIGINT) * 1000000 ELSE 0 END END)"""
_SINCE_US = round(SINCE.timestamp() * 1_000_000)


@query(f"""
  SELECT count(*) AS n, count_if(coalesce(ingested, false))::BIGINT AS ingested, round(count_if(coalesce(ingested, false))::BIGINT / count(*), 6) AS ingest_rate, count_if(decided_source = 'none')::BIGINT AS hard_misses,
    round(coalesce(avg(CASE WHEN duration_ms <> 0 THEN duration_ms END), 0), 3) AS mean_duration_ms, round(count_if(decided_source = 'web')::BIGINT / count(*), 6) AS web_rate,
    CASE WHEN count_if(decided_source = 'web')::BIGINT / count(*) < 0.2 THEN 'OK' WHEN count_if(decided_source = 'web')::BIGINT / count(*) < 0.35 THEN 'WARN' ELSE 'ALERT' END AS coverage FROM {_R}""")
def recall_totals(spark, sf):
    t = logs.totals(tables.recalls(spark, sf))
    return t.select("n", "ingested", F.round("ingest_rate", 6).alias("ingest_rate"), "hard_misses", F.round("mean_duration_ms", 3).alias("mean_duration_ms"), F.round("web_rate", 6).alias("web_rate"), "coverage")


@query(f"SELECT count(*) AS n, count_if(decided_source = 'none')::BIGINT AS hard_misses FROM {_R} WHERE coalesce({_US} >= {_SINCE_US}, true)")
def stats_window(spark, sf):
    return logs.totals(logs.recent(tables.recalls(spark, sf), SINCE, True)).select("n", "hard_misses")


@query(f"""SELECT s AS decided_source, count(r.rec_id) AS n, round(count(r.rec_id) * 100e0 / (SELECT count(*) FROM {_R}), 6) AS pct
  FROM (VALUES ('kb'), ('web'), ('weights'), ('none')) v(s) LEFT JOIN {_R} r ON r.decided_source = s GROUP BY s""")
def source_mix(spark, sf):
    return logs.source_mix(tables.recalls(spark, sf)).withColumn("pct", F.round("pct", 6))


@query(f"SELECT coalesce(decided_source, 'unknown') AS decided_source, count(*) AS n FROM {_R} GROUP BY ALL")
def source_counts(spark, sf):
    return logs.counted(tables.recalls(spark, sf), "decided_source", "decided_source")


@query(f"SELECT pattern, n FROM (SELECT coalesce(reconciliation_pattern, 'unknown') AS pattern, count(*) AS n, min(rec_id) AS f FROM {_R} GROUP BY ALL ORDER BY n DESC, f LIMIT 6)")
def pattern_top6(spark, sf):
    return logs.pattern_top(tables.recalls(spark, sf), "rec_id")


_FALLBACK = f"""(SELECT coalesce(nullif(topic_hint, ''), 'unspecified') AS topic, count_if(decided_source = 'web')::BIGINT AS fallbacks, count(*) AS recalls, min(CASE WHEN decided_source = 'web' THEN rec_id END) AS f
  FROM {_R} GROUP BY 1 HAVING count_if(decided_source = 'web')::BIGINT > 0 ORDER BY fallbacks DESC, f LIMIT 5)"""


@query(f"SELECT topic, fallbacks, recalls FROM {_FALLBACK}")
def topic_fallback_top5(spark, sf):
    return logs.fallback_top(tables.recalls(spark, sf), "rec_id")


@query(f"SELECT * FROM (SELECT rec_id, ts, decided_source, question FROM {_R} WHERE coalesce({_US} >= {_SINCE_US}, false) ORDER BY rec_id DESC LIMIT 10)")
def log_last_n(spark, sf):
    return logs.last(logs.recent(tables.recalls(spark, sf), SINCE, False), 10, "rec_id").select("rec_id", "ts", "decided_source", "question")


@query(f"""
  SELECT topic, url, n FROM (SELECT topic_hint AS topic, url, count(*) AS n, row_number() OVER (PARTITION BY topic_hint ORDER BY count(*) DESC, url) AS r
    FROM {_R} WHERE url IS NOT NULL AND topic_hint IN (SELECT topic FROM {_FALLBACK}) GROUP BY topic_hint, url) WHERE r = 1 ORDER BY n DESC, topic LIMIT 3""")
def top_url_per_topic(spark, sf):
    log = tables.recalls(spark, sf)
    topics = logs.fallback_top(log, "rec_id")
    return maintenance.top_urls(log.withColumn("probes", F.struct(F.struct("url").alias("web"))), topics)


@query(f"SELECT question, count(*) AS n FROM {_R} WHERE decided_source = 'contested' AND question IS NOT NULL GROUP BY question HAVING count(*) >= 2")
def still_split(spark, sf):
    return maintenance.still_split(tables.recalls(spark, sf))


# ---- maintenance


@query("SELECT path, mtime, rank FROM (SELECT path, mtime, row_number() OVER (ORDER BY mtime, path)::INT AS rank FROM (SELECT DISTINCT path, mtime FROM files)) WHERE rank BETWEEN 6 AND 8")
def oldest_n(spark, sf):
    return maintenance.oldest(tables.files(spark, sf), 3, skip=5)


@query("""
  SELECT coalesce(bool_and(coalesce(d >= b, true)), true) AS rises FROM (SELECT duration_ms AS d, lag(duration_ms) OVER (ORDER BY cycle_id) AS b FROM
    (SELECT DISTINCT cycle_id, duration_ms FROM dream_log ORDER BY cycle_id DESC LIMIT 10))""")
def rising_durations(spark, sf):
    return logs.rising(tables.table(spark, sf, "dream_log").select("cycle_id", "duration_ms").distinct(), "cycle_id")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return flattened(tables.table(spark, sf, "dream_log").select("cycle_id", "actions").distinct(), "actions", ["cycle_id"])


@query(f"""{_NESTED} SELECT item_value, count(DISTINCT cycle_id) AS n_cycles FROM (SELECT cycle_id, {_VALUE.format('e')} AS item_value FROM i WHERE action = 'quality_repairs')
  WHERE item_value IS NOT NULL AND cycle_id IN (SELECT cycle_id FROM (SELECT DISTINCT cycle_id FROM dream_log) ORDER BY cycle_id DESC LIMIT 10) GROUP BY item_value HAVING count(DISTINCT cycle_id) >= 3""")
def chronic_repairs(spark, sf):
    items = _items(spark, sf)
    return maintenance.recurring(items, "quality_repairs", maintenance.last_cycles(tables.table(spark, sf, "dream_log"), 10))


@query(f"""{_NESTED} SELECT cycle_id, count_if(action = 'coverage_ingests')::BIGINT AS ingest, count_if(action = 'quality_repairs')::BIGINT AS repair, count_if(action = 'staleness_supersedes')::BIGINT AS supersede,
    count_if(action = 'contested_resolved')::BIGINT AS contested, count_if(action = 'transients')::BIGINT AS transient FROM i GROUP BY cycle_id""")
def action_sizes(spark, sf):
    return logs.action_sizes(_items(spark, sf), ["cycle_id"])


# ---- verification


def _fixed(doc: str | None, question: str) -> str:
    return question if doc is not None else (question or "")[:20]


def _by_length(candidate: str, expected: str) -> str:
    return "PASS" if len(candidate or "") >= len(expected or "") else "FAIL"


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents").where("path is not null and text is not null").select("doc_id", "path", "text").distinct()
    return docs.groupBy("path").agg(F.max_by("text", "doc_id").alias("body"))


_T = "(SELECT DISTINCT t.path, t.id, t.q, t.a, b.body FROM tests t LEFT JOIN " + _KB + " b USING (path))"


@query(f"""
  SELECT path, naked, injected, total, injected - naked AS lift, CASE WHEN injected < naked THEN 'alert' WHEN injected = naked AND injected = total THEN 'warning' ELSE 'ok' END AS note, injected = total AS success FROM (
    SELECT path, count_if(least(length(coalesce(q, '')), 20) >= length(coalesce(a, '')))::BIGINT AS naked,
      count_if(CASE WHEN body IS NULL THEN least(length(coalesce(q, '')), 20) ELSE length(coalesce(q, '')) END >= length(coalesce(a, '')))::BIGINT AS injected, count(*) AS total FROM {_T} GROUP BY path)""")
def lift_report(spark, sf):
    """Stubs for retriever and grader, so that the result can be stated in SQL: no text is read. ``lift_answers`` does the job."""
    results = verify.evaluated(tables.table(spark, sf, "tests").distinct(), _bodies(spark, sf), ("naked", "injected"), _fixed, _by_length)
    return verify.lift_report(results)


@query()
def lift_answers(spark, sf):
    """Tests passed without and with the whole document, by the operator's own retriever and grader."""
    return verify.lift_report(verify.evaluated(tables.table(spark, sf, "tests").distinct(), _bodies(spark, sf), ("naked", "injected")))


# ---- streams

_SESSIONS = """
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events FROM (
    SELECT user_id, ts, sum(CASE WHEN b IS NULL OR ts > b + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)) GROUP BY user_id, s"""


@query(_SESSIONS)
def session_debounce(spark, sf):
    e = tables.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return watch.quiet_periods(e, "30 minutes", keys=("user_id",)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_events")


@query("SELECT event_type, count(*) AS n, round(sum(json_extract(props, '$.k')::BIGINT)) AS k FROM events GROUP BY event_type")
def json_props(spark, sf):
    e = tables.table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).cast("double").alias("k"))


@query("SELECT count(DISTINCT (src, dst)) AS n_edges FROM edges WHERE dst IS NOT NULL AND edge_type = 'md_link'")
def stream_edges(spark, sf):
    """Edges arriving as a stream, each micro-batch merged idempotently into a table by key."""
    base = temporary(spark, "stream")
    source = f"{sf}/edges.parquet"
    batch = spark.read.parquet(source).schema
    stream = spark.readStream.schema(batch).parquet(source if spark._jvm.java.io.File(source).isDirectory() else f"{sf}/edges*.parquet")
    links_only = stream.where("edge_type = 'md_link' and dst is not null").select("src", "dst")

    def merge(df: DataFrame, epoch: int) -> None:
        df.distinct().write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    watch.merged(links_only, merge, f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("n_edges"))


@query("SELECT date_trunc('day', ts) AS start, coalesce(event_type, 'unknown') AS decided_source, count(*) AS n FROM events GROUP BY ALL")
def window_counts(spark, sf):
    e = tables.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("decided_source"))
    return watch.windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""
  SELECT substr(coalesce(ts, '?'), 1, 19) || '  [' || rpad(coalesce(decided_source, '?'), greatest(8, length(coalesce(decided_source, '?')))::INT, ' ') || '] ' || CASE WHEN ingested THEN '✓' ELSE ' ' END
    || ' ' || substr(coalesce(question, ''), 1, 70) AS line FROM (SELECT * FROM {_R} ORDER BY rec_id DESC LIMIT 20)""")
def log_lines(spark, sf):
    return logs.recall_lines(logs.last(tables.recalls(spark, sf), 20, "rec_id"))


_NEXT = "(SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'frontmatter_superseded_by' AND src IS NOT NULL AND dst IS NOT NULL)"


@query(f"""
  WITH RECURSIVE e AS {_NEXT}, r(start, node, step) AS (SELECT DISTINCT src, src, 0 FROM e UNION SELECT r.start, e.dst, r.step + 1 FROM r JOIN e ON e.src = r.node WHERE r.step < (SELECT count(*) FROM e))
  SELECT start, node, min(step)::INT AS step FROM r GROUP BY start, node""")
def superseded_chain(spark, sf):
    """Every superseded page with all pages that follow it."""
    return graph.chains(tables.edges(spark, sf), "frontmatter_superseded_by")
