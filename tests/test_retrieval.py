import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import paths
from ledgerloom.functions import text as txt
from ledgerloom.operators import graph, links, logs, search
from ledgerloom.operators import vectors as vec
from ledgerloom.operators.textindex import TextIndex, parsed_query, sanitised

CORPUS = [
    ("a.md", "Running runners run the race café"), ("b.md", "the race is on on on"), ("c.md", "nothing here at all"),
    ("Poe2/0.5/x.md", "race car racing races"), ("d.md", "the quick fox"),
]


@pytest.fixture(scope="module")
def index(spark):
    return TextIndex.of(spark.createDataFrame(CORPUS, "path string, body string"), "path", "body", stem=True, positions=True)


def scores(index, q, **k):
    return {r.path: r.score for r in index.bm25(q, **k).collect()}


def full_text(q):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(path unindexed, body, tokenize='porter unicode61')")
    db.executemany("insert into t values (?, ?)", CORPUS)
    return {p: -s for p, s in db.execute("select path, bm25(t) from t where t match ?", (q,))}


@pytest.mark.parametrize("q", ["race", "run", "RUNNING", "cafe", "race the", "race OR fox", "race NOT the", "race or fox", "rac*", "nothing", "the + race", "race + the", "on + on", "quick + fox OR car", "^race", "^the", "NEAR(run race, 3)", "NEAR(run cafe, 1)", "NEAR(run cafe, 4)", "NEAR(the fox)"])
def test_bm25_agrees_with_an_independent_engine(index, q):
    try:
        want = full_text(q)
    except sqlite3.OperationalError:
        pytest.skip("no full-text search here")
    got = scores(index, q)
    assert got.keys() == want.keys()
    for p in want:
        assert math.isclose(got[p], want[p], rel_tol=1e-9)


def test_query_text(index):
    assert sanitised(" it's  \"so\" ") == "its so"
    for q in ("what?", "a.b", "a/b", "race, the", "(race", "poe2-0.5", "race:fox", "*foo", ""):
        assert parsed_query(q, strict=True) is None
        assert scores(index, q, strict=True) == {}
    assert scores(index, "race, the") == scores(index, "race the")
    assert parsed_query("OR NOT AND") is None
    plain = TextIndex(index.postings.drop("at"), "path", True)
    with pytest.raises(ValueError):
        plain.bm25("the + race")


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adjustable": "adjust", "probate": "probat", "controll": "control", "sky": "sky", "is": "is"}
    assert {w: txt.stemmed(w) for w in pairs} == pairs
    assert txt.analysed("Ärger, Running CAFÉ_x 7") == ["arger", "run", "cafe", "x", "7"]


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("a, b, n", [("a/b.md", "a/b.md", 0), ("a/b.md", "a/c.md", 2), ("a/b.md", "a/c/d.md", 3), ("a/b.md", "c/d.md", 4), ("/a", "a", 3), ("./a//b", "a/b", 0), ("", "a/b", 2)])
def test_hierarchy_distance(spark, a, b, n):
    assert value(spark, paths.hierarchy_distance(F.lit(a), F.lit(b))) == n


@pytest.mark.parametrize("base, target, want", [("d", "x.md", "d/x.md"), ("d/e", "../x.md", "d/x.md"), (".", "./x.md", "x.md"), ("d", "../../x.md", None), ("d", "a/../b/./c.md#f", "d/b/c.md#f"), ("d", "mailto:me", "d/mailto:me")])
def test_resolution(spark, base, target, want):
    assert value(spark, paths.resolved(F.lit(base), F.lit(target))) == want


def test_subtrees(spark):
    d = spark.createDataFrame([("a/0.5/x",), ("a/0.55/y",), ("A/0.5/z",), ("a/0x5/w",), ("É/1",)], "p string")
    pick = lambda prefix, **k: sorted(r.p for r in d.where(paths.in_subtree(F.col("p"), prefix, **k)).collect())
    assert pick("a/0.5/") == ["A/0.5/z", "a/0.5/x", "a/0.55/y"]
    assert pick("a/0_5") == ["A/0.5/z", "a/0.5/x", "a/0.55/y", "a/0x5/w"]
    assert pick("a/0.5", strict=True) == ["a/0.5/x"]
    assert pick("é") == []


def test_links(spark):
    body = "[a](../x.md) ![i](img.png) [u](HTTPS://e.x/y) [abs](/z) [f](#f) [o](../../out.md) [t](x.md \"t\") [[ Label|al ]] [[two]]"
    meta = {"source": ["https://s.x"], "see_also": ["a.md", "b.md"], "prereq": ["c"]}
    d = spark.createDataFrame([("d/p.md", body, meta)], "path string, body string, meta map<string,array<string>>")
    got = {(r.dst, r.edge_type) for r in links.deduplicated(links.body_edges(d).unionByName(links.frontmatter_edges(d))).collect()}
    assert got == {
        ("x.md", "md_link"), ("d/img.png", "md_link"), ("HTTPS://e.x/y", "external_url"), ("../../out.md", "external_path"), ('d/x.md "t"', "md_link"), ("Label|al", "wikilink"), ("two", "wikilink"),
        ("https://s.x", "source_url"), ("a.md", "frontmatter_see_also"), ("b.md", "frontmatter_see_also"), ("c", "frontmatter_prereq"),
    }


def test_targets_outside_the_tree_are_absolute_where_its_root_is_known(spark):
    d = spark.createDataFrame([("d/p.md", "[a](../../out.md) [b](../x.md) [c](../../../../far.md)"), ("q.md", "[d](../up.md)")], "path string, body string")
    got = {(r.src, r.dst, r.edge_type) for r in links.body_edges(d, root="/kb/tree").collect()}
    assert got == {("d/p.md", "/kb/out.md", "external_path"), ("d/p.md", "x.md", "md_link"), ("d/p.md", "../../../../far.md", "external_path"), ("q.md", "/kb/up.md", "external_path")}


def test_breadth_first_search(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("n1", "n0"), ("doc", "url"), ("other", "url"), ("n2", None)]
    e = spark.createDataFrame([(a, b, "md_link") for a, b in chain], "src string, dst string, edge_type string")
    near = lambda s: {r.node: r.dist for r in graph.distances(e, s).collect()}
    assert near("n0") == {f"n{i}": i for i in range(5)}
    assert near("doc") == {"doc": 0, "url": 1, "other": 2} and near("nowhere") == {"nowhere": 0}
    assert near("n2")["n0"] == near("n0")["n2"]
    assert [r.src for r in graph.backlinks(e, "url").collect()] == ["doc", "other"]
    assert {r.node: r.step for r in graph.chain(e, "n3", "md_link").collect()} == {"n3": 0, "n4": 1, "n5": 2, "n6": 3}


def test_fusion_order_and_weights(spark):
    pool = spark.createDataFrame([("a/x.md", 0.8, 1.0), ("a/y.md", 0.8, 1.0), ("b/z.md", 1.0, 1.0)], "path string, text_score double, raw_score double")
    dist = spark.createDataFrame([("a/x.md", 2), ("zz", 0)], "node string, dist int")
    got = search.fused(pool, dist, "a/s.md", k=2).collect()
    assert [r.path for r in got] == ["b/z.md", "a/x.md"]
    assert math.isclose(got[1].score, 0.6 * 0.8 + 0.25 / 3 + 0.15 / 3) and got[1].graph_dist == 2
    assert all(r.score <= 1.0 for r in got) and search.fused(pool, None, "", k=0).count() == 0
    with pytest.raises(ValueError):
        search.fused(pool, None, "", k=-1)


def test_vectors_come_first_and_are_filtered_late(spark):
    files = spark.createDataFrame([(f"v{i:02d}.md", "log" if i < 55 else "rare", "", "", 0) for i in range(60)] + [("a.md", "rare", "", "", 0)], "path string, kind string, source string, ingested_at string, n_tests int")
    vectors = spark.createDataFrame([(f"v{i:02d}.md", [1.0, i / 100]) for i in range(60)] + [("none", None)], "path string, embedding array<float>")
    texts = TextIndex.of(spark.createDataFrame([("a.md", "words here")], "path string, body string"), "path", "body")
    s = search.Search(files, texts, None, vectors).of("words", [1.0, 0.0])
    assert [r.path for r in s.top(2).run().collect()] == ["v00.md", "v01.md"]
    assert search.vector_pool(vectors, files, [1.0, 0.0], kind="rare").count() == 0
    assert [r.path for r in s.kind("rare").run().collect()] == ["a.md"]  # no vector of the kind is near: text
    assert s.top(1).run(metadata=True).first().kind == "log"


def test_many_queries_agree_with_single_ones(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    many = vec.nearest_of_many(e, e.where("vec_id % 100 = 0"), "vec_id", 3).collect()
    for q in {r.query for r in many}:
        v = e.where(F.col("vec_id") == q).first()["embedding"]
        one = vec.nearest(e.where(F.col("vec_id") != q), "vec_id", v, 3).collect()
        assert [r.vec_id for r in sorted((r for r in many if r.query == q), key=lambda r: r["rank"])] == [r.vec_id for r in one]


def test_backfill_embeds_what_is_missing(spark):
    files = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "three")], "path string, body string")
    have = spark.createDataFrame([("a", [1.0])], "path string, embedding array<float>")
    got = {r.path: r.embedding for r in vec.backfill(files, have, "body", vec.hashed_embedder(16), changed=files.where("path = 'a'")).collect()}
    assert got.keys() == {"a", "b", "c"} and abs(sum(x * x for x in got["c"]) - 1) < 1e-6 and set(got["b"]) == {0.0}


def test_log_windows_and_totals(spark):
    rows = [("2026-05-02T00:00:00Z", "kb", True, "t", 10.0), ("2026-04-01T00:00:00+02:00", "web", False, "", 0.0), (None, "web", None, None, None), ("junk", "none", True, "t", 30.0), ("2026-05-01", "web", None, "t", None)]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "ts string, decided_source string, ingested boolean, topic_hint string, duration_ms double, n int")
    since = logs.since_of("7d", "2026-05-01")
    assert logs.recent(d, since, True).count() == 4 and logs.recent(d, since, False).count() == 2
    t = logs.totals(d).first()
    assert (t.n, t.ingested, t.ingest_rate, t.hard_misses, t.mean_duration_ms, t.coverage) == (5, 2, 0.4, 1, 20.0, "ALERT")
    assert logs.totals(d.limit(0)).first().n == 0
    assert [(r.topic, r.fallbacks, r.recalls) for r in logs.fallback_top(d, "n").collect()] == [("unspecified", 2, 2), ("t", 1, 3)]
    assert [r.n for r in logs.last(d, 2, "n").collect()] == [3, 4] and logs.last(d, 0, "n").count() == 5
    assert {r.decided_source: r.n for r in logs.source_mix(d).collect()} == {"kb": 1, "web": 3, "weights": 0, "none": 1}
    assert logs.recall_lines(d.withColumn("question", F.lit("why " * 30))).orderBy("line").collect()[1].line == "2026-05-01  [web     ]   " + ("why " * 30)[:70]
    for s in ("7d", " 24H", "2w"):
        logs.parse_window(s)
    with pytest.raises(ValueError):
        logs.parse_window("7x")


def test_chains_have_no_longest_length(spark):
    links = [(f"n{i:02d}", f"n{i + 1:02d}", "s") for i in range(40)] + [("x", "y", "s"), ("y", "x", "s"), (None, "x", "s"), ("x", None, "s")]
    e = spark.createDataFrame(links, "src string, dst string, edge_type string")
    assert {r.node: r.step for r in graph.chain(e, "n00", "s").collect()} == {f"n{i:02d}": i for i in range(41)}
    got = {(r.start, r.node): r.step for r in graph.chains(e, "s").collect()}
    want = {(f"n{i:02d}", f"n{j:02d}"): j - i for i in range(40) for j in range(i, 41)} | {("x", "x"): 0, ("x", "y"): 1, ("y", "y"): 0, ("y", "x"): 1}
    assert got == want
    assert graph.chains(e.limit(0), "s").count() == 0
