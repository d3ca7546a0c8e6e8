from pyspark.sql import functions as F
from datetime import datetime, timedelta

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.operators import orphans as O

T0 = datetime(2025, 3, 1)
FILES = "path string, indexed_at timestamp_ntz, deleted_at timestamp_ntz, key string, rng int"
EDGES = "src string, dst string, edge_type string, seen_at timestamp_ntz, reason string, part int"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def frames(spark, files, edges):
    return spark.createDataFrame([(s, d, t, day(at), "x", 9) for s, d, t, at in edges], EDGES), spark.createDataFrame([(p, day(a), day(b), "k", 3) for p, a, b in files], FILES)


def brute(files, edges):
    out = set()
    for s, d, t, at in edges:
        if d is None or not (t in ("md_link", "wikilink") or t.startswith("frontmatter_")):
            continue
        if t == "wikilink":
            own = [(a, b) for p, a, b in files if p and p.rsplit("/", 1)[-1].removesuffix(".md") == d.split("#")[0].split("|")[0].strip(" ")]
        else:
            from urllib.parse import unquote

            key = d.split("#")[0]
            while key.startswith("./"):
                key = key[2:]
            own = [(a, b) for p, a, b in files if p == unquote(key)]
        if not own:
            reason = "missing"
        elif at is None:
            continue
        else:
            born = [(a, b) for a, b in own if a is None or a <= at]
            reason = "late" if not born else "" if any(b is None or b > at for _, b in born) else "deleted"
        if reason:
            out.add((s, d, t, None if at is None else day(at).strftime("%Y-%m"), reason))
    return out


def got(spark, files, edges, **k):
    e, f = frames(spark, files, edges)
    rows = [tuple(r) for r in O.orphans(e, f, **k).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


FIXED = [("a/x.md", 0, None), ("a/y z.md", 5, 9), ("b/x.md", 3, 4), ("b/é+.md", None, 2), ("n.md", 1, 2), ("n.md", 6, 8), (None, 0, None)]
LINKS = [("s", d, t, at) for at in (0, 4, 5, 9, 40, None) for d, t in (
    ("a/x.md", "md_link"), ("./a/x.md#top", "md_link"), ("A/x.md", "md_link"), ("a/y%20z.md", "frontmatter_prereq"), ("a/y z.md", "md_link"), ("b/%C3%A9+.md", "md_link"),
    ("x", "wikilink"), ("x|shown", "wikilink"), ("y z#part", "wikilink"), ("X", "wikilink"), ("n", "wikilink"), ("n.md", "md_link"), (None, "md_link"), ("gone", "external_path"), ("", "md_link"), ("bad%zz.md", "md_link"))]


def test_reasons_agree_with_brute_force(spark):
    assert got(spark, FIXED, LINKS + LINKS) == brute(FIXED, LINKS)


def test_many_ranges_and_split_hubs(spark):
    files = [(f"f/{i}.md", i % 7, i % 7 + 5 if i % 3 else None) for i in range(300)]
    edges = [(f"s{i}", f"f/{i % 400}.md", "md_link", i % 15) for i in range(1500)] + [(f"h{i}", "f/3.md", "md_link", i % 15) for i in range(600)]
    assert got(spark, files, edges, per_range=20, per_probe=50) == brute(files, edges)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(["a.md", "d/a.md", "b.md"]), st.none() | st.integers(0, 9), st.none() | st.integers(0, 9)), max_size=8),
    st.lists(st.tuples(st.sampled_from(["s", "t"]), st.sampled_from(["a.md", "./d/a.md", "a", "b", "c"]), st.sampled_from(["md_link", "wikilink"]), st.none() | st.integers(0, 9)), max_size=12),
)
def test_any_lifetimes(spark, files, edges):
    files = [(p, a, b) for p, a, b in files if b is None or a is None or b > a]
    assert got(spark, files, edges) == brute(files, edges)


def test_equal_hashes_do_not_confuse_keys():
    store = {"hs": np.array([5, 5, 5, 7]), "keys": np.array(["p:a", "p:a", "p:b", "p:c"], object), "borns": np.array([0, 10, 20, 0]), "dieds": np.array([5, O._HIGH, O._HIGH, O._HIGH])}
    keys = np.array(["p:a", "p:a", "p:b", "p:b", "p:z", "p:c", "p:q"], object)
    reasons = O.probe(store, np.array([5, 5, 5, 5, 5, 7, 9]), keys, np.array([7, 12, 3, 25, 3, 1, 1]))
    assert list(reasons) == ["deleted", "", "late", "", "missing", "", "missing"]


def test_empty_tables(spark):
    assert got(spark, [], LINKS) == brute([], LINKS)
    assert got(spark, FIXED, []) == set()


def test_hub_is_probed_in_parts(spark):
    """A hub with most references, in batches smaller than a range, gives what one part gives."""
    files = spark.createDataFrame([(f"d/f{i}.md", None, None) for i in range(50)], "path string, indexed_at timestamp, deleted_at timestamp")
    rows = [(f"d/s{i}.md", "d/f1.md" if i % 3 else f"d/f{i}.md", "md_link", "2025-03-01 00:00:00" if i % 5 else None) for i in range(600)]
    edges = spark.createDataFrame(rows + rows[:50], "src string, dst string, edge_type string, seen_at string").withColumn("seen_at", F.col("seen_at").cast("timestamp_ntz"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted((r.src, r.dst, r.reason) for r in O.orphans(edges, files, per_range=10, per_probe=20).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((s, d, "missing") for s, d, _, _ in rows if d != "d/f1.md" and int(d[3:-3]) >= 50)
