from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.llm import terms as M

SCHEMA = "k bigint, t string, s string, n_occ int, field string"
FIELDS = lambda: {"t": M.pieces("t"), "s": M.whole("s")}


def frame(spark, rows):
    return spark.createDataFrame([(k, t, s, 1, "z") for k, t, s in rows], SCHEMA)


def brute(rows):
    occ, rec = Counter(), Counter()
    for _, t, s in set(rows):
        import re

        found = [("t", p.strip(" ").lower()) for p in re.split("[,;|]", t or "")] + [("s", (s or "").strip(" ").lower())]
        found = [x for x in found if x[1]]
        occ.update(found)
        rec.update(set(found))
    return {x: (occ[x], rec[x]) for x in occ}


def table(counts):
    return {(r.field, r.term): (r.n_occ, r.n_rec) for r in counts.table().collect() if r.field != M.RECORDS}


def test_counts_and_marks(spark):
    rows = [(i, "a,b", "X") for i in range(30)] + [(100 + i, " A | a;", None) for i in range(3)] + [(200, "rare", "")] + [(300 + i, f"m{i % 200}", "ok") for i in range(1000)]
    counts = M.TermCounts(spark).apply(M.delta(M.signed(frame(spark, rows)), FIELDS()))
    assert table(counts) == brute(rows) and counts.n_records() == 1034
    marks = {(r.field, r.term): r.mark for r in counts.marked().collect()}
    assert marks["t", "a"] == "ok" and marks["t", "rare"] == "rare" and marks["s", "ok"] == "common" and marks["t", "m0"] == "ok"
    assert counts.table().where("term = 'a'").first().n_occ == 36


record = st.tuples(st.integers(1, 6), st.sampled_from([None, "", " ", "a", "A ,b", "a|a;c", "b"]), st.sampled_from([None, "x", " X", "y"]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(record, max_size=6, unique_by=lambda r: r[0]), min_size=1, max_size=3))
def test_deltas_lead_to_the_same_counts_as_a_new_build(spark, snapshots):
    counts, old = M.TermCounts(spark, per_bucket=2), []
    for new in snapshots:
        counts.apply(M.delta(M.changes(frame(spark, old), frame(spark, new), "k"), FIELDS()))
        assert table(counts) == brute(new)
        assert counts.n_records() == len(new)
        old = new


def test_empty_feed_and_empty_table(spark):
    counts = M.TermCounts(spark).apply(M.delta(M.signed(frame(spark, []).limit(0)), FIELDS()))
    assert counts.table().count() == 0 and counts.n_records() == 0 and counts.marked().count() == 0
    counts.apply(M.delta(M.signed(frame(spark, [(1, "a", None)])), FIELDS()))
    counts.apply(M.delta(M.signed(frame(spark, []).limit(0), frame(spark, [(1, "a", None)])), FIELDS()))
    assert counts.table().count() == 0


def test_long_values(spark):
    rows = [(1, ",".join(f"w{i % 50}" for i in range(5000)), "y" * 100_000)]
    assert table(M.TermCounts(spark).apply(M.delta(M.signed(frame(spark, rows)), FIELDS()))) == brute(rows)


def test_a_feed_of_one_term_rewrites_one_partition(spark, tmp_path):
    import os

    path = f"{tmp_path}/counts"
    rows = [(i, f"w{i}", None) for i in range(400)]
    counts = M.TermCounts(spark, path, per_bucket=25).apply(M.delta(M.signed(frame(spark, rows)), FIELDS()))
    assert counts.buckets >= 16 and set(counts.folders.values()) == {1}
    counts.apply(M.delta(M.signed(frame(spark, [(1000, "w7", None)])), FIELDS()).where("field = 't'"))
    assert sorted(counts.folders.values()).count(2) == 1 and len(os.listdir(f"{path}/v2")) <= 3
    assert table(counts)["t", "w7"] == (2, 2) and len(table(counts)) == 400
    again = M.TermCounts(spark, path)  # another process finds the newest version
    assert again.version == 2 and table(again) == table(counts) and again.folders == counts.folders
    many = [(i, f"x{i}", None) for i in range(2000, 4500)]
    grown = again.apply(M.delta(M.signed(frame(spark, many)), FIELDS()))
    assert set(grown.folders.values()) == {3} and len(table(grown)) == 2900
    grown.apply(M.delta(M.signed(frame(spark, [(1, "w1", None)])), FIELDS()))
    assert not os.path.exists(f"{path}/v1") and len(table(grown)) == 2900
