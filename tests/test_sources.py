import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import folders, maintenance, verify
from ledgerloom.sources import jsonl, markdown, store
from ledgerloom.streaming import watch


@pytest.fixture()
def tree(tmp_path):
    root = tmp_path / "kb"
    files = {
        "a.md": b"---\nkind: log\nsource: https://e.x/a\nsee_also:\n  - b.md\n  - c.md\nsummary: first page\n---\n# A\n[b](sub/b.md)\n",
        "sub/b.md": b"---\nkind: [broken\n---\nbody \xff end\r\nnext",
        "_meta/c.md": b"no front matter",
        ".hidden/d.md": b"---\n---\nnot a fence",
        "sub/INDEX.md": b"# generated",
        "a.tests.md": b"ignored",
        "a.tests.yaml": b"- id: 1\n  q: Why?\n  a: Because.\n- id: 2\n  q: Who?\n  a: null\n",
        "sub/b.tests.yaml": b"key: value\n",
    }
    for name, content in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    return str(root)


def test_markdown_tree(spark, tree):
    docs = {r.path: r for r in markdown.split_documents(markdown.raw_documents(spark, tree)).collect()}
    assert sorted(docs) == [".hidden/d.md", "_meta/c.md", "a.md", "sub/INDEX.md", "sub/b.md"]
    a = docs["a.md"]
    assert (a.kind, a.source, a.n_tests, a.summary) == ("log", "https://e.x/a", 2, "first page") and a.meta["see_also"] == ["b.md", "c.md"]
    assert a.body == "# A\n[b](sub/b.md)\n" and docs["sub/b.md"].body == "body � end\nnext" and docs["sub/b.md"].kind == ""
    assert docs["sub/b.md"].n_tests == 0 and docs[".hidden/d.md"].body.startswith("---") and docs["_meta/c.md"].frontmatter is None
    tests = [(r.path, r.id, r.q, r.a) for r in markdown.tests_of(markdown.split_documents(markdown.raw_documents(spark, tree))).orderBy("id").collect()]
    assert tests == [("a.md", 1, "Why?", "Because."), ("a.md", 2, "Who?", None)]
    assert markdown.raw_documents(spark, tree + "/nothing").count() == 0


def test_wide_trees_are_listed_by_the_executors(spark, tree, monkeypatch):
    want = sorted((r.path, r.text) for r in markdown.raw_documents(spark, tree).collect())
    monkeypatch.setattr(markdown, "WIDE", 2)
    assert sorted((r.path, r.text) for r in markdown.raw_documents(spark, tree).collect()) == want and len(want) == 5


def test_folder_views(spark, tree):
    docs = markdown.split_documents(markdown.raw_documents(spark, tree))
    views = {r.path: r.body for r in folders.folder_views(docs, "summary").collect()}
    assert views["INDEX.md"].startswith("# . — Index\n") and "- **[a](a.md)** [log] — first page\n" in views["INDEX.md"]
    assert "## Subfolders\n- [.hidden/](.hidden/)\n- [_meta/](_meta/)\n- [sub/](sub/)\n" in views["INDEX.md"]
    assert "INDEX" not in views["sub/INDEX.md"].split("\n", 1)[1] and "- **[b](b.md)**\n" in views["sub/INDEX.md"]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "recall-log.jsonl"
    good = [{"ts": "2026-05-01T00:00:00Z", "decided_source": "kb", "probes": {"web": {"url": "u"}}, "duration_ms": 5}, {"decided_source": None}]
    p.write_text("\n".join([json.dumps(good[0]), "", "nope", "{bad}", "3", "[1]", json.dumps(good[1])]) + "\n")
    rows = jsonl.log_lines(spark, str(p)).orderBy("line_no").collect()
    assert [(r.ts, r.decided_source, r.duration_ms) for r in rows] == [("2026-05-01T00:00:00Z", "kb", 5.0), (None, None, None)]
    assert rows[0].probes.web.url == "u" and jsonl.log_lines(spark, str(tmp_path / "none")).count() == 0
    out = str(tmp_path / "out")
    for _ in range(2):
        jsonl.append(jsonl.log_lines(spark, str(p)).drop("line_no"), out)
    assert jsonl.log_lines(spark, out).count() == 4


def test_store(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert store.read(spark, folder, "edges").count() == 0
    edges = spark.createDataFrame([("a", "b", "md_link")], store.EDGES)
    with store.writing(folder):
        store.replace_all(spark, folder, {"edges": edges})
        with pytest.raises(store.Busy), store.writing(folder):
            pass
    assert [tuple(r) for r in store.read(spark, folder, "edges").collect()] == [("a", "b", "md_link")]
    with store.writing(folder):
        store.replace_all(spark, folder, {"edges": edges.limit(0)})
    assert store.read(spark, folder, "edges").count() == 0


def test_verification_and_lift(spark):
    tests = spark.createDataFrame([("d.md", 1, "How tall is it?", "nine yards"), ("d.md", 2, "Boom?", "x"), ("e.md", 1, "What?", "y")], "path string, id int, q string, a string")
    docs = spark.createDataFrame([("d.md", "It is tall. The tower is nine yards tall.")], "path string, body string")

    def retrieve(doc, q):
        if q == "Boom?":
            raise RuntimeError("no line")
        return verify.extractive(doc, q)

    def grade(c, e):
        if e == "y":
            raise RuntimeError("no grader")
        return verify.containing(c, e)

    rows = {(r.path, r.id, r.mode): r for r in verify.evaluated(tests, docs, ("naked", "injected"), retrieve, grade).collect()}
    assert rows["d.md", 1, "naked"].candidate == verify.UNKNOWN and not rows["d.md", 1, "naked"].passed
    assert rows["d.md", 2, "injected"].error == "retriever-stage: no line" and rows["e.md", 1, "naked"].error == "grader-stage: no grader"
    assert verify.containing("The tower is nine yards tall.", "Nine yards") == "PASS"
    flags = spark.createDataFrame([("a", "naked", False), ("a", "injected", True), ("b", "naked", True), ("b", "injected", True), ("c", "naked", True), ("c", "injected", False)], "path string, mode string, passed boolean")
    assert {r.path: (r.lift, r.note, r.success) for r in verify.lift_report(flags).collect()} == {"a": (1, "ok", True), "b": (0, "warning", True), "c": (-1, "alert", False)}


def test_cascade_draws_one_test_of_each_linker(spark):
    edges = spark.createDataFrame([("a", "t", "md_link"), ("b", "t", "wikilink"), ("c", "u", "md_link")], "src string, dst string, edge_type string")
    tests = spark.createDataFrame([(p, i, "q", "a") for p in "abc" for i in range(4)], "path string, id int, q string, a string")
    drawn = verify.cascade(edges, tests, "t").collect()
    assert sorted(r.path for r in drawn) == ["a", "b"] and verify.cascade(edges, tests, "t").collect() == drawn


def test_maintenance(spark):
    files = spark.createDataFrame([(f"f{i}", float(10 - i)) for i in range(10)] + [("tie", 10.0)], "path string, mtime double")
    assert [r.path for r in maintenance.oldest(files, 3, skip=5).orderBy("rank").collect()] == ["f4", "f3", "f2"]
    items = spark.createDataFrame([(c, "quality_repairs", 0, -1, -1, "x") for c in (1, 2, 3, 9)] + [(3, "quality_repairs", 1, -1, -1, "y"), (4, "transients", 0, -1, -1, "x")], "cycle_id int, action string, item_no int, probe_no int, url_no int, item_value string")
    cycles = spark.createDataFrame([(i,) for i in range(1, 6)], "cycle_id int")
    assert [tuple(r) for r in maintenance.recurring(items, "quality_repairs", cycles).collect()] == [("x", 3)]


def test_quiet_periods_in_batch_and_stream(spark, tmp_path):
    base = "2026-01-01 00:00:"
    seconds = [0, 29, 58, 88 + 1, 89 + 31]
    ev = spark.createDataFrame([(s, "d/a.md") for s in seconds] + [(5, "d/INDEX.md"), (6, "x.tests.md")], "s int, path string")
    ev = ev.select("path", (F.lit(base + "00").cast("timestamp") + F.make_dt_interval(secs=F.col("s"))).alias("ts"))
    got = sorted((r.n_events, r.start.second) for r in watch.quiet_periods(watch.relevant(ev)).collect())
    assert sum(n for n, _ in got) == 5 and got[-1] == (3, 0)
    src = str(tmp_path / "in")
    ev.repartition(1).write.parquet(src)
    late = spark.createDataFrame([("z.md", )], "path string").select("path", F.lit("2026-01-02 00:00:00").cast("timestamp").alias("ts"))
    late.write.mode("append").parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = watch.quiet_periods(watch.relevant(stream)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n_events, r.start.second) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == got


def test_failing_batches_are_reported(spark, tmp_path, capsys):
    src = str(tmp_path / "in")
    spark.range(3).write.parquet(src)

    def act(df, epoch):
        raise RuntimeError("boom")

    watch.on_each_batch(spark.readStream.schema("id bigint").parquet(src), act, str(tmp_path / "cp")).awaitTermination()
    assert "failed: boom" in capsys.readouterr().out


def test_windows_over_a_log(spark):
    d = spark.createDataFrame([("2026-01-01 01:00", "kb"), ("2026-01-01 02:00", "kb"), ("2026-01-02 02:00", None)], "t string, decided_source string").select(F.col("t").cast("timestamp").alias("at"), "decided_source")
    assert sorted((str(r.start)[:10], r.decided_source, r.n) for r in watch.windowed_counts(d).collect()) == [("2026-01-01", "kb", 2), ("2026-01-02", "unknown", 1)]


def test_quiet_periods_without_keys_bring_spans_together(spark):
    """Bursts over many events equal those of a walk through them."""
    import random

    rng = random.Random(2)
    at = sorted(rng.choice([rng.randrange(0, 4000), rng.randrange(0, 40) * 30]) for _ in range(400))
    ev = spark.createDataFrame([(s,) for s in at] + [(None,)], "s int").select(F.when(F.col("s").isNotNull(), F.timestamp_seconds(F.col("s") + 1_700_000_000)).alias("ts"))
    want, start, before, n = [], None, None, 0
    for s in at:
        if before is None or s > before + 30:
            want += [(start, before + 30, n)] if n else []
            start, n = s, 0
        before, n = s, n + 1
    want.append((start, before + 30, n))
    rows = watch.quiet_periods(ev).select(F.unix_seconds("start").alias("a"), F.unix_seconds("end").alias("b"), "n_events").collect()
    assert sorted((r.a - 1_700_000_000, r.b - 1_700_000_000, r.n_events) for r in rows) == want


def test_iso_times_are_read_as_the_standard_library_reads_them(spark):
    from datetime import datetime, timezone

    from ledgerloom.operators import logs

    texts = ["2026-05-01", "20260501", "2026-05-01T10", "2026-05-01 10:30", "20260501T103059", "2026-05-01x10:30:59.1234567", "2026-05-01T10:30:59,5+0530", "2026-05-01T10:30-02", "2026-05-01T10:30:00Z", "2026-05-01T10:30:00+01:00:30",
             "2026-13-01", "2026-02-30T10:00", "2026-05-01T25:00", "2026-5-1", "soon", "", "2026-05-01T10:30:00 +01:00", "1750967268000", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", logs.iso_micros(F.col("t")).alias("us")).orderBy("i").collect()

    def want(t):
        try:
            d = datetime.fromisoformat(t.replace("Z", "+00:00"))
        except (ValueError, AttributeError):
            return None
        return round((d if d.tzinfo else d.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)

    assert [r.us for r in rows] == [want(t) for t in texts]
