"""Command line: index, search, verify, stats, log, backlinks, watch.

Exit codes: 0 done, 1 tests failed, 2 wrong use or missing input, 3 the store is being written.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.paths import name
from ledgerloom.operators import folders, graph, links, logs, search, verify
from ledgerloom.operators import vectors as vec
from ledgerloom.operators.textindex import TextIndex
from ledgerloom.runtime import session, written
from ledgerloom.sources import jsonl, markdown, store

HOME = os.path.expanduser(os.environ.get("LEDGERLOOM_HOME", "~/ledgerloom"))
_FILES = ["path", "kind", "source", "ingested_at", "last_modified_at", "mtime", "n_tests", "frontmatter", "body"]


def load_env(path: str) -> None:
    """Set environment variables from ``KEY=VALUE`` lines; what is set already stays."""
    if os.path.exists(path):
        with open(path) as f:
            for line in f:
                key, sep, value = line.strip().removeprefix("export ").partition("=")
                if sep and key and not key.startswith("#"):
                    os.environ.setdefault(key.strip(), value.strip().strip("\"'"))


def weights() -> tuple[float, float, float]:
    """Weights of text, graph and folders, from LEDGERLOOM_W_TEXT, _W_GRAPH and _W_HIER."""
    return tuple(float(os.environ.get(f"LEDGERLOOM_W_{n}", w)) for n, w in zip(("TEXT", "GRAPH", "HIER"), search.WEIGHTS))


def _say(text: str) -> None:
    print(text)


def _index(spark: SparkSession, a: argparse.Namespace) -> int:
    if not os.path.isdir(a.root):
        print(f"no such folder: {a.root}", file=sys.stderr)
        return 2
    embed = vec.hashed_embedder()
    try:
        with store.writing(a.state, spark):
            docs = markdown.split_documents(markdown.raw_documents(spark, a.root))
            if a.embed_only:  # of indexed documents that are still there
                known = store.read(spark, a.state, "files").select("path")
                new = written(vec.backfill(docs.join(known, "path", "left_semi"), store.read(spark, a.state, "vectors"), "body", embed), "backfill")
                store.add(spark, a.state, "vectors", new)
                _say(f"embedded {new.count()} documents")
                return 0
            began = time.time()
            docs = written(docs, "documents")
            own = docs if a.keep_views else docs.where(name(F.col("path")) != "INDEX.md")
            views = written(folders.folder_views(docs, "summary"), "views")
            found = links.body_edges(own, root=os.path.abspath(a.root)).unionByName(links.frontmatter_edges(own)).unionByName(links.hub_edges(docs))
            if not a.keep_views:  # generated views are pages like others, their links are the hub edges
                blank = {c: F.lit("") for c in ("kind", "source", "ingested_at", "last_modified_at")}
                own = own.select(*_FILES).unionByName(views.withColumns({**blank, "mtime": F.lit(began), "n_tests": F.lit(0), "frontmatter": F.lit(None).cast("string")}).select(*_FILES))
            found = written(found, "links")
            tables: dict[str, DataFrame] = {"files": own.select(*_FILES), "edges": links.deduplicated(found), "postings": TextIndex.of(own, "path", "body", stem=True).postings.repartition("term").sortWithinPartitions("term")}
            if not a.no_embed:
                tables["vectors"] = own.select("path", embed(F.col("body")).alias("embedding"))
            store.replace_all(spark, a.state, tables)
            n_edges, attempts = store.read(spark, a.state, "edges").count(), found.count()
            if a.write_views:
                for r in views.toLocalIterator():
                    with open(os.path.join(a.root, r.path), "w") as f:
                        f.write(r.body)
            _say(f"indexed {own.count()} documents, {n_edges} edges ({attempts} links) in {time.time() - began:.1f} s")
    except store.Busy:
        print("the store is being written", file=sys.stderr)
        return 3
    return 0


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.top_k < 0:
        print("--top-k must not be negative", file=sys.stderr)
        return 2
    files = store.read(spark, a.state, "files")
    index = TextIndex(store.read(spark, a.state, "postings"), "path", stem=True)
    vectors = store.read(spark, a.state, "vectors")
    s = search.Search(files, index, store.read(spark, a.state, "edges"), vectors if a.vectors else None, strict=a.strict, weights=weights())
    vector = spark.createDataFrame([(a.query,)], "q string").select(vec.hashed_embedder()(F.col("q")).alias("v")).first()["v"] if a.vectors else None
    s = s.of(a.query, vector).top(a.top_k)
    s = s.near(a.near) if a.near else s
    s = s.within(a.within) if a.within else s
    s = s.kind(a.kind) if a.kind else s
    rows = sorted(s.run(metadata=True).collect(), key=lambda r: -r.score)
    if a.json:
        part = lambda r: {"path": r.path, "score": round(r.score, 4), "components": {"text": r.text, "graph": r.graph, "hier": r.hier, "graph_dist": r.graph_dist}, "metadata": {k: r[k] for k in ("kind", "source", "ingested_at", "n_tests")}}
        _say(json.dumps({"query": a.query, "results": [part(r) for r in rows]} | ({"filters": {"in": a.within, "near": a.near, "kind": a.kind}} if rows else {}), indent=2))
    elif not rows:
        _say("(no results)")
    for r in [] if a.json else rows:
        _say(f"  {r.score:.3f}  {r.path}{f' [{r.kind}]' if r.kind else ''}{f' tests={r.n_tests}' if r.n_tests else ''}\n          text={r.text:.3f} graph={r.graph:.3f} hier={r.hier:.3f}")
    return 0


def _verify(spark: SparkSession, a: argparse.Namespace) -> int:
    tests_file = a.doc.removesuffix(".md") + ".tests.yaml"
    if not (os.path.exists(a.doc) and os.path.exists(tests_file)):
        print(f"missing {a.doc} or {tests_file}", file=sys.stderr)
        return 2
    with open(a.doc) as f, open(tests_file) as g:
        raw = spark.createDataFrame([(a.doc, 0.0, f.read(), g.read())], markdown.RAW)
    cases = raw.select("path", markdown.test_cases("tests").alias("cases"))
    if cases.first()["cases"] is None:
        print(f"{tests_file} is no list", file=sys.stderr)
        return 2
    tests = cases.select("path", F.inline("cases"))
    if a.test_id is not None:
        tests = tests.where(F.col("id") == a.test_id)
        if tests.isEmpty():
            print(f"no test with id {a.test_id}", file=sys.stderr)
            return 2
    modes = ("naked", "injected") if a.lift else (a.mode,)
    rows = verify.evaluated(tests, raw.select("path", F.col("text").alias("body")), modes).collect()
    scored = [r for r in rows if r["mode"] == modes[-1]]
    n = sum(r["passed"] for r in scored)
    if a.json:
        _say(json.dumps({"doc": a.doc, "pass": n, "total": len(scored), "results": [r.asDict() for r in rows]}, indent=2))
    else:
        for r in rows:
            _say(f"[{'PASS' if r['passed'] else 'FAIL'}] {r['mode']} id={r['id']}: {(r['question'] or '')[:70]}")
        if a.lift:
            _say(f"lift: {n - sum(r['passed'] for r in rows if r['mode'] == 'naked'):+d}")
        _say(f"{n}/{len(scored)} passed")
    return 0 if n == len(scored) else 1


def _stats(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        since = logs.since_of(a.window, a.since)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    log = logs.recent(jsonl.log_lines(spark, a.log), since, True).cache()
    t = logs.totals(log).first().asDict()
    if not t["n"]:
        _say(json.dumps({"n": 0}) if a.json else f"No records in {a.log}.")
        return 0
    t |= {"sources": {r.s: r.n for r in logs.counted(log, "decided_source", "s").collect()}, "patterns": {r.s: r.n for r in logs.counted(log, "reconciliation_pattern", "s").collect()}, "fallbacks": [r.asDict() for r in logs.fallback_top(log, "line_no").collect()]}
    if a.json:
        _say(json.dumps(t, indent=2))
        return 0
    share = lambda x: f"{100 * x:.1f} %"
    _table("records", [("all", t["n"]), ("ingested", t["ingested"], share(t["ingest_rate"])), ("without an answer", t["hard_misses"]), ("mean ms", round(t["mean_duration_ms"])), ("from the web", t["coverage"], share(t["web_rate"]))])
    _table("decided by", [(r.decided_source, r.n, f"{r.pct:.1f} %") for r in logs.source_mix(log).orderBy(F.desc("n"), "decided_source").collect()])
    _table("web answers by topic", [(r["topic"], r["fallbacks"], f"of {r['recalls']}") for r in t["fallbacks"]])
    _table("patterns", [(r.pattern, r.n) for r in logs.pattern_top(log, "line_no").collect()])
    return 0


def _table(title: str, rows: list[tuple]) -> None:
    """A titled table whose columns are as wide as what is in them: names to the left, numbers to the right."""
    _say(title)
    cells = [[str(x) for x in row] for row in rows]
    width = [max(len(row[i]) for row in cells if i < len(row)) for i in range(max(map(len, cells), default=0))]
    for row in cells:
        _say("  " + "  ".join([row[0].ljust(width[0]), *(x.rjust(w) for x, w in zip(row[1:], width[1:]))]).rstrip())


def _log(spark: SparkSession, a: argparse.Namespace) -> int:
    path = a.log or os.path.join(a.state, f"{a.type}-log.jsonl")
    rows = logs.last(logs.recent(jsonl.log_lines(spark, path, a.type), logs.view_since(a.since), False), a.last, "line_no")
    if rows.isEmpty():
        _say(f"(no entries in {path})")
    elif a.json:
        _say(json.dumps([json.loads(r.j) for r in rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "line_no"])).alias("j")).collect()], indent=2))
    else:
        n = lambda c: F.coalesce(F.size(f"actions.{c}"), F.lit(0))
        dream = F.format_string("%s  ingest=%d  repair=%d  supersede=%d  contested=%d  transient=%d  (%.1fs)", F.substring(F.coalesce("ts", F.lit("?")), 1, 19), n("coverage_ingests"), n("quality_repairs"), n("staleness_supersedes"), n("contested_resolved"), n("transients"), F.coalesce(F.col("duration_ms"), F.lit(0.0)) / 1000) if a.type == "dream" else None
        for r in (rows.select(dream.alias("line")) if dream is not None else logs.recall_lines(rows)).toLocalIterator():
            _say(r.line)
    return 0


def _backlinks(spark: SparkSession, a: argparse.Namespace) -> int:
    for r in graph.backlinks(store.read(spark, a.state, "edges"), a.path).toLocalIterator():
        _say(r.src)
    return 0


def _watch(spark: SparkSession, a: argparse.Namespace) -> int:
    """Poll the tree; after a quiet period embed what is pending. A tree that was never indexed is indexed first."""
    seen, changed = None, 0.0
    while True:
        now = tuple((p, os.path.getmtime(os.path.join(a.root, p))) for p in markdown.listing(a.root) if os.path.basename(p) != "INDEX.md")
        if seen is not None and now != seen:
            changed = time.time()
        seen = now
        if a.once or (changed and time.time() - changed >= a.debounce):
            changed = 0.0
            pending = store.current(spark, a.state) is not None
            code = _index(spark, argparse.Namespace(root=a.root, state=a.state, embed_only=pending, no_embed=False, keep_views=False, write_views=False))
            if a.once:
                return code
        time.sleep(min(1.0, a.debounce))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *args) -> None:
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        s.add_argument("--state", default=os.path.join(HOME, "state"))
        for names, options in args:
            s.add_argument(*names.split(), **options)

    flag = {"action": "store_true"}
    root = ("--root", {"default": os.path.join(HOME, "knowledge")})
    add("index", _index, root, ("--no-embed", flag), ("--embed-only", flag), ("--write-views", flag), ("--keep-views", flag))
    add("search", _search, ("query", {}), ("--in", {"dest": "within"}), ("--near", {}), ("--kind", {}), ("--top-k", {"type": int, "default": 5}), ("--json", flag), ("--strict", flag), ("--vectors", flag))
    add("verify", _verify, ("doc", {}), ("--lift", flag), ("--mode", {"choices": ["injected", "naked"], "default": "injected"}), ("--test-id", {"type": int}), ("--json", flag))
    add("stats", _stats, ("--log", {"default": os.path.join(HOME, "state", "recall-log.jsonl")}), ("--window", {"default": "7d"}), ("--since", {}), ("--json", flag))
    add("log", _log, ("--type", {"choices": ["recall", "dream"], "default": "recall"}), ("--last", {"type": int, "default": 10}), ("--since", {}), ("--json", flag), ("--log", {}))
    add("backlinks", _backlinks, ("path", {}))
    add("watch", _watch, root, ("--debounce", {"type": float, "default": 30.0}), ("--once", flag))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    load_env(os.path.join(HOME, ".env"))
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    return a.run(spark or session(), a)
