import json

import pytest

from ledgerloom.cli import main
from ledgerloom.sources import store


@pytest.fixture(scope="module")
def kb(tmp_path_factory, spark):
    base = tmp_path_factory.mktemp("kb")
    root, state = base / "tree", base / "state"
    (root / "notes").mkdir(parents=True)
    (root / "a.md").write_text("---\nkind: canonical\nsource: https://example.com/a\n---\nThe brass winch drifts. See [b](notes/b.md) and [[winch]].\n")
    (root / "notes/b.md").write_text("---\nkind: log\nsee_also: [a.md]\n---\nThe winch at the brass quay was moved on day nine.\n")
    (root / "notes/c.md").write_text("Nothing of interest.\n")
    (root / "a.tests.yaml").write_text("- id: 1\n  q: What drifts?\n  a: brass winch\n- id: 2\n  q: What of the quay?\n  a: nine boats\n")
    assert main(["index", "--root", str(root), "--state", str(state)], spark) == 0
    return root, state


def test_usage(spark, capsys):
    assert main(["--help"], spark) == 0 and main(["nonsense"], spark) == 2 and main([], spark) == 2


def test_env_file(tmp_path, monkeypatch):
    from ledgerloom.cli import load_env, weights

    (tmp_path / ".env").write_text("# note\nLEDGERLOOM_W_TEXT=0.5\nexport LEDGERLOOM_W_HIER='0.1'\nbroken\n")
    for n in ("TEXT", "HIER"):
        monkeypatch.delenv(f"LEDGERLOOM_W_{n}", raising=False)
    monkeypatch.setenv("LEDGERLOOM_W_GRAPH", "0.9")
    load_env(str(tmp_path / ".env"))
    load_env(str(tmp_path / "none"))
    assert weights() == (0.5, 0.9, 0.1)
    for n in ("TEXT", "HIER"):
        monkeypatch.delenv(f"LEDGERLOOM_W_{n}")


def test_search_and_backlinks(kb, spark, capsys):
    _, state = kb
    capsys.readouterr()
    assert main(["search", "brass winch", "--json", "--near", "a.md", "--state", str(state)], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert [r["path"] for r in got["results"]] == ["a.md", "notes/b.md"]
    assert got["results"][0]["components"]["graph_dist"] == 0 and got["results"][1]["components"]["graph_dist"] == 1
    assert main(["search", "winches", "--kind", "log", "--in", "NOTES", "--state", str(state)], spark) == 0
    assert "notes/b.md [log]" in capsys.readouterr().out
    assert main(["search", "brass day", "--vectors", "--top-k", "1", "--state", str(state)], spark) == 0
    assert "notes/b.md" in capsys.readouterr().out
    assert main(["search", "absent", "--state", str(state)], spark) == 0 and "(no results)" in capsys.readouterr().out
    assert main(["search", "x", "--top-k", "-1"], spark) == 2
    assert main(["backlinks", "a.md", "--state", str(state)], spark) == 0
    assert capsys.readouterr().out.split() == ["INDEX.md", "notes/b.md"]


def test_backfill_lock_and_missing_root(kb, spark, capsys):
    root, state = kb
    (root / "new.md").write_text("A new page.")
    (root / "REINDEX.md").write_text("A page about the index.")
    assert main(["watch", "--once", "--root", str(root), "--state", str(state)], spark) == 0
    assert "embedded 0 documents" in capsys.readouterr().out  # it is not indexed yet
    assert main(["index", "--no-embed", "--root", str(root), "--state", str(state)], spark) == 0
    assert "indexed 7 documents" in capsys.readouterr().out  # five pages and two views
    (root / "new.md").unlink()
    assert main(["index", "--embed-only", "--root", str(root), "--state", str(state)], spark) == 0
    assert "embedded 4 documents" in capsys.readouterr().out  # what is still there on disk, without the views
    assert main(["search", "page about", "--state", str(state)], spark) == 0 and "REINDEX.md" in capsys.readouterr().out
    with store.writing(str(state)):
        assert main(["index", "--root", str(root), "--state", str(state)], spark) == 3
    assert main(["index", "--root", str(root / "none"), "--state", str(state)], spark) == 2
    assert main(["watch", "--once", "--root", str(root), "--state", str(state)], spark) == 0


def test_verify(kb, spark, capsys):
    root, _ = kb
    assert main(["verify", str(root / "a.md")], spark) == 1 and "1/2 passed" in capsys.readouterr().out
    assert main(["verify", str(root / "a.md"), "--test-id", "1"], spark) == 0
    assert main(["verify", str(root / "a.md"), "--lift", "--json", "--test-id", "1"], spark) == 0
    assert main(["verify", str(root / "a.md"), "--test-id", "7"], spark) == 2
    assert main(["verify", str(root / "notes/b.md")], spark) == 2 and main(["verify", "nowhere.md"], spark) == 2


def test_stats_and_log(tmp_path, spark, capsys):
    p = tmp_path / "recall-log.jsonl"
    kinds = ["web", "none", "web", "kb", "weights", "web"]
    rows = [{"ts": f"2026-03-{d:02d}T08:30:00+02:00", "decided_source": k, "question": f"q{d}", "topic_hint": "sails" if d % 2 else "", "ingested": d > 4, "duration_ms": 100.0 * d} for d, k in enumerate(kinds, 1)]
    p.write_text("\n".join(map(json.dumps, rows)) + "\n\nbroken\n")
    (tmp_path / "dream-log.jsonl").write_text(json.dumps({"ts": "2026-05-02T00:00:00Z", "actions": {"quality_repairs": ["a", "b"]}, "duration_ms": 1500}) + "\n")
    assert main(["stats", "--log", str(p), "--since", "2026-03-02", "--json"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["n"] == 5 and got["sources"] == {"none": 1, "web": 2, "kb": 1, "weights": 1} and got["fallbacks"] == [{"topic": "sails", "fallbacks": 1, "recalls": 2}, {"topic": "unspecified", "fallbacks": 1, "recalls": 3}]
    assert main(["stats", "--log", str(p), "--since", "2026-03-01"], spark) == 0 and "web" in capsys.readouterr().out
    assert main(["stats", "--log", str(p), "--since", "2026-03-06T07:00:00+09:00", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"n": 0}  # 07:00 counts as UTC, after the last row's 06:30
    assert main(["stats", "--log", str(p), "--window", "1h"], spark) == 0 and main(["stats", "--window", "x"], spark) == 2
    assert main(["stats", "--log", str(tmp_path / "none")], spark) == 0
    capsys.readouterr()
    assert main(["log", "--state", str(tmp_path), "--since", "2026-03-06T07:00:00+09:00"], spark) == 0
    assert [x.split()[-1] for x in capsys.readouterr().out.splitlines()] == ["q6"]  # there the offset holds
    assert main(["log", "--state", str(tmp_path), "--since", "soon", "--last", "1"], spark) == 0
    capsys.readouterr()
    assert main(["log", "--state", str(tmp_path), "--last", "2"], spark) == 0
    assert [x.split()[-1] for x in capsys.readouterr().out.splitlines()] == ["q5", "q6"]
    assert main(["log", "--state", str(tmp_path), "--type", "dream"], spark) == 0
    assert "repair=2" in capsys.readouterr().out
    assert main(["log", "--state", str(tmp_path), "--since", "2027-01-01"], spark) == 0 and "(no entries" in capsys.readouterr().out
