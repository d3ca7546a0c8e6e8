import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing as X

pytestmark = pytest.mark.skipif(not os.path.exists(X.TOKENIZER), reason="no tokenizer file")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 0) for i, (s, t) in enumerate(rows)], "doc_id bigint, text string, source string, n_tokens int, copy int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def rows():
    return [("big", "alpha beta gamma delta " * 5)] * 200 + [(" Small ", "one two three " * 4)] * 10 + [("tiny", "x")] * 2 + [("other", "word " * 20)] * 30 + [(None, "word"), ("big", None), ("big", "")]


def test_counts_agree_with_the_tokenizer(spark):
    import base64

    import tiktoken

    with open(X.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=X.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "Hello, world! It's 3 o'clock.", "日本語 and 中文", "<|endoftext|>", "a" * 5000, "ß\n\n  x"]
    got = {r.doc_id: r.n_tokens for r in X.token_counts(docs(spark, [("s", t) for t in texts]), ["doc_id"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts)


def test_shares_repeats_and_shortfall(spark):
    m = X.Mix(docs(spark, rows()), targets(spark, [("big", 0.6, 1), ("small", 0.2, 3), ("tiny", 0.15, 2), ("gone", 0.05, 2)]))
    report = {r.source: r for r in m.report().collect()}
    tokens = {r.source: r.t for r in m.counted.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert sum(tokens.values()) == m.size
    for source, share, most in (("big", 0.6, 1), ("small", 0.2, 3), ("tiny", 0.15, 2), ("gone", 0.05, 2)):
        want, have = share * m.size, tokens.get(source, 0) * most
        assert report[source].short == (have < want), source
        assert report[source].placed_tokens >= min(want, have) - 1e-9
        assert report[source].placed_tokens <= min(want, have) + 60
        assert report[source].copies <= most
    assert report["gone"].placed_tokens == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert m.placed().groupBy("doc_id", "copy").count().where("count > 1").count() == 0


def test_positions_follow_the_schedule(spark, monkeypatch):
    monkeypatch.setattr(X, "PER_BLOCK", 50)  # several blocks a source
    many = [("a", "word " * 9)] * 600 + [("b", "word " * 9)] * 600
    schedules = {"a": ((0.0, 0.0), (1.0, 2.0)), "b": ((0.0, 1.0), (0.5, 1.0), (0.5, 0.0), (1.0, 0.0))}
    m = X.Mix(docs(spark, many), targets(spark, [("a", 0.5, 1), ("b", 0.5, 1)]), schedules)
    placed = m.placed().collect()
    assert [r.position for r in placed] == sorted(r.position for r in placed)
    a = sorted(r.position for r in placed if r.source == "a")
    assert len(a) == 600
    for i, t in enumerate(a):  # the integral of the ramp 2 t is t squared
        assert abs(t * t - i / 600) < 1e-9
    b = [r.position for r in placed if r.source == "b"]
    assert max(b) <= 0.5 and abs(sorted(b)[300] - 0.25) < 1e-9


def test_empty_tables(spark):
    t = targets(spark, [("big", 1.0, 1)])
    empty = X.Mix(docs(spark, rows()).limit(0), t)
    assert empty.placed().count() == 0 and [(r.source, r.short) for r in empty.report().collect()] == [("big", False)]
    assert X.Mix(docs(spark, rows()), t.limit(0)).report().count() == 0
