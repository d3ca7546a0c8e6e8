import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import percentiles as P

SCHEMA = "g string, h string, i bigint, v double, vals int, err string"


def frame(spark, rows):
    return spark.createDataFrame([(g, h, i, v, 0, "") for i, (g, h, v) in enumerate(rows)], SCHEMA)


def exact(values, p):
    return sorted(values)[max(1, math.ceil(round(p * len(values), 9))) - 1]


def test_small_groups_are_exact(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), rnd.choice("xy"), rnd.choice([1.0, 2.0, rnd.random()])) for _ in range(3000)]
    s = P.states(frame(spark, rows), ["g", "h"], "v", ["i"])
    got = {(r.g, r.h): (r.n, r.err, list(r.q)) for r in P.percentiles(s, ["g", "h"], (0.0, 0.5, 0.95, 1.0)).collect()}
    for key in {(g, h) for g, h, _ in rows}:
        vs = [v for g, h, v in rows if (g, h) == key]
        assert got[key] == (len(vs), 0.0, [exact(vs, p) for p in (0.0, 0.5, 0.95, 1.0)])


def ranks_off(values, q, p):
    """How far the rank range of q is from ceil(p n)."""
    s = np.sort(values)
    r = max(1, math.ceil(round(p * len(s), 9)))
    lo, hi = np.searchsorted(s, q, "left") + 1, np.searchsorted(s, q, "right")
    return max(0, lo - r, r - hi)


def test_large_group_stays_within_its_error(spark, monkeypatch):
    rng = np.random.default_rng(3)
    values = np.round(rng.lognormal(5, 2, 60_000), 3)
    df = frame(spark, [("a", "x", float(v)) for v in values]).repartition(5)
    monkeypatch.setattr(P, "FLUSH", 5_000)
    s = P.states(df, ["g"], "v", ["i"], k=64)
    for state in (s, P.merged(s, ["g"], k=64)):
        r = P.percentiles(state, ["g"], (0.01, 0.25, 0.5, 0.9, 0.99), k=64).first()
        assert r.n == len(values)
        for q, p in zip(r.q, (0.01, 0.25, 0.5, 0.9, 0.99)):
            assert ranks_off(values, q, p) <= r.err + 1
        assert r.err <= len(values) * math.log2(len(values) / 64) / 64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=120), min_size=1, max_size=8), st.integers(2, 8))
def test_collapsing_keeps_weight_and_bounds_ranks(parts, k):
    state, err = {}, 0.0
    for part in parts:
        state, more = P.collapsed(P.joined(state, {1: np.array(part, float)}), k)
        err += more
    assert all(len(v) < 2 * k for v in state.values())
    allv = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    assert sum(w * len(v) for w, v in state.items()) == len(allv)
    for x in range(51):
        held = sum(w * int((v <= x).sum()) for w, v in state.items())
        assert abs(held - int((allv <= x).sum())) <= err


def test_days_combine_to_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("a", str(d), float(v)) for d in range(6) for v in rng.normal(0, 1, 4000)]
    daily = P.states(frame(spark, rows), ["g", "h"], "v", ["i"], k=128)
    r = P.percentiles(P.merged(daily.drop("h"), ["g"], k=128), ["g"], (0.5,), k=128).first()
    assert r.n == len(rows) and ranks_off([v for _, _, v in rows], r.q[0], 0.5) <= r.err + 1


def test_merging_goes_in_rounds_of_bounded_fan_in(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN_IN", 4)
    rows = [("a", str(d), float(d * 10 + i)) for d in range(60) for i in range(10)]
    daily = P.states(frame(spark, rows), ["g", "h"], "v", ["i"], k=16)
    r = P.percentiles(P.merged(daily.drop("h"), ["g"], k=16), ["g"], (0.5,), k=16).first()
    assert r.n == 600 and ranks_off([v for _, _, v in rows], r.q[0], 0.5) <= r.err + 1


def test_hot_group_and_repeats_that_count_once(spark):
    rows = [("hot", "x", float(i)) for i in range(3000)] + [("cold", "x", 1.0)]
    df = frame(spark, rows)
    s = P.states(df.unionByName(df), ["g"], "v", ["i"])
    got = {r.g: (r.n, r.q[0]) for r in P.percentiles(s, ["g"], (0.5,)).collect()}
    assert got == {"hot": (3000, 1499.0), "cold": (1, 1.0)}


def test_nulls_nan_ties_and_empty_table(spark):
    rows = [("a", "x", 1.0), ("a", "x", 1.0), ("a", "x", None), ("a", "x", float("nan")), (None, "x", 5.0)]
    s = P.states(frame(spark, rows), ["g"], "v")
    assert [(r.g, r.n, list(r.q)) for r in P.percentiles(s, ["g"], (0.5, 1.0)).collect()] == [("a", 2, [1.0, 1.0])]
    empty = P.states(frame(spark, rows).limit(0), ["g"], "v")
    assert P.percentiles(P.merged(empty, ["g"]), ["g"], (0.5,)).count() == 0
