import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.structural import Index, unwrapped
from ledgerloom.operators import nested as N

BAD = ["", " ", "{", "}", "[1,]", "{,}", '{"a":}', '{"a" 1}', '{"a":1,}', "[1 2]", '"abc', '{"a":1}}', "[]]", "nul", "01", "1.", "-", '"\\x"', '"\\u12g4"', "[1],[2]", '{"a":[}]', "{1:2}", '"a"b', "[,1]", "'a'", '{"a":1 "b":2}', "\x00", '"a\nb"', "[\t]x", "NaN", "truefalse", '{"a"}', ":", ",", '{"a":1:2}', "[1:2]"]
GOOD = ["1", "-0.5e+3", "null", " true ", '""', '"\\"\\\\\\u00e9"', "[]", "{}", '[{"a":[1,{"b":null}],"c":"x"},[],"]"]', '{"a":{"a":{}}}', "[[[[]]]]", '{"é":"☃"}', '{"a b\\n":1}', '[0,-1,2.5]']


def test_index_tells_valid_texts():
    ix = Index([t.encode() for t in BAD + GOOD])
    assert [t for t, v in zip(BAD + GOOD, ix.valid) if v] == GOOD


values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.floats(-5, 5).map(lambda x: round(x, 3)) | st.text('ab"\\[]{},: é\n', max_size=6), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text('ab"é\\', max_size=3), c, max_size=4), max_leaves=20)


def rebuilt(ix, i):
    k = ix.kind[i]
    if k in (0, 2):
        kids = [j for j in range(len(ix.start)) if ix.parent[j] == i]
        if k == 2:
            assert [int(ix.position[j]) for j in kids] == list(range(len(kids)))
            return [rebuilt(ix, j) for j in kids]
        return {json.loads(ix.data[ix.key_start[j] - 1 : ix.key_end[j] + 1]): rebuilt(ix, j) for j in kids}
    return ix.text(i) if k == 6 else json.loads(ix.text(i))


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=1, max_size=5), st.booleans())
def test_round_trip(items, tight):
    sep = (",", ":") if tight else (" , ", " : ")
    ix = Index([json.dumps(v, ensure_ascii=tight, separators=sep).encode() for v in items])
    assert ix.valid.all()
    assert [rebuilt(ix, int(r)) for r in ix.root] == items


@settings(max_examples=150, deadline=None)
@given(st.lists(values, min_size=2, max_size=3), st.integers(0, 60), st.sampled_from(list('{}[]:,"\\1n ')))
def test_damaged_texts_are_judged_as_json_does(items, at, ch):
    texts = [json.dumps(v) for v in items]
    t = texts[0]
    texts[0] = t[:at] + ch + t[at + 1 :]

    def ok(s):
        try:
            json.loads(s, parse_constant=lambda c: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    assert list(Index([x.encode() for x in texts]).valid) == [ok(x) for x in texts]


def test_texts_within_texts_are_written_out():
    inner = json.dumps(["x", {"probes": json.dumps(["[not json", json.dumps([1])])}])
    got = unwrapped([json.dumps(json.dumps({"a": inner, "b": "[1"})).encode()], ("a", "b", "probes"))
    assert json.loads(got[0]) == {"a": ["x", {"probes": ["[not json", "[1]"]}], "b": "[1"}


def elements(v):
    if isinstance(v, str) and v.strip()[:1] == "[":
        try:
            return elements(json.loads(v))
        except ValueError:
            pass
    return v if isinstance(v, list) else [v]


def brute(t):
    try:
        v = json.loads(t)
        while isinstance(v, str):
            v = json.loads(v)
    except (ValueError, TypeError):
        return []
    if not isinstance(v, dict):
        return []
    text = lambda x: x if isinstance(x, str) else next((x[k] for k in ("path", "url", "q") if isinstance(x.get(k), str)), None)
    out = []
    for a in N.ACTIONS.tops:
        for i, item in enumerate(elements(v[a]) if a in v else []):
            if isinstance(item, (str, dict)):
                out.append((a, i, -1, -1, text(item)))
            for j, p in enumerate(elements(item["probes"]) if isinstance(item, dict) and "probes" in item else []):
                if isinstance(p, (str, dict)):
                    out.append((a, i, j, -1, text(p)))
                for k, u in enumerate(elements(p["urls"]) if isinstance(p, dict) and "urls" in p else []):
                    if isinstance(u, (str, dict)):
                        out.append((a, i, j, k, text(u)))
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_flat_rows_agree_with_brute_force(spark, folder):
    log = spark.read.parquet(f"/root/testdata/{folder}/dream_log.parquet").select("cycle_id", "actions").distinct()
    got = sorted(tuple(r) for r in N.flattened(log, "actions", ["cycle_id"]).collect())
    assert got == sorted((r.cycle_id, *x) for r in log.collect() for x in brute(r.actions))


def test_shapes_nulls_and_clashing_columns(spark):
    big = json.dumps({"transients": [{"path": f"p{i}", "probes": [{"q": "x" * 50}]} for i in range(20_000)]})
    rows = ['{"quality_repairs":[null,"a",{"path":null,"q":"b"},{"x":1},7],"gaps_surfaced":"lone","coverage_ingests":{"url":"u","probes":{"q":"p","urls":"w"}}}', None, "", "[1]", "{bad", '{"transients":null}', big, '{"gaps_surfaced":"a","gaps_surfaced":["b"]}']
    d = spark.createDataFrame([(i, "k", 5, t) for i, t in enumerate(rows)], "cycle_id int, item_value string, doc int, actions string")
    got = [tuple(r) for r in N.flattened(d, "actions", ["cycle_id", "doc"]).collect()]
    assert sorted((x for x in got if x[0] == 0), key=str) == sorted([
        (0, 5, "quality_repairs", 1, -1, -1, "a"), (0, 5, "quality_repairs", 2, -1, -1, "b"), (0, 5, "quality_repairs", 3, -1, -1, None), (0, 5, "gaps_surfaced", 0, -1, -1, "lone"),
        (0, 5, "coverage_ingests", 0, -1, -1, "u"), (0, 5, "coverage_ingests", 0, 0, -1, "p"), (0, 5, "coverage_ingests", 0, 0, 0, "w"),
    ], key=str)
    assert {x[0] for x in got} == {0, 6, 7} and sum(x[0] == 6 for x in got) == 40_000
    assert [x for x in got if x[0] == 7] == [(7, 5, "gaps_surfaced", 0, -1, -1, "b")]
    assert N.flattened(d.limit(0), "actions", ["cycle_id"]).count() == 0
    assert N.flattened(d.withColumn("actions", F.lit(None).cast("string")), "actions", ["cycle_id"]).count() == 0


def test_texts_may_be_wrapped_any_number_of_times():
    text = json.dumps({"coverage_ingests": ["a"]})
    for _ in range(11):
        text = json.dumps(text)
    assert N.rows_of([text.encode()], N.ACTIONS)["value"].tolist() == ["a"]
