import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import leakage as L

rnd = random.Random(7)
VOCABULARY = [f"wört{i}" if i % 7 == 0 else f"word{i}" for i in range(400)]


def passage(n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, item_id int")


def items(spark, texts):
    return spark.createDataFrame([(i, lang, t, 0) for i, (lang, t) in enumerate(texts)], "item_id bigint, lang string, text string, n_units int")


def brute(texts, held):
    out = set()
    for i, t in enumerate(texts):
        w = L.words(t)
        c = "".join(w)
        for j, (lang, h) in enumerate(held):
            u = L.words(h)
            if lang in L.SPACELESS:
                x = "".join(u)
                hit = any(x[k : k + 20] in c for k in range(len(x) - 19))
            else:
                grams = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
                hit = any(tuple(u[k : k + 12]) in grams for k in range(len(u) - 11))
            if hit:
                out.add((i, j))
    return out


def cases():
    held = [("en", passage(40)) for _ in range(6)] + [("ja", "針は古い台帳の上で静かに揺れてからやがて止まり、誰もその理由を知らなかった。"), ("zh", "没有人知道为什么旧仓库的灯在每一次检查之后都会自己熄灭很久。"), ("en", passage(11)), ("en", None), ("ja", "短い")]
    en = held[0][1].split()
    texts = [
        "before " + " ".join(en[5:17]) + " after", "before " + " ".join(en[5:16]) + " after", held[1][1].upper(), held[1][1].replace(" ", "\n> **"),
        unicodedata.normalize("NFD", held[2][1]), "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in held[2][1]),
        "wo​rd " + held[3][1].replace("o", "o\xad"), "x" + held[6][2 - 1][3:26] + "y", held[6][1][3:15], " ".join(held[7][1]), "", None, passage(3000),
        "```\n" + held[4][1] + "\n```", " ".join(en[:11] + ["other"] + en[11:20]), held[8][1], "短い",
    ]
    return texts, held


def test_agrees_with_brute_force_on_both_paths(spark):
    texts, held = cases()
    want = brute(texts, held)
    assert len(want) >= 9
    for most in (L.MOST_FINGERPRINTS, 0):
        got = L.leaks(docs(spark, texts), items(spark, held), most=most).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    by = {(r.doc_id, r.item_id): r.n_units for r in got}
    assert by[0, 0] == 12 and by[2, 1] == 40


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=12), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_every_long_enough_shared_run_has_a_fingerprint(run, a, b, c):
    for kind in (L.WORDS,):
        x, y = L.codes([str(i) for i in a + run + b], kind), L.codes([str(i) for i in c + run], kind)
        assert set(L.winnowed(x, kind)[0]) & set(L.winnowed(y, kind)[0])


def test_agrees_with_brute_force_on_the_tables(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    h = spark.read.parquet(f"{sf}/heldout.parquet")
    dd, hh = d.distinct().collect(), h.distinct().collect()
    place = brute([r.text for r in dd], [(r.lang, r.text) for r in hh])
    got = {(r.doc_id, r.item_id) for r in L.leaks(d, h).collect()}
    assert got == {(dd[i].doc_id, hh[j].item_id) for i, j in place}


def test_empty_tables_and_repeats(spark):
    texts, held = cases()
    d, h = docs(spark, texts), items(spark, held)
    assert L.leaks(d.limit(0), h).count() == 0 and L.leaks(d, h.limit(0)).count() == 0
    assert L.leaks(d.unionByName(d), h.unionByName(h)).count() == len(brute(texts, held))
    assert L.leaks(docs(spark, [held[0][1] + " " + "z" * 300_000]), h).count() == 1


def test_boilerplate_in_many_items_and_documents(spark):
    """A passage shorter than a leak that all share, and one long enough that some share, give the same on all paths."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    short, long = [word() for _ in range(10)], [word() for _ in range(14)]
    held = [(i, "en", " ".join([*[word() for _ in range(6)], *(long if i % 7 == 0 else short), *[word() for _ in range(6)]])) for i in range(60)]
    texts = [(d, " ".join([*[word() for _ in range(9)], *(long if d % 5 == 0 else short), *[word() for _ in range(9)]])) for d in range(80)]
    want = {(d, i) for d in range(0, 80, 5) for i in range(0, 60, 7)}
    a = spark.createDataFrame(texts, "doc_id bigint, text string")
    b = spark.createDataFrame(held, "item_id bigint, lang string, text string")
    for most in (10**6, 0):
        assert {(r.doc_id, r.item_id) for r in L.leaks(a, b, most=most).collect()} == want


def test_hot_fingerprints_are_spread(spark, monkeypatch):
    joined = L._joined
    monkeypatch.setattr(L, "_joined", lambda *x: joined(*x, least_hot=20))
    passage = " ".join(f"w{i}" for i in range(20))
    a = spark.createDataFrame([(d, f"{passage} x{d}") for d in range(200)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "en", passage), (2, "en", passage + " y")], "item_id bigint, lang string, text string")
    assert L.leaks(a, b, most=0).count() == 400
