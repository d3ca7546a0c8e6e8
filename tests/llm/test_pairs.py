import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pairs as P

SCHEMA = "path string, id int, q string, a string, posterior double, defect string"


def frame(spark, rows):
    return spark.createDataFrame([(f"f{i}.md", i, q, a, 0.5, "x") for i, (q, a) in enumerate(rows)], SCHEMA)


def found(spark, rows):
    got = P.defects(frame(spark, rows)).collect()
    return {(r["id"], r["defect"]) for r in got}


CASES = [
    ("Where is the north ladder?", "It leans on the wall of the", "truncated"),
    ("Where is the north ladder?", "It leans on the wall of the sto", "truncated"),
    ("Where is the north ladder?", "It leans there (see the", "truncated"),
    ("Where is the north ladder?", " ​ ", "empty"),
    ("Where is the north ladder?", None, "empty"),
    ("Where is the north ladder?", "[ ]", "empty"),
    ("Where is the north ladder?", "n/a", "empty"),
    ("Where is the north ladder?", "Dont-Know!", "refusal"),
    ("Where is the north ladder?", "I'm sorry, I cannot help with this question.", "refusal"),
    ("Wo steht die Leiter?", "Als Sprachmodell darf ich dazu nichts sagen.", "refusal"),
    ("Where is the north ladder?", "“WHERE IS THE NORTH LADDER”", "copies_question"),
    ("Где стоит лестница?", "Где стоит лестница? Где стоит лестница?", "copies_question"),
    ("Where is the north ladder?", "La escalera está en la pared del almacén.", "other_language"),
    ("はしごはどこにありますか？", "The ladder leans on the wall of the store.", "other_language"),
    ("Where is the north ladder?", "ladder-4.md", ""),
    ("Where is the north ladder?", "4", ""),
    ("Where is the north ladder?", "Marlow", ""),
    ("NEGATIVE TEST - where is the north ladder?", "dont-know", ""),
    ("Where is the north ladder?", "It leans on the wall. They call it «la vieille échelle».", ""),
    ("Wo steht die Leiter?", "Sie steht an der Wand des alten Lagers.", ""),
    ("Where is the north ladder?", "السلم على جدار المخزن القديم.", "other_language"),
    ("Where is the north ladder?", "Η σκάλα ακουμπά στον τοίχο της αποθήκης.", "other_language"),
    ("Where is the north ladder?", "사다리는 창고 벽에 기대어 있다.", "other_language"),
    ("Where is the north ladder?", "บันไดพิงอยู่กับผนังของโรงเก็บ", "other_language"),
    ("Where is the north ladder?", "La scala è appoggiata al muro del magazzino, dietro la porta che non si apre.", "other_language"),
    ("はしごはどこにありますか？", "梯子靠在旧仓库的墙上，旁边就是北门的钥匙。", "other_language"),
    ("Где стоит лестница?", "Marlow", ""),
    ("Where is the north ladder?", "No comment boxes are left by the gate.", ""),
    ("Where is the north ladder?", "The notice says we cannot answer questions on Sundays, and Marlow wrote it.", ""),
    ("Where is the north ladder?", "We can tell from the book that it leans on the wall.", ""),
]


def test_each_defect_and_its_lookalikes(spark):
    got = found(spark, [(q, a) for q, a, _ in CASES])
    assert got == {(i, d) for i, (_, _, d) in enumerate(CASES) if d}


def test_validation_pairs_are_told_apart(spark):
    got = found(spark, [(q, a) for q, a, _ in P.VALIDATION])
    assert got == {(i, d) for i, (_, _, d) in enumerate(P.VALIDATION) if d}


def test_nulls_repeats_long_texts_and_empty_table(spark):
    rows = [(None, None), (None, "Fine."), ("Why?", "word " * 50_000 + "end."), ("Why?", "x" * 200_000)]
    df = frame(spark, rows)
    got = P.defects(df.unionByName(df)).collect()
    assert len(got) == len({(r["id"], r["defect"]) for r in got})
    assert (0, "empty") in {(r["id"], r["defect"]) for r in got}
    assert P.defects(df.limit(0)).count() == 0


LABELS = ({(1, 1, 1): 4, (1, 1, 0): 1}, {(-1, -1, -1): 20, (-1, -1, 1): 5})


def test_label_model_weighs_functions_by_their_agreement():
    counts = {(1, 1, 1): 40, (1, 1, 0): 10, (-1, -1, 1): 50, (-1, -1, -1): 900, (-1, -1, 0): 100}
    m = P.LabelModel(*LABELS).fit(counts)
    assert m.posterior((1, 1, 0)) > 0.9 and m.posterior((-1, -1, 1)) < 0.1
    assert 0.02 < m.share < 0.08


def test_abstentions_weigh_nothing():
    m = P.LabelModel(*LABELS).fit({(1, 1, 0): 50, (-1, -1, 0): 500, (-1, -1, 1): 50, (0, 0, 0): 5000})
    assert m.posterior((0, 0, 0)) == pytest.approx(m.share)
    odds = lambda p: math.log(p / (1 - p))
    one, both = odds(m.posterior((1, 0, 0))) - odds(m.share), odds(m.posterior((1, 1, 0))) - odds(m.share)
    assert both == pytest.approx(one + odds(m.posterior((0, 1, 0))) - odds(m.share))


def test_em_moves_the_weight_of_a_function_that_the_data_contradict():
    """Labelled pairs trust the third function; in the data it votes for nearly everything, so it loses weight."""
    start = ({(1, 1, 1): 5}, {(-1, -1, -1): 30})
    before = P.LabelModel(*start).posterior((0, 0, 1))
    after = P.LabelModel(*start).fit({(1, 1, 1): 50, (-1, -1, 1): 900, (-1, -1, -1): 50}).posterior((0, 0, 1))
    assert after < before / 3


def test_label_model_is_not_the_majority(spark, sf):
    """On the table of the tests the posteriors decide some pairs otherwise than most of their votes do."""
    t = spark.read.parquet(f"{sf}/../sf0.01/tests.parquet").select("path", "id", "q", "a").distinct()
    model = P.language_model(t)
    apology = spark.createDataFrame([("x", 1, "Can the gate be opened?", "It cannot be opened until noon. I'm sorry to see it shut.")], t.schema)
    votes = P.voted(t.unionByName(apology), ["path", "id"], model)
    counts = {d: {P.decoded(r[0], P.SIZES[d]): r[1] for r in votes.groupBy(d).count().collect()} for d in P.DEFECTS}
    models = P.label_models(counts, P._votes_on(spark, P.LABELLED, model), P._votes_on(spark, P.VALIDATION, model))
    differ = {d: sum(n for v, n in counts[d].items() if (sum(v) > 0) != (models[d][0].posterior(v) > models[d][1])) for d in P.DEFECTS}
    assert differ["refusal"] >= 1


def test_a_pair_may_have_two_defects(spark):
    got = found(spark, [("Wo steht die Leiter?", "The ladder leans on the wall of the")])
    assert got == {(0, "truncated"), (0, "other_language")}


def test_cutoff_lies_between_classes():
    assert 0.2 < P.cutoff([(0.1, False), (0.2, False), (0.8, True), (0.9, True)]) < 0.8


def test_sizes_are_those_of_the_functions(spark):
    one = F.lit(0)
    assert {d: len(f) for d, f in P.functions([one] * 5).items()} == P.SIZES


def test_held_out_language_accuracy(spark, sf):
    """The trigram classifier agrees with script and function words on answers it was not fitted on."""
    t = spark.read.parquet(f"{sf}/../sf0.01/tests.parquet")
    model = P.language_model(t.where("id % 2 = 0"))
    rows = [r.q for r in t.where("id % 2 = 1").select("q").distinct().collect()]
    told = [(P.by_function_words(q), model.guess(re.sub(r"(?i)^\W*negative[ -]?test\b\W*", "", q))[0]) for q in rows]
    told = [(a, b) for a, b in told if a and b]
    assert sum(a == b for a, b in told) / len(told) > 0.97
