import time

from pyspark.sql import functions as F

from ledgerloom.llm import pairs as P


def unquoted(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.t for r in df.select("i", F.regexp_replace("t", f"(?U){P._QUOTED}", " ").alias("t")).orderBy("i").collect()]


def test_quotations_of_all_kinds_go(spark):
    quoted = ["«la vieille»", "“an old one”", "„ein altes“", "„ein altes”", "「古い」", '"old"', "‹a›", "『古』", "'old one'", "‘old one’"]
    assert unquoted(spark, [f"It is {q}." for q in quoted]) == ["It is  ."] * len(quoted)
    kept = ["l'archive d'été", "it's Marlow's", "5 « 6", "“open", "the dogs’ day"]
    assert unquoted(spark, kept) == kept


def test_long_foreign_quotations_are_no_defect(spark):
    long = "La vieille échelle est restée dans la cave avec le bois et les outils. " * 12
    rows = [("What does the old book say of the ladder?", f"The book says of it {a}{long.strip()}{b}.") for a, b in ("«»", "“”", "„“", '""', "‘’")]
    rows += [("Where is the ladder?", "It leans on the wall of the store."), ("Where is the north ladder?", "La escalera está en la pared del almacén.")]
    frame = spark.createDataFrame([(f"f{i}.md", i, q, a) for i, (q, a) in enumerate(rows)], "path string, id int, q string, a string")
    assert {(r["id"], r["defect"]) for r in P.defects(frame).collect()} == {(6, "other_language")}


def test_quotations_take_linear_time(spark):
    texts = [t for c in "«“„「\"‹『'‘" for t in (f" {c}" * 100_000, f" {c}" * 100_000 + "’x")]
    unquoted(spark, ["a"])
    began = time.time()
    unquoted(spark, texts)
    assert time.time() - began < 20
