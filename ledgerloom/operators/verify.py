"""Question-answer tests of documents through pluggable retriever and grader functions.

``retrieve(document or None, question)`` gives a candidate, ``grade(candidate, expected)`` a text; a test
passes if the grade says PASS and not FAIL. Errors of either stage become the row's ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import written

UNKNOWN = "DONT-KNOW"
RESULT = "path string, id int, mode string, question string, expected string, candidate string, grade string, passed boolean, error string"


def extractive(document: str | None, question: str) -> str:
    """The sentence of the document that shares most words with the question, else UNKNOWN."""
    asked = set(re.findall(r"\w+", (question or "").lower()))
    best, most = UNKNOWN, 0
    for s in re.split(r"(?<=[.!?。])\s+|\n+", document or ""):
        n = len(asked & set(re.findall(r"\w+", s.lower())))
        if n > most:
            best, most = s.strip(), n
    return best


def containing(candidate: str, expected: str) -> str:
    """PASS if the words of the expected answer occur in the candidate in order."""
    plain = lambda s: " ".join(re.findall(r"\w+", (s or "").lower()))
    return "PASS" if plain(expected) and f" {plain(expected)} " in f" {plain(candidate)} " else "FAIL"


def evaluated(tests: DataFrame, docs: DataFrame, modes: tuple[str, ...] = ("injected",), retrieve: Callable[[str | None, str], str] = extractive, grade: Callable[[str, str], str] = containing) -> DataFrame:
    """A row per test and mode; ``naked`` sees no document. Tests of a document without text see none either."""
    rows = tests.select("path", "id", "q", "a").join(docs.select("path", F.col("body").alias("doc")), "path", "left")
    rows = rows.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, i, q, a, doc, mode in zip(pdf["path"], pdf["id"], pdf["q"], pdf["a"], pdf["doc"], pdf["mode"]):
                row = {"path": path, "id": i, "mode": mode, "question": q, "expected": a, "candidate": None, "grade": None, "passed": False, "error": None}
                try:
                    row["candidate"] = retrieve(None if mode == "naked" else doc, q)
                except Exception as e:
                    row["error"] = f"retriever-stage: {e}"
                else:
                    try:
                        row["grade"] = grade(row["candidate"], a)
                        said = row["grade"].upper()
                        row["passed"] = "PASS" in said and "FAIL" not in said
                    except Exception as e:
                        row["error"] = f"grader-stage: {e}"
                out.append(row)
            if out:
                yield pd.DataFrame(out, columns=["path", "id", "mode", "question", "expected", "candidate", "grade", "passed", "error"])

    return rows.select("path", "id", "q", "a", "doc", "mode").mapInPandas(run, RESULT)


def lift_report(results: DataFrame) -> DataFrame:
    """Per document: tests passed without and with it, the difference and what it says."""
    g = results.groupBy("path").agg(
        F.count_if((F.col("mode") == "naked") & F.col("passed")).alias("naked"), F.count_if((F.col("mode") == "injected") & F.col("passed")).alias("injected"), F.count_if(F.col("mode") == "injected").alias("total")
    )
    lift = F.col("injected") - F.col("naked")
    note = F.when(lift < 0, "alert").when((lift == 0) & (F.col("injected") == F.col("total")), "warning").otherwise("ok")
    return g.select("path", "naked", "injected", "total", lift.alias("lift"), note.alias("note"), (F.col("injected") == F.col("total")).alias("success"))


def run_totals(results: DataFrame) -> DataFrame:
    """Per document and mode: tests passed, all tests, whether all passed."""
    g = results.groupBy("path", "mode").agg(F.count_if("passed").alias("n_pass"), F.count(F.lit(1)).alias("n_total"))
    return g.withColumn("success", F.col("n_pass") == F.col("n_total"))


def paired(results: DataFrame) -> DataFrame:
    """Per test its result without and with the document: (path, id, question, expected, naked, injected, change).

    ``change`` is gained, lost or same. Tests that share an id are told apart by their question and answer; rows of a
    test that was not run in a mode have null there.
    """
    ran = lambda m: F.bool_or(F.when(F.col("mode") == m, F.col("passed")))
    g = results.groupBy("path", "id", "question", "expected").agg(ran("naked").alias("naked"), ran("injected").alias("injected"))
    change = F.when(F.col("injected") & ~F.col("naked"), "gained").when(F.col("naked") & ~F.col("injected"), "lost").otherwise("same")
    return g.withColumn("change", change)


def reprobed(tests: DataFrame, docs: DataFrame, retrieve: Callable[[str | None, str], str] = extractive, again: Callable[[str | None, str], str] | None = None, grade: Callable[[str, str], str] = containing) -> DataFrame:
    """(path, id, q, a, outcome): each test probed, and where it fails probed once more, by ``again`` (a retriever, else the same).

    ``ok`` passed at once, ``transient`` only the second time, ``repair`` not at all: its document needs work.
    """
    first = written(evaluated(tests, docs, ("injected",), retrieve, grade).select("path", "id", F.col("question").alias("q"), F.col("expected").alias("a"), "passed"), "probes")
    failed = first.where(~F.col("passed")).drop("passed")
    second = evaluated(failed, docs, ("injected",), again or retrieve, grade).select("path", "id", F.col("question").alias("q"), F.col("expected").alias("a"), F.when(F.col("passed"), "transient").otherwise("repair").alias("outcome"))
    return first.where("passed").select("path", "id", "q", "a", F.lit("ok").alias("outcome")).unionByName(second)


def cascade(edges: DataFrame, tests: DataFrame, target: str, seed: int = 0) -> DataFrame:
    """One test, drawn by a seeded hash, of every document that links to ``target``."""
    from pyspark.sql.window import Window

    linkers = edges.where(F.col("dst") == target).select(F.col("src").alias("path")).distinct()
    drawn = F.row_number().over(Window.partitionBy("path").orderBy(F.md5(F.concat_ws("/", "path", "id", "q", F.lit(seed))), "id", "q", "a"))
    return tests.join(linkers, "path", "left_semi").withColumn("n", drawn).where("n = 1").drop("n")
