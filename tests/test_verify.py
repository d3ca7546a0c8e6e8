import re

from ledgerloom.plans import retrieval

DOCS = [
    (1, "a.md", "An older text. The well is nine yards deep."),
    (2, "a.md", "---\nkind: log\n---\nThe rota hangs by the door.\nMarlow wrote the rota in May. " + "Filler stands here. " * 200 + "The spare key of the store is kept under the third step."),
    (3, "b.md", "La llave está detrás de la puerta. El pozo tiene nueve metros."),
    (4, "c.md", None),
]
TESTS = [
    ("a.md", 1, "Who wrote the rota?", "Marlow"), ("a.md", 2, "Where is the spare key of the store kept?", "under the third step"), ("a.md", 3, "How deep is the well?", "nine yards"),
    ("a.md", 3, "Who wrote the rota in May?", "marlow WROTE"), ("a.md", 3, "Who wrote the rota in May?", "marlow WROTE"), ("b.md", 1, "¿Dónde está la llave?", "detrás de la puerta"),
    ("c.md", 1, "What is here?", "nothing"), ("d.md", 1, "Long question that no document answers?", "x"), ("b.md", 2, None, "nueve"), ("b.md", 3, "¿Dónde está la llave?", None),
]


def words(s):
    return re.findall(r"\w+", (s or "").lower())


def brute():
    """Every test against every sentence of the latest text of its path."""
    body, rows = {}, {}
    for _, path, text in sorted(DOCS):
        if text is not None:
            body[path] = text
    for path, _, q, a in set(TESTS):
        said = re.split(r"(?<=[.!?。])\s+|\n+", body.get(path, ""))
        shared = [len(set(words(q)) & set(words(s))) for s in said]
        best = words(said[shared.index(max(shared))]) if max(shared) else words("DONT-KNOW")
        n = len(words(a))
        found = n > 0 and any(best[i : i + n] == words(a) for i in range(len(best)))
        total, passed = rows.get(path, (0, 0))
        rows[path] = (total + 1, passed + found)
    return {p: (0, k, n, k, "ok" if k or n else "warning", k == n) for p, (n, k) in rows.items()}


def test_answers_are_looked_for_in_the_documents(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id bigint, path string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(TESTS, "path string, id int, q string, a string").write.parquet(f"{tmp_path}/tests.parquet")
    got = {r.path: (r.naked, r.injected, r.total, r.lift, r.note, r.success) for r in retrieval.QUERIES["lift_answers"](spark, str(tmp_path)).collect()}
    assert got == brute()
    assert got["a.md"] == (0, 3, 4, 3, "ok", False) and got["d.md"] == (0, 0, 1, 0, "ok", False)
