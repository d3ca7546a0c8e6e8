import numpy as np

from ledgerloom.operators import vectors as vec
from ledgerloom.plans import retrieval
from tests.oracle import agree


def test_all_members_of_a_group_of_copies_are_found(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(4, 8))
    rows = [(i, (base[i % 4] * 3 + (0 if i < 40 else rng.normal(size=8) * 0.1)).tolist()) for i in range(120)] + [(200, base[0].tolist()), (300, None)]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    e.coalesce(1).write.parquet(f"{tmp_path}/embeddings")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{tmp_path}/embeddings/*.parquet")[0], f"{tmp_path}/embeddings.parquet")
    query, sql = retrieval.QUERIES["near_duplicates_all"], retrieval.ORACLE["near_duplicates_all"]
    assert agree(spark, str(tmp_path), query, sql)
    assert query(spark, str(tmp_path)).where("query = 0").count() > 9
    monkeypatch.setattr(vec, "BLOCK_BYTES", 640)
    several = vec.within(e, e.where("vec_id % 3 = 0"), "vec_id", 0.6)
    v = {i: np.float32(x).astype(float) for i, x in rows if x}
    want = {(a, b) for a in v if a % 3 == 0 for b in v if a != b and np.linalg.norm(v[a] - v[b]) < 0.6}
    assert {(r.query, r.vec_id) for r in several.collect()} == want


def test_nearest_of_many_among_copies(spark, monkeypatch):
    """Ties go by key, whatever batch or block they are in."""
    monkeypatch.setattr(vec, "BLOCK_BYTES", 256)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8)).astype(np.float32)
    rows = [(i, base[i % 3 if i % 5 else i % 6].tolist()) for i in rng.permutation(300).tolist()]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = sorted((r.query, r["rank"], r.vec_id) for r in vec.nearest_of_many(e, e.where("vec_id % 20 = 0"), "vec_id", 4).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    v = {i: np.array(x) for i, x in rows}
    want = []
    for q in sorted(i for i in v if i % 20 == 0):
        near = sorted((float(np.linalg.norm(v[q] - x)), i) for i, x in v.items() if i != q)[:4]
        want += [(q, r + 1, i) for r, (_, i) in enumerate(near)]
    assert got == want
