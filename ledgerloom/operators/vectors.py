"""Exact nearest neighbours over arrays of floats, embedding by feature hashing, and incremental backfill."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import analysed, plain_tokens
from ledgerloom.runtime import written

POOL = 50


def l2(vector: Column, query: Sequence[float]) -> Column:
    """Distance to one vector, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in query])
    square = F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda acc, x: acc + x))


def nearest(vectors: DataFrame, key: str, query: Sequence[float], k: int = POOL, vector: str = "embedding") -> DataFrame:
    """The k nearest rows (key, distance); ties by key. Null vectors are not found."""
    return vectors.where(F.col(vector).isNotNull()).select(key, l2(F.col(vector), query).alias("distance")).orderBy("distance", key).limit(k)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / 2)


#: Bytes of query vectors that go to all tasks at once, and rows of them in one matrix product.
BLOCK_BYTES, PRODUCT_ROWS = 64 << 20, 1024


def _blocks(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """``rows`` in blocks of at most about BLOCK_BYTES of vectors: one row (rows) a block; and their number."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(vector)).alias("x")).first()
    n = max(1, -(-8 * (size["x"] or 0) // BLOCK_BYTES))
    by = F.xxhash64(*rows.columns)
    return rows.groupBy(F.pmod(by, F.lit(n))).agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).select("rows"), n


def nearest_of_many(vectors: DataFrame, queries: DataFrame, key: str, k: int, vector: str = "embedding") -> DataFrame:
    """For each query row its k nearest other rows: (query, key, distance, rank); ties by key.

    Queries are taken in blocks of BLOCK_BYTES, so all vectors are read once for some hundred thousand
    queries. A task keeps the k best of its partition for each query and emits only those.
    """
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField("query", kind), T.StructField(key, kind), T.StructField("distance", T.DoubleType())])
    vectors = vectors.where(F.col(vector).isNotNull()).select(key, vector)
    queries = queries.where(F.col(vector).isNotNull()).select(key, vector)
    blocks, n = _blocks(queries, vector)
    parts = []
    for part in blocks.toLocalIterator():  # one block at a time is on the driver
        shared = vectors.sparkSession.sparkContext.broadcast(([r[key] for r in part["rows"]], np.asarray([r[vector] for r in part["rows"]], np.float64)))
        found = vectors.mapInPandas(_best(key, vector, shared, k), schema)
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
        parts.append(found if n == 1 else written(found, "nearest"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    return reduce(DataFrame.unionByName, parts)


def _best(key: str, vector: str, shared, k: int) -> Callable:
    """For a partition of vectors: each query's k best of it, kept batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        ids = np.asarray(ids)
        best_d, best_key = np.full((len(ids), k), np.inf), np.empty((len(ids), k), object)
        for pdf in batches:
            if not len(pdf):
                continue
            # In order of keys, so that a stable sort breaks ties by key.
            pdf = pdf.sort_values(key, kind="stable")
            v, own = np.asarray(pdf[vector].tolist(), np.float64), pdf[key].to_numpy()
            for a in range(0, len(ids), PRODUCT_ROWS):
                part, ends = q[a : a + PRODUCT_ROWS], slice(a, a + PRODUCT_ROWS)
                d = np.maximum(0, (part**2).sum(1)[:, None] - 2 * part @ v.T + (v**2).sum(1)[None, :])
                d[own[None, :] == ids[ends, None]] = np.inf
                # The product form loses digits: some more than k are taken and measured again from differences.
                m = min(k + 8, d.shape[1])
                near = np.argpartition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else np.broadcast_to(np.arange(m), d.shape).copy()
                near.sort(axis=1)
                exact = np.sqrt(((part[:, None, :] - v[near]) ** 2).sum(2))
                exact[~np.isfinite(np.take_along_axis(d, near, 1))] = np.inf
                all_d, all_key = np.concatenate([best_d[ends], exact], 1), np.concatenate([best_key[ends], own[near]], 1)
                order = np.argsort(all_d, axis=1, kind="stable")
                new_d, new_key = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_key, order, 1)
                tied = np.isfinite(new_d[:, k]) & (new_d[:, k] == new_d[:, k - 1]) if new_d.shape[1] > k else np.zeros(len(part), bool)
                choice = {i: (all_d[i], all_key[i]) for i in np.flatnonzero(tied)}
                new_d, new_key = new_d[:, :k], new_key[:, :k]
                if m < d.shape[1]:
                    # Where more rows than were taken are as near as the k-th, as copies are, all of them are measured.
                    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    near_edge = d <= edge + 1e-9 * (1 + (part**2).sum(1)[:, None] + (v**2).sum(1)[None, :])
                    for i in np.flatnonzero(near_edge.sum(1) > m):
                        c = np.flatnonzero(near_edge[i] & np.isfinite(d[i]))
                        choice[i] = (np.concatenate([best_d[a + i], np.sqrt(((part[i] - v[c]) ** 2).sum(1))]), np.concatenate([best_key[a + i], own[c]]))
                for i, (c_d, c_key) in choice.items():
                    first = sorted((x, y) for x, y in zip(c_d.tolist(), c_key.tolist()) if np.isfinite(x))[:k]
                    new_d[i, : len(first)], new_key[i, : len(first)] = [x for x, _ in first], [y for _, y in first]
                best_d[ends], best_key[ends] = new_d, new_key
        rows, cols = np.nonzero(np.isfinite(best_d))
        if len(rows):
            yield pd.DataFrame({"query": ids[rows], key: best_key[rows, cols], "distance": best_d[rows, cols]})

    return run


def within(vectors: DataFrame, queries: DataFrame, key: str, radius: float, vector: str = "embedding") -> DataFrame:
    """For each query row all other rows nearer than ``radius``: (query, key, distance).

    Equal vectors are one row while distances are computed, so a pair of classes is held together once however
    many copies there are; blocks of distinct query vectors are taken as in ``nearest_of_many``.
    """
    one = lambda df: df.where(F.col(vector).isNotNull()).select(key, vector)
    kind = vectors.schema[key].dataType
    vectors, queries = one(vectors), one(queries)
    classes = vectors.groupBy(vector).agg(F.collect_list(key).alias("members"))
    schema = T.StructType([T.StructField("query_vector", vectors.schema[vector].dataType), T.StructField("members", T.ArrayType(kind)), T.StructField("distance", T.DoubleType())])
    single = np.float32 if vectors.schema[vector].dataType.elementType == T.FloatType() else np.float64
    blocks, n = _blocks(queries.select(vector).distinct(), vector)
    parts = []
    for part in blocks.toLocalIterator():  # one block at a time is on the driver
        shared = vectors.sparkSession.sparkContext.broadcast(np.asarray([r[vector] for r in part["rows"]], np.float64))
        found = classes.mapInPandas(_inside(vector, shared, radius, single), schema)
        parts.append(found if n == 1 else written(found, "within"))
    if not parts:
        parts = [vectors.sparkSession.createDataFrame([], schema)]
    pairs = reduce(DataFrame.unionByName, parts)
    asked = queries.select(F.col(key).alias("query"), F.col(vector).alias("query_vector"))
    pairs = asked.join(pairs, "query_vector").select("query", F.explode("members").alias(key), "distance")
    return pairs.where(F.col("query") != F.col(key))


def _inside(vector: str, shared, radius: float, kind: type) -> Callable:
    """For Arrow batches of classes: each query vector's classes of the batch that are nearer than the radius."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.asarray(pdf[vector].tolist(), np.float64)
            for a in range(0, len(asked), PRODUCT_ROWS):
                q = asked[a : a + PRODUCT_ROWS]
                squares = (q**2).sum(1)[:, None] + (v**2).sum(1)[None, :]
                # The product form loses digits: what may be inside is computed again from differences.
                rows, cols = np.nonzero(squares - 2 * q @ v.T <= radius**2 + 1e-9 * (1 + squares))
                exact = np.sqrt(((q[rows] - v[cols]) ** 2).sum(1))
                keep = exact < radius
                rows, cols = rows[keep], cols[keep]
                if len(rows):
                    yield pd.DataFrame({"query_vector": list(q[rows].astype(kind)), "members": pdf["members"].to_numpy()[cols], "distance": exact[keep]})

    return run


def pending(files: DataFrame, vectors: DataFrame, key: str = "path") -> DataFrame:
    """Files that have no vector yet."""
    return files.join(vectors.select(key), key, "left_anti")


def hashed_embedder(size: int = 384, stem: bool = True) -> Callable[[Column], Column]:
    """A deterministic embedder: signed feature hashing (MD5) of tokens, stemmed or as they are, length 1."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        import hashlib

        places: dict[str, tuple[int, float]] = {}  # of the batch's words

        def place(w: str) -> tuple[int, float]:
            if w not in places:
                h = hashlib.md5(w.encode("utf-8", "replace")).digest()
                places[w] = int.from_bytes(h[:4], "big") % size, 1.0 if h[4] & 1 else -1.0
            return places[w]

        def one(t: str | None) -> np.ndarray:
            v = np.zeros(size, np.float32)
            for w in analysed(t or "") if stem else plain_tokens(t or ""):
                at, sign = place(w)
                v[at] += sign
            n = np.linalg.norm(v)
            return v / n if n else v

        return texts.map(one)

    return embed


def backfill(files: DataFrame, vectors: DataFrame, text: str, embed: Callable[[Column], Column], key: str = "path", changed: DataFrame | None = None) -> DataFrame:
    """Vectors of files that lack one (and of those in ``changed``), to be appended."""
    todo = pending(files, vectors, key)
    if changed is not None:
        todo = todo.unionByName(files.join(changed.select(key), key, "left_semi")).dropDuplicates([key])
    return todo.select(key, embed(F.col(text)).alias("embedding"))
