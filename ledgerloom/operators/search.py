"""Ranked search: text or vectors, graph distance and folder distance, under filters.

Vectors are tried first; only if they yield nothing text ranking is used. Kind and subtree filters come
after the k nearest vectors but before the k best texts. Scores are divided by the best of the pool.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.paths import hops, in_subtree, parts
from ledgerloom.operators import vectors as vec
from ledgerloom.operators.graph import distances
from ledgerloom.operators.textindex import POOL, TextIndex, top

WEIGHTS = (0.6, 0.25, 0.15)


def filtered(files: DataFrame, kind: str | None, prefix: str | None, strict: bool = False) -> DataFrame:
    if kind:
        files = files.where(F.col("kind") == kind)
    if prefix:
        files = files.where(in_subtree(F.col("path"), prefix, strict))
    return files


def normalised(pool: DataFrame, score: Column) -> DataFrame:
    """(path, text_score): scores of at most POOL rows divided by their maximum (by 1 if it is 0)."""
    best = F.max(score).over(Window.partitionBy(F.lit(0)))
    return pool.select("path", (score / F.when(best == 0, 1.0).otherwise(best)).alias("text_score"), score.alias("raw_score"))


def text_pool(index: TextIndex, files: DataFrame, query: str, kind: str | None = None, prefix: str | None = None, strict: bool = False, limit: int = POOL) -> DataFrame:
    hits = index.bm25(query, strict).join(filtered(files, kind, prefix).select("path"), "path")
    return normalised(top(hits, "path", limit), F.col("score"))


def vector_pool(vectors: DataFrame, files: DataFrame, query: Sequence[float], kind: str | None = None, prefix: str | None = None, limit: int = POOL) -> DataFrame:
    near = vec.nearest(vectors, "path", query, limit)
    kept = near.join(filtered(files, kind, prefix).select("path"), "path")
    return normalised(kept, vec.similarity(F.col("distance")))


def fused(pool: DataFrame, dist: DataFrame | None, seed: str, weights: Sequence[float] = WEIGHTS, k: int = 5) -> DataFrame:
    """(path, score, text, graph, hier, graph_dist): the k best; ties in order of the pool, then by path."""
    if k < 0:
        raise ValueError("the number of results must not be negative")
    rows = pool.join(dist.select(F.col("node").alias("path"), F.col("dist").alias("graph_dist")), "path", "left") if dist is not None else pool.withColumn("graph_dist", F.lit(None).cast("int"))
    graph = F.coalesce(1.0 / (F.col("graph_dist") + 1), F.lit(0.0))
    hier = 1.0 / (hops(parts(F.lit(seed)), parts(F.col("path"))) + 1) if seed else F.lit(0.0)
    w = [F.lit(float(x)) for x in weights]
    total = w[0] * F.col("text_score") + w[1] * graph + w[2] * hier
    out = rows.select("path", total.alias("score"), F.round("text_score", 4).alias("text"), F.round(graph, 4).alias("graph"), F.round(hier, 4).alias("hier"), "graph_dist", "text_score")
    return out.orderBy(F.desc("score"), F.desc("text_score"), "path").limit(k).drop("text_score")


@dataclass(frozen=True)
class Search:
    """``Search(files, index, edges, vectors).of("words").within("a/b").near("x.md").kind("log").top(5).run()``"""

    files: DataFrame
    index: TextIndex | None = None
    edges: DataFrame | None = None
    vectors: DataFrame | None = None
    query: str = ""
    query_vector: tuple[float, ...] | None = None
    prefix: str | None = None
    seed: str | None = None
    wanted: str | None = None
    k: int = 5
    weights: tuple[float, float, float] = WEIGHTS
    strict: bool = False

    def of(self, query: str, vector: Sequence[float] | None = None) -> Search:
        return replace(self, query=query, query_vector=tuple(vector) if vector is not None else None)

    def within(self, prefix: str) -> Search:
        return replace(self, prefix=prefix)

    def near(self, seed: str) -> Search:
        return replace(self, seed=seed)

    def kind(self, kind: str) -> Search:
        return replace(self, wanted=kind)

    def top(self, k: int) -> Search:
        return replace(self, k=k)

    def pool(self) -> DataFrame:
        if self.vectors is not None and self.query_vector is not None:
            found = vector_pool(self.vectors, self.files, self.query_vector, self.wanted, self.prefix)
            if self.index is None or found.limit(1).count():
                return found
        if self.index is None:
            raise ValueError("neither vectors nor a text index to search")
        return text_pool(self.index, self.files, self.query, self.wanted, self.prefix, self.strict)

    def run(self, metadata: bool = False) -> DataFrame:
        dist = distances(self.edges, self.seed) if self.edges is not None and self.seed else None
        best = fused(self.pool(), dist, self.seed or self.prefix or "", self.weights, self.k)
        if not metadata:
            return best
        # At most k rows look up their metadata.
        meta = self.files.select("path", "kind", "source", "ingested_at", "n_tests")
        return F.broadcast(best).join(meta, "path", "left") if self.k <= 1000 else best.join(meta, "path", "left")
