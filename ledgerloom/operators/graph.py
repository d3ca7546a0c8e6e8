"""Reachability in the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import written


def backlinks(edges: DataFrame, target: str) -> DataFrame:
    """Sources that link to ``target``, sorted."""
    return edges.where(F.col("dst") == target).select("src").distinct().orderBy("src")


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other) of both directions, without repetitions and nulls."""
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


#: Nodes up to which a frontier or the visited nodes are broadcast; they are counted first.
SMALL = 100_000


def _levels(links: DataFrame, start: str, name: str, depth: int) -> DataFrame:
    """(node, ``name``) of nodes within ``depth`` steps along links (node, other), with the least number of steps.

    One join of the frontier with the links per level. Frontier and visited nodes are broadcast while they
    are few, so that the links are not shuffled for a small neighbourhood. Each level is a written table, so
    lineage stays short and a lost executor costs one level.
    """
    seen = links.sparkSession.createDataFrame([(start, 0)], f"node string, {name} int")
    return _spread(links, seen, 1, ["node"], name, depth)


def _spread(links: DataFrame, seen: DataFrame, n_seen: int, keys: list[str], name: str, depth: int | None) -> DataFrame:
    """``seen`` (keys, ``name``) and what is reached from it along links (node, other); None goes on until nothing is new."""
    frontier, n, level = seen, n_seen, 0
    small = lambda d, count: F.broadcast(d) if count <= SMALL else d
    while depth is None or level < depth:
        level += 1
        step = links.join(small(frontier.select(*keys), n), "node").drop("node").withColumnRenamed("other", "node").select(*keys).distinct()
        new = step.join(small(seen.select(*keys), n_seen), keys, "left_anti").withColumn(name, F.lit(level))
        frontier = written(new, name)
        n = frontier.count()
        if not n:
            break
        seen, n_seen = seen.unionByName(frontier), n_seen + n
        if level % 16 == 0:  # so that the union does not grow without end
            seen = written(seen, f"{name}-seen")
    return seen


def distances(edges: DataFrame, seed: str, depth: int = 4) -> DataFrame:
    """(node, dist) within ``depth`` hops of the seed, which is there at 0 even if no edge has it."""
    return _levels(written(undirected(edges), "links"), seed, "dist", depth)


def _along(edges: DataFrame, edge_type: str) -> DataFrame:
    links = edges.where((F.col("edge_type") == edge_type) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return links.select(F.col("src").alias("node"), F.col("dst").alias("other")).distinct()


def chain(edges: DataFrame, start: str, edge_type: str, depth: int | None = None) -> DataFrame:
    """(node, step) along edges of one type, as ``superseded_by``, to the end of the chain; a cycle ends where it closes."""
    return _levels(_along(edges, edge_type), start, "step", depth)


def chains(edges: DataFrame, edge_type: str) -> DataFrame:
    """(start, node, step): the chain of every node that has a successor, as ``chain``, all followed at once."""
    links = written(_along(edges, edge_type), "links")
    starts = links.select(F.col("node").alias("start"), "node").distinct().withColumn("step", F.lit(0))
    return _spread(links, starts, starts.count(), ["start", "node"], "step", None)
