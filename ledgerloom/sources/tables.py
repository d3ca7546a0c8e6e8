"""Parquet tables as the relations of a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file; whole copies of rows are dropped."""
    return table(spark, folder, "files").select("path", "kind", "source", "ingested_at", "last_modified_at", "mtime", "n_tests", "frontmatter").distinct()


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "edges").where(F.col("dst").isNotNull()).select("src", "dst", "edge_type").distinct()


def recalls(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct records; struct columns other than the web URL are not read."""
    log = table(spark, folder, "recall_log")
    return log.select("rec_id", "ts", "question", "topic_hint", F.col("probes.web.url").alias("url"), "reconciliation_pattern", "decided_source", "ingested", "ingested_path", "duration_ms").distinct()
