"""Append-only logs of JSON lines, tolerant of blank and broken lines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schema import DREAM, RECALL, struct

SCHEMAS = {"recall": RECALL, "dream": DREAM}


def log_lines(spark: SparkSession, path: str, kind: str = "recall") -> DataFrame:
    """Records of a log with ``line_no`` in file order; a missing file is an empty log.

    Lines that are no JSON object are left out. Numbers rise in file order, with gaps.
    """
    schema = struct(SCHEMAS[kind])
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], struct(SCHEMAS[kind] + ", line_no bigint"))
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    rows = rows.where(F.col("value").rlike(r"^\s*\{"))
    wide = struct(SCHEMAS[kind] + ", _corrupt string")
    parsed = rows.select("line_no", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r")).where("r is not null and r._corrupt is null")
    return parsed.select(*[F.col(f"r.{f.name}") for f in schema.fields], "line_no")


def append(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; each is valid by construction."""
    df.write.mode("append").json(path)
