"""What operators share: the shared work folder, written intermediate tables and hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most keys that ``hot_keys`` may return, hence the bound on what is broadcast for them.
MOST_HOT = 20_000


def session(app: str = "ledgerloom", master: str | None = None) -> SparkSession:
    """A session with the settings the operators are written for; values already set win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; only if it is unset (tests) a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders of intermediate tables that this process has written and not yet removed.
_WRITTEN: list[str] = []


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, to be removed as ``written`` tables are."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clean, spark)
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: it survives the loss of executors.

    Such tables are removed at the end of the process, or of the ``scratch`` block they are written in.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed."""
    if getattr(spark, "_ledgerloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="ledgerloom-")  # on the driver only; Spark copies the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = shutil.make_archive(os.path.join(folder, "ledgerloom"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(name)
    spark._ledgerloom_shipped = True


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders through the file system they are in; what is not there is passed over."""
    jvm = getattr(spark, "_jvm", None)
    for path in paths:
        if jvm is not None and spark.sparkContext._jsc is not None:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        else:  # no JVM at hand: only local folders can be reached
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _clean(spark: SparkSession, since: int = 0) -> None:
    gone = _WRITTEN[since:]
    del _WRITTEN[since:]
    try:
        remove(spark, *gone)
    except Exception:  # the session may be over
        for path in gone:
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written within are removed at the end: use results before, or write them elsewhere."""
    since = len(_WRITTEN)
    try:
        yield
    finally:
        _clean(spark, since)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def hot_keys(counts: DataFrame, n: str, total: int, least: int = 50_000) -> tuple[DataFrame, int]:
    """Rows of ``counts`` whose ``n`` exceeds a limit, and that limit.

    The limit is ``max(least, total / MOST_HOT)``, so at most MOST_HOT keys can exceed it whatever the
    size of the data: the result may be broadcast.
    """
    limit = max(least, total // MOST_HOT + 1)
    return counts.where(F.col(n) > limit), limit


def plain(c: Column | str) -> Column:
    """Spaces removed at both ends, then lower-cased; null and empty strings are null."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lower(F.trim(c))
    return F.when(out != "", out)
