"""The materialised index: tables that are replaced together.

A version is a folder with all tables; the file CURRENT names the version that readers see and is replaced in
one step, so a reader gets the old tables or the new ones, never some of each. Everything goes through the
Hadoop file system, so a store may be on any that Spark reads. A replaced version is kept until the next
replacement, for readers that began with it.
"""

from __future__ import annotations

import fcntl
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.runtime import exists, remove
from ledgerloom.schema import EDGES, FILES, VECTORS, struct

TABLES = {"files": FILES, "edges": EDGES, "vectors": VECTORS, "postings": "term string, path string, tf bigint, n_tokens bigint"}
CURRENT = "CURRENT"


class Busy(RuntimeError):
    """Another writer holds the store."""


def _local(folder: str) -> str | None:
    path = folder.removeprefix("file://")
    return None if "://" in path else path


@contextmanager
def writing(folder: str, spark: SparkSession | None = None) -> Iterator[None]:
    """Hold the store's only write lock: of the system on a local disk (gone with its process), else a file that only one can create."""
    path = _local(folder)
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, ".lock"), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except BlockingIOError:
                raise Busy(folder) from None
            yield
        return
    fs, p = _file(spark, f"{folder}/.lock")
    if not fs.createNewFile(p):
        raise Busy(folder)
    try:
        yield
    finally:
        fs.delete(p, False)


def _file(spark: SparkSession, name: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(name)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the version that readers see, if there is one."""
    if not exists(spark, f"{folder}/{CURRENT}"):
        return None
    fs, p = _file(spark, f"{folder}/{CURRENT}")
    stream = fs.open(p)
    try:
        return f"{folder}/{stream.readUTF()}"
    finally:
        stream.close()


def replace_all(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> str:
    """Write a version with all tables, then let readers see it; its folder. A failure before leaves the old one."""
    version = f"v-{uuid.uuid4().hex}"
    before = current(spark, folder)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    fs, new = _file(spark, f"{folder}/.{version}")
    stream = fs.create(new, True)
    stream.writeUTF(version)
    stream.close()
    # A rename that replaces is one step on the file systems Hadoop knows.
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{folder}/{CURRENT}"), how)
    keep = {version, (before or "").rsplit("/", 1)[-1]}
    here = _file(spark, folder)
    remove(spark, *[f"{folder}/{s.getPath().getName()}" for s in here[0].listStatus(here[1]) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in keep])
    return f"{folder}/{version}"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the store; empty if it was never written. A table that cannot be read is an error."""
    version = current(spark, folder)
    if version is None or not exists(spark, f"{version}/{name}"):
        return spark.createDataFrame([], struct(TABLES[name]))
    return spark.read.schema(struct(TABLES[name])).parquet(f"{version}/{name}")


def add(spark: SparkSession, folder: str, name: str, rows: DataFrame) -> None:
    """Append rows to a table of the version that readers see."""
    version = current(spark, folder)
    if version is None:
        replace_all(spark, folder, {name: rows})
    else:
        rows.write.mode("append").parquet(f"{version}/{name}")
