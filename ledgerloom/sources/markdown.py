"""A tree of markdown files with front matter and sibling test files as DataFrames.

Folders and files whose names begin with ``_`` or ``.`` count, which Spark's own file listing passes over. The
driver lists folders until it has some hundred of them, whose trees the executors then list, as they read
the contents, so the tree must be reachable from all of them.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.runtime import parallelism

FENCE = r"(?s)\A---\n(.*?)\n---\n(.*)"
RAW = "path string, mtime double, text string, tests string"
META = T.StructType([T.StructField("plain", T.MapType(T.StringType(), T.StringType())), T.StructField("strings", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])
CASES = T.ArrayType(T.StructType([T.StructField("id", T.IntegerType()), T.StructField("q", T.StringType()), T.StructField("a", T.StringType())]))


def _yaml(text: str):
    """A YAML value, or None if the text is none."""
    try:
        return yaml.safe_load(text)
    except (yaml.YAMLError, ValueError):
        return None


def _is_document(name: str) -> bool:
    return name.endswith(".md") and not name.endswith(".tests.md")


def listing(root: str) -> list[str]:
    """Relative paths of all markdown files below ``root`` but test files, sorted; on the driver, for small trees."""
    found = []
    for folder, _, names in os.walk(root):
        found += [os.path.relpath(os.path.join(folder, n), root) for n in names if _is_document(n)]
    return sorted(found)


#: Folders from which on the executors list what is below.
WIDE = 256


def _paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all documents below ``root``."""
    files: list[str] = []
    folders = [root]
    while folders and len(folders) < WIDE:  # one level of the tree after the other
        below = []
        for folder in folders:
            with os.scandir(folder) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        below.append(e.path)
                    elif _is_document(e.name):
                        files.append(os.path.relpath(e.path, root))
        folders = below
    near = spark.createDataFrame([(p,) for p in files], "path string")
    if not folders:
        return near.repartition(max(1, min(len(files) // 64 + 1, 10_000)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder in pdf["folder"]:
                found = [os.path.relpath(os.path.join(folder, p), root) for p in listing(folder)]
                if found:
                    yield pd.DataFrame({"path": found})

    far = spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 10_000)).mapInPandas(walk, "path string")
    return near.unionByName(far).repartition(parallelism(spark))


def raw_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, text, tests): contents decoded with replacement, line breaks as ``\\n``; tests null if there is no such file."""
    root = os.path.abspath(root)
    if not os.path.isdir(root):
        return spark.createDataFrame([], RAW)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def load(path: str) -> str | None:
            try:
                with open(path, "rb") as f:
                    return f.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
            except FileNotFoundError:
                return None

        for pdf in batches:
            full = [os.path.join(root, p) for p in pdf["path"]]
            yield pd.DataFrame({"path": pdf["path"], "mtime": [os.path.getmtime(f) for f in full], "text": [load(f) for f in full], "tests": [load(f[:-3] + ".tests.yaml") for f in full]})

    return _paths(spark, root).mapInPandas(read, RAW)


@F.pandas_udf(META)
def front_matter(texts: pd.Series) -> pd.DataFrame:
    """A YAML mapping as ``plain`` (every value as text) and ``strings`` (values that are strings, and the strings of lists).

    Nulls are left out; what is no mapping gives empty maps.
    """

    def one(t: str | None) -> tuple[dict, dict]:
        value = _yaml(t) if t else None
        if not isinstance(value, dict):
            return {}, {}
        plain = {str(k): str(v) for k, v in value.items() if v is not None}
        strings = {str(k): [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)] for k, v in value.items() if isinstance(v, (str, list))}
        if isinstance(value.get("source"), list):  # a source is one string or none
            del strings["source"]
        return plain, strings

    found = [one(t) for t in texts]
    return pd.DataFrame({"plain": [p for p, _ in found], "strings": [x for _, x in found]})


@F.pandas_udf(CASES)
def test_cases(texts: pd.Series) -> pd.Series:
    """The cases of a test file; null if the file is no list."""

    def one(t: str | None):
        value = _yaml(t) if t else None
        if not isinstance(value, list):
            return None
        text = lambda x: None if x is None else str(x)
        return [{"id": c.get("id") if isinstance(c.get("id"), int) else None, "q": text(c.get("q")), "a": text(c.get("a"))} for c in value if isinstance(c, dict)]

    return texts.map(one)


def split_documents(raw: DataFrame) -> DataFrame:
    """Raw documents with ``body``, ``meta`` and the columns of the files relation."""
    fenced = F.col("text").rlike(FENCE)
    head = F.when(fenced, F.regexp_extract("text", FENCE, 1))
    body = F.when(fenced, F.regexp_extract("text", FENCE, 2)).otherwise(F.col("text"))
    rows = raw.withColumn("frontmatter", head).withColumn("body", body).withColumn("head", front_matter("frontmatter")).withColumn("cases", test_cases("tests"))
    one = lambda k: F.coalesce(F.try_element_at("head.plain", F.lit(k)), F.lit(""))
    return rows.select(
        "path", one("kind").alias("kind"), one("source").alias("source"), one("ingested_at").alias("ingested_at"), one("last_modified_at").alias("last_modified_at"),
        "mtime", F.coalesce(F.size("cases"), F.lit(0)).alias("n_tests"), "frontmatter", "body", one("summary").alias("summary"), F.col("head.strings").alias("meta"), "cases",
    )


def tests_of(docs: DataFrame) -> DataFrame:
    """(path, id, q, a) of the documents' test cases."""
    return docs.select("path", F.inline("cases"))
