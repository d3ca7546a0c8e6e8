"""Generated views of folders: the documents in each, with kind and summary, and its subfolders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.paths import folder, name, stem

_NOTE = "Generated view; edits are lost."


def listed(files: DataFrame) -> DataFrame:
    """Documents that folder views show."""
    p = F.col("path")
    return files.where(p.endswith(".md") & (name(p) != "INDEX.md") & ~p.endswith(".tests.md"))


def folder_lines(files: DataFrame, summary: str | None = None) -> DataFrame:
    """(dir, child, line) of every listed document."""
    p = F.col("path")
    tag = F.when(F.coalesce("kind", F.lit("")) != "", F.concat(F.lit(" ["), F.col("kind"), F.lit("]"))).otherwise("")
    text = F.regexp_replace(F.coalesce(F.col(summary), F.lit("")), r"^\s+|\s+$", "") if summary else F.lit("")
    tail = F.when(text != "", F.concat(F.lit(" — "), text)).otherwise("")
    line = F.concat(F.lit("- **["), stem(p), F.lit("]("), name(p), F.lit(")**"), tag, tail)
    return listed(files).select(folder(p).alias("dir"), name(p).alias("child"), line.alias("line"))


def folder_counts(files: DataFrame) -> DataFrame:
    """Per folder with documents: their number, the first and last by name, and how many have each of the commonest kinds."""
    return folder_lines(files).groupBy("dir").agg(F.count(F.lit(1)).alias("n_docs"), F.min("child").alias("first"), F.max("child").alias("last"))


def folder_views(files: DataFrame, summary: str | None = None) -> DataFrame:
    """(path, body) of the view of each folder with documents; a view is one file, so one folder is one row."""
    rows = folder_lines(files, summary).groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("child", "line"))).alias("rows"))
    dirs = rows.select("dir")
    parents = dirs.where(F.col("dir") != ".").select(F.col("dir").alias("sub"), folder(F.col("dir")).alias("dir"))
    subs = parents.groupBy("dir").agg(F.array_sort(F.collect_set(name(F.col("sub")))).alias("subs"))
    out = rows.join(subs, "dir", "left")
    lines = F.concat(F.array(F.concat(F.lit("# "), F.col("dir"), F.lit(" — Index")), F.lit(""), F.lit(_NOTE), F.lit("")), F.transform("rows", lambda r: r["line"]))
    more = F.when(F.col("subs").isNotNull(), F.concat(F.array(F.lit(""), F.lit("## Subfolders")), F.transform("subs", lambda s: F.concat(F.lit("- ["), s, F.lit("/]("), s, F.lit("/)"))))).otherwise(F.array().cast("array<string>"))
    path = F.when(F.col("dir") == ".", "INDEX.md").otherwise(F.concat("dir", F.lit("/INDEX.md")))
    return out.select(path.alias("path"), F.concat(F.array_join(F.concat(lines, more), "\n"), F.lit("\n")).alias("body"))
