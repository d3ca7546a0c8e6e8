"""Edges between documents and to the outside, from link syntax and front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.paths import folder, resolved

URL = r"(?i)^https?://"
LISTED = ("see_also", "prereq", "superseded_by", "episodic_source")


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def body_edges(docs: DataFrame, path: str = "path", body: str = "body", strip_fragment: bool = False, root: str | None = None) -> DataFrame:
    """(src, dst, edge_type) of markdown links and wikilinks; targets under ``/`` or ``#`` are none.

    A target outside the tree is an ``external_path``: absolute if the tree's ``root`` is given, else as it is written.
    """
    found = docs.select(F.col(path).alias("src"), F.explode(F.regexp_extract_all(body, F.lit(r"\[([^\]]+)\]\(([^)]+)\)"), F.lit(2))).alias("t"))
    found = found.select("src", _stripped(F.col("t")).alias("t")).where(~F.col("t").startswith("/") & ~F.col("t").startswith("#"))
    url = F.col("t").rlike(URL)
    target = F.regexp_replace("t", "#.*$", "") if strip_fragment else F.col("t")
    found = found.select("src", "t", url.alias("url"), F.when(~url, resolved(folder(F.col("src")), target)).alias("inner"))
    kind = F.when(F.col("url"), "external_url").when(F.col("inner").isNotNull(), "md_link").otherwise("external_path")
    outside = F.col("t")
    if root is not None:
        base = F.when(folder(F.col("src")) == ".", F.lit(root.strip("/"))).otherwise(F.concat(F.lit(root.strip("/") + "/"), folder(F.col("src"))))
        outside = F.when(F.col("url"), F.col("t")).otherwise(F.coalesce(F.concat(F.lit("/"), resolved(base, F.col("t"))), F.col("t")))
    links = found.select("src", F.coalesce("inner", outside).alias("dst"), kind.alias("edge_type"))
    wiki = docs.select(F.col(path).alias("src"), F.explode(F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("t"))
    return links.unionByName(wiki.select("src", _stripped(F.col("t")).alias("dst"), F.lit("wikilink").alias("edge_type")))


def frontmatter_edges(docs: DataFrame, path: str = "path", meta: str = "meta") -> DataFrame:
    """Edges of a map column of front matter, whose values are arrays of strings."""
    m = F.col(meta)
    source = docs.select(F.col(path).alias("src"), F.explode(F.try_element_at(m, F.lit("source"))).alias("dst"))
    source = source.select("src", "dst", F.when(F.col("dst").rlike(URL), "source_url").otherwise("source_ref").alias("edge_type"))
    out = source
    for k in LISTED:
        out = out.unionByName(docs.select(F.col(path).alias("src"), F.explode(F.try_element_at(m, F.lit(k))).alias("dst")).withColumn("edge_type", F.lit(f"frontmatter_{k}")))
    return out


def hub_edges(docs: DataFrame, path: str = "path") -> DataFrame:
    """Edges of the generated folder views: to their documents and to their subfolders."""
    p = F.col(path)
    own = docs.where((F.regexp_extract(p, r"([^/]*)$", 1) != "INDEX.md") & ~p.endswith(".tests.md")).select(p.alias("dst"), folder(p).alias("dir")).distinct()
    at = lambda d: F.when(d == ".", F.lit("INDEX.md")).otherwise(F.concat(d, F.lit("/INDEX.md")))
    children = own.select(at(F.col("dir")).alias("src"), "dst")
    dirs = own.select("dir").distinct()
    subs = dirs.where(F.col("dir") != ".").select(at(folder(F.col("dir"))).alias("src"), F.col("dir").alias("dst"))
    have = dirs.select(at(F.col("dir")).alias("src"))
    return children.unionByName(subs.join(have, "src", "left_semi")).withColumn("edge_type", F.lit("md_link"))


def deduplicated(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "edge_type"])
