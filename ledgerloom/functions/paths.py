"""Path arithmetic as column expressions; paths are relative to the root of the tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(c: Column) -> Column:
    """Components of a path; a leading slash is one, empty ones and dots are none."""
    names = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    return F.when(c.startswith("/"), F.concat(F.array(F.lit("/")), names)).otherwise(names)


def hops(a: Column, b: Column) -> Column:
    """Steps between two paths through their longest common prefix."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, F.lit(False))
    common = F.when(differ == 0, F.size(same)).otherwise(differ - 1)
    return (F.size(a) + F.size(b) - 2 * common).cast("int")


def hierarchy_distance(a: Column, b: Column) -> Column:
    return hops(parts(a), parts(b))


def folder(c: Column) -> Column:
    """The folder of a path, ``.`` at the root."""
    return F.when(c.contains("/"), F.regexp_replace(c, r"/[^/]*$", "")).otherwise(".")


def name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def stem(c: Column) -> Column:
    return F.regexp_replace(name(c), r"\.md$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def in_subtree(c: Column, prefix: str, strict: bool = False) -> Column:
    """Whether a path begins with ``prefix``: by ASCII case folding with ``%`` and ``_`` as wildcards, or strictly by folders."""
    bare = prefix.rstrip("/")
    if strict:
        return (c == bare) | c.startswith(bare + "/")
    return F.like(ascii_lower(c), ascii_lower(F.lit(bare.replace("\\", "\\\\") + "%")))


def resolved(base: Column, target: Column) -> Column:
    """``target`` seen from the folder ``base``: dots collapsed; null if it leaves the root."""
    start = F.when(base == ".", F.array().cast("array<string>")).otherwise(parts(base))
    names = F.concat(start, F.filter(F.split(target, "/"), lambda p: (p != "") & (p != ".")))
    lost = F.array(F.lit(".."))
    step = lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when((F.size(acc) == 0) | (F.element_at(acc, 1) == ".."), F.concat(lost, acc)).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))
    out = F.aggregate(names, F.array().cast("array<string>"), step)
    return F.when((F.size(out) == 0) | (F.try_element_at(out, F.lit(1)) != "..") | F.try_element_at(out, F.lit(1)).isNull(), F.array_join(out, "/"))
