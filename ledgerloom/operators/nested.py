"""Deeply nested JSON records -> flat tables whose rows keep their parents' keys and positions.

Texts are indexed a batch at a time by ``functions.structural``; rows of all levels come out of one pass
over the records, in which no record meets another, so nothing is shuffled. A text that is null, empty or
not valid JSON gives no row; null elements keep their position but give no row; a lone value counts as a
list of one; a list, or the whole record, may itself be held as a JSON text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.structural import OPEN_ARR, OPEN_OBJ, STRING, Index, indexed

#: Bytes of text that are indexed at once; a longer text is indexed alone.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Nesting:
    """Lists at the top of a record and, in their elements, the lists below, level by level.

    ``names`` are the positions' column names by level, ``values`` the members that stand for an object.
    """

    tops: tuple[str, ...]
    below: tuple[str, ...]
    names: tuple[str, ...]
    values: tuple[str, ...]


#: dream_log.actions: items of six lists, their probes, and the probes' URLs.
ACTIONS = Nesting(
    ("coverage_ingests", "quality_repairs", "staleness_supersedes", "contested_resolved", "gaps_surfaced", "transients"),
    ("probes", "urls"),
    ("item_no", "probe_no", "url_no"),
    ("path", "url", "q"),
)


def _elements(ix: Index, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements of list nodes: (place in ``lists``, element node, position). A lone value is its own element."""
    place = np.full(len(ix.start), -1, np.int64)
    place[lists] = np.arange(len(lists))
    lone = ix.kind[lists] != OPEN_ARR
    inner = np.flatnonzero((ix.parent >= 0) & (place[np.maximum(ix.parent, 0)] >= 0))
    inner = inner[~lone[place[ix.parent[inner]]]]
    whose = np.concatenate([place[ix.parent[inner]], np.flatnonzero(lone)])
    nodes = np.concatenate([inner, lists[lone]])
    at = np.concatenate([ix.position[inner], np.zeros(int(lone.sum()), np.int64)])
    keep = ~ix.is_null(nodes)
    keep &= (ix.kind[nodes] == STRING) | (ix.kind[nodes] == OPEN_OBJ)
    return whose[keep], nodes[keep], at[keep]


def rows_of(texts: list[bytes], shape: Nesting) -> pd.DataFrame:
    """Rows (doc, list, one position per level, value) of valid texts; deeper positions are -1."""
    parts = []
    for ix, numbers in indexed(texts, shape.tops + shape.below):
        rows = _rows(ix, shape)
        parts.append(rows.assign(doc=numbers[rows["doc"].to_numpy()]))
    return pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]


def _rows(ix: Index, shape: Nesting) -> pd.DataFrame:
    levels = len(shape.names)
    tops, names = [], []
    of_root = np.zeros(len(ix.start), bool)
    roots = ix.root[ix.root >= 0]
    of_root[roots[ix.kind[roots] == OPEN_OBJ]] = True
    for k, name in enumerate(shape.tops):
        hit = np.flatnonzero(ix.named(name))
        hit = hit[of_root[ix.parent[hit]]]
        tops.append(hit)
        names.append(np.full(len(hit), k))
    lists, which = np.concatenate(tops), np.concatenate(names)
    positions = np.full((len(lists), levels), -1, np.int64)
    is_value = [ix.named(v) for v in shape.values]
    below = [ix.named(b) for b in shape.below]
    value_of = np.full(len(ix.start), -1, np.int64)
    for flag in reversed(is_value):
        v = np.flatnonzero(flag & (ix.kind == STRING))
        value_of[ix.parent[v]] = v
    out = []
    for level in range(levels):
        whose, nodes, at = _elements(ix, lists)
        which, positions = which[whose], positions[whose].copy()
        positions[:, level] = at
        holder = np.where(ix.kind[nodes] == STRING, nodes, value_of[nodes])
        out.append((ix.doc[nodes], which, positions, [ix.text(h) if h >= 0 else None for h in holder]))
        if level + 1 < levels:
            place = np.full(len(ix.start), -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            lists = np.flatnonzero(below[level])
            lists = lists[place[ix.parent[lists]] >= 0]
            whose = place[ix.parent[lists]]
            which, positions = which[whose], positions[whose]
    frame = {"doc": np.concatenate([o[0] for o in out]), "list": np.concatenate([o[1] for o in out])}
    stacked = np.concatenate([o[2] for o in out])
    frame |= {name: stacked[:, k].astype(np.int32) for k, name in enumerate(shape.names)}
    frame["value"] = [v for o in out for v in o[3]]
    return pd.DataFrame(frame)


def flattened(df: DataFrame, text: str, keys: Sequence[str], shape: Nesting = ACTIONS, list_name: str = "action", value_name: str = "item_value") -> DataFrame:
    """One row for each element at each level: ``keys``, list name, a position for each level, value."""
    schema = T.StructType([df.schema[k] for k in keys])
    schema = schema.add(list_name, T.StringType())
    for name in shape.names:
        schema = schema.add(name, T.IntegerType())
    schema = schema.add(value_name, T.StringType())
    columns = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["__text"].notna()]
            texts = [t.encode("utf-8", "replace") for t in pdf["__text"]]
            here = 0
            while here < len(texts):
                size, there = 0, here
                while there < len(texts) and (there == here or size + len(texts[there]) <= CHUNK):
                    size += len(texts[there])
                    there += 1
                rows = rows_of(texts[here:there], shape)
                here, start = there, here
                if not len(rows):
                    continue
                out = pdf[list(keys)].iloc[start:there].iloc[rows["doc"].to_numpy()].reset_index(drop=True)
                out[list_name] = [shape.tops[k] for k in rows["list"]]
                for name in shape.names:
                    out[name] = rows[name]
                out[value_name] = rows["value"]
                yield out[columns]

    return df.select(*keys, F.col(text).alias("__text")).mapInPandas(run, schema)
