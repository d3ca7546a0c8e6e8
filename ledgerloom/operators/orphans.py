"""References to records that do not exist, at the time of the reference.

Parents' keys are cut into ranges of a 64-bit hash (so ranges are of one size whatever the keys look
like); each range is stored as one row of sorted arrays: hashes, keys, and per key the merged intervals in
which a record of that key exists. References are shuffled once, to the range of their key, and stream by
the range's arrays in Arrow batches, each probed by binary search; a hit is confirmed on the key itself, so
equal hashes cannot confuse two keys. A task holds one range and one batch, however many references there
are. Ranges that many references fall into (hubs) are probed by several tasks, each with the range's arrays
and a part of the references. Only misses are shuffled again, to drop those of repeated rows.

Semantics: ``missing`` if no parent ever has the key; otherwise none if some parent of the key exists at
the time; otherwise ``deleted`` if one had existed before, else ``late``. A null ``indexed_at`` means
always there, a null ``deleted_at`` never deleted. References with a null key or target are no case; with
a null time only ``missing`` can be told.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import hot_keys, written

REFERRING = ("md_link", "wikilink")
PER_RANGE = 100_000
PER_PROBE = 500_000
_LOW, _HIGH = -(2**62), 2**62  # before and after every time
_NEVER = -(2**63)  # in place of an unknown time
_STORE = ("hs", "borns", "dieds", "sizes")


def path_key(c: Column) -> Column:
    """A path from the root without leading ``./``, ``#`` fragment and percent-escapes."""
    c = F.regexp_replace(F.regexp_replace(c, r"#.*$", ""), r"^(?:\./)+", "")
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def wiki_key(c: Column) -> Column:
    """The file name a wikilink means: what stands before ``#`` or ``|``."""
    return F.trim(F.regexp_replace(c, r"[#|].*$", ""))


def parent_keys(files: DataFrame) -> DataFrame:
    """(key, born, died) of files: ``p:`` and the path, ``w:`` and the name without folder and ``.md``."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keys = F.array(F.concat(F.lit("p:"), "path"), F.concat(F.lit("w:"), F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.md$", "")))
    return files.where(F.col("path").isNotNull()).select(
        F.explode(keys).alias("key"), F.coalesce(us("indexed_at"), F.lit(_LOW)).alias("born"), F.coalesce(us("deleted_at"), F.lit(_HIGH)).alias("died")
    )


def _range(h: Column, n: int) -> Column:
    """The range of a 64-bit hash: n ranges of one width."""
    width = 2**32 // n + 1
    return F.floor((F.shiftright(h, 32) + F.lit(2**31)) / F.lit(width)).cast("int")


def parent_store(keys: DataFrame, n_ranges: int) -> DataFrame:
    """One row per range: ``rng`` and arrays sorted by (hash, key, born), intervals of a key disjoint.

    Arrays are kept as bytes: beside a column of lists, the size of an Arrow batch is costly to take at every row.
    """
    keyed = keys.groupBy("key", "born").agg(F.max("died").alias("died"))
    keyed = keyed.withColumn("h", F.xxhash64("key")).withColumn("rng", _range(F.col("h"), n_ranges))
    keyed = keyed.repartition(n_ranges, "rng").sortWithinPartitions("rng", "h", "key", "born")

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted, so a range ends where the next begins."""
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                d = pd.concat(held, ignore_index=True)
                held.clear()
                # Overlapping intervals of a key become one: a new one begins after all earlier ones died.
                h, key, born = d["h"].to_numpy(), d["key"].to_numpy(), d["born"].to_numpy()
                new_key = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
                group = np.cumsum(new_key)
                reach = d["died"].groupby(group).cummax().to_numpy()
                start = new_key.copy()
                start[1:] |= born[1:] > reach[:-1]
                at = np.flatnonzero(start)
                ends = np.append(at[1:], len(d)) - 1
                raw = [k.encode() for k in key[at]]
                sizes = np.fromiter(map(len, raw), np.int32, len(raw))
                yield pd.DataFrame({"rng": [int(d["rng"].iloc[0])]} | {n: [v.tobytes()] for n, v in zip(_STORE, (h[at], born[at], reach[ends], sizes))} | {"keys": [b"".join(raw)]})

        for pdf in batches:
            for r, part in pdf.groupby("rng", sort=False):
                if held and held[-1]["rng"].iloc[0] != r:
                    yield from flush()
                held.append(part)
        yield from flush()

    return keyed.select("rng", "h", "key", "born", "died").mapInPandas(arrays, "rng int, " + ", ".join(f"{c} binary" for c in (*_STORE, "keys")))


def _unpacked(r: pd.Series) -> dict[str, np.ndarray]:
    """The arrays of a range; ``keys`` are cut from one string of bytes by their sizes."""
    out = {c: np.frombuffer(r[c], np.int64) for c in _STORE[:3]}
    ends = np.cumsum(np.frombuffer(r["sizes"], np.int32), dtype=np.int64)
    data = bytes(r["keys"])
    out["keys"] = np.array([data[a:b].decode() for a, b in zip([0, *ends[:-1]], ends)], object)
    return out


def _bisect(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each i the first place in values[lo[i]:hi[i]] beyond x[i]."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        right = (lo < hi) & (values[np.minimum(mid, len(values) - 1)] <= x)
        lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
    return lo


def probe(store: dict, h: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """'' or the reason, for references (hash, key, time in us or _NEVER)."""
    out = np.full(len(h), "missing", object)
    hs, keys, borns, dieds = (store[k] for k in ("hs", "keys", "borns", "dieds"))
    lo, hi = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
    # Within equal hashes, the part that has the key itself; more than one key there is very rare.
    todo = np.flatnonzero(lo < hi)
    pure = keys[lo[todo]] == key[todo]
    pure &= keys[hi[todo] - 1] == key[todo]
    for i in todo[~pure]:
        same = np.flatnonzero(keys[lo[i] : hi[i]] == key[i])
        lo[i], hi[i] = (lo[i] + same[0], lo[i] + same[-1] + 1) if len(same) else (0, 0)
    known = np.flatnonzero(lo < hi)
    out[known] = ""
    timed = known[at[known] != _NEVER]
    after = _bisect(borns, lo[timed], hi[timed], at[timed])
    born = after > lo[timed]
    out[timed[~born]] = "late"
    dead = born & (dieds[np.maximum(after - 1, 0)] <= at[timed])
    out[timed[dead]] = "deleted"
    return out


def orphans(edges: DataFrame, files: DataFrame, per_range: int = PER_RANGE, per_probe: int = PER_PROBE) -> DataFrame:
    """Distinct (src, dst, edge_type, period, reason) of edges whose target does not exist at ``seen_at``."""
    parents = parent_keys(files)
    n = parents.count()
    n_ranges = max(1, -(-n // per_range))
    store = written(parent_store(parents, n_ranges), "parents")
    kind = F.col("edge_type")
    key = F.when(kind == "wikilink", F.concat(F.lit("w:"), wiki_key(F.col("dst")))).otherwise(F.concat(F.lit("p:"), path_key(F.col("dst"))))
    referring = edges.where((kind.isin(*REFERRING) | kind.startswith("frontmatter_")) & F.col("dst").isNotNull())
    keyed = lambda d: d.withColumn("key", key).withColumn("h", F.xxhash64("key")).withColumn("rng", _range(F.col("h"), n_ranges))
    refs = keyed(referring.select("src", "dst", "edge_type", "seen_at"))
    refs = refs.select("rng", "src", "dst", "edge_type", F.date_format("seen_at", "yyyy-MM").alias("period"), F.coalesce(F.unix_micros(F.col("seen_at").cast("timestamp")), F.lit(_NEVER)).alias("at"), "key", "h")
    # Ranges with more than per_probe references are probed in parts. Their number is bounded by rows / limit.
    counts = keyed(referring.select("dst", "edge_type")).groupBy("rng").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    fan = F.lit(1)
    if total > per_probe:
        hot, limit = hot_keys(counts, "n", total, per_probe)
        hot = F.broadcast(written(hot.select("rng", F.ceil(F.col("n") / limit).cast("int").alias("fan")), "hot-ranges"))
        refs, store = refs.join(hot, "rng", "left"), store.join(hot, "rng", "left")
        fan = F.coalesce("fan", F.lit(1))
    refs = refs.withColumn("part", F.pmod(F.xxhash64("src", "dst", "edge_type"), fan).cast("int")).select("rng", "part", "src", "dst", "edge_type", "period", "at", "key", "h", F.lit(True).alias("ref"))
    store = store.withColumn("part", F.explode(F.sequence(F.lit(0), fan - 1))).select("rng", "part", *_STORE, "keys")
    # A range's arrays come before its references. Numbers have no nulls, which pandas would turn into floats.
    store = store.withColumns({"at": F.lit(0).cast("bigint"), "h": F.lit(0).cast("bigint"), "ref": F.lit(False)})
    both = store.unionByName(refs, allowMissingColumns=True).repartition("rng", "part").sortWithinPartitions("rng", "part", "ref")
    return both.mapInPandas(_probed, "src string, dst string, edge_type string, period string, reason string").distinct()


_NONE = {"hs": np.zeros(0, np.int64), "keys": np.zeros(0, object), "borns": np.zeros(0, np.int64), "dieds": np.zeros(0, np.int64)}


def _probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Misses of sorted rows: of each range first its arrays, if it has any parent, then its references."""
    place, arrays = None, _NONE
    for pdf in batches:
        if not len(pdf):
            continue
        rng, part, stored = pdf["rng"].to_numpy(), pdf["part"].to_numpy(), ~pdf["ref"].to_numpy(bool)
        cuts = np.flatnonzero(np.concatenate([[True], (rng[1:] != rng[:-1]) | (part[1:] != part[:-1]) | stored[1:] | stored[:-1]]))
        found = []
        for a, b in zip(cuts, [*cuts[1:], len(pdf)]):
            if stored[a]:
                r = pdf.iloc[a]
                place, arrays = (rng[a], part[a]), _unpacked(r)
                continue
            left = pdf.iloc[a:b]
            reason = probe(arrays if place == (rng[a], part[a]) else _NONE, left["h"].to_numpy(np.int64), left["key"].to_numpy(object), left["at"].to_numpy(np.int64))
            miss = reason != ""
            found.append(left.loc[miss, ["src", "dst", "edge_type", "period"]].assign(reason=reason[miss]))
        if found:
            yield pd.concat(found, ignore_index=True)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans by edge type, period and reason."""
    return found.groupBy("edge_type", "period", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
