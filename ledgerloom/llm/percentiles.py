"""Percentiles per group by deterministic buffer collapsing, in mergeable states.

A state holds sorted buffers, at most two full ones of ``k`` values for each weight; a value in a buffer of
weight w stands for w values. When the buffers of a weight are full they are merged, every second position
of the merge is selected, and the selection becomes a buffer of twice the weight: the schedule is a binary
tree over the weights. One such step moves any rank by at most w, n values cause at most n / (2 k w) steps
at weight w, so the rank error is at most n * h / (2 k) with h = log2(n / k) levels; the default k gives
0.5 % up to 2**40 full buffers. States carry the sum of their steps as ``err``. States of separate
partitions, days or files are combined by putting their buffers together.

Rows with a null key or value, or NaN, are left out. Groups of up to 2 k values are exact. Equal values
keep their multiplicity; an empty table has no groups. States are made where the rows are, so no group's rows
are brought together, however hot it is: only states are, in rounds of bounded fan-in. Rows are shuffled only
if repeated rows must be recognised, and then by their own key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.runtime import written

K = 4096
FLUSH = 400_000  # rows sorted at once
HELD = 4_000_000  # values of unfinished states that a task holds
FAN_IN = 256  # parts of a group that one merge takes

Buffers = dict[int, np.ndarray]


def collapsed(state: Buffers, k: int) -> tuple[Buffers, float]:
    """``state`` with fewer than 2 k values at each weight, and the rank error of the steps taken."""
    out: Buffers = {}
    err = 0.0
    todo = dict(state)
    while todo:
        w = min(todo)
        v = np.sort(todo.pop(w), kind="stable")
        if len(v) >= 2 * k:
            # The middle value of an odd number stays, so that the total weight is kept.
            mid = len(v) // 2
            rest = v[mid : mid + 1] if len(v) % 2 else v[:0]
            even = np.delete(v, mid) if len(v) % 2 else v
            picked = even[(int(np.log2(w)) & 1) :: 2]  # lower and upper positions by turns
            todo[2 * w] = np.concatenate([todo[2 * w], picked]) if 2 * w in todo else picked
            err += w
            v = rest
        if len(v):
            out[w] = v
    return out, err


def joined(a: Buffers, b: Buffers) -> Buffers:
    return {w: np.concatenate([x[w] for x in (a, b) if w in x]) for w in {*a, *b}}


def _codes(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number for each combination of keys."""
    code = np.zeros(len(t), np.int64)
    for key in keys:
        d = t[key].combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    return code


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0)))


def states(df: DataFrame, keys: Sequence[str], value: str, unique: Sequence[str] = (), k: int = K) -> DataFrame:
    """State rows (keys, part, weight, vals, err) of ``value`` per group and partition.

    ``unique`` names the columns by which repeated rows of a group are recognised (none: rows all count).
    """
    df = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    extra = [c for c in unique if c not in keys]
    rows = df.select(*keys, *extra, F.col(value).cast("double").alias("v"))
    if unique:
        rows = rows.dropDuplicates([*keys, *extra])
    return _leaves(rows.select(*keys, F.lit(0).alias("part"), "v"), keys, k)


def _schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    s = T.StructType([df.schema[c] for c in keys])
    for name, kind in (("part", T.IntegerType()), ("weight", T.LongType()), ("vals", T.ArrayType(T.DoubleType())), ("err", T.DoubleType())):
        s = s.add(name, kind)
    return s


def _emit(keys: Sequence[str], rows: pa.Table, at: list[int], weights: list[int], vals: list[np.ndarray], errs: list[float]) -> Iterator[pa.RecordBatch]:
    if at:
        head = rows.select([*keys, "part"]).take(pa.array(at))
        t = head.append_column("weight", pa.array(weights, pa.int64())).append_column("vals", _lists(vals)).append_column("err", pa.array(errs, pa.float64()))
        yield from t.combine_chunks().to_batches()


def _leaves(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    keyed = [*keys, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        large: dict[tuple, tuple[Buffers, float, pa.Table]] = {}

        def finish() -> Iterator[pa.RecordBatch]:
            for state, err, head in large.values():
                yield from _emit(keys, head, [0] * len(state), list(state), list(state.values()), [err, *[0.0] * (len(state) - 1)])
            large.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            v, code = t["v"].to_numpy(), _codes(t, keyed)
            order = np.lexsort((v, code))
            code, v = code[order], v[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            last = np.append(first[1:], len(code))
            big = last - first >= 2 * k
            small = np.flatnonzero(~big)
            if len(small):
                keep = np.repeat(~big, last - first)
                offsets = np.concatenate([[0], np.cumsum((last - first)[small])]).astype(np.int32)
                head = t.select(keyed).take(pa.array(order[first[small]]))
                n = len(small)
                out = head.append_column("weight", pa.array(np.ones(n, np.int64)))
                out = out.append_column("vals", pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[keep]))).append_column("err", pa.array(np.zeros(n)))
                yield from out.combine_chunks().to_batches()
            for i in np.flatnonzero(big):
                head = t.select(keyed).slice(order[first[i]], 1)
                name = tuple(head[c][0].as_py() for c in keyed)
                state, err, head = large.get(name, ({}, 0.0, head))
                state, more = collapsed(joined(state, {1: v[first[i] : last[i]]}), k)
                large[name] = (state, err + more, head)
            if sum(len(b) for s, _, _ in large.values() for b in s.values()) > HELD:
                yield from finish()

        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= FLUSH:
                yield from flush()
                n = 0
        yield from flush()
        yield from finish()

    return rows.mapInArrow(run, _schema(rows, keys))


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], k: int) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by ``keys``; a group of many states is collapsed on the way."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        change = np.zeros(len(t), bool)
        for key in keys:
            c = t[key].combine_chunks()
            if len(t) > 1:
                change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(change)
        cut = int(at[-1]) if len(at) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
        if len(rest) > FAN_IN:
            rest = _collapsed_table(rest, k)
    if rest is not None and len(rest):
        yield rest


def _collapsed_table(t: pa.Table, k: int) -> pa.Table:
    """The rows of one group as one state."""
    state: Buffers = {}
    for w, vals in zip(t["weight"].to_pylist(), t["vals"]):
        state = joined(state, {w: vals.values.to_numpy(zero_copy_only=False)})
    state, err = collapsed(state, k)
    errs = [float(pc.sum(t["err"]).as_py() or 0) + err, *[0.0] * (len(state) - 1)]
    head = t.drop_columns(["weight", "vals", "err"]).take(pa.array([0] * len(state)))
    return head.append_column("weight", pa.array(list(state), pa.int64())).append_column("vals", _lists(list(state.values()))).append_column("err", pa.array(errs))


def _merged_groups(t: pa.Table, keys: Sequence[str], k: int) -> Iterator[pa.RecordBatch]:
    """One state for each group of a table sorted by ``keys``; groups of few values are put together all at once."""
    t = t.combine_chunks()
    change = np.ones(len(t), bool)
    change[1:] = False
    for key in keys:
        c = t[key].combine_chunks()
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(t))
    sizes = pc.list_value_length(t["vals"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    small = (np.maximum.reduceat(t["weight"].to_numpy(), first) == 1) & (upto[last] - upto[first] < 2 * k)
    keep = np.repeat(small, last - first)
    if keep.any():
        some = t.filter(pa.array(keep)) if not keep.all() else t
        v = some["vals"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = (upto[last] - upto[first])[small]
        v = v[np.lexsort((v, np.repeat(np.arange(len(n)), n)))]
        head = t.drop_columns(["weight", "vals", "err"]).take(pa.array(first[small]))
        vals = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(v))
        head = head.append_column("weight", pa.array(np.ones(len(n), np.int64))).append_column("vals", vals)
        yield from head.append_column("err", pa.array(np.add.reduceat(t["err"].to_numpy(), first)[small])).combine_chunks().to_batches()
    for i in np.flatnonzero(~small):
        yield from _collapsed_table(t.slice(first[i], last[i] - first[i]), k).combine_chunks().to_batches()


def merged(state: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """States combined to one per group (or per part of a group, in rounds, while a group has too many)."""
    keys = list(keys)
    while True:
        state = written(state, "states")
        most = state.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        slots = -(-most // FAN_IN) if most > 4 * FAN_IN else 1
        slot = F.pmod(F.xxhash64("part", F.xxhash64("vals")), F.lit(slots)).cast("int")
        by = state.withColumn("part", slot if slots > 1 else F.lit(0))
        schema = _schema(by, keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _groups(batches, [*keys, "part"], k):
                yield from _merged_groups(t, [*keys, "part"], k)

        state = by.repartition(*keys, "part").sortWithinPartitions(*keys, "part").mapInArrow(run, schema)
        if slots == 1:
            return state


def percentiles(state: DataFrame, keys: Sequence[str], shares: Sequence[float], k: int = K) -> DataFrame:
    """(keys, n, err, q): per group the number of values, the greatest rank error and the values at ranks ceil(p n)."""
    keys, shares = list(keys), list(shares)
    schema = T.StructType([state.schema[c] for c in keys])
    schema = schema.add("n", T.LongType()).add("err", T.DoubleType()).add("q", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys, k):
            lists = t["vals"].combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            v = lists.flatten().to_numpy(zero_copy_only=False)
            group = _codes(t, keys)
            code, w = np.repeat(group, sizes), np.repeat(t["weight"].to_numpy(), sizes)
            order = np.lexsort((v, code))
            v, code, upto = v[order], code[order], np.cumsum(w[order])
            n_groups = int(group.max()) + 1
            end = np.searchsorted(code, np.arange(n_groups), "right")
            before = np.concatenate([[0], upto[end[:-1] - 1]]) if n_groups > 1 else np.zeros(1, np.int64)
            n = upto[end - 1] - before
            ranks = [before + np.ceil(np.round(p * n, 9)).astype(np.int64) for p in shares]
            q = np.stack([v[np.searchsorted(upto, np.maximum(r, before + 1), "left")] for r in ranks], axis=1)
            head = t.select(keys).take(pa.array(np.unique(group, return_index=True)[1]))
            err = np.bincount(group, t["err"].to_numpy(), n_groups)
            offsets = pa.array(np.arange(n_groups + 1, dtype=np.int32) * len(shares))
            out = head.append_column("n", pa.array(n)).append_column("err", pa.array(err)).append_column("q", pa.ListArray.from_arrays(offsets, pa.array(q.ravel())))
            yield from out.combine_chunks().to_batches()

    return state.select(*keys, "weight", "vals", "err").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
