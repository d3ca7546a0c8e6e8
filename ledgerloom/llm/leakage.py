"""Evaluation passages inside a training corpus, by winnowing.

Texts are brought to one form: compatibility forms folded (width), case folded, accents and invisible
characters removed; words are the runs of letters and digits that remain. Of every window of ``w``
consecutive k-gram hashes the smallest is kept as a fingerprint, so any shared run of k + w - 1 units has
a fingerprint in common. Units are words (k = 8, w = 5: runs of 12), or for items in scripts without
spaces letters and digits (k = 12, w = 9: runs of 20). Fingerprints that a document shares with an item are
extended to the left and right on the units themselves; a pair is reported if a run is long enough.

A run through a hit is long enough if, beside the k units of the hit, w - 1 more agree on its two sides together,
so w - 1 units to the left and right decide. Items that agree on these (boilerplate) are one class of the
fingerprint and looked at once a hit; only classes that pass are taken apart into their items.

The documents are read once and not shuffled while the items' fingerprints are at most MOST_FINGERPRINTS
(they are counted first): each batch of documents is joined to their sorted array. Beyond that the
fingerprints of both sides are joined by a shuffle, in which fingerprints that very many documents have are
salted; places that pass are joined with the texts. Null and empty texts have no units; repeated rows and
several runs of one item in a document give one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
import unicodedata
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.runtime import hot_keys, written

WORDS, LETTERS = 0, 1
#: By unit: (k, w); shared runs of k + w - 1 units are found.
SIZES = {WORDS: (8, 5), LETTERS: (12, 9)}
SPACELESS = ("ja", "zh")
MOST_FINGERPRINTS = 2_000_000

_DROP = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}\p{Cc}--\s]+", regex.V1)
_UNITS = regex.compile(r"[\p{L}\p{N}]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the text's folded form."""
    if not text:
        return []
    if not text.isascii():
        folded = unicodedata.normalize("NFKC", text).casefold()
        text = unicodedata.normalize("NFC", _DROP.sub("", unicodedata.normalize("NFKD", folded)))
    else:
        text = _DROP.sub("", text.lower())
    return _UNITS.findall(text)


class _Hashes(dict):
    """Hashes of words; each word is hashed once, the oldest are forgotten together when there are too many."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def codes(units: Sequence[str] | str, kind: int) -> np.ndarray:
    """A 64-bit number for each word, or each letter of joined words."""
    if kind == WORDS:
        return np.fromiter(map(_HASHES.__getitem__, units), np.uint64, len(units))
    return np.frombuffer("".join(units).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def winnowed(code: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a unit sequence: hashes and their positions."""
    k, w = SIZES[kind]
    n = len(code) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _BASE + code[j : j + n]
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(kind)
        h ^= h >> np.uint64(32)
    if n < w:
        at = np.array([n - 1 - int(np.argmin(h[::-1]))])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        at = np.unique(np.arange(len(view)) + w - 1 - np.argmin(view[:, ::-1], axis=1))
    return h[at].view(np.int64), at


def run_length(a: np.ndarray, b: np.ndarray, i: int, j: int, k: int) -> tuple[int, int]:
    """Of the shared run of units that holds a[i:i+k] and b[j:j+k]: its start in a and length; 0 if they differ."""
    if not np.array_equal(a[i : i + k], b[j : j + k]):
        return i, 0
    back = min(i, j)
    x = a[i - back : i][::-1] == b[j - back : j][::-1]
    left = back if x.all() else int(np.argmin(x))
    ahead = min(len(a) - i - k, len(b) - j - k)
    y = a[i + k : i + k + ahead] == b[j + k : j + k + ahead]
    right = ahead if y.all() else int(np.argmin(y))
    return i - left, left + k + right


def longest(a: np.ndarray, b: np.ndarray, places: Sequence[tuple[int, int]], kind: int) -> int:
    """The longest shared run through any of the hit places (position in a, position in b)."""
    k, _ = SIZES[kind]
    best, reached = 0, {}
    for i, j in sorted(places):
        if i < reached.get(i - j, -1):
            continue
        start, n = run_length(a, b, i, j, k)
        reached[i - j] = start + n
        best = max(best, n)
    return best


def _kind(lang: str | None) -> int:
    return LETTERS if (lang or "").strip().lower().split("-")[0] in SPACELESS else WORDS


def _prints(df: DataFrame, key: str, lang: str | None, all_letters: bool) -> DataFrame:
    """(key, kind, h, at): the fingerprints of texts; by words and letters unless ``lang`` tells which."""
    schema = T.StructType([df.schema[key], T.StructField("kind", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, kinds, hs, ats = [], [], [], []
            for row in zip(pdf[key], pdf["__text"], pdf["__lang"]):
                units = words(row[1])
                for kind in [_kind(row[2])] if lang else _streams(row[1], all_letters):
                    h, at = winnowed(codes(units, kind), kind)
                    keys += [row[0]] * len(h)
                    kinds.append(np.full(len(h), kind))
                    hs.append(h)
                    ats.append(at)
            if keys:
                yield pd.DataFrame({key: keys, "kind": np.concatenate(kinds), "h": np.concatenate(hs), "at": np.concatenate(ats)})

    return df.select(key, F.col("text").alias("__text"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("__lang")).mapInPandas(run, schema)


def _streams(text: str | None, all_letters: bool) -> list[int]:
    """By which units a document is fingerprinted: letters only where an item by letters could occur."""
    return [WORDS, LETTERS] if text and (all_letters or _CJK.search(text)) else [WORDS]


def _plain_letters(text: str | None, lang: str | None) -> bool:
    """Whether an item by letters has a run of the found length without a letter of its script."""
    if _kind(lang) != LETTERS:
        return False
    k, w = SIZES[LETTERS]
    return any(len(run) >= k + w - 1 for run in _CJK.split("".join(words(text))))


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", most: int = MOST_FINGERPRINTS) -> DataFrame:
    """(doc_key, item_key, n_units): documents that hold a long enough part of an item, and the longest run.

    Both sides need ``text``, items also ``lang``.
    """
    items = items.select(item_key, "text", "lang").where(F.col("text").isNotNull()).distinct()

    def lacks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [any(map(_plain_letters, pdf["text"], pdf["lang"]))]})

    all_letters = bool(items.select("text", "lang").mapInPandas(lacks, "x boolean").where("x").limit(1).count())
    test = written(_prints(items, item_key, "lang", False), "item-prints")
    schema = T.StructType([docs.schema[doc_key], items.schema[item_key], T.StructField("n_units", T.IntegerType())])
    docs = docs.where(F.col("text").isNotNull())
    if test.count() <= most:
        found = _mapped(docs, items, test, doc_key, item_key, schema, all_letters)
    else:
        found = _joined(docs, items, test, doc_key, item_key, schema, all_letters)
    return found.groupBy(doc_key, item_key).agg(F.max("n_units").alias("n_units"))


def _context(code: np.ndarray, at: int, kind: int) -> tuple[bytes, bytes, bytes]:
    """The units of a fingerprint and the w - 1 on its left (from the near to the far one) and right."""
    k, w = SIZES[kind]
    return code[max(0, at - w + 1) : at][::-1].tobytes(), code[at : at + k].tobytes(), code[at + k : at + k + w - 1].tobytes()


def _passes(a: tuple[bytes, bytes, bytes], b: tuple[bytes, bytes, bytes], kind: int) -> bool:
    """Whether a run through the fingerprints of two contexts is long enough."""
    if a[1] != b[1]:
        return False
    need = SIZES[kind][1] - 1
    for x, y in ((a[0], b[0]), (a[2], b[2])):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        n = min(len(p), len(q))
        same = p[:n] == q[:n]
        need -= n if same.all() else int(np.argmin(same))
    return need <= 0


def _classes(prints: pd.DataFrame, item_key: str, units_of: dict) -> tuple[np.ndarray, np.ndarray, list]:
    """The items' fingerprints as an index: sorted hashes, where each one's classes begin, and the classes.

    A class is (kind, context, its (item, place)s).
    """
    found: dict[tuple, list] = {}
    for h, kind, item, at in zip(prints["h"].tolist(), prints["kind"].tolist(), prints[item_key].tolist(), prints["at"].tolist()):
        found.setdefault((h, kind, _context(units_of[item], at, kind)), []).append((item, at))
    rows = sorted(found.items(), key=lambda x: x[0][:2])
    hs, first = np.unique(np.array([k[0] for k, _ in rows], np.int64), return_index=True)
    return hs, np.append(first, len(rows)), [(k[1], k[2], places) for k, places in rows]


def _mapped(docs: DataFrame, items: DataFrame, test: DataFrame, doc_key: str, item_key: str, schema: T.StructType, all_letters: bool) -> DataFrame:
    prints = test.toPandas()
    known = items.join(test.select(item_key).distinct(), item_key, "left_semi").toPandas()
    units_of = {x: codes(words(t), _kind(lang)) for x, t, lang in zip(known[item_key].tolist(), known["text"], known["lang"])}
    index = (*_classes(prints[prints[item_key].isin(units_of)], item_key, units_of), units_of)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hs, first, classes, units_of = shared.value
        for pdf in batches:
            out = []
            for key, text in zip(pdf[doc_key], pdf["text"]):
                units = words(text)
                for kind in _streams(text, all_letters):
                    code = codes(units, kind)
                    h, at = winnowed(code, kind)
                    if not len(h) or not len(hs):
                        continue
                    x = np.minimum(np.searchsorted(hs, h), len(hs) - 1)
                    places: dict = {}
                    for i in np.flatnonzero(hs[x] == h):
                        own = _context(code, int(at[i]), kind)
                        for other, context, members in classes[first[x[i]] : first[x[i] + 1]]:
                            if other == kind and _passes(own, context, kind):
                                for item, j in members:
                                    places.setdefault(item, []).append((int(at[i]), j))
                    out += [(key, item, longest(code, units_of[item], p, kind)) for item, p in places.items()]
            if out:
                yield pd.DataFrame(out, columns=schema.fieldNames())

    return docs.select(doc_key, "text").mapInPandas(run, schema)


def _joined(docs: DataFrame, items: DataFrame, test: DataFrame, doc_key: str, item_key: str, schema: T.StructType, all_letters: bool, least_hot: int = 200_000) -> DataFrame:
    key = ["kind", "h"]
    known = test.select(*key).distinct()
    train = written(_prints(docs, doc_key, None, all_letters), "train-prints")
    # Documents' rows of a fingerprint that very many have are spread over several tasks, the items' rows copied to each.
    counts = train.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).join(known, key, "left_semi")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    salt = F.lit(0)
    if total > least_hot:
        hot, limit = hot_keys(counts, "__n", total, least_hot)
        hot = F.broadcast(written(hot.select(*key, F.ceil(F.col("__n") / limit).cast("int").alias("__fan")), "hot-prints"))
        train, test = train.join(hot, key, "left"), test.join(hot, key, "left")
        salt = F.coalesce("__fan", F.lit(1))
        train = train.withColumn("__salt", F.pmod(F.xxhash64(doc_key, "at"), salt).cast("int"))
        test = test.withColumn("__salt", F.explode(F.sequence(F.lit(0), salt - 1)))
        key = [*key, "__salt"]
    hits = train.join(test.withColumnRenamed("at", "__jat"), key).groupBy(doc_key, item_key, "kind")
    hits = written(hits.agg(F.collect_set(F.struct("at", F.col("__jat").alias("j"))).alias("__places")), "hits")
    pairs = docs.select(doc_key, F.col("text").alias("__d")).join(hits, doc_key).join(items.select(item_key, F.col("text").alias("__i")), item_key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, item, kind, d, i, places in zip(pdf[doc_key], pdf[item_key], pdf["kind"], pdf["__d"], pdf["__i"], pdf["__places"]):
                n = longest(codes(words(d), kind), codes(words(i), kind), [(p["at"], p["j"]) for p in places], kind)
                if n >= sum(SIZES[kind]) - 1:
                    out.append((key, item, n))
            if out:
                yield pd.DataFrame(out, columns=schema.fieldNames())

    return pairs.select(doc_key, item_key, "kind", "__d", "__i", "__places").mapInPandas(run, schema)
