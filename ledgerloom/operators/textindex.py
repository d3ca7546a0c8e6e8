"""An inverted index as DataFrames and BM25 ranking over it.

``postings(term, key, tf, n_tokens)`` hold for each term and text its occurrences and the text's length; a
text's own row has the empty term, so one table is the whole index and texts are tokenised once. ``stored``
keeps it as Parquet, partitioned by a hash of the term and sorted by term, and finds it again while the
source files are the same: a query then reads the partitions of its terms only. Matching is a conjunction of
words; upper-case OR and NOT and ``word*`` are understood, and over an index with positions ``a + b`` (in this
order, side by side), ``^a`` (first in the text) and ``NEAR(a b, n)`` (at most n words between the outer two).
Scores are positive, statistics are those of the whole index whatever filters apply, and ties are ordered by
key.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as txt
from ledgerloom.runtime import exists, parallelism, work_dir, written

K1, B, FLOOR = 1.2, 0.75, 1e-6
POOL = 50


@dataclass
class Query:
    """Alternatives of words that must all occur; ``no`` must not; words ending in ``*`` are prefixes.

    A word with blanks is a phrase, one that begins with ``^`` must be the first. ``near`` holds groups of
    words with the most words between them; they restrict all matches, scores count all occurrences.
    """

    any_of: list[list[str]] = field(default_factory=list)
    no: list[str] = field(default_factory=list)
    near: list[tuple[list[str], int]] = field(default_factory=list)

    def positional(self) -> bool:
        return bool(self.near) or any(" " in w or w.startswith("^") for w in [*self.words(), *self.no])

    def words(self) -> list[str]:
        return sorted({w for group in self.any_of for w in group})


def sanitised(raw: str) -> str:
    """Blanks joined and quotation marks deleted."""
    return " ".join(raw.split()).replace("'", "").replace('"', "")


def parsed_query(raw: str, stem: bool = False, strict: bool = False) -> Query | None:
    """The query, or None if it matches nothing: empty, or in strict mode with marks that are no words."""
    s = sanitised(raw)
    if strict and re.search(r"[?.,/(){}@:\-+^~;!&|\\\[\]<>=%$#]|^\*|\s\*", s):
        return None
    q, group, negate, joined = Query(), [], False, False

    def close(m: re.Match) -> str:
        found = [w for x in m[1].split() for w in words_of(x)]
        q.near.append((found, int(m[2] or 10)))
        return " ".join(m[1].split())

    def words_of(token: str) -> list[str]:
        found = txt._WORD.findall(txt.folded(token) if stem else token.lower())
        return [txt.stemmed(w) if stem else w for w in found]

    s = re.sub(r"\bNEAR\s*\(([^(),]*)(?:,\s*(\d+)\s*)?\)", close, s)
    for token in re.sub(r"\s*\+\s*", " + ", s).split():
        if token == "+":
            joined = bool(group)
        elif token == "OR":
            q.any_of, group = q.any_of + [group], []
        elif token == "AND":
            continue
        elif token == "NOT":
            negate = True
        else:
            star = "*" if token.endswith("*") and len(token) > 1 else ""
            found = txt._WORD.findall(txt.folded(token) if stem else token.lower())
            found = [txt.stemmed(w) if stem and not star else w for w in found]
            found = [w + (star if i == len(found) - 1 else "") for i, w in enumerate(found)]
            found = ["^" + found[0], *found[1:]] if token.startswith("^") and found else found
            if joined and found and not negate:
                group[-1], found, joined = f"{group[-1]} {found[0]}", found[1:], False
            if negate:
                q.no, negate = q.no + found, False
            else:
                group += found
    q.any_of = [g for g in q.any_of + [group] if g]
    return q if q.any_of else None


class TextIndex:
    """Build with ``of`` or ``stored``; ``bm25`` ranks, ``matching`` only selects."""

    def __init__(self, postings: DataFrame, key: str, stem: bool = False) -> None:
        self.postings, self.key, self.stem = postings, key, stem
        self._stats: tuple[int, float] | None = None

    @classmethod
    def of(cls, docs: DataFrame, key: str, text: str, stem: bool = False, positions: bool = False) -> TextIndex:
        """An index of ``text``; with ``positions`` postings also have ``at``, a term's places in the text from 0."""
        words = txt.stemmed_tokens(F.col(text)) if stem else txt.tokens(F.col(text))
        listed = docs.select(key, words.alias("words")).withColumn("n_tokens", F.size("words").cast("bigint"))
        # The text's own row comes first, with the empty term.
        placed = listed.select(key, "n_tokens", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("i", "term")).groupBy("term", key, "n_tokens")
        found = [F.count(F.lit(1)).alias("tf")] + ([F.array_sort(F.collect_list(F.col("i") - 1)).alias("at")] if positions else [])
        return cls(placed.agg(*found), key, stem)

    @classmethod
    def stored(cls, docs: DataFrame, key: str, text: str, stem: bool = False, positions: bool = False) -> TextIndex:
        """The index of ``docs``, kept in the shared folder for as long as their files and the query over them are the same."""
        spark = docs.sparkSession
        name = f"textindex-{_identity(docs, key, text, stem, positions)}"
        path = f"{work_dir(spark)}/{name}"
        index = cls.of(docs, key, text, stem, positions)
        if not exists(spark, f"{path}/_SUCCESS"):
            index.save(path)
        return cls(spark.read.schema(f"{_ddl(index.postings)}, buckets int, bucket int").parquet(path), key, stem)

    def save(self, path: str, buckets: int | None = None) -> None:
        n = buckets or parallelism(self.postings.sparkSession)
        rows = self.postings.withColumn("bucket", _bucket(F.col("term"), n)).repartition(n, "bucket").sortWithinPartitions("bucket", "term")
        rows.withColumn("buckets", F.lit(n)).write.mode("overwrite").partitionBy("buckets", "bucket").parquet(path)

    def _pruned(self, terms: list[str]) -> DataFrame:
        """Postings of the partitions that hold the given terms; all if one of them is a prefix or there are no partitions."""
        if "bucket" not in self.postings.columns or any(t.endswith("*") and len(t) > 1 for t in terms):
            return self.postings
        if self._buckets is None:
            row = self.postings.select("buckets").first()
            self._buckets = row[0] if row else 1
        wanted = F.lit(False)
        for t in terms:
            wanted = wanted | (F.col("bucket") == _bucket(F.lit(t), self._buckets))
        return self.postings.where(wanted)

    _buckets: int | None = None

    def documents(self) -> DataFrame:
        """(key, n_tokens) of every text."""
        return self._pruned([""]).where(F.col("term") == "").select(self.key, "n_tokens")

    def corpus(self) -> DataFrame:
        return self.documents().agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n_tokens").alias("avgdl"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))

    def stats(self) -> tuple[int, float]:
        if self._stats is None:
            r = self.corpus().first()
            self._stats = (r["n_docs"], float(r["avgdl"] or 0.0))
        return self._stats

    def terms(self) -> DataFrame:
        """Per term the number of documents and of occurrences."""
        return self.postings.where(F.col("term") != "").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))

    def _of(self, word: str) -> Column:
        return F.col("term").startswith(word[:-1]) if word.endswith("*") else F.col("term") == word

    def _hits(self, words: list[str]) -> DataFrame:
        """(word, key, tf, n_tokens) of the query's words; a prefix counts all its terms as one, a phrase its occurrences."""
        if any(" " in w or w.startswith("^") for w in words):
            return self._placed(words)
        cond = self._of(words[0])
        for w in words[1:]:
            cond = cond | self._of(w)
        which = F.array_compact(F.array(*[F.when(self._of(w), F.lit(w)) for w in words]))
        found = self._pruned(words).where(cond & (F.col("term") != "")).select(F.explode(which).alias("word"), self.key, "tf", "n_tokens")
        return found.groupBy("word", self.key).agg(F.sum("tf").alias("tf"), F.first("n_tokens").alias("n_tokens"))

    def _places(self, terms: list[str]) -> DataFrame:
        """(key, n_tokens, m): of each text a map from the given terms to their places."""
        if "at" not in self.postings.columns:
            raise ValueError("phrases, NEAR and ^ need an index with positions")
        cond = self._of(terms[0])
        for w in terms[1:]:
            cond = cond | self._of(w)
        which = F.array_compact(F.array(*[F.when(self._of(w), F.lit(w)) for w in terms]))
        one = self._pruned(terms).where(cond & (F.col("term") != "")).select(F.explode(which).alias("w"), self.key, "at", "n_tokens").groupBy(self.key, "n_tokens", "w").agg(F.flatten(F.collect_list("at")).alias("at"))
        return one.groupBy(self.key, "n_tokens").agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("m"))

    def _placed(self, words: list[str]) -> DataFrame:
        """Hits by positions: of each text only the places of the query's terms are brought together."""

        def starts(word: str) -> Column:
            """Places at which the word or phrase begins."""
            found = None
            for k, p in enumerate(word.lstrip("^").split()):
                here = F.transform(_at(p), _minus(k))
                found = here if found is None else F.array_intersect(found, here)
            return F.filter(found, lambda x: x == 0) if word.startswith("^") else found

        rows = self._places(sorted({p for w in words for p in w.lstrip("^").split()}))
        counted = F.array(*[F.struct(F.lit(w).alias("word"), F.size(starts(w)).cast("bigint").alias("tf")) for w in words])
        return rows.select(self.key, "n_tokens", F.explode(counted).alias("x")).select("x.word", self.key, "x.tf", "n_tokens").where("tf > 0")

    def _close(self, words: list[str], most: int) -> DataFrame:
        """Keys of texts that have all words with at most ``most`` others between the outer two."""
        places = [_at(w) for w in words]
        return self._places(sorted(set(words))).where(F.exists(F.flatten(F.array(*places)), _clump(places, most))).select(self.key)

    def matching(self, q: Query, hits: DataFrame | None = None) -> DataFrame:
        """Keys that satisfy the query, with the hits of its words."""
        hits = self._hits(q.words()) if hits is None else hits
        have = F.collect_set("word")
        ok = None
        for group in q.any_of:
            need = F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in sorted(set(group))]))) == len(set(group))
            ok = need if ok is None else ok | need
        keys = hits.groupBy(self.key).agg(ok.alias("ok")).where("ok").select(self.key)
        for words, most in q.near:
            keys = keys.join(self._close(words, most), self.key, "left_semi")
        if q.no:
            keys = keys.join(self._hits(q.no).select(self.key), self.key, "left_anti")
        return hits.join(keys, self.key, "left_semi")

    def bm25(self, raw: str, strict: bool = False) -> DataFrame:
        """(key, score) of all matches; an unusable query matches nothing."""
        q = parsed_query(raw, self.stem, strict)
        if q is None:
            return self.postings.select(self.key, F.lit(0.0).alias("score")).where(F.lit(False))
        n, avgdl = self.stats()
        # The query's own postings are few and used three times.
        hits = written(self._hits(q.words()), "hits")
        df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # one row per word of the query
        raw_idf = F.log((F.lit(float(n)) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
        idf = F.when(raw_idf <= 0, F.lit(FLOOR)).otherwise(raw_idf)
        tf = F.col("tf").cast("double")
        weight = idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n_tokens") / F.lit(avgdl)))
        found = self.matching(q, hits).join(F.broadcast(df), "word")
        return found.groupBy(self.key).agg(F.sum(weight).alias("score"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _bucket(term: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def _identity(docs: DataFrame, *options) -> str:
    """A name for an index: the files under ``docs`` with sizes and times, the query over them, and the options."""
    spark = docs.sparkSession
    parts = [str(options), docs._jdf.queryExecution().optimizedPlan().canonicalized().toString()]
    for name in sorted(docs.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        st = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        parts.append(f"{name} {st.getLen()} {st.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


def _at(w: str) -> Column:
    return F.coalesce(F.try_element_at("m", F.lit(w)), F.array().cast("array<int>"))


def _minus(k: int):
    return lambda x: x - k


def _clump(places: list[Column], most: int):
    """Whether each word has a place from the given one on, with at most ``most`` words between first and last."""

    def holds(p: Column) -> Column:
        ok = F.lit(True)
        for a in places:
            ok = ok & F.exists(a, lambda x: (x >= p) & (x <= p + most + 1))
        return ok

    return holds


def top(scored: DataFrame, key: str, n: int = POOL) -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(n)
