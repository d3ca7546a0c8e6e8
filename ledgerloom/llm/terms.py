"""Frequency of every distinct term, kept by incremental signed deltas.

A change feed holds records with a sign: +1 for an added record, -1 for a deleted one, both for a changed
one. Only the feed is aggregated, to signed changes of occurrences and record counts per term; the changes
are merged into persistent counts that are partitioned by a hash of the term. Merging adds and drops what
falls to zero. It reads and writes only the partitions that a change falls into; the others are carried over
by reference: a version is a list of partition folders, each in the version that last wrote it.

A null or empty term is no term; an empty feed changes nothing. Terms are found per record first (so a
record counts once per term), then pre-aggregated before the shuffle, which no frequent term can skew.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.runtime import plain, remove, temporary, written

#: The field under which the number of records is counted; it can be no field's name.
RECORDS = ""


def pieces(c: str) -> Column:
    """Plain forms of the parts between comma, semicolon and vertical bar."""
    return F.transform(F.split(F.col(c), "[,;|]"), lambda p: F.lower(F.trim(p)))


def whole(c: str) -> Column:
    """The plain form of the value as the only term."""
    return F.array(plain(c))


def signed(added: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """A change feed of added and deleted records (a changed record is in both), with a column ``_sign``."""
    feed = added.withColumn("_sign", F.lit(1))
    return feed if deleted is None else feed.unionByName(deleted.withColumn("_sign", F.lit(-1)))


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The change feed that leads from ``old`` to ``new``: records equal in both are left out. Repeated rows count once.

    For sources that keep snapshots only; a source that tells its changes needs no such comparison of whole snapshots.
    """
    both = old.distinct().withColumn("_sign", F.lit(-1)).unionByName(new.distinct().withColumn("_sign", F.lit(1)))
    same = [c for c in both.columns if c != "_sign"]
    return both.groupBy(*same).agg(F.sum("_sign").cast("int").alias("_sign")).where(F.col("_sign") != 0).where(F.col(key).isNotNull())


def _counted(name: str, terms: Column) -> Column:
    """An array of (field, term, occ): the distinct terms of one record and how often it has them."""
    kept = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    occ = lambda t: F.size(F.filter(kept, lambda p: p == t)).cast("bigint")
    return F.transform(F.array_distinct(kept), lambda t: F.struct(F.lit(name).alias("field"), t.alias("term"), occ(t).alias("occ")))


def delta(feed: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """(field, term, d_occ, d_rec): signed changes of a feed; ``fields`` give each field's array of terms."""
    found = [_counted(name, terms) for name, terms in fields.items()]
    found.append(F.array(F.struct(F.lit(RECORDS).alias("field"), F.lit("").alias("term"), F.lit(1).cast("bigint").alias("occ"))))
    rows = feed.select("_sign", F.inline(F.concat(*found)))
    return rows.groupBy("field", "term").agg(F.sum(F.col("_sign") * F.col("occ")).alias("d_occ"), F.sum(F.col("_sign").cast("bigint")).alias("d_rec"))


class TermCounts:
    """Persistent counts (field, term, n_occ, n_rec) in hash partitions, one Parquet folder per partition and version.

    The number of partitions follows from the size of the first feed (``per_bucket`` terms in each) and stays
    until a feed is four times as large as all of them.
    The list of a version's folders is a table itself, so a later process opens the newest by ``path`` alone.
    Folders that no version but older ones than the last refer to are removed.
    """

    SCHEMA = "field string, term string, n_occ bigint, n_rec bigint"

    def __init__(self, spark: SparkSession, path: str | None = None, per_bucket: int = 1_000_000) -> None:
        self.spark, self.per_bucket = spark, per_bucket
        self.path, self.version, self.buckets = path or temporary(spark, "terms"), 0, 0
        self.folders: dict[int, int] = {}  # by partition the version that wrote it
        if path is not None:
            self._open()

    def _open(self) -> None:
        try:
            rows = self.spark.read.parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return
            raise
        last = rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == last).collect()  # one row a partition
        self.version, self.buckets = last, found[0]["buckets"]
        self.folders = {r["bucket"]: r["written"] for r in found if r["bucket"] >= 0}

    def _read(self, buckets: list[int]) -> DataFrame:
        if not buckets:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.path}/v{self.folders[b]}/bucket={b}" for b in sorted(buckets)])

    def table(self) -> DataFrame:
        return self._read(list(self.folders))

    def apply(self, changed: DataFrame) -> TermCounts:
        """Merge signed changes into the counts and write the next version: the partitions they touch."""
        changed = written(changed.select("field", "term", F.col("d_occ").alias("n_occ"), F.col("d_rec").alias("n_rec")).where("n_occ <> 0 or n_rec <> 0"), "delta")
        n = changed.count()
        if not n:
            return self
        grown = n > 4 * self.buckets * self.per_bucket
        if grown:  # the first feed, or one that outgrows the partitions: all are written anew, in a fitting number
            kept = self.table()
            self.buckets = -(-(n + kept.count()) // self.per_bucket)
        bucket = F.pmod(F.xxhash64("field", "term"), F.lit(self.buckets)).cast("int")
        touched = list(range(self.buckets)) if grown else [r[0] for r in changed.select(bucket.alias("bucket")).distinct().collect()]  # at most one row a partition
        old = kept if grown else self._read([b for b in touched if b in self.folders])
        merged = old.unionByName(changed).groupBy("field", "term").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_rec").alias("n_rec"))
        merged = merged.where("n_occ <> 0 or n_rec <> 0").withColumn("bucket", bucket)
        self.version += 1
        out = f"{self.path}/v{self.version}"
        merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        # A partition whose terms all fell to zero has no folder.
        full = [r[0] for r in self.spark.read.schema(self.SCHEMA + ", bucket int").parquet(out).select("bucket").distinct().collect()]
        before = set(self.folders.values())
        self.folders = {b: v for b, v in self.folders.items() if not grown and b not in set(touched)} | {b: self.version for b in full}
        rows = [(self.version, self.buckets, b, v) for b, v in sorted(self.folders.items())] or [(self.version, self.buckets, -1, self.version)]
        self.spark.createDataFrame(rows, "version int, buckets int, bucket int, written int").coalesce(1).write.mode("append").parquet(f"{self.path}/versions")
        # What the version before the last referred to and this one does not goes with the next merge.
        remove(self.spark, *[f"{self.path}/v{v}" for v in self._gone])
        self._gone = sorted(before - set(self.folders.values()))
        return self

    _gone: list[int] = []

    def n_records(self) -> int:
        row = self.table().where(F.col("field") == RECORDS).agg(F.sum("n_rec")).first()
        return row[0] or 0

    def marked(self, rare_below: int = 5, common_share: tuple[int, int] = (1, 20)) -> DataFrame:
        """(field, term, n_occ, n_rec, mark): rare under ``rare_below`` records, else common beyond a share of all."""
        n, (a, b) = self.n_records(), common_share
        mark = F.when(F.col("n_rec") < rare_below, "rare").when(F.col("n_rec") * b > a * n, "common").otherwise("ok")
        return self.table().where(F.col("field") != RECORDS).select("field", "term", "n_occ", "n_rec", mark.alias("mark"))
