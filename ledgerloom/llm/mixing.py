"""Mixing sources to target weights by a time-varying curriculum.

Each source has a schedule: weights at knots of the training time 0..1, linear between them. The schedule
is integrated to a cumulative token demand and scaled to the source's share of the mix. A source's
documents, in a hashed order and repeated as often as needed but at most ``max_repeats`` times, take up
that demand; inverting the integral at the tokens before a document gives its training position. The mix
is range-sorted by position.

Sources are compared trimmed and lower-cased. Documents of sources without a target are not in the mix but
count for its size. A source that has not enough tokens gives all it may and is marked ``short``. A text
that is null has no tokens; repeated rows of a document count once. Sources may hold any part of the rows:
cumulative tokens come from sums per block of the hashed order, so no task gets a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.runtime import MOST_HOT, plain, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern by which the tokenizer's vocabulary was built.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PER_BLOCK = 50_000
FLAT = ((0.0, 1.0), (1.0, 1.0))


def token_counts(docs: DataFrame, keys: Sequence[str], text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``keys`` and ``n_tokens`` of whole texts by a public byte-level tokenizer file of ranks.

    The file is read here and sent to the executors (below a megabyte), which need not have it.
    """
    with open(tokenizer, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.value.splitlines())}
        enc = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["__text"]]
            if n:
                yield pdf[list(keys)].assign(n_tokens=n)

    return docs.select(*keys, F.col(text).alias("__text")).mapInPandas(run, schema)


def _segments(targets: Sequence[tuple], schedules: Mapping[str, Sequence[tuple[float, float]]]) -> list[tuple]:
    """(source, share before and after, t0, t1, w0, w1) of each linear piece of the integrated, normalised schedules."""
    out = []
    for (source,) in targets:
        knots = [(float(t), float(w)) for t, w in schedules.get(source, FLAT)]
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, upto = sum(areas), 0.0
        for (a, b), area in zip(zip(knots, knots[1:]), areas):
            if area > 0:
                out.append((source, upto / total, (upto + area) / total, a[0], b[0], a[1] / total, b[1] / total))
            upto += area
    return out


class Mix:
    """The plan of a mix: ``counted`` documents, ``demand`` per source, ``placed`` copies, ``report``."""

    def __init__(self, docs: DataFrame, targets: DataFrame, schedules: Mapping[str, Sequence[tuple[float, float]]] | None = None, size: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER, measure: Column | None = None) -> None:
        spark = docs.sparkSession
        keyed = docs.select("doc_id", plain("source").alias("source"), "text")
        # Sizes are tokens, unless another measure of a text is given.
        sized = token_counts(keyed, ["doc_id", "source"], tokenizer=tokenizer) if measure is None else keyed.select("doc_id", "source", F.coalesce(measure, F.lit(0)).cast("bigint").alias("n_tokens"))
        self.counted = written(sized.distinct(), "tokens")
        per_source = self.counted.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs"))
        self.size = int(size if size is not None else self.counted.agg(F.sum("n_tokens")).first()[0] or 0)
        goals = targets.select(plain("source").alias("source"), "target_share", "max_repeats").where("source is not null").dropDuplicates(["source"])
        want = F.col("target_share") * F.lit(float(self.size))
        # One row per target, so small enough for any join.
        self.demand = written(
            goals.join(per_source, "source", "left").na.fill(0, ["supply", "n_docs"])
            .withColumn("want", want).withColumn("have", F.col("supply") * F.col("max_repeats"))
            .withColumn("take", F.least("want", F.col("have").cast("double")))
            .withColumn("copies", F.when(F.col("take") > 0, F.ceil(F.col("take") / F.col("supply"))).otherwise(0).cast("int")),
            "demand",
        )
        names = [tuple(r) for r in self.demand.select("source").collect()]
        # The plan of sources is broadcast while there are few of them.
        self.near = F.broadcast if len(names) <= MOST_HOT else (lambda d: d)
        pieces = _segments(names, {k.strip().lower(): v for k, v in (schedules or {}).items()})
        self.pieces = spark.createDataFrame(pieces, "source string, f0 double, f1 double, t0 double, t1 double, w0 double, w1 double")
        self.seed = seed

    def placed(self) -> DataFrame:
        """(position, doc_id, source, copy, n_tokens), range-sorted by position."""
        n = self.counted.count()
        blocks = max(1, n // PER_BLOCK)
        h = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.lit(str(self.seed)))), 1, 15), 16, 10).cast("bigint")  # below 2**60
        docs = self.counted.join(self.near(self.demand.where("copies > 0").select("source", "supply", "take", "copies")), "source")
        docs = docs.withColumn("h", h).withColumn("block", F.floor(F.shiftright("h", 28) / F.lit(2**32 // blocks + 1)).cast("int"))
        sums = docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("s"))
        before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("source", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
        inner = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        docs = docs.withColumn("within", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(sums, ["source", "block"])
        docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        docs = docs.withColumn("at", F.col("copy") * F.col("supply") + F.col("base") + F.col("within")).where(F.col("at") < F.col("take"))
        docs = docs.withColumn("f", F.col("at") / F.col("take"))
        pieces = self.near(self.pieces.withColumnRenamed("source", "__s"))
        docs = docs.join(pieces, (F.col("source") == F.col("__s")) & (F.col("f") >= F.col("f0")) & (F.col("f") < F.col("f1")))
        # Within a piece the demand is w0 x + (w1 - w0) x^2 / (2 d) for x = t - t0 of length d; solved for x.
        d, r = F.col("t1") - F.col("t0"), F.col("f") - F.col("f0")
        slope = (F.col("w1") - F.col("w0")) / d
        root = F.sqrt(F.greatest(F.lit(0.0), F.col("w0") * F.col("w0") + 2 * slope * r))
        position = F.col("t0") + F.least(d, F.when(r <= 0, 0.0).otherwise(2 * r / (F.col("w0") + root)))
        out = docs.select(position.alias("position"), "doc_id", "source", "copy", "n_tokens")
        return out.repartitionByRange("position").sortWithinPartitions("position", "doc_id", "copy")

    def report(self) -> DataFrame:
        """Per target source: shares wanted and placed, copies of the documents, and whether it falls short."""
        got = self.placed().groupBy("source").agg(F.sum("n_tokens").alias("placed_tokens"), F.count(F.lit(1)).alias("n_placed"))
        all_placed = F.sum("placed_tokens").over(Window.partitionBy(F.lit(0)))  # one row per target
        out = self.demand.join(got, "source", "left").na.fill(0, ["placed_tokens", "n_placed"])
        share = F.when(all_placed > 0, F.col("placed_tokens") / all_placed).otherwise(0.0)
        return out.select("source", "target_share", share.alias("actual_share"), F.col("supply").alias("source_tokens"), "placed_tokens", "n_placed", "copies", (F.col("placed_tokens") < F.col("want")).alias("short"))
