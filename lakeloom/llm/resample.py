"""Importance resampling towards a target distribution, over hashed word n-grams.

A streaming ring of CRC states makes the features: one scan of a text keeps the running CRC-32 of the runs that begin at the last n words,
extends each by a blank and the next word, and emits the bucket of each state. So every run of 1 to n words is hashed once without being put
together. A document's log-weight is the sum of its buckets' gains, the log-ratios of how often the target and the raw documents have the
bucket; documents are drawn by Gumbel noise on top of it, which is drawing without replacement in proportion to the weights.

A task tells Spark one number for each bucket (a fixed count), scores are made by a second pass over the written buckets of each document (two bytes a
feature), and ranks come from one range sort whose partitions are counted, so nothing but the gains reaches the driver.

Defined cases: a null text has no words; a document without words has weight 0; a null id is hashed as an empty text and comes before others on ties;
rows that repeat are ranked each; other columns are ignored; an empty table gives an empty result, an empty target gives gains for no counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spill
from . import textkit as K

#: Every byte that is in no word becomes a blank, and A-Z become a-z.
_WORDS_ONLY = bytes(K.LOWER[b] if K.ALNUM_WORD[K.LOWER[b]] else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS_ONLY).split()


def ring(found: list[bytes], n: int, buckets: int) -> Iterator[int]:
    """The bucket of every run of 1 to n consecutive words, in order of the run's last word."""
    crc = zlib.crc32
    if n == 1:
        for w in found:
            yield crc(w) % buckets
        return
    states: list[int] = []  # of the runs that begin at the last words, the oldest first
    for w in found:
        longer = b" " + w
        states = [crc(longer, s) for s in states[-(n - 1) :]]
        states.append(crc(w))
        for s in states:
            yield s % buckets


def features(docs: DataFrame, id_column: str, n: int, buckets: int, text: str = "text") -> DataFrame:
    """(id, n_words, buckets as 32-bit integers laid end to end, 16-bit ones where they suffice)."""
    code = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for b in K.slices(batches):
            sizes, blobs = [], []
            for t in K.each_bytes(b.column("text")):
                found = words(t)
                sizes.append(len(found))
                blobs.append(np.fromiter(ring(found, n, buckets), code).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "n_words", "hashed"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n_words long, hashed binary")


def bucket_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of features(); a task sends at most one row for each bucket."""
    code = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column("hashed"):
                total += np.bincount(np.frombuffer(x.as_buffer(), code), minlength=buckets) if len(x.as_buffer()) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return rows.select("hashed").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket: `buckets` numbers on the driver."""
    spark = raw.sparkSession
    sums = raw.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("s_all")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("t_all")))
    each = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").crossJoin(F.broadcast(sums))
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * (F.col("s_all") + buckets) / ((s + 1) * (F.col("t_all") + buckets))
    out = np.zeros(buckets, np.int64)
    for r in each.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def ranked(rows: DataFrame, score: str, key: str) -> DataFrame:
    """rows (written before) with rank: 1 for the highest score, ties to the smaller key. One range sort; only the partitions' sizes meet in one task."""
    ordered = rows.repartitionByRange(F.desc(score), F.asc_nulls_first(key)).sortWithinPartitions(F.desc(score), F.asc_nulls_first(key))
    placed = spill.write(ordered.withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", (F.col("_before") + place + 1).cast("long")).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", id_column: str = "doc_id", target_id: str = "item_id") -> DataFrame:
    """One row for each row of docs: its id, n_features, weight, score, and rank if it is among the `percent` per cent drawn of the documents with at
    least `least_words` words."""
    rows = spill.write(features(docs, id_column, n, buckets), "resample-features")
    gain = gains(spill.write(bucket_counts(rows, buckets), "resample-raw"), spill.write(bucket_counts(features(target, target_id, n, buckets), buckets), "resample-target"), buckets)
    code = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for b in batches:
            sizes, weights = [], []
            for x in b.column("hashed"):
                own = np.frombuffer(x.as_buffer(), code)
                sizes.append(len(own))
                weights.append(int(gain[own].sum()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_words"), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=["id", "n_words", "n_features", "weight"])

    weighed = rows.mapInArrow(run, "id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")
    scored = spill.write(weighed.withColumn("score", F.col("weight") + noise), "resample-scores")
    fit = scored.where(F.col("n_words") >= least_words)
    draw = percent * fit.count() // 100
    placed = ranked(fit, "score", "id").withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    out = placed.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")


def op13_resample(spark, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
