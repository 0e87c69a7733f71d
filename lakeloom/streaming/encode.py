"""Streams: new documents are encoded as they arrive, and counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators.bpe import Bpe, encode_cached


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def encoded(stream: DataFrame, bpe: Bpe, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The batch plan on a stream: stateless, so results are the same."""
    return stream.select(key, encode_cached(F.col(text), bpe).alias("token_ids"))


def write_encoded(stream: DataFrame, bpe: Bpe, path: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Exactly-once Parquet output of all files that are there now."""
    return encoded(stream, bpe, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by key and event-time window; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def write_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Changed windows of each batch, in update mode, as Parquet by batch; a batch that is repeated after a failure overwrites its own."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return counts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def read_windows(spark: SparkSession, path: str, key: str = "event_type") -> DataFrame:
    """The last state of each window that write_windows() has written."""
    rows = spark.read.parquet(path)
    return rows.groupBy("window", key).agg(F.max_by("n", "batch").alias("n"))
