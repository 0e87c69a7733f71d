"""Queries on streams and token files, run to completion as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import instruct as I
from lakeloom.sources.tables import table
from lakeloom.streaming import encode as S
from lakeloom.streaming import replies as R

from .base import query, scratch
from .text_queries import _GPT4
from .token_queries import _IDS, _hex, _merged, small_bpe, token_sums


_MERGED_IDS = f"""j AS (SELECT doc_id, {_merged(f"array_to_string(list_transform({_GPT4}, lambda c: {_hex('c')}), '|')")} AS s FROM documents), t AS (SELECT doc_id, {_IDS} AS ids FROM j)"""


@query("stream_encode", f"WITH {_MERGED_IDS} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(ids, lambda x, i: x * (i % 1000))) AS BIGINT) AS checksum FROM t")
def stream_encode(spark, sf_dir):
    """Documents encoded by a stream that runs until all files are read."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "stream")
    docs.write.parquet(f"{folder}/in")
    stream = S.read_documents(spark, f"{folder}/in", docs.schema)
    S.write_encoded(stream, small_bpe(), f"{folder}/out", f"{folder}/state").awaitTermination()
    return token_sums(spark.read.parquet(f"{folder}/out"), "token_ids", "doc_id")


@query(
    "stream_windows",
    """WITH e AS (SELECT *, event_id % 2 AS half FROM events), seen AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e WHERE half = 0)
    SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM e, seen WHERE half = 0 OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY ALL""",
)
def stream_windows(spark, sf_dir):
    """Events in two files that come one after the other: those of the second whose windows had closed by the watermark are left out."""
    folder = scratch(spark, "windows")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).coalesce(1).write.parquet(f"{folder}/{half}")
        source = spark.readStream.schema(events.schema).parquet(f"{folder}/[01]")
        S.write_windows(S.windowed_counts(source, "ts", "event_type"), f"{folder}/out", f"{folder}/state").awaitTermination()
    got = S.read_windows(spark, f"{folder}/out")
    return got.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


@query("event_windows", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """The window plan of the stream on a finished table."""
    got = S.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return got.select("event_type", F.col("window.start").alias("hour"), "n")


@query(
    "reply_stream",
    """WITH a AS (SELECT *, length(text) AS n FROM conversations WHERE role = 'assistant')
    SELECT CASE WHEN conv_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status, conv_id || ':' || turn AS key, sha256(CASE WHEN conv_id % 3 = 0 THEN text ELSE regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') END) AS sha256 FROM a""",
)
def reply_stream(spark, sf_dir):
    """Assistant turns as streamed lines of 40 characters in several files, which come in two halves: the stream is stopped in between and goes on
    from its offsets and its state. Whole replies are routed by whether they hold a better answer."""
    folder = scratch(spark, "reply-stream")
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    text = F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("[New Instruction] x [End] [New Answer] "), F.col("text"), F.lit(" [End]")))
    n = F.floor((F.length("text") + 39) / 40).cast("long")
    parts = turns.select(F.concat_ws(":", "conv_id", "turn").alias("key"), text.alias("text")).select("key", "text", n.alias("n"))
    lines = parts.select("key", "n", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)))).alias("seq"))
    said = F.struct(F.col("text").substr((F.col("seq") * 40 + 1).cast("int"), F.lit(40)).alias("content"))
    lines = lines.select(F.to_json(F.struct("key", "seq", (F.col("seq") >= F.col("n") - 1).alias("done"), said.alias("message"))).alias("value"), F.pmod(F.xxhash64("key", "seq"), F.lit(2)).alias("half"))

    def routed(batch):
        rows = batch.select("key", "raw", F.lit("").alias("instruction"), F.lit("").alias("input"), F.col("raw").alias("output"))
        return I.reflected(rows).select("key", "output", "status")

    for half in (0, 1):
        lines.where(F.col("half") == half).select("value").write.mode("append").text(f"{folder}/in")
        R.write_routes(R.assembled(R.read_lines(spark, f"{folder}/in")), routed, f"{folder}/out", f"{folder}/state").awaitTermination()
    got = [spark.read.schema("key string, output string").json(f"{folder}/out/{kind}").select(F.lit(kind).alias("status"), "key", F.sha2("output", 256).alias("sha256")) for kind in ("success", "failed")]
    return got[0].unionByName(got[1])
