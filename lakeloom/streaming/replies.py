"""Streams of replies: JSON lines are put together to whole texts as files arrive, and routed once.

A reply is streamed as lines (key, seq, message.content, done), in any order and over any number of files; the line that is done says with its seq how many
there are. A reply is given out once, when all its lines are there. Routes are folders with a folder for each batch, so a batch that is
repeated after a failure overwrites its own rows, and offsets in the checkpoint keep other files from being read again.

Defined cases: lines that are no JSON or lack a key or a seq add nothing; lines that repeat are one line; a reply without its done line, or with a gap, waits; contents that are null are empty.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LINE = "key string, seq long, done boolean, message struct<content: string>"


def read_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(key, seq, done, content) of a folder's files of JSON lines, as a stream with offsets."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    got = text.select(F.from_json("value", LINE).alias("x")).select("x.key", "x.seq", F.coalesce("x.done", F.lit(False)).alias("done"), F.coalesce("x.message.content", F.lit("")).alias("content"))
    return got.where("key IS NOT NULL AND seq >= 0")


def assembled(lines: DataFrame) -> DataFrame:
    """(key, raw): each reply once, when it is whole. The state of a key is what has come of its reply, and then that it is given out."""

    def run(key, frames, state):
        parts, total = {}, None
        if state.exists:
            held, total, over = state.get
            total = None if total < 0 else total
            parts = {int(k): v for k, v in json.loads(held).items()}
        else:
            over = False
        for pdf in frames:
            for seq, done, content in zip(pdf["seq"], pdf["done"], pdf["content"], strict=True):
                parts[int(seq)] = content
                if done:
                    total = int(seq) + 1
        if not over and total is not None and all(i in parts for i in range(total)):
            yield pd.DataFrame({"key": [key[0]], "raw": ["".join(parts[i] for i in range(total))]})
            over = True
        state.update(("{}" if over else json.dumps(parts), -1 if total is None else total, over))

    return lines.groupBy("key").applyInPandasWithState(run, "key string, raw string", "parts string, total long, over boolean", "append", "NoTimeout")


def write_routes(rows: DataFrame, routed, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of a stream in two routes, <path>/success and <path>/failed. routed(batch) adds `status`; what it gives is written once and then read for both."""

    def put(batch: DataFrame, number: int) -> None:
        whole = f"{path}/whole/batch={number}"
        routed(batch).write.mode("overwrite").parquet(whole)
        kept = batch.sparkSession.read.parquet(whole)
        for kind in ("success", "failed"):
            kept.where(F.col("status") == kind).drop("status").write.mode("overwrite").json(f"{path}/{kind}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
