"""Replies of models that are kept: asked for once, in batches, and found again after a failure.

A prompt's key is a hash of model, options and prompt, so equal prompts are one, in whatever table they stand. The store is a folder with a table for each
batch, which appears whole or not at all. Where a provider fails on a prompt, the others of its batch are kept and the failure is raised after it; asking again
asks only for what the store lacks. (Prompts that a lost executor was asking in that moment are asked again by Spark, as nobody heard the replies.)

Defined cases: null systems and prompts are empty texts; rows that repeat, or that ask the same, share a reply; an empty table asks nothing; columns of any name may be there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .instruct import Options

STORED = "key string, raw string"


class ProviderError(RuntimeError):
    """Prompts that a provider failed on; the replies to the others are stored."""


class ReplyStore:
    def __init__(self, spark: SparkSession, path: str, model: str, options: Options | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.salt = json.dumps([model, (options or Options()).to_dict()], sort_keys=True)

    def key(self, system: str, prompt: str):
        """The key of a row's prompt, with the texts' lengths so that no two (system, prompt) run together."""
        one = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
        return F.sha2(F.concat(F.lit(self.salt), *[one(F.coalesce(F.col(c), F.lit(""))) for c in (system, prompt)]), 256)

    def _read(self, kind: str, schema: str) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{kind}/*")

    def replies(self) -> DataFrame:
        return self._read("replies", STORED)

    def fill(self, df: DataFrame, make: Callable[[int], Callable[[str, str], str]], system: str = "system", prompt: str = "prompt", endpoints: int = 1, workers: int = 1, batch: int = 100_000) -> int:
        """Asks for what the store lacks, about `batch` prompts in a job; gives the number of prompts asked. make is that of call_provider()."""
        asked = df.select(self.key(system, prompt).alias("key"), F.coalesce(system, F.lit("")).alias("system"), F.coalesce(prompt, F.lit("")).alias("prompt")).groupBy("key").agg(F.min("system").alias("system"), F.min("prompt").alias("prompt"))
        run = uuid.uuid4().hex
        asked.join(self.replies().select("key"), "key", "left_anti").withColumn("number", F.pmod(F.xxhash64("key"), F.lit(1 << 20))).write.parquet(f"{self.path}/asked/{run}")
        todo = self.spark.read.schema("key string, system string, prompt string, number long").parquet(f"{self.path}/asked/{run}")
        n = todo.count()
        parts = max(1, -(-n // batch))

        def ask(batches):
            called = {}
            for b in batches:
                rows = []
                for key, s, p, number in zip(*(b.column(c).to_pylist() for c in ("key", "system", "prompt", "number")), strict=True):
                    at = number % endpoints
                    if at not in called:
                        called[at] = make(at)
                    try:
                        rows.append((key, called[at](s, p), None))
                    except Exception as e:  # noqa: BLE001  told below, after the batch is kept
                        rows.append((key, None, f"{type(e).__name__}: {e}"[:500]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["key", "raw", "error"])

        for k in range(parts if n else 0):
            own = todo.where(F.col("number") % parts == k).repartition(endpoints * workers, "number")
            own.mapInArrow(ask, "key string, raw string, error string").write.parquet(f"{self.path}/answers/{run}-{k}")
            got = self.spark.read.schema("key string, raw string, error string").parquet(f"{self.path}/answers/{run}-{k}")
            got.where("error IS NULL").select("key", "raw").write.parquet(f"{self.path}/replies/{run}-{k}")
            failed = got.where("error IS NOT NULL")
            first = failed.select("error").first()
            if first is not None:
                raise ProviderError(f"{failed.count()} prompts failed, for one: {first['error']}")
        return n

    def answered(self, df: DataFrame, system: str = "system", prompt: str = "prompt") -> DataFrame:
        """df with `raw`, null where the store has no reply."""
        own = self.replies().groupBy(F.col("key").alias("_key")).agg(F.min("raw").alias("raw"))
        return df.withColumn("_key", self.key(system, prompt)).join(own, "_key", "left").drop("_key")
