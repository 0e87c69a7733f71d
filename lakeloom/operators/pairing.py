"""Pairing the rows of two tables by their place in the files.

A row's place is (file, block of the file, row of the block); the blocks' rows are counted, and sums over files and over a file's blocks
give each row its number from 0. Nothing depends on how tasks are dealt. Only one row for each block of a file is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, name: str = "pos") -> DataFrame:
    """The rows of files of one kind ("parquet", or lines of "json" or "text") with their number, files in order of their paths."""
    reader = spark.read.schema(schema) if schema else spark.read
    got = reader.format(kind).load(path)
    if kind == "parquet":
        block, order = F.lit(0).cast("long"), F.col("_metadata.row_index")
    else:
        block, order = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    rows = got.select("*", F.col("_metadata.file_path").alias("_file"), block.alias("_block"), order.alias("_order"))
    # rows of a block are read one after the other, so they are numbered from the least number among them
    sizes = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_least"))
    files = sizes.groupBy("_file").agg(F.sum("_n").alias("_all"))
    before = files.select("_file", F.coalesce(F.sum("_all").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_files"))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", "_block", "_least", inside.alias("_inside")).join(before, "_file")
    number = (F.col("_files") + F.col("_inside") + F.col("_order") - F.col("_least")).cast("long")
    return rows.join(starts, ["_file", "_block"]).select(*[F.col(c) for c in got.columns], number.alias(name))


def pair_files(spark: SparkSession, baseline: str, other: str, kind: str = "parquet", response: str = "generated_response", schema: str | None = None) -> DataFrame:
    """(pos, the baseline's columns, <response>_other): the k-th row of one with the k-th of the other; different numbers of rows are an error."""
    a, b = numbered(spark, baseline, kind, schema), numbered(spark, other, kind, schema)
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows against {m}")
    return a.join(b.select("pos", F.col(response).alias(f"{response}_other")), "pos")
