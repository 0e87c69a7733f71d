"""Readers of the named Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a file for each core under which a table is dealt to all of them.
SMALL = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """(key, text) of a table. A row group is read by one task, so a table of one small file would be worked on by one core: it is dealt to all. Tables that have
    SMALL bytes for each core or more are left as they are read, and nothing is shuffled."""
    df = table(spark, sf_dir, name).select(key, "text")
    cores = spark.sparkContext.defaultParallelism
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return df.repartition(cores) if size < cores * SMALL else df
