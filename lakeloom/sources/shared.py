"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a step writes: under spark.checkpoint.dir; in local mode, where that may be unset, under the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, *partition_by: str, codec: str | None = None) -> DataFrame:
    """df as a written table: no lineage, and nothing is lost with an executor. codec: the files' compression, if not the session's."""
    path = folder(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lakeloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a table of keep() that nothing reads any more."""
    path = getattr(df, "_lakeloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
