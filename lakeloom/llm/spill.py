"""Tables between stages, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; in local mode, where it may be unset, a folder of the warehouse. Elsewhere it is an error not to have one, since
    a folder of one machine would not do."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not own:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not got.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = got.get() if got.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return own.rstrip("/")


def write(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written to a new table of the shared folder, and read from it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeloom_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete a table of write() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(df._lakeloom_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
