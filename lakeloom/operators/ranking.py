"""Global positions without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Groups of keys that one task orders at most.
GROUPS = 1 << 16


def prefix_sum(df: DataFrame, key: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """df with `name`: the sum of value over all rows with a smaller integer key (keys are distinct).

    Only (key, value) is summed, and joined to the rows afterwards. Keys are grouped by key div width, or by a greater width if the keys are
    spread so far that there would be more than GROUPS groups; only the groups' sums are ordered in one task.
    """
    small = df.select(key, value)
    ends = small.agg(F.min(key).cast("long"), F.max(key).cast("long")).first()
    if ends[0] is not None:
        width = max(width, -(-(ends[1] - ends[0] + 1) // GROUPS))
    part = F.floor(F.col(key) / width).cast("long")
    sums = small.groupBy(part.alias("_part")).agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = small.withColumn("_part", part).withColumn("_inside", inside).join(before, "_part").select(key, (F.col("_before") + F.col("_inside")).cast("long").alias(name))
    return df.join(placed, key)


def rank_strings(df: DataFrame, column: str, name: str, prefix: int = 3) -> DataFrame:
    """df with `name`: the number of smaller distinct strings (values are distinct), by code points.

    Rows are ranked among those with the same first characters; only the prefixes' counts are ordered in one task.
    """
    head = F.substring(F.col(column), 1, prefix)
    counts = df.groupBy(head.alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_head", F.coalesce(F.sum("_n").over(W.orderBy("_head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_head").orderBy(column)) - 1
    return df.withColumn("_head", head).withColumn("_inside", inside).join(before, "_head").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_head", "_before", "_inside")
