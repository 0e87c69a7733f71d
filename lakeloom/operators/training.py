"""Training control as tables: learning rates, parameter groups, loss history."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def learning_rates(spark, n: int, rate: float, warmup: int, decay: int, least: float) -> DataFrame:
    """(iter, lr): linear warm-up, cosine decay, then the least rate."""
    i = F.col("id")
    ratio = (i - warmup) / F.lit(float(decay - warmup))
    cosine = least + 0.5 * (1 + F.cos(F.lit(math.pi) * ratio)) * (rate - least)
    lr = F.when(i < warmup, rate * (i + 1) / (warmup + 1)).when(i > decay, F.lit(least)).otherwise(cosine)
    return spark.range(n).select(i.alias("iter"), lr.cast("double").alias("lr"))


def parameter_groups(weights: DataFrame, decay: float) -> DataFrame:
    """weights with weight_decay: none for names with bias, ln or norm."""
    return weights.withColumn("weight_decay", F.when(F.col("name").rlike("bias|ln|norm"), 0.0).otherwise(F.lit(decay)))


def best_so_far(history: DataFrame, run: str, step: str = "iter", value: str = "val_loss") -> DataFrame:
    """history with is_best: lower than every earlier value of its run."""
    earlier = F.min(value).over(W.partitionBy(run).orderBy(step).rowsBetween(W.unboundedPreceding, -1))
    return history.withColumn("is_best", F.coalesce(F.col(value) < earlier, F.lit(True)))


def cadence(history: DataFrame, step: str, every: int) -> DataFrame:
    """Steps that are logged, evaluated or saved: the multiples of `every`, 0 too."""
    return history.where(F.col(step) % every == 0)


def evaluate(losses: DataFrame, position: str, loss: str, n: int, batches: int, evaluations: int) -> DataFrame:
    """(evaluation, mean_loss) over `batches` losses each. The loader goes on where the evaluation before ended, and from the end of its n losses
    (position 0 to n - 1) to their start."""
    spark = losses.sparkSession
    wanted = spark.range(evaluations * batches).select(F.floor(F.col("id") / batches).alias("evaluation"), (F.col("id") % n).alias(position))
    return wanted.join(losses.select(F.col(position).cast("long").alias(position), loss), position).groupBy("evaluation").agg(F.avg(loss).alias("mean_loss"))
