"""Routing of tokens to experts with a capacity, and the weighted sum of what the experts return.

A token chooses the k experts with its highest logits (ties: the smaller number) and weighs them by the softmax of these k. Every expert takes as many
choices as its capacity: first choices before second ones, then by the token's number; choices beyond it are not sent, and a token none of whose choices are
sent returns zeros, which a residual connection adds to the token. A choice's place in its expert's queue comes from one range sort of all choices
and the counts of its partitions, so an expert that most tokens choose is no hot group.

Defined cases: a null token number, null or empty logits and null vectors choose nothing and return nothing; a null among the logits is never chosen; tokens of one number are taken in
the order of their weight, then of their vector; fewer experts than k are all chosen; a capacity under 1 sends nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.sources.shared import keep

#: Experts whose weights are sent to all tasks.
MOST = 4096


def choices(logits: Column, k: int) -> Column:
    """array of (choice, expert, gate) of a token's logits."""
    ranked = F.slice(F.array_sort(F.filter(F.transform(logits, lambda x, i: F.struct((-x).alias("minus"), i.alias("expert"))), lambda x: x["minus"].isNotNull())), 1, k)
    top = F.element_at(ranked, 1)["minus"]
    weights = F.transform(ranked, lambda x: F.exp(top - x["minus"]))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(ranked, lambda x, i: F.struct(i.alias("choice"), x["expert"].alias("expert"), (F.exp(top - x["minus"]) / total).alias("gate")))


def capacity(tokens: int, experts: int, k: int, factor: float = 1.0) -> int:
    """Choices that an expert takes: its even share times a factor, rounded up."""
    return math.ceil(factor * tokens * k / experts) if experts else 0


def route(tokens: DataFrame, token: str, logits: str, x: str, k: int, most: int) -> DataFrame:
    """(token, x, choice, expert, gate, place, sent): each choice with its place from 0 in its expert's queue, and whether it is within `most`."""
    given = tokens.select(F.col(token).cast("long").alias("token"), F.col(x).alias("x"), F.col(logits).cast("array<double>").alias("l")).where("token IS NOT NULL AND x IS NOT NULL AND size(l) > 0")
    each = given.select("token", "x", F.explode(choices(F.col("l"), k)).alias("c")).select("token", "x", "c.choice", "c.expert", "c.gate")
    order = ["expert", "choice", "token", F.desc("gate"), "x"]
    sorted_ = keep(each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "choices")
    part = F.shiftrightunsigned("_at", 33)
    runs = sorted_.groupBy("expert", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("expert").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("expert", "_part", "_first", before.alias("_before"))
    placed = sorted_.withColumn("_part", part).join(F.broadcast(starts), ["expert", "_part"]).withColumn("place", (F.col("_before") + F.col("_at") - F.col("_first")).cast("long"))
    return placed.select("token", "x", "choice", "expert", "gate", "place", (F.col("place") < most).alias("sent"))


def combine(routed: DataFrame, experts: DataFrame, run) -> DataFrame:
    """(token, y): the gated sum of run(x, weights), a column expression on a sent token's vector and its expert's weights; experts: (expert, weights)."""
    few = experts.select(F.col("expert").cast("int").alias("expert"), "weights")
    few = F.broadcast(few) if experts.count() <= MOST else few
    zero = F.transform("x", lambda _: F.lit(0.0))
    out = routed.join(few, "expert", "left").withColumn("y", F.when(F.col("sent"), F.transform(run(F.col("x"), F.col("weights")), lambda v: v * F.col("gate"))).otherwise(zero))
    all_ = out.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("choice", "y"))).alias("all"))
    return all_.select("token", F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.element_at("all", 1)["y"], lambda a, v: F.zip_with(a, v["y"], lambda p, q: p + q)).alias("y"))
