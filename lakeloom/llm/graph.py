"""Connected components of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spill

SMALL = 1 << 20
HOT, HOT_KEYS = 256, 1 << 16


def hot_keys(counts: DataFrame, keys: list[str], total: int, name: str = "n") -> DataFrame:
    """(keys, _parts) of the keys that more than `most` rows have, which are dealt to several tasks; counts has the rows of each key, `total` in all.
    `most` grows with the total, so there are never more than HOT_KEYS such keys, and they can be broadcast."""
    most = max(HOT, total // HOT_KEYS)
    return counts.where(F.col(name) > most).select(*keys, F.ceil(F.col(name) / most).cast("int").alias("_parts"))


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows with _salt: rows of a hot key are dealt by a hash of the column `by`."""
    return rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")


def copied(side: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """side, which has a key once, with a row for each _salt of its key."""
    return side.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")


def components(links: DataFrame, most: int = 100) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that links reach.

    Each round takes the least label among neighbours and then the label's own label, so chains
    halve; labels are written between rounds. Aggregates are pre-combined, and the links of a node that has very many are dealt to
    several tasks.
    """
    pairs = spill.write(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    degrees = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    hot = spill.write(hot_keys(degrees, ["b"], pairs.count()), "hot-nodes")
    both = spill.write(salted(pairs, hot, ["b"], "a"), "links")
    spill.remove(pairs)
    table = spill.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"), F.col("node").alias("was")).select("node", "was", "component"), "labels")
    for _ in range(most):
        labels = table.select("node", "component")
        near = both.join(copied(labels.select(F.col("node").alias("b"), "component"), hot, ["b"]), ["b", "_salt"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = spill.write(step.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        spill.remove(table)
        table = new
        if table.where("was <> component").isEmpty():
            spill.remove(both)
            spill.remove(hot)
            return table.select("node", "component")
    raise RuntimeError("components did not settle")


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is in the one column of ids (a written table); ids are broadcast if at most SMALL (8 MB)."""
    ids = ids.select(F.col(ids.columns[0]).alias(column))
    if ids.count() <= SMALL:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_semi")
