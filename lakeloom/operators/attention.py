"""Attention over sequences of any length, in blocks of positions with mergeable partial states.

A block of queries meets each block of keys that it may look at; what comes of it is a partial state for each query and head: the greatest score, the sum
of the exponentials below it, and the sum of the values weighted by them. Two states merge into one of the same size (sums are scaled
to the greater maximum), so no task holds more than two blocks and a state, whatever the length of the sequence.

Defined cases: positions are integers, and need not be without gaps; rows with a null position, vector or sequence are left out; sequences are apart from each other; rows of one position all
count, and each gets its result; a query that may look at nothing (none here: it sees itself) would be left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions in a block.
BLOCK = 256


def _packed(table: pa.Table) -> pa.Table:
    """One block's rows as arrays: sorted positions, and the vectors of these end to end."""
    order = np.argsort(table.column("pos").to_numpy(), kind="stable")
    out = {"seq": table.column("seq").slice(0, 1), "block": table.column("block").slice(0, 1), "pos": pa.array([table.column("pos").to_numpy()[order].astype("<i8").tobytes()], pa.binary())}
    for c in "qkv":
        x = np.array(table.column(c).to_pylist(), np.float64)[order]
        out[c] = pa.array([x.astype("<f8").tobytes()], pa.binary())
    return pa.table(out)


def partial(q: np.ndarray, k: np.ndarray, v: np.ndarray, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(maximum, sum, weighted vectors) by query and head, of (rows, heads, width) arrays; allowed: queries by keys."""
    s = np.einsum("ihd,jhd->ihj", q, k) / np.sqrt(q.shape[2])
    if allowed is not None:
        s = np.where(allowed[:, None, :], s, -np.inf)
    top = s.max(2)
    e = np.exp(s - np.where(np.isfinite(top), top, 0.0)[:, :, None])
    return top, e.sum(2), np.einsum("ihj,jhd->ihd", e, v)


def merge(a: tuple, b: tuple) -> tuple:
    """One state of two."""
    top = np.maximum(a[0], b[0])
    safe = np.where(np.isfinite(top), top, 0.0)
    x, y = np.exp(a[0] - safe), np.exp(b[0] - safe)
    return top, a[1] * x + b[1] * y, a[2] * x[:, :, None] + b[2] * y[:, :, None]


def attention(df: DataFrame, sequence: str, pos: str, q: str = "q", k: str = "k", v: str = "v", causal: bool = True, heads: int = 1, block: int | None = None) -> DataFrame:
    """(sequence, pos, y): softmax(q k / sqrt(head size)) v within each sequence, head by head; with causal, over positions up to the query's."""
    size = BLOCK if block is None else block
    kind = df.schema[sequence].dataType.simpleString()
    array = "array<double>"
    rows = df.select(F.col(sequence).alias("seq"), F.col(pos).cast("long").alias("pos"), *[F.col(c).cast(array).alias(n) for c, n in ((q, "q"), (k, "k"), (v, "v"))]).dropna()
    blocks = rows.withColumn("block", F.floor(F.col("pos") / size).cast("long")).groupBy("seq", "block").applyInArrow(_packed, f"seq {kind}, block long, pos binary, q binary, k binary, v binary")
    asked = blocks.select("seq", "block", F.col("pos").alias("at"), "q")
    given = blocks.select("seq", F.col("block").alias("other"), F.col("pos").alias("from"), "k", "v")
    others = blocks.groupBy("seq").agg(F.collect_set("block").alias("others"))  # numbers of blocks only
    wanted = asked.join(others, "seq").withColumn("other", F.explode(F.filter("others", lambda x: x <= F.col("block")) if causal else F.col("others"))).drop("others")
    met = wanted.join(given, ["seq", "other"])

    def shaped(raw, n):
        return np.frombuffer(raw, "<f8").reshape(n, heads, -1)

    def meet(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("at", "from", "q", "k", "v")}
                at, of = np.frombuffer(r["at"], "<i8"), np.frombuffer(r["from"], "<i8")
                state = partial(shaped(r["q"], len(at)), shaped(r["k"], len(of)), shaped(r["v"], len(of)), of[None, :] <= at[:, None] if causal else None)
                packed = pa.array([np.concatenate([state[0][:, :, None], state[1][:, :, None], state[2]], 2).astype("<f8").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("seq").slice(i, 1), b.column("block").slice(i, 1), b.column("other").slice(i, 1), b.column("at").slice(i, 1), packed], names=["seq", "block", "other", "at", "state"])

    states = met.mapInArrow(meet, f"seq {kind}, block long, other long, at binary, state binary")

    def add(batches):
        key = held = None

        def out():
            seq, positions, (_, total, sums) = key[0], held[0], held[1]
            y = (sums / total[:, :, None]).reshape(len(positions), -1)
            return pa.RecordBatch.from_arrays([pa.array([seq] * len(positions), seq_type), pa.array(positions, pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], names=["seq", "pos", "y"])

        for b in batches:
            seq_type = b.schema.field("seq").type
            for i in range(b.num_rows):
                own = (b.column("seq")[i].as_py(), b.column("block")[i].as_py())
                positions = np.frombuffer(b.column("at")[i].as_buffer(), "<i8")
                x = np.frombuffer(b.column("state")[i].as_buffer(), "<f8").reshape(len(positions), heads, -1)
                state = (x[:, :, 0], x[:, :, 1], x[:, :, 2:])
                if own == key:
                    held = (positions, merge(held[1], state))
                else:
                    if key is not None:
                        yield out()
                    key, held = own, (positions.copy(), tuple(y.copy() for y in state))
        if key is not None:
            yield out()

    merged = states.repartition("seq", "block").sortWithinPartitions("seq", "block", "other").mapInArrow(add, f"seq {kind}, pos long, y {array}")
    return merged.select(F.col("seq").alias(sequence), F.col("pos").alias(pos), "y")
