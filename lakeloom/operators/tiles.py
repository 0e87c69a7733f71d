"""Matrix products on tables, in tiles, and the pre-norm transformer block made of them.

The rows of a sequence are cut into blocks of positions, and these, like the weights, into tiles of TILE columns. Tiles are joined on the inner coordinate,
multiplied, and summed block by block from sorted rows with one sum held, so no task holds more than a few tiles, whatever the width of the weights or
the length of the sequence.

A weight matrix is a table (i, row): the weights of input i, by output. Defined cases: rows with a null sequence, position or vector are left out; rows of one
position all count; an empty table gives an empty result; weights that lack an input are an error of the sum's width and must not be given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions import vectors as V

from .attention import attention

#: Columns of a tile, and positions of a block.
TILE, BLOCK = 256, 256


def _weight_tiles(weights: DataFrame, tile: int) -> DataFrame:
    """(inner, outer, w): tiles of a weight table, in binary."""
    n = F.floor((F.size("row") + tile - 1) / tile).cast("int")
    parts = weights.select(F.col("i").cast("int").alias("i"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.slice(F.col("row").cast("array<double>"), j * tile + 1, F.lit(tile)))).alias("outer", "part"))

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("i").to_numpy())
        w = np.array(table.column("part").to_pylist(), np.float64)[order]
        return pa.table({"inner": table.column("inner").slice(0, 1), "outer": table.column("outer").slice(0, 1), "w": pa.array([w.astype("<f8").tobytes()], pa.binary())})

    return parts.withColumn("inner", F.floor(F.col("i") / tile).cast("int")).groupBy("inner", "outer").applyInArrow(pack, "inner int, outer int, w binary")


def matmul(rows: DataFrame, weights: DataFrame, x: str = "x", tile: int | None = None, block: int | None = None) -> DataFrame:
    """(seq, pos, y): each vector x times the weights."""
    tile, block = tile or TILE, block or BLOCK
    kind = rows.schema["seq"].dataType.simpleString()
    given = rows.select("seq", F.col("pos").cast("long").alias("pos"), F.col(x).cast("array<double>").alias("x")).dropna().withColumn("block", F.floor(F.col("pos") / block).cast("long"))

    def cut(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("pos").to_numpy(),))
        pos = table.column("pos").to_numpy()[order].astype("<i8").tobytes()
        m = np.array(table.column("x").to_pylist(), np.float64)[order]
        parts = [m[:, a : a + tile].astype("<f8").tobytes() for a in range(0, m.shape[1], tile)]
        n = len(parts)
        first = lambda c: pa.concat_arrays([table.column(c).slice(0, 1).combine_chunks()] * n)
        return pa.table({"seq": first("seq"), "block": first("block"), "inner": pa.array(range(n), pa.int32()), "at": pa.array([pos] * n, pa.binary()), "m": pa.array(parts, pa.binary())})

    tiles = given.groupBy("seq", "block").applyInArrow(cut, f"seq {kind}, block long, inner int, at binary, m binary")
    met = tiles.join(_weight_tiles(weights, tile), "inner")

    def multiply(batches):
        for b in batches:
            for i in range(b.num_rows):
                n = len(b.column("at")[i].as_py()) // 8
                m = np.frombuffer(b.column("m")[i].as_buffer(), "<f8").reshape(n, -1)
                out = m @ np.frombuffer(b.column("w")[i].as_buffer(), "<f8").reshape(m.shape[1], -1)
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, 1) for c in ("seq", "block", "outer", "inner", "at")] + [pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["seq", "block", "outer", "inner", "at", "m"])

    products = met.mapInArrow(multiply, f"seq {kind}, block long, outer int, inner int, at binary, m binary")

    def add(batches):
        key, done, held, at = None, [], None, b""

        def out():
            y = np.concatenate([*done, held], 1)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(y), kind_of), pa.array(np.frombuffer(at, "<i8"), pa.int64()), pa.array(list(y), pa.list_(pa.float64()))], names=["seq", "pos", "y"])

        outer = None
        for b in batches:
            kind_of = b.schema.field("seq").type
            for i in range(b.num_rows):
                own, j = (b.column("seq")[i].as_py(), b.column("block")[i].as_py()), b.column("outer")[i].as_py()
                positions = b.column("at")[i].as_py()
                m = np.frombuffer(b.column("m")[i].as_buffer(), "<f8").reshape(len(positions) // 8, -1)
                if own != key:
                    if key is not None:
                        yield out()
                    key, done, held, at, outer = own, [], m.copy(), positions, j
                elif j != outer:
                    done, held, outer = [*done, held], m.copy(), j
                else:
                    held = held + m
        if key is not None:
            yield out()

    return products.repartition("seq", "block").sortWithinPartitions("seq", "block", "outer", "inner").mapInArrow(add, f"seq {kind}, pos long, y array<double>")


def _vector(values) -> F.Column:
    return F.array(*[F.lit(float(v)) for v in values])


def transformer_block(rows: DataFrame, weights: dict[str, DataFrame], heads: int, vectors: dict[str, list[float]] | None = None, tile: int | None = None, block: int | None = None) -> DataFrame:
    """(seq, pos, y) of rows (seq, pos, x), positions distinct: x + attention(norm(x)), and to that its feed-forward layer of its norm. weights: q_proj, k_proj, v_proj, out_proj, fc1 and
    fc2; vectors: biases by the same names, and ln1.scale, ln1.shift, ln2.scale, ln2.shift, each where there is one."""
    own = vectors or {}

    def norm(x, name):
        out = V.layer_norm(x)
        if f"{name}.scale" in own:
            out = F.zip_with(out, _vector(own[f"{name}.scale"]), lambda a, s: a * s)
        return V.add(out, _vector(own[f"{name}.shift"])) if f"{name}.shift" in own else out

    def linear(df, name, x):
        y = matmul(df, weights[name], x, tile, block)
        return y.withColumn("y", V.add(F.col("y"), _vector(own[name]))) if name in own else y

    rows = rows.select("seq", F.col("pos").cast("long").alias("pos"), F.col("x").cast("array<double>").alias("x")).dropna()
    h = rows.select("seq", "pos", norm(F.col("x"), "ln1").alias("h"))
    q, k, v = (linear(h, f"{p}_proj", "h").withColumnRenamed("y", p) for p in "qkv")
    seen = attention(q.join(k, ["seq", "pos"]).join(v, ["seq", "pos"]), "seq", "pos", heads=heads, block=block)
    mixed = linear(seen, "out_proj", "y").join(rows, ["seq", "pos"]).select("seq", "pos", V.add(F.col("x"), F.col("y")).alias("x"))
    up = linear(mixed.select("seq", "pos", norm(F.col("x"), "ln2").alias("h")), "fc1", "h")
    down = linear(up.select("seq", "pos", V.gelu(F.col("y")).alias("h")), "fc2", "h")
    return down.join(mixed, ["seq", "pos"]).select("seq", "pos", V.add(F.col("x"), F.col("y")).alias("y"))
