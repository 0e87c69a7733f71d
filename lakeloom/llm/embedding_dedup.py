"""Links between embeddings by spherical-cap filters with structured random product codes.

A filter is a direction; it holds the vectors whose inner product with it exceeds a threshold. The
directions are products: the space is randomly rotated and halved, each half has a small random
code, and every pair of code words is a filter, so the exceeding ones are list-decoded from the two short
lists of inner products, without looking at most of them. Many rotations with small codes make filters of different pairs independent.

The threshold grows with the number of vectors so that a filter holds about BUCKET of them, and there
are as many filters as make vectors at the least linked similarity share SHARED filters on average (both from the
exact distribution of one coordinate on a sphere). A pair at the least similarity that shares no filter is missed: of 6,000 such pairs in 64 dimensions the one
with the fewest shared 4, at 50,000 as at 1,000,000 vectors (with 6 rotations one in 6,000 was missed). Filters are then joined, and pairs are verified in double
precision; a pair counts in the first filter that both vectors have. A filter that holds more than BLOCK vectors is
cut into blocks, and each pair of blocks is a piece of work of its own.

Equal vectors are one class, which carries their number. Pairs are not written out: each piece of work gives its
vectors' numbers of links, and a spanning forest of the links.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths do not link; repeated rows (equal ids) are links of each other like any equal vectors;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import graph, spill

BUCKET, SHARED, ROTATIONS, BLOCK = 64, 30, 48, 1024


def _tail(d: int, a: np.ndarray) -> np.ndarray:
    """P(x >= a) for one coordinate x of a random unit vector in d dimensions."""
    grid = np.linspace(-1, 1, 20001)
    density = np.maximum(1 - grid**2, 1e-300) ** ((d - 3) / 2) if d > 2 else np.ones_like(grid)
    c = np.cumsum(density)
    return 1 - np.interp(a, grid, c / c[-1])


def plan(n: int, d: int, similarity: float) -> tuple[float, int]:
    """(threshold of the inner product, code words in each half) for n vectors of d dimensions."""
    grid = np.linspace(0, 1, 20001)
    tail = _tail(d, grid)
    a = float(grid[np.searchsorted(-tail, -min(0.25, BUCKET / max(n, 1)))])
    x = np.linspace(a, 1, 4001)[:-1]
    weight = np.maximum(1 - x**2, 1e-300) ** ((d - 3) / 2)
    other = _tail(d - 1, np.clip((a - similarity * x) / np.sqrt((1 - similarity**2) * np.maximum(1 - x**2, 1e-12)), -1, 1))
    joint = float(_tail(d, np.array([a]))[0]) * float((weight * other).sum() / weight.sum())
    return a, max(2, math.ceil(math.sqrt(SHARED / max(joint, 1e-12) / ROTATIONS)))


class Codes:
    """The filters for vectors of one length."""

    def __init__(self, d: int, n: int, similarity: float):
        self.d = max(4, d + d % 2)
        self.least, self.words = plan(n, self.d, similarity)
        rng = np.random.default_rng([d, 12])
        self.rotations = [np.linalg.qr(rng.standard_normal((self.d, self.d)))[0] for _ in range(ROTATIONS)]
        half = self.d // 2
        self.codes = []
        for _ in range(ROTATIONS):
            two = rng.standard_normal((2, half, self.words))
            self.codes.append(two / np.linalg.norm(two, axis=1, keepdims=True) / math.sqrt(2))

    def decode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter), sorted, of all filters that the unit vectors v exceed."""
        full = np.zeros((len(v), self.d))
        full[:, : v.shape[1]] = v
        rows, filters = [], []
        for r, (turn, (c1, c2)) in enumerate(zip(self.rotations, self.codes, strict=True)):
            t = full @ turn
            s1, s2 = t[:, : self.d // 2] @ c1, t[:, self.d // 2 :] @ c2
            i, a = np.nonzero(s1 >= self.least - s2.max(1, keepdims=True))  # the others exceed with no word of the second half
            for k in range(0, len(i), 1 << 14):
                j, b = np.nonzero(s1[i[k : k + (1 << 14)], a[k : k + (1 << 14)], None] + s2[i[k : k + (1 << 14)]] >= self.least)
                rows.append(i[k + j])
                filters.append((r * self.words + a[k + j].astype(np.int64)) * self.words + b)
        rows, filters = np.concatenate(rows), np.concatenate(filters)
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _vectors(column) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _assign(n: int, similarity: float):
    """mapInArrow: (node, weight, embedding, filters)."""

    def run(batches):
        codes: dict[int, Codes] = {}
        for b in batches:
            vectors = _vectors(b.column("embedding"))
            sizes = np.array([len(v) for v in vectors], np.int64)
            lists = [None] * len(vectors)
            for d in np.unique(sizes):
                code = codes.setdefault(int(d), Codes(int(d), n, similarity))
                which = np.flatnonzero(sizes == d)
                for k in range(0, len(which), 2048):
                    part = which[k : k + 2048]
                    v = _unit(np.stack([vectors[i] for i in part]))
                    rows, filters = code.decode(v)
                    cut = np.searchsorted(rows, np.arange(len(part) + 1))
                    for j, i in enumerate(part):
                        lists[i] = filters[cut[j] : cut[j + 1]] + (int(d) << 44)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("weight"), b.column("embedding"), pa.array(lists, pa.list_(pa.int64()))], names=["node", "weight", "embedding", "filters"])

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """The smallest index that links reach, by index, of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        near = np.where(linked, label[None, :], n).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(similarity: float):
    """Of a part: the links in its filters' blocks, as numbers of links by vector and as edges of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        key = [table.column(c).to_numpy() for c in ("filter", "low", "high", "node")]
        order = np.lexsort(key[::-1])
        f, low, high, node = (k[order] for k in key)
        weight = table.column("weight").to_numpy()[order]
        block = table.column("block").to_numpy()[order]
        vectors, earlier = table.column("embedding").combine_chunks(), table.column("earlier").combine_chunks()
        cut = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))) if len(f) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(f))
        nodes, counts, edge_a, edge_b = [], [], [], []
        for a, b in zip(cut, ends, strict=True):
            if b - a < 2:
                continue
            v = _unit(vectors.take(pa.array(order[a:b])).flatten().to_numpy().astype(np.float64).reshape(b - a, -1))
            linked = v @ v.T >= similarity
            np.fill_diagonal(linked, False)
            if low[a] != high[a]:  # pairs inside a block are another piece's work
                linked &= block[a:b, None] != block[None, a:b]
            if not linked.any():
                continue
            some = np.flatnonzero(linked.any(1))
            linked = linked[np.ix_(some, some)]
            own = node[a:b][some]
            label = _forest(linked)
            edge_a.append(own)
            edge_b.append(own[label])
            lists = earlier.take(pa.array(order[a:b][some]))
            values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            if len(values):  # pairs that share an earlier filter count there
                slot = np.unique(values, return_inverse=True)[1]
                has = np.zeros((len(some), slot.max() + 1), np.float32)
                has[np.repeat(np.arange(len(some)), np.diff(offsets)), slot] = 1
                linked = linked & ~(has @ has.T > 0.5)
            nodes.append(own)
            counts.append(linked @ weight[a:b][some])
        if not nodes:
            return _out(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        n, c = np.concatenate(nodes), np.concatenate(counts)
        u, at = np.unique(n, return_inverse=True)
        ea, eb = np.concatenate(edge_a), np.concatenate(edge_b)
        e = np.unique(np.stack([ea, eb], 1)[ea != eb], axis=0)
        return _out(u, np.bincount(at, c.astype(np.float64)).astype(np.int64), e[:, 0], e[:, 1])

    return run


_OUT = "a long, b long, n_links long"


def _out(nodes, counts, a, b) -> pa.Table:
    return pa.table({"a": pa.array(np.concatenate([nodes, a])), "b": pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(b, pa.int64())]), "n_links": pa.concat_arrays([pa.array(counts, pa.int64()), pa.nulls(len(a), pa.int64())])})


def embedding_links(vectors: DataFrame, similarity: float = 0.9, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id (smallest id that links reach), kept."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    fit = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    good = given.where(fit)
    classes = spill.write(good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    n = classes.count()
    held = spill.write(classes.mapInArrow(_assign(n, similarity), f"node long, weight long, embedding {classes.schema['embedding'].dataType.simpleString()}, filters array<long>"), "vector-filters")
    size = int(held.agg(F.sum(F.size("filters") * (F.size("embedding") * 4 + F.size("filters") * 4))).first()[0] or 0)
    parts = X.parts(spark, size, 16 << 20)
    rows = held.select("node", "weight", "embedding", "filters", F.posexplode("filters").alias("at", "filter"))
    hot = held.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    hot = spill.write(hot.select("filter", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks")), "hot-filters")
    few = F.broadcast(hot) if hot.count() <= graph.SMALL else hot
    rows = rows.join(few, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("filter", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "weight", "embedding", F.slice("filters", F.lit(1), F.col("at")).alias("earlier"))
    rows = rows.withColumn("part", F.pmod(F.hash("filter", "low", "high"), F.lit(parts)))
    found = spill.write(rows.groupBy("part").applyInArrow(_pairs(similarity), _OUT), "vector-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n_far"))
    comp = graph.components(found.where("b IS NOT NULL").select("a", "b"))
    by_class = classes.join(links, "node", "left").join(comp, "node", "left").select("embedding", F.coalesce("component", "node").alias("component_id"), (F.coalesce("n_far", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = good.join(by_class, "embedding", "left").select("vec_id", "n_links", "component_id")
    alone = given.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
