"""Near-duplicate documents: SetSketch registers, banded, estimated jointly, verified on full sets.

1. One pass over the text gives each document's set size, a 128-bit key of its set, and its registers.
   Documents with equal sets are one class, represented by the smallest id.
2. Registers are banded; classes that share a band key are candidates. In a bucket of at most SMALL
   classes all pairs are. In a larger one only pairs with its hub are, where the hub is the
   class with the least share of rare elements: those that at most RARE classes of the large buckets have.
3. The similarity of each candidate pair is estimated from both sketches by the joint likelihood; pairs that are FAR standard errors
   or more under the threshold go, the others are verified on their full sets (the hub's set travels to the shards of its partners).
4. What may still link two components inside large buckets is found in two ways. Pairs that share a rare element
   come from an inverted index of the rare elements, whose lists have at most RARE classes. For a pair that shares none, both
   classes' rare elements lie outside the intersection, which bounds its similarity: classes that are not yet
   in their hub's component are compared in blocks with all others of the bucket by this bound. What is left is estimated and verified
   like the others. So no bucket is cut off and no pair list of a whole group is made.

With 24 bands of 4 registers a pair at similarity 0.85 shares no band with probability 2e-8; an estimate is FAR errors off about once in a million pairs
at the threshold.

Defined cases: null texts, and texts without words, have the empty set and link with nothing; with
fewer words than a shingle the whole sequence is the one element; texts of any length are hashed in pieces; a null id links with nothing and is not kept; rows with one id are the same document (each row is reported); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import graph, spill
from . import setsketch as S
from . import textkit as K

_U = np.uint64
REGISTERS, ROWS, SMALL, RARE, FAR, BLOCK, OTHERS = 96, 4, 24, 64, 5.0, 1024, 1 << 15
_SKETCH = "id long, n_shingles long, key1 long, key2 long, registers binary, bands array<long>"


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of text i are hashes[first[i]:first[i + 1]]."""
    w = K.MixedWords(texts, K.BLANK_WORD, lower=True)
    at, h = w.windows(k)
    of = w.text_of()[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(few):
        of, h = np.append(of, few), np.append(h, w.whole(few))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def text_sets(group: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() of a group of runs(), a long text by pieces."""
    found, words = [], 0
    for part, cut in K.pieces(group, K.BLANK_WORD, k - 1, lower=True):
        if cut is None:
            return shingle_sets(part, k)
        w = K.MixedWords(part, K.BLANK_WORD, lower=True)
        found.append(np.unique(w.windows(k)[1]))
        words += int(np.searchsorted(w.starts, cut))
    if words < k:  # all its words are in the piece that has the first one
        w = K.MixedWords(group, K.BLANK_WORD, lower=True)
        return (w.whole(np.array([0])), np.array([0, 1])) if words else (np.zeros(0, _U), np.array([0, 0]))
    h = np.unique(np.concatenate(found))
    return h, np.array([0, len(h)])


def _sketch(k: int):
    def run(batches):
        for b in K.slices(batches):
            sizes, k1, k2, regs, bands = [], [], [], [], []
            for _, group in K.runs(K.each_bytes(b.column("text"))):
                h, first = text_sets(group, k)
                n = np.diff(first)
                some = np.flatnonzero(n)
                sums = np.concatenate([np.zeros((1, 2), _U), np.cumsum(np.stack([K.mix(h), K.mix(h ^ _U(0xABCDEF))], 1), 0, dtype=_U)]) if len(h) else np.zeros((1, 2), _U)
                key = sums[first[1:]] - sums[first[:-1]]
                sizes += n.tolist()
                k1 += key[:, 0].view(np.int64).tolist()
                k2 += key[:, 1].view(np.int64).tolist()
                r = S.registers(h, np.append(first[some], len(h)), REGISTERS) if len(some) else np.zeros((0, REGISTERS), np.uint16)
                own_bands = S.bands(r, ROWS).view(np.int64)
                blobs, lists = [None] * len(group), [None] * len(group)
                for j, i in enumerate(some):
                    blobs[i], lists[i] = r[j].tobytes(), own_bands[j]
                regs += blobs
                bands += lists
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n_shingles", "key1", "key2", "registers", "bands"],
            )

    return run


def _sets(k: int):
    """Packed sets of documents: (part, id, payload)."""

    def run(batches):
        for b in K.slices(batches):
            blobs = []
            for _, group in K.runs(K.each_bytes(b.column("text"))):
                h, first = text_sets(group, k)
                blobs += [h[first[i] : first[i + 1]].tobytes() for i in range(len(group))]
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("id"), pa.array(blobs, pa.binary())], names=["part", "id", "payload"])

    return run


def _elements(buckets: int, columns: list[str]):
    """Elements of the given sets, with the set's id and further columns."""

    def run(batches):
        for b in batches:
            sets = [np.frombuffer(x, _U) for x in b.column("payload").to_pylist()]
            if sets:
                h, n = np.concatenate(sets), [len(s) for s in sets]
                yield X.rows(X.dealt(X.bucket_of(h, buckets), [h, *(np.repeat(b.column(c).to_numpy(), n).view(_U) for c in columns)]))

    return run


def _lists(table: pa.Table, columns: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A bucket's elements sorted, where each one's list starts, and its length."""
    cols = X.get_all(table.column("payload").to_pylist(), columns)
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
    cols = [c[new] for c in cols]
    start = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])) if len(cols[0]) else np.zeros(0, np.int64)
    return cols, start, np.diff(np.append(start, len(cols[0])))


def _rare(shards: int):
    """Numbers of rare elements, by set."""

    def run(table: pa.Table) -> pa.Table:
        (_, d), _, n = _lists(table, 2)
        ids = np.sort(d[np.repeat(n <= RARE, n)])
        at = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        return X.blob_table(X.dealt(X.shard_of(ids[at].view(np.int64), shards), [ids[at], np.diff(np.append(at, len(ids))).astype(_U)]))

    return run


def _summed(table: pa.Table) -> pa.Table:
    ids, n = X.get_all(table.column("payload").to_pylist(), 2)
    u, at = np.unique(ids, return_inverse=True)
    return pa.table({"id": pa.array(u.view(np.int64)), "n_rare": pa.array(np.bincount(at, n.astype(np.float64), len(u)).astype(np.int64))})


def _sharing(shards: int):
    """Pairs of sets of different components that share a rare element, by the shard of the second."""

    def run(table: pa.Table) -> pa.Table:
        (_, d, comp), start, n = _lists(table, 3)
        found = []
        for size in range(2, RARE + 1):  # all lists of one length at once
            at = start[n == size]
            if not len(at):
                continue
            i, j = np.triu_indices(size, 1)
            few = max(1, (1 << 18) // len(i))  # lists at a time, for bounded memory
            for k in range(0, len(at), few):
                a, b = (at[k : k + few, None] + i).reshape(-1), (at[k : k + few, None] + j).reshape(-1)
                cross = comp[a] != comp[b]
                found.append(_distinct(d[a[cross]], d[b[cross]]))
        if not found:
            return X.blob_table([])
        a, b = _distinct(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))
        return X.blob_table(X.dealt(X.shard_of(b.view(np.int64), shards), [a, b]))

    return run


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _as_pairs(table: pa.Table) -> pa.Table:
    a, b = _distinct(*X.get_all(table.column("payload").to_pylist(), 2))
    return pa.table({"hub": pa.array(a.view(np.int64)), "leaf": pa.array(b.view(np.int64))})


_MAIL = "part int, hub long, leaf long, payload binary"


def _post(sets: pa.Table, wants: pa.Table) -> pa.Table:
    """Of a shard: the sets of its hubs, to the shards of their partners."""
    at = {i: k for k, i in enumerate(sets.column("id").to_pylist())}
    pairs = [(t, h, at[h]) for h, t in zip(wants.column("hub").to_pylist(), wants.column("target").to_pylist(), strict=True) if h in at]
    own = sets.column("payload").take(pa.array([p[2] for p in pairs], pa.int64()))
    return pa.table({"part": pa.array([p[0] for p in pairs], pa.int32()), "hub": pa.array([p[1] for p in pairs], pa.int64()), "leaf": pa.nulls(len(pairs), pa.int64()), "payload": own})


def _far(threshold: float) -> float:
    """Estimates under this are too far from the threshold."""
    return threshold - FAR * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


def _likely(threshold: float):
    """Whether the similarity of two sketches, by the joint likelihood, is not far under the threshold."""
    far = _far(threshold)

    def run(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b, size_a, size_b in columns:
            found = []
            for k in range(0, len(a), 4096):
                part = slice(k, k + 4096)
                x, y = (np.frombuffer(b"".join(c[part].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (a, b))
                found.append(S.joint_jaccard(x, y, size_a[part].to_numpy(), size_b[part].to_numpy()) >= far)
            yield pa.array(np.concatenate(found) if found else np.zeros(0, bool), pa.bool_())

    return F.arrow_udf(run, "boolean")


def _verify(num: int, den: int):
    """Of a shard: its documents against the sets of their hubs; den * intersection >= num * union."""

    def run(sets: pa.Table, mail: pa.Table) -> pa.Table:
        at = {i: k for k, i in enumerate(sets.column("id").to_pylist())}
        blob = sets.column("payload").combine_chunks()
        hubs, by_leaf = {}, {}
        for hub, leaf, payload in zip(*(mail.column(c) for c in ("hub", "leaf", "payload")), strict=True):
            if leaf.is_valid:
                by_leaf.setdefault(hub.as_py(), []).append(leaf.as_py())
            else:
                hubs[hub.as_py()] = payload
        a, b = [], []
        for hub, leaves in by_leaf.items():
            if hub not in hubs:
                continue
            own, there = np.frombuffer(hubs[hub].as_buffer(), _U), [x for x in leaves if x in at]
            for k in range(0, len(there), 256):
                theirs = [np.frombuffer(blob[at[x]].as_buffer(), _U) for x in there[k : k + 256]]
                n, values = np.array([len(s) for s in theirs]), np.concatenate(theirs)
                slot = np.searchsorted(own, values)
                slot[slot == len(own)] = 0
                both = np.add.reduceat((own[slot] == values).astype(np.int64), np.cumsum(n) - n)
                for i in np.flatnonzero(den * both >= num * (n + len(own) - both)):
                    a.append(hub)
                    b.append(there[k + i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _rest(threshold: float):
    """Of a block of a large bucket's unsettled classes (mine) and one of all its classes: the pairs that may still link."""
    far = _far(threshold)

    def run(table: pa.Table) -> pa.Table:
        node, size, rare, comp = (table.column(c).to_numpy() for c in ("node", "n_shingles", "n_rare", "component"))
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        mine = table.column("mine").to_numpy(zero_copy_only=False)
        out_a, out_b = [], []
        for i in np.flatnonzero(mine):
            most = np.minimum(size - rare, size[i] - rare[i])
            least = np.maximum(np.maximum(size + rare[i], size[i] + rare), size + size[i] - most)
            j = np.flatnonzero(~mine & (comp != comp[i]) & (most >= threshold * least))
            if len(j):
                est = S.joint_jaccard(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), size[i]), size[j])
                j = j[est >= far]
                out_a.append(node[j])
                out_b.append(np.full(len(j), node[i]))
        a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
        b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
        return pa.table({"hub": pa.array(np.minimum(a, b), pa.int64()), "leaf": pa.array(np.maximum(a, b), pa.int64())})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 85, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest id that links reach), kept.

    Linked are documents whose shingle sets have 100 * intersection >= percent * union.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    sketches = spill.write(given.mapInArrow(_sketch(shingle), _SKETCH), "sketches")
    some = sketches.where("n_shingles > 0 AND id IS NOT NULL")
    classes = some.groupBy("key1", "key2", "n_shingles").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    nodes = spill.write(some.groupBy("key1", "key2", "n_shingles").agg(F.min_by(F.struct("registers", "bands"), "id").alias("s"), F.min("id").alias("node")).select("node", "n_shingles", "s.*"), "classes")
    banded = nodes.select(F.explode("bands").alias("band"), "node")
    keys = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = spill.write(keys, "bands")
    hot = spill.write(graph.hot_keys(keys, ["band"], int(keys.agg(F.sum("n")).first()[0] or 0)), "hot-bands")
    met = spill.write(graph.salted(banded, hot, ["band"], "node").join(graph.copied(keys, hot, ["band"]), ["band", "_salt"]), "met")  # classes that share a band key
    links = _links(spark, given, nodes, met, hot, shingle, percent)
    comp = graph.components(links) if links is not None else spark.createDataFrame([], "node long, component long")
    own = ["key1", "key2", "n_shingles"]
    by_class = classes.join(comp, "node", "left").where("component IS NOT NULL OR n > 1").select(*own, F.coalesce("component", "node").alias("component_id"))
    hot = spill.write(graph.hot_keys(classes, own, some.count()), "hot-classes")  # one class may have very many copies
    rows = graph.salted(sketches.select("id", *own), hot, own, "id")
    out = rows.join(graph.copied(by_class, hot, own), [*own, "_salt"], "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _links(spark, given: DataFrame, nodes: DataFrame, met: DataFrame, hot: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    wanted = spill.write(met.select(F.col("node").alias("id")).distinct(), "wanted")
    if wanted.isEmpty():
        return None
    size = int(nodes.agg(F.sum("n_shingles")).first()[0]) * 8
    shards, buckets = X.parts(spark, size, 32 << 20), X.parts(spark, size, 32 << 20)
    texts = graph.only(given, wanted, "id").withColumn("part", X.shard_column(shards, "id"))
    sets = spill.write(texts.select("part", "id", "text").mapInArrow(_sets(shingle), "part int, id long, payload binary").dropDuplicates(["id"]), "sets")
    likely = _likely(percent / 100)

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (hub, leaf), which are distinct."""
        pairs = spill.write(pairs, "candidates")
        busy = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
        busy = spill.write(graph.hot_keys(busy, ["hub"], pairs.count()), "hot-hubs")
        side = lambda k: nodes.select(F.col("node").alias(k), F.col("registers").alias(f"{k}_sketch"), F.col("n_shingles").alias(f"{k}_size"))
        both = graph.salted(pairs, busy, ["hub"], "leaf").join(graph.copied(side("hub"), busy, ["hub"]), ["hub", "_salt"]).join(side("leaf"), "leaf")
        pairs = both.where(likely("hub_sketch", "leaf_sketch", "hub_size", "leaf_size")).select("hub", "leaf")
        pairs = spill.write(pairs.withColumn("part", X.shard_column(shards, "leaf")), "likely")
        wants = pairs.select(X.shard_column(shards, "hub").alias("own"), "hub", F.col("part").alias("target")).distinct()
        mail = sets.groupBy("part").cogroup(wants.groupBy("own")).applyInArrow(_post, _MAIL)
        mail = mail.unionByName(pairs.select("part", "hub", "leaf", F.lit(None).cast("binary").alias("payload")))
        return spill.write(sets.groupBy("part").cogroup(mail.groupBy("part")).applyInArrow(_verify(percent, 100), "a long, b long"), "links")

    small = met.where(F.col("n") <= SMALL)
    pairs = small.select("band", F.col("node").alias("hub")).join(small.select("band", F.col("node").alias("leaf")), "band").where("hub < leaf").select("hub", "leaf")
    large = met.where(F.col("n") > SMALL)
    if large.isEmpty():
        return verified(pairs.distinct())
    inside = spill.write(large.select(F.col("node").alias("id")).distinct(), "inside")
    own = graph.only(sets, inside, "id").select("id", "payload")
    entries = own.mapInArrow(_elements(buckets, ["id"]), X.BLOB)
    rare = X.by_bucket(X.by_bucket(entries, buckets, _rare(shards)), shards, _summed, "id long, n_rare long")
    stats = spill.write(
        inside.join(rare, "id", "left").join(nodes.select(F.col("node").alias("id"), "n_shingles", "registers"), "id").select(F.col("id").alias("node"), "n_shingles", F.coalesce("n_rare", F.lit(0)).alias("n_rare"), "registers"), "inside-stats"
    )
    rank = F.struct(F.col("n_rare") / F.col("n_shingles"), F.col("node"))
    hubs = spill.write(large.select("band", "node").join(stats.drop("registers"), "node").groupBy("band").agg(F.min_by("node", rank).alias("hub")), "hubs")
    stars = large.select("band", "_salt", "node").join(graph.copied(hubs, hot, ["band"]), ["band", "_salt"]).where("hub <> node").select("hub", F.col("node").alias("leaf"))
    first = verified(pairs.unionByName(stars).select(F.least("hub", "leaf").alias("x"), F.greatest("hub", "leaf").alias("y"), "hub", "leaf").dropDuplicates(["x", "y"]).select("hub", "leaf"))
    comp = graph.components(first)
    entries = own.join(comp.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "payload", F.coalesce("component", "id").alias("component")).mapInArrow(_elements(buckets, ["id", "component"]), X.BLOB)
    sharing = X.by_bucket(X.by_bucket(entries, buckets, _sharing(shards)), shards, _as_pairs, "hub long, leaf long")
    # Pairs that share no rare element: these lie outside the intersection and bound the similarity from above.
    may = stats.where((F.col("n_shingles") - F.col("n_rare")) * 100 >= F.col("n_shingles") * percent).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = large.select("band", "_salt", "node").join(may.drop("registers"), "node")
    split = open_.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
    hub_comp = hubs.join(split, "band").join(comp.select(F.col("node").alias("hub"), "component"), "hub", "left").select("band", F.coalesce("component", "hub").alias("main"))
    open_ = spill.write(open_.join(graph.copied(hub_comp, hot, ["band"]), ["band", "_salt"]).select("band", "node", "n_shingles", "n_rare", "component", (F.col("component") != F.col("main")).alias("mine")), "open")
    counts = open_.groupBy("band").agg(F.count(F.when(F.col("mine"), 1)).alias("n_mine"), F.count(F.lit(1)).alias("n_all"))
    blocks = open_.join(F.broadcast(counts) if counts.count() <= graph.SMALL else counts, "band")
    blocks = blocks.withColumn("rows", F.ceil(F.col("n_mine") / BLOCK).cast("int")).withColumn("columns", F.ceil(F.col("n_all") / OTHERS).cast("int"))
    blocks = blocks.select("band", "node", "component", "mine", "rows", "columns")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = blocks.where("mine").withColumn("i", F.pmod(F.hash("node"), F.col("rows"))).withColumn("j", each("columns"))
    others = blocks.withColumn("mine", F.lit(False)).withColumn("i", each("rows")).withColumn("j", F.pmod(F.hash("node"), F.col("columns")))
    work = mine.unionByName(others).drop("rows", "columns").join(stats, "node")
    rest = work.groupBy("band", "i", "j").applyInArrow(_rest(percent / 100), "hub long, leaf long")
    return first.unionByName(verified(rest.unionByName(sharing).distinct()))


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
