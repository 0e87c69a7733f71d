"""Trie of conversation prefixes, from chained cryptographic digests.

The digest of a prefix of d turns is SHA-256 of the digest of d - 1 turns and the d-th turn's own digest, so equal digests at a
depth are equal prefixes. Every prefix of every conversation is a row (the empty one is the root), and the rows with one (depth,
digest) are a node, grouped with partial aggregates, so that a prefix which very many conversations share is no hot group.

Sums over subtrees: each node tells what it has to all its ancestors. A node belongs to its smallest member; the nodes of one member
are the end of its path, so what they tell is summed along that path first, and an ancestor gets a row for each such path instead of one for
each node below it (which would be quadratic in the depth). A node is a leaf if all its members end in it.

Texts are digested where they are read and never shuffled. A conversation is chained turn by turn from sorted rows with one digest held, and the hash
over the members that end in a node is fed from sorted blocks of ids, so neither a long conversation nor a prefix with any number of
members is ever held as a whole; the rows of one conversation (about 100 bytes a turn) go through one task, since a chain is sequential.

Defined cases: a null role or text is empty; turns are in order of ``turn``, null first, ties by role, then by the SHA-256 of the text;
repeated rows are repeated turns; rows with a null conversation id belong to no conversation and are left out; other
columns are ignored; an empty table gives an empty result (no conversation, no root).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import spill

ROOT = hashlib.sha256(b"").digest()
EMPTY = hashlib.sha256(b"").hexdigest()
#: Ids in a block of a node's members.
BLOCK = 256
#: A parent with more children than this (or than a 65,536th of all nodes) is looked up by broadcast.
HOT, HOT_KEYS = 256, 1 << 16


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, chars) of each turn: at counts from 1 within the conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sized = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("own"), F.unhex(F.sha2(sized, 256)).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "own")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("at"), "digest", "chars")


def rebuilt(own: DataFrame, shared, base) -> DataFrame:
    """Turns of conversations that begin with turns of another: the first `shared` turns (a column of conv_id, at most 5) of conversation `base` (a
    column of conv_id), all if it has fewer and none if it is absent, then the own turns after the first `shared`. A conversation of which no turn is left
    keeps a row with at = null."""
    head = own.where(F.col("at") <= 5).where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), "at", "digest", "chars")
    ids = own.where("at = 1").select("conv_id")
    given = ids.select("conv_id", base.alias("base"), shared.cast("long").alias("shared")).join(head, "base").where("at <= shared").select("conv_id", "at", "digest", "chars")
    rest = own.where(F.col("at") > shared)
    none = ids.select("conv_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    return none.unionByName(given).unionByName(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars, ends): every prefix of every conversation of rows (conv_id, at, digest, chars), the empty one too.
    A row with at = null only says that the conversation is there."""
    kind = "conv_id long, depth long, node binary, parent binary, chars long, ends boolean"

    def run(batches):
        conv, depth, node = None, 0, ROOT
        held = None  # the last row so far, which ends its conversation if no row of that follows
        for b in batches:
            out = []
            for c, d, n in zip(b.column("conv_id").to_pylist(), b.column("digest").to_pylist(), b.column("chars").to_pylist(), strict=True):
                if c != conv:
                    if held:
                        out.append((*held, True))
                    conv, depth, node = c, 0, ROOT
                    held = (c, 0, ROOT, None, 0)
                if d is not None:
                    out.append((*held, False))
                    parent, depth, node = node, depth + 1, hashlib.sha256(node + d).digest()
                    held = (c, depth, node, parent, n)
            yield _batch(out)
        if held:
            yield _batch([(*held, True)])

    given = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("at")).select("conv_id", "digest", "chars")
    return given.mapInArrow(run, kind)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "depth", "node", "parent", "chars", "ends"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def member_hashes(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) from (depth, node, conv_id): the ids in numerical order, comma-joined. Ids are packed into blocks of at most BLOCK, which
    one streaming pass over the sorted blocks hashes."""
    blocks = ends.groupBy("depth", "node", F.floor(F.col("conv_id") / BLOCK).cast("long").alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for d, n, ids in zip(b.column("depth").to_pylist(), b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if (d, n) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d, n), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _hashes(out)
        if key:
            yield _hashes([(*key, sha.hexdigest())])

    return blocks.repartition("depth", "node").sortWithinPartitions("depth", "node", "block").select("depth", "node", "ids").mapInArrow(run, "depth long, node binary, ends_sha256 string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["depth", "node", "ends_sha256"])


def _parents(nodes: DataFrame, sums: DataFrame) -> DataFrame:
    """(depth, node, parent_conv_id) of all nodes but the root."""
    total = nodes.count()
    below = nodes.where("depth > 0")
    # the parent of most nodes has the same smallest member; the others are the first of their member's own nodes
    named = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hot = sums.where(F.col("n_children") > max(HOT, total // HOT_KEYS)).select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    hot_named = spill.write(named.join(F.broadcast(hot), ["depth", "parent"]), "trie-hot")
    keys = ["depth", "parent"]
    return (
        below.join(F.broadcast(hot_named), keys).select("depth", "node", "parent_conv_id")
        .unionByName(below.join(F.broadcast(hot_named), keys, "left_anti").join(named, keys).select("depth", "node", "parent_conv_id"))
    )


def trie(rows: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations in rows (see prefixes()): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and node, its digest."""
    paths = spill.write(prefixes(rows), "trie-prefixes")
    key = ["depth", "node"]
    grouped = paths.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count_if("ends").alias("n_ends"), F.min("parent").alias("parent"), F.min("chars").alias("chars"))
    nodes = spill.write(grouped, "trie-nodes")
    leaf, saved = (F.col("n_ends") == F.col("n_convs")).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    # what a member's own nodes tell, summed from the end of its path
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), leaf.alias("leaf"), saved.alias("saved"))
    path = paths.select("conv_id", "depth", "node", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    onward = W.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(W.unboundedPreceding, 0)
    told = path.unionByName(own).select("depth", "node", F.sum("leaf").over(onward).alias("leaves"), F.sum("saved").over(onward).alias("saved")).where("node IS NOT NULL AND (leaves > 0 OR saved > 0)")
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node"))
    none = F.lit(0).cast("long")
    given = told.withColumn("children", none).unionByName(children.select(*key, none.alias("leaves"), none.alias("saved"), F.lit(1).cast("long").alias("children")))
    sums = spill.write(given.groupBy(*key).agg(F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "trie-sums")
    ends = member_hashes(paths.where("ends").select(*key, "conv_id"))
    whole = nodes.join(sums, key).join(_parents(nodes, sums), key, "left").join(ends, key, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "node")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of conversation conv_id - conv_id % 100; their number is crc32(conv_id as text) % 6."""
    own = spill.write(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    return trie(rebuilt(own, shared, base)).drop("node")
