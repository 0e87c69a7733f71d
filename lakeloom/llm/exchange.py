"""Packed exchanges: hashed entries travel as sorted arrays in a few binary rows, not as a row each.

``buckets`` split the hash space evenly, so a bucket holds a bounded share of the *distinct* hashes
whatever the keys' skew: a task sends each (hash, document) once, and one hot hash adds one small
entry for each document that has it. ``shards`` split documents by a hash of their id. Both counts
follow the size of the input, so each group stays a few megabytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
BLOB = "part int, payload binary"
BLOB_ARROW = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
FLUSH = 1 << 21


def text_size(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text (one cheap scan)."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def parts(spark: SparkSession, size: int, each: int) -> int:
    """Groups for an exchange of `size` bytes with about `each` bytes in a group: at least one for every shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)


BITS = 255


def put(columns: list[np.ndarray]) -> bytes:
    """Integer arrays of equal length as one byte string: each from its least value, in as few bytes as it needs, or in bits."""
    n = len(columns[0])
    out = [np.array([n, len(columns)], "<u8").tobytes()]
    for c in columns:
        c = c.astype(np.int64).view(_U) if c.dtype != _U else c
        low = c.min() if n else _U(0)
        c = c - low
        width = (int(c.max()).bit_length() + 7) // 8 if n else 0
        if width == 1 and c.max() == 1:
            out += [np.array([int(low), BITS], "<u8").tobytes(), np.packbits(c.astype(bool)).tobytes()]
            continue
        out.append(np.array([int(low), width], "<u8").tobytes())
        out.append(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes())
    return b"".join(out)


def get(blob: bytes) -> list[np.ndarray]:
    """The arrays of put(), as uint64."""
    n, k = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    at, out = 16, []
    for _ in range(k):
        low, width = (int(x) for x in np.frombuffer(blob, "<u8", 2, at))
        at += 16
        if width == BITS:
            size = -(-n // 8)
            out.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=n).astype(_U) + _U(low))
            at += size
            continue
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        out.append(full.reshape(-1).view("<u8").astype(_U) + _U(low))
    return out


def put_keys(keys: np.ndarray) -> bytes:
    """Ascending different uint64 keys as Rice-coded gaps: about the logarithm of the mean gap and 1.5 bits each."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    n = len(gaps)
    low = max(0, int(gaps.mean()).bit_length() - 1) if n else 0
    ends = np.cumsum((gaps >> _U(low)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, bool)
    unary[ends - 1] = True
    rest = np.unpackbits(gaps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - low :]
    return np.array([n, low, len(unary), keys[0]], "<u8").tobytes() + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def get_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, _U)
    n, low, size, first = (int(x) for x in np.frombuffer(blob, "<u8", 4))
    a = 32 + -(-size // 8)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, a - 32, 32), count=size)) + 1
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - low :] = np.unpackbits(np.frombuffer(blob, np.uint8, -(-n * low // 8), a), count=n * low).reshape(n, low)
    out = np.full(n + 1, first, _U)
    out[1:] += np.cumsum((np.diff(ends, prepend=0) - 1).astype(_U) * _U(1 << low) + np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(_U))
    return out


def squeeze(columns: list[np.ndarray]) -> bytes:
    """Integer arrays with mostly small values as one byte string: byte plane by byte plane, deflated."""
    out = [len(columns).to_bytes(8, "little")]
    for c in columns:
        c = c.astype(np.int64).view(_U) if c.dtype != _U else c
        low = int(c.view(np.int64).min()) if len(c) else 0
        c = c - _U(low % (1 << 64))
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        data = zlib.compress(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)
        out += [np.array([len(c), low, width, len(data)], "<i8").tobytes(), data]
    return b"".join(out)


def stretch(blob: bytes) -> list[np.ndarray]:
    """The arrays of squeeze(), as uint64."""
    at, out = 8, []
    for _ in range(int.from_bytes(blob[:8], "little")):
        n, low, width, size = (int(x) for x in np.frombuffer(blob, "<i8", 4, at))
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(zlib.decompress(blob[at + 32 : at + 32 + size]), np.uint8).reshape(width, n).T
        out.append(full.reshape(-1).view("<u8").astype(_U) + _U(low % (1 << 64)))
        at += 32 + size
    return out


def get_all(blobs: Iterable[bytes], k: int) -> list[np.ndarray]:
    """All blobs' columns, one after the other."""
    got = [get(b) for b in blobs]
    return [np.concatenate([g[i] for g in got]) if got else np.zeros(0, _U) for i in range(k)]


def rows(blobs: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    blobs = list(blobs)
    return pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary())], schema=BLOB_ARROW)


def dealt(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """A blob for each part; sorted by part, then by the first column."""
    if not len(part):
        return
    first = columns[0]
    order = np.argsort(part, kind="stable") if (first[1:] >= first[:-1]).all() else np.lexsort((first, part))
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
        yield int(part[a]), put([c[a:b] for c in columns])


_SPREAD = _U(0x9E3779B97F4A7C15)


def spread(h: np.ndarray) -> np.ndarray:
    """A bijection of hashes that spreads them evenly, also where only small ones are left (as the least ones of windows are)."""
    return h * _SPREAD


def dealt_in_order(g: np.ndarray, columns: list[np.ndarray], n: int) -> Iterator[tuple[int, bytes]]:
    """A blob for each of n buckets of ascending spread() values g; columns go with g."""
    part = ((g >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(g)], strict=True) if len(g) else ():
        yield int(part[a]), put([g[a:b], *(c[a:b] for c in columns)])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Even shares of hashes, also where only small hashes are left (as the least ones of windows are)."""
    return ((spread(h) >> _U(32)) * _U(n) >> _U(32)).astype(np.int32)


def _murmur(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of a long, as int32."""
    u = np.uint32

    def turn(v, k):
        return (v << u(k)) | (v >> u(32 - k))

    h = np.full(len(x), 42, u)
    for half in ((x & _U(0xFFFFFFFF)).astype(u), (x >> _U(32)).astype(u)):
        k = turn(half * u(0xCC9E2D51), 15) * u(0x1B873593)
        h = turn(h ^ k, 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32)


def shard_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The shard of document ids; the same as shard_column()."""
    return np.mod(_murmur(ids.astype(np.int64).view(_U)).astype(np.int64), n).astype(np.int32)


def shard_column(n: int, id_column: str = "doc_id"):
    return F.pmod(F.hash(F.col(id_column).cast("long")), F.lit(n)).cast("int")


def sharded(docs: DataFrame, n: int, id_column: str = "doc_id", text: str = "text", row=None) -> DataFrame:
    """(part, id, text, and row if given) for a cogroup by shard. Spark exchanges it once for all cogroups of one plan."""
    more = [] if row is None else [row.alias("row")]
    return docs.select(shard_column(n, id_column).alias("part"), F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"), *more)


def by_bucket(entries: DataFrame, n: int, fn, schema: str = BLOB) -> DataFrame:
    """fn(table of one bucket's blobs) -> table; the bucket's rows come from all tasks."""
    return entries.groupBy("part").applyInArrow(fn, schema)


def by_shard(docs: DataFrame, replies: DataFrame, fn, schema: str) -> DataFrame:
    """fn(one shard's documents, its replies) -> table."""
    return docs.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(fn, schema)


def blob_table(blobs: Iterable[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([rows(blobs)])
