"""Token streams: global positions, train and validation parts, fixed-size blocks and batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeloom.errors import DataLoaderError

from .ranking import GROUPS, prefix_sum
from .shuffling import shuffled_place

# Bounds of the automatic buffer size.
BUFFER_BATCHES, BUFFER_LEAST, BUFFER_MOST = 500, 10_000, 10_000_000


def token_type(vocab_size: int) -> str:
    """The narrowest unsigned type for ids below vocab_size."""
    for limit, name in ((256, "uint8"), (65535, "uint16"), (4294967295, "uint32")):
        if vocab_size <= limit:
            return name
    raise ValueError(f"no token type for a vocabulary of {vocab_size}")


def split_index(n: int, train_split: float) -> int:
    """First position of the validation part."""
    return int(n * train_split)


def positions(tokens: DataFrame, key: str, ids: str = "token_ids") -> DataFrame:
    """(key, start, n, ids): documents with the global position of their first token, in order of an integer key."""
    sized = tokens.select(key, F.col(ids).alias("ids"), F.size(ids).cast("long").alias("n"))
    return prefix_sum(sized, key, "n", "start")


def long_tokens(placed: DataFrame) -> DataFrame:
    """(pos, token_id) of positions()."""
    return placed.select("start", F.posexplode("ids").alias("_at", "token_id")).select((F.col("start") + F.col("_at")).alias("pos"), "token_id")


def split_tokens(stream: DataFrame, total: int, train_split: float) -> DataFrame:
    """(split, pos, token_id) with positions from 0 in each split."""
    cut = split_index(total, train_split)
    is_train = F.col("pos") < cut
    return stream.select(F.when(is_train, "train").otherwise("val").alias("split"), F.when(is_train, F.col("pos")).otherwise(F.col("pos") - cut).alias("pos"), "token_id")


def split_sizes(placed: DataFrame, total: int, train_split: float) -> DataFrame:
    """(split, n_tokens) of positions(), from documents' places alone."""
    cut = split_index(total, train_split)
    train = F.coalesce(F.sum(F.greatest(F.least(F.lit(cut) - F.col("start"), F.col("n")), F.lit(0))), F.lit(0)).cast("long")
    both = placed.agg(train.alias("train"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("all"))
    return both.select(F.explode(F.array(F.struct(F.lit("train").alias("split"), F.col("train").alias("n_tokens")), F.struct(F.lit("val").alias("split"), (F.col("all") - F.col("train")).alias("n_tokens")))).alias("s")).select("s.*")


def batches(stream: DataFrame, block_size: int, batch_size: int, by: list[str] | None = None) -> DataFrame:
    """(by, batch_id, row, x, y): rows of block_size + 1 consecutive tokens that do not overlap; x without the last, y without
    the first. Incomplete rows and batches are dropped."""
    by = by or []
    width = block_size + 1
    rows = stream.groupBy(*by, F.floor(F.col("pos") / width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "token_id"))).alias("t")).where(F.size("t") == width)
    ids = F.transform("t", lambda x: x["token_id"])
    out = rows.select(*by, F.floor(F.col("block") / batch_size).cast("long").alias("batch_id"), (F.col("block") % batch_size).cast("int").alias("row"), ids.alias("ids"))
    full = out.groupBy(*by, "batch_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == batch_size).drop("_n")
    return out.join(full, [*by, "batch_id"], "left_semi").select(*by, "batch_id", "row", F.slice("ids", 1, block_size).alias("x"), F.slice("ids", 2, block_size).alias("y"))


def batches_of(placed: DataFrame, block_size: int, batch_size: int) -> DataFrame:
    """(batch_id, row, x, y) as batches() gives, straight from positions(): documents are cut at the rows' borders first, so a row moves a few
    arrays instead of one record for each token."""
    width = block_size + 1
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n") - 1) / width)

    def piece(b):
        low = F.greatest(b * width - F.col("start"), F.lit(0))
        high = F.least((b + 1) * width - F.col("start"), F.col("n"))
        return F.struct(b.alias("block"), (F.col("start") + low).alias("at"), F.slice("ids", (low + 1).cast("int"), (high - low).cast("int")).alias("ids"))

    pieces = placed.where("n > 0").select(F.explode(F.transform(F.sequence(first, last), piece)).alias("p")).select("p.*")
    rows = pieces.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("all")).select("block", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids")).where(F.size("ids") == width)
    n = placed.agg(F.sum("n")).first()[0] or 0
    full = epoch_batches(int(n), block_size, batch_size)
    out = rows.select(F.floor(F.col("block") / batch_size).cast("long").alias("batch_id"), (F.col("block") % batch_size).cast("int").alias("row"), "ids").where(F.col("batch_id") < full)
    return out.select("batch_id", "row", F.slice("ids", 1, block_size).alias("x"), F.slice("ids", 2, block_size).alias("y"))


def packed_batches(docs: DataFrame, key: str, raw: Column, block_size: int, batch_size: int, code: str = "u1") -> DataFrame:
    """(batch_id, row, x, y) as batches() gives, from documents in order of an integer key whose tokens are packed in a binary column (numbers of the NumPy type
    `code`). Documents are shuffled once, by ranges of keys; in a range the stream is cut into rows where it lies, and only the pieces at the ranges' ends are put
    together by a second, small shuffle. Null tokens are none; keys must be distinct.
    """
    width, item = block_size + 1, np.dtype(code).itemsize
    rows = docs.select(F.col(key).cast("long").alias("_key"), raw.alias("raw")).withColumn("n", F.floor(F.octet_length("raw") / item).cast("long")).where("n > 0")
    ends = rows.agg(F.min("_key"), F.max("_key")).first()
    if ends[0] is None:
        return docs.sparkSession.createDataFrame([], "batch_id long, row int, x array<int>, y array<int>")
    range_ = F.floor(F.col("_key") / max(256, -(-(ends[1] - ends[0] + 1) // GROUPS))).cast("long")
    sums = rows.groupBy(range_.alias("range")).agg(F.sum("n").alias("_sum"))
    before = sums.select("range", "_sum", F.coalesce(F.sum("_sum").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    known = before.collect()  # at most GROUPS rows
    full = epoch_batches(sum(r["_sum"] for r in known), block_size, batch_size)
    known = docs.sparkSession.createDataFrame([(r["range"], r["_before"]) for r in known], "range long, _before long")
    inside = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("range", range_).withColumn("_inside", inside).join(F.broadcast(known), "range").select((F.col("_before") + F.col("_inside")).cast("long").alias("start"), "raw")

    def cut(pieces: bool):
        def run(batches):
            held, at = np.zeros(0, code), 0  # what has come since the last whole row, and where it begins
            for b in batches:
                starts = b.column("start").to_pylist()
                parts, first = [held], at
                out = []
                size = len(held)
                for start, x in zip(starts, b.column("raw"), strict=True):
                    ids = np.frombuffer(x.as_buffer(), code)
                    if start != first + size:
                        out.append((first, np.concatenate(parts)))
                        parts, first, size = [], start, 0
                    parts.append(ids)
                    size += len(ids)
                data = np.concatenate(parts)
                keep_ = min(len(data), (first + len(data)) % width)
                out.append((first, data[: len(data) - keep_]))
                held, at = data[len(data) - keep_ :], first + len(data) - keep_
                for o in out:
                    yield from _rows_of(*o, width, pieces)
            yield from _rows_of(at, held, width, pieces)

        return run

    schema = "block long, at long, ids array<int>"
    whole = placed.mapInArrow(cut(False), schema).select("block", "ids")
    parts = placed.mapInArrow(cut(True), schema).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("all")).select("block", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids")).where(F.size("ids") == width)
    got = whole.unionByName(parts).where(F.col("block") < full * batch_size)
    return got.select(F.floor(F.col("block") / batch_size).cast("long").alias("batch_id"), (F.col("block") % batch_size).cast("int").alias("row"), F.slice("ids", 1, block_size).alias("x"), F.slice("ids", 2, block_size).alias("y"))


def _rows_of(first: int, data: np.ndarray, width: int, pieces: bool):
    """The whole rows of a part of the stream that begins at position first, or else what is before and after them."""
    head = min(len(data), -first % width)
    n = (len(data) - head) // width
    if not pieces:
        if n:
            block = (first + head) // width + np.arange(n)
            yield _listed(block, block * width, data[head : head + n * width], np.arange(n + 1) * width)
        return
    for a, x in ((first, data[:head]), (first + head + n * width, data[head + n * width :])):
        if len(x):
            yield _listed(np.array([a // width]), np.array([a]), x, np.array([0, len(x)]))


def _listed(block: np.ndarray, at: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(at, pa.int64()), lists], names=["block", "at", "ids"])


def epoch_batches(n: int, block_size: int, batch_size: int) -> int:
    return n // (batch_size * (block_size + 1))


@dataclass(frozen=True)
class LoaderConfig:
    """Sizes of a batch loader; the buffer holds 500 batches within fixed bounds unless it is given."""

    block_size: int
    batch_size: int
    buffer_size: int | None = None

    def __post_init__(self):
        need = self.batch_size * (self.block_size + 1)
        if self.buffer_size is not None and self.buffer_size < need:
            raise DataLoaderError(f"buffer_size must be at least {need}")
        if self.block_size <= 0 or self.batch_size <= 0:
            raise DataLoaderError("block_size and batch_size must be positive")

    @property
    def buffer(self) -> int:
        return self.buffer_size or max(BUFFER_LEAST, min(BUFFER_MOST, BUFFER_BATCHES * self.batch_size * (self.block_size + 1)))


def refill_starts(n: int, buffer: int, need: int, count: int) -> list[list[int]]:
    """Positions of the tokens in each of the first `count` batches of the historic bounded buffer, which drops the oldest tokens
    when a refill overflows and wraps at the end of the data."""
    held: list[int] = []
    pos, out = 0, []
    for _ in range(count):
        while len(held) < need:
            take = min(buffer, n - pos)
            held = (held + list(range(pos, pos + take)))[-buffer:]
            pos = (pos + take) % n
        out.append(held[:need])
        held = held[need:]
    return out


def refill_runs(n: int, buffer: int, need: int, count: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, period) of refill_starts() without its lists. A run is (first batch, batches of a refill, refills, tokens from one refill to
    the next, position of the first token); batch b takes the tokens of batch b mod period. Data that fill the buffer need at most two runs:
    whole refills, which leave nothing of what was held, and the refill that the end of the data cuts short. Smaller data need one for each refill."""
    if n <= 0 < count:
        raise DataLoaderError("no tokens to fill the buffer with")
    if n >= buffer:
        each, (refills, rest) = buffer // need, divmod(n, buffer)
        held = min(buffer % need + rest, buffer) if rest else 0
        runs = [(0, each, refills, buffer, 0)]
        if held >= need:
            runs.append((each * refills, held // need, 1, held, n - held))
        return runs, each * refills + held // need
    runs, b, read, held = [], 0, 0, 0
    while b < count:
        read, held = read + n, min(held + n, buffer)
        if k := min(held // need, count - b):
            runs.append((b, k, 1, k * need, read - held))
            b, held = b + k, held - k * need
    return [(b, k, q, stride, at % n) for b, k, q, stride, at in runs], max(count, 1)


def refill_batches(placed: DataFrame, n: int, config: LoaderConfig, count: int | None = None) -> DataFrame:
    """(batch_id, row, x, y) of the first `count` batches of the historic loader (refill_starts), by default of a whole epoch, from
    positions() of n tokens. Rows are found by arithmetic on each document's positions, so the driver holds no positions."""
    per, width = config.batch_size, config.block_size + 1
    count = epoch_batches(n, config.block_size, per) if count is None else count
    runs, period = refill_runs(n, config.buffer, per * width, count)
    start, end = F.col("start"), F.col("start") + F.col("n")

    def pieces(first, rows, refills, stride, at):
        """Of a document, what is in the rows of a run that begins at position `at`."""
        since = lambda x: F.greatest(x - at, F.lit(-1))
        inside = lambda y: F.least(F.floor(y % stride / width) + 1, F.lit(rows))
        begun = lambda x: F.when(since(x) < 0, F.lit(0)).otherwise(F.least(F.floor(since(x) / stride) * rows + inside(since(x)), F.lit(rows * refills))).cast("long")
        low, high = begun(start - width), begun(end - 1)

        def piece(k):
            own = F.floor(k / rows) * stride + k % rows * width + at
            skip = F.greatest(own - start, F.lit(0))
            size = F.least(own + width, end) - start - skip
            return F.struct((F.floor(k / per) + first).cast("long").alias("b"), (k % per).cast("int").alias("row"), (start + skip - own).cast("long").alias("at"), F.slice("ids", (skip + 1).cast("int"), size.cast("int")).alias("ids"))

        return F.when(high > low, F.transform(F.sequence(low, high - 1), piece))

    found = []
    for b, k, q, stride, at in runs:
        for lap in range((at + (q - 1) * stride + k * per * width - 1) // n + 1):  # a run that goes on over the end of the data meets each document again
            found.append(pieces(b, k * per, q, stride, at - lap * n))
    if not found or count <= 0:
        return placed.sparkSession.createDataFrame([], "batch_id long, row int, x array<int>, y array<int>")
    none = F.array().cast("array<struct<b:bigint,row:int,at:bigint,ids:array<int>>>")
    parts = placed.where("n > 0").select(F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("p")).select("p.*").where(F.col("b") < count)
    rows = parts.groupBy("b", "row").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("all")).select("b", "row", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"))
    again = F.explode(F.sequence(F.col("b"), F.lit(count - 1).cast("long"), F.lit(period).cast("long")))
    return rows.select(again.alias("batch_id"), "row", F.slice("ids", 1, config.block_size).alias("x"), F.slice("ids", 2, config.block_size).alias("y"))


def fraction_split(df: DataFrame, position: str, n: int, train: float = 0.85, test: float = 0.10) -> DataFrame:
    """df with `split`: train, then test, then val, by position."""
    a = int(n * train)
    b = a + int(n * test)
    return df.withColumn("split", F.when(F.col(position) < a, "train").when(F.col(position) < b, "test").otherwise("val"))


def sample_batches(df: DataFrame, position: str, batch_size: int, n: int, drop_last: bool = False, seed: int | None = None) -> DataFrame:
    """df with batch_id and row: batch_size samples in order of position (0 to n - 1), or in a seeded order that each row computes; with drop_last the incomplete
    last batch goes."""
    at = F.col(position).cast("long") if seed is None else shuffled_place(F.col(position).cast("long"), n, seed)
    placed = df.withColumn("_at", at)
    out = placed.withColumn("batch_id", F.floor(F.col("_at") / batch_size).cast("long")).withColumn("row", (F.col("_at") % batch_size).cast("int")).drop("_at")
    return out.where(F.col("batch_id") < n // batch_size) if drop_last else out


def collate(df: DataFrame, batch: str, ids: str, pad: int = 50256, ignore: int = -100, longest: int | None = 1024) -> DataFrame:
    """df with inputs and targets: each sample cut and padded to its batch's length; targets are shifted by one, and every pad after the
    first is ignored. Where longest is None nothing is cut."""
    cut = F.col(ids) if longest is None else F.slice(F.col(ids), 1, longest - 1)
    size = F.max(F.size(cut) + 1)
    size = df.groupBy(batch).agg((size if longest is None else F.least(size, F.lit(longest))).alias("_length"))
    full = F.concat(cut, F.array_repeat(F.lit(pad), F.col("_length") - F.size(cut)))
    joined = df.join(size, batch).withColumn("_full", full)
    target = F.slice("_full", F.lit(2), F.col("_length") - 1)
    out = joined.withColumn("inputs", F.slice("_full", F.lit(1), F.col("_length") - 1)).withColumn("_target", target)
    return out.withColumn("targets", _masked(F.col("_target"), pad, ignore)).drop("_full", "_target", "_length")


def _masked(target: Column, pad: int, ignore: int) -> Column:
    first = F.array_position(target, pad)
    return F.transform(target, lambda v, i: F.when((v == pad) & (i >= first), F.lit(ignore)).otherwise(v))
