"""Byte-pair training on one unbroken stream of bytes: no pre-tokenizer, so pairs go across every border.

The stream is a table of ranges of consecutive tokens. A round takes several merges that cannot influence each other (see bpe_train.py), each range does them
by itself, and what lies across the border of two ranges is stitched: a border is known by the last token of one range and the first of the next one
that is not empty, and a run of one token (``aaaa`` merges in twos from its beginning) hands on whether its last token is still alone. Borders
are the driver's: ranges grow with the stream, so there are about MOST of them at most (a few dozen bytes each). Pairs are counted by range, added up
distributed, and only the head of their ranking is collected. Ties go to the pair that comes first in the stream. Tasks bring the
ranges up to date by the rounds since they were stored; they are stored anew every FOLD rounds only.

The texts are shuffled once, into parts that are in order of the key; a part is cut into ranges by itself, so no text is placed by a sum over those before it.
Ranges are compressed by the Python workers, one by one: what Spark reads, batches and writes for them are about half a byte a token,
and a worker holds one range as numbers at a time.

Defined cases: null and empty texts add nothing; texts follow each other in order of an integer key, which must be distinct; fewer than two tokens end the training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.shared import drop, keep

from .bpe_train import HEAD, independent

BYTES = 256
#: Bytes of a range at least, and ranges at most.
RANGE, MOST = 1 << 18, 1 << 20
#: Bytes of a part, about.
PART = 1 << 24
#: Bytes of stored ranges that a task hands on together.
HANDED = 1 << 20
#: How a range is compressed.
CODEC = "zstd"
#: Rounds after which the ranges are stored with the merges done.
FOLD = 2
#: Pairs of tokens up to which a task counts in an array of all of them.
DENSE = 1 << 22
MADE = "kind int, no long, ids binary, pair long, total long, at long, first long, last long, tail long, n long"


def code_for(n: int) -> str:
    """The integers that hold ids after n merges."""
    return "<u2" if BYTES + n <= 1 << 16 else "<i4"


def parts(df: DataFrame, key: str, text: str, total: int) -> DataFrame:
    """(raw): the texts' bytes in parts, in order of key from part to part and in each of them. Long texts are rows of RANGE bytes."""
    raw = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("raw")).where("octet_length(raw) > 0")
    piece = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / RANGE).cast("int")), lambda i: F.struct(i.alias("i"), F.substring("raw", i * RANGE + 1, F.lit(RANGE)).alias("raw")))
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // PART))
    return raw.select("key", F.explode(piece).alias("p")).select("key", "p.*").repartitionByRange(n, "key", "i").sortWithinPartitions("key", "i").select("raw")


def train(df: DataFrame, key: str, n: int, text: str = "text", size: int | None = None) -> list[tuple[int, int]]:
    """The first n merges (fewer if no pair is left) of the texts as one stream."""
    merges: list[tuple[int, int]] = []
    if n <= 0:
        return merges
    spark = df.sparkSession
    code, tokens = code_for(n), (BYTES + n) * ((BYTES + n) ** 2 <= DENSE)
    total = int(df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0)
    size = size or max(RANGE, -(-total // MOST))
    stored = made = keep(parts(df, key, text, total).mapInArrow(_first(size, code, tokens), MADE), "stream-bpe", codec="snappy")
    steps: list[tuple[dict, dict]] = []  # the rounds that the stored ranges lack
    while len(merges) < n:
        edges = [tuple(r) for r in made.where("kind = 0 AND n > 0").select("no", "n", "first", "last", "tail").orderBy("no").collect()]
        batch = _next(spark, made, edges, n - len(merges))
        if not batch:
            break
        new = {p: BYTES + len(merges) + k for k, p in enumerate(batch)}
        merges += [(p >> 32, p & 0xFFFFFFFF) for p in batch]
        if len(merges) == n:
            break
        steps.append((new, stitched(edges, new)))
        fold = len(steps) == FOLD
        after = keep(stored.where("kind = 0").select("no", "n", "ids").mapInArrow(_round(list(steps), code, tokens, fold), MADE), "stream-bpe", codec="snappy")
        if made is not stored:
            drop(made)
        if fold:
            drop(stored)
            stored, steps = after, []
        made = after
    if made is not stored:
        drop(stored)
    drop(made)
    return merges


def _next(spark, made: DataFrame, edges: list[tuple], most: int) -> list[int]:
    """The pairs of the next round, in order."""
    across = [(a[3] << 32 | b[2], 1, a[0], a[1] - 1) for a, b in zip(edges, edges[1:], strict=False)]
    pairs = made.where("kind = 1").select("pair", "total", "no", "at")
    if across:
        pairs = pairs.unionByName(spark.createDataFrame(across, "pair long, total long, no long, at long"))
    ranking = pairs.groupBy("pair").agg(F.sum("total").alias("total"), F.min(F.struct("no", "at")).alias("first")).orderBy(F.desc("total"), "first").limit(HEAD + 1).collect()
    head = [(r["pair"], r["total"]) for r in ranking]
    if len(head) > HEAD:  # of pairs as frequent as the last, there may be more
        whole = [x for x in head if x[1] > head[-1][1]]
        if not whole:
            return [head[0][0]]
        head = whole
    return independent(head, most, head)


def stitched(edges: list[tuple], new: dict[int, int]) -> dict[int, tuple[bool, int]]:
    """Of ranges (no, n, first, last, tail: how often the last token ends them) in order: those whose first token is merged into the range before, and the id
    that takes the last token's place (-1: none)."""
    drops, lasts = set(), {}
    before, token, alone = None, -1, False  # the last token so far, and whether it ends an odd run
    for no, n, first, last, tail in edges:
        made = new.get(token << 32 | first) if before is not None else None
        taken = made is not None and (token != first or alone)
        if taken:
            drops.add(no)
            lasts[before] = made
            if n == 1:
                token, alone = made, False
                continue
            tail -= tail == n
        before, token, alone = no, last, tail % 2 == 1
    return {no: (no in drops, lasts.get(no, -1)) for no in drops | set(lasts)}


def merged(ids: np.ndarray, new: dict[int, int], table: np.ndarray | None = None, tokens: int = 0) -> np.ndarray:
    """All merges of a round on one range. table: of made_of(), with the number of tokens; pairs are looked up in it instead."""
    if len(ids) < 2 or not new:
        return ids
    if table is not None:
        found = table.take(codes_of(ids, tokens))
        at = np.flatnonzero(found != 0)
        made = found[at]
    else:
        codes = ids[:-1].astype(np.int64) << 32 | ids[1:]
        keys = np.array(sorted(new), np.int64)
        k = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        at = np.flatnonzero(keys[k] == codes)
        made = np.array([new[int(x)] for x in keys], ids.dtype)[k[at]]
    if not len(at):
        return ids
    if any(p >> 32 == p & 0xFFFFFFFF for p in new):  # of each run, the pairs from its beginning
        twice = np.flatnonzero(ids[at] == ids[at + 1])
        if len(twice):
            own = at[twice]
            start = np.append(True, own[1:] != own[:-1] + 1)
            offset = np.arange(len(own)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            some = np.ones(len(at), bool)
            some[twice[offset % 2 == 1]] = False
            at, made = at[some], made[some]
    out = ids.copy()
    out[at] = made
    stays = np.ones(len(ids), bool)
    stays[at + 1] = False
    return out[stays]


def codes_of(ids: np.ndarray, tokens: int) -> np.ndarray:
    """The pairs as places of an array of all of them."""
    codes = ids[:-1].astype(np.intp)
    codes *= tokens
    codes += ids[1:]
    return codes


def made_of(new: dict[int, int], tokens: int, code: str) -> np.ndarray | None:
    """What each pair becomes in a round (0: nothing), if pairs are looked up in an array."""
    if not tokens:
        return None
    table = np.zeros(tokens * tokens, code)
    for p, made in new.items():
        table[(p >> 32) * tokens + (p & 0xFFFFFFFF)] = made
    return table


class Counts:
    """Pairs of the ranges of a task: their number and first place. tokens: how many there are, if pairs of them are to be counted in an array, else 0."""

    def __init__(self, tokens: int):
        self.tokens = tokens
        if tokens:
            self.total, self.no, self.at = (np.full(tokens * tokens, x, np.int64) for x in (0, np.iinfo(np.int64).max, 0))
        self.other: dict[int, list[int]] = {}

    def add(self, no: int, ids: np.ndarray) -> None:
        if not self.tokens:
            pairs, at, n = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_index=True, return_counts=True)
            for p, i, k in zip(pairs.tolist(), at.tolist(), n.tolist(), strict=True):
                own = self.other.setdefault(p, [0, no, i])
                own[:] = own[0] + k, *min((own[1], own[2]), (no, i))
            return
        codes = codes_of(ids, self.tokens)
        here = np.bincount(codes, minlength=len(self.total))
        self.total += here
        first = (here > 0) & (no < self.no)
        if first.any():
            place = np.flatnonzero(first.take(codes))[::-1]
            self.at[codes[place]] = place  # the last one that is written is the first one
            self.no[first] = no

    def rows(self) -> list[np.ndarray]:
        """Columns: pair, number, range, place."""
        if not self.tokens:
            return list(np.array([(p, *x) for p, x in self.other.items()], np.int64).reshape(-1, 4).T)
        some = np.flatnonzero(self.total)
        return [some // self.tokens << 32 | some % self.tokens, self.total[some], self.no[some], self.at[some]]


def _first(size: int, code: str, tokens: int):
    """A part as ranges of size bytes; what it yields is that of _round()."""

    def run(batches):
        low, rest = TaskContext.get().partitionId() << 32, []

        def cut() -> Iterator[tuple[int, np.ndarray]]:
            nonlocal low, rest
            for b in batches:
                for raw in b.column("raw"):
                    rest.append(np.frombuffer(raw.as_buffer(), np.uint8))
                if sum(map(len, rest)) >= size:
                    held = np.concatenate(rest)
                    for at in range(0, len(held) - size + 1, size):
                        yield low, held[at : at + size].astype(code)
                        low += 1
                    rest = [held[len(held) // size * size :].copy()]
                else:
                    rest = [np.concatenate(rest)] if rest else []
            if sum(map(len, rest)):
                yield low, np.concatenate(rest).astype(code)

        yield from _told(cut(), tokens, True)

    return run


def _round(steps: list[tuple[dict[int, int], dict[int, tuple[bool, int]]]], code: str, tokens: int, store: bool):
    """Ranges after the merges of some rounds (kind 0, with their edges; the ids if they are to be stored), and their pairs (kind 1: number, first range and place, one row for each pair and task)."""

    def run(batches):
        tables = [made_of(new, tokens, code) for new, _ in steps]

        def brought() -> Iterator[tuple[int, np.ndarray]]:
            for b in batches:
                for no, n, raw in zip(b.column("no").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
                    ids = np.frombuffer(pa.decompress(raw.as_buffer(), n * np.dtype(code).itemsize, CODEC) if n else b"", code)
                    for (new, borders), table in zip(steps, tables, strict=True):
                        dropped, last = borders.get(no, (False, -1))
                        ids = merged(ids[1:] if dropped else ids, new, table, tokens)
                        if last >= 0:
                            ids = np.append(ids[:-1], np.array(last, code))
                    yield no, ids

        yield from _told(brought(), tokens, store)

    return run


def _told(ranges: Iterator[tuple[int, np.ndarray]], tokens: int, store: bool) -> Iterator[pa.RecordBatch]:
    """Rows of ranges, and then of their pairs."""
    counts, rows, held = Counts(tokens), [], 0
    for no, ids in ranges:
        if len(ids) > 1:
            counts.add(no, ids)
        edge = (int(ids[0]), int(ids[-1]), _tail(ids), len(ids)) if len(ids) else (-1, -1, 0, 0)
        raw = pa.compress(np.ascontiguousarray(ids), CODEC, asbytes=True) if store and len(ids) else b"" if store else None
        rows.append((no, raw, *edge))
        held += len(raw or b"") + 256
        if held > HANDED:
            yield _edges(rows)
            rows, held = [], 0
    yield _edges(rows)
    pairs, total, no, at = (pa.array(x, pa.int64()) for x in counts.rows())
    yield _batch(1, len(pairs), no=no, pair=pairs, total=total, at=at)


def _tail(ids: np.ndarray) -> int:
    """How often the last token ends them."""
    near = np.flatnonzero(ids[-64:] != ids[-1])
    if len(near):
        return min(len(ids), 64) - 1 - int(near[-1])
    other = np.flatnonzero(ids != ids[-1])
    return len(ids) - (int(other[-1]) + 1 if len(other) else 0)


def _edges(rows: list[tuple]) -> pa.RecordBatch:
    names = ("no", "ids", "first", "last", "tail", "n")
    return _batch(0, len(rows), **{c: pa.array([r[i] for r in rows], pa.binary() if c == "ids" else pa.int64()) for i, c in enumerate(names)})


def _batch(kind: int, rows: int, **columns: pa.Array) -> pa.RecordBatch:
    """A batch of MADE; what is not given is null."""
    names = [c.split()[0] for c in MADE.split(", ")]
    given = columns | {"kind": pa.array(np.full(rows, kind), pa.int32())}
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(rows, pa.binary() if c == "ids" else pa.int64()) for c in names], names=names)
