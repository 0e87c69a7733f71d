"""Benchmark decontamination by winnowing.

A benchmark item's windows are its runs of `words` consecutive words. Of the k-word grams in such a
window (k = words // 2) only the one with the least hash is a fingerprint, so every window that a
document shares with an item gives the same fingerprint on both sides. The documents' fingerprints
are joined with the benchmark's; where they meet, the hit is extended to whole windows, and these
are compared word by word, so hash collisions do no harm.

The benchmark is read in blocks of about BLOCK bytes of text, by a hash of the item, and the fingerprints of at most TOGETHER blocks are broadcast at
once (64 MB of text). Documents are tested against them in one pass over their texts; nothing is shuffled. For a larger benchmark the documents and
what was found so far (a bit for each word, and the items) are written, and tested against the next blocks, so memory does not grow with it.

Defined cases: null texts and texts without words hit nothing; items without words are ignored; items with a null id hit like others, but are
not counted or named; an item of fewer words than the window is one window; rows with one item id count as one
item; each document row is judged by itself, whatever its id; texts of any length are tested in pieces that overlap; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import spill
from . import textkit as K

_U = np.uint64
BLOCK, TOGETHER = 16 << 20, 4
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _least(h: np.ndarray, at: np.ndarray, place: np.ndarray, span: int) -> np.ndarray:
    """Least hash of the span grams that start at each of `at`."""
    first = place[at]
    out = h[first].copy()
    for k in range(1, span):
        np.minimum(out, h[first + k], out=out)
    return out


def _winnow(w: K.Words, k: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The words-long windows' starts and their fingerprints."""
    at, h = w.windows(k)
    wide, _ = w.windows(words)
    place = np.zeros(len(w.starts) + 1, np.int64)
    place[at] = np.arange(len(at))
    return wide, _least(h, wide, place, words - k + 1) if len(wide) else np.zeros(0, _U)


class Index:
    """One block of the benchmark: sorted fingerprints, and the windows (hash, item, place) of each length."""

    def __init__(self, items: list[tuple[str | None, str]], words: int = 10):
        self.words, self.k = words, max(1, words // 2)
        self.names = [i for i, _ in items]
        w = K.Words([t.encode() for _, t in items], K.ALNUM_WORD, lower=True)
        self.data, self.starts, self.ends = w.data, w.starts, w.ends
        of = w.text_of()
        wide, prints = _winnow(w, self.k, words)
        self.prints = np.unique(prints)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self._add(words, wide, w.windows(words)[1], of[wide])
        counts = w.counts
        for n in np.unique(counts[(counts > 0) & (counts < words)]):
            which = np.flatnonzero(counts == n)
            self._add(int(n), w.first[which], w.whole(which), which)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.prints >> _U(44)).astype(np.int64)] = True

    def _add(self, n, at, h, item):
        if len(at):
            order = np.argsort(h, kind="stable")
            self.by_length[n] = (h[order], item[order], at[order])

    def scan(self, texts: list[bytes]):
        """(words, start of each text's words, mask of hit words, {text: items})."""
        w = K.Words(texts, K.ALNUM_WORD, lower=True)
        hits, items = np.zeros(len(w.starts), bool), {}
        of = w.text_of()
        for n, (known, item, place) in self.by_length.items():
            if n == self.words:
                at, prints = _winnow(w, self.k, n)
                new = self.filter[(prints >> _U(44)).astype(np.int64)]
                at, prints = at[new], prints[new]
                slot = np.searchsorted(self.prints, prints)
                slot[slot == len(self.prints)] = 0
                at = at[self.prints[slot] == prints]
                if not len(at):
                    continue
                all_at, h = w.windows(n)
                h = h[np.searchsorted(all_at, at)]
            else:
                at, h = w.windows(n)
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            for i in np.flatnonzero(high > low):
                a = int(at[i])
                own = [w.data[w.starts[j] : w.ends[j]].tobytes() for j in range(a, a + n)]
                for j in range(low[i], high[i]):
                    p = int(place[j])
                    if own == [self.data[self.starts[q] : self.ends[q]].tobytes() for q in range(p, p + n)]:
                        hits[a : a + n] = True
                        if self.names[item[j]] is not None:
                            items.setdefault(int(of[a]), set()).add(self.names[item[j]])
        return w, hits, items


def blocks(benchmark: DataFrame, words: int = 10, id_column: str = "item_id", text: str = "text", block: int | None = None) -> Iterator[Index]:
    """The benchmark's blocks, one after the other."""
    given = benchmark.where(F.col(text).isNotNull()).select(F.col(id_column).cast("string").alias("i"), F.col(text).alias("t"))
    _, size = X.text_size(given, "t")
    n = max(1, -(-size // (block or BLOCK)))
    for b in range(n):
        rows = (given if n == 1 else given.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)).collect()
        yield Index([(r["i"], r["t"]) for r in rows], words)


def _marks(indexes: list[Index], group: list[bytes], words: int) -> Iterator[tuple[np.ndarray, set[str]]]:
    """For each text of a group of runs(): the mask of its hit words, and its items."""
    whole, named, carried = [], set(), np.zeros(0, bool)
    for part, cut in K.pieces(group, K.ALNUM_WORD, words - 1, lower=True):
        hits, items, w = None, [set() for _ in part], None
        for ix in indexes:
            w, own, found = ix.scan(part)
            hits = own if hits is None else hits | own
            for i, names in found.items():
                items[i] |= names
        if cut is None:
            for i, names in enumerate(items):
                yield hits[w.first[i] : w.first[i + 1]], names
            return
        hits[: len(carried)] |= carried
        own = int(np.searchsorted(w.starts, cut))
        whole.append(hits[:own])
        carried, named = hits[own:], named | items[0]
    yield np.concatenate(whole), named


def _judge(indexes: list[Index], texts: Iterable[bytes], words: int) -> Iterator[tuple[np.ndarray, set[str]]]:
    for _, group in K.runs(texts):
        yield from _marks(indexes, group, words)


_FOUND = "id long, text string, hits binary, items array<string>"


def _tested(docs: DataFrame, benchmark: DataFrame, words: int, finish, schema: str) -> DataFrame:
    """finish(ids, [(mask, items)]) -> record batch, of all rows of docs (id, text). Written between the passes of a benchmark that needs several."""
    spark, todo, passes = docs.sparkSession, blocks(benchmark, words), 0
    now = list(islice(todo, TOGETHER))
    while True:
        following = list(islice(todo, 1))
        ours = spark.sparkContext.broadcast(now)

        def run(batches, ours=ours, first=passes == 0, last=not following):
            for b in K.slices(batches):
                found = list(_judge(ours.value, K.each_bytes(b.column("text")), words))
                if not first:
                    old = zip(b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True)
                    found = [(m | np.unpackbits(np.frombuffer(h, np.uint8), count=len(m)).astype(bool), names | set(i)) for (m, names), (h, i) in zip(found, old, strict=True)]
                if last:
                    yield finish(b.column("id"), found)
                else:
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array([np.packbits(m).tobytes() for m, _ in found], pa.binary()), pa.array([sorted(x) for _, x in found], pa.list_(pa.string()))], names=["id", "text", "hits", "items"])

        if not following:
            return docs.mapInArrow(run, schema)
        docs, passes = spill.write(docs.mapInArrow(run, _FOUND), "tested"), passes + 1
        ours.unpersist()
        now = following + list(islice(todo, TOGETHER - 1))


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 10, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def finish(ids, found):
        hit = [int(m.sum()) for m, _ in found]
        sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for _, x in found]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(m) for m, _ in found], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array(sha, pa.string()), pa.array([n > 0 for n in hit], pa.bool_())], schema=ARROW)

    return _tested(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")), benchmark, words, finish, RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, words: int = 10, text: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that hit nothing. Each TOGETHER blocks of the benchmark are a filter of their own."""
    spark, todo = docs.sparkSession, blocks(benchmark, words)
    first = True
    while now := list(islice(todo, TOGETHER)):
        if not first:
            docs = spill.write(docs, "tested")
        docs, first = docs.where(F.arrow_udf(_free_of(spark.sparkContext.broadcast(now), words), "boolean")(F.col(text))), False
    return docs


def _free_of(indexes, words: int):
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in column:
            yield pa.array([not m.any() for m, _ in _judge(indexes.value, K.each_bytes(c), words)], pa.bool_())

    return run


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
