"""Hashed text features, bounded labelled samples, and the fits that share them.

Features are (row, column, value) triples of a sparse matrix: byte grams (square roots of their shares in the text, and how
repetitive its words are), or words and their beginnings (present or not). A fit reads at most a stated number of
labelled rows, taken in the order of a hash of their id; scores are computed for every whole text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spill
from . import textkit as K

_U = np.uint64
GRAM_BITS, WORD_BITS = 16, 20
REPEAT_BINS = 21


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def _long(texts: list[bytes]) -> bool:
    """Whether these are a text that is taken in pieces."""
    return len(texts) == 1 and len(texts[0]) > K.CHUNK


def gram_shares(texts: list[bytes], n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte n-grams by the square root of their share of the text; texts of fewer bytes have none."""
    buf = np.frombuffer(texts[0] if len(texts) == 1 else b"\n".join(texts), np.uint8)
    if len(buf) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if _long(texts):
        count = np.zeros(1 << GRAM_BITS, np.int64)
        for a in range(0, len(buf) - n + 1, K.CHUNK):
            count += np.bincount((K.Grams(buf[a : a + K.CHUNK + n - 1]).every(n) >> _U(64 - GRAM_BITS)).astype(np.int64), minlength=len(count))
        col = np.flatnonzero(count)
        return np.zeros(len(col), np.int64), col, np.sqrt(count[col] / (len(buf) - n + 1))
    h = (K.Grams(buf).every(n) >> _U(64 - GRAM_BITS)).astype(np.int64)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    own = np.repeat(np.arange(len(texts)), sizes + 1)[: len(h)]
    whole = np.arange(n, len(h) + n) <= ends[own]
    key, count = _counted(((own << GRAM_BITS) | h)[whole])
    row = key >> GRAM_BITS
    return row, key & ((1 << GRAM_BITS) - 1), np.sqrt(count / np.maximum(sizes - n + 1, 1)[row])


def grams(texts: list[bytes], n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram_shares, and the share of distinct words as a bin of its own; texts without words and grams have no features."""
    row, col, val = gram_shares(texts, n)
    if _long(texts):
        key, counts = np.zeros(0, _U), np.zeros(1, np.int64)
        for part, _ in K.pieces(texts, K.BLANK_WORD, 0):
            w = K.Words(part, K.BLANK_WORD)
            key, counts = np.union1d(key, w.hash >> _U(24)), counts + len(w.starts)
        distinct = np.array([len(key)])
    else:
        w = K.Words(texts, K.BLANK_WORD)
        key, _ = _counted((w.text_of().astype(_U) << _U(40)) | (w.hash >> _U(24)))
        distinct, counts = np.bincount((key >> _U(40)).astype(np.int64), minlength=len(texts)), w.counts
    some = np.flatnonzero(counts)
    if len(some):
        # long texts repeat common words: the number of words that would be distinct grows about with the 3/4th power
        share = np.minimum(distinct[some] / counts[some] ** 0.75, 1.0)
        row, col, val = np.append(row, some), np.append(col, (1 << GRAM_BITS) + np.floor(share * (REPEAT_BINS - 1)).astype(np.int64)), np.append(val, np.ones(len(some)))
    return row, col, val


GRAM_COLUMNS = (1 << GRAM_BITS) + REPEAT_BINS


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words, and their first four and five bytes, that occur in the text."""
    if _long(texts):
        cols = np.unique(np.concatenate([_words(part)[1] for part, _ in K.pieces(texts, K.ALNUM_WORD, 0, lower=True)]))
        return np.zeros(len(cols), np.int64), cols, np.ones(len(cols))
    return _words(texts)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = K.Words(texts, K.ALNUM_WORD, lower=True)
    own = w.text_of().astype(np.int64) << WORD_BITS
    keys = [own | (w.hash >> _U(64 - WORD_BITS)).astype(np.int64)]
    for n in (4, 5):
        long = np.flatnonzero(w.ends - w.starts > n)
        h = w.ranges(w.starts[long], w.starts[long] + n) * _U(2 * n + 1)
        keys.append(own[long] | (h >> _U(64 - WORD_BITS)).astype(np.int64))
    key, _ = _counted(np.concatenate(keys))
    return key >> WORD_BITS, key & ((1 << WORD_BITS) - 1), np.ones(len(key))


WORD_COLUMNS = 1 << WORD_BITS


def score(texts: Iterable[bytes], make, weights: np.ndarray, bias) -> np.ndarray:
    """Linear scores of whole texts: (n,) for a vector of weights, (n, k) for a matrix of k rows."""
    out = []
    for _, group in K.runs(texts):
        row, col, val = make(group)
        if weights.ndim == 1:
            out.append(np.bincount(row, val * weights[col], len(group)) + bias)
        else:
            out.append(np.stack([np.bincount(row, val * w[col], len(group)) for w in weights], 1) + bias)
    return np.concatenate(out) if out else np.zeros((0,) + weights.shape[:-1])


class Sample:
    """A sparse matrix of some labelled rows on the driver, by rows and by columns."""

    def __init__(self, sizes: np.ndarray, col: np.ndarray, val: np.ndarray):
        """sizes: entries of each row; col and val: the entries, row by row."""
        self.n, self.sizes, self.col, self.val = len(sizes), np.asarray(sizes, np.int64), col, val
        self._some = np.flatnonzero(self.sizes)
        self._first = (np.cumsum(self.sizes) - self.sizes)[self._some]
        self._by_column: tuple | None = None

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        if len(self._some):
            out[self._some] = np.add.reduceat(self.val * w[self.col], self._first)
        return out

    def back(self, e: np.ndarray, columns: int) -> np.ndarray:
        if self._by_column is None:
            order = np.argsort(self.col, kind="stable")
            col = self.col[order]
            first = np.flatnonzero(np.append(True, col[1:] != col[:-1])) if len(col) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)
            self._by_column = (col[first], first, row[order], self.val[order])
        own, first, row, val = self._by_column
        out = np.zeros(columns)
        if len(first):
            out[own] = np.add.reduceat(val * e[row], first)
        return out

    def seen(self, columns: int) -> np.ndarray:
        """Rows that have each column."""
        return np.bincount(self.col, minlength=columns)

    def only(self, used: np.ndarray) -> Sample:
        """The columns where used is true, numbered anew."""
        k = used[self.col]
        row = np.repeat(np.arange(self.n), self.sizes)[k]
        return Sample(np.bincount(row, minlength=self.n), (np.cumsum(used) - 1)[self.col[k]], self.val[k].astype(np.float64))


def sample(docs: DataFrame, labelled: DataFrame, make, most: int, id_column: str = "doc_id", text: str = "text") -> tuple[Sample, np.ndarray]:
    """Features and labels (column y) of at most `most` rows of labelled (id, y), those whose ids hash lowest.

    At most `most` ids are broadcast and at most `most` rows of features reach the driver, by way of a table that all tasks write at once. An id with several
    labels has the least of them, one with several texts that of the least hash.
    """
    spark = docs.sparkSession
    own = labelled.where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.min("y").alias("y"))
    y = {r["id"]: r["y"] for r in own.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(most).collect()}
    ids = spark.createDataFrame([(i,) for i in y], "id long")
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("of"), F.col(text).alias("text")).join(F.broadcast(ids), "id", "left_semi")

    def run(batches):
        for b in K.slices(batches):
            blobs = []
            for _, group in K.runs(K.each_bytes(b.column("text"))):
                row, col, val = make(group)
                order = np.argsort(row, kind="stable")
                cut = np.searchsorted(row[order], np.arange(len(group) + 1))
                for i in range(len(group)):
                    sel = order[cut[i] : cut[i + 1]]
                    blobs.append(col[sel].astype("<i4").tobytes() + val[sel].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("of"), pa.array(blobs, pa.binary())], names=["id", "of", "features"])

    written = spill.write(given.mapInArrow(run, "id long, of long, features binary"), "sample")
    got: dict[int, tuple[int, bytes]] = {}
    for r in written.toLocalIterator(prefetchPartitions=True):
        if r["id"] not in got or r["of"] < got[r["id"]][0]:
            got[r["id"]] = (r["of"], bytes(r["features"]))
    spill.remove(written)
    keep = [i for i in y if i in got]
    blobs = [got.pop(i)[1] for i in keep]
    sizes = np.array([len(b) // 8 for b in blobs], np.int64)
    cols = [np.frombuffer(b, "<i4", n) for b, n in zip(blobs, sizes, strict=True)]
    vals = [np.frombuffer(b, "<f4", n, 4 * n) for b, n in zip(blobs, sizes, strict=True)]
    col, val = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((cols, np.int32), (vals, np.float32)))
    return Sample(sizes, col, val), np.array([y[i] for i in keep])


class Adam:
    """Full-batch Adam steps on a flat vector."""

    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.s, self.t = rate, np.zeros(size), np.zeros(size), 0

    def step(self, x: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.s += 0.001 * (g * g - self.s)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))
