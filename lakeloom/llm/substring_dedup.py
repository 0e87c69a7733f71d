"""Removal of word passages that repeat an earlier document (level-wise doubling).

A passage of n words can only repeat if the shorter windows inside it repeat. So windows of a base length are tested first; the
passages whose windows repeat at that length are tested at twice the length, and so on, until no candidate survives or the
windows are n words long. At a length under n only the least-hashed window of each n-word candidate travels (a repeated
n-word window has the same least window in both places), and level by level there are fewer candidates. Short windows
are compared by a 64-bit hash, since a false repeat only makes a candidate; windows of n words by two independent hashes, 96 bits in all.

A shard of documents tells a window once, as (hash, least document, whether it has several), however many of its documents have it, and gets the least
document of all back. So a window's bucket holds at most one entry for each shard, whatever share of the documents has the
window, and no group grows with the number of copies.

Defined cases: a null text has no words; a null id neither removes nor is removed; rows of one
document id are one document to each other (an id is never smaller than itself), each row is
reported; equal windows in documents of several ids stay in the smallest id only; texts shorter than
the window keep all words; a text of any length is hashed in pieces that overlap by n - 1 words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkit as K

_U = np.uint64
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def lengths(words: int, base: int) -> list[int]:
    """Window lengths of the levels: base, twice that, ... and last `words`."""
    out = [min(base, words)]
    while out[-1] < words:
        out.append(min(2 * out[-1], words))
    return out


def _least(w: K.MixedWords, base: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `words` words: its start and the hash of its least window of base words."""
    at, h = w.windows(base)
    wide, _ = w.windows(words)
    if not len(wide):
        return wide, np.zeros(0, _U)
    place = np.zeros(len(w.starts) + 1, np.int64)
    place[at] = np.arange(len(at))
    return wide, K.slide_min(h, words - base + 1)[place[wide]]


def _ids(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, 0 where null, and whether they are there."""
    ids = docs.column("id").combine_chunks()
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_valid().to_numpy(zero_copy_only=False)


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, ascending by the first, and where each group of them starts in it."""
    order = np.argsort(keys[0])
    for k in keys[1:]:
        own, first = k[order], keys[0][order]
        if ((own[1:] != own[:-1]) & (first[1:] == first[:-1])).any():  # first keys that collide
            order = np.lexsort(keys[::-1])
    own = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in own])
    return order, np.flatnonzero(new)


def _told(shard: int, keys: list[np.ndarray], ids: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """A shard's windows (key columns and the document of each) for their buckets: keys, least document, 1 where it is not the only one, shard."""
    if not len(ids):
        return []
    order, at = _groups(keys)
    ids, first = ids[order], order[at]
    least = np.minimum.reduceat(ids, at)
    several = least != np.maximum.reduceat(ids, at)
    return list(X.dealt_in_order(keys[0][first], [*(k[first] for k in keys[1:]), least.view(_U), several.astype(_U), np.full(len(at), shard, _U)], buckets))


def _keys(w: K.MixedWords, words: int, sel: np.ndarray) -> list[np.ndarray]:
    """The two hashes, of 64 and 32 bits, of the selected windows."""
    return [X.spread(w.windows(words)[1][sel]), w.windows(words, 1)[1][sel] >> _U(32)]


def _entries(prior: int, length: int, words: int, buckets: int):
    """Of a shard: what it tells at a level. prior: the length of the level before, whose repeated windows are the replies; 0 at the first level."""

    def run(docs: pa.Table, replies: pa.Table | None) -> pa.Table:
        known = None
        if prior:
            known = np.sort(X.get_all(replies.column("payload").to_pylist(), 1)[0])
            if not len(known):
                return X.blob_table([])
        if not docs.num_rows:
            return X.blob_table([])
        ids, valid = _ids(docs)
        keys: list[list[np.ndarray]] = []
        owners: list[np.ndarray] = []
        for first, group in K.runs(K.each_bytes(docs.column("text").combine_chunks())):
            for part, _ in K.pieces(group, K.BLANK_WORD, words - 1):
                w = K.MixedWords(part, K.BLANK_WORD)
                doc = first + w.text_of()
                wide, least = _least(w, prior or length, words)
                sel = valid[doc[wide]]
                if prior:
                    sel &= _has(known, X.spread(least))
                if not sel.any():
                    continue
                if length == words:
                    h = _keys(w, words, sel)
                else:
                    h = [X.spread(_least(w, length, words)[1][sel] if prior else least[sel])]
                d = ids[doc[wide[sel]]]
                new = np.ones(len(d), bool)  # neighbours mostly share their least window
                new[1:] = (h[0][1:] != h[0][:-1]) | (d[1:] != d[:-1])
                keys.append([x[new] for x in h])
                owners.append(d[new])
        if not keys:
            return X.blob_table([])
        return X.blob_table(_told(docs.column("part")[0].as_py(), [np.concatenate([k[i] for k in keys]) for i in range(len(keys[0]))], np.concatenate(owners), buckets))

    return run if prior else lambda docs: run(docs, None)


def _repeated(n_keys: int):
    """Of a bucket: to each shard that told a window which several documents have, the window; with two keys the least document too (and of the
    second key 16 bits, enough to tell a shard's own windows apart)."""

    def run(table: pa.Table) -> pa.Table:
        *keys, least, several, shard = X.get_all(table.column("payload").to_pylist(), n_keys + 3)
        if not len(shard):
            return X.blob_table([])
        order, at = _groups(keys)
        keys, least, several, shard = [k[order] for k in keys], least[order].view(np.int64), several[order], shard[order]
        n, low = np.diff(np.append(at, len(shard))), np.minimum.reduceat(least, at)
        again = np.repeat((np.maximum.reduceat(least, at) != low) | (np.maximum.reduceat(several, at) > 0), n)
        keys, low, shard = [k[again] for k in keys], np.repeat(low, n)[again], shard[again].astype(np.int32)
        return X.blob_table(X.dealt(shard, [keys[0], keys[1] & _SHORT, low.view(_U)] if n_keys > 1 else keys))

    return run


_SHORT = _U(0xFFFF)


def _has(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each x is among the sorted values."""
    if not len(known):
        return np.zeros(len(x), bool)
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def _earliest(known: list[np.ndarray], h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window is among the known ones (two hashes and the least document, sorted by the hashes), and its least document."""
    found, least = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    k1, k2, ids = known
    if not len(k1):
        return found, least
    at = np.searchsorted(k1, h)
    open_ = np.arange(len(h))
    while len(open_):  # more than one round only where first hashes collide
        open_ = open_[at[open_] < len(k1)]
        open_ = open_[k1[at[open_]] == h[open_]]
        hit = k2[at[open_]] == h2[open_] & _SHORT
        found[open_[hit]], least[open_[hit]] = True, ids[at[open_[hit]]]
        open_ = open_[~hit]
        at[open_] += 1
    return found, least


def _removed(docs: pa.Table, replies: pa.Table, words: int):
    """For each text of a shard: its number, and its pieces as (bytes, starts of its words, mask of the removed ones); a piece's bytes and words
    are those that no other piece has. A text that loses nothing has one piece, itself, and no starts and mask."""
    k1, k2, least = X.get_all(replies.column("payload").to_pylist(), 3)
    order = np.lexsort((k2, k1))
    known = [k1[order], k2[order], least[order].view(np.int64)]
    ids, valid = _ids(docs)
    for first, group in K.runs(K.each_bytes(docs.column("text").combine_chunks())):
        found: list[list] = [[] for _ in group]
        carried = np.zeros(0, bool)
        for part, cut in K.pieces(group, K.BLANK_WORD, words - 1):
            w = K.MixedWords(part, K.BLANK_WORD)
            doc = first + w.text_of()
            at, h = w.windows(words)
            gone = valid[doc[at]] & _has(known[0], X.spread(h))
            if gone.any():
                there, least = _earliest(known, *_keys(w, words, gone))
                gone[gone] = there & (least < ids[doc[at[gone]]])
            mask = K.covered(at[gone], at[gone] + words, len(w.starts))
            if cut is None:
                for i in range(len(group)):
                    a, b = w.first[i], w.first[i + 1]
                    found[i].append((part[i], w.starts[a:b] - w.text_start[i], mask[a:b]))
            else:
                mask[: len(carried)] |= carried
                own = int(np.searchsorted(w.starts, cut))
                found[0].append((part[0][:cut], w.starts[:own], mask[:own]))
                carried = mask[own:]
        for i, t in enumerate(group):
            yield first + i, found[i] if any(m.any() for _, _, m in found[i]) else [(t, None, None)]


def _finish(words: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        n_words, n_removed, sha = [], [], []
        for _, pieces in _removed(docs, replies, words):
            n = gone = 0
            digest, some = hashlib.sha256(), False
            for piece, _, mask in pieces:
                for group, _ in K.pieces([piece], K.BLANK_WORD, 0) if mask is None else [([piece], None)]:
                    own = group[0].split()
                    kept = b" ".join(own if mask is None else compress(own, (~mask).tolist()))
                    n += len(own)
                    gone += 0 if mask is None else int(mask.sum())
                    if kept:
                        digest.update(b" " + kept if some else kept)
                        some = True
            n_words.append(n)
            n_removed.append(gone)
            sha.append(digest.hexdigest())
        return pa.Table.from_arrays([docs.column("id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], schema=RESULT_ARROW)

    return run


def _kept_text(pieces) -> bytes:
    """A text without its removed words, each of which goes with the blanks after it."""
    kept, within = [], False  # within: the last word so far is a removed one
    for piece, starts, mask in pieces:
        edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=int(within), append=0 if not len(mask) else int(mask[-1])))
        ends = np.append(starts, len(piece))
        at, gone = 0, within
        for e in edges:
            if not gone:
                kept.append(piece[at : ends[e]])
            at, gone = ends[e], not gone
        if not gone:
            kept.append(piece[at:])
        within = gone
    return b"".join(kept).rstrip(b" \t\n\x0b\x0c\r")


def _cut(words: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        texts = [pieces[0][0] if pieces[0][1] is None else _kept_text(pieces) for _, pieces in _removed(docs, replies, words)]
        column = docs.column("text").combine_chunks()
        new = pa.array(texts, pa.binary()).cast(pa.string())
        new = pa.compute.if_else(column.is_valid(), new, pa.nulls(len(new), pa.string()))
        left = pa.array([t is None or len(t) > 0 or len(o) == 0 for t, o in zip(texts, K.each_bytes(column), strict=True)], pa.bool_())
        return pa.Table.from_arrays([docs.column("row").combine_chunks(), new, left], names=["row", "text", "left"])

    return run


def _levels(docs: DataFrame, words: int, base: int, id_column: str, text: str, row=None) -> tuple[DataFrame, DataFrame]:
    """The documents by shard, and the last level's replies: windows that several documents have, with the least of these."""
    spark = docs.sparkSession
    _, size = X.text_size(docs, text)
    shards, buckets = X.parts(spark, size, 8 << 20), X.parts(spark, size, 16 << 20)
    held = X.sharded(docs, shards, id_column, text, row)
    replies, prior = None, 0
    for length in lengths(words, base):
        run = _entries(prior, length, words, buckets)
        entries = held.drop("row").groupBy("part").applyInArrow(run, X.BLOB) if replies is None else X.by_shard(held.drop("row"), replies, run, X.BLOB)
        replies = X.by_bucket(entries, buckets, _repeated(1 if length < words else 2))
        prior = length
    return held, replies


def remove_repeats(docs: DataFrame, words: int = 13, base: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256.

    Removed is each word covered by a window of `words` words that also starts in a document with a
    smaller id; windows are judged on the input.
    """
    held, replies = _levels(docs, words, base, id_column, text)
    return X.by_shard(held, replies, _finish(words), RESULT)


def cut(docs: DataFrame, words: int = 13, base: int = 4, id_column: str = "doc_id", text: str = "text", emptied: bool = True) -> DataFrame:
    """docs without the words that remove_repeats() removes, each with the blanks after it; other texts and all other columns stay as
    they are. Where emptied is false, rows whose text became empty go."""
    others = [c for c in docs.columns if c != text]
    held, replies = _levels(docs, words, base, id_column, text, F.struct(*others))
    kind = held.schema["row"].dataType.simpleString()
    out = X.by_shard(held, replies, _cut(words), f"row {kind}, text string, left boolean")
    if not emptied:
        out = out.where("left")
    return out.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
