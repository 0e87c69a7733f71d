"""Removal of repeated byte strings with a logarithmic family of suffix-array indexes.

An index holds the sampled suffixes of its documents in sorted order. Sampled are the suffixes that
start at an *anchor*: among the starting places of the 32-byte grams inside a string of `length`
bytes, the one with the least hash (the last, among equals). Equal strings have the same anchor, so
comparing suffixes of equal anchors finds every repeated string, while about 2 of every `length - 31`
suffixes are kept. A sampled suffix stands for the run of strings that have it as their anchor. An array is cut into buckets by a hash of the anchor's 32
bytes; in a bucket suffixes are in order of their first eight bytes, and among equal ones of hashes (of the 32 bytes, and two of the run's whole
bytes), document and place. The hashes stand in for the further bytes, so that entries stay small: the order among suffixes that begin alike is not
the bytes' own, but equal ones are neighbours, which is all that a merge-scan needs.

Documents come in batches. A batch's suffix arrays are built in one pass over its text, merge-scanned
against all levels of the family (equal neighbours are matches, for the new and for the old side),
and then put in as a new level; while the two smallest levels are of similar size they are merged to
one twice as large, so n batches are rewritten about log2(n) times. Levels are tables in the shared folder; save() and open() keep a family beyond the
session, so add_documents() can test new documents against all that came before without reading those again but for the ends of repeated passages.

A scan gives two kinds of match. Runs with equal bytes repeat as a whole. Runs with equal anchors and
different bytes (the ends of a repeated passage) are settled string by string: one run of each kind is
hashed at all its places, and equal hashes in two places are repeats. Both are exact up to equality of 96 bits of hashes.

What many documents have is met where it is read: of runs with equal bytes a task tells one, and reports the others as repeated; an anchor with over LOCAL kinds
of runs in a task is told once, as a mark, and its runs go the way of large groups, string by string, to buckets that depend on the string. So no
bucket gets a passage as often as documents have it.

Defined cases: null texts are empty; texts under `length` bytes keep everything; repeated rows repeat each other (a string
that starts in two rows starts elsewhere, whatever the rows' ids, null ones too); empty tables give empty results; texts of any length are indexed in
overlapping pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import spill
from . import textkit as K

_U = np.uint64
GRAM = 32
LARGE, LOCAL = 256, 64  # kinds of runs with one anchor, in all and in a part of a task
KEYS = 4  # columns of an entry that tell runs apart: first bytes, hash of the anchor, two hashes of the run; then document, place, number of strings
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_PLACE = 22  # bits for a place in a chunk
_MASK = _U((1 << _PLACE) - 1)


def _chunks(texts: list[bytes], length: int):
    """(numbers of the texts, their bytes, places where they start in these texts): many short texts, or a piece of a long one
    that overlaps the next by length - 1 bytes."""
    short: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        if len(t) > K.CHUNK:
            for a in range(0, len(t) - length + 1, K.CHUNK):
                yield [i], [t[a : a + K.CHUNK + length - 1]], [a]
            continue
        if size + len(t) > K.CHUNK and short:
            yield short, [texts[j] for j in short], [0] * len(short)
            short, size = [], 0
        short.append(i)
        size += len(t)
    if short:
        yield short, [texts[j] for j in short], [0] * len(short)


def suffixes(texts: list[bytes], length: int):
    """Sampled suffixes of the texts: their first eight bytes, gram hash (32 bits), run hashes (64 and 32 bits), text number, first place of the run, number of
    places in the run."""
    out = []
    for numbers, group, starts in _chunks(texts, length):
        buf = np.frombuffer(b"".join(group), np.uint8)
        grams = K.Grams(buf)
        h = grams.every(GRAM)
        n = len(buf) - length + 1
        key = (h & ~_MASK) | (_MASK - np.arange(len(h), dtype=_U))
        anchor = (_MASK - (K.slide_min(key, length - GRAM + 1) & _MASK)).astype(np.int64)
        del key
        sizes = np.array([len(t) for t in group])
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(group)), sizes)[:n]
        whole = np.arange(n) <= (first + sizes - length)[owner]
        cut = np.ones(n, bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(cut & whole)
        last_ok = (first + sizes - length)[owner[begin]]
        nxt = np.append(np.flatnonzero(cut), n)
        end = np.minimum(nxt[np.searchsorted(nxt, begin, "right")] - 1, last_ok)
        at = anchor[begin]
        own = owner[begin]
        head = np.zeros(len(at), _U)
        for k in range(8):
            head = head << _U(8) | buf[at + k].astype(_U)
        whole_run = [g.of(begin, end + length) + _U(0x9E37) * (at - begin).astype(_U) for g in (grams, K.Grams(buf, salt=3))]
        out.append((head, h[at] >> _U(32), whole_run[0], whole_run[1] >> _U(32), np.array(numbers)[own], begin - first[own] + np.array(starts)[own], end - begin + 1))
    if not out:
        return [*(np.zeros(0, _U) for _ in range(KEYS)), *(np.zeros(0, np.int64) for _ in range(3))]
    return [np.concatenate([x[i] for x in out]) for i in range(KEYS + 3)]


def _in_order(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Entries in the order of an array: by first bytes, hashes, document and place."""
    order = np.lexsort((cols[KEYS + 1], cols[KEYS], *cols[KEYS - 1 :: -1]))
    return [c[order] for c in cols]


def _starts(cols: list[np.ndarray]) -> np.ndarray:
    """Where groups of equal values begin in sorted columns."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def _bucket(gram: np.ndarray, n: int) -> np.ndarray:
    return X.bucket_of(K.mix(gram), n)


def _combined(cols: list[np.ndarray], buckets: int, shards: int, local: int):
    """(part, kind, payload) of a part of a task: its array by bucket (kind ARRAY), and what it can tell by itself, by shard: runs that repeat in it (kind 0)
    and runs of anchors that have over `local` kinds in it (kind 2)."""
    cols = _in_order(cols)
    c = _starts(cols[:KEYS])
    sizes = np.diff(np.append(c, len(cols[0])))
    again = np.repeat(sizes > 1, sizes)
    doc, place, count = (x[again] for x in cols[KEYS:])
    yield from ((p, 0, b) for p, b in X.dealt(X.shard_of(doc.view(np.int64), shards), [doc, place, count]))
    cols = [x[c] for x in cols]  # the first of each kind
    g = _starts(cols[:2])
    kinds = np.diff(np.append(g, len(c)))
    busy = np.repeat(kinds > local, kinds)
    gram, (doc, place, count) = cols[1][busy], (x[busy] for x in cols[KEYS:])
    yield from ((p, 2, b) for p, b in X.dealt(X.shard_of(doc.view(np.int64), shards), [doc, place, count, gram]))
    marks = g[kinds > local]
    zero = np.zeros(len(marks), _U)
    left = [np.concatenate([x[~busy], y]) for x, y in zip(cols, [cols[0][marks], cols[1][marks], *[zero] * (KEYS + 1)], strict=True)]
    left = _in_order(left)
    yield from ((p, ARRAY, b) for p, b in X.dealt(_bucket(left[1], buckets), left))


ARRAY = 9


def _array_of(length: int, buckets: int, shards: int, n_batches: int, local: int):
    """mapInArrow: (batch, part, kind, payload) of _combined(), of rows (id, text)."""

    def run(batches):
        held: list = []
        size = 0

        def flush():
            cols = [np.concatenate([x[i] for x in held]) for i in range(KEYS + 4)]
            held.clear()
            batch = cols.pop()
            blobs = []
            for b in np.unique(batch):
                blobs += [(int(b), *x) for x in _combined([c[batch == b] for c in cols], buckets, shards, local)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in blobs], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["batch", "part", "kind", "payload"])

        for b in K.slices(batches):
            ids = b.column("id").to_numpy(zero_copy_only=False)
            *keys, doc, place, count = suffixes(K.as_bytes(b.column("text")), length)
            held.append((*keys, ids[doc].astype(np.int64).view(_U), place.astype(_U), count.astype(_U), np.mod(X._murmur(ids[doc].astype(np.int64).view(_U) ^ _U(0x5BD1)).astype(np.int64), n_batches)))
            size += len(doc)
            if size >= X.FLUSH // 4:
                yield flush()
                size = 0
        if size:
            yield flush()

    return run


def _scan(shards: int, most: int, once: bool):
    """Merge-scan of one bucket: the levels' arrays and the batch's. Gives spans (kind 0: document, start, count) of runs that
    repeat as a whole, and runs to be settled string by string (kind 1; kind 2 in groups of over `most` kinds or
    with a mark), by shard. With once, runs that an earlier scan gave for settling are not given again."""

    def run(table: pa.Table) -> pa.Table:
        new_blobs = table.filter(table.column("fresh")).column("payload").to_pylist()
        if not new_blobs:
            return _kinds()
        old_blobs = table.filter(pa.compute.invert(table.column("fresh"))).column("payload").to_pylist()
        new, old = X.get_all(new_blobs, KEYS + 3), X.get_all(old_blobs, KEYS + 3)
        fresh = np.zeros(len(new[0]) + len(old[0]), _U)
        fresh[: len(new[0])] = 1
        *cols, fresh = _in_order([*(np.concatenate(x) for x in zip(new, old, strict=True)), fresh])
        fresh = fresh > 0
        if not len(fresh):
            return _kinds()
        g = _starts(cols[:2])
        sizes = np.diff(np.append(g, len(fresh)))
        again = np.repeat((sizes > 1) & np.logical_or.reduceat(fresh, g), sizes)  # groups of equal anchors with something new in them
        cols, fresh = [c[again] for c in cols], fresh[again]
        if not len(fresh):
            return _kinds()
        doc, place, count = cols[KEYS:]
        mark = count == 0
        c = _starts(cols[:KEYS])
        c_sizes = np.diff(np.append(c, len(fresh)))
        same = np.repeat((c_sizes > 1) & np.logical_or.reduceat(fresh, c), c_sizes) & ~mark
        blobs = [(p, 0, b) for p, b in X.dealt(X.shard_of(doc[same].view(np.int64), shards), [doc[same], place[same], count[same]])]
        c_mark, c_old = mark[c], ~np.logical_and.reduceat(fresh, c)
        g = _starts([cols[0][c], cols[1][c]])
        members = np.diff(np.append(g, len(c)))
        number = lambda x: np.repeat(np.add.reduceat(x.astype(np.int64), g), members)
        n_kinds, n_old = number(~c_mark), number(c_old & ~c_mark)
        large, was_large = (n_kinds > most) | (number(c_mark) > 0), (n_old > most) | (number(c_mark & c_old) > 0)
        # old kinds of a group that was settled before, in the same way, were handed on by an earlier scan
        told = c_old & ((n_old > 1) & (was_large == large) | was_large) & once
        for kind, sel in ((1, (n_kinds > 1) & ~large), (2, large)):
            rep = c[sel & ~told & ~c_mark]  # the first run of each kind
            blobs += [(p, kind, b) for p, b in X.dealt(X.shard_of(doc[rep].view(np.int64), shards), [doc[rep], place[rep], count[rep], cols[1][rep]])]
        return _kinds(blobs)

    return run


_KINDS = "part int, kind int, payload binary"


def _kinds(blobs=()) -> pa.Table:
    blobs = list(blobs)
    return pa.table({"part": pa.array([x[0] for x in blobs], pa.int32()), "kind": pa.array([x[1] for x in blobs], pa.int32()), "payload": pa.array([x[2] for x in blobs], pa.binary())})


def _merge(table: pa.Table) -> pa.Table:
    """Two levels' arrays of one bucket as one sorted array."""
    cols = _in_order(X.get_all(table.column("payload").to_pylist(), KEYS + 3))
    return X.blob_table([(table.column("part")[0].as_py(), X.put(cols))])


class IndexFamily:
    """Levels of suffix arrays; each level is a table of (part, payload) and the number of batches in it."""

    def __init__(self, spark, buckets: int, shards: int, length: int = 200):
        self.spark, self.buckets, self.shards, self.length = spark, buckets, shards, length
        self.levels: list[tuple[int, DataFrame]] = []

    def scan(self, batch: DataFrame, once: bool = True) -> DataFrame:
        """Matches of a batch's arrays in itself and with every level: (part: shard, kind, payload). once: all scans' matches will be settled together."""
        rows = batch.select("part", "payload", F.lit(True).alias("fresh"))
        for _, level in self.levels:
            rows = rows.unionByName(level.select("part", "payload", F.lit(False).alias("fresh")))
        return rows.groupBy("part").applyInArrow(_scan(self.shards, LARGE, once), _KINDS)

    def add(self, batch: DataFrame) -> None:
        """Put the batch in as a level; merge levels of equal size, the smallest first."""
        self.levels.append((1, batch))
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            both = a.select("part", "payload").unionByName(b.select("part", "payload"))
            self.levels.append((n + m, spill.write(both.groupBy("part").applyInArrow(_merge, X.BLOB), "suffix-level")))

    def save(self, path: str) -> None:
        """Write the family to a folder: its levels, the greatest first, and their sizes. An older family there is replaced when the new one is complete."""
        name = uuid.uuid4().hex
        sizes = [(k, n, f"{name}/{k}") for k, (n, _) in enumerate(self.levels)]
        for k, (_, level) in enumerate(self.levels):
            level.select("part", "payload").write.parquet(f"{path}/{name}/{k}")
        rows = self.spark.createDataFrame([(self.buckets, self.shards, self.length, *x) for x in sizes], _MANIFEST)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        self.levels = [(n, self.spark.read.schema(X.BLOB).parquet(f"{path}/{place}")) for _, n, place in sizes]

    @classmethod
    def open(cls, spark, path: str) -> IndexFamily:
        """The family that save() wrote."""
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy("level").collect()
        out = cls(spark, rows[0]["buckets"], rows[0]["shards"], rows[0]["length"])
        out.levels = [(r["batches"], spark.read.schema(X.BLOB).parquet(f"{path}/{r['place']}")) for r in rows]
        return out

    def add_documents(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """(id, start, size): strings of `length` bytes that repeat because of the batch, in its documents and in older ones, as runs of bytes (they may
        overlap). batch and texts are (id, text) with ids that tell rows apart; texts holds the batch and all older documents, of which only those with
        parts of a match are looked at. The batch is in the family afterwards. A family that is to be kept has no marks: its arrays hold one run of every kind."""
        arrays = spill.write(batch.select("id", "text").mapInArrow(_array_of(self.length, self.buckets, self.shards, 1, 1 << 60), _ARRAYS), "suffix-arrays")
        matches = spill.write(self.scan(arrays.where(f"kind = {ARRAY}"), once=False).unionByName(arrays.where(f"kind <> {ARRAY}").select("part", "kind", "payload")), "suffix-matches")
        self.add(arrays.where(f"kind = {ARRAY}").select("part", "payload"))
        held = texts.select(X.shard_column(self.shards, "id").alias("part"), "id", "text")
        settled = X.by_bucket(X.by_shard(held, matches, _settle(self.length, self.buckets), _KINDS), self.buckets, _equal(self.shards, self.length), _KINDS)
        spans = matches.where("kind = 0").unionByName(settled).select("payload")
        return spans.mapInArrow(_as_spans(self.length), "id long, start long, size long")


_ARRAYS = "batch int, part int, kind int, payload binary"
_MANIFEST = "buckets int, shards int, length int, level int, batches int, place string"


def _as_spans(length: int):
    def run(batches):
        for b in batches:
            doc, place, count = (c.view(np.int64) for c in X.get_all(b.column("payload").to_pylist(), 3))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(count + length - 1)], names=["id", "start", "size"])

    return run


def _settle(length: int, buckets: int):
    """Of a shard: what settles its runs. Of most runs the bytes travel (kind 1: gram, document, place, count, then the bytes), which
    is less than the hashes of all their strings; of runs in a large group the hashes (kind 2), so that no bucket gets the group."""

    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        kinds = np.array(runs.column("kind").to_pylist(), np.int64)
        payload = runs.column("payload").to_pylist()
        cols = [X.get_all([payload[i] for i in np.flatnonzero(kinds == k)], 4) for k in (1, 2)]
        large = np.repeat([False, True], [len(c[0]) for c in cols])
        doc, place, count, gram = (np.concatenate(x) for x in zip(*cols, strict=True))
        if not len(doc):
            return _kinds()
        doc = doc.view(np.int64)  # ids may be negative
        order = np.lexsort((~large, gram, count, place, doc))
        doc, place, count, gram, large = (c[order] for c in (doc, place, count, gram, large))
        new = np.ones(len(doc), bool)
        same = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]) & (gram[1:] == gram[:-1])
        new[1:] = ~same | (large[1:] != large[:-1])  # a group may have become large later: then both ways are needed
        doc, place, count, gram, large = doc[new], place[new].astype(np.int64), count[new].astype(np.int64), gram[new], large[new]
        ids = docs.column("id").to_numpy()
        sel = np.flatnonzero(np.isin(ids, doc))
        texts = K.as_bytes(docs.column("text").combine_chunks().take(pa.array(sel)))
        hashed, sent = [], []
        for t, i in zip(texts, ids[sel].tolist(), strict=True):
            own = np.arange(np.searchsorted(doc, i, "left"), np.searchsorted(doc, i, "right"))
            own = own[place[own] + count[own] + length - 1 <= len(t)]
            sent += [(int(k), t[place[k] : place[k] + count[k] + length - 1]) for k in own[~large[own]]]
            own = own[large[own]]
            if len(own):
                hashed.append(_strings([t[place[k] : place[k] + count[k] + length - 1] for k in own], gram[own], np.full(len(own), i), place[own], count[own], length))
        blobs = []
        if sent:
            k = np.array([x[0] for x in sent])
            part = _bucket(gram[k], buckets)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            for group in np.split(order, cuts):
                head = X.put([gram[k[group]], doc[k[group]], place[k[group]], count[k[group]]])
                blobs.append((int(part[group[0]]), 1, len(head).to_bytes(8, "little") + head + b"".join(sent[g][1] for g in group)))
        if hashed:
            cols, repeats = _once([np.concatenate([x[i] for x in hashed]) for i in range(4)])
            blobs += [(p, 2, x) for p, x in X.dealt(X.bucket_of(cols[0], buckets), cols)]
            blobs += [(runs.column("part")[0].as_py(), 0, x) for _, x in _spans(*repeats, 1)]
        return _kinds(blobs)

    return run


def _once(cols: list[np.ndarray]) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of strings (two hashes, document, place) the first of each kind; and document and place of all that are there twice or more."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    first = np.zeros(len(order), bool)
    first[_starts(cols)] = True  # a string that came both ways is one place
    cols = [c[first] for c in cols]
    at = _starts(cols[:2]) if len(cols[0]) else np.zeros(0, np.int64)
    n = np.diff(np.append(at, len(cols[0])))
    again = np.repeat(n > 1, n)
    return [c[at] for c in cols], (cols[2][again], cols[3][again])


def _spans(doc: np.ndarray, place: np.ndarray, shards: int):
    """Runs of neighbouring places as (document, start, count), by shard."""
    if not len(doc):
        return
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + _U(1))))
    count = (np.append(cut[1:], len(doc)) - cut).astype(_U)
    yield from X.dealt(X.shard_of(doc[cut].view(np.int64), shards), [doc[cut], place[cut], count])


def _strings(pieces: list[bytes], gram, doc, place, count, length: int) -> list[np.ndarray]:
    """Two hashes, document and place of every string of the runs whose bytes are given."""
    out = []
    for first, group in K.runs(pieces):
        n = count[first : first + len(group)]
        sizes = np.array([len(x) for x in group])
        ahead = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(np.cumsum(sizes) - sizes, n) + ahead
        buf = np.frombuffer(b"".join(group), np.uint8)
        h, h2 = (K.Grams(buf, salt).of(starts, starts + length) for salt in (7, 11))
        own = slice(first, first + len(group))
        out.append((h, h2 >> _U(32), np.repeat(doc[own], n).astype(np.int64).view(_U), (np.repeat(place[own], n) + ahead).astype(_U)))
    return [np.concatenate([x[i] for x in out]) for i in range(4)]


def _equal(shards: int, length: int):
    """Of a bucket: strings with equal hashes in two places, as spans by shard."""

    def run(table: pa.Table) -> pa.Table:
        got, hashed, found = [], [], []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
            if kind == 0:  # repeats that a shard found by itself
                found.append((table.column("part")[0].as_py(), 0, blob))
                continue
            if kind == 2:
                hashed.append(blob)
                continue
            size = int.from_bytes(blob[:8], "little")
            gram, doc, place, count = X.get(blob[8 : 8 + size])
            ends = 8 + size + np.cumsum(count.astype(np.int64) + length - 1)
            pieces = [blob[a:b] for a, b in zip([8 + size, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            got.append(_strings(pieces, gram, doc.view(np.int64), place.astype(np.int64), count.astype(np.int64), length))
        got.append(X.get_all(hashed, 4))
        _, repeats = _once([np.concatenate([x[i] for x in got]) for i in range(4)])
        return _kinds(found + [(p, 0, b) for p, b in _spans(*repeats, shards)])

    return run


def _copies(ids: np.ndarray, texts: pa.Array) -> set[int]:
    """Rows of a shard that another one equals, id and text."""
    u, at, n = np.unique(ids, return_inverse=True, return_counts=True)
    rows: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(n[at] > 1):
        rows.setdefault((int(ids[i]), texts[int(i)].as_py()), []).append(int(i))
    return {i for group in rows.values() if len(group) > 1 for i in group}


def _finish(length: int):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        spans = spans.filter(pa.compute.equal(spans.column("kind"), 0))
        doc, place, count = (c.view(np.int64) for c in X.get_all(spans.column("payload").to_pylist(), 3))
        order = np.argsort(doc, kind="stable")
        doc, place, count = doc[order], place[order], count[order]
        ids = docs.column("id").to_numpy()
        low, high = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
        out: list[list] = [[], [], [], []]
        copies = _copies(ids, docs.column("text").combine_chunks())
        for i, t in enumerate(K.each_bytes(docs.column("text").combine_chunks())):
            removed = n_spans = 0
            if i in copies and len(t) >= length:  # each string starts in the other row too
                removed, n_spans, t2 = len(t), 1, b""
            elif high[i] > low[i]:
                a, b = place[low[i] : high[i]], place[low[i] : high[i]] + count[low[i] : high[i]] + length - 1
                gone = K.covered(a, b, len(t))
                removed = int(gone.sum())
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                t2 = np.frombuffer(t, np.uint8)[~gone].tobytes()
            else:
                t2 = t
            for o, x in zip(out, (len(t), removed, n_spans, hashlib.sha256(t2).hexdigest()), strict=True):
                o.append(x)
        return pa.Table.from_arrays([docs.column("doc_id").combine_chunks(), *(pa.array(o[:], k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], schema=ARROW)

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 200, batches: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a `length`-byte string that also starts anywhere else in docs;
    strings are judged on the input. length is at least 64.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    given = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    twice = given.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    # ids that do not tell rows apart are replaced by a hash of id and text
    given = given.withColumn("id", F.col("doc_id") if twice.isEmpty() else F.xxhash64("doc_id", "text"))
    _, size = X.text_size(given)
    shards, buckets = X.parts(spark, size, 8 << 20), X.parts(spark, size, 32 << 20)
    arrays = spill.write(given.select("id", "text").mapInArrow(_array_of(length, buckets, shards, batches, LOCAL), _ARRAYS), "suffix-arrays", "batch")
    family, matches = IndexFamily(spark, buckets, shards, length), arrays.where(f"kind <> {ARRAY}").select("part", "kind", "payload")
    for b in range(batches):
        batch = arrays.where((F.col("batch") == b) & (F.col("kind") == ARRAY)).select("part", "payload")
        matches = matches.unionByName(spill.write(family.scan(batch), "suffix-matches"))
        if b < batches - 1:
            family.add(batch)
    held = given.select(X.shard_column(shards, "id").alias("part"), "id", "doc_id", "text")
    settled = X.by_bucket(X.by_shard(held, matches, _settle(length, buckets), _KINDS), buckets, _equal(shards, length), _KINDS)
    return X.by_shard(held, matches.unionByName(settled), _finish(length), RESULT)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
