"""Language model over words: a probabilistic suffix tree with smoothed states.

A context is the last 1 to `depth` tokens (one mark for the start of a text among them). It is a state of the tree if it was seen at least `least`
times and passes a divergence test: what its own next-token frequencies gain over the next shorter state, N(s) times the Kullback-Leibler divergence of the
two, is at least `gain` nats for each different next token (the parameters that the state costs). A token has the distribution of
the longest state that ends its history, and a state's distribution is smoothed by that of the next shorter one in proportion to the number of its
different next tokens:

    P(w | s) = (c(s w) + T(s) P(w | shorter)) / (N(s) + T(s)),    P(w | root) = (c(w) + 0.1) / (N + 0.1 (V + 1))

so each state is a distribution over the V learned tokens and one for all others, as the root (the base score) is.

Counts of the corpus never meet in one place. Documents are packed where they are read, about 16 MB of text to a shard. A shard tells the buckets of an exchange (exchange.py) each different n-gram once, with its
count in documents that are learned from, and gets the corpus' count back in the same order; one shard of those that have it is named its owner, so that
owners together count the different next tokens of a context. Longer n-grams are told only where their context is frequent enough. A hot word is one
entry for each shard. What a shard has heard it hears again in later passes, from the same shuffle files. The gains of the divergence test are summed as
integers (2**-16 nats), so no result depends on the partitioning.

Defined cases: a null or empty text is one end token; a null id counts as held out and gives held_out = true; rows of one id are scored (and learned
from) each; an empty table gives an empty result; if nothing is learned from, N = V = 0 and all tokens have probability 1 (the one unknown token); other columns are
ignored. A text is hashed 1 MB at a time; a pass holds about 80 bytes for each word of its shard.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textkit as K

_U = np.uint64
PAD, END = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
UNIT = 65536
#: Bytes of text in a shard.
SHARD = 16 << 20
STATES = 100  # kinds of messages: on contexts of k tokens STATES + k; on grams of k tokens k
HELD = "part long, payload binary"
TOLD = "kind int, part long, payload binary"
TOLD_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("payload", pa.binary())])
REPLY = "part long, kind int, bucket long, payload binary"
REPLY_ARROW = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("payload", pa.binary())])
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out(doc_id: int | None, of: int = 10) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % of == 0


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens, each text's end too, and the number of tokens of each text."""
    hashes, sizes = [], []
    for _, group in K.runs(texts):
        n = np.zeros(len(group), np.int64)
        for part, cut in K.pieces(group, K.BLANK_WORD, 0):
            w = K.Words(part, K.BLANK_WORD, lower=True)
            h = K.block_hashes(w.data, w.starts, w.ends)
            n += w.counts
            hashes.append(h if cut is not None else np.insert(h, w.first[1:], END))
        if cut is not None:
            hashes.append(np.array([END]))
        sizes.append(n + 1)
    return (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, _U), (sizes, np.int64)))


def _packed(texts, ids: list[int | None]) -> bytes:
    """A shard's documents: ids, numbers of tokens, the different tokens' hashes (frequent ones first, by powers of two; in order among such), and each position's
    number among these, byte plane by byte plane."""
    token, sizes = _tokens(texts)
    found = _Sorted(slice(None), token, 64)
    words, power = found.keys, np.frexp(found.sizes)[1]
    order = np.argsort(-power, kind="stable")
    number, own = np.empty(len(words), "<u4"), np.empty(len(token), "<u4")
    number[order] = np.arange(len(words))
    own[found.positions] = found.each(number)
    planes = own.view(np.uint8).reshape(-1, 4).T[: 1 + int(len(words) > 256) + 2 * int(len(words) > 65536)]
    keys = [X.put_keys(k) for k in np.split(words[order], np.flatnonzero(np.diff(power[order])) + 1)]
    parts = [X.put([np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.int64), sizes]), *keys, *(zlib.compress(np.ascontiguousarray(p).tobytes(), 1) for p in planes)]
    return np.array([len(keys), len(parts), *map(len, parts)], "<u8").tobytes() + b"".join(parts)


def held(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(part, payload): the documents in shards of about SHARD bytes of text, cut where they are read."""

    def run(batches):
        number, size, texts, ids = 0, 0, [], []

        def out():
            shard = (TaskContext.get().partitionId() << 32) + number
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([_packed(texts, ids)], pa.binary())], names=["part", "payload"])

        for b in K.slices(batches):
            for i, t in zip(b.column("id").to_pylist(), K.each_bytes(b.column("text")), strict=True):
                if texts and size + len(t) > SHARD:
                    yield out()
                    number, size, texts, ids = number + 1, 0, [], []
                texts.append(t)
                ids.append(i)
                size += len(t) + 1
        if texts:
            yield out()

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, HELD)


def _in_order(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of keys of `bits` bits in ascending order of these, then of their own; where in that order each different key begins; and these. A place and as many of
    its key's first bits as there is room for are sorted as one number; keys that this does not tell apart are put in order afterwards."""
    low = _U(max(len(keys) - 1, 0).bit_length())
    lost = _U(max(0, bits + int(low) - 64))
    packed = keys >> lost
    packed <<= low
    packed |= np.arange(len(keys), dtype=_U)
    packed.sort()
    packed &= (_U(1) << low) - _U(1)
    order = packed.view(np.int64)
    got = keys[order]
    if (got[1:] < got[:-1]).any():
        alike = np.append(0, np.cumsum(np.diff(got >> lost) > 0))
        at = np.flatnonzero(np.isin(alike, alike[1:][got[1:] < got[:-1]]))
        order[at] = order[at][np.argsort(got[at], kind="stable")]
        got = keys[order]
    starts = np.flatnonzero(np.append(True, got[1:] != got[:-1])[: len(keys)])
    return order, starts, got[starts]


class _Sorted:
    """Positions (a slice: all) by ascending keys, which go with them."""

    def __init__(self, at: np.ndarray | slice, keys: np.ndarray, bits: int):
        order, self.starts, self.keys = _in_order(keys, bits)
        self.positions = order if isinstance(at, slice) else at[order]

    @property
    def first(self) -> np.ndarray:
        return self.positions[self.starts]

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.positions))

    def total(self, x: np.ndarray) -> np.ndarray:
        """Sums for each different key."""
        return np.add.reduceat(x[self.positions], self.starts, dtype=np.int64)

    def each(self, x: np.ndarray) -> np.ndarray:
        """The value of the key of each of `positions`."""
        return np.repeat(x, self.sizes)


class _Numbered:
    """The same where keys follow from small numbers: nothing is sorted but the numbers' keys."""

    def __init__(self, at: np.ndarray | slice, keys: np.ndarray, number: np.ndarray):
        every, group = np.unique(keys, return_inverse=True)
        some = np.bincount(group, np.bincount(number, minlength=len(keys)), len(every)) > 0
        self.positions, self.keys = at, every[some]
        self.own = (np.cumsum(some) - 1)[group][number]

    def total(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.own, x[self.positions], len(self.keys)).astype(np.int64)

    def each(self, x: np.ndarray) -> np.ndarray:
        return x[self.own]


class _Shard:
    """Token positions of a shard's documents. Keys have the first `bits` bits of hashes."""

    def __init__(self, blob: bytes, bits: int):
        keys, n = (int(i) for i in np.frombuffer(blob, "<u8", 2))
        ends = 8 * (n + 2) + np.cumsum([0, *np.frombuffer(blob, "<u8", n, 16).astype(np.int64)])
        parts = [blob[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        ids, null, sizes = X.get(parts[0])
        self.ids = pa.array(ids.view(np.int64), mask=null > 0)
        self.sizes = sizes.astype(np.int64)
        planes = [np.frombuffer(zlib.decompress(x), np.uint8).astype(np.uint32) for x in parts[1 + keys :]]
        self.words = np.concatenate([X.get_keys(k) for k in parts[1 : 1 + keys]])
        self.number = sum(x << np.uint32(8 * i) for i, x in enumerate(planes))
        self.words = np.append(self.words, PAD)  # the last number: before a text's first token
        self.bits, self.shift = bits, _U(64 - bits)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.number), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.sizes)
        self.held = np.array([held_out(i) for i in self.ids.to_pylist()], bool)
        self.learned = np.repeat(~self.held, self.sizes)

    def before(self, x: np.ndarray, k: int, start) -> np.ndarray:
        """x at the k-th position before; `start` before a text's first."""
        out = np.full(len(x), start, x.dtype)
        out[k:] = x[: len(x) - k]
        out[self.place < k] = start
        return out

    def context(self, k: int, at: np.ndarray | slice) -> np.ndarray:
        """Hashes of the last k tokens of some positions, which mean something where place >= k - 1."""
        out = _U(0)
        for j in range(1, k + 1):
            out = K.mix(out * _M1 + self.words[self.before(self.number, j, len(self.words) - 1)[at]] + _U(j))
        return out

    def contexts(self, k: int, where: np.ndarray) -> _Sorted | _Numbered:
        """Positions by the key of their last k tokens."""
        at = np.flatnonzero(where)
        if k == 1:
            return _Numbered(at, K.mix(self.words + _U(1)) >> self.shift, self.before(self.number, 1, len(self.words) - 1)[at])
        return _Sorted(at, self.context(k, at) >> self.shift, self.bits)

    def grams(self, k: int, where: np.ndarray) -> _Sorted | _Numbered:
        """Positions by the key of k tokens, of which the position's is the last."""
        at = slice(None) if where.all() else np.flatnonzero(where)
        if k == 1:
            return _Numbered(at, self.words >> self.shift, self.number[at])
        return _Sorted(at, K.mix(self.context(k - 1, at) * _M2 + self.words[self.number[at]]) >> self.shift, self.bits)


def _tell(kind: int, keys: np.ndarray, columns: list[np.ndarray], shard: int, n: int, bits: int) -> list[tuple[int, int, bytes]]:
    """Ascending keys with their columns, for n buckets: the keys' size and they, then the columns. Single tokens are told to every bucket, if there are none too."""
    part = ((keys >> _U(bits - 32)) * _U(n) >> _U(32)).astype(np.int64)
    edges = np.searchsorted(part, np.arange(n + 1)).tolist()
    out = []
    for bucket, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a == b and kind != 1:
            continue
        packed = X.put_keys(keys[a:b])
        out.append((kind, bucket, len(packed).to_bytes(8, "little") + packed + X.squeeze([*(c[a:b] for c in columns), np.array([shard], _U)])))
    return out


def _heard(blob: bytes) -> list[np.ndarray]:
    """The keys and columns of _tell()."""
    size = 8 + int.from_bytes(blob[:8], "little")
    return [X.get_keys(blob[8:size]), *X.stretch(blob[size:])]


def _told(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.binary()))], schema=TOLD_ARROW)


def _bucket(gain: float):
    """Answers a bucket's shards, in the order in which each told its keys: for grams the count, times two, plus one for the owner; for contexts the number of
    next tokens where they are states, else 0. On single tokens it adds how many different ones it has that are learned."""
    return lambda table: _answered(table, gain)


def _answered(table: pa.Table, gain: float) -> pa.Table:
    kind, bucket = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    blobs = table.column("payload").to_pylist()
    got = sorted(map(_heard, blobs), key=lambda g: int(g[-1][0]))
    key, *values = (np.concatenate(c) for c in list(zip(*got, strict=True))[:-1])
    order, more = np.argsort(key, kind="stable"), []
    sorted_ = key[order]
    new = np.ones(len(key), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    back = np.empty(len(order), np.int64)
    back[order] = group
    if kind < STATES:
        n = values[0][order]
        total = np.add.reduceat(n, at)
        some = n > 0
        seen = np.cumsum(some)
        owner = np.zeros(len(key), bool)
        owner[order] = some & (seen - np.repeat(seen[at] - some[at], np.diff(np.append(at, len(key)))) == 1)
        answers = total[back] * _U(2) + owner.astype(_U)
        more = [np.array([np.count_nonzero(total)], _U)] if kind == 1 else []
    else:
        following, gained = (np.add.reduceat(v[order].view(np.int64), at) for v in values)
        answers = np.where(gained >= gain * UNIT * following, following, 0)[back]
    ends = np.cumsum([len(g[0]) for g in got])
    return _replies([(int(g[-1][0]), kind, bucket, X.squeeze([answers[e - len(g[0]) : e], *more])) for g, e in zip(got, ends, strict=True)])


def _replies(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], schema=REPLY_ARROW)


class _Answers:
    """Replies to a shard, by kind and in the order of buckets."""

    def __init__(self, replies: pa.Table):
        self.of: dict[int, list[bytes]] = {}
        rows = zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "payload")), strict=True)
        for k, _, payload in sorted(rows, key=lambda r: r[:2]):
            self.of.setdefault(k, []).append(payload)

    def _got(self, kind: int, column: int = 0) -> np.ndarray:
        return np.concatenate([np.zeros(0, _U), *(X.stretch(b)[column] for b in self.of.get(kind, []))])

    def counts(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the told grams, in 4 bytes if there is room, and which of them are this shard's own."""
        got = self._got(kind)
        return (got >> _U(1)).astype(np.uint32 if got.max(initial=_U(0)) < _U(1 << 33) else np.int64), (got & _U(1)) > 0

    def states(self, kind: int) -> np.ndarray:
        return self._got(kind).astype(np.float64)

    def vocabulary(self) -> int:
        return int(self._got(1, 1).sum())


def _pass(number: int, depth: int, least: int, buckets: int, tokens: int, bits: int):
    """What a shard does with its documents and the replies so far. Pass 1 tells tokens and pairs; pass p tells the contexts of p - 1 tokens and the grams of
    p + 1 tokens; pass depth + 2 scores."""

    def run(docs: pa.Table, replies: pa.Table | None) -> pa.Table:
        last = number == depth + 2
        if not docs.num_rows:
            return pa.Table.from_batches([], RESULT_ARROW) if last else _told([])
        s, me, rows = _Shard(docs.column("payload")[0].as_py(), bits), docs.column("part")[0].as_py(), []
        def tell_grams(k: int, where: np.ndarray) -> None:
            grams = s.grams(k, where)
            rows.extend(_tell(k, grams.keys, [grams.total(s.learned).view(_U)], me, buckets, bits))

        everywhere = np.ones(len(s.number), bool)
        if number == 1:
            tell_grams(1, everywhere)
            tell_grams(2, everywhere)
            return _told(rows)
        answers = _Answers(replies)

        def count(k: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Counts of grams of k tokens at each position (0 where not told), and which positions are the first of those that this shard owns (k > 1)."""
            grams = s.grams(k, where)
            got, own = answers.counts(k)
            out, first = np.zeros(len(s.number), got.dtype), np.zeros(len(s.number), bool)
            out[grams.positions] = grams.each(got)
            if k > 1:
                first[grams.first[own]] = True
            return out, first

        def sums(x: np.ndarray) -> np.ndarray:
            """Sums of each text, in its order."""
            return np.array([np.add.accumulate(x[a : a + n])[-1] for a, n in zip(s.starts.tolist(), s.sizes.tolist(), strict=True)])

        c, _ = count(1, everywhere)
        texts = int(c[s.sizes[0] - 1])  # as often as the end token, texts were learned from
        p = (c + 0.1) / (tokens + 0.1 * (answers.vocabulary() + 1))
        if last:
            known, base = np.add.reduceat(c > 0, s.starts, dtype=np.int64), sums(np.log10(p))
        where = everywhere
        for k in range(1, min(depth, number - 1) + 1):
            longer, owned = count(k + 1, where)
            n = s.before(c, 1, texts)  # of the context
            used = where & (n >= least)
            contexts = s.contexts(k, used)
            if k == number - 1:
                at = np.flatnonzero(used & s.learned)
                ratio = n[at] * p[at]
                np.log(np.divide(longer[at], ratio, out=ratio), out=ratio)
                ratio *= UNIT
                gained = np.zeros(len(s.number), np.int64)
                gained[at] = np.rint(ratio, out=ratio)
                del n, ratio
                rows.extend(_tell(STATES + k, contexts.keys, [contexts.total(owned).view(_U), contexts.total(gained).view(_U)], me, buckets, bits))
                if k < depth:
                    c = longer
                    tell_grams(k + 2, _next(s, c, k, least))
                break
            t = contexts.each(answers.states(STATES + k))
            state = t > 0
            at, t = contexts.positions[state], t[state]
            p[at] = (longer[at] + t * p[at]) / (n[at] + t)
            c = longer
            where = _next(s, c, k, least)
        if not last:
            return _told(rows)
        columns = [s.ids, pa.array(s.held), pa.array(s.sizes), pa.array(known), pa.array(np.full(len(s.sizes), tokens)), pa.array(base), pa.array(sums(np.log10(p)))]
        return pa.Table.from_arrays(columns, schema=RESULT_ARROW)

    return run if number > 1 else lambda docs: run(docs, None)


def _next(s: _Shard, c: np.ndarray, k: int, least: int) -> np.ndarray:
    """Positions whose context of k + 1 tokens is frequent enough; c are the counts of grams of that length."""
    return (s.place >= k) & (s.before(c, 1, 0) >= least)


def learned_tokens(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> int:
    """Tokens of the documents that are learned from."""

    def run(batches):
        for b in K.slices(batches):
            learned = (t for t, i in zip(K.each_bytes(b.column("text")), b.column("id").to_pylist(), strict=True) if not held_out(i))
            n = sum(n + 1 for _, group in K.runs(learned) for n in K.word_counts(group))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return int(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0)


def score(docs: DataFrame, depth: int = 2, least: int = 3, gain: float = 1.0, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability). Learned
    are the documents whose crc32 (of the id as text) is no multiple of 10."""
    spark = docs.sparkSession
    _, size = X.text_size(docs, text)
    buckets = X.parts(spark, size, 12 << 20)
    tokens = learned_tokens(docs, id_column, text)
    bits = min(64, max(40, 2 * tokens.bit_length() + 2))  # of N grams, less than an eighth of one is expected to have another's key
    shards = held(docs, id_column, text).repartition(buckets, "part").groupBy("part")
    heard = None  # replies of all passes, each shuffled once: one partitioning, which the union keeps
    for number in range(1, depth + 3):
        run = _pass(number, depth, least, buckets, tokens, bits)
        if number == depth + 2:
            return shards.cogroup(heard.groupBy("part")).applyInArrow(run, RESULT)
        entries = shards.applyInArrow(run, TOLD) if heard is None else shards.cogroup(heard.groupBy("part")).applyInArrow(run, TOLD)
        replies = entries.groupBy("kind", "part").applyInArrow(_bucket(gain), REPLY).repartition(buckets, "part")
        heard = replies if heard is None else heard.unionByName(replies)


def op12_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
