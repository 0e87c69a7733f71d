"""Byte-pair training for any number of distinct chunks.

The chunks stay in one table, and a second one, the index, says which chunks have a pair. A round takes as many merges as cannot influence each other, reads
the chunks that the index names for them, adds what changed to the index, and tells the driver the changes of the pairs' totals; so a merge costs what its
own chunks cost, and a job serves many merges. Chunks are not rewritten in a round: a task brings those it reads up to date by the merges since they were
stored. Every FOLD merges the chunks are stored anew and the index is built again. The driver holds one total for each pair: 65,536 pairs of bytes, and each
merge adds at most two with every token there is, so after n merges there are fewer than 65,536 + n (n + 514), whatever the corpus.

The merges of a round are the head of the ranking of pairs, (c, d) being added as long as for no earlier (a, b) of the round d = a or c = b: then no earlier
merge takes an occurrence of (c, d) away. What an earlier merge makes, (x, ab) or (ab, y), is at most as frequent as (x, a) or (b, y) are, and these
come later in the ranking (or would have ended the round), so only where one of them is as frequent as (c, d) could it come first; there the
round ends too, and where (a, a) is twice as frequent as (c, d). Ties go to the pair of the first chunk, then the most frequent one in it, then the
first one in it; they are looked up only where the round gets to them.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.shared import drop, keep

from .merging import merge_word

BYTES = 256
#: Merges after which the chunks are stored with the merges done.
FOLD = 512
#: Pairs of the ranking's head that are looked at in a round.
HEAD = 128
#: Chunks of a round that are looked up by broadcast; more are found by reading all chunks.
FEW = 1 << 18
#: Files of an index, by pair.
BUCKETS = 16


def learn(chunks: DataFrame, n: int) -> list[tuple[int, int]]:
    """The first n merges of chunks: (chunk, first_text, first_pos, n) as chunk_counts() of bpe.py gives them, a chunk being one character for each byte."""
    return Learner(chunks).run(n)


def _key(a: int, b: int) -> int:
    return a << 32 | b


def _bucket(pair):
    """The file of a pair in the index: of a number or of a column."""
    return pair % 8191 % BUCKETS


class Learner:
    def __init__(self, counts: DataFrame):
        self.spark = counts.sparkSession
        self.merges: list[tuple[int, int]] = []
        self.stored = 0  # merges that the stored chunks have
        order = ["first_text", "first_pos"]
        parts = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        some = counts.where(F.length("chunk") > 1).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        ids = F.encode("chunk", "ISO-8859-1")
        self.chunks = keep(some.select(F.monotonically_increasing_id().alias("no"), "n", ids.alias("ids")), "bpe-chunks")
        self.rounds = 0
        self._store(1)

    # -- tables ------------------------------------------------------------------------------

    def _store(self, width: int) -> None:
        """Index and totals of the stored chunks, whose ids are integers of `width` bytes."""
        self.width = width
        self.totals: dict[int, list[int]] = {}  # of a pair: its total, and its entries in the index
        self.made: list[DataFrame] = []
        made = self._made(self.chunks, [])
        postings = made.where("kind = 1").select("pair", F.col("a").alias("no"), _bucket(F.col("pair")).alias("bucket"))
        self.index = keep(postings.repartition(BUCKETS, "bucket"), "bpe-index", "bucket")
        drop(made)
        self.made = []

    def _made(self, chunks: DataFrame, batch: list[tuple[int, int]]) -> DataFrame:
        """The table of _changes(), after its totals are added to the driver's."""
        made = keep(chunks.mapInArrow(_changes(self, self.merges, batch), "kind int, pair long, a long, b long"), "bpe-pairs", "kind")
        for r in made.where("kind = 0").groupBy("pair").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
            own = self.totals.setdefault(r["pair"], [0, 0])
            own[0] += r["a"]
            own[1] += r["b"]
            if not own[0]:
                del self.totals[r["pair"]]
        self.made.append(made)
        return made

    def _fold(self) -> None:
        """Stores the chunks with all merges done, and their index."""
        old = [self.chunks, self.index, *self.made]
        self.chunks = keep(self.chunks.mapInArrow(_rewritten(self, self.merges), "no long, n long, ids binary"), "bpe-chunks")
        self.stored = len(self.merges)
        self._store(4)
        for t in old:
            drop(t)

    def _having(self, pairs: list[int], places: int) -> DataFrame:
        """The stored chunks that had one of the pairs at some time since they were stored; places: entries of the index for them."""
        if places > FEW or len(pairs) > HEAD:
            return self.chunks
        found = self.index.where(F.col("bucket").isin(*{_bucket(p) for p in pairs})).where(F.col("pair").isin(*pairs)).select("no")
        for t in self.made:
            found = found.unionByName(t.where("kind = 1").where(F.col("pair").isin(*pairs)).select(F.col("a").alias("no")))
        return self.chunks.join(F.broadcast(found), "no", "left_semi")

    # -- rounds ------------------------------------------------------------------------------

    def _next(self, most: int) -> list[int]:
        """The pairs of the next round, in order."""
        head = heapq.nlargest(HEAD, ((t, -p) for p, (t, _) in self.totals.items()))
        if not head:
            return []
        least = head[-1][0] if len(head) == HEAD and len(self.totals) > HEAD else 0
        ranking = [(-p, t) for t, p in head if t > least]  # with all that are as frequent
        if not ranking:
            ranking = [(p, t) for p, (t, _) in self.totals.items() if t == head[0][0]]
        seen = Counter(t for _, t in ranking)
        single = next((i for i, (_, t) in enumerate(ranking) if seen[t] > 1), len(ranking))
        batch = independent(ranking[:single], most, ranking)
        if len(batch) < single or len(batch) == most or single == len(ranking):
            return batch
        place = self._ties([p for p, t in ranking if seen[t] > 1])
        ranking.sort(key=lambda x: (-x[1], place.get(x[0])))
        return independent(ranking, most, ranking)

    def _ties(self, pairs: list[int]) -> dict[int, tuple[int, int, int]]:
        """The first chunk of each pair, minus its number there, and its first place."""
        chunks = self._having(pairs, sum(self.totals[p][1] for p in pairs))
        first = chunks.mapInArrow(_first_places(self, self.merges, set(pairs)), "pair long, no long, few long, at long")
        best = first.groupBy("pair").agg(F.min(F.struct("no", "few", "at")).alias("m")).select("pair", "m.no", "m.few", "m.at")
        return {r["pair"]: (r["no"], r["few"], r["at"]) for r in best.collect()}

    def run(self, n: int) -> list[tuple[int, int]]:
        while len(self.merges) < n:
            if len(self.merges) - self.stored >= FOLD:
                self._fold()
            batch = self._next(n - len(self.merges))
            if not batch:
                break
            pairs = [(p >> 32, p & 0xFFFFFFFF) for p in batch]
            self._made(self._having(batch, sum(self.totals[p][1] for p in batch)), pairs)
            self.merges = [*self.merges, *pairs]
            self.rounds += 1
        for t in (self.chunks, self.index, *self.made):
            drop(t)
        return self.merges


def independent(ranking: list[tuple[int, int]], most: int, whole: list[tuple[int, int]]) -> list[int]:
    """The merges of one round (see the module's text) from (pair, total) in order; whole has all pairs that are as frequent as the last."""
    out, firsts, seconds = [], set(), set()
    equal: dict[int, list[int]] = defaultdict(list)
    for p, t in whole:
        equal[t].append(p)
    doubled = 0  # how often a pair of two such new tokens can occur as come of (a, a)
    for p, total in ranking:
        a, b = p >> 32, p & 0xFFFFFFFF
        if len(out) == most or b in firsts or a in seconds or (out and total <= doubled):
            break
        if out and any(q not in out and ((q & 0xFFFFFFFF) in firsts or (q >> 32) in seconds) for q in equal[total]):
            break
        out.append(p)
        firsts.add(a)
        seconds.add(b)
        doubled = max(doubled, total // 2 * (a == b))
    return out


# -- in tasks ------------------------------------------------------------------------------------


def _current(b: pa.RecordBatch, width: int, ranks: dict[tuple[int, int], int]):
    """(no, n, ids) of a batch of stored chunks, brought up to date."""
    kind = "u1" if width == 1 else "<i4"
    for no, n, raw in zip(b.column("no").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True):
        ids = np.frombuffer(raw.as_buffer(), kind).tolist()
        yield no, n, merge_word(ids, ranks) if ranks else ids


def _since(learner: Learner, merges: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """Ranks of the merges that the stored chunks lack."""
    return {p: k for k, p in enumerate(merges) if k >= learner.stored}


def _rewritten(learner: Learner, merges):
    width, ranks = learner.width, _since(learner, merges)

    def run(batches):
        for b in batches:
            rows = list(_current(b, width, ranks))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([np.array(r[2], "<i4").tobytes() for r in rows], pa.binary())], names=["no", "n", "ids"])

    return run


def _rows(kind: int, pair: list, a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(pair), pa.int32()), pa.array(pair, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "pair", "a", "b"])


def _changes(learner: Learner, merges, batch):
    """What the merges of batch change: kind 0: (pair, change of its total, new entries in the index), one row for each task; kind 1: (pair, chunk), these entries. With
    no batch: all pairs, as if the chunks were new."""
    width, before, done = learner.width, _since(learner, merges), len(merges)
    after = {p: done + k for k, p in enumerate(batch)}

    def run(batches):
        total, places = Counter(), Counter()
        for b in batches:
            pair, no_of = [], []
            for no, n, ids in _current(b, width, before):
                if not after:
                    own = Counter(zip(ids, ids[1:], strict=False))
                    for p, k in own.items():
                        total[p] += n * k
                        places[p] += 1
                    pair += [_key(*p) for p in own]
                    no_of += [no] * len(own)
                    continue
                old = Counter(zip(ids, ids[1:], strict=False))
                if not any(p in after for p in old):
                    continue
                new_ids = merge_word(ids, after)
                new = Counter(zip(new_ids, new_ids[1:], strict=False))
                for p, k in old.items():
                    if new.get(p, 0) != k:
                        total[p] += n * (new.get(p, 0) - k)
                for p, k in new.items():
                    if p not in old:
                        total[p] += n * k
                        places[p] += 1
                        pair.append(_key(*p))
                        no_of.append(no)
            yield _rows(1, pair, no_of, [0] * len(pair))
        keys = list(total)
        yield _rows(0, [_key(*p) for p in keys], [total[p] for p in keys], [places[p] for p in keys])

    return run


def _first_places(learner: Learner, merges, wanted: set[int]):
    """For each wanted pair: the first chunk of this task that has it, minus its number in that, and its first place."""
    width, ranks = learner.width, _since(learner, merges)

    def run(batches):
        best: dict[int, tuple[int, int, int]] = {}
        for b in batches:
            for no, _, ids in _current(b, width, ranks):
                here: dict[int, list[int]] = {}
                for i, p in enumerate(zip(ids, ids[1:], strict=False)):
                    k = _key(*p)
                    if k in wanted:
                        here.setdefault(k, [0, i])[0] += 1
                for k, (count, at) in here.items():
                    if k not in best or (no, -count, at) < best[k]:
                        best[k] = (no, -count, at)
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), *(pa.array([x[i] for x in best.values()], pa.int64()) for i in range(3))], names=["pair", "no", "few", "at"])

    return run
