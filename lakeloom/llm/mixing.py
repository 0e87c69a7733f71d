"""Mixing documents with target weights of domains, by soft membership.

A softmax classifier on hashed text, trained on a labelled table, gives each document's posterior over the domains. A
document's rate r >= 0 is how often it is to be used. With n tokens and posterior p, a domain's expected total is the sum of
r n p over all documents; the rates are to solve

    min 1/2 sum over domains of (totals / T - targets)^2 / share,  r >= 0

(T: all tokens, share: a domain's part of them before mixing). With gap = totals / T - targets, the gradient of a document's rate is p . (gap / share), so a
step of projected gradient is

    r <- max(0, r - p . (gap / share))

Dividing by the share gives each domain its own step, so a rare domain moves as fast as a hot one; a whole step never overshoots, since the
matrix of sums n p p' / T has the shares as its row sums. Steps go on until each target of a domain that has tokens is met to within TOLERANCE; where targets cannot
be met (posteriors that never are sure enough), steps end when they change nothing any more, and the gaps are warned about.

Many rates meet the targets; the steps begin near those closest to 1: r = max(0, 1 - p . start), the dual solution of a bounded sample with a small penalty
on (r - 1)^2. Rates follow from start, the gaps of the steps so far and a document's own posteriors, as a column expression, so a step is one
aggregation without Python, and no state is kept anywhere that could be lost.

Copies are floor(r + u), u uniform from a hash of the id, so their expected number is r.

Defined cases: null texts are empty and have no tokens, their rates follow from their posteriors like the others; null
ids draw the same u; domains without labelled rows get no posterior, their targets stay unmet; without any labelled row all
rates are 1; repeated rows get equal rates; an empty table gives an empty result; a column named like one of the result is replaced by that.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as T
from . import spill
from . import textkit as K

SAMPLE = 6000
#: Steps end when no share is further than this from its target.
TOLERANCE = 5e-4
#: A domain's share that is further than this from its target is warned about.
MISSED = 1e-3
#: Penalties on (r - 1)^2 with which the sample's rates are sought, until its targets are met.
PENALTIES = (1e-3, 1e-4, 1e-5, 1e-6)
RESULT = ("n_tokens", "posteriors", "rate")
#: Lengths of a Newton step that are tried in one pass.
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)


class Model:
    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        if not texts or not self.domains:
            return np.zeros((len(texts), len(self.domains)))
        z = T.score(texts, T.gram_shares, self.weights, self.bias)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE, steps: int = 60, penalty: float = 1e-5) -> Model:
    """labelled: (id, y) with y the domain's name; at most `most` rows are read."""
    x, y = T.sample(docs, labelled, T.gram_shares, most)
    domains = sorted(set(y.tolist()))
    k, d = len(domains), 1 << T.GRAM_BITS
    if not k:
        return Model([], np.zeros((0, d)), np.zeros(0))
    at = np.searchsorted(domains, y)
    hot = np.eye(k)[at]
    w, b = np.zeros((d, k)), np.log(hot.mean(0))
    flat = np.append(w.reshape(-1), b)
    adam = T.Adam(len(flat), 0.05)
    for _ in range(steps):
        w, b = flat[:-k].reshape(d, k), flat[-k:]
        z = np.stack([x.times(w[:, j]) for j in range(k)], 1) + b
        e = np.exp(z - z.max(1, keepdims=True))
        err = (e / e.sum(1, keepdims=True) - hot) / len(y)
        g = np.stack([x.back(err[:, j], d) for j in range(k)], 1) + penalty * w
        adam.step(flat, np.append(g.reshape(-1), err.sum(0)))
    return Model(domains, flat[:-k].reshape(d, k).T.copy(), flat[-k:].copy())


def rates_at(p: np.ndarray, gap: np.ndarray, penalty: float) -> np.ndarray:
    """The rates that a gap of the domains' shares asks for."""
    return np.maximum(0.0, 1 - p @ gap / penalty)


def dual_sums(p: np.ndarray, n: np.ndarray, points: np.ndarray, penalty: float) -> np.ndarray:
    """For each point: sum of n r r, sums of n r p, and sums of n p p' where r > 0; one row."""
    out = []
    for g in points:
        r = rates_at(p, g, penalty)
        on = r > 0
        out.append(np.concatenate([[n @ (r * r)], (n * r) @ p, ((p[on] * n[on, None]).T @ p[on]).reshape(-1)]))
    return np.array(out)


def solve(gather: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, total: float, penalty: float, steps: int, tolerance: float, near: np.ndarray | None = None) -> np.ndarray:
    """The gap at the minimum; gather(points) gives the sums of dual_sums() over all rows. near: a gap to try at the start beside 0."""
    if penalty <= 0:
        raise ValueError("the penalty must be positive")
    k = len(wanted)
    points, value, least, gap = np.zeros((1, k)), np.inf, max(tolerance * penalty, 1e-12), None
    if near is not None:
        points = np.stack([points[0], near])
    for _ in range(steps):
        sums = gather(points) / total
        values = penalty / 2 * sums[:, 0] + points @ wanted + (points * points).sum(1) / 2
        slopes = points + wanted - sums[:, 1 : k + 1]
        norms = np.abs(slopes).max(1)
        best = int(norms.argmin()) if norms.min() <= least else int(values.argmin())
        if norms[best] <= least:
            return points[best]
        if gap is not None and values[best] >= value:
            lengths = lengths * LENGTHS[-1]  # none of them came lower: the same direction, shorter
        else:
            gap, value, slope, lengths = points[best], values[best], slopes[best], np.array(LENGTHS)
            step = np.linalg.solve(np.eye(k) + sums[best, k + 1 :].reshape(k, k) / penalty, slope)
        points = gap - lengths[:, None] * step
    raise RuntimeError(f"rates not found in {steps} steps: the optimality condition is off by {np.abs(slope).max():.3g}, {least:.3g} is asked for")


def rate_of(posteriors, moves: list[np.ndarray]):
    """The rate after moves r <- max(0, r - p . move) from 1, as a column expression on an array of posteriors; 1 where there are no domains."""
    moves = [m for m in moves if len(m)]
    if not moves:
        return F.lit(1.0)
    given = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])
    dot = lambda m: F.aggregate(F.zip_with(posteriors, m, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(given, F.lit(1.0), lambda r, m: F.greatest(F.lit(0.0), r - dot(m)))


def rates_after(p: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """rate_of() of an array of posteriors."""
    r = np.ones(len(p))
    for m in moves:
        r = np.maximum(0.0, r - p @ m)
    return r


def descend(gather: Callable[[list[np.ndarray]], np.ndarray], share: np.ndarray, wanted: np.ndarray, start: np.ndarray | None, steps: int, tolerance: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Moves of projected gradient until the targets of domains with a share are met, and the gaps that are left. gather(moves) gives the shares at the rates after
    these moves."""
    moves = [] if start is None else [start]
    scale = np.where(share > 0, 1 / np.maximum(share, 1e-300), 0.0)
    value = np.inf
    for k in range(steps + 1):
        gap = gather(moves) - wanted
        now = float(gap @ (scale * gap))
        if np.abs(gap[share > 0]).max(initial=0.0) <= tolerance or k == steps or now > value * (1 - 1e-3):
            break
        value = now
        moves.append(scale * gap)
    return moves, gap


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], steps: int = 60, tolerance: float = TOLERANCE, most: int = SAMPLE, text: str = "text") -> DataFrame:
    """docs with n_tokens, posteriors (array, domains in sorted order) and rate."""
    return rated(docs, labelled, targets, docs.columns, steps, tolerance, most, text)[0]


def rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], columns: list[str], steps: int = 60, tolerance: float = TOLERANCE, most: int = SAMPLE, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The given columns of docs with n_tokens, posteriors and rate, and the domains that the posteriors stand for.

    Texts go to Python once, alone, and only (n_tokens, posteriors) come back; the table that the passes read holds the given columns, of
    which they read none. Rates are a column expression on the posteriors.
    """
    spark = docs.sparkSession
    columns = [c for c in columns if c not in RESULT]
    fitted = fit(docs, labelled, most)
    model = spark.sparkContext.broadcast(fitted)

    def judge(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in column:
            sizes, found = [], []
            for _, group in K.runs(K.each_bytes(c)):
                sizes += K.word_counts(group)
                found.append(model.value.posteriors(group))
            p = np.concatenate(found) if found else np.zeros((0, len(model.value.domains)))
            k = p.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * k, pa.int32()), pa.array(p.reshape(-1), pa.float64()))
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), lists], names=["n_tokens", "posteriors"])

    judged = F.arrow_udf(judge, "n_tokens long, posteriors array<double>")(F.col(text))
    own = [F.col(c) for c in columns]
    table = spill.write(docs.select(F.struct(*own).alias("row"), judged.alias("judged")), "posteriors")
    table = table.select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("judged.n_tokens").alias("n_tokens"), F.col("judged.posteriors").alias("posteriors"))
    total = float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    wanted = np.array([float(targets.get(d, 0.0)) for d in fitted.domains])
    moves: list[np.ndarray] = []
    small = table.select("n_tokens", "posteriors").where("n_tokens > 0")
    if total > 0 and len(wanted):
        wanted = wanted / max(sum(targets.values()), 1e-300)
        gather = lambda m: _shares(small, m, len(wanted), total)
        moves, gap = descend(gather, gather([]), wanted, _near(small, wanted, most, tolerance), steps, tolerance)
        missed = {d: (round(float(w + g), 4), round(float(w), 4)) for d, w, g in zip(fitted.domains, wanted, gap, strict=True) if abs(g) > MISSED}
        if missed:
            warnings.warn(f"shares that miss their targets, as (share, target): {missed}", stacklevel=3)
    return table.withColumn("rate", rate_of(F.col("posteriors"), moves)), fitted.domains


def _near(small: DataFrame, wanted: np.ndarray, most: int, tolerance: float) -> np.ndarray | None:
    """The first move: to the rates closest to 1 that meet the targets on at most `most` rows by themselves."""
    some = small.orderBy(F.xxhash64("n_tokens", "posteriors"), "n_tokens").limit(most).collect()
    p, n = np.array([r["posteriors"] for r in some]), np.array([r["n_tokens"] for r in some], np.float64)
    found, left = None, np.inf
    for penalty in PENALTIES:
        try:
            gap = solve(lambda points: dual_sums(p, n, points, penalty), wanted, n.sum(), penalty, 200, 1e-3, None if found is None else found * penalty)  # noqa: B023
        except (RuntimeError, np.linalg.LinAlgError):
            break
        if np.abs(gap).max() > 0.5 * left:  # what is left cannot be met
            break
        found, left = gap / penalty, np.abs(gap).max()
        if left <= tolerance:
            break
    return found


def _shares(small: DataFrame, moves: list[np.ndarray], k: int, total: float) -> np.ndarray:
    """The domains' shares at the rates after moves: one aggregation."""
    used = small.select(F.col("posteriors").alias("p"), (F.col("n_tokens") * rate_of(F.col("posteriors"), moves)).alias("n"))
    row = used.agg(*[F.sum(F.col("n") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]).first()
    return np.array([float(x or 0.0) for x in row]) / total


def copies(rate, id_column):
    """Number of copies of a document: floor(rate + u), u in [0, 1) from a hash of the id."""
    u = F.pmod(F.xxhash64(id_column, F.lit(5)), F.lit(1 << 40)) / float(1 << 40)
    return F.floor(rate + u).cast("int")


def domains(spark, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(id, y): the language of the documents that the labels table covers."""
    own = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("id")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("y")).join(own, "id", "left_semi")


#: Target weights of the production mix.
TARGETS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, with all their columns, with n_tokens, posteriors, rate and copies."""
    out = mix(docs, domains(spark, sf_dir, docs), TARGETS)
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, names = rated(docs, domains(spark, sf_dir, docs), TARGETS, ["doc_id"])
    known = {d: F.col("posteriors")[k] for k, d in enumerate(names)}
    own = [known.get(d, F.lit(None).cast("double")).alias(f"p_{d}") for d in sorted(TARGETS)]
    return got.select("doc_id", "n_tokens", *own, "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
