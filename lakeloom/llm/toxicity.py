"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the words of a text (and their beginnings) is trained from confirmed toxic texts and
from unlabelled texts, which hold toxic ones too. Only features whose shares in the two differ significantly take part. With the class prior p (the share of toxic rows among the
labelled ones that may be learned from) the risk is p E+[loss(+)] + max(0, Eu[loss(-)] - p E+[loss(-)]): the second
part estimates the loss on clean texts and cannot fall below zero; where it does, the step goes back instead of on.

Labels are learned only from rows for which crc32(id as text) mod 5 is not 0. Label, language, source and id are no inputs of a
score. Defined cases: null texts are empty and get the score of a text without words; with no toxic row to learn from all scores are
0; null ids are scored and count as held out false; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as T
from . import textkit as K

POSITIVE, UNLABELLED = 3000, 8000
RESULT = "doc_id long, held_out boolean, score double, predicted int"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def is_held_out(id_column):
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        used = np.flatnonzero(weights)
        self.used, self.values, self.bias = used, weights[used], bias
        self._full = None

    def score(self, texts: Iterable[bytes]) -> np.ndarray:
        if self._full is None:
            self._full = np.zeros(T.WORD_COLUMNS)
            self._full[self.used] = self.values
        return T.sigmoid(T.score(texts, T.words, self._full, self.bias))


def fit(docs: DataFrame, labelled: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED, steps: int = 200, significant: float = 5.0, least_seen: int = 5, penalty: float = 1e-4) -> Model:
    """labelled: (id, y) with y 1 for toxic. At most `positive` toxic rows and `unlabelled` rows of docs are read."""
    own = labelled.where(~is_held_out(F.col("id")) & F.col("y").isNotNull())
    rows = own.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).first()
    prior = float(rows["toxic"] or 0) / max(1, rows["n"])
    if prior <= 0:
        return Model(np.zeros(T.WORD_COLUMNS), -100.0)
    prior = min(prior, 0.95)
    p, _ = T.sample(docs, own.where("y = 1"), T.words, positive)
    u, _ = T.sample(docs, docs.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).alias("y")).where(~is_held_out(F.col("id"))), T.words, unlabelled)
    if not p.n or not u.n:
        return Model(np.zeros(T.WORD_COLUMNS), -100.0)
    in_p, in_u = p.seen(T.WORD_COLUMNS), u.seen(T.WORD_COLUMNS)
    share = (in_p + in_u + 1) / (p.n + u.n + 2)
    gap = np.abs(in_p / p.n - in_u / u.n) / np.sqrt(share * (1 - share) * (1 / p.n + 1 / u.n))
    fit_for = (in_p + in_u >= least_seen) & (gap >= significant)  # the others differ by chance
    p, u, columns = p.only(fit_for), u.only(fit_for), np.flatnonzero(fit_for)
    d = len(columns)
    theta = np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    adam = T.Adam(d + 1, 0.03)
    for _ in range(steps):
        zp, zu = p.times(theta[:d]) + theta[d], u.times(theta[:d]) + theta[d]
        loss_minus = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        e_plus = -prior * T.sigmoid(-zp) / max(1, p.n)
        e_minus_p, e_minus_u = -prior * T.sigmoid(zp) / max(1, p.n), T.sigmoid(zu) / max(1, u.n)
        if loss_minus < 0:  # the estimate of a loss fell below zero: undo that part
            ep, eu = -e_minus_p, -e_minus_u
        else:
            ep, eu = e_plus + e_minus_p, e_minus_u
        g = np.append(p.back(ep, d) + u.back(eu, d), ep.sum() + eu.sum())
        g[:d] += penalty * theta[:d]
        adam.step(theta, g)
    full = np.zeros(T.WORD_COLUMNS)
    full[columns] = theta[:d]
    return Model(full, float(theta[d]))


def scored(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 from 0.5)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled))

    def run(batches):
        for b in K.slices(batches):
            s = model.value.score(K.each_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id").cast("long")).alias("held_out"), "text").mapInArrow(run, RESULT)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
