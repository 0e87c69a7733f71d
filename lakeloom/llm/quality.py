"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < K have one shared weight for each hashed text feature and ordered thresholds:
P(grade > k) = sigmoid(score - threshold_k). Thresholds are the first one plus positive steps, so they stay in order. A text's
expected grade is the sum of these tails; it is kept if the tail above `grade` is at least `least`.

Defined cases: grades are the sorted distinct ratings of the sample (with one grade or no labelled row every text gets that
grade or 0, and all are kept); null texts are empty and score by the thresholds alone; null ratings and ids
are not learned from; repeated rows get equal scores; other columns are passed on or ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as T
from . import textkit as K

SAMPLE = 8000
RESULT = "doc_id long, expected_grade double, tail double, kept boolean"


class Model:
    def __init__(self, grades: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def tails(self, texts: Iterable[bytes]) -> np.ndarray:
        """P(grade > k) for each text and each k but the last."""
        z = T.score(texts, T.grams, self.weights, 0.0)
        return T.sigmoid(z[:, None] - self.thresholds[None, :])

    def judge(self, texts: Iterable[bytes], grade: float) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(rating >= grade)."""
        if not len(self.thresholds):
            n, only = sum(1 for _ in texts), float(self.grades[0]) if len(self.grades) else 0.0
            return np.full(n, only), np.ones(n)
        tails = self.tails(texts)
        n, expected = len(tails), self.grades[0] + tails @ np.diff(self.grades)
        k = int(np.searchsorted(self.grades, grade, "left"))
        return expected, np.ones(n) if k == 0 else tails[:, min(k, len(self.grades) - 1) - 1] if k < len(self.grades) else np.zeros(n)


def fit(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE, steps: int = 120, penalty: float = 1e-5) -> Model:
    """labelled: (id, y) with numeric ratings; at most `most` rows are read."""
    x, y = T.sample(docs, labelled, T.grams, most)
    grades = np.unique(y.astype(np.float64)) if len(y) else np.zeros(0)
    k = len(grades) - 1
    if k < 1:
        return Model(grades, np.zeros(T.GRAM_COLUMNS), np.zeros(0))
    level = np.searchsorted(grades, y.astype(np.float64))
    above = np.array([(level > j).mean() for j in range(k)])
    start = np.log((1 - above) / above)
    theta = np.concatenate([np.zeros(T.GRAM_COLUMNS), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    adam, n, d = T.Adam(len(theta), 0.05), len(y), T.GRAM_COLUMNS
    for _ in range(steps):
        steps_up = np.exp(theta[d + 1 :])
        cuts = theta[d] + np.concatenate([[0.0], np.cumsum(steps_up)])
        z = x.times(theta[:d])
        cdf = np.concatenate([np.zeros((n, 1)), T.sigmoid(cuts[None, :] - z[:, None]), np.ones((n, 1))], 1)  # P(level < j)
        i = np.arange(n)
        p = np.maximum(cdf[i, level + 1] - cdf[i, level], 1e-12)
        slope = cdf * (1 - cdf)
        dz = (slope[i, level + 1] - slope[i, level]) / p / n  # of the mean negative log-likelihood
        dcut = np.zeros((n, k + 2))
        dcut[i, level + 1] -= slope[i, level + 1] / p / n
        dcut[i, level] += slope[i, level] / p / n
        by_cut = dcut.sum(0)[1:-1]
        g = np.concatenate([x.back(dz, d) + penalty * theta[:d], [by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * steps_up])
        adam.step(theta, g)
    return Model(grades, theta[:d], theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1 :]))]))


def graded(docs: DataFrame, labelled: DataFrame, grade: float = 1.0, least: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, expected_grade, tail (P(rating >= grade)), kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled, most))

    def run(batches):
        for b in K.slices(batches):
            expected, tail = model.value.judge(K.each_bytes(b.column("text")), grade)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= least, pa.bool_())], names=["doc_id", "expected_grade", "tail", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def keep(docs: DataFrame, labelled: DataFrame, grade: float = 1.0, least: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """The rows of docs, with their columns, that are kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labelled, most))

    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in column:
            yield pa.array(model.value.judge(K.each_bytes(c), grade)[1] >= least, pa.bool_())

    return docs.where(F.arrow_udf(run, "boolean")(F.col("text")))


def ratings(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("y"))


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return graded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ratings(spark, sf_dir))
