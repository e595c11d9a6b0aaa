"""Quality classification by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed byte trigrams is shared by all grades; ordered thresholds cut its score into grades:
P(grade > g_k) = sigmoid(score - theta_k). From these tail probabilities follow the expected grade and the most
probable grade. A document's features are the shares of its trigrams' buckets, over its whole text.

The model is fitted on at most TRAIN_ROWS rated documents, chosen by hash of their id; prediction is one narrow pass.

Defined results
* null or empty text has no trigram: its score is 0, so the thresholds alone grade it;
* null ratings are not used; one rated grade only: that grade with certainty; no rating at all: null results;
* a document with several different ratings is used once for each; of several texts of an id the smallest is learned
  from; rows that repeat an id are predicted one by one;
* other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, text_blocks

BUCKET_BITS = 15
TRAIN_ROWS, STEPS, RATE, PENALTY = 4000, 120, 0.1, 1e-6
#: Shares of buckets are small numbers; the score is this factor times their weighted sum.
SCALE = 30.0


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte trigram, row of each); trigrams never cross rows."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(32 - BUCKET_BITS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = row[:-2] == row[2:]
    return code[ok].astype(np.int64), row[:-2][ok]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    def __init__(self, grades: list[float]):
        self.grades = np.asarray(grades, float)
        self.weights = np.zeros(1 << BUCKET_BITS, np.float32)
        self.theta = np.zeros(max(0, len(grades) - 1))

    def fit(self, bucket: np.ndarray, share: np.ndarray, row: np.ndarray, grade: np.ndarray, steps: int = STEPS) -> None:
        """Full-batch Adam on the mean log-likelihood. theta_1 and the logarithms of the gaps are free, so the
        thresholds stay in order."""
        n, k = len(grade), len(self.grades)
        free = np.concatenate([[0.0], np.zeros(max(0, k - 2))])
        state = [np.zeros_like(self.weights, float), np.zeros_like(self.weights, float), np.zeros_like(free), np.zeros_like(free)]
        balance = (n / (k * np.maximum(1, np.bincount(grade, minlength=k))))[grade]
        w = self.weights.astype(float)
        for step in range(1, steps + 1):
            theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
            eta = SCALE * np.bincount(row, w[bucket] * share, n)
            upper = np.where(grade < k - 1, sigmoid(theta[np.minimum(grade, k - 2)] - eta), 1.0)
            lower = np.where(grade > 0, sigmoid(theta[np.maximum(grade - 1, 0)] - eta), 0.0)
            fu, fl, p = upper * (1 - upper), lower * (1 - lower), np.maximum(upper - lower, 1e-9)
            g_eta = -(fu - fl) / p * balance / n
            g_theta = np.bincount(np.minimum(grade, k - 2), np.where(grade < k - 1, fu / p, 0) * balance / n, k - 1) - np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, fl / p, 0) * balance / n, k - 1)
            g_free = np.concatenate([[g_theta.sum()], [g_theta[j + 1 :].sum() * np.exp(free[j + 1]) for j in range(k - 2)]])
            g_w = SCALE * np.bincount(bucket, g_eta[row] * share, len(w)) - PENALTY * w
            for x, g, m, v in ((w, g_w, state[0], state[1]), (free, g_free, state[2], state[3])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.weights = w.astype(np.float32)
        self.theta = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > g_k) for every row and every grade but the last."""
        bucket, row = trigrams(data, offsets)
        n = len(offsets) - 1
        eta = SCALE * np.bincount(row, self.weights[bucket], n) / np.maximum(1, np.bincount(row, minlength=n))
        return sigmoid(eta[:, None] - self.theta[None, :])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, buckets uint16, shares float32) of each document, as bytes."""
    for batch in batches:
        labels, cols = batch.column(0), [[], []]
        for _, _, data, offsets in text_blocks(batch.column(1)):
            bucket, row = trigrams(data, offsets)
            key, count = np.unique(row << BUCKET_BITS | bucket, return_counts=True)
            cuts = np.searchsorted(key >> BUCKET_BITS, np.arange(len(offsets)))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                cols[0].append((key[a:b] & ((1 << BUCKET_BITS) - 1)).astype(np.uint16).tobytes())
                cols[1].append((count[a:b] / max(1, count[a:b].sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([labels, pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], ["label", "buckets", "shares"])


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> OrdinalModel | None:
    """Fit on the ``train_rows`` ratings with the smallest hash of their id. Only those rows are joined and only
    their features come to the driver: one row a rating, whatever repeats, and 6 bytes a distinct trigram bucket of it, so
    at most TRAIN_ROWS * 2 ** BUCKET_BITS * 6 bytes."""
    chosen = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(grade_col).cast("double").alias("label")).distinct().orderBy(F.xxhash64("i"), "label").limit(train_rows)
    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i").groupBy("i", "label").agg(F.min("text").alias("text")).select("label", "text").mapInArrow(_features, "label double, buckets binary, shares binary")
    got = [(r.label, bytes(r.buckets), bytes(r.shares)) for r in found.collect()]
    got.sort()  # the order of rows must not matter
    if not got:
        return None
    grades = sorted({g for g, _, _ in got})
    model = OrdinalModel(grades)
    if len(grades) > 1:
        bucket = np.concatenate([np.frombuffer(b, np.uint16) for _, b, _ in got]).astype(np.int64)
        share = np.concatenate([np.frombuffer(s, np.float32) for _, _, s in got]).astype(float)
        row = np.repeat(np.arange(len(got)), [len(b) // 2 for _, b, _ in got])
        model.fit(bucket, share, row, np.array([grades.index(g) for g, _, _ in got]))
    return model


def predict(df: DataFrame, model: OrdinalModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, expected_grade, tail_prob, grade_pred): tail_prob is that of the best grade."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_prob", T.DoubleType()), T.StructField("grade_pred", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                if model is None:
                    out = [pa.nulls(hi - lo, pa.float64())] * 3
                else:
                    tails = np.concatenate([np.ones((hi - lo, 1)), model.tails(data, offsets)], axis=1)
                    each = tails - np.concatenate([tails[:, 1:], np.zeros((hi - lo, 1))], axis=1)
                    out = [pa.array(each @ model.grades), pa.array(tails[:, -1]), pa.array(model.grades[each.argmax(axis=1)])]
                yield pa.RecordBatch.from_arrays([ids, *out], schema.names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
