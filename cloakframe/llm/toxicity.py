"""Toxicity by a chain of linear classifiers.

Categories are predicted in order. The model of a category sees the document's words and the probabilities of all
earlier categories; in training those are out-of-fold predictions, so later models learn from probabilities as good
or bad as they will get. A category's model is a logistic regression over the words that tell it apart best.

Features are the presence of hashed words anywhere in the whole text, so one insult in a long text weighs as much as
in a short one. The chain is fitted on at most TRAIN_ROWS labelled documents, chosen by hash of their id; prediction
is one narrow pass.

Defined results
* null or empty text has no words: the intercepts alone decide;
* a row whose label in a category is null is not used for that category; a category without positive (or without
  negative) rows gets the constant probability 0 (or 1); no labels at all: 0 everywhere;
* a document with several different label rows is used once for each; of several texts of an id the smallest is learned
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

from .common import PUNCT, documents, text_blocks, words

BUCKET_BITS = 18
TRAIN_ROWS, FOLDS, FEATURES, THRESHOLD = 6000, 4, 400, 0.5
#: The chain, in order: the label table has one toxicity flag and a quality grade, so later links split the flag.
CATEGORIES = (("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 AND quality = 0"), ("toxic_high_quality", "toxic = 1 AND quality = 1"))


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of the words of each row, of the wanted buckets only."""
    hashes, counts = words(data, offsets, PUNCT)
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    if wanted is not None:
        ok = wanted[bucket]
        bucket, row = bucket[ok], row[ok]
    pair = np.unique(row << BUCKET_BITS | bucket)
    return pair >> BUCKET_BITS, pair & ((1 << BUCKET_BITS) - 1)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Link:
    """One category's model: weights of its words, of the earlier probabilities, and an intercept."""

    def __init__(self, row: np.ndarray, bucket: np.ndarray, earlier: np.ndarray, y: np.ndarray, steps: int = 200):
        n, size = len(y), 1 << BUCKET_BITS
        self.weights, self.chain, self.bias = np.zeros(size, np.float32), np.zeros(earlier.shape[1]), 0.0
        share = y.mean() if n else 0.0
        if share in (0.0, 1.0):
            self.bias = -40.0 if share == 0 else 40.0
            return
        df = np.bincount(bucket, minlength=size)
        hits = np.bincount(bucket, y[row].astype(float), size)
        z = (hits - df * share) / np.sqrt(np.maximum(1, df) * share * (1 - share))
        z[(df < 2) | (np.abs(z) < 3)] = 0
        best = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
        best = best[z[best] != 0]
        slot = np.full(size, -1)
        slot[best] = np.arange(len(best))
        ok = slot[bucket] >= 0
        x = np.zeros((n, len(best) + earlier.shape[1]), np.float32)
        x[row[ok], slot[bucket[ok]]] = 1
        x[:, len(best) :] = earlier
        w, b, y = np.zeros(x.shape[1], np.float32), float(np.log(share / (1 - share))), y.astype(np.float32)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, steps + 1):
            err = (y - sigmoid(x @ w + b)).astype(np.float32)
            g, gb = x.T @ err / n - 1e-4 * w, float(err.mean())
            m, v, mb, vb = m + 0.1 * (g - m), v + 0.01 * (g * g - v), mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
            c1, c2 = 1 - 0.9**step, 1 - 0.99**step
            w += (0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)).astype(np.float32)
            b += 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        self.weights[best] = w[: len(best)]
        self.chain, self.bias = w[len(best) :], b

    def predict(self, row: np.ndarray, bucket: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(np.bincount(row, self.weights[bucket], len(earlier)) + earlier @ self.chain + self.bias)


class Chain:
    def __init__(self, names: list[str]):
        self.names, self.links = names, []

    def fit(self, row: np.ndarray, bucket: np.ndarray, labels: np.ndarray, folds: int = FOLDS) -> None:
        """labels: 1, 0, or nan where unknown, (rows, categories). A link is fitted on the rows whose label is known; every
        row gets an out-of-fold probability for the links after it."""
        n = len(labels)
        fold, earlier = np.arange(n) % folds, np.zeros((n, 0))

        def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            at, use = np.cumsum(rows) - 1, rows[row]
            return at[row[use]], bucket[use], earlier[rows]

        for k in range(len(self.names)):
            known = ~np.isnan(labels[:, k])
            self.links.append(Link(*part(known), labels[known, k]))
            out = np.zeros(n)
            for f in range(folds) if k + 1 < len(self.names) else ():
                inside = known & (fold != f)
                out[fold == f] = Link(*part(inside), labels[inside, k]).predict(*part(fold == f))
            earlier = np.column_stack([earlier, out])
        self.wanted = np.any([link.weights != 0 for link in self.links], axis=0)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories), each fed to the next link."""
        row, bucket = present(data, offsets, self.wanted)
        p = np.zeros((len(offsets) - 1, 0))
        for link in self.links:
            p = np.column_stack([p, link.predict(row, bucket, p)])
        return p


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(labels, distinct word buckets uint32) of each document, as bytes."""
    for batch in batches:
        out = []
        for _, _, data, offsets in text_blocks(batch.column(1)):
            row, bucket = present(data, offsets)
            cuts = np.searchsorted(row, np.arange(len(offsets)))
            out += [bucket[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["labels", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Chain | None:
    """Fit on the ``train_rows`` label rows with the smallest hash of their id; only their features come here."""
    flags = F.concat(*[F.when(F.expr(e), F.lit("1")).when(~F.expr(e), F.lit("0")).otherwise(F.lit("?")) for _, e in categories])
    chosen = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), flags.alias("labels")).where(F.col("labels").rlike("[01]")).distinct().orderBy(F.xxhash64("i"), "labels").limit(train_rows)
    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "i").groupBy("i", "labels").agg(F.min("text").alias("text")).select("labels", "text").mapInArrow(_features, "labels string, buckets binary")
    got = sorted((bytes(r.buckets), r.labels) for r in found.collect())
    if not got:
        return None
    order = np.random.default_rng(5).permutation(len(got))  # folds must not follow the order of texts
    got = [got[k] for k in order]
    bucket = np.concatenate([np.frombuffer(b, np.uint32) for b, _ in got]).astype(np.int64)
    row = np.repeat(np.arange(len(got)), [len(b) // 4 for b, _ in got])
    chain = Chain([name for name, _ in categories])
    chain.fit(row, bucket, np.array([[np.nan if c == "?" else float(c) for c in s] for _, s in got]))
    return chain


def predict(df: DataFrame, chain: Chain | None, names: list[str], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_<category> for each, is_toxic): is_toxic tells if the first category reaches the threshold."""
    fields = [T.StructField("doc_id", df.schema[id_col].dataType), *[T.StructField(f"p_{n}", T.DoubleType()) for n in names], T.StructField("is_toxic", T.BooleanType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                p = chain.predict(data, offsets) if chain else np.zeros((hi - lo, len(names)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(np.ascontiguousarray(c)) for c in p.T], pa.array(p[:, 0] >= threshold)], schema.names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, chain, [n for n, _ in CATEGORIES])
