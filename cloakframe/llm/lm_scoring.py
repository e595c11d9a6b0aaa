"""Stupid-backoff scores of all documents under the n-gram counts of the whole corpus.

    S(w | context) = c_n / c_{n-1}(context)             if c_n >= MIN_COUNT
                   = ALPHA * S(w | shorter context)     otherwise;      S(w) = c_1 / N

The score of a document is the sum of log S over all its words. n-grams seen fewer than MIN_COUNT times back off.

Relational plan: documents are exploded to n-grams, count tables are partitioned by hash, counts are joined back to
the n-grams and summed per document. Rows of the exchanges are not single n-grams but sorted runs of them: a *unit*
(some megabytes of text) sends each hash bucket the distinct n-grams it holds, with their local counts; the bucket
adds up the counts of all units and answers each with the totals in the order asked. So an n-gram in a third of all
documents costs a row per unit, not per occurrence, and a run costs about four bytes an n-gram. The number of buckets
grows with the corpus, so that a bucket's share stays bounded; a unit sends a bucket a row only if it has n-grams for
it, so rows never outnumber n-grams, and the buckets' work and the units' work are both in proportion to n-grams.

n-grams are told apart by hashes of as many bits as keep the expected share of n-grams that meet another one below
2 ** -SPARE_BITS: 51 bits for 10^8 words, 64 for 10^12. Past that it is words / 2 ** 64: one in a million at 10^13.

Defined results
* null or empty text has no words: n_tokens 0, score 0, mean_log_score null;
* a word is a run of bytes other than white space, lower-cased in A-Z; n-grams never cross documents;
* rows that repeat an id (or a text) each count in the corpus and each get a row; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, expand, materialize, sequences, squeeze, text_blocks, words

ORDER, MIN_COUNT, ALPHA = 3, 2, 0.4
#: Bytes of text in a unit, and words of the corpus for each bucket of the count tables.
UNIT_BYTES, BUCKET_WORDS = 10 << 20, 3 << 20
#: Units whose answers one task reads, one after the other.
TASK_UNITS = 8
#: Bits of a hash beyond those that number the words of the corpus.
SPARE_BITS = 24


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of documents: ids, words of each document, and the words as places in a vocabulary, frequent ones first."""
    base, made = TaskContext.get().partitionId() << 32, 0
    ids, counts, hashes, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal made
        vocabulary, at, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.lexsort((vocabulary, -times))  # frequent words get small numbers
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        vocabulary, at = vocabulary[order], rank[at]
        row = [[base + made], [pa.concat_arrays(ids).to_pylist()], [squeeze(np.concatenate(counts))], [squeeze(np.diff(vocabulary, prepend=np.uint64(0)))], [squeeze(at)], [int(len(at))]]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.list_(pa.int64())), *[pa.array(x, pa.binary()) for x in row[2:5]], pa.array(row[5], pa.int64())], ["unit", "ids", "counts", "vocabulary", "at", "n_words"])

    for batch in batches:
        for lo, hi, data, offsets in text_blocks(batch.column(1)):
            h, c = words(data, offsets)
            ids.append(batch.column(0).slice(lo, hi - lo)), counts.append(c), hashes.append(h)
            size += len(data) + 8 * (hi - lo)
            if size >= UNIT_BYTES:
                yield flush()
                ids, counts, hashes, size = [], [], [], 0
    if ids:
        yield flush()


def hash_bits(total: int) -> int:
    """Bits of the hashes for a corpus of so many words."""
    return min(64, max(1, total).bit_length() + SPARE_BITS)


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes of the n-grams of a unit, in the order of their last words."""
    return sequences(hashes, counts, n)[0] >> np.uint64(64 - bits)


def bucket_runs(distinct: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, end) of the runs of a sorted array that fall into one bucket's range of hashes, without empty runs."""
    width = -(-(1 << bits) // buckets)
    bucket = distinct // np.uint64(width) if width < 1 << 64 else np.zeros(len(distinct), np.uint64)
    ends = np.flatnonzero(np.concatenate([bucket[1:] != bucket[:-1], [True]])) + 1 if len(distinct) else np.zeros(0, np.int64)
    return bucket[ends - 1].astype(np.int64), ends


def _words_of(counts: bytes, vocabulary: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumsum(expand(vocabulary), dtype=np.uint64)[expand(at).astype(np.int64)], expand(counts).astype(np.int64)


UNITS = "unit bigint, ids array<bigint>, counts binary, vocabulary binary, at binary, n_words bigint"


def score(df: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score, mean_log_score, n_backed_off): n_backed_off counts words that left full context."""
    units = materialize(df.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(_units, UNITS), "lm_units")
    total = units.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_WORDS))
    bits = hash_bits(total)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, order * buckets)
    unit_partitions = max(least, -(-units.count() // TASK_UNITS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, *packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                hashes, counts = _words_of(*packed)
                for n in range(1, order + 1):
                    distinct, times = np.unique(ngrams(hashes, counts, n, bits), return_counts=True)
                    of, ends = bucket_runs(distinct, buckets, bits)
                    rows = [(b, distinct[i:j], times[i:j]) for b, i, j in zip(of.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False)]
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n] * m, pa.int32()), pa.array([b for b, _, _ in rows], pa.int32()), pa.array([unit] * m, pa.int64()), pa.array([squeeze(np.diff(d, prepend=np.uint64(0))) for _, d, _ in rows], pa.binary()), pa.array([squeeze(t) for _, _, t in rows], pa.binary())],
                        ["n", "bucket", "unit", "grams", "times"],
                    )

    def add_up(table: pa.Table) -> pa.Table:
        """One bucket of one count table: totals for each unit that asked, in the order asked."""
        runs = [np.cumsum(expand(b), dtype=np.uint64) for b in table["grams"].to_pylist()]
        ends = np.cumsum([len(r) for r in runs])
        _, at = np.unique(np.concatenate(runs), return_inverse=True)
        totals = np.bincount(at, np.concatenate([expand(b) for b in table["times"].to_pylist()]).astype(float))[at].astype(np.uint64)
        return pa.table({"unit": table["unit"], "n": table["n"], "bucket": table["bucket"], "totals": pa.array([squeeze(t) for t in np.split(totals, ends[:-1])], pa.binary())})

    asked = units.select("unit", "counts", "vocabulary", "at").mapInArrow(ask, "n int, bucket int, unit bigint, grams binary, times binary")
    answers = asked.repartition(partitions, "n", "bucket").groupBy("n", "bucket").applyInArrow(add_up, "unit bigint, n int, bucket int, totals binary")
    out_type = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType()), T.StructField("n_backed_off", T.LongType())])

    def sum_up(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        """A unit's documents: counts of all orders beside each word, then the formula."""
        ids, counts = left["ids"].to_pylist()[0], left["counts"].to_pylist()[0]
        hashes, counts = _words_of(counts, left["vocabulary"].to_pylist()[0], left["at"].to_pylist()[0])
        told = [[] for _ in range(order + 1)]
        for n, b, t in zip(right["n"].to_pylist(), right["bucket"].to_pylist(), right["totals"].to_pylist(), strict=True):
            told[n].append((b, t))
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        c = np.zeros((order + 1, len(hashes)))
        for n in range(1, order + 1):
            distinct, at = np.unique(ngrams(hashes, counts, n, bits), return_inverse=True)
            if len(distinct):
                got = np.concatenate([expand(t) for _, t in sorted(told[n])]).astype(float)
                c[n, place >= n - 1] = got[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            log = np.log(c[1] / max(1, total))
            backed = np.zeros(len(hashes), bool)
            for n in range(2, order + 1):  # from the shortest context up
                context = np.concatenate([[1.0], c[n - 1, :-1]])
                full, seen = place >= n - 1, c[n] >= min_count
                backed = full & ~seen
                log = np.where(full & seen, np.log(c[n] / context), np.where(backed, np.log(alpha) + log, log))
        row = np.repeat(np.arange(len(counts)), counts)
        sums = np.bincount(row, log, len(counts))
        return pa.table([pa.array(ids, pa.int64()), pa.array(counts), pa.array(sums), pa.array(sums / np.maximum(1, counts), mask=counts == 0), pa.array(np.bincount(row, backed, len(counts)).astype(np.int64))], names=out_type.names)

    asked_by, answered = (f.repartition(unit_partitions, "unit") for f in (units.drop("n_words"), answers))
    return asked_by.groupBy("unit").cogroup(answered.groupBy("unit")).applyInArrow(sum_up, out_type)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
