"""Decontamination against a benchmark with BM25 and block-max pruning.

The benchmark's items form an inverted index: for each term its postings with impacts, the largest impact of the list,
and sparsely, for the blocks of BLOCK_ITEMS items that hold the term, the largest impact in the block. An impact is a
BM25 weight divided by the item's score against itself, so one threshold serves items of any length. Number of items,
their mean length and document frequencies are those of the whole benchmark.

Every passage of every document is a query. Block maxima of a passage's terms are summed per block, first by stride for
all passages of a stretch of text together; a passage without a block that reaches the threshold is done. Any other walks the postings
(block-max WAND): cursors in order of item, the pivot is the first item that the lists' maxima allow to reach the
threshold; if the block's maxima do not, the cursors leave the block, else they move up to the pivot and it is scored.
All items at or above the threshold are retrieved, not a top k.

Retrieved pairs are verified on the words themselves: the question's and the answer's word sequences must both be
covered by the passage. An item without separate columns is split at its last sentence; an item of one sentence at
two thirds of its words.

Passages are two strides long, and a stride is the least power of two, MIN_STRIDE at least, that holds the item: items
of like length share their passages, and what an item is held against depends on nothing but its length. The document
side is one narrow pass without shuffle. The index is sent in shards of SHARD_BYTES of item text, so what is broadcast
is bounded; a larger benchmark takes more passes, never a larger broadcast, and every score stays the same.

Defined results
* null or empty texts and items have no words and match nothing;
* a document that holds an item many times gives one row, with the best score; rows that repeat an id are searched
  one by one; items with equal text each give a row;
* items of any length are found, since passages of every length class overlap by a whole item;
* :func:`decontaminate` decides row by row, so rows without id go like any other;
* other columns are never looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PUNCT, documents, materialize, sequences, text_blocks, words

K1, B = 1.2, 0.75
#: Share of an item's self-score that a passage must reach to be retrieved, and the overlaps that verify it.
THRESHOLD, QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.7, 0.7
BLOCK_ITEMS, MIN_STRIDE, SHARD_BYTES = 4, 64, 4 << 20
#: Block maxima summed at once, and the tolerance of sums against the threshold.
CELLS, SLACK = 1 << 21, 1e-9


def split_item(text: str) -> tuple[str, str]:
    """(question, answer) of an item without such columns."""
    parts = [m.group() for m in re.finditer(r"[^.?!\n]+[.?!\n]*", text) if re.search(r"\w", m.group())]
    if len(parts) > 1 and re.search(r"\w.*\w", parts[-1]):
        return "".join(parts[:-1]), parts[-1]
    w = text.split()
    return " ".join(w[: -(-2 * len(w) // 3)]), " ".join(w[-(-2 * len(w) // 3) :])


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), PUNCT)[0]


def _gram_size(n: int) -> int:
    """Words in a sequence that is compared: short texts are compared in shorter ones, so one word changed spoils few."""
    return 3 if n >= 12 else 2 if n >= 6 else 1


def _grams(hashes: np.ndarray) -> np.ndarray:
    return np.unique(sequences(hashes, np.array([len(hashes)]), _gram_size(len(hashes)))[0])


def stride_of(n: int) -> int:
    return max(MIN_STRIDE, 1 << (n - 1).bit_length())


class Statistics:
    """Of all items: their number, mean length, and the document frequencies of the terms of a shard."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.terms, self.df = n, mean, terms, df

    @classmethod
    def of(cls, items: list[tuple[int, str, str]]) -> Statistics:
        lists = [np.concatenate([_hashes(q), _hashes(a)]) for _, q, a in items]
        lists = [x for x in lists if len(x)]
        terms, df = np.unique(np.concatenate([np.unique(x) for x in lists]), return_counts=True) if lists else (np.zeros(0, np.uint64), np.zeros(0))
        return cls(len(lists), sum(map(len, lists)) / max(1, len(lists)), terms, df)


class Index:
    """Inverted index of items of one stride, small enough to send to every task."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], known: Statistics):
        """items: (item_id, words of the question, words of the answer), with a word at least."""
        self.ids, n = [i for i, _, _ in items], len(items)
        whole = [np.concatenate([q, a]) for _, q, a in items]
        self.stride = stride_of(max(map(len, whole)))
        self.terms = np.unique(np.concatenate(whole))
        lengths = np.array([len(x) for x in whole], float)
        term, item, tf = [], [], []
        for k, x in enumerate(whole):
            t, c = np.unique(np.searchsorted(self.terms, x), return_counts=True)
            term.append(t), item.append(np.full(len(t), k)), tf.append(c)
        term, item, tf = (np.concatenate(a) for a in (term, item, tf))
        df = known.df[np.searchsorted(known.terms, self.terms)]
        idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / known.mean))
        impact = weight / np.bincount(item, weight, n)[item]
        # postings by term, then item; block maxima likewise, only where a block holds the term
        by = np.lexsort((item, term))
        term, self.item, self.impact = term[by], item[by].astype(np.int32), impact[by]
        self.begin = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.impact, self.begin[:-1])
        self.blocks = -(-n // BLOCK_ITEMS)
        cell = term * self.blocks + self.item // BLOCK_ITEMS
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.block, self.block_most = (cell[first] % self.blocks).astype(np.int32), np.maximum.reduceat(self.impact, first)
        self.block_begin = np.searchsorted(cell[first] // self.blocks, np.arange(len(self.terms) + 1))
        self.grams = [(_grams(q), _gram_size(len(q)), _grams(a), _gram_size(len(a))) for _, q, a in items]

    def bounds(self, stride: np.ndarray, term: np.ndarray, low: int, high: int) -> np.ndarray:
        """Sums of block maxima (strides from low to high, blocks) for sorted pairs of stride and term."""
        a, b = np.searchsorted(stride, [low, high])
        stride, term = stride[a:b] - low, term[a:b]
        each = self.block_begin[term + 1] - self.block_begin[term]
        out = np.zeros((high - low) * self.blocks)
        ends = np.cumsum(each)
        at = 0
        while at < len(term):  # a bounded number of maxima at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
            n = each[at:to]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.block_begin[term[at:to]], n)
            out += np.bincount(np.repeat(stride[at:to], n) * self.blocks + self.block[place], self.block_most[place], len(out))
            at = to
        return out.reshape(high - low, self.blocks)

    def walk(self, terms: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
        """Block-max WAND: (item, score) of the items that score the threshold with these distinct, sorted terms."""
        cursors = []  # [item, place, postings, impacts, largest impact, block maxima, term]
        for t in terms.tolist():
            a, b, c, d = self.begin[t], self.begin[t + 1], self.block_begin[t], self.block_begin[t + 1]
            postings = self.item[a:b].tolist()
            cursors.append([postings[0], 0, postings, self.impact[a:b].tolist(), float(self.most[t]), dict(zip(self.block[c:d].tolist(), self.block_most[c:d].tolist(), strict=True)), t])
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                total += c[4]
                if total >= threshold - SLACK:
                    pivot = k
                    break
            if pivot is None:
                return
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(c[5].get(block, 0.0) for c in cursors[: pivot + 1]) < threshold - SLACK:
                target = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
            elif cursors[0][0] == item:
                score = sum(v for _, v in sorted((c[6], c[3][c[1]]) for c in cursors if c[0] == item))
                if score >= threshold - SLACK:
                    yield item, score
                target = item + 1
            else:
                target = item
            left = []
            for c in cursors:
                if c[0] < target:
                    c[1] = bisect_left(c[2], target, c[1])
                    if c[1] == len(c[2]):
                        continue
                    c[0] = c[2][c[1]]
                left.append(c)
            cursors = left

    def search(self, hashes: np.ndarray, counts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of every retrieved passage of rows of words."""
        step = self.stride
        slot = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[slot] == hashes)
        if not len(known):
            return
        # every row is cut into strides; a passage is a stride and the next one
        first = np.cumsum(counts) - counts
        per = -(-counts // step)
        base = np.cumsum(per) - per
        row = np.repeat(np.arange(len(counts)), counts)[known]
        pair = np.unique((base[row] + (known - first[row]) // step) * len(self.terms) + slot[known])
        stride, term = pair // len(self.terms), pair % len(self.terms)
        strides = int(per.sum())
        row_of = np.repeat(np.arange(len(counts)), per)
        joined = np.concatenate([row_of[1:] == row_of[:-1], [False]])
        width = max(1, CELLS // self.blocks)
        for low in range(0, strides, width):
            high = min(strides, low + width)
            bound = self.bounds(stride, term, low, min(strides, high + 1))
            if high == strides:
                bound = np.vstack([bound, np.zeros((1, self.blocks))])
            upper = bound[:-1] + np.where(joined[low:high, None], bound[1:], 0)
            for p in (np.flatnonzero(upper.max(axis=1) >= threshold - SLACK) + low).tolist():
                a, b = np.searchsorted(stride, [p, p + 1 + int(joined[p])])
                r, inside, terms = row_of[p], None, np.unique(term[a:b])
                if self.bounds(np.zeros(len(terms), np.int64), terms, 0, 1).max() < threshold - SLACK:
                    continue  # its two strides share terms, which their sums count twice
                for item, score in self.walk(terms, threshold):
                    if inside is None:
                        at = first[r] + (p - base[r]) * step
                        inside = hashes[at : min(at + 2 * step, first[r] + counts[r])]
                    q, qn, w, wn = self.grams[item]
                    share = lambda g, size, inside=inside: float(np.isin(g, sequences(inside, np.array([len(inside)]), size)[0]).mean()) if len(g) else 1.0
                    yield int(r), item, score, share(q, qn), share(w, wn)


def indexes(items: list[tuple[int, str, str]], known: Statistics) -> list[Index]:
    """One index for each stride that items (item_id, question, answer) have."""
    by_stride: dict[int, list] = {}
    for item_id, question, answer in items:
        q, a = _hashes(question), _hashes(answer)
        if len(q) + len(a):
            by_stride.setdefault(stride_of(len(q) + len(a)), []).append((item_id, q, a))
    return [Index(v, known) for _, v in sorted(by_stride.items())]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, n_words, terms) of items given as (shard, question, answer or null)."""
    for batch in batches:
        n, terms = [], []
        for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            q, a = split_item(q) if a is None else (q, a)
            x = np.concatenate([_hashes(q), _hashes(a)])
            n.append(len(x)), terms.append(np.unique(x).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["shard", "n_words", "terms"])


def _shards(items: DataFrame, item_id: str, item_text: str, question_col: str | None, answer_col: str | None) -> Iterator[list[Index]]:
    """The indexes of one shard of items after the other."""
    if question_col and answer_col:
        items = items.select(F.col(item_id).alias("item_id"), F.coalesce(question_col, F.lit("")).alias("q"), F.coalesce(answer_col, F.lit("")).alias("a"))
    else:
        items = items.select(F.col(item_id).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("q"), F.lit(None).cast("string").alias("a"))
    size = items.agg(F.sum(F.length("q") + F.coalesce(F.length("a"), F.lit(0)))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "q"), F.lit(shards)))
    terms = materialize(items.select("shard", "q", "a").mapInArrow(_item_terms, "shard bigint, n_words bigint, terms array<bigint>"), "item_terms")
    total = terms.where("n_words > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean")).first()
    each = terms.select("shard", F.explode("terms").alias("term"))
    frequencies = materialize(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item_df")
    for shard in range(shards):
        here = F.col("shard") == shard
        rows = sorted(((r.item_id, r.q, r.a) for r in items.where(here).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        found = [(r.term & (1 << 64) - 1, r.df) for r in each.where(here).select("term").distinct().join(frequencies, "term").collect()]
        found.sort()
        known = Statistics(total.n, total.mean or 0.0, np.array([t for t, _ in found], np.uint64), np.array([d for _, d in found], np.int64))
        yield indexes([(i, *(split_item(q) if a is None else (q, a))) for i, q, a in rows], known)


def _matches(parts: list[Index], column: pa.Array, threshold: float, question_overlap: float, answer_overlap: float) -> Iterator[tuple[int, int, dict]]:
    """(first row, end row, {(row, index, item): (score, overlaps)}) of the verified pairs of a column of texts."""
    for lo, hi, data, offsets in text_blocks(column):
        best: dict[tuple[int, int, int], tuple[float, float, float]] = {}
        hashes, counts = words(data, offsets, PUNCT)
        for k, part in enumerate(parts if len(hashes) else ()):
            for row, item, s, q, a in part.search(hashes, counts, threshold):
                if q >= question_overlap and a >= answer_overlap:
                    best[row, k, item] = max(best.get((row, k, item), (0.0, 0.0, 0.0)), (s, q, a))
        yield lo, hi, best


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", question_col: str | None = None, answer_col: str | None = None, threshold: float = THRESHOLD, question_overlap: float = QUESTION_OVERLAP, answer_overlap: float = ANSWER_OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): the verified pairs of documents and items."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", items.schema[item_id].dataType), *[T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]])
    item_type = to_arrow_type(schema["item_id"].dataType)
    out = None
    for parts in _shards(items, item_id, item_text, question_col, answer_col):
        sent = docs.sparkSession.sparkContext.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, best in _matches(sent.value, batch.column(1), threshold, question_overlap, answer_overlap):
                    ids = batch.column(0).slice(lo, hi - lo).take(pa.array([r for r, _, _ in best], pa.int64()))
                    cols = [pa.array([v[j] for v in best.values()], pa.float64()) for j in range(3)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([sent.value[k].ids[i] for _, k, i in best], item_type), *cols], schema.names)

        part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", question_col: str | None = None, answer_col: str | None = None, threshold: float = THRESHOLD, question_overlap: float = QUESTION_OVERLAP, answer_overlap: float = ANSWER_OVERLAP) -> DataFrame:
    """The rows without any verified item, with all their columns: a narrow pass for each shard of the index."""
    names, schema = docs.columns, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    for parts in _shards(items, item_id, item_text, question_col, answer_col):
        sent = docs.sparkSession.sparkContext.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, _, best in _matches(sent.value, batch.column(names.index(text_col)), threshold, question_overlap, answer_overlap):
                    keep[[lo + r for r, _, _ in best]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
