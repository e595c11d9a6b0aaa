"""Removal of repeated substrings by merging the Burrows-Wheeler transforms of shards.

Every byte covered by a string of WINDOW bytes that also starts elsewhere in the corpus is removed.

A transform of the whole corpus in one place would not scale, so suffixes are merged in independent buckets. Each
window names one of its positions, the anchor: the place of the least hash of K bytes inside it (leftmost of equals).
Equal windows have equal anchors at equal places, so only suffixes that start at anchors with the same K bytes need
to be merged with each other, to a depth of WINDOW bytes on either side.

1. Anchors are counted; an anchor seen once cannot lie in a repeated window.
2. Every shard (a stretch of a task) sorts its own suffixes at repeated anchors once and sends them as a run: the
   right context, and the bytes before the anchor, which in this order are the columns of the shard's transform.
   Contexts equal within a shard travel once, with their number.
3. A bucket merges the runs without sorting suffixes again. At first its rows are one block, run after run; round by
   round the next symbol refines the interleave of the runs (a stable partition of each block, in which every run keeps
   its own order), and where a block splits, the common prefix of its neighbours is known. From there the order of the
   suffixes one byte further left follows by a stable partition on the preceding byte (the step backwards through the
   transform). At step j, neighbours that agree on j bytes to the left and WINDOW - j to the right are a repeated window.
4. The repeated stretch around an anchor goes back to its occurrences; only documents that lose bytes are joined.

Defined results
* null text counts as empty; texts shorter than WINDOW bytes lose nothing;
* matches never cross documents, may overlap themselves, and are judged on the input, not on what is left;
* a row that repeats id and text is another document with the same text: both lose their windows;
* removed bytes may cut a character in two; kept bytes are concatenated as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, INVERSE, bitmap_of, documents, in_bitmap, marked, materialize, mix, powers, settled, text_blocks

WINDOW, K = 200, 32
#: Window starts handled at once; positions fit 20 bits.
SEGMENT = 1 << 19
#: Bytes of text looked at, contexts merged by a bucket's task, contexts sorted by a shard, and texts cut at once. A worker's
#: memory grows with them.
TEXT_BYTES = 1 << 18
MERGE_ROWS = 1 << 14
SHARD_ROWS = 1 << 14
CUT_ROWS = 1 << 9


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash, least j, largest j) of the anchors: position is in ``data``; the windows that chose the
    anchor start at position - j."""
    width = window - k + 1
    lengths = np.diff(offsets)
    out = [[np.zeros(0, np.int64)] for _ in range(2)] + [[np.zeros(0, np.uint64)]] + [[np.zeros(0, np.int64)] for _ in range(2)]
    if not (lengths >= window).any():
        return tuple(o[0] for o in out)
    for a in range(0, len(data) - window + 1, SEGMENT):
        starts = min(SEGMENT, len(data) - window + 1 - a)
        part = data[a : a + starts + window - 1]
        n = len(part)
        acc = np.empty(n + 1, np.uint64)
        acc[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=acc[1:])
        h = mix((acc[k:] - acc[:-k]) * powers(INVERSE, n)[: n - k + 1])
        del acc
        # least hash of every run of ``width``: blocks of that length, least from the left and from the right
        m = -(-len(h) // width) * width
        key = np.full(m, np.uint64(0xFFFFFFFFFFFFFFFF))
        key[: len(h)] = h >> np.uint64(20) << np.uint64(20) | np.arange(len(h), dtype=np.uint64)
        grid = key.reshape(-1, width)
        left = np.minimum.accumulate(grid, axis=1).reshape(-1)
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(right[:starts], left[width - 1 : width - 1 + starts])
        at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        # window starts inside rows
        begin = np.arange(a, a + starts)
        row = np.searchsorted(offsets, begin, "right") - 1
        ok = begin + window <= offsets[row + 1]
        at, begin, row = at[ok], begin[ok], row[ok]
        if not len(at):
            continue
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        for o, v in zip(out, (row[first], at[first] + a, h[at[first]], at[first] + a - begin[last], at[first] + a - begin[first]), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) for o in out)


def interleave(bucket: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows by bucket and right context, and the bytes that each shares with the one before (-1: first of
    its bucket). The rows come as runs of shards, every run in this order already; runs are only merged."""
    rows, window = right.shape
    symbols = np.pad(right, ((0, 0), (0, -window % 4))).view(">u4").astype(np.uint32)
    sizes = np.bincount(bucket)
    block = (np.cumsum(sizes) - sizes)[bucket]  # place of the block's first row in the merged order
    lcp = np.full(rows, window, np.int32)
    lcp[block] = -1
    live = np.arange(rows)
    for depth in range(symbols.shape[1]):
        live = live[np.bincount(block[live], minlength=rows)[block[live]] > 1]
        if not len(live):
            break
        key = block[live].astype(np.uint64) << np.uint64(32) | symbols[live, depth]
        z = np.argsort(key, kind="stable")  # keys ascend within a run: a merge of the runs
        key, old, at = key[z], block[live[z]], np.arange(len(z))
        first = np.concatenate([[True], old[1:] != old[:-1]])
        head = np.concatenate([[True], key[1:] != key[:-1]])
        new = old + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(first, at, 0))
        cut = np.flatnonzero(head & ~first)
        apart = (key[cut] ^ key[cut - 1]).astype(">u4").view(np.uint8).reshape(-1, 4) != 0
        lcp[new[cut]] = 4 * depth + apart.argmax(axis=1)
        block[live[z]] = new
    return np.argsort(block, kind="stable"), lcp


def merge(bucket: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, many: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(least j, largest j) of the repeated windows of each distinct context; -1 where there is none.

    Rows are runs of shards, each by bucket and right context. bucket: the number of each row's anchor. left: bytes
    before the anchor, nearest first, (rows, window - K). right: bytes from the anchor on, (rows, WINDOW). low, high:
    the j of the row's own windows. many: context seen twice or more."""
    rows = len(bucket)
    least, most = np.where(many, low, -1), np.where(many, high, -1)
    order, lcp = interleave(bucket, right)
    # one step to the left at a time: stable partition by the preceding byte
    group = np.cumsum(np.concatenate([[0], np.diff(bucket[order]) != 0]))
    place = np.arange(rows)  # of each row of the current order in the order of right contexts
    for j in range(int(high.max(initial=-1)) + 1):
        if j:
            keep = high[order[place]] >= j
            mates = group[1:] == group[:-1]
            keep &= np.concatenate([[False], mates]) | np.concatenate([mates, [False]])  # alone: no partner any more
            place, group = place[keep], group[keep]
            if not len(place):
                break
            key = group * 256 + left[order[place], j - 1]
            by = np.argsort(key, kind="stable")
            place, key = place[by], key[by]
            group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        able = np.flatnonzero(low[order[place]] <= j)
        if len(able) < 2:
            continue
        shared = np.cumsum(lcp < window - j)[place[able]]  # equal where WINDOW - j bytes to the right agree
        g = group[able]
        same = (g[1:] == g[:-1]) & (shared[1:] == shared[:-1])
        hit = order[place[able[np.concatenate([[False], same]) | np.concatenate([same, [False]])]]]
        least[hit] = np.where(least[hit] < 0, j, np.minimum(least[hit], j))
        most[hit] = np.maximum(most[hit], j)
    return least, most


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "n"])

    for batch in batches:
        for _, _, data, offsets in text_blocks(batch.column(0), TEXT_BYTES):
            held.append(anchors(data, offsets)[2])
            size += len(held[-1])
            if size > 1 << 21:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


CONTEXTS = "row_key bigint, at bigint, context bigint, shard bigint, place int, anchor bigint, low int, high int, n int, bytes binary"


def _contexts(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Occurrences (row_key, at, context) and the shards' distinct contexts (context, shard, place, anchor, low, high,
        n, bytes), place by place in the order of anchor and right context."""
        names = [c.split()[0] for c in CONTEXTS.split(", ")]
        types = [pa.int64()] * 4 + [pa.int32(), pa.int64()] + [pa.int32()] * 3 + [pa.binary()]
        seen: dict[int, int] = {}  # context -> times sent by this task, two at most
        held: list[tuple[int, int, int, int, bytes]] = []  # anchor, context, low, high, bytes
        shard = TaskContext.get().partitionId() << 32

        def run_of_shard() -> pa.RecordBatch:
            held.sort(key=lambda c: (c[0], c[4][c[3] :]))  # by anchor and right context
            anchor, context, low, high, raw = zip(*held, strict=True)
            columns = [context, np.full(len(held), shard), np.arange(len(held)), anchor, low, high, np.ones(len(held)), raw]
            none = pa.nulls(len(held), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, *(pa.array(c).cast(t) for c, t in zip(columns, types[2:], strict=True))], names)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in text_blocks(batch.column(1), TEXT_BYTES):
                row, at, h, low, high = anchors(data, offsets)
                ok = np.flatnonzero(in_bitmap(bits.value, h))
                if not len(ok):
                    continue
                row, at, h, low, high = row[ok], at[ok], h[ok].view(np.int64), low[ok], high[ok]
                raw, ids = data.tobytes(), []
                for i, (p, j0, j1) in enumerate(zip(at.tolist(), low.tolist(), high.tolist(), strict=True)):
                    part = raw[p - j1 : p + WINDOW - j0]
                    c = xxhash.xxh3_64_intdigest(part, seed=j0 << 8 | j1) - (1 << 63)
                    ids.append(c)
                    if (times := seen.get(c, 0)) < 2:  # a third time would tell nothing new
                        seen[c] = times + 1
                        held.append((int(h[i]), c, j0, j1, part))
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo + row]), pa.array(at - offsets[row]), pa.array(ids, pa.int64()), *[pa.nulls(len(ok), t) for t in types[3:]]], names)
                if len(held) >= SHARD_ROWS:
                    yield run_of_shard()
                    held.clear()
                    shard += 1
        if held:
            yield run_of_shard()

    return run


def _merge_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, shard, place, context, low, high, n, bytes) in the order of the first three to (context, least, most)
    of contexts with repeats. Whole buckets are gathered up to about MERGE_ROWS distinct contexts and merged together."""
    held: list[list] = []  # [anchor, shard, context, low, high, n, bytes]
    known: dict[int, list] = {}  # the last anchor's contexts; one that other shards sent too is held once

    def solve(rows: list[list]) -> pa.RecordBatch:
        anchor, shard, context, low, high, n, raw = zip(*rows, strict=True)
        bucket = np.cumsum(np.concatenate([[0], np.diff(np.array(anchor)) != 0]))
        runs = np.argsort(np.array(shard), kind="stable")  # of one shard: by bucket, and there as the shard sorted them
        low, high = np.array(low), np.array(high)
        left = np.zeros((len(rows), WINDOW - K + 1), np.uint8)
        right = np.zeros((len(rows), WINDOW), np.uint8)
        for i, row in enumerate(runs.tolist()):
            cell = np.frombuffer(raw[row], np.uint8)
            j = high[row]
            left[i, :j] = cell[:j][::-1]
            right[i, : len(cell) - j] = cell[j:]
        least, most = merge(bucket[runs], left, right, low[runs], high[runs], np.array(n)[runs] > 1)
        hit = np.flatnonzero(most >= 0)
        return pa.RecordBatch.from_arrays([pa.array(np.array(context, np.int64)[runs[hit]]), pa.array(least[hit].astype(np.int32)), pa.array(most[hit].astype(np.int32))], ["context", "least", "most"])

    for batch in batches:
        for anchor, shard, _, context, low, high, n, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[-1][0] != anchor:
                known = {}
                if len(held) >= MERGE_ROWS:
                    yield solve(held)
                    held = []
            if context in known:
                known[context][5] += n
                continue
            known[context] = row = [anchor, shard, context, low, high, n, raw]
            held.append(row)
    if held:
        yield solve(held)


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, spans): the repeated stretches [begin, end) around anchors, of rows that have any."""
    spark, parts = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    counted = texts.select("text").mapInArrow(settled(_count), "anchor bigint, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    bits = spark.sparkContext.broadcast(bitmap_of(materialize(counted, "anchors"), "anchor", hashed=True)[0])
    found = materialize(texts.mapInArrow(settled(_contexts(bits)), CONTEXTS), "contexts")
    sent = found.where("bytes IS NOT NULL").select("anchor", "shard", "place", "context", "low", "high", "n", "bytes")
    merged = sent.repartition(parts, "anchor").sortWithinPartitions("anchor", "shard", "place").mapInArrow(settled(_merge_buckets), "context bigint, least int, most int")
    extents = materialize(merged, "extents")
    hits = found.where("bytes IS NULL").select("row_key", "at", "context").join(extents, "context")
    stretch = F.struct((F.col("at") - F.col("most")).alias("begin"), (F.col("at") + WINDOW - F.col("least")).alias("end"))
    return hits.groupBy("row_key").agg(F.sort_array(F.collect_set(stretch)).alias("spans"))


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def _joined(spans_: list[dict]) -> list[tuple[int, int]]:
    """Sorted stretches as maximal runs."""
    out: list[list[int]] = []
    for s in spans_:
        if out and s["begin"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["begin"], s["end"]])
    return [(a, b) for a, b in out]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the removed runs and the bytes that stay, for every row.

    Rows without repeats are told by a bitmap; they are never shuffled, nor sent to Python."""
    found = materialize(spans(df, id_col, text_col), "spans")
    texts = df.select(row_key(id_col, text_col).alias("row_key"), F.col(id_col).cast("bigint").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    texts = marked(texts, "row_key", found)
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    plain = texts.where("NOT near").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), none.alias("removed"), F.col("text").alias("kept"))
    hit = texts.where("near").join(found, "row_key", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(k, CUT_ROWS) for k in range(0, len(batch), CUT_ROWS)):
                sizes, removed, kept = [], [], []
                for text, marks in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    runs, at, parts = _joined(marks), 0, []
                    for a, b in runs:
                        parts.append(text[at:a])
                        at = b
                    sizes.append(len(text)), removed.append([{"begin": a, "end": b} for a, b in runs]), kept.append(b"".join([*parts, text[at:]]))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])

    changed = hit.mapInArrow(settled(cut), "doc_id bigint, n_bytes bigint, removed array<struct<begin:bigint,end:bigint>>, kept binary")
    return plain.unionByName(changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    total = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["begin"])
    return out.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
