import random
import types
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cloakframe.llm import suffix_dedup as op

from . import brute


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute.without_repeats([t for _, t in rows]), strict=True)), key=repr)
    out = op.remove_repeats(df)
    total = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["begin"])
    got = out.select("doc_id", "n_bytes", total, F.size("removed"), F.sha2("kept", 256)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    return want


def test_edge_rows(edge):
    check(edge.where("doc_id IS NULL OR doc_id NOT IN (10, 11)"))


def test_very_long_rows(edge):
    """Too long for the plain version: the text of row 11 holds all of row 10, so nothing of it stays."""
    got = {r.doc_id: r for r in op.remove_repeats(edge.where("doc_id IN (10, 11)")).collect()}
    assert got[10].kept == b"" and len(got[11].removed) == 1


def test_shared_passages(spark):
    """Passages of 190 to 420 bytes in different surroundings, periods, overlaps with themselves."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [some(n) for n in (190, 199, 200, 201, 260, 420)]
    texts = [some(rng.randrange(400)) + rng.choice(passages) + some(rng.randrange(300)) + rng.choice(passages) + some(rng.randrange(30)) for _ in range(60)]
    texts += ["ab" * 150, "ab" * 99, "a" * 200, "a" * 201, "a" * 199, some(700), passages[-1], passages[-1][5:]]
    want = check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4))
    assert sum(w[2] for w in want) > 0


def test_anchors_cover_every_window():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 150, 150, 2000, 2199, 5000])
    row, at, _, low, high = op.anchors(data, offsets)
    covered = sorted((r, a - j) for r, a, lo, hi in zip(row, at, low, high, strict=True) for j in range(lo, hi + 1))
    assert covered == sorted((r, s) for r in range(5) for s in range(offsets[r], offsets[r + 1] - op.WINDOW + 1))


def test_runs_are_merged_as_a_sort_would():
    """Runs of several shards, with equal rows, long common prefixes and zero bytes."""
    rng = np.random.default_rng(3)
    for alphabet in (2, 60):
        right = np.repeat(rng.integers(0, alphabet, (40, 200)), 10, axis=0).astype(np.uint8)
        tail = rng.integers(0, 201, 400)
        right[np.arange(200) >= tail[:, None]] = rng.integers(0, 2)
        bucket, shard = np.sort(rng.integers(0, 4, 40)).repeat(10), rng.integers(0, 5, 400)
        key = [(int(b), r.tobytes()) for b, r in zip(bucket, right, strict=True)]
        runs = sorted(range(400), key=lambda i: (shard[i], key[i]))  # noqa: B023
        order, lcp = op.interleave(bucket[runs], right[runs])
        merged = [key[runs[i]] for i in order]
        assert merged == sorted(key)
        for a, b, n in zip(merged, merged[1:], lcp[1:], strict=False):
            same = next((i for i in range(200) if a[1][i] != b[1][i]), 200)
            assert n == (same if a[0] == b[0] else -1)


def test_shards_of_a_few_rows(spark, monkeypatch):
    """However a task is cut into shards, the result is the same."""
    monkeypatch.setattr(op, "SHARD_ROWS", 3)
    monkeypatch.setattr(op, "MERGE_ROWS", 5)
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = some(300)
    texts = [some(rng.randrange(200)) + passage[rng.randrange(60) :] + some(rng.randrange(200)) for _ in range(40)] + [passage] * 3
    held = [(rng.randrange(60), t) for t in texts]
    got = [pa.RecordBatch.from_pydict({"key": [i], "text": [t]}) for i, t in held]
    bits = types.SimpleNamespace(value=np.full(1 << 10, 255, np.uint8))
    monkeypatch.setattr(op, "in_bitmap", lambda b, h: np.ones(len(h), bool))
    monkeypatch.setattr(op, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 1)))
    rows = [r for b in op._contexts(bits)(iter(got)) for r in b.to_pylist() if r["bytes"] is not None]
    assert len({r["shard"] for r in rows}) > 5
    for shard in {r["shard"] for r in rows}:
        run = sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["place"])
        keys = [(r["anchor"], r["bytes"][r["high"] :]) for r in run]
        assert keys == sorted(keys)
    names = ["anchor", "shard", "place", "context", "low", "high", "n", "bytes"]
    rows.sort(key=lambda r: (r["anchor"], r["shard"], r["place"]))
    sent = pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names})
    found = {(r["context"], r["least"], r["most"]) for b in op._merge_buckets(iter([sent])) for r in b.to_pylist()}
    monkeypatch.setattr(op, "MERGE_ROWS", 1 << 15)
    assert found == {(r["context"], r["least"], r["most"]) for b in op._merge_buckets(iter([sent])) for r in b.to_pylist()}
    windows = Counter(r["bytes"][i : i + op.WINDOW] for r in rows for i in range(r["high"] - r["low"] + 1))
    sends = Counter(r["context"] for r in rows)
    want = set()
    for r in rows:
        js = [j for j in range(r["low"], r["high"] + 1) if windows[r["bytes"][r["high"] - j : r["high"] - j + op.WINDOW]] > 1]
        if js:
            want.add((r["context"], min(js), max(js)))
    assert found == want and max(sends.values()) == 2


def test_empty(nothing):
    assert op.remove_repeats(nothing).count() == 0
