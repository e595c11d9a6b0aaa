"""What a Python worker holds while repeated substrings are removed."""

import random
import tracemalloc
import types

import numpy as np
import pyarrow as pa

from cloakframe.llm import suffix_dedup as op


def peak(run):
    tracemalloc.start()
    rows = sum(len(b) for b in run())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most / 1e6


def test_contexts_and_buckets(monkeypatch):
    """Memory grows with the shard and the bucket's share, not with what a task reads (but for one number a context)."""
    monkeypatch.setattr(op, "in_bitmap", lambda bits, h: np.ones(len(h), bool))
    monkeypatch.setattr(op, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 1)))
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(2000)), "text": texts})
    out = []

    def contexts():
        for b in op._contexts(types.SimpleNamespace(value=np.full(1 << 10, 255, np.uint8)))(iter([batch])):
            out.append(b)
            yield b

    rows, most = peak(contexts)
    assert rows > 100_000 and most < 60
    sent = pa.Table.from_batches([b for b in out if b.column("bytes").null_count == 0]).sort_by([("anchor", "ascending"), ("shard", "ascending"), ("place", "ascending")])
    sent = sent.select(["anchor", "shard", "place", "context", "low", "high", "n", "bytes"])
    rows, most = peak(lambda: op._merge_buckets(iter(sent.combine_chunks().to_batches(max_chunksize=5000))))
    assert rows == 0 and most < 40


def test_texts_that_lose_nothing_stay_out_of_python(spark):
    df = spark.createDataFrame([(1, "ab" * 150), (2, "short")], "doc_id bigint, text string")
    plan = op.remove_repeats(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == plan.split("== Initial Plan ==")[0].count("MapInArrow") == 1
