import numpy as np
import pytest

from cloakframe.llm import lm_scoring as op

from . import brute


def check(df, **kw):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = sorted(((i, len(brute.words(t)), s) for (i, t), s in zip(rows, brute.backoff_scores([t for _, t in rows], **kw), strict=True)), key=lambda r: (r[0] is None, r[0] or 0))
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in op.score(df, **({"order": kw["order"]} if kw else {})).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9, abs=1e-9)


def test_edge_rows(edge):
    check(edge)


def test_real_rows_in_many_units_and_buckets(sample, monkeypatch):
    monkeypatch.setattr(op, "UNIT_BYTES", 40_000)
    monkeypatch.setattr(op, "BUCKET_WORDS", 10_000)
    check(sample)
    check(sample, order=2)


def test_hashes_have_room_at_any_size():
    assert all(words / 2.0 ** op.hash_bits(words) <= 2.0**-op.SPARE_BITS for words in (1, 1000, 10**8, 5 * 10**9, 10**12))
    assert op.hash_bits(10**14) == 64
    distinct = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2))
    for buckets in (1, 7, 1000):
        of, ends = op.bucket_runs(distinct, buckets, 64)
        assert ends[-1] == 50 and (np.diff(of) > 0).all() and 0 <= of.min() and of.max() < buckets
    assert len(op.bucket_runs(distinct[:0], 3, 64)[0]) == 0


def test_empty(nothing):
    assert op.score(nothing).count() == 0
