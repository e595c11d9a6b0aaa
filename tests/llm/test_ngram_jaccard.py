import random

import numpy as np

from cloakframe.llm import common
from cloakframe.llm import ngram_jaccard as op

from . import brute


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect() if r.doc_id is not None]
    want = brute.components(dict(rows))
    got = [tuple(r) for r in op.similarity_components(df).collect() if r.doc_id is not None]
    assert sorted(got) == sorted((i, *want[i]) for i, _ in rows)
    return got


def test_edge_rows(edge):
    check(edge)


def test_real_rows(sample):
    check(sample)


def test_chains_stars_and_borders(spark, monkeypatch):
    """Near copies in chains around the threshold, a common passage, and sets of every small size."""
    for name in ("GROUP", "LIST", "ASK"):
        monkeypatch.setattr(op, name, 3)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    passage, texts = [word() for _ in range(40)], []
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(30, 90))]
        for _ in range(14):
            texts.append(list(base))
            base = list(base)
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = word()
    texts += [[word() for _ in range(rng.randrange(60))] + passage for _ in range(25)]
    texts += [["a", "b", "c", "d", "e", "f", "g"][:k] for k in range(8) for _ in range(2)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(k * 3, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    got = check(df)
    assert len({c for _, _, c in got}) < len(got) - 30


def test_representatives(edge):
    got = op.representatives(edge)
    assert got.columns == edge.columns
    ids = [r.doc_id for r in got.collect()]
    assert 10 in ids and 11 not in ids and 7 in ids and 8 not in ids and None in ids


def test_rows_without_id_link_others(spark):
    """a ~ n ~ b, but a is not like b; and two near copies that have no id at all."""
    w = [f"w{k}" for k in range(100)]
    a, n, b = w, w[:-9] + [f"x{k}" for k in range(9)], w[9:-9] + [f"x{k}" for k in range(18)]
    lone = [f"y{k}" for k in range(50)]
    rows = [(1, a), (2, b), (None, n), (None, lone), (None, [*lone, "z"]), (None, ["p", "q"]), (None, [])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    got = [r.component_id for r in op.similarity_components(df).collect() if r.n_shingles > 60]
    assert got == [1, 1, 1]
    assert op.similarity_components(df.where("doc_id IS NOT NULL")).where("component_id = doc_id").count() == 2
    stay = op.representatives(df).collect()
    assert sorted(r.doc_id or 0 for r in stay) == [0, 0, 0, 1]
    assert {len(r.text.split()) for r in stay if r.doc_id is None} in ({50, 2, 0}, {51, 2, 0})


def test_empty(nothing):
    assert op.similarity_components(nothing).count() == 0
    assert op.representatives(nothing).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(100, 130)] + [(5, 7), (7, 7), (7, 9), (9, 5), (200, 1)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    u = brute.Union()
    for a, b in edges:
        u.join(a, b)
    assert got == {x: u.find(x) for e in edges for x in e}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_bitmap(spark):
    keys = spark.createDataFrame([(k * 7919,) for k in range(5000)], "k bigint")
    bits, width = common.bitmap_of(keys, "k", hashed=True)
    assert width == len(bits) * 8
    assert common.in_bitmap(bits, np.array([k * 7919 for k in range(5000)])).all()
    assert common.in_bitmap(bits, np.random.default_rng(1).integers(-(2**62), 2**62, 5000)).mean() < 0.2


def test_words_and_sequences():
    data = "Ab  cd\tE f".encode() + b"xy z" + b"" + "é ü".encode()
    offsets = np.array([0, 10, 14, 14, len(data)])
    h, c = common.words(np.frombuffer(data, np.uint8), offsets)
    assert c.tolist() == [4, 2, 0, 2]
    g, runs = common.sequences(h, c, 2)
    assert runs.tolist() == [3, 1, 0, 1] and len(set(g.tolist())) == 5
    again = common.words(np.frombuffer(b"ab cd e f", np.uint8), np.array([0, 9]))[0]
    assert (again == h[:4]).all()
