"""Held-out accuracy of the trained operators, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import language_id, quality, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").cache()


def test_language_accuracy(spark, docs):
    found = language_id.query(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    rows = found.where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert np.mean([r.ok for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_gradients_equal_differences():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    d = language_id.Direction(rng, 3, 2)
    for k in d.p:
        d.p[k] = d.p[k].astype(np.float64)
    x, c = rng.integers(97, 105, (5, 4)).astype(np.intp), rng.normal(size=(5, 2, 4))
    loss = lambda: float((d.forward(x, range(5), True)[0].astype(np.float64) * c).sum())
    grads = d.backward(x, d.forward(x, range(5), True)[1], c.astype(np.float32))
    for k, at in (("gates", (1, 2)), ("state", (0, 1)), ("out", (1, 0)), ("inputs", (4, int(x[2, 1])))):
        kept, step = d.p[k][at], 1e-2
        d.p[k][at] = kept + step
        up = loss()
        d.p[k][at] = kept - step
        down = loss()
        d.p[k][at] = kept
        assert grads[k][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=5e-3)


def test_language_edges(edge, nothing, docs):
    net = language_id.fit(docs)
    rows = {r.doc_id: r for r in language_id.predict(edge, net).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {1, 2, 3, 12, 17}
    assert rows[1].score == 0 and rows[10].score > 0 and sum(rows[10].lang_positions.values()) > 400_000
    assert language_id.predict(edge, net, keep="found").count() == edge.count()
    assert language_id.predict(nothing, net).count() == 0
    assert language_id.fit(nothing) is None
    assert {r.lang_pred for r in language_id.predict(edge, None).collect()} == {"und"}
    one = language_id.fit(edge)
    assert all(r.score == pytest.approx(1.0) for r in language_id.predict(edge, one).where("lang_pred <> 'und'").collect())


def test_labels_of_held_out_rows_do_not_matter(docs):
    other = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language_id.fit(d.where(~language_id.held_out()), steps=3) for d in (docs, other))
    assert a.languages == b.languages and (a.ahead.p["inputs"] == b.ahead.p["inputs"]).all()


def test_quality_accuracy(docs, labels):
    held = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(3)) == 0
    model = quality.fit(docs, labels.where(~held))
    rows = quality.predict(docs, model).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.grade_pred == r.quality for r in rows]) > 0.85
    assert all(0 <= r.tail_prob <= 1 for r in rows)


def test_ordered_grades(spark):
    """Three grades by the share of a sign: the expected grade rises with it and thresholds are in order."""
    text = lambda k: "good words here " * (6 - k) + "%%% " * k
    rows = [(i, text(i % 7)) for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i, 2 - (i % 7) // 3 if i % 7 < 6 else 0) for i, _ in rows], "doc_id bigint, quality int")
    model = quality.fit(docs, ratings)
    assert len(model.theta) == 2 and model.theta[0] < model.theta[1]
    got = {r.doc_id: r.expected_grade for r in quality.predict(docs, model).collect()}
    assert got[0] > got[3] > got[6]


def test_toxicity_finds_the_words(spark):
    rng = np.random.default_rng(4)
    plain = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        w = list(rng.choice(plain, 60))
        if i % 5 == 0:
            w[int(rng.integers(60))] = ("Vile", "NASTY,")[i % 2]
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit(docs, labels.where("doc_id < 300"))
    names = [n for n, _ in toxicity.CATEGORIES]
    got = toxicity.predict(docs, chain, names).where("doc_id >= 300").collect()
    assert np.mean([r.is_toxic == (r.doc_id % 5 == 0) for r in got]) > 0.97
    assert len(chain.links) == 3 and [len(link.chain) for link in chain.links] == [0, 1, 2]


@pytest.mark.parametrize("op", [quality, toxicity])
def test_edges(op, edge, nothing, docs, labels, spark):
    extra = () if op is quality else ([n for n, _ in toxicity.CATEGORIES],)
    model = op.fit(docs, labels)
    assert op.predict(edge, model, *extra).count() == edge.count()
    assert op.predict(nothing, model, *extra).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert op.fit(docs, none) is None
    assert op.predict(edge, None, *extra).count() == edge.count()
    same = spark.createDataFrame([(4, 1, None), (4, 1, 0), (None, 1, 1), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    assert op.predict(edge, op.fit(edge, same), *extra).count() == edge.count()


def test_plain_versions_agree():
    """Each model's forward pass against plain loops."""
    rng, text = np.random.default_rng(2), "Some été text, long enough: " * 12
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 70, 70, len(text.encode())])
    rows = [bytes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sig = lambda x: 1 / (1 + np.exp(-x))

    model = quality.OrdinalModel([0.0, 1.0, 2.0])
    model.weights, model.theta = rng.normal(size=len(model.weights)).astype(np.float32), np.array([-0.5, 0.7])
    tails = model.tails(data, offsets)
    for r, t in enumerate(rows):
        weights = [float(model.weights[quality.trigrams(np.frombuffer(t[k : k + 3], np.uint8), np.array([0, 3]))[0][0]]) for k in range(len(t) - 2)]
        eta = quality.SCALE * sum(weights) / max(1, len(weights))
        assert tails[r] == pytest.approx([sig(eta - x) for x in model.theta], abs=1e-6)

    chain = toxicity.Chain(["a", "b"])
    row, bucket = toxicity.present(data, offsets)
    chain.fit(np.concatenate([row, row + 3]), np.concatenate([bucket, bucket]), np.array([[1, 0], [0, np.nan], [1, 1]] * 2, float), folds=2)
    for link in chain.links:
        link.weights, link.chain, link.bias = rng.normal(size=len(link.weights)).astype(np.float32), rng.normal(size=len(link.chain)), float(rng.normal())
    chain.wanted = np.ones(len(chain.links[0].weights), bool)
    got = chain.predict(data, offsets)
    for r in range(3):
        mine, earlier = set(bucket[row == r].tolist()), []
        for link in chain.links:
            earlier.append(sig(sum(float(link.weights[b]) for b in mine) + sum(c * p for c, p in zip(link.chain, earlier, strict=True)) + link.bias))
        assert got[r] == pytest.approx(earlier, abs=1e-6)

    net = language_id.Network(["x", "y", "z"], hidden=4)
    prob, marks = net.pooled(data, offsets)
    for r, t in enumerate(rows):
        total, seen = np.zeros(3), np.zeros(3, int)
        for at in range(0, len(t), language_id.SEGMENT):
            part = t[at : at + language_id.SEGMENT]
            padded = part + bytes(language_id.SEGMENT - len(part))
            logits = np.zeros((len(padded), 3)) + net.bias[:, 0]
            for layer, order in ((net.ahead, range(len(padded))), (net.back, range(len(padded) - 1, -1, -1))):
                h = np.zeros(4)
                for k in order:
                    a = layer.p["inputs"][:, padded[k]].astype(float)
                    g = sig(a[:8] + layer.p["gates"] @ h)
                    n = np.tanh(a[8:] + g[4:] * (layer.p["state"] @ h))
                    h = n + g[:4] * (h - n)
                    logits[k] += layer.p["out"] @ h
            p = np.exp(logits[: len(part)])
            total += (p / p.sum(axis=1, keepdims=True)).sum(axis=0)
            seen += np.bincount(p.argmax(axis=1), minlength=3)
        assert prob[r] == pytest.approx(total / max(1, len(t)), abs=1e-4) and marks[r].sum() == len(t) and abs(marks[r] - seen).sum() <= 2


def test_unknown_and_repeated_labels(spark):
    docs = spark.createDataFrame([(k, "vile words here" if k % 2 else "fine words here") for k in range(200)] + [(1, "vile words here")] * 50, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2 if k < 100 else None, None) for k in range(200)] + [(1, 1, None)] * 5, "doc_id bigint, toxic int, quality int")
    assert quality.fit(docs, labels) is None
    chain = toxicity.fit(docs, labels)
    p = {r.doc_id: r.p_toxic for r in toxicity.predict(docs, chain, [n for n, _ in toxicity.CATEGORIES]).collect()}
    assert p[151] > 0.9 and p[150] < 0.1  # rows without a label teach nothing
    rated = labels.select("doc_id", "toxic", F.lit(1).alias("quality"))
    assert quality.fit(docs, rated) is not None
