import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cloakframe.llm import decontamination as op


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")


def test_finds_every_planted_item(spark, items):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-￿]+", t.lower())) + " "
    texts = {r.doc_id: clean(r.text) for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if clean(r.text) in t}
    got = {(r.doc_id, r.item_id) for r in op.contaminated(docs, items).collect()}
    assert want and want <= got
    assert {d for d, _ in got} == {d for d, _ in want}


def test_edges_of_passages_and_partial_items(spark, items):
    item = items.first()
    filler = [f"filler{k}" for k in range(500)]
    w = item.text.split()
    rows = [(k, " ".join([*filler[:k], *w, *filler[k:]])) for k in range(0, 140, 3)]
    rows += [(1000, " ".join(w[: len(w) // 2])), (1001, " ".join(filler)), (1002, ", ".join(w).upper())]
    got = {r.doc_id for r in op.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), items.where(f"item_id = {item.item_id}")).collect()}
    assert got >= {k for k, _ in rows if k < 1000} and not got & {1000, 1001}


def brute_scores(docs, items, threshold):
    """Plain BM25 of every passage against every item: {(doc_id, item_id): best score}."""
    bag = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    split = [(r.item_id, bag(r.text)) for r in items if bag(r.text)]
    df = Counter(t for _, w in split for t in set(w))
    n, mean = len(split), sum(len(w) for _, w in split) / max(1, len(split))
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
    holders, out = defaultdict(list), {}
    for i, w in split:
        tf = Counter(w)
        weight = {t: idf[t] * c * (op.K1 + 1) / (c + op.K1 * (1 - op.B + op.B * len(w) / mean)) for t, c in tf.items()}
        for t, v in weight.items():
            holders[op.stride_of(len(w)), t].append((i, v / sum(weight.values())))
    for r in docs:
        w = bag(r.text)
        for step in {s for s, _ in holders}:
            for at in range(0, len(w), step):
                score = Counter()
                for t in set(w[at : at + 2 * step]):
                    for i, v in holders.get((step, t), ()):
                        score[i] += v
                for i, v in score.items():
                    if v >= threshold:
                        out[r.doc_id, i] = max(out.get((r.doc_id, i), 0), v)
    return out


@pytest.mark.parametrize("threshold", [op.THRESHOLD, 0.3])
def test_retrieves_what_plain_scoring_does(spark, items, threshold, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9001, "only two"), (9002, " ".join(f"long{k % 90} item" for k in range(150))), (9003, None)], "item_id bigint, text string")
    items = items.select("item_id", "text").union(extra)
    docs = docs.select("doc_id", "text").union(extra.selectExpr("item_id AS doc_id", "text || ' and more' AS text"))
    want = brute_scores(docs.collect(), items.collect(), threshold)
    monkeypatch.setattr(op, "CELLS", 5000)
    got = {(r.doc_id, r.item_id): r.score for r in op.contaminated(docs, items, threshold=threshold, question_overlap=0, answer_overlap=0).collect()}
    assert len(want) > 4 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_shards_give_the_same(spark, items, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = key(op.contaminated(docs, items))
    monkeypatch.setattr(op, "SHARD_BYTES", 3000)
    assert key(op.contaminated(docs, items)) == whole


def test_walk_finds_what_full_scoring_does(items):
    rows = [(r.item_id, *op.split_item(r.text)) for r in items.collect()]
    index = op.indexes(rows, op.Statistics.of(rows))[0]
    rng = np.random.default_rng(3)
    for _ in range(200):
        terms = np.unique(rng.integers(0, len(index.terms), rng.integers(1, 120)))
        full = np.zeros(len(index.ids))
        for t in terms:
            full[index.item[index.begin[t] : index.begin[t + 1]]] += index.impact[index.begin[t] : index.begin[t + 1]]
        for threshold in (0.05, 0.2, 0.6):
            got = dict(index.walk(terms, threshold))
            assert got.keys() == set(np.flatnonzero(full >= threshold).tolist())
            assert all(got[k] == pytest.approx(full[k]) for k in got)


def test_a_changed_word_in_a_short_answer(spark):
    items = spark.createDataFrame([(1, "the long question asks which of the seven wandering lights is the red one. it is called mars today.")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "the long question asks which of the seven wandering lights is the red one. it is named mars today."), (2, "the long question asks which of the seven wandering lights is the red one. nobody knows what.")], "doc_id bigint, text string")
    assert [r.doc_id for r in op.contaminated(docs, items).collect()] == [1]


def test_columns_for_question_and_answer(spark):
    items = spark.createDataFrame([(1, "what is the name of the red planet near us", "it is called mars"), (2, None, None)], "item_id bigint, q string, a string")
    docs = spark.createDataFrame([(1, "what is the name of the red planet near us it is called mars"), (2, "what is the name of the red planet near us nobody knows")], "doc_id bigint, text string")
    assert [r.doc_id for r in op.contaminated(docs, items, question_col="q", answer_col="a").collect()] == [1]


def test_edge_rows(edge, nothing, items, spark):
    assert op.contaminated(edge, items).count() == 0
    assert op.decontaminate(edge, items).count() == edge.count()
    assert op.decontaminate(edge, items).columns == edge.columns
    assert op.contaminated(nothing, items).count() == 0
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert op.contaminated(edge, empty).count() == 0
    assert op.decontaminate(edge, spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string")).count() == edge.count()
