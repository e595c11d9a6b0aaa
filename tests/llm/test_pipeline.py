"""The pipeline against a plain version of its stages."""

import re

import pytest

from cloakframe.llm import language_id
from cloakframe.llm.common import materialize, release

from . import brute

pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    start = {r.doc_id: r.text for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    clean = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-￿]+", t.lower())) + " "

    texts = {i: t for i, t in start.items() if t is not None and re.search(r"[^\W\d_]", t)}
    largest = {}
    for i, t in texts.items():
        largest[t] = max(i, largest.get(t, i))
    exact = {i: t for t, i in largest.items()}
    near = {i: t for i, t in exact.items() if brute.components(exact)[i][1] == i}
    left = {i: t for i, t in near.items() if not any(clean(x) in clean(t) for x in items)}

    got = docs
    for (name, stage), want in zip(pipeline.STAGES[:4], (texts, exact, near, left), strict=True):
        got = materialize(stage(spark, got, D), name)
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(want), name
    packed = pipeline.STAGES[4][1](spark, got, D)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(left)
    assert {r.doc_id for r in pipeline.run(spark, D).select("doc_id").collect()} == set(left)
    release(spark)


def test_edge_rows(spark, edge, nothing):
    for docs in (edge, nothing):
        for _, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, D), "stage")
        docs.count()
    kept = pipeline.language(spark, edge, D)
    assert kept.columns == edge.columns
    assert not {1, 2, 3, 12, 17} & {r.doc_id for r in kept.collect()}
    assert language_id.UNDETERMINED not in {r.lang for r in kept.collect()}


def test_a_run_leaves_only_its_result(spark, tmp_path):
    import os

    import corpus_pipeline
    from cloakframe.llm import common

    root = common.scratch_root(spark).split(":", 1)[-1]
    where = f"{root}/llm-{spark.sparkContext.applicationId}"
    before = set(os.listdir(where)) if os.path.exists(where) else set()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = set(os.listdir(where)) - before
    assert len(left) == 1 and out.count() > 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]
