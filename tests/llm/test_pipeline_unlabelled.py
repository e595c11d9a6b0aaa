import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_an_unlabelled_corpus_keeps_its_texts_with_letters(spark):
    rows = [(k, f"an ordinary text {k}") for k in range(30)] + [(30, None), (31, "12 %% 34"), (32, ""), (33, "été")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {*range(30), 33}
