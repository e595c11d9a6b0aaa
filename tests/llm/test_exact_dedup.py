import hashlib

from cloakframe.llm import exact_dedup as op


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, kept = [], set()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        stays = i == keep and (t or "") not in kept
        if stays:
            kept.add(t or "")
        out.append((i, keep, len(groups[t or ""]), stays, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_edge_rows(spark, edge):
    got = op.classify(edge, op.fresh_index(spark)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected([(r.doc_id, r.text) for r in edge.collect()])


def test_deduplicate_keeps_columns_and_the_largest_id(spark, edge):
    got = op.deduplicate(edge, op.fresh_index(spark))
    assert got.columns == edge.columns
    kept = [r.doc_id for r in got.collect()]
    assert 17 in kept and 1 not in kept and 2 not in kept and 7 not in kept and kept.count(8) == 1 and kept.count(None) == 1


def test_batches(spark):
    index = op.DigestIndex(spark, "digests_in_batches", 4)
    index.drop()
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string")
    second = spark.createDataFrame([(10, "a"), (11, "c"), (12, "c")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in op.deduplicate(first, index).collect()) == [2, 3]
    assert sorted(r.doc_id for r in op.deduplicate(second, index).collect()) == [12]
    third = op.classify(spark.createDataFrame([(20, "c"), (21, "c"), (None, "c"), (None, "d"), (None, "d")], "doc_id bigint, text string"), index).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in third if r.group_size > 2) == [(0, 12, 5, False), (20, 12, 5, False), (21, 12, 5, False)]
    assert sorted(r.kept for r in third if r.group_size == 2) == [False, True]
    assert index.read().select("digest").distinct().count() == 4
    plan = second.select(op.digest_of("text").alias("digest")).join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the index is not shuffled
    index.drop()


def test_hot_groups_are_split_off(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_SHARE", 10)
    rows = [(k, "same" if k % 3 else f"text {k}") for k in range(4000)] + [(3998, "same")] * 3
    got = op.classify(spark.createDataFrame(rows, "doc_id bigint, text string"), op.fresh_index(spark)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (3, "b", "x"), (3, "b", "x"), (None, "c", "x"), (None, "c", "x")], "doc_id bigint, text string, _id string")
    left = op.deduplicate(df, op.fresh_index(spark))
    assert left.columns == df.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "c"), (1, "a"), (3, "b")]


def test_empty(spark, nothing):
    assert op.classify(nothing, op.fresh_index(spark)).count() == 0
    assert op.deduplicate(nothing, op.fresh_index(spark)).count() == 0


def test_native(spark, sample):
    plan = op.classify(sample, op.fresh_index(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
