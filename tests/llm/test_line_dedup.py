import hashlib

from pyspark.sql import functions as F

from cloakframe.llm import line_dedup as op


def cut(text):
    lines = (text or "").split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:6], 16) for x in lines]
    out, begin = [], 0
    for k in range(len(lines)):
        rolled = k > 0 and (h[k] + h[k - 1] * op.FACTOR) % op.MODULUS % op.DIVISOR == 0
        if rolled or k == len(lines) - 1:
            out.append((k + 1 - begin, "\n".join(lines[begin : k + 1])))
            begin = k + 1
    return out


def expected(rows):
    docs = {(i, t): cut(t) for i, t in rows}
    seen = {}
    for (i, t), chunks in docs.items():
        for p, (n, c) in enumerate(chunks):
            if n >= op.MIN_LINES and c.strip(" \t\r\n"):
                seen.setdefault(c, []).append((i is not None, i or 0, p))
    out = {}
    for (i, t), chunks in docs.items():
        gone = {p for p, (n, c) in enumerate(chunks) if c in seen and (i is not None, i or 0, p) != min(seen[c])}
        kept = [c for p, (_, c) in enumerate(chunks) if p not in gone]
        out[i, t] = (sum(n for n, _ in chunks), len(chunks), len(gone), sum(chunks[p][0] for p in gone), None if t is None else "\n".join(kept))
    return sorted(((i, *out[i, t]) for i, t in rows), key=repr)


def test_edge_rows(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted((tuple(r) for r in op.line_dedup(edge).collect()), key=repr) == expected(rows)


def test_texts_that_lose_nothing_stay(spark, sample):
    """Without broadcasts by size, only the rows that the bitmap lets through meet an exchange; same result."""
    want = sorted((tuple(r) for r in op.line_dedup(sample).collect()), key=repr)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = op.line_dedup(sample)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == want
        union = next(c for c in _nodes(out._jdf.queryExecution().sparkPlan()) if c.nodeName() == "Union")
        whole = union.children().apply(0).toString()
        assert "SortMergeJoin" not in whole and whole.count("BroadcastHashJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


def test_bitmap_loses_no_key(spark):
    keys = spark.range(0, 400000, 7).select(F.xxhash64("id").alias("k"))
    rows = spark.range(400000).select("id", F.xxhash64("id").alias("k"))
    got = op._marked(rows, "k", keys).groupBy((F.col("id") % 7 == 0).alias("wanted"), "near").count().collect()
    counts = {(r.wanted, r.near): r["count"] for r in got}
    assert counts[True, True] == 57143 and (True, False) not in counts
    assert counts[False, True] < 0.1 * 342857


def test_real_rows(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    got = op.line_dedup(sample).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)
    assert sum(r.n_removed_lines for r in got) > 0


def test_an_inserted_line_moves_few_boundaries():
    lines = [f"line {k * k}" for k in range(200)]
    a, b = cut("\n".join(lines)), cut("\n".join([*lines[:100], "new", *lines[100:]]))
    assert len({c for _, c in a} - {c for _, c in b}) <= 2


def test_empty(nothing):
    assert op.line_dedup(nothing).count() == 0


def test_native(sample):
    plan = op.line_dedup(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
