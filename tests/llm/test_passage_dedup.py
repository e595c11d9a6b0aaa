from collections import defaultdict

import duckdb

from cloakframe.llm import passage_dedup as op

DOCS = "doc_id bigint, text string"


def gone_lines(docs):
    """{(doc_id, text): places that go} of distinct rows with distinct ids, pair by pair."""
    first, out = {}, defaultdict(set)
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        for k, pair in enumerate(zip(lines, lines[1:])):
            if not "".join(pair).strip(" \t\r\n"):
                continue
            head = first.setdefault(pair, (i, k))
            if head != (i, k):
                out[i, t] |= {k + 1} if head == (i, k - 1) else {k, k + 1}
    return out


def expected(rows):
    gone = gone_lines(set(rows))
    out = []
    for i, t in rows:
        lines, g = (t or "").split("\n"), gone[i, t]
        out.append((i, len(lines), len(g), sum(k - 1 not in g for k in g), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in g)))
    return sorted(out, key=repr)


def test_edge_rows(edge):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted((tuple(r) for r in op.passage_dedup(edge).collect()), key=repr) == expected(rows)


def test_real_rows(sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert sorted((tuple(r) for r in op.passage_dedup(sample).collect()), key=repr) == expected(rows)


def test_real_rows_equal_sql(sample):
    c = duckdb.connect()
    c.register("documents", sample.toArrow())
    names = "doc_id, n_lines, n_removed_lines, n_removed_runs, kept_text"
    rows = op.passage_dedup(sample).select(*names.split(", ")).collect()
    assert sorted(map(tuple, rows)) == sorted(c.execute(f"SELECT {names} FROM ({op.ORACLE})").fetchall())


def test_every_repeated_passage_goes_whatever_lies_around_it(spark):
    """Passages of over 50 words between foreign lines, and exact copies, leave nothing of several lines."""
    passage = [[f"passage {p} line {k} " + "with some more words in it " * 3 for k in range(2 + p % 7)] for p in range(60)]
    around = lambda d, p: "\n".join([f"before {d} {p}", *passage[p], f"after {d} {p}"])
    rows = [(p, around(0, p)) for p in range(60)] + [(100 + p, around(1, p)) for p in range(60)] + [(200 + p, around(0, p)) for p in range(60)]
    kept = {r.doc_id: r.kept_text for r in op.passage_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    for p in range(60):
        assert kept[p] == around(0, p)
        assert kept[100 + p] == f"before 1 {p}\nafter 1 {p}"
        assert kept[200 + p] == ""


def test_one_line_over_and_over_keeps_its_first_pair(spark):
    out = op.passage_dedup(spark.createDataFrame([(1, "a\na\na\na\nb")], DOCS)).first()
    assert (out.kept_text, out.n_removed_lines, out.n_removed_runs) == ("a\na\nb", 2, 1)


def test_rows_of_one_id_are_judged_apart(spark):
    out = op.passage_dedup(spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nd"), (1, "a\nb\nd")], DOCS)).collect()
    assert sorted(r.n_removed_lines for r in out) in ([0, 0, 2], [0, 2, 2])


def test_native(sample):
    plan = op.passage_dedup(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
