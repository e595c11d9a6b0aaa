"""Spans of long texts, and the building blocks they are made of, against plain versions."""

import random

from pyspark.sql import functions as F

from cloakframe.engine import scan
from cloakframe.functions import arrays, names, patterns
from cloakframe.operators import detect

SPANS = "array<struct<start:int,end:int>>"


def test_running_sums_and_maxima(spark):
    rng = random.Random(1)
    lists = [[rng.randrange(50) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1500)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, x array<int>")
    got = {r.k: (r.s, r.m) for r in df.select("k", arrays.running(F.col("x")).alias("s"), arrays.running(F.col("x"), F.greatest).alias("m")).collect()}
    for k, x in enumerate(lists):
        assert got[k][0] == [sum(x[: i + 1]) for i in range(len(x))]
        assert got[k][1] == [max(x[: i + 1]) for i in range(len(x))]


def test_cuts_of_chunked_texts(spark):
    text = "".join(random.Random(2).choice("aé日\U0001f600 ") for _ in range(20_000))
    cuts = [(0, 0), (0, 5), (8191, 8193), (8192, 8192), (100, 19_000), (19_999, 20_000), (0, 20_000)]
    df = spark.createDataFrame([(text, cuts)], f"t string, c {SPANS}").select(arrays.chunked(F.col("t")).alias("t"), "c")
    got = df.select(F.transform("c", lambda c: arrays.cut(F.col("t"), c["start"], c["end"])).alias("x")).first().x
    assert got == [text[a:b] for a, b in cuts]


def test_anti_join_of_spans(spark):
    rng, rows = random.Random(3), []

    def disjoint(n):
        at, out = 0, []
        for _ in range(n):
            at += rng.randrange(4)
            out.append((at, at := at + rng.randrange(1, 6)))
        return out

    for k in range(300):
        rows.append((k, disjoint(rng.randrange(12)), disjoint(rng.randrange(8))))
    rows += [(900, [(0, 2)], None), (901, None, [(0, 2)])]
    df = spark.createDataFrame(rows, f"k int, spans {SPANS}, taken {SPANS}").select("k", F.transform("spans", lambda s: F.struct(F.lit("x").alias("text"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"), "taken")
    got = {r.k: r.x and [(s.start, s.end) for s in r.x] for r in df.select("k", detect.without_overlap(F.col("spans"), F.col("taken")).alias("x")).collect()}
    for k, spans, taken in rows[:300]:
        assert (got[k] or []) == [s for s in spans if not any(s[1] > t[0] and s[0] < t[1] for t in taken)]


def test_a_text_with_the_mark_and_one_without(spark):
    body = "Ann Lee wrote to ann@site.org from 10.20.30.40. Bob. J. Ray did not"
    rows = [(1, body), (2, body.replace(". Bob", ".\x00Bob"))]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: (r.p, r.n) for r in df.select("k", patterns.pattern_spans("text").alias("p"), names.name_spans("text").alias("n")).collect()}
    assert [s.text for s in got[1][0]] == ["ann@site.org", "10.20.30.40"] and [(s.start, s.end) for s in got[1][0]] == [(s.start, s.end) for s in got[2][0]]
    for k, text in rows:
        assert all(text[s.start : s.end] == s.text for s in [*got[k][0], *got[k][1]])
    assert [s.text for s in got[1][1]] == ["Ann Lee", "Bob. J. Ray"]


def test_a_text_of_megabytes(spark):
    one = "Foo bar baz a@b.com and nothing for some time after that at all "
    n = 5_000_000 // len(one)
    row = scan(spark.createDataFrame([(one * n,)], "text string")).select(F.size("entities").alias("n"), "sanitized_text").first()
    assert row.n == 2 * n and row.sanitized_text.count("[REDACTED_EMAIL_ADDRESS]") == n and "Foo" not in row.sanitized_text


def test_spans_of_a_new_detector_are_swept(spark):
    def words(text):
        spans = F.array(*[F.struct(F.lit("WORD").alias("entity_type"), text.substr(a + 1, b - a).alias("text"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("confidence")) for a, b, c in ((0, 5, 0.5), (3, 8, 0.9), (9, 12, 0.4))])
        return F.when(text.isNotNull(), spans)

    detect.register("overlapping", words)
    try:
        df = spark.createDataFrame([("abcdefghijklmnop",), (None,)], "text string")
        full, empty = scan(df, "strict", detectors=("overlapping", "names")).select("sanitized_text", F.transform("entities", lambda e: e["start"]).alias("s")).collect()
        assert full.s == [3, 9] and full.sanitized_text == "abc[REDACTED_WORD]i[REDACTED_WORD]mnop" and empty.s == []
    finally:
        del detect.DETECTORS["overlapping"]
