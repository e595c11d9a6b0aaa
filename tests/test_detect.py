"""Spans, checks, names, overlaps."""

import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import validators
from cloakframe.functions.names import name_spans
from cloakframe.functions.patterns import ANY_TYPE, pattern_spans
from cloakframe.operators.detect import detect, detect_records, entities, exploded, register, survivors

FOUND = [
    ("Contact john@example.com for details", [("EMAIL_ADDRESS", "john@example.com", 8, 24, 1.0)]),
    ("Call 555-123-4567 now", [("PHONE_NUMBER", "555-123-4567", 5, 17, 0.95)]),
    ("Call +1 (555) 123-4567 now", [("PHONE_NUMBER", "+1 (555) 123-4567", 5, 22, 0.95)]),
    ("Server at 192.168.1.100 is down", [("IP_ADDRESS", "192.168.1.100", 10, 23, 1.0)]),
    ("CC: 4532015112830366", [("CREDIT_CARD", "4532015112830366", 4, 20, 1.0)]),
    ("SSN: 123-45-6789", [("US_SSN", "123-45-6789", 5, 16, 0.95)]),
    ("CPF: 529.982.247-25", [("BRAZILIAN_CPF", "529.982.247-25", 5, 19, 1.0)]),
    ("Key: sk-abcdefghijklmnopqrstuvwxyz", [("API_KEY", "sk-abcdefghijklmnopqrstuvwxyz", 5, 34, 0.95)]),
    ("Number: 1234567890123456", []),
    ("version 2.0.0.1", []),
    ("CPF: 111.111.111-11", []),
    ("not-an-email", []),
    ("sk-short", []),
    ("", []),
    (None, []),
    ("The weather is nice today", []),
    ("user.name+tag@domain.co.uk", [("EMAIL_ADDRESS", "user.name+tag@domain.co", 0, 23, 1.0)]),
    ("x 12345678901234567890", [("PHONE_NUMBER", "1234567890", 12, 22, 0.95)]),
    ("order 4532015112830366 12", [("CREDIT_CARD", "4532015112830366", 6, 22, 1.0)]),
    ("999.1.1.1", []),
    ("010.0.0.01", [("IP_ADDRESS", "010.0.0.01", 0, 10, 1.0)]),
    ("8.8.8.8", []),
    ("ça va \U0001f600 x@mail5.example.com", [("EMAIL_ADDRESS", "x@mail5.example", 8, 23, 1.0)]),
]


def test_pattern_spans(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(FOUND)], "k int, t string").select("k", pattern_spans("t").alias("e")).collect()
    assert {r.k: [tuple(e) for e in r.e] for r in rows} == {k: e for k, (_, e) in enumerate(FOUND)}


def test_spans_equal_a_scan_of_raw_matches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    from cloakframe.functions.patterns import located

    got = {r.doc_id: [(m.text, m.start, m.end) for m in r.m] for r in docs.select("doc_id", located(F.col("text"), ANY_TYPE).alias("m")).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == [(m.group(), m.start(), m.end()) for m in re.finditer(ANY_TYPE, r.text)]


@pytest.mark.parametrize(
    ("check", "right", "wrong"),
    [
        (validators.is_luhn, ["4532015112830366", "5425233430109903", "4532 0151-1283 0366", "0" * 13], ["4532015112830367", "", "4532", "x" * 16, None]),
        (validators.is_cpf, ["529.982.247-25", "52998224725"], ["529.982.247-26", "111.111.111-11", "1", None]),
        (validators.is_ip, ["10.0.0.1", "192.168.1.100", "255.255.255.255"], ["8.8.8.8", "256.1.1.1", "1.2.3", "a.b.c.d", None]),
        (validators.is_email, ["a@b.co", "x.y@z.org"], ["no-at-sign", "@no-local.com", "a@b", "a@b.c", None]),
    ],
)
def test_checks(spark, check, right, wrong):
    rows = spark.createDataFrame([(x, ok) for xs, ok in ((right, True), (wrong, False)) for x in xs], "x string, ok boolean").select("x", "ok", check(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in rows] == [(r.x, r.ok) for r in rows]


NAMES = [
    ("K. Fernando met J. R. Smith", [(0, 11), (16, 27)]),
    ("Mary-Jane Doe, Bob", [(0, 18)]),
    ("Vinícius Melo", [(9, 13)]),
    ("McDonald Ronald", [(9, 15)]),
    ("Dear K.  \n", [(0, 10)]),
    ("The I This", []),
    (None, []),
]


def test_names(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(NAMES)], "k int, t string").select("k", "t", name_spans("t").alias("n")).collect()
    assert {r.k: [(n.start, n.end) for n in r.n] for r in rows} == {k: e for k, (_, e) in enumerate(NAMES)}
    assert all(n.text == r.t[n.start : n.end] for r in rows for n in r.n)


def test_patterns_win_over_names_and_order_is_kept(spark):
    df = spark.createDataFrame([("Ann Lee wrote to John@example.com and Bob",)], "text string")
    got = exploded(detect(df), ["text"]).select("entity_type", "entity_text").collect()
    assert [tuple(r) for r in got] == [("EMAIL_ADDRESS", "John@example.com"), ("PERSON", "Ann Lee"), ("PERSON", "Bob")]


def test_registry(spark):
    register("nothing", lambda text: F.array().cast("array<struct<entity_type:string,text:string,start:int,end:int,confidence:double>>"))
    df = spark.createDataFrame([("a@b.co",)], "text string")
    assert df.select(F.size(entities(F.col("text"), ("nothing", "patterns")))).first()[0] == 1
    with pytest.raises(ValueError):
        detect(df, "text", ("missing",))


def test_overlap_sweep_is_against_the_last_survivor(spark):
    spans = [("A", 0, 10, 0.5), ("B", 5, 8, 0.9), ("C", 8, 12, 0.4), ("D", 9, 20, 0.4), ("E", 8, 9, 0.4)]
    df = spark.createDataFrame([([(n, n, s, e, c) for n, s, e, c in spans],)], "s array<struct<entity_type:string,text:string,start:int,end:int,confidence:double>>")
    assert [e.text for e in df.select(survivors(F.col("s")).alias("k")).first().k] == ["B", "C"]


def test_records(spark):
    record = '{"email": "a@b.co", "n": 5551234567, "inner": {"x": "c@d.co"}, "list": ["e@f.co"], "none": null, "ip": "10.0.0.15"}'
    df = spark.createDataFrame([(1, record), (2, "not json"), (3, None)], "id int, record string")
    assert sorted(r.key for r in detect_records(df, ["id"], "record", ("patterns",)).collect()) == ["email", "ip"]
    maps = spark.createDataFrame([(1, {"a": "a@b.co", "b": "x", "c": None})], "id int, record map<string,string>")
    assert [r.key for r in detect_records(maps, ["id"], "record", ("patterns",)).collect()] == ["a"]
    structs = spark.createDataFrame([(1, ("a@b.co", 5))], "id int, record struct<a:string,b:int>")
    assert [r.key for r in detect_records(structs, ["id"], "record", ("patterns",)).collect()] == ["a"]
