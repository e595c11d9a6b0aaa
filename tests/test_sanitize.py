"""Policies, rewriting, scores, the surface."""

import json

import pytest
from pyspark.sql import functions as F

from cloakframe import engine
from cloakframe.operators import sanitize
from cloakframe.operators.policy import BUILT_IN, Policy, policy_of

SPAN = "array<struct<entity_type:string,text:string,start:int,end:int,confidence:double>>"


def one(spark, f, text):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x"))).first()[0]


def test_pseudonyms(spark):
    assert one(spark, sanitize.pseudonym_person, "John Smith") == "Daniel Taylor"
    assert one(spark, sanitize.pseudonym_person, "Jane Doe") == "Michael Lee"
    assert one(spark, sanitize.pseudonym_email, "john@example.com") == "james.wilson@example.com"
    assert one(spark, sanitize.pseudonym_ip, "192.168.1.1") == "140.205.239.193"
    assert one(spark, lambda x: sanitize.pseudonym_other(F.lit("US_SSN"), x), "123-45-6789") == "[PSEUDO_US_SSN_01a54629]"
    assert sanitize.phone_of("555-867-5309") == "+1-405-963-2497"


def test_rewrite_under_each_policy(spark):
    df = spark.createDataFrame([("Ann Lee: a@b.co, 10.0.0.15.",), ("",), (None,)], "text string")
    by = {p: [r.sanitized_text for r in engine.scan(df, p).collect()] for p in BUILT_IN}
    pseudonym = one(spark, sanitize.pseudonym_person, "Ann Lee")
    assert by["default"][:2] == [f"{pseudonym}: [REDACTED_EMAIL_ADDRESS], [REDACTED_IP_ADDRESS].", ""]
    assert by["strict"][0] == "[REDACTED_PERSON]: [REDACTED_EMAIL_ADDRESS], [REDACTED_IP_ADDRESS]."
    assert by["permissive"][0] == "Ann Lee: [REDACTED_EMAIL_ADDRESS], [REDACTED_IP_ADDRESS]."
    row = engine.scan(df, "permissive").first()
    assert (row.redacted, row.pseudonymized, row.allowed) == (2, 0, 1)


def test_phone_pseudonym_in_place(spark):
    df = spark.createDataFrame([("a@b.co or 555-867-5309",)], "text string")
    policy = Policy("p", "", "allowlist", {"PHONE_NUMBER": "pseudonymize"})
    assert engine.scan(df, policy).first().sanitized_text == "a@b.co or +1-405-963-2497"


@pytest.mark.parametrize(
    ("confidences", "leaked", "score", "level"),
    [([0.85, 1.0, 0.75], 0, 0.526667, "HIGH"), ([1.0], 0, 0.46, "MEDIUM"), ([0.95], 0, 0.44, "MEDIUM"), ([0.95], 1, 0.74, "HIGH"), ([1.0] * 5, 0, 0.7, "HIGH"), ([1.0] * 5, 5, 1.0, "CRITICAL"), ([], 0, 0.0, "NONE")],
)
def test_score(spark, confidences, leaked, score, level):
    df = spark.createDataFrame([([("X", "x", k, k + 1, c) for k, c in enumerate(confidences)], leaked)], f"entities {SPAN}, allowed int")
    s = sanitize.score(df).first().privacy_score
    assert (round(s.score, 6), s.level, s.total_entities, s.leaked) == (score, level, len(confidences), leaked)


def test_policies(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("name: mine\ndefault_action: allowlist\nentities:\n  PERSON:\n    action: redact\n")
    p = Policy.from_yaml(path)
    assert (p.name, p.action_for("PERSON"), p.action_for("US_SSN")) == ("mine", "redact", "allowlist")
    assert policy_of("strict") is BUILT_IN["strict"]
    with pytest.raises(ValueError):
        policy_of("none")
    path.write_text("default_action: burn\n")
    with pytest.raises(ValueError):
        Policy.from_yaml(path)


def test_engine_surface(spark):
    e = engine.Engine(spark)
    result = e.scan("John Smith, john@example.com")
    assert result["sanitization"]["sanitized_text"] == "Daniel Taylor, [REDACTED_EMAIL_ADDRESS]"
    assert e.detect("nothing here")["has_pii"] is False
    with pytest.raises(ValueError):
        e.set_policy("none")
    e.set_policy("strict")
    assert "[REDACTED_PERSON]" in e.scan("John Smith")["sanitization"]["sanitized_text"]
    found = engine.Engine(spark, detectors=("patterns",)).scan_record({"email": "a@b.co", "n": 5, "x": "plain", "deep": {"y": "a@b.co"}})
    assert list(found) == ["email"]
    assert json.loads(engine.call_tool(spark, "scan", {"text": "a@b.co", "policy": "strict"}))["entities_found"] == 1
    assert json.loads(engine.call_tool(spark, "score", {"text": ""}))["level"] == "NONE"
    assert json.loads(engine.call_tool(spark, "detect", {"text": "a@b.co"}))["entity_count"] == 1
    assert engine.call_tool(spark, "burn", {}) == "Unknown tool: burn"


def test_command_line_and_sql_functions(spark, capsys):
    assert engine.main(["policies"]) == 0
    assert "strict" in capsys.readouterr().out
    assert engine.main(["scan", "--policy", "strict", "--format", "json", "mail a@b.co"]) == 0
    assert json.loads(capsys.readouterr().out)["privacy_score"]["total_entities"] == 1
    assert engine.main(["detect", "mail a@b.co"]) == 0
    assert "EMAIL_ADDRESS" in capsys.readouterr().out
    engine.register_functions(spark)
    assert spark.sql("SELECT osa_distance('ca', 'abc')").first()[0] == 3
    assert [tuple(r) for r in spark.sql("SELECT entity_type, start FROM scan_text('mail a@b.co')").collect()] == [("EMAIL_ADDRESS", 5)]


def test_scan_is_narrow(spark):
    df = spark.createDataFrame([("a@b.co",)], "text string")
    plan = engine.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
