"""The surface for users: frames in, frames out; one call for one text; three tools with JSON answers."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.detect import detect, detect_records
from .operators.policy import BUILT_IN, Policy, policy_of
from .operators.sanitize import sanitize, score
from .sources.readers import from_record, from_text

BOTH = ("patterns", "names")


def scan(df: DataFrame, policy: str | Policy = "default", text_col: str = "text", detectors: Sequence[str] = BOTH) -> DataFrame:
    """Detect, rewrite and score a text column. One narrow stage: no shuffle, no Python worker."""
    return score(sanitize(detect(df, text_col, detectors), policy, text_col))


def result_json(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``result``: detection, sanitization and score of each row as JSON. Numbers are rounded here only."""
    rounded = F.transform("entities", lambda e: F.struct(e["entity_type"].alias("entity_type"), e["text"].alias("text"), e["start"].alias("start"), e["end"].alias("end"), F.bround(e["confidence"], 2).alias("confidence")))
    found = F.struct(F.col(text_col).alias("original_text"), "entity_count", "has_pii", rounded.alias("entities"))
    listed = F.transform("sanitized", lambda s: F.struct(s["entity_type"].alias("entity_type"), s["original"].alias("original"), s["replacement"].alias("replacement"), s["action"].alias("action")))
    rewritten = F.struct(F.col(text_col).alias("original_text"), "sanitized_text", "entity_count", "redacted", "pseudonymized", "allowed", listed.alias("entities"))
    s = F.col("privacy_score")
    rated = F.struct(F.bround(s["score"], 2).alias("score"), s["level"].alias("level"), s["total_entities"].alias("total_entities"), s["sanitized"].alias("sanitized"), s["leaked"].alias("leaked"))
    return df.withColumn("result", F.to_json(F.struct(found.alias("detection"), rewritten.alias("sanitization"), rated.alias("privacy_score"))))


class Engine:
    """Single texts and records with a policy that belongs to this object alone."""

    def __init__(self, spark: SparkSession, policy: str | Policy = "default", detectors: Sequence[str] = BOTH):
        self.spark, self.detectors = spark, detectors
        self.policy = policy_of(policy)

    def set_policy(self, policy: str | Policy) -> None:
        self.policy = policy_of(policy)

    def scan(self, text: str) -> dict:
        return json.loads(result_json(scan(from_text(self.spark, text), self.policy, "text", self.detectors)).first().result)

    def detect(self, text: str) -> dict:
        return self.scan(text)["detection"]

    def scan_record(self, record: dict) -> dict[str, dict]:
        """Results of the top-level strings of a record that hold anything."""
        found = detect_records(from_record(self.spark, record), [], "record", self.detectors)
        rows = result_json(score(sanitize(found, self.policy, "value")), "value").select("key", "result").collect()
        return {r.key: json.loads(r.result) for r in rows}

    def detect_in_record(self, record: dict) -> dict[str, dict]:
        return {k: v["detection"] for k, v in self.scan_record(record).items()}


#: Names of the tools and what they need.
TOOLS = {
    "scan": {"description": "Detect and rewrite personal data in a text under a policy", "required": ["text"], "optional": {"policy": sorted(BUILT_IN)}},
    "detect": {"description": "Detect personal data in a text without rewriting it", "required": ["text"], "optional": {}},
    "score": {"description": "Rate the privacy risk of a text", "required": ["text"], "optional": {"policy": sorted(BUILT_IN)}},
}


def call_tool(spark: SparkSession, name: str, arguments: dict) -> str:
    """A tool's JSON answer. The policy holds for this call only; an unknown policy leaves the default, an unknown
    tool gives a message."""
    if name not in TOOLS:
        return f"Unknown tool: {name}"
    policy = arguments.get("policy", "default")
    result = Engine(spark, policy if policy in BUILT_IN else "default").scan(arguments.get("text", ""))
    if name == "detect":
        return json.dumps(result["detection"], indent=2)
    if name == "score":
        return json.dumps(result["privacy_score"], indent=2)
    rewritten = result["sanitization"]
    return json.dumps({"sanitized_text": rewritten["sanitized_text"], "entities_found": rewritten["entity_count"], "privacy_score": result["privacy_score"], "details": rewritten["entities"]}, indent=2)


def register_functions(spark: SparkSession) -> None:
    """SQL names: osa_similarity, phonetic_codes, phonetic_similarity, and the table function scan_text(text)."""
    from pyspark.sql.functions import udtf

    from .functions import similarity
    from .operators.linkage import phonetic_signals

    for f in ("osa_distance", "osa_similarity", "phonetic_codes", "phonetic_similarity"):
        spark.udf.register(f, getattr(similarity, f))
    spark.udf.register("phonetic_signal", phonetic_signals)

    import re

    from .functions.patterns import ANY_TYPE, TYPES

    @udtf(returnType="entity_type string, entity_text string, start int, end int")
    class ScanText:
        """Raw matches of a text, before the checks of their types."""

        def eval(self, text: str):
            for m in re.finditer(ANY_TYPE, text or "", re.ASCII):
                kind = next(k for k, p in TYPES.items() if re.fullmatch(p, m.group(), re.ASCII))
                yield kind, m.group(), m.start(), m.end()

    spark.udtf.register("scan_text", ScanText)


def report(df: DataFrame, text_col: str = "text", color: bool = False) -> str:
    """A readable report of the first row of a scanned frame."""
    row = df.first()
    mark = (lambda s, on: f"\x1b[31m{s}\x1b[0m" if on else f"\x1b[33m{s}\x1b[0m") if color else (lambda s, on: s)
    lines = [f"Text:   {row[text_col]}"]
    if not row.entities:
        return "\n".join([*lines, "Nothing personal found."])
    for e in row.entities:
        sure = e.confidence if e.confidence is not None else 0.95
        lines.append(f"  {e.start}-{e.end} {mark(e.entity_type, sure >= 0.8)} {e.text!r}, sure by {sure:.2f}")
    s = row.privacy_score
    return "\n".join([*lines, f"Result: {row.sanitized_text}", f"Risk:   {s.level}, {s.score:.2f} of 1 ({s.total_entities} spans: {s.sanitized} rewritten, {s.leaked} left in)"])


def main(arguments: list[str] | None = None) -> int:
    """Command line: scan and detect a text, or list the policies."""
    import argparse

    parser = argparse.ArgumentParser(prog="cloakframe")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "detect"):
        p = commands.add_parser(name)
        p.add_argument("text")
        p.add_argument("--format", choices=("text", "json"), default="text")
        if name == "scan":
            p.add_argument("--policy", choices=sorted(BUILT_IN), default="default")
    commands.add_parser("policies")
    a = parser.parse_args(arguments)
    if a.command == "policies":
        print("\n".join(f"{p.name}: {p.description}" for p in BUILT_IN.values()))
        return 0
    spark = SparkSession.builder.getOrCreate()
    scanned = scan(from_text(spark, a.text), getattr(a, "policy", "default"))
    if a.format == "text":
        print(report(scanned, color=True))
    else:
        result = json.loads(result_json(scanned).first().result)
        print(json.dumps(result if a.command == "scan" else result["detection"], indent=2))
    return 0
