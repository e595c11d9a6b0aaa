"""Rewriting of texts under a policy, and the risk score of what was found."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import bound, chunked, cut
from .policy import ALLOW, PSEUDONYMIZE, REDACT, Policy, policy_of

# Pseudonyms of persons, chosen by hash.
NAMES = (
    "James Wilson", "Maria Garcia", "Robert Chen", "Sarah Johnson", "David Kim", "Emily Brown", "Michael Lee",
    "Anna Martinez", "Thomas Wright", "Lisa Anderson", "Daniel Taylor", "Rachel Moore",
)


def digest(text: Column) -> Column:
    """SHA-256 as lower-case hex: what all pseudonyms follow from. Pass it on, so that it is computed once."""
    return F.sha2(text, 256)


def name_index(text: Column, h: Column | None = None) -> Column:
    """SHA-256 modulo 12. Of its eight 32-bit limbs all but the lowest weigh 4, since 2**32 and 4 * 4 are 4 modulo 12."""
    h = digest(text) if h is None else h
    limbs = [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(8)]
    high = limbs[0]
    for limb in limbs[1:7]:
        high = high + limb
    return F.pmod(high * 4 + limbs[7], F.lit(len(NAMES))).cast("int")


def pseudonym_person(text: Column, h: Column | None = None) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), name_index(text, h) + 1)


def pseudonym_email(text: Column, h: Column | None = None) -> Column:
    return F.concat(F.replace(F.lower(pseudonym_person(text, h)), F.lit(" "), F.lit(".")), F.lit("@example.com"))


def pseudonym_ip(text: Column, h: Column | None = None) -> Column:
    """The four lowest bytes of the hash, lowest first."""
    h = digest(text) if h is None else h
    return F.concat_ws(".", *[F.conv(F.substring(h, 63 - 2 * k, 2), 16, 10) for k in range(4)])


def pseudonym_other(entity_type: Column, text: Column, h: Column | None = None) -> Column:
    return F.concat(F.lit("[PSEUDO_"), entity_type, F.lit("_"), F.substring(digest(text) if h is None else h, 1, 8), F.lit("]"))


def phone_of(text: str) -> str:
    """The first ten decimal digits of the hash as a number: the one pseudonym that needs 256-bit arithmetic."""
    d = str(int(hashlib.sha256(text.encode()).hexdigest(), 16))[:10]
    return f"+1-{d[:3]}-{d[3:6]}-{d[6:]}"


@F.pandas_udf(T.ArrayType(T.StringType()))
def phones_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda a: [phone_of(t) for t in a])


def redacted(entity_type: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), entity_type, F.lit("]"))


def spliced(text: Column, spans: Column) -> Column:
    """The text with every (start, end, replacement) of an array in order of start put in place of what it covers."""

    def parts(both: Column) -> Column:
        chunks, spans = both["chunks"], both["spans"]
        before = lambda k: F.coalesce(F.get(spans, k - 1)["end"], F.lit(0))
        head = F.transform(spans, lambda s, k: F.concat(cut(chunks, before(k), s["start"]), s["replacement"]))
        return F.concat(F.array_join(head, ""), cut(chunks, before(F.size(spans)), F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(bound(F.struct(chunked(text).alias("chunks"), spans.alias("spans")), parts))


def sanitize(df: DataFrame, policy: str | Policy = "default", text_col: str = "text", entities_col: str = "entities") -> DataFrame:
    """Add sanitized (array of start, end, entity_type, original, replacement, action), sanitized_text and counts.

    Narrow and without Python, unless the policy pseudonymizes phone numbers."""
    rule = policy_of(policy)
    by_start = F.array_sort(F.col(entities_col), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    df = df.withColumn("_sorted", by_start)
    phones = rule.action_for("PHONE_NUMBER") == PSEUDONYMIZE
    if phones:
        df = df.withColumn("_phones", phones_of(F.transform("_sorted", lambda e: e["text"])))

    acting = F.transform("_sorted", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["entity_type"].alias("entity_type"), e["text"].alias("text"), rule.action(e["entity_type"]).alias("action"), F.when(rule.action(e["entity_type"]) == PSEUDONYMIZE, digest(e["text"])).alias("h")))
    df = df.withColumn("_acting", acting)

    def replaced(e: Column, k: Column) -> Column:
        kind, text, action, h = e["entity_type"], e["text"], e["action"], e["h"]
        pseudonym = F.when(kind == "PERSON", pseudonym_person(text, h)).when(kind == "EMAIL_ADDRESS", pseudonym_email(text, h)).when(kind == "IP_ADDRESS", pseudonym_ip(text, h))
        if phones:
            pseudonym = pseudonym.when(kind == "PHONE_NUMBER", F.element_at("_phones", k + 1))
        out = F.when(action == REDACT, redacted(kind)).when(action == PSEUDONYMIZE, pseudonym.otherwise(pseudonym_other(kind, text, h))).otherwise(text)
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), kind.alias("entity_type"), text.alias("original"), out.alias("replacement"), action.alias("action"))

    df = df.withColumn("sanitized", F.transform("_acting", replaced)).drop("_sorted", "_acting", "_phones")
    count = lambda a: F.size(F.filter("sanitized", lambda e: e["action"] == a))
    return (
        df.withColumn("sanitized_text", spliced(F.col(text_col), F.col("sanitized")))
        .withColumn("redacted", count(REDACT))
        .withColumn("pseudonymized", count(PSEUDONYMIZE))
        .withColumn("allowed", count(ALLOW))
    )


#: Weights of confidence, density and leaks; entities at which density is full; least scores of levels.
WEIGHTS, FULL_DENSITY = (0.4, 0.3, 0.3), 5.0
LEVELS = (("CRITICAL", 0.75), ("HIGH", 0.5), ("MEDIUM", 0.25))
#: A span of a detector without confidences counts with that of an unchecked pattern.
UNKNOWN_CONFIDENCE = 0.95


def score(df: DataFrame, entities_col: str = "entities", allowed_col: str = "allowed") -> DataFrame:
    """Add privacy_score: struct<score, level, total_entities, sanitized, leaked>; the score is not rounded."""
    total = F.size(entities_col)
    confidence = F.aggregate(entities_col, F.lit(0.0), lambda a, e: a + F.coalesce(e["confidence"], F.lit(UNKNOWN_CONFIDENCE))) / total
    raw = confidence * WEIGHTS[0] + F.least(total / FULL_DENSITY, F.lit(1.0)) * WEIGHTS[1] + F.col(allowed_col) / total * WEIGHTS[2]
    df = df.withColumn("_score", F.when(total == 0, 0.0).otherwise(F.least(raw, F.lit(1.0))))
    level = F.when(total == 0, "NONE")
    for name, least in LEVELS:
        level = level.when(F.col("_score") >= least, name)
    fields = (F.col("_score").alias("score"), level.otherwise("LOW").alias("level"), total.alias("total_entities"), (total - F.col(allowed_col)).alias("sanitized"), F.col(allowed_col).alias("leaked"))
    return df.withColumn("privacy_score", F.struct(*fields)).drop("_score")
