"""Typed spans of structured identifiers, found with built-in regular expressions only.

Spark has no function that gives the places of all matches. But when matches are marked and the text is split at the
marks, the pieces between matches and the matches themselves alternate, so their running lengths are the places: one
pass of one compiled pattern, no Python worker, and work in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound, running
from .validators import is_cpf, is_ip, is_luhn

# Entity types with their patterns, in order of priority, and the confidences.
# A type's pattern wins over those after it; a match that fails its check is dropped and its characters stay used.
TYPES = {
    "EMAIL_ADDRESS": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}",
    "BRAZILIAN_CPF": r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b",
    "US_SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "PHONE_NUMBER": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "API_KEY": r"\b(?:sk|pk|api)[_-][a-zA-Z0-9]{20,}\b",
}
CHECKED = ("EMAIL_ADDRESS", "BRAZILIAN_CPF", "CREDIT_CARD", "IP_ADDRESS")
CONFIDENCE_CHECKED, CONFIDENCE_PATTERN = 1.0, 0.95

ANY_TYPE = "|".join(TYPES.values())
#: What is put around matches; a text that holds it is split in two passes instead.
MARK = "\x00"

SPAN = "struct<entity_type:string,text:string,start:int,end:int,confidence:double>"


def pieces(text: Column, pattern: str) -> Column:
    """array<string>: what stands between matches and the matches, in turn; a match is at every odd index."""
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def woven(both: Column) -> Column:
        pairs = F.zip_with(both["gaps"], both["found"], lambda g, m: F.array(g, m))
        return F.slice(F.flatten(pairs), F.lit(1), 2 * F.size(both["gaps"]) - 1)

    two_passes = bound(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), woven)
    return F.when(F.contains(text, F.lit(MARK)), two_passes).otherwise(marked)


def placed(parts: Column) -> Column:
    """array<struct<text, start, end>> of the pieces of a text; offsets count characters, end is exclusive."""
    return F.zip_with(parts, running(F.transform(parts, F.length)), lambda p, e: F.struct(p.alias("text"), (e - F.length(p)).alias("start"), e.alias("end")))


def located(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of all matches of a pattern."""
    return F.filter(bound(pieces(text, pattern), placed), lambda p, k: k % 2 == 1)


def type_of(match: Column) -> Column:
    """The type of a matched text: the first alternative that matches all of it."""
    out = None
    for name, pattern in TYPES.items():
        hit = match.rlike(f"^(?:{pattern})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def passes(entity_type: Column, match: Column) -> Column:
    """Whether a match survives the check of its type. An e-mail that matches its pattern is always well formed."""
    return F.when(entity_type == "CREDIT_CARD", is_luhn(match)).when(entity_type == "BRAZILIAN_CPF", is_cpf(match)).when(entity_type == "IP_ADDRESS", is_ip(match)).otherwise(F.lit(True))


def pattern_spans(text: str | Column) -> Column:
    """array<SPAN> of the identifiers in a text, in order of place. A null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    # marking costs only where something can match: every pattern needs an @, a digit or the mark of a key
    typed = F.transform(located(text, ANY_TYPE), lambda m: F.struct(type_of(m["text"]).alias("entity_type"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end")))
    kept = F.filter(typed, lambda m: passes(m["entity_type"], m["text"]))
    scored = F.transform(kept, lambda m: F.struct(m["entity_type"].alias("entity_type"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.when(m["entity_type"].isin(*CHECKED), CONFIDENCE_CHECKED).otherwise(CONFIDENCE_PATTERN).alias("confidence")))
    empty = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(r"[@\d]|(?:sk|pk|api)[_-]"), scored).otherwise(empty)
