"""Detection: spans of all detectors in one array per text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bound, running
from ..functions.names import name_spans
from ..functions.patterns import SPAN, pattern_spans

PERSON = "PERSON"


def without_overlap(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of the taken ones: an anti-join on ranges inside the row, by one sort.

    Neither side overlaps itself. In order of start, a span is free if all taken ones before it end before it starts,
    and the one right after it, if taken, starts after it ends (a span there starts later still)."""

    def free(sides: Column) -> Column:
        tagged = lambda side, kind: F.transform(sides[side], lambda s, k: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), k.alias("at")))
        rows = F.sort_array(F.concat(tagged("taken", 0), tagged("spans", 1)))

        def chosen(both: Column) -> Column:
            rows, reach = both["rows"], both["reach"]
            late = lambda r, k: F.coalesce((F.get(rows, k + 1)["kind"] == 0) & (F.get(rows, k + 1)["start"] < r["end"]), F.lit(False))
            kept = F.filter(rows, lambda r, k: (r["kind"] == 1) & (F.get(reach, k) <= r["start"]) & ~late(r, k))
            return F.transform(kept, lambda r: F.get(sides["spans"], r["at"]))

        reached = lambda rows: F.struct(rows.alias("rows"), running(F.transform(rows, lambda r: F.when(r["kind"] == 0, r["end"]).otherwise(0)), F.greatest).alias("reach"))
        return bound(bound(rows, reached), chosen)

    return F.when(F.size(taken) == 0, spans).otherwise(bound(F.struct(spans.alias("spans"), taken.alias("taken")), free))


def survivors(spans: Column) -> Column:
    """Overlap sweep: by start, higher confidence first; a span that starts inside the last survivor replaces it only
    if it is more confident, and is dropped otherwise."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0))
    last = lambda done: F.element_at(done, -1)
    return F.aggregate(
        ordered,
        F.array().cast(f"array<{SPAN}>"),
        lambda done, s: F.when((F.size(done) == 0) | (s["start"] >= last(done)["end"]), F.concat(done, F.array(s))).when(s["confidence"] > last(done)["confidence"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(s))).otherwise(done),
    )


def name_entities(text: Column) -> Column:
    return F.transform(name_spans(text), lambda n: F.struct(F.lit(PERSON).alias("entity_type"), n["text"].alias("text"), n["start"].alias("start"), n["end"].alias("end"), F.lit(None).cast("double").alias("confidence")))


#: Detectors by name. A detector turns a text column into array<SPAN>; register more with :func:`register`.
DETECTORS: dict[str, Callable[[Column], Column]] = {"patterns": pattern_spans, "names": name_entities}


#: Detectors whose spans never overlap each other; those of any other go through the sweep first.
APART = {"patterns", "names"}


def register(name: str, detector: Callable[[Column], Column]) -> None:
    """Add a detector. Of its own spans that overlap, the sweep of :func:`survivors` keeps the more confident."""
    DETECTORS[name] = detector
    APART.discard(name)


def _spans_of(name: str, text: Column) -> Column:
    found = DETECTORS[name](text)
    return found if name in APART else survivors(F.coalesce(found, F.array().cast(f"array<{SPAN}>")))


def entities(text: Column, detectors: Sequence[str] = ("patterns", "names")) -> Column:
    """Spans of the detectors in turn; each adds what overlaps nothing found before. An unknown name is an error."""
    if unknown := [d for d in detectors if d not in DETECTORS]:
        raise ValueError(f"unknown detector {unknown[0]!r}; there are {sorted(DETECTORS)}")
    found = _spans_of(detectors[0], text)
    for name in detectors[1:]:
        found = F.concat(found, without_overlap(_spans_of(name, text), found))
    return F.coalesce(found, F.array().cast(f"array<{SPAN}>"))


def detect(df: DataFrame, text_col: str = "text", detectors: Sequence[str] = ("patterns", "names"), out: str = "entities") -> DataFrame:
    """Add ``entities``, entity_count and has_pii. Detectors are applied one column at a time, so that no span
    expression is evaluated twice."""
    if unknown := [d for d in detectors if d not in DETECTORS]:
        raise ValueError(f"unknown detector {unknown[0]!r}; there are {sorted(DETECTORS)}")
    df = df.withColumn(out, _spans_of(detectors[0], F.col(text_col)))
    for name in detectors[1:]:
        df = df.withColumn("_more", _spans_of(name, F.col(text_col))).withColumn(out, F.concat(out, without_overlap(F.col("_more"), F.col(out)))).drop("_more")
    return df.withColumn(out, F.coalesce(out, F.array().cast(f"array<{SPAN}>"))).withColumn("entity_count", F.size(out)).withColumn("has_pii", F.size(out) > 0)


def exploded(df: DataFrame, keys: Sequence[str], entities_col: str = "entities") -> DataFrame:
    """One row per span: the keys and entity_type, entity_text, start, end, confidence."""
    e = F.col("_e")
    return df.select(*keys, F.explode_outer(entities_col).alias("_e")).where("_e IS NOT NULL").select(*keys, e["entity_type"].alias("entity_type"), e["text"].alias("entity_text"), e["start"].alias("start"), e["end"].alias("end"), e["confidence"].alias("confidence"))


def detect_records(df: DataFrame, keys: Sequence[str], record: str = "record", detectors: Sequence[str] = ("patterns", "names")) -> DataFrame:
    """Flat records to one row per string value with findings: (keys, key, value, entities, ...).

    ``record`` is a JSON object as text (only its top-level strings are looked at), a map, or a struct."""
    kind = df.schema[record].dataType.typeName()
    if kind == "string":
        parsed = F.try_parse_json(F.col(record))
        cells = df.select(*keys, F.explode(F.map_entries(F.try_variant_get(parsed, "$", "map<string,variant>"))).alias("_c")).select(*keys, F.col("_c.key").alias("key"), F.col("_c.value").alias("_v"))
        values = cells.where(F.schema_of_variant("_v") == "STRING").select(*keys, "key", F.variant_get("_v", "$", "string").alias("value"))
    elif kind == "map":
        values = df.select(*keys, F.explode(record).alias("key", "value"))
    else:
        strings = [f.name for f in df.schema[record].dataType if f.dataType.typeName() == "string"]
        cells = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"{record}.`{n}`").alias("value")) for n in strings])
        values = df.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.key", "_c.value").where("value IS NOT NULL")
    return detect(values, "value", detectors).where("has_pii")
