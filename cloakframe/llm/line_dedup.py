"""Deduplication of multi-line chunks with content-defined boundaries.

A text is cut into lines. A rolling hash over the hashes of neighbouring lines chooses where chunks end, so an
inserted or deleted line moves only the boundaries near it. A chunk of several lines that occurs again anywhere in
the corpus is removed, except its first occurrence by (doc_id, place). Candidates come from hashes alone; a chunk
is removed only after its bytes were compared. Everything is built-in Spark expressions.

Defined results
* null text counts as one empty line: nothing is removed, and its kept_text is null;
* chunks of one line are never removed, however common the line; nor are blank chunks;
* a row that repeats both id and text is the same document: its chunks count once more, but are not repeats of itself;
* rows that share an id but not a text are judged apart; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize
from .common import marked as _marked

#: A boundary falls after a line whose rolling hash is 0 modulo DIVISOR: chunks have about DIVISOR lines.
DIVISOR = 3
#: Factor and modulus of the rolling hash over two neighbouring lines; products stay far below 2**63 in any engine.
FACTOR, MODULUS = 31, 1000003
MIN_LINES = 2


def line_hash(line: Column) -> Column:
    """The first 24 bits of MD5: the same number in any engine."""
    return F.conv(F.substring(F.md5(line), 1, 6), 16, 10).cast("bigint")


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def chunk_arrays(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """(row_key, doc_id, is_null, pieces): every text as its chunks (n_lines, chunk) in order.

    Boundaries are found inside the row, so cutting needs no shuffle and is linear in the text."""
    lines = df.select(
        _row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).isNull().alias("is_null"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines")
    )
    rolled = lines.withColumn("h", F.transform("lines", line_hash)).withColumn("before", F.slice(F.concat(F.array(F.lit(None).cast("bigint")), "h"), F.lit(1), F.size("h")))
    flags = rolled.withColumn("flag", F.zip_with("h", "before", lambda h, b: F.coalesce(F.pmod(F.pmod(h + b * FACTOR, F.lit(MODULUS)), F.lit(divisor)) == 0, F.lit(False))))
    ends = flags.withColumn(
        "ends", F.filter(F.transform("flag", lambda f, i: F.when(f | (i == F.size("lines") - 1), i + 1)), lambda e: e.isNotNull())
    ).withColumn("starts", F.slice(F.concat(F.array(F.lit(0)), "ends"), F.lit(1), F.size("ends")))
    pieces = F.zip_with("starts", "ends", lambda a, b: F.struct((b - a).alias("n_lines"), F.array_join(F.slice("lines", a + 1, b - a), "\n").alias("chunk")))
    return ends.select("row_key", "doc_id", "is_null", pieces.alias("pieces"))


def _few(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Left-semi join on a long hash that spares the shuffle most rows: first by the bitmap, then exactly."""
    return _marked(rows, key, wanted).where("near").drop("near").join(wanted, key, "left_semi")


def repeated(pieces: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(row_key, doc_id, place) of the chunks that go: all but the first of each group of equal chunks.

    First a 64-bit hash and a counter a chunk, partially aggregated, so a chunk in a third of all documents costs
    its reducer one row per map task; then the bytes of those chunks whose hash repeats. The outer form of explode
    keeps the optimizer from repeating the whole chunk expression in a filter on its size."""
    many = pieces.select("row_key", "doc_id", F.posexplode_outer("pieces").alias("place", "c")).select("row_key", "doc_id", "place", "c.n_lines", "c.chunk").where((F.col("n_lines") >= min_lines) & F.col("chunk").rlike("[^ \t\r\n]"))
    many = many.withColumn("h", F.xxhash64("chunk"))
    twice = materialize(many.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "chunk_hashes")
    again = materialize(_few(many, "h", twice).select("h", "chunk", "row_key", "doc_id", "place"), "chunk_again")
    first = again.groupBy("h", "chunk").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place")))
    return again.join(first, ["h", "chunk"]).where(later).select("row_key", "doc_id", "place")


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, kept_text) for every row.

    Texts that lose nothing are told by a bitmap and never shuffled."""
    gone = materialize(repeated(chunk_arrays(df, id_col, text_col, divisor), min_lines).groupBy("row_key").agg(F.collect_set("place").alias("gone")), "chunk_gone")
    rows = _marked(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _row_key(id_col, text_col).alias("row_key")), "row_key", gone)
    none = F.array().cast("array<int>")
    whole = chunk_arrays(rows.where("NOT near"), divisor=divisor).withColumn("gone", none)
    cut = chunk_arrays(rows.where("near"), divisor=divisor).join(gone, "row_key", "left").withColumn("gone", F.coalesce("gone", none))
    stay = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("gone"))
    left = whole.unionByName(cut).withColumn("left", F.transform(stay, lambda k: F.get("pieces", k)))
    count = lambda a: F.aggregate(a, F.lit(0), lambda s, p: s + p["n_lines"])
    return left.select(
        "doc_id",
        count("pieces").alias("n_lines"),
        F.size("pieces").alias("n_chunks"),
        F.size("gone").alias("n_removed_chunks"),
        (count("pieces") - count("left")).alias("n_removed_lines"),
        F.when(~F.col("is_null"), F.array_join(F.transform("left", lambda p: p["chunk"]), "\n")).alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


ORACLE = f"""
WITH l AS (SELECT doc_id, text IS NULL AS is_null, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
e AS (SELECT doc_id, is_null, len(a) AS n, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM l),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 6))::BIGINT AS h FROM e),
b AS (SELECT *, (i = n OR coalesce(((h + lag(h) OVER w * {FACTOR}) % {MODULUS}) % {DIVISOR} = 0, false)) AS is_end FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM b),
c AS (SELECT doc_id, is_null, place, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM p GROUP BY ALL),
r AS (SELECT *, n_lines >= {MIN_LINES} AND regexp_matches(chunk, '[^ \\t\\r\\n]') AND row_number() OVER (PARTITION BY chunk, n_lines >= {MIN_LINES} ORDER BY doc_id, place) > 1 AS gone FROM c)
SELECT doc_id, sum(n_lines)::INT AS n_lines, count(*)::INT AS n_chunks, count(*) FILTER (gone)::INT AS n_removed_chunks,
       coalesce(sum(n_lines) FILTER (gone), 0)::INT AS n_removed_lines,
       CASE WHEN NOT any_value(is_null) THEN coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT gone), '') END AS kept_text
FROM r GROUP BY doc_id
"""
