"""Deduplication of repeated multi-line passages by all pairs of neighbouring lines.

A passage of several lines occurs again if and only if each pair of its neighbouring lines does, so the pairs find
every repeated passage whatever lies around it, down to the line where it begins or ends. Candidates come from 64-bit
hashes of pairs; candidates are equal if their SHA-256 is, as in op10. Everything is built-in Spark expressions.

Defined results
* a pair that occurred before (by doc_id, then a hash of the row, then place) is a repeat, and both of its lines go;
  of a pair that overlaps its own first occurrence (one line over and over) only the second line goes. The earliest
  occurrence of a line's text is in no repeat, so every text stays somewhere;
* a line is never removed for itself, however common; nor are pairs of blank lines;
* null text counts as one empty line: nothing is removed, and its kept_text is null;
* a row that repeats both id and text is the same document: its pairs are not repeats of itself;
* rows that share an id but not a text are judged apart; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize
from .line_dedup import _few, _row_key


def line_arrays(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, doc_id, is_null, lines)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(_row_key(id_col, text_col).alias("row_key"), F.col(id_col).alias("doc_id"), F.col(text_col).isNull().alias("is_null"), F.split(text, "\n", -1).alias("lines"))


def repeated(lines: DataFrame) -> DataFrame:
    """(row_key, place) of the lines that go.

    First a 64-bit hash and a counter a pair, partially aggregated; then the SHA-256 of those pairs whose hash
    repeats, a tenth of their bytes.
    The outer form of explode keeps the optimizer from repeating the pair expression in a filter on its size. All
    joins but the coarse one are merge joins at every size, as a large input needs them, so that the shuffle of a
    small input tells that of a large one."""
    pairs = F.zip_with(F.slice("lines", F.lit(1), F.size("lines") - 1), F.slice("lines", F.lit(2), F.size("lines") - 1), lambda a, b: F.concat(a, F.lit("\n"), b))
    many = lines.select("row_key", "doc_id", F.posexplode_outer(F.when(F.size("lines") > 1, pairs)).alias("place", "pair")).where(F.col("pair").rlike("[^ \t\r\n]"))
    many = many.withColumn("h", F.xxhash64("pair"))
    twice = materialize(many.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "pair_hashes")
    known = many.withColumn("digest", F.unhex(F.sha2("pair", 256))).drop("pair")
    again = materialize(_few(known, "h", twice.hint("merge")).select("digest", "row_key", "doc_id", "place"), "pair_again")
    at = F.struct("doc_id", "row_key", "place")
    first = again.groupBy("digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("digest", "first"), "pair_first")  # on its own, so that a join on a hot pair can be split
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    ahead = F.when(same, F.col("place") - F.col("first.place"))
    later = again.join(first.hint("merge"), "digest").withColumn("ahead", ahead).where("ahead IS NULL OR ahead > 0")
    both = F.when(F.col("ahead") == 1, F.array(F.col("place") + 1)).otherwise(F.array("place", F.col("place") + 1))
    return later.select("row_key", F.explode(both).alias("place"))


def passage_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed_lines, n_removed_runs, kept_text) for every row."""
    lines = line_arrays(df, id_col, text_col)
    gone = materialize(repeated(lines).groupBy("row_key").agg(F.array_sort(F.collect_set("place")).alias("gone")), "lines_gone")
    both = lines.join(gone.hint("merge"), "row_key", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    left = both.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
    runs = F.size("gone") - F.size(F.array_intersect(F.col("gone"), F.transform("gone", lambda k: k + 1)))
    return left.select(
        "doc_id",
        F.size("lines").alias("n_lines"),
        F.size("gone").alias("n_removed_lines"),
        runs.alias("n_removed_runs"),
        F.when(~F.col("is_null"), F.array_join(F.transform("left", lambda k: F.get("lines", k)), "\n")).alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup(documents(spark, sf_dir))


#: For tables whose doc_id is unique.
ORACLE = """
WITH l AS (SELECT doc_id, text IS NULL AS is_null, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
e AS (SELECT doc_id, is_null, unnest(a) AS line, unnest(range(len(a)))::INT AS k FROM l),
p AS (SELECT *, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS pair FROM e),
f AS (SELECT pair, min((doc_id, k)) AS head FROM p WHERE regexp_matches(pair, '[^ \\t\\r\\n]') GROUP BY pair HAVING count(*) > 1),
g AS (SELECT doc_id, k, doc_id = head[1] AND k = head[2] + 1 AS overlapping FROM p JOIN f USING (pair) WHERE (doc_id, k) <> head),
x AS (SELECT doc_id, k FROM g WHERE NOT overlapping UNION SELECT doc_id, k + 1 FROM g),
r AS (SELECT e.*, x.k IS NOT NULL AS gone FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.k = e.k),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS is_head FROM r)
SELECT doc_id, count(*)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_removed_lines, count(*) FILTER (is_head)::INT AS n_removed_runs,
       CASE WHEN NOT any_value(is_null) THEN coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') END AS kept_text
FROM s GROUP BY doc_id
"""
