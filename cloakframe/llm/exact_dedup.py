"""Exact deduplication with a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest. A batch is reduced to one row per digest, anti-joined
to the index by sort-merge (the index side needs no shuffle: its buckets are its partitioning), and what is new is
appended. Everything on this path is built-in Spark expressions.

Defined results
* null text counts as empty, so null and '' are equal texts;
* of equal texts in a batch the row with the largest doc_id stays; a null doc_id is smaller than any other;
* of rows that repeat both doc_id and text each counts in group_size, and one is kept: the last one read. Other columns
  do not matter, so :func:`deduplicate` keeps any one of them;
* a text that an earlier batch brought is not kept; its group_size counts the rows of all batches so far;
* columns other than the id and the text are never looked at and pass through :func:`deduplicate` unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, parted, unused

#: A digest with more than 1/HOT_SHARE of a batch's rows is hot; there are fewer than HOT_SHARE of them in any batch.
HOT_SHARE = 1000


def digest_of(text: str | Column) -> Column:
    """The 32-byte digest of a text; null is empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


class DigestIndex:
    """Digests seen so far: (digest BINARY, keep_id BIGINT, group_size BIGINT), one row per digest and batch that
    brought it; keep_id is that of the first batch, later rows of a digest have none."""

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None):
        self.spark, self.table = spark, table
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> DataFrame:
        """Add a batch's groups (digest, keep_id, keep_row, group_size). Gives them back with keep_id and group_size over
        all batches, and ``fresh``: whether no earlier batch had the digest. New digests are what a sort-merge anti-join
        leaves; the index side of all joins needs no shuffle, since its buckets are its partitioning."""
        if not self.exists():
            out = materialize(groups.withColumn("fresh", F.lit(True)), "groups")
        else:
            seen = self.read().hint("merge")
            fresh = groups.join(seen.select("digest"), "digest", "left_anti").withColumn("fresh", F.lit(True))
            # the rows of a digest are in one bucket, so this sum needs no exchange either
            before = groups.select(F.col("digest").alias("d")).join(seen, F.col("d") == F.col("digest")).groupBy("digest").agg(F.max("keep_id").alias("first_id"), F.sum("group_size").alias("before"))
            known = groups.join(before, "digest").select("digest", F.col("first_id").alias("keep_id"), "keep_row", (F.col("group_size") + F.col("before")).alias("group_size"), F.lit(False).alias("fresh"), F.col("group_size").alias("added"))
            out = materialize(fresh.withColumn("added", F.col("group_size")).unionByName(known), "groups")  # a table cannot be read and appended to in one job
        added = F.col("added") if "added" in out.columns else F.col("group_size")
        rows = out.select("digest", F.when(F.col("fresh"), F.col("keep_id")).alias("keep_id"), added.alias("group_size"))
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)
        return out.select("digest", "keep_id", "keep_row", "group_size", "fresh")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _classified(df: DataFrame, index: DigestIndex, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) of a batch's rows, after adding the batch to the index.

    The texts are read once; what is shuffled is an id, a row number and a digest. One row a digest leaves each map task
    (partial aggregation), so a digest with a third of all rows costs its reducer one row per map task. Groups too large
    for one task are looked up in a broadcast table of fewer than HOT_SHARE rows, all others by sort-merge join."""
    numbered = df.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"), F.monotonically_increasing_id().alias("row"))
    hashed = materialize(numbered, "digests")  # row numbers hold from here on
    largest = hashed.groupBy("digest", "doc_id").agg(F.max("row").alias("row"), F.count(F.lit(1)).alias("n"))
    groups = largest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"), F.sum("n").alias("group_size"))
    total = hashed.count()
    hot_digests = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, total // HOT_SHARE)).select("digest")
    hot_digests = F.broadcast(materialize(hot_digests, "hot"))
    entries = index.append(groups)
    cold = hashed.join(hot_digests, "digest", "left_anti").join(entries.hint("merge"), "digest")
    both = hashed.join(F.broadcast(entries.join(hot_digests, "digest", "left_semi")), "digest").unionByName(cold)
    return both.select("doc_id", "digest", "keep_id", "group_size", (F.col("fresh") & (F.col("row") == F.col("keep_row"))).alias("kept"))


def classify(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add a batch to the index and decide each of its rows: (doc_id, keep_id, group_size, kept, text_sha256)."""
    return _classified(df, index, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(df: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a batch that stay, with all their columns.

    What goes is looked up by id and digest. Rows that a bitmap tells to stay are never shuffled, so the texts that are
    grow with what goes, whichever join the planner takes. Rows that repeat id and text of a row that stays are told from
    it by nothing, so only those few are gathered, and one of each is taken."""
    name, digest = unused(df, "_id"), unused(df, "_digest")
    found = materialize(_classified(df, index, id_col, text_col), "decided")
    by_pair = materialize(found.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1"), "by_pair")
    pair = lambda rows: rows.select(F.col("doc_id").alias(name), F.col("digest").alias(digest))
    gone, again = pair(by_pair.where("NOT kept")), pair(by_pair.where("kept"))
    rest, some = parted(df, F.xxhash64(F.col(id_col), digest_of(text_col)), by_pair.select(F.xxhash64("doc_id", "digest").alias("key")))
    same = some[id_col].eqNullSafe(F.col(name)) & (digest_of(some[text_col]) == F.col(digest))
    left = some.join(gone, same, "left_anti")
    if again.isEmpty():
        return rest.unionByName(left)
    once = left.join(again, same, "left_semi").withColumn(digest, digest_of(text_col)).dropDuplicates([id_col, digest]).drop(digest)
    return rest.unionByName(left.join(again, same, "left_anti")).unionByName(once)


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An index of its own for one run over a whole table."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex[:12]}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), fresh_index(spark))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h),
k AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept FROM d)
SELECT k.doc_id, g.keep_id, g.group_size, k.kept, lower(k.h) AS text_sha256
FROM k JOIN g USING (h)
"""
