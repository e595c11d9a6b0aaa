"""Reports over scanned frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def report(scanned: DataFrame, by: str = "source") -> DataFrame:
    """Documents, entities and the worst score by source and level, with totals: one rollup, partially aggregated."""
    s = F.col("privacy_score")
    rows = scanned.select(by, s["level"].alias("level"), s["total_entities"].alias("n"), s["score"].alias("score"))
    out = rows.rollup(by, "level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_entities"), F.round(F.max("score"), 6).alias("max_score"), F.grouping(by).alias("_a"), F.grouping("level").alias("_b"))
    return out.select(F.when(F.col("_a") == 1, "ALL").otherwise(F.col(by)).alias(by), F.when(F.col("_b") == 1, "ALL").otherwise(F.col("level")).alias("level"), "n_docs", "n_entities", "max_score")


def nearest_rank(df: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """Mean and nearest-rank percentiles: of n sorted values the one at place floor(n * q), counted from 0.

    Equal values are counted before they are ordered, so what a window sorts is distinct values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    picks = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col(value))).alias(name) for name, q in at.items()]
    return ranked.groupBy(key).agg(F.sum("c").alias("n"), F.round(F.sum(F.col(value) * F.col("c")) / F.sum("c"), 6).alias("mean"), *picks)
