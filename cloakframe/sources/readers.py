"""Sources: single texts, records, scripts of turns, labelled pairs, policies; and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.policy import Policy


def from_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string")


def from_record(spark: SparkSession, record: dict) -> DataFrame:
    """A flat record as one JSON row, so that only its string values are looked at later."""
    import json

    return spark.createDataFrame([(json.dumps(record),)], "record string")


def from_script(spark: SparkSession, path: str, session_id: str = "script") -> DataFrame:
    """A JSON array of strings, one per turn: (session_id, turn from 1, text)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.lit(session_id).alias("session_id"), F.posexplode(F.from_json("value", "array<string>")).alias("k", "text")).select("session_id", (F.col("k") + 1).alias("turn"), "text")


def from_turns(spark: SparkSession, turns: list[str], session_id: str = "script") -> DataFrame:
    return spark.createDataFrame([(session_id, k, t) for k, t in enumerate(turns, 1)], "session_id string, turn int, text string")


def from_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs: {"pairs": [{canonical, variant, category, expected}]}."""
    pair = "struct<canonical:string,variant:string,category:string,expected:string>"
    return spark.read.schema(f"description string, pairs array<{pair}>").option("multiLine", True).json(path).select(F.explode("pairs").alias("p")).select("p.*")


def policy_file(path: str) -> Policy:
    return Policy.from_yaml(path)


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files in a folder as a stream of turns: (session_id: the file, turn: order within a batch, text);
    resolve them with ``numbered=False``."""
    lines = spark.readStream.text(folder)
    return lines.select(F.input_file_name().alias("session_id"), F.monotonically_increasing_id().alias("turn"), F.col("value").alias("text"))
