"""Stages that drop few rows shuffle few texts, also where the planner broadcasts nothing."""

import random
import time

import pytest

from cloakframe.llm import exact_dedup, ngram_jaccard
from cloakframe.llm.common import materialize


@pytest.fixture()
def merged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def shuffled(spark):
    """Bytes written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    time.sleep(0.3)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def kept(spark, frame):
    before = shuffled(spark)
    rows = materialize(frame, "kept").collect()
    return rows, shuffled(spark) - before


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, " ".join(rng.randbytes(4).hex() for _ in range(300)), f"s{i}") for i in range(1500)]


def table(spark, rows):
    return materialize(spark.createDataFrame(rows, "doc_id bigint, text string, near string").repartition(3), "parted")


def test_exact_copies(spark, merged, rows):
    size = sum(len(t) for _, t, _ in rows)
    copies = [(i + 2000, rows[i][1], "c") for i in range(20)] + [rows[30]] * 3 + [(40, "other", "x"), (None, rows[50][1], "n"), (None, None, "n"), (None, None, "m")]
    got, bytes_ = kept(spark, exact_dedup.deduplicate(table(spark, rows + copies), exact_dedup.fresh_index(spark)))
    want = {i + 2000 if i < 20 else i: t for i, t, _ in rows}
    assert sorted(((r.doc_id or -1, r.text or "") for r in got)) == sorted([*want.items(), (40, "other"), (-1, "")])
    assert bytes_ < size / 8


def test_near_copies(spark, merged, rows):
    size = sum(len(t) for _, t, _ in rows)
    copies = [(i + 2000, rows[i][1] + " more", "c") for i in range(20)] + [(None, rows[50][1], "n"), (3000, None, "x"), (None, "alone", "y")]
    frame = ngram_jaccard.representatives(table(spark, rows + copies))
    got, bytes_ = kept(spark, frame)
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted([*((i or -1, t) for i, t, _ in rows), (3000, ""), (-1, "alone")])
    assert bytes_ < size / 8
