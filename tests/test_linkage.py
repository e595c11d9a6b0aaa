import math
"""Similarity, codes, pair scores, sessions in batch and as a stream."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import phonetic
from cloakframe.functions import similarity as sim
from cloakframe.operators import linkage, session
from cloakframe.sources import readers
from cloakframe.streaming import sessions as streaming

CODES = {"Catherine": "K0RN", "Katherine": "K0RN", "Steven": "STFN", "Stephen": "STFN", "Knight": "NKT", "Wright": "RKT", "Xavier": "SFR", "Schmidt": "SXMT", "Edge": "AJ", "Thomas": "0MS", "Aesop": "SP", "Hughes": "HKS", "123": "", "": "", "Kavishka Fernando": "KFXK", "Fernando": "FRNN", "Smith John": "SM0J"}


def test_codes(spark):
    assert {w: phonetic.codes(w)[0] for w in CODES} == CODES
    assert phonetic.codes("George") == ("JRJ", "KRK")
    rows = spark.createDataFrame([(w,) for w in CODES], "w string").select("w", sim.phonetic_codes("w").alias("c")).collect()
    assert {r.w: r.c.primary for r in rows} == CODES


def test_edit_distance():
    pairs = [("kavishka", "kavihska", 1), ("ca", "abc", 3), ("", "", 0), ("abc", "", 3), ("ab", "ba", 1), ("kitten", "sitting", 3)]
    assert sim.alignment_distances([a for a, _, _ in pairs], [b for _, b, _ in pairs]).tolist() == [d for _, _, d in pairs]
    assert sim.alignment_similarities(["kavishka"], ["kavihska"])[0] == 0.875


def test_jaccards(spark):
    cases = [("kavishka", "kavihska", 0.2, 0.0), ("John Smith", "Smith John", None, 1.0), ("K. Fernando", "Kavishka Fernando", None, 0.3333), ("", "", 1.0, 1.0), ("a", "", 0.0, 0.0)]
    rows = spark.createDataFrame([(a, b) for a, b, _, _ in cases], "a string, b string").select(sim.trigram_jaccard(F.col("a"), F.col("b")).alias("g"), sim.token_jaccard(F.col("a"), F.col("b")).alias("t")).collect()
    for r, (_, _, g, t) in zip(rows, cases, strict=True):
        assert (g is None or abs(r.g - g) < 1e-3) and abs(r.t - t) < 1e-3


def test_signatures_agree_with_plain_values(spark):
    texts = ["Kavishka Fernando", "ab", "", "Vinícius"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sim.signature(F.col("t")).alias("s"), F.size(sim.bands(sim.signature(F.col("t")))).alias("n")).collect()
    assert all(r.s == sim.signature_of(r.t) and len(r.s) == 64 and r.n == 32 for r in rows)


def labelled_pairs():
    """The labelled pairs and posteriors of FIXTURES.md."""
    text = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text()
    rows = re.findall(r"^\| ([^|]+) \| ([^|]+) \| (\w+) \| (MERGE|NEW_ENTITY) \| ([\d.]+) \|$", text, re.M)
    assert len(rows) == 51
    return rows


def test_posteriors_and_evaluation(spark, tmp_path):
    rows = labelled_pairs()
    (tmp_path / "pairs.json").write_text(json.dumps({"description": "", "pairs": [dict(zip(("canonical", "variant", "category", "expected"), r[:4], strict=True)) for r in rows]}))
    pairs = readers.from_pairs(spark, str(tmp_path / "pairs.json"))
    scored = {(r.canonical, r.variant): r.posterior for r in linkage.score_pairs(pairs, "canonical", "variant").collect()}
    for a, b, _, _, p in rows:
        assert abs(scored[a, b] - float(p)) < 6e-5, (a, b)
        values = linkage.signal_values([a], [b])[0]
        assert abs(linkage.weigh([*values, 0.0])[0] - scored[a, b]) < 1e-9
    table = {r.threshold: (r.tp, r.fp, r.tn, r.fn, round(r.f1, 3)) for r in linkage.evaluate(pairs, [0.4, 0.5, 0.6, 0.65, 0.7, 0.8, 0.85, 0.9]).where("category = 'ALL'").collect()}
    assert table == {0.4: (36, 13, 2, 0, 0.847), 0.5: (36, 13, 2, 0, 0.847), 0.6: (36, 13, 2, 0, 0.847), 0.65: (36, 13, 2, 0, 0.847), 0.7: (36, 9, 6, 0, 0.889), 0.8: (36, 9, 6, 0, 0.889), 0.85: (36, 7, 8, 0, 0.911), 0.9: (36, 6, 9, 0, 0.923)}


def test_thresholds(spark):
    expected = {1: (0.68, 0.33), 3: (0.71, 0.36), 15: (0.77, 0.42), 1023: (0.95, 0.60)}
    merge, defer = linkage.thresholds(F.lit("PERSON"), F.col("n"))
    rows = spark.createDataFrame([(n,) for n in expected], "n int").select("n", merge.alias("m"), defer.alias("d")).collect()
    assert {r.n: (round(r.m, 2), round(r.d, 2)) for r in rows} == expected
    assert all(tuple(round(x, 2) for x in linkage.DEFAULT.thresholds("PERSON", n)) == t for n, t in expected.items())


def test_blocking_equals_all_pairs_by_key(spark):
    texts = ["John Smith", "Smith John", "Jon Smyth", "Maria Garcia", "Garcia", "123", "456"]
    df = spark.createDataFrame([(k, "PERSON", t) for k, t in enumerate(texts)] + [(9, "OTHER", "John Smith")], "id int, kind string, text string")
    got = {(r.id_a, r.id_b) for r in linkage.candidate_pairs(df, "id", "kind", "text").collect()}
    keys = [session.keys_of(t) for t in texts]
    assert got == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if keys[i] & keys[j]}


SCRIPT = [
    "Send this report to Kavishka Fernando at kavishka@wso2.com",
    "Also CC john.smith@example.com on that thread",
    "Kavihska Fernando confirmed the meeting for tomorrow",
    "Fernando will send the invoice from 192.168.1.100",
    "Please forward to Katherine at katherine.jones@corp.com",
    "Catherine said she already has it",
]
REWRITTEN = [
    "Send this report to [USER_2] at [EMAIL_1]",
    "Also CC [EMAIL_3] on that thread",
    "[USER_2] confirmed the meeting for tomorrow",
    "[USER_2] will send the invoice from [IP_4]",
    "Please forward to [USER_6] at [EMAIL_5]",
    "[USER_6] said she already has it",
]


def check_script(folded):
    rows = {r.turn: r for r in folded}
    assert [rows[k].sanitized_text for k in range(1, 7)] == REWRITTEN
    third, fourth, sixth = rows[3].decisions[0], rows[4].decisions[1], rows[6].decisions[0]
    assert (third.decision, round(third.posterior, 3), [round(s.value, 3) for s in third.signals]) == ("MERGE", 0.831, [0.875, 0.941, 0.579, 0.333, 0])
    assert (fourth.decision, round(fourth.posterior, 3)) == ("DEFERRED", 0.627)
    assert (sixth.decision, round(sixth.posterior, 3), [round(s.value, 3) for s in sixth.signals]) == ("DEFERRED", 0.645, [1, 0.889, 0.75, 0, 0])
    summary = [(s.entity_type, s.entity_id, s.mentions) for s in rows[6].summary]
    assert summary == [("EMAIL_ADDRESS", 1, 1), ("EMAIL_ADDRESS", 3, 1), ("IP_ADDRESS", 4, 1), ("PERSON", 2, 3), ("EMAIL_ADDRESS", 5, 1), ("PERSON", 6, 2)]
    assert rows[6].summary[3].variants == ["Kavishka Fernando", "Kavihska Fernando", "Fernando"]


def test_script_in_batch(spark, tmp_path):
    (tmp_path / "script.json").write_text(json.dumps(SCRIPT))
    turns = readers.from_script(spark, str(tmp_path / "script.json"))
    folded = session.fold(turns, "session_id", "turn")
    check_script(folded.collect())
    assert session.resolved(folded).count() == 9
    assert session.summaries(folded).count() == 6


def test_script_as_a_stream(spark, tmp_path):
    streaming.configure(spark)
    turns = readers.from_turns(spark, SCRIPT)
    for k, (a, b) in enumerate(((1, 3), (4, 6))):
        turns.where(F.col("turn").between(a, b)).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    query = streaming.resolve_stream(stream, "session_id", "turn").writeStream.format("memory").queryName("resolved_turns").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    check_script(spark.table("resolved_turns").collect())


def test_sessions_do_not_mix(spark):
    a, b = readers.from_turns(spark, SCRIPT, "a"), readers.from_turns(spark, SCRIPT[::-1], "b")
    rows = session.fold(a.union(b), "session_id", "turn").collect()
    check_script([r for r in rows if r.session_id == "a"])
    assert len(rows) == 12 and sum(r.summary is not None for r in rows) == 2


def test_session_state():
    s = session.Session(capacity=5)
    s.next_turn()
    for k in range(10):
        s.add("PERSON", f"Name{'abcdefghij'[k]} Q{k}")
    assert len(s.entities) == 5 and list(s.entities) == [6, 7, 8, 9, 10]
    s.advance_to(3)
    assert s.turn == 3
    s.advance_to(1)
    assert s.turn == 3
    assert s.together(9, 10) > 0 and s.together(9, 99) == 0
    assert s.label_of(10) == "[USER_10]" and s.label_of(1) == "[UNKNOWN_1]"
    again = session.Session.load(s.dump())
    assert again.summary() == s.summary()
    s.destroy()
    with pytest.raises(RuntimeError):
        s.add("PERSON", "x")


def test_types_do_not_link():
    s = session.Session()
    s.next_turn()
    s.resolve("PERSON", "John Smith")
    assert s.resolve("EMAIL_ADDRESS", "John Smith")["decision"] == "NEW_ENTITY"
    assert s.resolve("PERSON", "John Smith")["decision"] == "MERGE"


def test_cooccurrence_join_equals_state(spark):
    s = session.Session()
    mentions = []
    for turn, texts in enumerate([["Ann Lee", "Bob Ray"], ["Ann Lee"], ["Bob Ray", "Cid Poe"], ["Ann Lee", "Cid Poe"]], 1):
        s.next_turn()
        for t in texts:
            mentions.append(("s", turn, s.resolve("PERSON", t)["assigned_entity_id"]))
    rows = session.cooccurrence(spark.createDataFrame(mentions, "session_id string, turn int, entity_id int")).collect()
    assert {(r.entity_a, r.entity_b): round(r.score, 9) for r in rows} == {(a, b): round(s.together(a, b), 9) for a in s.entities for b in s.entities if a < b and s.together(a, b)}


def test_turns_with_gaps_and_late_ones(spark):
    s = session.Session()
    for turn, texts in ((0, ["Ann Lee"]), (4, ["Ann Lee", "Bob Ray"]), (2, ["Bob Ray"]), (None, ["Cid Poe"])):
        s.take_turn(turn)
        for t in texts:
            s.resolve("PERSON", t)
    assert s.turn == 6 and s.entities[1]["turns"] == {1, 5} and s.entities[2]["turns"] == {5} and s.entities[3]["turns"] == {6}
    assert s.together(1, 2) == pytest.approx(math.exp(-session.DECAY * 2))
    rows = [("a", 1, "Ann Lee is here"), ("a", 7, "Ann Lee again"), ("a", None, "before all"), ("a", 7, "Bob Ray too")]
    folded = session.fold(spark.createDataFrame(rows, "session_id string, turn int, text string"), "session_id", "turn").collect()
    assert [(r.turn, r.text) for r in folded] == [(None, "before all"), (1, "Ann Lee is here"), (7, "Ann Lee again"), (7, "Bob Ray too")]
