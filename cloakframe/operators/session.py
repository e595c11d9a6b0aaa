"""Linking of mentions across the turns of a session: an ordered fold over each session's rows.

The fold is greedy and order-dependent (identifiers, thresholds and eviction follow from what came before), so it is a
keyed sequential operator, not a join: one shuffle by session, one sort, and a stream over each partition that holds
the state of one session at a time. The same fold runs in batch and in Structured Streaming.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phonetic
from ..functions import similarity as sim
from .detect import detect
from .linkage import DEFAULT, DEFERRED, MERGE, NEW_ENTITY, SIGNALS, Config, signal_values, weigh

CAPACITY, DECAY = 1024, 0.1
# Prefixes of labels by type; the short table of the resolver's own labels.
PREFIXES = {"PERSON": "USER", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "IP_ADDRESS": "IP", "CREDIT_CARD": "CC", "US_SSN": "SSN", "BRAZILIAN_CPF": "CPF", "API_KEY": "APIKEY"}
RESOLVER_PREFIXES = {k: PREFIXES[k] for k in ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS")}
OTHER_PREFIX, UNKNOWN_PREFIX = "ENTITY", "UNKNOWN"


def label(entity_type: str | None, entity_id: int, prefixes: dict = PREFIXES) -> str:
    return f"[{UNKNOWN_PREFIX if entity_type is None else prefixes.get(entity_type, OTHER_PREFIX)}_{entity_id}]"


def keys_of(text: str) -> frozenset:
    """What a mention can be found by: its phonetic codes, the bands of its signature, its tokens."""
    signature = sim.signature_of(text)
    bands = {(k, *signature[k * sim.ROWS : (k + 1) * sim.ROWS]) for k in range(sim.BANDS)}
    return frozenset({("P", c) for c in phonetic.codes(text) if c} | bands | {("T", t) for t in text.lower().split()})


class Session:
    """State of one session. Entities are kept in order of last mention; their canonical text never changes."""

    def __init__(self, capacity: int = CAPACITY, config: Config = DEFAULT):
        self.capacity, self.config = capacity, config
        self.turn, self.made, self.alive = 0, 0, True
        self.shift: int | None = None
        self.entities: dict[int, dict] = {}
        self.by_key: dict[tuple, set[int]] = defaultdict(set)

    def next_turn(self) -> int:
        self.turn += 1
        return self.turn

    def advance_to(self, turn: int) -> None:
        """Turns never run backwards: a late one counts with the current turn."""
        self.turn = max(self.turn, turn)

    def take_turn(self, turn) -> None:
        """Move to a row's turn. Numbers that begin at 0 or below are counted from 1; no number is the next turn."""
        if turn is None or turn != turn:
            self.next_turn()
            return
        if self.shift is None:
            self.shift = 1 - min(int(turn), 1)
        self.advance_to(int(turn) + self.shift)

    def _need_alive(self) -> None:
        if not self.alive:
            raise RuntimeError("the session was destroyed: no more mentions can be added")

    def _touch(self, entity_id: int) -> None:
        self.entities[entity_id] = self.entities.pop(entity_id)
        if self.turn:
            self.entities[entity_id]["turns"].add(self.turn)

    def add(self, entity_type: str, text: str) -> int:
        self._need_alive()
        self.made += 1
        keys = keys_of(text)
        self.entities[self.made] = {"type": entity_type, "canonical": text, "variants": [text], "mentions": 1, "keys": keys, "turns": set(), "first_turn": self.turn, "last_turn": self.turn}
        for k in keys:
            self.by_key[k].add(self.made)
        self._touch(self.made)
        while len(self.entities) > self.capacity:
            oldest = next(iter(self.entities))
            for k in self.entities.pop(oldest)["keys"]:
                self.by_key[k].discard(oldest)
                if not self.by_key[k]:
                    del self.by_key[k]
        return self.made

    def mention(self, entity_id: int, text: str) -> None:
        self._need_alive()
        if (e := self.entities.get(entity_id)) is None:
            return
        e["mentions"] += 1
        e["last_turn"] = self.turn
        if text not in e["variants"]:
            e["variants"].append(text)
        self._touch(entity_id)

    def candidates(self, entity_type: str, text: str) -> list[int]:
        found = set().union(*(self.by_key.get(k, ()) for k in keys_of(text)))
        return sorted(i for i in found if self.entities[i]["type"] == entity_type)

    def count(self, entity_type: str) -> int:
        return sum(e["type"] == entity_type for e in self.entities.values())

    def together(self, a: int, b: int) -> float:
        """Co-occurrence: shared turns, weighted by recency, against the rarer entity's turns. A forgotten one has none."""
        turns = [self.entities[i]["turns"] if i in self.entities else set() for i in (a, b)]
        shared = turns[0] & turns[1]
        return min(1.0, sum(math.exp(-DECAY * (self.turn - t + 1)) for t in shared) / min(map(len, turns))) if shared else 0.0

    def resolve(self, entity_type: str, text: str) -> dict:
        """Decide about one mention and apply the decision. Of equal posteriors the lowest id wins."""
        ids = self.candidates(entity_type, text)
        out = {"entity_type": entity_type, "query_text": text, "decision": NEW_ENTITY, "assigned_entity_id": None, "best_candidate_id": None, "candidate_text": None, "posterior": 0.0, "total_weight": 0.0, "signals": []}
        if ids:
            texts = [self.entities[i]["canonical"] for i in ids]
            merge, defer = self.config.thresholds(entity_type, self.count(entity_type))
            rated = [(weigh([*v, 0.0], self.config), [*v, 0.0]) for v in signal_values([text] * len(ids), texts)]
            k = max(range(len(ids)), key=lambda i: (rated[i][0][0], -i))
            (posterior, total, ratios), values = rated[k]
            decision = MERGE if posterior >= merge else DEFERRED if posterior >= defer else NEW_ENTITY
            out |= {"decision": decision, "best_candidate_id": ids[k], "candidate_text": texts[k], "posterior": posterior, "total_weight": total, "signals": [{"name": n, "value": float(v), "log_lr": float(r)} for n, v, r in zip(SIGNALS, values, ratios, strict=True)]}
        if out["decision"] == NEW_ENTITY:
            out["assigned_entity_id"] = self.add(entity_type, text)
        else:
            out["assigned_entity_id"] = out["best_candidate_id"]
            self.mention(out["best_candidate_id"], text)
        return out

    def process(self, text: str, entities: list[dict]) -> tuple[str, list[dict]]:
        """One turn: (text with labels in place of the mentions, decisions in order of resolution)."""
        decisions, cuts = [], []
        for seq, e in enumerate(entities):
            d = self.resolve(e["entity_type"], e["text"])
            decisions.append(d | {"seq": seq, "start": e["start"], "end": e["end"], "label": label(e["entity_type"], d["assigned_entity_id"])})
            cuts.append((e["start"], e["end"], decisions[-1]["label"]))
        at, parts = 0, []
        for start, end, mark in sorted(cuts):
            parts += [text[at:start], mark]
            at = end
        return "".join([*parts, text[at:]]), decisions

    def label_of(self, entity_id: int) -> str:
        e = self.entities.get(entity_id)
        return label(e and e["type"], entity_id, RESOLVER_PREFIXES)

    def summary(self) -> list[dict]:
        """Known entities, least recently mentioned first."""
        return [{"entity_id": i, "entity_type": e["type"], "canonical": e["canonical"], "variants": list(e["variants"]), "mentions": e["mentions"], "lru_seq": k} for k, (i, e) in enumerate(self.entities.items())]

    def destroy(self) -> None:
        """Forget everything; adding mentions afterwards is an error. Memory is not overwritten."""
        self.entities.clear(), self.by_key.clear()
        self.alive = False

    def dump(self) -> bytes:
        return pickle.dumps(self)

    @staticmethod
    def load(data: bytes) -> Session:
        return pickle.loads(data)


DECISION = "struct<seq:int,entity_type:string,query_text:string,start:int,end:int,decision:string,assigned_entity_id:int,label:string,best_candidate_id:int,candidate_text:string,posterior:double,total_weight:double,signals:array<struct<name:string,value:double,log_lr:double>>>"
SUMMARY = "struct<entity_id:int,entity_type:string,canonical:string,variants:array<string>,mentions:int,lru_seq:int>"


def _entities_of(cell) -> list[dict]:
    return [{"entity_type": e["entity_type"], "text": e["text"], "start": e["start"], "end": e["end"]} for e in (cell if cell is not None else ())]


def fold(df: DataFrame, session_col: str, turn_col: str, text_col: str = "text", detectors: tuple[str, ...] = ("patterns", "names"), capacity: int = CAPACITY, config: Config = DEFAULT) -> DataFrame:
    """(session_id, turn, text, sanitized_text, decisions, summary): summary only on the last row of a session.

    Detection is a narrow expression before the shuffle. Sessions are streamed, so a long one costs its state, not
    its rows. Rows of a session with equal turns are taken in order of their text and count as one turn; null texts
    count as empty; a row without turn comes first and counts as a turn of its own. Turns are whole numbers."""
    found = detect(df.select(F.col(session_col).alias("session_id"), F.col(turn_col).alias("turn"), F.coalesce(text_col, F.lit("")).alias("text")), "text", detectors).select("session_id", "turn", "text", "entities")
    kind = found.schema["session_id"].dataType.simpleString()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(n, "session_id").sortWithinPartitions("session_id", "turn", "text")
    schema = f"session_id {kind}, turn {found.schema['turn'].dataType.simpleString()}, text string, sanitized_text string, decisions array<{DECISION}>, summary array<{SUMMARY}>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current, first, held = None, None, True, None
        for frame in frames:
            rows = [] if held is None else [held]
            for row in frame.itertuples(index=False):
                if first or row.session_id != current:
                    if rows and state is not None:
                        rows[-1]["summary"] = state.summary()
                    state, current, first = Session(capacity, config), row.session_id, False
                state.take_turn(row.turn)
                text, decisions = state.process(row.text, _entities_of(row.entities))
                rows.append({"session_id": row.session_id, "turn": row.turn, "text": row.text, "sanitized_text": text, "decisions": decisions, "summary": None})
            held = rows.pop() if rows else None  # it may be the last of its session
            if rows:
                yield pd.DataFrame(rows)
        if held is not None:
            held["summary"] = state.summary()
            yield pd.DataFrame([held])

    return dealt.mapInPandas(run, schema)


def resolved(folded: DataFrame) -> DataFrame:
    """One row per mention."""
    return folded.select("session_id", "turn", F.explode("decisions").alias("d")).select("session_id", "turn", "d.*")


def summaries(folded: DataFrame) -> DataFrame:
    """One row per entity known at the end of a session."""
    return folded.where("summary IS NOT NULL").select("session_id", F.explode("summary").alias("s")).select("session_id", "s.*")


def cooccurrence(mentions: DataFrame, decay: float = DECAY) -> DataFrame:
    """(session_id, entity_a, entity_b, score) for entities that share a turn: an equi-join on session and turn.

    mentions: session_id, turn (1-based), entity_id. Shared turns are weighted by exp(-decay * age), where age counts
    from the turn's 0-based place to the session's last turn, and are set against the rarer entity's turns."""
    turns = mentions.select("session_id", "turn", "entity_id").distinct()
    last = mentions.groupBy("session_id").agg(F.max("turn").alias("last"))
    each = turns.groupBy("session_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = turns.withColumnRenamed("entity_id", "entity_a"), turns.withColumnRenamed("entity_id", "entity_b")
    shared = a.join(b, ["session_id", "turn"]).where("entity_a < entity_b").join(last, "session_id").groupBy("session_id", "entity_a", "entity_b").agg(F.sum(F.exp(-decay * (F.col("last") - F.col("turn") + 1))).alias("w"))
    n = lambda c: each.select("session_id", F.col("entity_id").alias(c), F.col("n").alias(f"n_{c}"))
    return shared.join(n("entity_a"), ["session_id", "entity_a"]).join(n("entity_b"), ["session_id", "entity_b"]).select("session_id", "entity_a", "entity_b", F.least(F.lit(1.0), F.col("w") / F.least("n_entity_a", "n_entity_b")).alias("score"))
