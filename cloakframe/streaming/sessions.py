"""The session fold on a stream: state by session, rows of a batch in order of turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import detect
from ..operators.linkage import DEFAULT, Config
from ..operators.session import CAPACITY, DECISION, SUMMARY, Session, _entities_of

#: A line that ends an interactive session.
END_WORDS = ("quit", "exit", "q")


class SessionProcessor(StatefulProcessor):
    """Keeps a :class:`Session` per key. A turn that arrives late counts with the current turn. An idle session is
    forgotten after ``ttl_ms``; a line that is an end word forgets it at once, and lines after it begin a new one. Turns
    that only give the order of a batch's rows (``numbered`` false) count one by one."""

    def __init__(self, capacity: int = CAPACITY, config: Config = DEFAULT, ttl_ms: int | None = None, numbered: bool = True):
        self.capacity, self.config, self.ttl_ms, self.numbered = capacity, config, ttl_ms, numbered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "data binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = Session.load(bytes(self.state.get()[0])) if self.state.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(["turn", "text"], kind="stable").itertuples(index=False):
            if row.text.strip().lower() in END_WORDS:
                session = None
                continue
            session = session or Session(self.capacity, self.config)
            session.take_turn(row.turn if self.numbered else None)
            text, decisions = session.process(row.text, _entities_of(row.entities))
            out.append({"session_id": key[0], "turn": row.turn, "text": row.text, "sanitized_text": text, "decisions": decisions, "summary": None})
        if session and out:
            out[-1]["summary"] = session.summary()
        if session is None:
            self.state.clear()
        else:
            self.state.update((session.dump(),))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def resolve_stream(stream: DataFrame, session_col: str, turn_col: str, text_col: str = "text", detectors: tuple[str, ...] = ("patterns", "names"), capacity: int = CAPACITY, config: Config = DEFAULT, ttl_ms: int | None = None, numbered: bool = True) -> DataFrame:
    """A stream of turns to (session_id, turn, text, sanitized_text, decisions, summary): the summary so far is on a
    session's last row of a batch. Needs the RocksDB state store (see :func:`configure`)."""
    found = detect(stream.select(F.col(session_col).alias("session_id"), F.col(turn_col).alias("turn"), F.coalesce(text_col, F.lit("")).alias("text")), "text", detectors).select("session_id", "turn", "text", "entities")
    schema = f"session_id {found.schema['session_id'].dataType.simpleString()}, turn {found.schema['turn'].dataType.simpleString()}, text string, sanitized_text string, decisions array<{DECISION}>, summary array<{SUMMARY}>"
    processor = SessionProcessor(capacity, config, ttl_ms, numbered)
    return found.groupBy("session_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def configure(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def scan_stream(stream: DataFrame, policy="default", text_col: str = "text", **kw) -> DataFrame:
    """Detection, rewriting and scoring are narrow expressions: they run on a stream as they do on a table."""
    from ..engine import scan

    return scan(stream, policy, text_col, **kw)
