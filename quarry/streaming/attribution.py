"""Which search led to which opened turn: keyed state with timers on streams, joins in batch.

Events of sessions are queries, trials (a turn shown for a query, with a trial's id) and expands (a turn
opened). An expand belongs to the newest of the session's last 20 queries, if that is at most 60 seconds
old; it then decides the newest trial of that query and turn that is at most five minutes old and not yet
decided, each trial once. Without such a query an expand gives no row.

On a stream, events wait in the state of their session until the watermark has passed them, and are then
taken in order of time, so arrivals may come in any order. Events that come behind the watermark are
dropped. Both forms take equal times in the order query, trial, expand, then by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Queries of a session that are remembered; microseconds for which they and open trials count.
LAST, NEAR_US, OPEN_US = 20, 60_000_000, 300_000_000
KINDS = ("query", "trial", "expand")
#: Columns of events: ``at`` is microseconds, ``query`` null for expands, ``trial_id`` for trials only.
EVENT = "at bigint, kind string, id bigint, query string, turn_id bigint, trial_id bigint"
OUT = "session string, at bigint, id bigint, turn_id bigint, query string, trial_id bigint"


@dataclass
class Ledger:
    """What a session remembers between events, and what an event makes of it."""

    queries: list[tuple[int, str]] = field(default_factory=list)
    trials: list[tuple[int, int, str, int]] = field(default_factory=list)  # (at, id, query, turn), open ones

    def take(self, event: tuple) -> tuple | None:
        """The (at, id, turn_id, query, trial_id) of an expand that has a query."""
        at, kind, number, query, turn, trial = event
        if kind == "query":
            self.queries = [*self.queries, (at, query)][-LAST:]
            return None
        if kind == "trial":
            self.trials.append((at, trial, query, turn))
            return None
        self.trials = [t for t in self.trials if at - t[0] <= OPEN_US]
        if not self.queries or at - self.queries[-1][0] > NEAR_US:
            return None
        led = self.queries[-1][1]
        same = [t for t in self.trials if t[2] == led and t[3] == turn]
        decided = max(same, default=None)
        if decided:
            self.trials.remove(decided)
        return at, number, turn, led, decided[1] if decided else None


def _order(event: tuple) -> tuple:
    return event[0], KINDS.index(event[1]), event[2]


def _plain(row: tuple) -> tuple:
    """A row of the state or of pandas with None for what is missing."""
    at, kind, number, query, turn, trial = row
    some = lambda x: None if x is None or x != x else x
    whole = lambda x: None if some(x) is None else int(x)
    return int(at), kind, int(number), some(query), whole(turn), whole(trial)


class Attribution(StatefulProcessor):
    """One session's waiting events and ledger."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.queries = handle.getListState("queries", "at bigint, query string")
        self.trials = handle.getListState("trials", "at bigint, trial_id bigint, query string, turn_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for part in rows:
            events = [_plain(r) for r in part[["at", "kind", "id", "query", "turn_id", "trial_id"]].itertuples(index=False, name=None)]
            self.waiting.appendList(events)
            for due in {e[0] // 1000 + 1 for e in events}:
                self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        events = [_plain(tuple(e)) for e in self.waiting.get()]
        now, later = sorted((e for e in events if e[0] < due), key=_order), [e for e in events if e[0] >= due]
        ledger = Ledger([tuple(q) for q in self.queries.get()], [tuple(t) for t in self.trials.get()])
        made = [row for row in map(ledger.take, now) if row]
        # what no later expand can meet goes
        ledger.queries = [q for q in ledger.queries if due - q[0] <= NEAR_US]
        ledger.trials = [t for t in ledger.trials if due - t[0] <= OPEN_US]
        for state, rows in ((self.waiting, later), (self.queries, ledger.queries), (self.trials, ledger.trials)):
            state.put(rows) if rows else state.clear()
        if made:
            out = pd.DataFrame([(key[0], *row) for row in made], columns=["session", "at", "id", "turn_id", "query", "trial_id"])
            yield out.astype({"trial_id": "Int64"})

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def attributed_stream(events: DataFrame, late: str) -> DataFrame:
    """``OUT`` of a stream of events (session, ts and ``EVENT`` but for ``at``); ``late`` is the watermark.

    The session's state store must be RocksDB (``STATE_STORE``), which keyed state with timers needs.
    """
    rows = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return rows.groupBy("session").transformWithStateInPandas(Attribution(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def attributed(events: DataFrame) -> DataFrame:
    """``OUT`` of a table of events: the query of an expand by a window over its session, its trial by a fold
    over the few events of one query and turn."""
    rows = events.withColumn("at", F.unix_micros("ts")).withColumn("_k", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))
    order = Window.partitionBy("session").orderBy("at", "_k", "id")
    last = F.last(F.when(F.col("kind") == "query", F.struct("at", "query")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    led = rows.withColumn("_q", last).filter("kind <> 'query'")
    near = (F.col("kind") == "trial") | (F.col("at") - F.col("_q.at") <= NEAR_US)
    met = led.filter(near).withColumn("query", F.when(F.col("kind") == "trial", F.col("query")).otherwise(F.col("_q.query")))

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        ledger, out = Ledger(), []
        for event in sorted((_plain(r) for r in part[["at", "kind", "id", "query", "turn_id", "trial_id"]].itertuples(index=False, name=None)), key=_order):
            if event[1] == "expand":
                ledger.queries = [(event[0], event[3])]
            row = ledger.take(event)
            out += [(part["session"].iloc[0], *row)] if row else []
        return pd.DataFrame(out, columns=["session", "at", "id", "turn_id", "query", "trial_id"]).astype({"trial_id": "Int64"})

    return met.groupBy("session", "query", "turn_id").applyInPandas(decide, OUT)
