"""Reservations against a cap: an ordered fold for each ledger, in batch and as Structured Streaming with timers.

Events are (key, seq, at_us, action, id, nano, ttl_us), in order of at_us and seq within a ledger:

* reserve holds nano under id if what is spent, held and asked for stays within the cap; else it is refused and changes nothing. With a ttl
  the hold is gone at at_us + ttl_us, without one it stays. An id that is held already is a duplicate and changes nothing.
* spend is never refused, as a cap can't undo a cost. With an id that is held its hold shrinks by what is spent, and goes when it is used up;
  settle is a spend that lets go of the rest as well.
* release lets go of a hold; gone, if there is none.

Amounts that are null or negative, unknown actions and reserves without id are invalid and change nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "key long, seq long, at_us long, id string, outcome string, spent long, held long"
NAMES = [c.split()[0] for c in OUTCOMES.split(", ")]
STATE = "spent long, ids array<string>, nanos array<long>, ends array<long>"
NEVER = 1 << 62


class Budget:
    """One ledger: what is spent, and the open holds with their ends."""

    def __init__(self, cap: int, state: tuple | None = None) -> None:
        self.cap = cap
        self.spent, ids, nanos, ends = state or (0, (), (), ())
        self.holds = {i: (n, e) for i, n, e in zip(ids, nanos, ends, strict=True)}
        self.held = sum(n for n, _ in self.holds.values())
        self.ends = [(e, i) for i, (_, e) in self.holds.items()]
        heapq.heapify(self.ends)

    def state(self) -> tuple:
        return self.spent, list(self.holds), [n for n, _ in self.holds.values()], [e for _, e in self.holds.values()]

    def let_go(self, name: str) -> None:
        self.held -= self.holds.pop(name)[0]

    def expire(self, now: int) -> list[tuple]:
        """(at, id, "expired", spent, held) of holds whose end has come, in order."""
        out = []
        while self.ends and self.ends[0][0] <= now:
            end, name = heapq.heappop(self.ends)
            if name in self.holds and self.holds[name][1] == end:
                self.let_go(name)
                out.append((end, name, "expired", self.spent, self.held))
        return out

    def apply(self, at: int, action: str | None, name: str | None, nano: int | None, ttl: int | None) -> str:
        if action == "release":
            if name not in self.holds:
                return "gone"
            self.let_go(name)
            return "released"
        if action not in ("reserve", "spend", "settle") or nano is None or nano < 0 or (action == "reserve" and name is None):
            return "invalid"
        if action == "reserve":
            if name in self.holds:
                return "duplicate"
            if self.spent + self.held + nano > self.cap:
                return "refused"
            end = NEVER if ttl is None else at + ttl
            self.holds[name] = nano, end
            self.held += nano
            heapq.heappush(self.ends, (end, name))
            return "held"
        self.spent += nano
        if name in self.holds:
            left, end = self.holds[name][0] - nano, self.holds[name][1]
            if action == "settle" or left <= 0:
                self.let_go(name)
            else:
                self.held -= nano
                self.holds[name] = left, end
        return "spent"

    def rows(self, key: int, seq: int, at: int, action: str | None, name: str | None, nano: int | None, ttl: int | None) -> list[tuple]:
        out = [(key, None, *e) for e in self.expire(at)]
        outcome = self.apply(at, action, name, nano, ttl)
        return [*out, (key, seq, at, name, outcome, self.spent, self.held)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({"seq": "Int64", "at_us": "int64", "spent": "int64", "held": "int64"})


def _plain(batch: pd.DataFrame) -> Iterator[tuple]:
    whole = lambda x: None if x is None else int(x)
    for key, seq, at, action, name, nano, ttl in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
        yield int(key), int(seq), int(at), action, name, whole(nano), whole(ttl)


COLUMNS = ("key", "seq", "at_us", "action", "id", "nano", "ttl_us")


def fold(events: DataFrame, cap: int) -> DataFrame:
    """What becomes of every event, and a row without seq for every hold that expired before a later event of its ledger.

    Events without key, seq or at_us are left out. One ledger is one task's work, in passing: what is held is its open holds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, budget = None, None
        for batch in batches:
            out = []
            for row in _plain(batch):
                if budget is None or row[0] != now:
                    now, budget = row[0], Budget(cap)
                out += budget.rows(*row)
            yield _frame(out)

    known = events.select(*COLUMNS).dropna(subset=["key", "seq", "at_us"])
    return known.repartition("key").sortWithinPartitions("key", "at_us", "seq").mapInPandas(run, OUTCOMES)


class Ledger(StatefulProcessor):
    """The streaming twin: a value state for the ledger, and a timer for the end that comes next."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("budget", STATE)

    def _budget(self) -> Budget:
        return Budget(self.cap, tuple(self.state.get()) if self.state.exists() else None)

    def _keep(self, budget: Budget) -> None:
        self.state.update(budget.state())
        ends = {-(-e // 1000) for e, i in budget.ends if i in budget.holds and e < NEVER}
        there = {t for t in self.handle.listTimers()}
        for t in there - ends:
            self.handle.deleteTimer(t)
        for t in ends - there:
            self.handle.registerTimer(t)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        budget, out = self._budget(), []
        for row in sorted((r for b in rows for r in _plain(b[list(COLUMNS)])), key=lambda r: (r[2], r[1])):
            out += budget.rows(*row)
        self._keep(budget)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        budget = self._budget()
        out = [(int(key[0]), None, *e) for e in budget.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)]
        self._keep(budget)
        yield _frame(out)

    def close(self) -> None:
        pass


#: What transformWithState needs; set it on the session before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def watch(events: DataFrame, cap: int, delay: str = "0 seconds") -> DataFrame:
    """fold as a stream: events of a micro-batch are taken in order of time; holds expire when the watermark has passed their end.

    Spark drops events that are no later than the watermark, so the delay must cover what comes late.
    """
    timed = events.selectExpr(*COLUMNS, "timestamp_micros(at_us) AS _at").withWatermark("_at", delay)
    known = timed.dropna(subset=["key", "seq", "at_us"])
    return known.groupBy("key").transformWithStateInPandas(Ledger(cap), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
