"""Events from snapshots: what changed in a run between one snapshot and the next, with ids that go on over restarts.

Snapshots are (key, seq, stages, spend, calls, logs, status), in order of seq within a run. A snapshot gives, in this order, an event for each stage
whose status isn't the one last seen (in the order of its list), one if spend or calls aren't those last seen, one for each line of the log
beyond those seen, and `done` once, when the run is complete or has failed. Ids count a run's events from 1.

In batch it is one pass over sorted partitions; as a stream the state of a run is kept by transformWithState, so a stream that stops and goes on
from its checkpoint gives each event once, under the id that it would have had. `after` resumes a reader after an id, as server-sent frames.

Nulls: a snapshot without key or seq is left out; stages without a name are passed over, and null stages, logs, spend or calls change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.functions.text import frames

SNAPSHOT = "key long, seq long, stages array<struct<name:string,status:string>>, spend long, calls long, logs array<string>, status string"
COLUMNS = ("key", "seq", "stages", "spend", "calls", "logs", "status")
EVENTS = "key long, id long, seq long, kind string, name string, value string"
NAMES = [c.split()[0] for c in EVENTS.split(", ")]
STATE = "last long, names array<string>, statuses array<string>, spend long, calls long, lines long, done boolean"
ENDED = ("complete", "failed")


class Feed:
    """One run: what was last seen of it, and the last id."""

    def __init__(self, state: tuple | None = None) -> None:
        self.last, names, statuses, self.spend, self.calls, self.lines, self.done = state or (0, (), (), None, None, 0, False)
        self.stages = dict(zip(names, statuses, strict=True))

    def state(self) -> tuple:
        return self.last, list(self.stages), list(self.stages.values()), self.spend, self.calls, self.lines, self.done

    def see(self, key: int, seq: int, stages: list | None, spend: int | None, calls: int | None, logs: list | None, status: str | None) -> list[tuple]:
        found: list[tuple] = []
        for name, now in stages or ():
            if name is not None and (name not in self.stages or self.stages[name] != now):
                self.stages[name] = now
                found.append(("stage", name, now))
        if spend is not None and calls is not None and (spend, calls) != (self.spend, self.calls):
            self.spend, self.calls = spend, calls
            found.append(("spend", str(calls), str(spend)))
        for line in (logs or ())[self.lines :]:
            found.append(("log", None, line))
        self.lines = max(self.lines, len(logs or ()))
        if status in ENDED and not self.done:
            self.done = True
            found.append(("done", None, status))
        out = [(key, self.last + 1 + i, seq, *event) for i, event in enumerate(found)]
        self.last += len(out)
        return out


def _plain(batch: pd.DataFrame) -> Iterator[tuple]:
    whole = lambda x: None if pd.isna(x) else int(x)
    some = lambda x: None if x is None or isinstance(x, float) else list(x)
    for key, seq, stages, spend, calls, logs, status in batch[list(COLUMNS)].itertuples(index=False):
        pairs = None if some(stages) is None else [(s["name"], s["status"]) if isinstance(s, dict) else tuple(s) for s in stages]
        yield int(key), int(seq), pairs, whole(spend), whole(calls), some(logs), status if isinstance(status, str) else None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES)


def _known(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(*COLUMNS).dropna(subset=["key", "seq"])


def fold(snapshots: DataFrame) -> DataFrame:
    """All events of all runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, feed = None, None
        for batch in batches:
            out = []
            for row in _plain(batch):
                if feed is None or row[0] != now:
                    now, feed = row[0], Feed()
                out += feed.see(*row)
            yield _frame(out)

    return _known(snapshots).repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, EVENTS)


class Runs(StatefulProcessor):
    """The streaming twin: a value state for each run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("feed", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        feed, out = Feed(tuple(self.state.get()) if self.state.exists() else None), []
        for row in sorted((r for b in rows for r in _plain(b)), key=lambda r: r[1]):
            out += feed.see(*row)
        self.state.update(feed.state())
        yield _frame(out)

    def close(self) -> None:
        pass


def watch(snapshots: DataFrame) -> DataFrame:
    """fold as a stream; snapshots of a micro-batch are taken in order of seq. The session needs `budget.STATE_STORE`."""
    return _known(snapshots).groupBy("key").transformWithStateInPandas(Runs(), outputStructType=EVENTS, outputMode="Append", timeMode="None")


def after(events: DataFrame, key: int, last_id: int) -> DataFrame:
    """(id, frame): the server-sent frames of a run after the last id that a reader has, in order."""
    data = F.to_json(F.struct("name", F.col("seq"), "value"))
    return events.where((F.col("key") == key) & (F.col("id") > last_id)).orderBy("id").select("id", frames(F.col("id"), F.col("kind"), data).alias("frame"))
