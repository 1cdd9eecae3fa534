"""A sliding rate limit for each key, in batch and as Structured Streaming. Refused requests don't count against the limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISIONS = "key long, request_id long, at_us long, allowed boolean, wait_us long"
NAMES = [c.split()[0] for c in DECISIONS.split(", ")]


class Window:
    """At most `limit` accepted requests in any `width_us` microseconds; a day limit, if given, is asked first and starts anew at midnight UTC."""

    DAY = 86_400_000_000

    def __init__(self, limit: int, width_us: int, daily: int | None = None, state: tuple | None = None) -> None:
        self.limit, self.width, self.daily = limit, width_us, daily
        hits, self.day, self.used = state or ((), -1, 0)
        self.hits = deque(hits)

    def state(self) -> tuple:
        return list(self.hits), self.day, self.used

    def wait(self, at: int) -> int:
        """0 if the request is accepted, else the microseconds until one would be."""
        if self.daily is not None and at // self.DAY != self.day:
            self.day, self.used = at // self.DAY, 0
        if self.daily is not None and self.used >= self.daily:
            return self.DAY - at % self.DAY
        while self.hits and at - self.hits[0] >= self.width:
            self.hits.popleft()
        if len(self.hits) >= self.limit:
            return self.width - (at - self.hits[0])
        self.hits.append(at)
        self.used += 1
        return 0


def decide(requests: DataFrame, limit: int, width_us: int, daily: int | None = None) -> DataFrame:
    """requests(key, request_id, at_us): whether each is allowed, in order of time and request_id; a key holds `limit` times, no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, None
        for batch in batches:
            out = []
            for k, request, at in batch.itertuples(index=False):
                if window is None or k != key:
                    key, window = k, Window(limit, width_us, daily)
                w = window.wait(int(at))
                out.append((k, request, at, w == 0, w))
            yield pd.DataFrame(out, columns=NAMES)

    return requests.select("key", "request_id", "at_us").dropna().repartition("key").sortWithinPartitions("key", "at_us", "request_id").mapInPandas(run, DECISIONS)


def watch(requests: DataFrame, limit: int, width_us: int, daily: int | None = None) -> DataFrame:
    """The streaming twin; requests of a micro-batch are taken in order of time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = Window(limit, width_us, daily, state.get if state.exists else None)
        out = []
        for at, request in sorted((int(r.at_us), int(r.request_id)) for b in batches for r in b.itertuples()):
            w = window.wait(at)
            out.append((key[0], request, at, w == 0, w))
        state.update(window.state())
        yield pd.DataFrame(out, columns=NAMES)

    return requests.groupBy("key").applyInPandasWithState(step, DECISIONS, "hits array<long>, day long, used long", "append", GroupStateTimeout.NoTimeout)
