"""Admission of streams with a cap for each address and one for all: a refused stream takes no slot, and its end frees none.

Opens are taken in order of (open_us, id); streams that end at or before an open have left by then. As every decision hangs on those
before it, time is cut into blocks of rows, and a block begins with the streams that were open at the end of the one before: `total` of them
at most, which is all that goes through the driver. A task holds one block's batches in passing and the open streams.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import written

DECISIONS = "key long, id long, open_us long, admitted boolean, reason string, open_all long, open_key long"
#: Decisions, and in the last rows of a block the streams that are still open: close_us is set only there.
ROWS = f"{DECISIONS}, close_us long"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
#: Parts of the time that rows are counted in before they are put together to blocks.
PARTS = 4096


class Slots:
    """The open streams, in order of their end."""

    def __init__(self, per_key: int, total: int, open_: list[tuple[int, int, int]]) -> None:
        self.per_key, self.total, self.open = per_key, total, list(open_)
        heapq.heapify(self.open)
        self.of = Counter(k for _, _, k in self.open)

    def ask(self, key: int, name: int, at: int, until: int) -> str | None:
        """Why the stream is refused, or None."""
        while self.open and self.open[0][0] <= at:
            self.of[heapq.heappop(self.open)[2]] -= 1
        if len(self.open) >= self.total:
            return "total"
        if self.of[key] >= self.per_key:
            return "key"
        heapq.heappush(self.open, (until, name, key))
        self.of[key] += 1
        return None


def blocks(streams: DataFrame, rows: int) -> list[tuple[int, int]]:
    """[from, to) of open_us, of about so many rows each; rows of one time stay together."""
    low, high = streams.agg(F.min("open_us"), F.max("open_us")).first()
    if low is None:
        return []
    width = (high - low) // PARTS + 1
    counts = sorted(streams.groupBy(F.expr(f"(open_us - {low}) div {width}").alias("part")).count().collect())  # PARTS rows at most
    out, start, n = [], low, 0
    for part, count in counts:
        if n and n + count > rows:
            out.append((start, low + part * width))
            start, n = low + part * width, 0
        n += count
    return [*out, (start, high + 1)]


def admit(streams: DataFrame, per_key: int, total: int, rows: int = 2_000_000) -> DataFrame:
    """key, id, open_us, admitted, reason of a refusal (total, which is asked first, or key), and how many streams are open after it, in all and of the key.

    streams: key, id, open_us, close_us (null: never); rows without key, id or open_us are left out.
    """
    spark = streams.sparkSession
    known = streams.select("key", "id", "open_us", F.coalesce("close_us", F.lit((1 << 63) - 1)).alias("close_us")).dropna()
    cuts = blocks(known, rows)
    if len(cuts) > 1:
        known = written(known, "streams")
    parts, open_ = [], []
    for low, high in cuts:

        def run(batches: Iterator[pd.DataFrame], open_: list = open_) -> Iterator[pd.DataFrame]:
            slots = Slots(per_key, total, open_)
            for batch in batches:
                out = []
                for key, name, at, until in batch.itertuples(index=False):
                    reason = slots.ask(int(key), int(name), int(at), int(until))
                    out.append((key, name, at, reason is None, reason, len(slots.open), slots.of[int(key)], None))
                yield pd.DataFrame(out, columns=NAMES).astype({"close_us": "Int64"})
            yield pd.DataFrame([(k, i, None, None, None, None, None, e) for e, i, k in slots.open], columns=NAMES).astype({"open_us": "Int64", "open_all": "Int64", "open_key": "Int64"})

        mine = known.where((F.col("open_us") >= low) & (F.col("open_us") < high))
        done = written(mine.repartition(1).sortWithinPartitions("open_us", "id").mapInPandas(run, ROWS), "slots")
        open_ = [(r["close_us"], r["id"], r["key"]) for r in done.where("close_us IS NOT NULL").collect()]
        parts.append(done.where("close_us IS NULL").drop("close_us"))
    out = parts[0] if parts else spark.createDataFrame([], DECISIONS)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
