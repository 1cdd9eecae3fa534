"""Reservations and admissions against plain versions, in batch and as a stream."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

from pyspark.sql import SparkSession

from lodestar.streaming import budget, slots

EVENT = "key bigint, seq bigint, at_us bigint, action string, id string, nano bigint, ttl_us bigint"
SECOND = 1_000_000


def ledger_events(seed: int, n: int) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for seq in range(n):
        key = rng.randint(1, 4)
        action = rng.choice(["reserve", "reserve", "reserve", "spend", "settle", "release", "odd", None])
        ttl = rng.choice([None, SECOND * rng.randint(1, 20)])
        rows.append((key, seq, (seq + 1) * SECOND, action, rng.choice([None, *(f"r{i}" for i in range(8))]), rng.choice([None, -1, *range(0, 60)]), ttl))
    return rows


def plain(rows: list[tuple], cap: int) -> list[tuple]:
    """The rules one by one, with all holds looked through at every event."""
    spent, holds, out = defaultdict(int), defaultdict(dict), []
    for key, seq, at, action, name, nano, ttl in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        mine = holds[key]
        for end, i in sorted((e, i) for i, (_, e) in mine.items() if e is not None and e <= at):
            del mine[i]
            out.append((key, None, end, i, "expired", spent[key], sum(n for n, _ in mine.values())))
        good = nano is not None and nano >= 0
        if action == "release":
            outcome = "released" if mine.pop(name, None) else "gone"
        elif action in ("spend", "settle") and good:
            outcome, spent[key] = "spent", spent[key] + nano
            if name in mine:
                left = mine[name][0] - nano
                if action == "settle" or left <= 0:
                    del mine[name]
                else:
                    mine[name] = left, mine[name][1]
        elif action == "reserve" and good and name is not None:
            outcome = "duplicate" if name in mine else "refused" if spent[key] + sum(n for n, _ in mine.values()) + nano > cap else "held"
            if outcome == "held":
                mine[name] = nano, None if ttl is None else at + ttl
        else:
            outcome = "invalid"
        out.append((key, seq, at, name, outcome, spent[key], sum(n for n, _ in mine.values())))
    return out


def order(rows: list) -> list[tuple]:
    return sorted(map(tuple, rows), key=str)


def test_reservations(spark: SparkSession) -> None:
    rows = ledger_events(3, 700)
    got = budget.fold(spark.createDataFrame(rows, EVENT).repartition(5), 1500).collect()
    assert order(got) == order(plain(rows, 1500))
    assert {"held", "refused", "duplicate", "spent", "released", "gone", "invalid", "expired"} == {r["outcome"] for r in got}
    none = spark.createDataFrame([(None, 1, 1, "spend", "a", 1, None)], EVENT)
    assert budget.fold(none, 1).count() == 0


def test_reservations_as_a_stream(spark: SparkSession, tmp_path: Path) -> None:
    """Three micro-batches with state between them: every event has the outcome it has in batch, and holds expire by timers."""
    rows = ledger_events(4, 240)
    for key, value in budget.STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        (source := tmp_path / "in").mkdir()
        stream = budget.watch(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(source)), 900)
        run = lambda: stream.writeStream.format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
        got = []
        for part in range(3):
            spark.createDataFrame(rows[part * 80 : part * 80 + 80], EVENT).coalesce(1).write.mode("append").json(str(source))
            if part != 1:
                query = run() if part == 0 else query
            query.processAllAvailable()
        got = order(spark.sql("SELECT * FROM ledger").collect())
        query.stop()
    finally:
        for key in budget.STATE_STORE:
            spark.conf.unset(key)
    want = plain(rows, 900)
    assert [r for r in got if r[1] is not None] == order(r for r in want if r[1] is not None)
    expired = {r[:5] for r in got if r[1] is None}
    assert expired >= {r[:5] for r in want if r[1] is None} and {r[4] for r in expired} == {"expired"}


def test_admissions(spark: SparkSession) -> None:
    rng = random.Random(2)
    rows = [(rng.randint(0, 5), i, at := rng.randint(0, 400), rng.choice([None, at, at + rng.randint(0, 60)])) for i in range(300)] + [(1, None, 2, 3), (None, 5, 2, 3), (1, 999, None, 3)]
    want, open_ = [], []
    for key, name, at, until in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[2], r[1])):
        open_ = [o for o in open_ if o[1] is None or o[1] > at]
        mine = [o for o in open_ if o[0] == key]
        reason = "total" if len(open_) >= 12 else "key" if len(mine) >= 3 else None
        open_ += [] if reason else [(key, until)]
        want.append((key, name, at, reason is None, reason, len(open_), len([o for o in open_ if o[0] == key])))
    streams = spark.createDataFrame(rows, "key bigint, id bigint, open_us bigint, close_us bigint").repartition(4)
    for size in (1_000_000, 37, 1):
        assert order(slots.admit(streams, 3, 12, rows=size).collect()) == order(want)
        if size == 37:
            assert len(slots.blocks(streams.dropna(subset=["key", "id", "open_us"]), size)) > 5
    assert {w[4] for w in want} == {None, "total", "key"}
    assert slots.admit(streams.limit(0), 3, 12).count() == 0
