"""Mutations as a table function; a feed that stops and goes on. The queries are held against their oracles with all others."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession

from lodestar.operators import sqltext
from lodestar.plans import checks, generation
from lodestar.streaming import budget, feed

SF = "/root/testdata/sf0.001"


def test_mutations_as_a_table_function(spark: SparkSession) -> None:
    gold = [r["sql"] for r in generation.draws(spark, SF).select("sql").distinct().collect()]
    made = [(k, m) for s in gold for k, m in (sqltext.mutations(s) | sqltext.literal_mutations(s)).items() if m != s]
    want = {k: (n, sum(sqltext.refused(m) is None for j, m in made if j == k), len({m for j, m in made if j == k})) for k, n in Counter(k for k, _ in made).items()}
    assert {r["kind"]: (r["n"], r["n_allowed"], r["n_distinct"]) for r in checks.mutation_catalogue(spark, SF).collect()} == want and len(want) > 5
    rows = checks.variants(spark.createDataFrame([(None, 1), ("SELECT a FROM b WHERE c > 3", 2)], "sql string, id int")).collect()
    assert {(r["id"], r["kind"]) for r in rows} == {(2, "gt_to_gte"), (2, "numeric_literal")}


def shots(n: int) -> list[tuple]:
    rng, rows, logs = random.Random(8), [], {k: [] for k in (1, 2, 3)}
    for seq in range(n):
        key = rng.randint(1, 3)
        logs[key] = logs[key] + [f"line {seq}.{i}" for i in range(rng.choice([0, 0, 2]))]
        stages = rng.choice([None, [(f"s{rng.randint(0, 3)}", rng.choice(["running", "done"])) for _ in range(rng.randint(0, 3))], [(None, "x")]])
        status = rng.choice(["running", None, "complete" if seq > 0.7 * n else "running"])
        rows.append((key, seq, stages, rng.choice([None, seq // 4]), rng.choice([None, seq // 9]), list(logs[key]) or None, status))
    return rows


def plain(rows: list[tuple]) -> list[tuple]:
    out = []
    for key in {r[0] for r in rows}:
        seen, spent, lines, done, last = {}, None, 0, False, 0
        for _, seq, stages, spend, calls, logs, status in (r for r in rows if r[0] == key):
            found = []
            for name, now in stages or []:
                if name is not None and seen.get(name) != now:
                    seen[name] = now
                    found.append(("stage", name, now))
            if spend is not None and calls is not None and spent != (spend, calls):
                spent = spend, calls
                found.append(("spend", str(calls), str(spend)))
            found += [("log", None, x) for x in (logs or [])[lines:]]
            lines = max(lines, len(logs or []))
            if status == "complete" and not done:
                done = True
                found.append(("done", None, status))
            out += [(key, last + 1 + i, seq, *f) for i, f in enumerate(found)]
            last += len(found)
    return sorted(out, key=str)


def test_feed_goes_on_after_a_stop(spark: SparkSession, tmp_path: Path) -> None:
    """A stream that is stopped and started again from its checkpoint gives each event once, under the id it has in batch."""
    rows = shots(90)
    batch = spark.createDataFrame(rows, feed.SNAPSHOT)
    want = plain(rows)
    assert sorted(map(tuple, feed.fold(batch.repartition(4)).collect()), key=str) == want
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    Path(source).mkdir()
    for key, value in budget.STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        for part in range(3):
            spark.createDataFrame(rows[30 * part : 30 * part + 30], feed.SNAPSHOT).coalesce(1).write.mode("append").json(source)
            stream = feed.watch(spark.readStream.schema(feed.SNAPSHOT).json(source))
            query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
            query.processAllAvailable()
            query.stop()
    finally:
        for key in budget.STATE_STORE:
            spark.conf.unset(key)
    events = spark.read.parquet(sink)
    assert sorted(map(tuple, events.select(*feed.NAMES).collect()), key=str) == want
    mine = [r for r in want if r[0] == 2]
    resumed = feed.after(events, 2, len(mine) - 3).collect()
    assert [r["id"] for r in resumed] == [len(mine) - 2, len(mine) - 1, len(mine)]
    assert resumed[0]["frame"].startswith(f"id: {len(mine) - 2}\nevent: ") and resumed[0]["frame"].endswith("\n\n")
    assert sum(r[3] == "done" for r in want) == len({r[0] for r in want if r[3] == "done"})


def test_long_quotes_are_read_in_runs() -> None:
    """A text is tokenised once, and quoted parts by runs: the guard took 20 times as long over these, and gave the same."""
    import time

    from lodestar.operators import sqltext

    sql = "SELECT '" + "it''s a word * " * 5000 + "' AS \"" + 'a ""b"" ' * 5000 + '" /* ' + "text * more " * 5000 + " */"
    assert [t.kind for t in sqltext.tokens(sql)] == ["word", "text", "word", "name"] and sqltext.refused(sql) is None
    started = time.perf_counter()
    for _ in range(20):
        sqltext.refused(sql)
    assert time.perf_counter() - started < 0.15
    assert sqltext.refused("SELECT 'a''") is None and sqltext.refused("/* a **/ SELECT 1; /* *") is None and sqltext.refused("; SELECT 1") == "forbidden"
