"""Registered queries against DuckDB, and the operators that SQL can't express against plain Python."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession

from lodestar.functions import stats
from lodestar.operators import routing
from lodestar.plans import registry
from lodestar.streaming import drift

SF = "/root/testdata/sf0.001"


def cell(v: object) -> str:
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    try:
        return f"{float(v):.9g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark: SparkSession, duck: duckdb.DuckDBPyConnection, name: str) -> None:
    df = registry.queries()[name](spark, SF)
    result = duck.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted(tuple(cell(v) for _, v in sorted(zip(cols, r, strict=True), key=lambda x: x[0])) for r in result.fetchall())
    got = sorted(tuple(cell(r[c]) for c in sorted(cols)) for r in df.collect())
    assert got == want


def test_statistics() -> None:
    assert stats.mcnemar(0, 0) == 1.0 and stats.mcnemar(10, 2) == pytest.approx(0.0385742, abs=1e-6)
    assert stats.binomial_cdf(3, 10, 0.5) == pytest.approx(0.171875)
    low, high = stats.clopper_pearson(0, 36, 0.05)
    assert low == 0 and high == pytest.approx(1 - 0.05 ** (1 / 36), abs=1e-9)
    point, lo, hi = stats.bootstrap_ratio(80, 10, 2, 8)
    assert point == pytest.approx(90 / 82) and lo <= point <= hi and stats.bootstrap_ratio(80, 10, 2, 8) == (point, lo, hi)
    assert stats.promote(200, 60, 3, 37) and not stats.promote(200, 3, 60, 37)
    assert stats.certify([(0.9, 36, 0), (0.8, 60, 1), (0.7, 90, 30), (0.6, 200, 0)], 0.08, 0.05) == 0.9 or stats.binomial_cdf(1, 60, 0.08) <= 0.05
    assert all(math.isnan(x) for x in stats.bootstrap_ratio(0, 5, 0, 5)) and not stats.promote(0, 5, 0, 5)
    assert stats.binomial_tail(7, 10, 0.5) == pytest.approx(0.171875) and stats.binomial_tail(0, 5, 0.1) == 1 and stats.binomial_tail(40, 40, 0.1) == pytest.approx(1e-40, rel=1e-9)
    with pytest.raises(ValueError, match="fall"):
        stats.certify([(0.5, 100, 0), (0.6, 100, 0)], 0.08, 0.05)


def test_router_fit(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    means, stds, w = routing.fit(df, ["a", "b"], "y", l2=0.1)
    z = np.column_stack([(x - means) / stds, np.ones(400)])
    gradient = z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.array([0.1, 0.1, 0]) * w
    assert np.abs(gradient).max() < 1e-3


def brute_drift(events: list[tuple[int, bool, bool | None]], x: drift.Limits) -> list[tuple[int, str]]:
    defers, audits = [], []
    for i, (request, d, a) in enumerate(events):
        defers.append(d)
        audits += [a] if a is not None else []
        last = defers[-x.window :]
        fired = ["deferral"] * (i + 1 >= x.least and sum(last) * x.tau_den >= len(last) * x.tau_num) + ["audit"] * (sum(audits[-x.audits :]) >= x.fail)
        if fired:
            return [(request, "+".join(fired))]
    return []


def test_drift_batch_and_stream(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    rng = random.Random(4)
    limits = drift.Limits(window=6, tau_num=2, tau_den=3, audits=5, fail=3, least=4)
    rows = [(s, r, rng.random() < 0.3 + 0.02 * (r // 10), rng.choice([None, None, True, False])) for r in range(120) for s in range(6)]
    schema = "stream long, request_id long, deferred boolean, audit boolean"
    want = {(s, *x) for s in range(6) for x in brute_drift([(r, d, a) for t, r, d, a in rows if t == s], limits)}
    got = drift.replay(spark.createDataFrame(rows, schema), limits)
    assert {(r["stream"], r["request_id"], r["detector"]) for r in got.collect()} == want and got.count() == 3 * len(want)
    for k in range(3):
        spark.createDataFrame(rows[k * 240 : (k + 1) * 240], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = drift.watch(stream, limits).writeStream.format("memory").queryName("drift_events").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["stream"], r["request_id"], r["detector"]) for r in spark.table("drift_events").collect()} == want


def test_recertification_and_restore(spark: SparkSession) -> None:
    limits = drift.Limits(window=4, tau_num=1, tau_den=2, least=4)
    one, two = "a" * 64, "b" * 64
    machine = drift.Machine(limits)
    assert not machine.recertify(one)  # it is certified
    trip = lambda: [machine.observe(True, None) for _ in range(4)][-1]
    assert trip() and machine.observe(True, None) is None and not machine.recertify("A" * 64) and machine.recertify(one)
    assert trip() and not machine.recertify(one) and machine.recertify(two) and machine.open
    rows = [(0, r, True, None, None) for r in range(6)] + [(0, 6, None, None, one)] + [(0, r, True, None, None) for r in range(7, 12)] + [(0, 12, None, None, one), (0, 13, None, None, two), (1, 0, False, None, two)]
    got = drift.replay(spark.createDataFrame(rows, "stream long, request_id long, deferred boolean, audit boolean, cert string"), limits).collect()
    assert [(r["request_id"], r["kind"]) for r in got if r["kind"] in ("rollback", "recertify")] == [(3, "rollback"), (6, "recertify"), (10, "rollback"), (13, "recertify")]
    log = [(0, 1, "rollback", "rollback", "audit", None), (0, 2, "teacher_only", "teacher", None, None), (0, 3, "recertify", "certified", None, one), (1, 1, "rollback", "rollback", "deferral", two), (2, 4, "rollback", "rollback", "deferral", one), (2, 5, "redistill", "teacher", None, None)]
    state = drift.restore(spark.createDataFrame(log, "stream long, seq long, kind string, state_to string, detector string, cert string"))
    assert {r["stream"]: (r["state"], r["cert"], r["revoked"], r["detector"]) for r in state.collect()} == {0: ("certified", one, [], None), 1: ("teacher", None, [two], "deferral"), 2: ("teacher", None, [one], "deferral")}
