"""The registered queries over fitted models and certificates, against plain numpy and fractions."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import SparkSession

from lodestar.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark: SparkSession) -> list:
    return sorted(map(tuple, spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value", "user_id", "event_type").collect()))


def newton(x: np.ndarray, y: np.ndarray, l2: float = 0.01) -> np.ndarray:
    """Weights of a logistic model with the bias last, which isn't shrunk."""
    a, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([l2] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
    return w


def scores(train: np.ndarray, y: np.ndarray, ask: np.ndarray) -> np.ndarray:
    mean, std = train.mean(0), train.std(0)
    w = newton((train - mean) / std, y)
    return 1 / (1 + np.exp(-(np.hstack([(ask - mean) / std, np.ones((len(ask), 1))]) @ w)))


def test_router_scores(spark: SparkSession, events: list) -> None:
    x, y = np.array([(v, u % 10) for _, v, u, _ in events]), np.array([k != "error" for *_, k in events], float)
    want = scores(x, y, x)
    got = {r["event_id"]: r for r in registry.queries()["router_scores"](spark, SF).collect()}
    assert len(got) == len(events)
    for (event, *_), s in zip(events, want, strict=True):
        assert got[event]["score"] == pytest.approx(s, abs=2e-6)
        assert abs(s - 0.8) < 1e-5 or got[event]["served_by"] == ("student" if s >= 0.8 else "teacher")


def test_out_of_fold_scores(spark: SparkSession, events: list) -> None:
    """Each row is scored by a model that hasn't seen its fold; folds are places modulo five."""
    x, y = np.array([(v, u % 10) for _, v, u, _ in events]), np.array([k != "error" for *_, k in events], float)
    fold = np.arange(len(events)) % 5
    got = {r["event_id"]: (r["fold"], r["score"]) for r in registry.queries()["out_of_fold_scores"](spark, SF).collect()}
    for f in range(5):
        want = scores(x[fold != f], y[fold != f], x[fold == f])
        for k, s in zip(np.flatnonzero(fold == f), want, strict=True):
            assert got[events[k][0]] == (f, pytest.approx(s, abs=2e-6))


def test_risk_certificate(spark: SparkSession, events: list) -> None:
    """Thresholds of the fit half, certified one after the other on the other half until the first that fails."""
    fit = sorted((v for e, v, *_ in events if e % 2 == 0), reverse=True)
    grid = sorted({fit[max(1, math.ceil(i / 20 * len(fit) - 1e-9)) - 1] for i in range(1, 21)}, reverse=True)
    held = [(v, k == "error") for e, v, _, k in events if e % 2 == 1]
    want = {}
    for alpha in (Fraction(15, 100), Fraction(25, 100), Fraction(35, 100)):
        found = None
        for t in grid:
            n, wrong = sum(v >= t for v, _ in held), sum(v >= t and w for v, w in held)
            p = sum((math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(wrong + 1)), Fraction(0))
            if not n or p > Fraction(5, 100):
                break
            found = t
        want[float(alpha)] = found
    assert {r["alpha"]: r["threshold"] for r in registry.queries()["risk_certificate"](spark, SF).collect()} == want
