"""What replaces windows over whole groups, sums over all terms and comparisons with all rows: the same results."""

from __future__ import annotations

import math
import random
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

from lodestar.functions import ranks, stats
from lodestar.operators import vector_index


def exact_cdf(k: int, n: int, p: Fraction) -> Fraction:
    return sum((math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), Fraction(0))


def test_binomial_against_fractions() -> None:
    for n, p in ((1, Fraction(1, 2)), (7, Fraction(1, 3)), (40, Fraction(2, 25)), (61, Fraction(97, 100)), (300, Fraction(1, 7))):
        for k in range(-1, n + 2):
            want = 0.0 if k < 0 else float(exact_cdf(min(k, n), n, p))
            assert stats.binomial_cdf(k, n, float(p)) == pytest.approx(want, rel=1e-11, abs=1e-15), (n, p, k)
            assert stats.binomial_tail(k, n, float(p)) == pytest.approx(1 - (0.0 if k < 1 else float(exact_cdf(k - 1, n, p))), rel=1e-9, abs=1e-14)


def test_binomial_of_many() -> None:
    """Of a thousand million items, against the normal distribution, and in few steps."""
    n, p = 10**9, 0.08
    sd = math.sqrt(n * p * (1 - p))
    for z in (-4, -1, 0, 1, 4):
        want = 0.5 * math.erfc(-z / math.sqrt(2))
        assert stats.binomial_cdf(round(n * p + z * sd), n, p) == pytest.approx(want, rel=2e-3)
    low, high = stats.clopper_pearson(80_000_000, n, 0.05)
    assert low < 0.08 < high and high - low == pytest.approx(2 * 1.6449 * sd / n, rel=1e-3)
    for a, b in ((1200, 1100), (900, 1101), (2001, 0)):
        tail = sum(math.comb(a + b, i) for i in range(min(a, b) + 1))
        assert stats.mcnemar(a, b) == pytest.approx(float(min(Fraction(1), Fraction(2 * tail, 2 ** (a + b)))), rel=1e-9)
    assert stats.wilson(0, 0) == (0.0, 1.0)


def test_percentiles_by_group(spark: SparkSession) -> None:
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 1e6), 5.0, -0.0, 1e300, -1e308, 1e308])) for _ in range(3000)] + [("c", 2.0), ("d", None), ("d", float("nan"))]
    got = {r["g"]: (r["p0"], r["p1"], r["p2"]) for r in ranks.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", [0.0, 0.5, 0.95]).collect()}
    groups = {g: sorted(v for h, v in rows if h == g and v is not None and v == v) for g in ("a", "b", None, "c")}
    assert got == {g: tuple(vs[max(1, math.ceil(s * len(vs) - 1e-9)) - 1] for s in (0.0, 0.5, 0.95)) for g, vs in groups.items()}
    assert ranks.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", [0.5]).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_index_gives_the_greatest_cosine(spark: SparkSession, tmp_path: Path, clustered: bool) -> None:
    rng = np.random.default_rng(3)
    at = rng.normal(size=(20, 24))
    x = at[rng.integers(0, 20, 3000)] + rng.normal(scale=0.05, size=(3000, 24)) if clustered else rng.normal(size=(600, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 24), (5, None), (6, [0.0] * 24), (7, [float("nan")] * 24), (8, x[9].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    centres = vector_index.centres_of(vectors, 64)
    index = vector_index.build(vectors, str(tmp_path / "index"), centres)
    got = {r["vec_id"]: r for r in vector_index.search(vectors.where("vec_id % 20 = 0"), index, centres).collect()}
    ids = np.array([*range(len(x)), 8])
    y = np.vstack([x, x[9]])
    y /= np.sqrt((y**2).sum(1, keepdims=True))
    asked = list(range(0, len(x), 20))
    for q in asked:
        assert got[q]["nn_sim"] == pytest.approx((y @ y[q])[ids != q].max(), abs=1e-9)
    share = sum(r["compared"] for r in got.values()) / (len(asked) * len(y))
    assert set(got) == set(asked) and (share < 0.3 if clustered else share <= 1.0)
    again = vector_index.build(vectors.limit(0), str(tmp_path / "index"), centres)
    n = index.count()
    assert again.count() == n
    (tmp_path / "index" / "_SUCCESS").unlink()  # as after a build that was lost
    assert vector_index.build(vectors, str(tmp_path / "index"), centres).count() > 0
    assert vector_index.key_of(vectors, centres) == vector_index.key_of(vectors.repartition(2), centres) != vector_index.key_of(vectors.limit(9), centres)
    one = vectors.where("vec_id = 3")
    c = vector_index.centres_of(one)
    assert [r["nn_sim"] for r in vector_index.search(one, vector_index.build(one, str(tmp_path / "one"), c), c).collect()] == [None]


def test_toolcall_generation_without_order(spark) -> None:  # noqa: ANN001
    from lodestar.plans import reports
    from lodestar.plans.analytics import run_sql

    sf = "/root/testdata/sf0.01"
    mine = reports.queries()["toolcall_generation"](spark, sf)
    assert "Window" not in mine._jdf.queryExecution().optimizedPlan().toString()
    want = run_sql(spark, sf, *reports.R["toolcall_generation"])
    assert mine.schema == want.schema and sorted(mine.collect()) == sorted(want.collect())


def test_nn_similarity_runs_one_python_worker_a_task(spark) -> None:  # noqa: ANN001
    from lodestar.plans import workloads

    found = workloads.nn_similarity(spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.count() == found.select("vec_id").distinct().count() > 0
