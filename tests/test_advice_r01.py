"""What the advice of the first round found cut short in the plans."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from lodestar.plans import stateful, toolcalls, workloads
from lodestar.plans.analytics import run_sql


def test_nearest_of_all_labels(spark: SparkSession, tmp_path: Path) -> None:
    """Each query's nearest vector is under another label."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 8)).astype(np.float32)
    ids = [*range(1499), 40]  # an id that occurs twice isn't its own neighbour
    spark.createDataFrame([(i, v.tolist(), i % 20) for i, v in zip(ids, vectors, strict=True)] + [(None, [1.0] * 8, 0), (1600, [0.0] * 8, 0), (1601, None, 0)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    cosines = np.where(np.equal.outer(ids, ids), -2, unit @ unit.T)
    want = {i: round(max(cosines[k].max() for k, x in enumerate(ids) if x == i), 5) for i in ids if i % 20 == 0}
    got = {r["vec_id"]: r["nn_sim"] for r in workloads.nn_similarity(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_all_templates_are_replayed(spark: SparkSession) -> None:
    sf = "/root/testdata/sf0.001"
    calls = stateful.task_calls(spark, sf).collect()
    want = {name: run_sql(spark, sf, sql).select("task_key").distinct().count() for name, sql in toolcalls.T.items()}
    tasks = {(r["template"], r["task"]) for r in calls}
    assert {name: sum(t == name for t, _ in tasks) for name in want} == want
    assert len({(r["task"], r["step"]) for r in calls}) == len(calls)
    done = stateful.replay_final_state(spark, sf).collect()
    assert {r["task"] for r in done} == {t for _, t in tasks} and len(done) == len(tasks)
