"""Logistic routing: fit by Newton's method with one aggregation a step, score and decide as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardise(df: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations; a constant feature gets 1."""
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    k = len(features)
    return list(row[:k]), [s or 1.0 for s in row[k:]]


def logit(features: list[str], means: list[float], stds: list[float], weights: list[float]) -> Column:
    """Bias plus weighted standardised features; weights end with the bias."""
    return sum(((F.col(f) - m) / s * w for f, m, s, w in zip(features, means, stds, weights, strict=False)), F.lit(float(weights[-1])))


def fit(df: DataFrame, features: list[str], label: str, l2: float = 0.01, steps: int = 30, tolerance: float = 1e-9) -> tuple[list[float], list[float], list[float]]:
    """(means, stds, weights with the bias last) that minimise the log loss plus l2/2 of the squared weights, bias apart.

    A step is one aggregation of gradient, Hessian and loss over the kept columns, whatever the number of rows; the small system is
    solved on the driver.
    """
    df = df.select(*features, label).persist(StorageLevel.MEMORY_AND_DISK)  # read by every step
    try:
        return _fit(df, features, label, l2, steps, tolerance)
    finally:
        df.unpersist()


def _fit(df: DataFrame, features: list[str], label: str, l2: float, steps: int, tolerance: float) -> tuple[list[float], list[float], list[float]]:
    means, stds = standardise(df, features)
    x = [((F.col(f) - m) / s) for f, m, s in zip(features, means, stds, strict=True)] + [F.lit(1.0)]
    k = len(x)
    ridge = np.diag([l2] * (k - 1) + [0.0])
    w = np.zeros(k)
    y = F.col(label).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((c * float(v) for c, v in zip(x, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
        row = df.agg(F.sum(loss), *[F.sum((p - y) * c) for c in x], *[F.sum(p * (1 - p) * x[i] * x[j]) for i, j in pairs]).first()
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[1 + k :], strict=True):
            h[i, j] = h[j, i] = v
        return row[0] + 0.5 * w @ ridge @ w, np.array(row[1 : 1 + k]) + ridge @ w, h + ridge

    loss, gradient, hessian = measure(w)
    for _ in range(steps):
        step = np.linalg.solve(hessian + 1e-12 * np.eye(k), gradient)
        if gradient @ step < tolerance:
            break
        size = 1.0
        while (new := measure(w - size * step))[0] > loss and size > 1e-6:
            size /= 2
        w, (loss, gradient, hessian) = w - size * step, new
    return means, stds, w.tolist()


def decide(df: DataFrame, score: Column, threshold: float) -> DataFrame:
    return df.withColumn("score", 1 / (1 + F.exp(-score))).withColumn("served_by", F.when(F.col("score") >= threshold, "student").otherwise("teacher"))


def out_of_fold(df: DataFrame, features: list[str], label: str, place: str, k: int = 5, l2: float = 0.01) -> DataFrame:
    """df with `score` by a model fitted on the other folds; the fold of a row is its number (column `place`) modulo k."""
    score = F.lit(None).cast("double")
    for i in range(k):
        means, stds, weights = fit(df.where(F.pmod(F.col(place), F.lit(k)) != i), features, label, l2)
        score = F.when(F.pmod(F.col(place), F.lit(k)) == i, 1 / (1 + F.exp(-logit(features, means, stds, weights)))).otherwise(score)
    return df.withColumn("score", score)


def features_of(signals: DataFrame) -> DataFrame:
    """signals with mean_logprob checked: a row without it is an error, as the router can't score it."""
    there = F.col("mean_logprob").isNotNull()
    return signals.withColumn("mean_logprob", F.when(there, F.col("mean_logprob")).otherwise(F.raise_error(F.concat(F.lit("no mean_logprob for "), F.col("task_id").cast("string"))).cast("double")))


def signals(tasks: DataFrame, student: DataFrame, teacher: DataFrame, nearest: DataFrame) -> DataFrame:
    """tasks(task_id, question, gold_sql), student(task_id, sql, ok, correct, mean_logprob), teacher(task_id, correct), nearest(task_id, nn_sim):
    one row for each task. A missing log-probability is the mean of the others and `imputed`."""
    joined = tasks.join(student, "task_id", "left").join(teacher.select("task_id", F.col("correct").alias("teacher_correct")), "task_id", "left").join(nearest, "task_id", "left")
    mean = student.agg(F.avg("mean_logprob")).scalar()
    return joined.select(
        "task_id", F.sha2("question", 256).alias("question_sha256"), F.sha2("gold_sql", 256).alias("gold_sha256"), F.coalesce("ok", F.lit(False)).alias("exec_ok"), F.coalesce("correct", F.lit(False)).alias("correct"),
        F.coalesce("teacher_correct", F.lit(False)).alias("teacher_correct"), F.coalesce("nn_sim", F.lit(0.0)).alias("nn_sim"), F.coalesce("mean_logprob", mean).alias("mean_logprob"), F.col("mean_logprob").isNull().alias("imputed"),
    )
