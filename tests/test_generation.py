"""Generation with caps and retirement against one draw after the other; streaks over blocks."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.operators.generate import generate, streak_end
from lodestar.plans import generation

DRAW = "family string, template string, place int, round bigint, question string, sql string, skeleton string, ok boolean, n_rows bigint"


def one_by_one(rows: list[tuple], n: int, template_cap: int, family_cap: int, skeleton_cap: int | None, exhausted: int, worn_out: int) -> list[str]:
    sqls, questions, skeletons, templates, families, dup, worn = set(), set(), Counter(), Counter(), Counter(), Counter(), Counter()
    out = []
    for family, template, _, _, question, sql, skeleton, ok, n_rows in rows:
        if templates[template] >= template_cap or families[family] >= family_cap or templates.total() >= n or dup[template] >= exhausted or worn[template] >= worn_out:
            out.append("retired")
            continue
        if sql in sqls or question in questions:
            dup[template] += 1
            out.append("duplicate_sql" if sql in sqls else "duplicate_question")
            continue
        dup[template] = 0
        if skeleton_cap is not None and skeletons[skeleton] >= skeleton_cap:
            worn[template] += 1
            out.append("skeleton_cap")
            continue
        worn[template] = 0
        if not ok or not n_rows:
            out.append("empty" if ok else "error")
            continue
        sqls.add(sql)
        questions.add(question)
        skeletons[skeleton] += 1
        templates[template] += 1
        families[family] += 1
        out.append("accepted")
    return out


@pytest.mark.parametrize(("seed", "n", "template_cap", "family_cap", "skeleton_cap"), [(1, 1000, 12, 30, 6), (2, 25, 9, 100, None), (3, 1000, 100, 14, 3)])
def test_against_one_draw_after_the_other(spark: SparkSession, seed: int, n: int, template_cap: int, family_cap: int, skeleton_cap: int | None) -> None:
    rng, rows = random.Random(seed), []
    for k in range(40):
        for place in range(6):
            x = rng.randint(0, 12 + 9 * place)
            sql = f"t{place if rng.random() < 0.8 else 0} {x}"
            question = f"q{place // 2} {x if rng.random() < 0.7 else x % 3}"
            rows.append((f"f{place % 3}", f"t{place}", place, k, question, sql, f"s{place // 2}{x % 2}", rng.random() < 0.9, rng.randint(0, 3)))
    want = one_by_one(rows, n, template_cap, family_cap, skeleton_cap, 4, 3)
    got = generate(spark.createDataFrame(rows, DRAW).repartition(3), n, template_cap, family_cap, skeleton_cap, 4, 3).orderBy("pos").collect()
    assert [r["verdict"] for r in got] == want
    assert len(set(want)) > 4


def test_nulls_and_empty_draws(spark: SparkSession) -> None:
    rows = [(None, "t", 0, 0, "q", "s", None, None, 5), (None, "t", 0, 1, "q", "s", None, True, None), (None, "t", 0, 2, "q", "s", None, True, 1), (None, None, 0, 3, "q", "s", None, True, 1), ("f", "t", None, 3, "q", "s", None, True, 1)]
    draws = spark.createDataFrame(rows, DRAW)
    assert [(r["round"], r["verdict"]) for r in generate(draws, 5, 5, 5, 1).orderBy("pos").collect()] == [(0, "error"), (1, "empty"), (2, "accepted")]
    assert generate(draws.limit(0), 5, 5, 5, 1).count() == 0
    same = spark.createDataFrame([("f", "t", 0, 0, "q", s, "k", True, 1) for s in "ba"], DRAW)
    assert [(r["sql"], r["verdict"]) for r in generate(same, 5, 5, 5).orderBy("pos").collect()] == [("a", "accepted"), ("b", "duplicate_question")]


def test_streaks_over_blocks(spark: SparkSession) -> None:
    rng = random.Random(5)
    kinds = [rng.choice("+-.") for _ in range(400)]
    rows = spark.createDataFrame([("t", i, i, k) for i, k in enumerate(kinds)], "template string, round bigint, pos bigint, kind string")
    for length in (2, 4, 6):
        streak, want = 0, None
        for i, k in enumerate(kinds):
            streak = 0 if k == "-" else streak + (k == "+")
            if streak >= length:
                want = i
                break
        got = streak_end(rows, F.col("kind") == "+", F.col("kind") == "-", length, block=7).collect()
        assert [r["pos"] for r in got] == ([want] if want is not None else [])


def test_toolcall_tasks(spark: SparkSession) -> None:
    sf = "/root/testdata/sf0.001"
    draws = generation.toolcall_draws(spark, sf).orderBy("round", "place").collect()
    verdicts = one_by_one([tuple(d[c] for c in ("family", "template", "place", "round", "question", "sql", "skeleton", "ok", "n_rows")) for d in draws], 6 * generation.N, generation.TEMPLATE_CAP, 6 * generation.FAMILY_CAP, None, generation.EXHAUSTED, generation.WORN_OUT)
    want = Counter((d["template"], v) for d, v in zip(draws, verdicts, strict=True) if v != "retired")
    assert {(r["template"], r["verdict"]): r["n"] for r in generation.toolcall_tasks(spark, sf).collect()} == want
    assert len({d["template"] for d in draws}) > 30 and {v for _, v in want} >= {"accepted"}


def test_draws_put_no_table_in_order(spark: SparkSession) -> None:
    sf = "/root/testdata/sf0.01"
    mine = generation.draws(spark, sf)
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == len(generation.G)  # a task hands on as many rows as there are draws
    want = generation.run_sql(spark, sf, generation.DRAWS).selectExpr("place", "CAST(round AS BIGINT) AS round", "question", "sql", "ok", "n_rows")
    got = mine.select(*want.columns)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() > 300


def test_toolcall_draws_are_those_of_all_tasks(spark: SparkSession) -> None:
    """Drawing by name gives what gathering all calls first gave; the calls of other tasks aren't written."""
    from lodestar.plans import stateful

    sf = "/root/testdata/sf0.001"
    calls = stateful.task_calls(spark, sf)
    turn = F.row_number().over(generation.Window.partitionBy("template").orderBy(F.xxhash64(F.lit("seed-1"), "task"), "task"))
    tasks = calls.groupBy("template", "task").agg(F.count_if(F.col("step") >= 0).alias("n"), F.sum(F.xxhash64("step", "tool", "args").cast("decimal(38,0)")).alias("answer")).withColumn("turn", turn).where(F.col("turn") <= generation.ATTEMPTS)
    want = {(r["template"], r["turn"] - 1, f"{r['n']}:{r['answer']}") for r in tasks.collect()}
    got = generation.toolcall_draws(spark, sf).collect()
    assert {(r["template"], r["round"], r["sql"]) for r in got} == want and len(got) == len(want)
    some = stateful.task_names(spark, sf).where("template = 'bk_close'").select("task").limit(1)
    assert stateful.task_calls(spark, sf, some).select("template", "task").distinct().count() == 1
