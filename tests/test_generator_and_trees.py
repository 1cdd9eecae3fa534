"""Seeded tables and their properties, the state made of them, trees, and the forms of files."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import replay, tree
from lodestar.sources import files, generator


@pytest.fixture(scope="module")
def made(spark: SparkSession) -> dict[str, DataFrame]:
    return {t: df.persist() for t, df in generator.tables(spark, 3).items()}


def test_rows_hang_on_seed_and_number_alone(spark: SparkSession, made: dict[str, DataFrame]) -> None:
    for t in generator.ROWS:
        rows = sorted(map(tuple, made[t].collect()), key=str)
        assert rows == sorted(map(tuple, generator.generate(spark, t, 3, partitions=7).collect()), key=str)
        assert t == "plans" or rows != sorted(map(tuple, generator.generate(spark, t, 4).collect()), key=str)
        assert len(rows) == generator.n_rows(t, 1)
    assert 3000 <= sum(generator.n_rows(t, 1) for t in generator.ROWS) <= 12_000
    more = generator.generate(spark, "accounts", 3, scale=3)
    assert more.count() == 360 and more.select("account_id").distinct().count() == 360


FOREIGN = (("accounts", "parent_account_id", "accounts", "account_id"), ("users", "account_id", "accounts", "account_id"), ("subscriptions", "account_id", "accounts", "account_id"), ("subscriptions", "plan_id", "plans", "plan_id"),
           ("invoices", "account_id", "accounts", "account_id"), ("invoices", "subscription_id", "subscriptions", "subscription_id"), ("payments", "invoice_id", "invoices", "invoice_id"), ("support_tickets", "account_id", "accounts", "account_id"),
           ("support_tickets", "user_id", "users", "user_id"), ("feature_usage", "user_id", "users", "user_id"))
NULLS = (("plans", "seat_limit"), ("accounts", "deleted_at"), ("accounts", "parent_account_id"), ("accounts", "sales_rep"), ("users", "last_login_at"), ("users", "deleted_at"), ("subscriptions", "end_date"), ("subscriptions", "discount_pct"),
         ("invoices", "amount_cents"), ("invoices", "subscription_id"), ("payments", "processor_ref"), ("support_tickets", "user_id"), ("support_tickets", "closed_at"), ("support_tickets", "csat_score"))


def test_properties(made: dict[str, DataFrame]) -> None:
    for table, column, of, key in FOREIGN:
        missing = made[table].where(F.col(column).isNotNull()).join(made[of].select(F.col(key).alias(column)), column, "left_anti")
        assert missing.isEmpty(), (table, column)
    for table, column in NULLS:
        n, some = made[table].agg(F.count("*"), F.count(column)).first()
        assert 0 < some < n, (table, column)
    assert not made["accounts"].groupBy("name").count().where("count > 1").isEmpty()
    assert made["invoices"].where("due_date <= issued_date").isEmpty()
    assert made["support_tickets"].where("closed_at < opened_at OR (status <> 'closed' AND closed_at IS NOT NULL)").isEmpty()
    assert made["accounts"].where("CAST(CAST(created_at AS DATE) AS STRING) <> created_at").isEmpty()
    assert {r[0] for r in made["invoices"].select("status").distinct().collect()} == set(generator.INVOICE_STATUSES)
    same = made["support_tickets"].where("user_id IS NOT NULL").alias("t").join(made["users"].alias("u"), "user_id").where("t.account_id <> u.account_id")
    assert same.isEmpty()
    with pytest.raises(ValueError, match="no table"):
        generator.generate(made["plans"].sparkSession, "nope", 1)


def test_nested_state_is_one_that_calls_change(spark: SparkSession, made: dict[str, DataFrame]) -> None:
    state = generator.nested_state(made)
    assert state.groupBy("kind", "id").count().where("count > 1").isEmpty()
    assert {r["kind"] for r in state.select("kind").distinct().collect()} == {"account", "user", "invoice", "ticket"}
    paid = made["invoices"].where("status = 'paid' AND amount_cents IS NOT NULL").orderBy("invoice_id").first()["invoice_id"]
    void = made["invoices"].where("status = 'void'").orderBy("invoice_id").first()["invoice_id"]
    calls = [(1, 0, "refund_invoice", json.dumps({"invoice_id": paid})), (2, 0, "refund_invoice", json.dumps({"invoice_id": void})), (3, 0, "refund_invoice", json.dumps({"invoice_id": 10**9}))]
    got = {r["task"]: (r["ok"], r["error"]) for r in replay.replay(spark.createDataFrame(calls, "task bigint, step bigint, tool string, args string"), state).collect()}
    assert got == {1: (True, None), 2: (False, "not_paid"), 3: (False, "no_invoice")}


def test_trees(spark: SparkSession) -> None:
    rng = random.Random(4)
    parent = {i: rng.choice([None, 999, *range(i)]) if rng.random() < 0.1 else (i - 1 if i < 40 and i else rng.randrange(i) if i else None) for i in range(200)}
    rows = [(i, p, i * 3) for i, p in parent.items()] + [(None, 1, 1)]
    nodes = tree.placed(spark.createDataFrame(rows, "id bigint, parent bigint, v bigint"))

    def chain(i: int) -> list[int]:
        out = [i]
        while parent[out[-1]] in parent:
            out.append(parent[out[-1]])
        return out

    assert {r["id"]: (r["root"], r["depth"]) for r in nodes.collect()} == {i: (chain(i)[-1], len(chain(i)) - 1) for i in parent}
    totals = {r["id"]: (r["n"], r["total"]) for r in tree.subtree_totals(nodes, F.col("v")).collect()}
    below = {i: [j for j in parent if i in chain(j)] for i in parent}
    assert totals == {i: (len(b), sum(3 * j for j in b)) for i, b in below.items()}
    assert tree.placed(nodes.select("id", "parent").limit(0)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        tree.placed(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "id bigint, parent bigint"))


def test_tree_of_a_report(spark: SparkSession) -> None:
    report = {
        "rounds": [{"round": 1, "dev_acc": 0.5, "targeted_new_rows": 7, "clusters": [{"description": "joins", "target_families": ["b", "a"]}, {"description": "", "target_families": ["a"]}]}, {"round": 2, "dev_acc": 0.6}],
        "sandbox_lineage": [{"label": "round-1", "uuid": "u1", "parent": "u0"}], "headroom": {"base_dev_acc": 0.25}, "candidate_round": 2,
    }
    reports = spark.createDataFrame([(1, json.dumps(report)), (2, "{}")], "run int, t string").select("run", F.parse_json("t").alias("report"))
    got = [tuple(r)[1:] for r in tree.from_reports(reports).orderBy(F.coalesce("round", F.lit(0))).collect()]
    assert got == [
        ("u0", None, "base model", None, None, None, None, 0.25, None, False),
        ("u1", "u0", "round 1", 1, "joins", 7, ["a", "b"], 0.5, "u1", False),
        ("round-2", "u1", "round 2", 2, None, None, None, 0.6, None, True),
    ]


def test_forms_of_files(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "prices.json").write_text(json.dumps({"a/b": {"input_per_mtok": 1.0, "output_per_mtok": 3.0, "source": "list", "date": "2026-10-01"}, "note": "of today", "hours": {"usd": 2}}))
    (tmp_path / "old.json").write_text(json.dumps({"models": {"m": {"input": 1, "output": 2}}}))
    assert [tuple(r) for r in files.priced(spark, str(tmp_path / "prices.json")).collect()] == [("a/b", 1.0, 3.0, "list", "2026-10-01")]
    prices = files.prices(spark, str(tmp_path / "old.json"))
    assert [tuple(r) for r in prices.collect()] == [("m", 1.0, 2.0)]
    usage = spark.createDataFrame([("m", 2_000_000, 1_000_000), ("x", 1, 1)], "model string, input_tokens bigint, output_tokens bigint")
    assert {r["model"]: r["usd"] for r in files.with_prices(usage, prices, strict=False).collect()} == {"m": 4.0, "x": None}
    with pytest.raises(Exception, match="no price for x"):
        files.with_prices(usage, prices).collect()
    (tmp_path / "seed.json").write_text(json.dumps({"spend": [{"run_id": "r", "usd": 1.5, "note": "n", "evidence": "e.json", "source_root": "s"}], "reservations": [{"id": "i", "holder": "h", "usd": 2.0, "note": "k"}]}))
    assert {(r["kind"], r["usd"], r["evidence"], r["holder"]) for r in files.ledger_seed(spark, str(tmp_path / "seed.json")).collect()} == {("spend", 1.5, "e.json", None), ("reservation", 2.0, None, "h")}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "events.json").write_text(json.dumps([{"id": 2, "event": "done", "data": {"x": 1}}, {"id": 1, "event": "stage", "data": {"name": "a"}}]))
    (tmp_path / "b" / "run.json").write_text('{"status": "complete"}')
    parts = files.bundle(spark, str(tmp_path / "b"))
    assert set(parts) == {"run", "events"} and [(r["id"], r["event"], json.loads(r["data"])) for r in parts["events"].collect()] == [(1, "stage", {"name": "a"}), (2, "done", {"x": 1})]
