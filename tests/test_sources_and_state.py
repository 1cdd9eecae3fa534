"""Readers, text functions, replay of calls, rate limits and simulations against plain Python."""

from __future__ import annotations

import hashlib
import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.functions import ranks, text
from lodestar.operators import replay
from lodestar.sources import files
from lodestar.streaming import limits, simulate
from lodestar.streaming.drift import Limits


def test_questions(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "q.txt").write_text("# note\nHow  many users?\n\n What is due? \r\nHow many users?\n#x\nLasté", encoding="utf-8")
    rows = sorted((r["task_id"], r["question"], r["n"]) for r in files.questions(spark, str(tmp_path / "q.txt")).collect())
    want = [("How many users?", 2), ("What is due?", 1), ("Lasté", 1)]
    assert rows == [(f"h-{i}-{hashlib.sha256(q.encode()).hexdigest()[:8]}", q, n) for i, (q, n) in enumerate(want)]
    (tmp_path / "long.txt").write_text("x" * 501)
    with pytest.raises(Exception, match="too long at line 1"):
        files.questions(spark, str(tmp_path / "long.txt")).collect()
    (tmp_path / "empty.txt").write_text("# only\n")
    assert files.questions(spark, str(tmp_path / "empty.txt")).count() == 0


@pytest.mark.parametrize("form", ["list", "rows", "items", "lines"])
def test_signal_rows(spark: SparkSession, tmp_path: Path, form: str) -> None:
    rows = [{"task_id": "a", "score": 0.5, "correct": True}, {"task_id": "b", "score": None, "correct": False}]
    name = tmp_path / ("s.jsonl" if form == "lines" else "s.json")
    name.write_text("\n\n".join(map(json.dumps, rows)) if form == "lines" else json.dumps(rows if form == "list" else {form: rows}))
    got = files.signal_rows(spark, str(name), "task_id string, score double, correct boolean").orderBy("task_id").collect()
    assert [r.asDict() for r in got] == rows
    name.write_text("" if form == "lines" else "[]" if form == "list" else json.dumps({form: []}))
    with pytest.raises(ValueError, match="no rows"):
        files.signal_rows(spark, str(name), "task_id string, score double, correct boolean")


def test_decisions_prices_and_seeds(spark: SparkSession, tmp_path: Path) -> None:
    log = spark.createDataFrame([(1, "a", "confirmed", "s1"), (2, "a", "rejected", None), (3, "b", "confirmed", "s2")], "seq long, task_id string, decision string, sql string")
    assert {r["task_id"]: (r["decision"], r["sql"]) for r in files.last_decisions(log).collect()} == {"a": ("rejected", None), "b": ("confirmed", "s2")}
    assert files.tally(spark.createDataFrame([("a",), ("b",), ("c",)], "task_id string"), log).first() == (1, 1, 0, 1)
    (tmp_path / "p.json").write_text(json.dumps({"models": {"m": {"input": 1.5, "output": 3}}}))
    assert files.prices(spark, str(tmp_path / "p.json")).collect() == [("m", 1.5, 3.0)]
    (tmp_path / "l.json").write_text(json.dumps({"spend": [{"run_id": "r1", "usd": 2.0}, {"run_id": "r2", "usd": 1.0}], "reservations": [{"run_id": "r3", "usd": 5.0, "expires_at": "2024"}]}))
    seed = files.ledger_seed(spark, str(tmp_path / "l.json"))
    add, skipped = files.add_missing(seed.where("run_id = 'r1'"), seed, ["kind", "run_id"])
    assert {r["run_id"] for r in add.collect()} == {"r2", "r3"} and [r["run_id"] for r in skipped.collect()] == ["r1"]


def test_sinks(spark: SparkSession, tmp_path: Path) -> None:
    df = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "x int, y string")
    files.write_once(df, str(tmp_path / "once"))
    with pytest.raises(AnalysisException):
        files.write_once(df, str(tmp_path / "once"))
    path = files.write_addressed(df, str(tmp_path))
    assert files.write_addressed(df.orderBy(F.desc("x")).select("y", "x"), str(tmp_path)) == path and files.read_addressed(spark, path).count() == 3
    assert files.digest(df.distinct()) != files.digest(df)
    df.distinct().write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="name says"):
        files.read_addressed(spark, path)


def test_stages_logs_and_forms(spark: SparkSession, tmp_path: Path) -> None:
    made = []
    build = lambda: made.append(1) or spark.range(3)
    one = files.memoised(spark, str(tmp_path / "stages"), "split", {"seed": 1}, ["a"], build)
    again = files.memoised(spark, str(tmp_path / "stages"), "split", {"seed": 1}, ["a"], build)
    other = files.memoised(spark, str(tmp_path / "stages"), "split", {"seed": 1}, ["b"], build)
    assert (one[1], again[1], other[1], len(made), again[0].count()) == (False, True, False, 2, 3)
    for _ in range(2):
        files.append_log(spark.range(2), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    (tmp_path / "r.jsonl").write_text('{"question": "How  many?", "sql": "SELECT 1"}\n{"question": "Why?", "sql": "SELECT 2"}\n')
    assert {tuple(r) for r in files.references(spark, str(tmp_path / "r.jsonl")).collect()} == {("How many?", "SELECT 1"), ("Why?", "SELECT 2")}
    (tmp_path / "r2.jsonl").write_text('{"question": "How  many?", "sql": "SELECT 1"}\n{"question": "How many?", "sql": "SELECT 2"}\n')
    with pytest.raises(Exception, match="occurs twice"):
        files.references(spark, str(tmp_path / "r2.jsonl")).collect()
    for k, text_ in enumerate(['{"items": [{"question": "a  b"}, {"question": "c"}]}', '{"questions": ["a b", "c"]}', '["a b", "c"]', '[{"question": "a b"}, {"question": "c"}]', '{"question": "a b"}\n{"question": "c"}', "# note\na  b\nc\n"]):
        (tmp_path / f"q{k}").write_text(text_)
        assert sorted(r["question"] for r in files.any_questions(spark, str(tmp_path / f"q{k}")).collect()) == ["a b", "c"], text_
    (tmp_path / "n.json").write_text(json.dumps({"questions": ["a", "b"], "sqls": ["1", "2"], "families": ["x", "y"]}))
    assert {tuple(r) for r in files.natural_rows(spark, str(tmp_path / "n.json")).collect()} == {("a", "1", "x"), ("b", "2", "y")}
    (tmp_path / "n2.json").write_text(json.dumps({"questions": ["a", "b"], "sqls": ["1"], "families": ["x", "y"]}))
    with pytest.raises(Exception, match="different lengths"):
        files.natural_rows(spark, str(tmp_path / "n2.json")).collect()
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "task_id int, score double")
    files.write_signals(rows, str(tmp_path / "signals"))
    assert files.read_signals(spark, str(tmp_path / "signals")).count() == 2
    rows.limit(1).write.mode("overwrite").parquet(str(tmp_path / "signals" / "rows"))
    with pytest.raises(ValueError, match="header says"):
        files.read_signals(spark, str(tmp_path / "signals"))
    drafts = spark.createDataFrame([("a", "q", "s"), ("b", "q", "s")], "task_id string, question string, sql string")
    log = spark.createDataFrame([(1, "a", "confirmed", "t"), (2, "b", "confirmed", None), (3, "b", "rejected", None)], "seq long, task_id string, decision string, sql string")
    assert [tuple(r) for r in files.confirmed(drafts, log).collect()] == [("a", "q", "t")]
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    assert files.embedding_key("m", 8, texts) == files.embedding_key("m", 8, texts.orderBy("text").distinct()) != files.embedding_key("m", 9, texts)
    for name in ("report", "run", "tree"):
        (tmp_path / f"{name}.json").write_text('{"a": 1}')
    (tmp_path / "events.jsonl").write_text('{"id": 2, "event": "log", "data": "y"}\n{"id": 1, "event": "log", "data": "x"}\n')
    assert [r["id"] for r in files.bundle(spark, str(tmp_path))["events"].collect()] == [1, 2]


EXTRACTED = [
    ("```sql\nSELECT 1;\n```", "SELECT 1"),
    ("<think>```sql\nSELECT 0\n```</think>Here:\n```\n-- c\nWITH a AS (SELECT 1) SELECT * FROM a\n```\ntext", "WITH a AS (SELECT 1) SELECT * FROM a"),
    ("```sql\nSELECT 1\n```\n```\nnot a query\n```", "SELECT 1"),
    ("early</think>The answer is SELECT x FROM t WHERE y = 'a;b';", "SELECT x FROM t WHERE y = 'a;b'"),
    ("```sql\nSELECT a\nFROM t", "SELECT a\nFROM t"),
    ("SELECT old FROM t\n\nSELECT new FROM t\n\nThat was it.", "SELECT new FROM t"),
    ("SELECT 1; SELECT 2;", "SELECT 2"),
    ("I would select none", "select none"),
    ("selected nothing", None),
    ("<think>SELECT 1", None),
    ("", None),
    (None, None),
]


def test_text(spark: SparkSession) -> None:
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXTRACTED)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(text.extract_sql(F.col("t"))).collect()] == [w for _, w in EXTRACTED]
    one = spark.createDataFrame([("How many  'Gold' users in Peru paid $1,200.50 by 2024-01-02?", "SELECT  x FROM t -- c\nWHERE a = 'it''s' AND b > 1.5")], "q string, s string")
    row = one.select(text.skeleton(F.col("q"), ("Peru", "gold")), text.masked_sql(F.col("s")), text.normal_paraphrase(F.lit("  Été, -- Oui! "))).first()
    assert tuple(row) == ("how many <s> users in <v> paid <n> by <n>?", "select x from t where a = ? and b > ?", "été oui")
    cost = one.select(text.break_even(F.lit(10.0), F.lit(1.0), F.lit(4.0), F.lit(0.25)), text.break_even(F.lit(10.0), F.lit(5.0), F.lit(4.0), F.lit(0.0))).first()
    assert tuple(cost) == (5, None)


STATE = [
    ("account", "1", {"plan": "starter", "seats": 9, "status": "active", "taken": 9}),
    ("account", "2", {"plan": "free", "seats": 3, "status": "suspended", "taken": 1}),
    ("user", "a@x", {"account_id": 1}),
    ("invoice", "5", {"status": "paid", "amount_cents": 100}),
    ("invoice", "6", {"status": "paid"}),
    ("ticket", "7", {"status": "open"}),
]
USER = {"account_id": 1, "email": "n@x", "full_name": "N", "role": "member"}
#: The calls of a task, how many of them apply, the error, and what has changed.
TASKS = [
    ([("add_seat", {"account_id": 1, "count": 1}), ("create_user", USER)], 2, None, {"account/1": {"seats": 10, "taken": 10}, "users": ["n@x"]}),
    ([("create_user", USER)], 0, "no_free_seat", {}),
    ([("add_seat", {"account_id": 1, "count": 2})], 0, "over_seat_limit", {}),
    ([("add_seat", {"account_id": 1, "count": 11})], 0, "argument_count", {}),
    ([("suspend_account", {"account_id": 2, "reason": "abuse"})], 0, "account_not_open", {}),
    ([("refund_invoice", {"invoice_id": 5}), ("refund_invoice", {"invoice_id": 5})], 1, "not_paid", {"invoice/5": {"refunded": True, "status": "void"}}),
    ([("refund_invoice", {"invoice_id": 6})], 0, "no_amount", {}),
    ([("refund_invoice", {"invoice_id": 99})], 0, "no_invoice", {}),
    ([("close_ticket", {"ticket_id": 7, "resolution": "resolved"})], 0, "unassigned", {}),
    ([("assign_ticket", {"ticket_id": 7, "agent": "dana"}), ("close_ticket", {"ticket_id": 7, "resolution": "resolved"})], 2, None, {"ticket/7": {"assignee": "dana", "resolution": "resolved", "status": "closed"}}),
    ([("lookup_user", {"email": "a@x"}), ("add_seat", {"account_id": 1, "count": 1}), ("create_user", USER | {"email": "a@x"})], 2, "email_taken", {"account/1": {"seats": 10}}),
    ([("add_seat", {"account_id": 1, "count": 1}), ("create_user", USER), ("lookup_user", {"email": "n@x"}), ("lookup_user", {"email": "m@x"})], 3, "no_user", {"account/1": {"seats": 10, "taken": 10}, "users": ["n@x"]}),
    ([("nothing", {})], 0, "unknown_tool", {}),
    ([("lookup_ticket", {"ticket_id": 7, "more": 1})], 0, "argument_names", {}),
    ([("lookup_ticket", {"ticket_id": True})], 0, "argument_ticket_id", {}),
]


def test_replay(spark: SparkSession) -> None:
    state = spark.createDataFrame([(k, i, json.dumps(f)) for k, i, f in STATE], "kind string, id string, fields string")
    rows = [(t, s, tool, json.dumps(args)) for t, (calls, *_) in enumerate(TASKS) for s, (tool, args) in enumerate(calls)]
    calls = spark.createDataFrame(rows + [(90, 0, None, None), (91, 0, "lookup_user", "{")], "task long, step long, tool string, args string")
    done = replay.replay(calls, state)
    got = {r["task"]: (r["n_applied"], r["error"], json.loads(r["changed"]), r["ok"], r["failed_step"]) for r in done.collect()}
    for t, (_, n, error, changed) in enumerate(TASKS):
        assert got[t] == (n, error, changed, error is None, None if error is None else n), t
    assert got[90][1] == "unknown_tool" and got[91][1] == "argument_names"
    assert replay.replay(calls.limit(0), state).count() == 0 and {r["task"] for r in replay.same_state(done, done).where("same").collect()} == {0, 9}
    bad = replay.corrupt(calls)
    assert {r["fault"] for r in bad.collect()} == {"drop_call", "wrong_id", "wrong_number", "wrong_enum", "swapped_args", "broken_order", "extra_call"}
    enum = {r["task"]: json.loads(r["args"]) for r in bad.where("fault = 'wrong_enum' AND tool = 'close_ticket'").collect()}
    assert enum[8]["resolution"] == "wont_fix"
    pair = spark.createDataFrame([(0, 0, "close_ticket", '{"resolution":"resolved","ticket_id":7}'), (0, 1, "close_ticket", '{"resolution":"duplicate","ticket_id":8}'), (1, 0, "suspend_account", '{"account_id":2,"reason":"abuse"}')], "task long, step long, tool string, args string")
    swapped = {(r["task"], r["step"]): r["args"] for r in replay.corrupt(pair).where("fault = 'swapped_args'").collect()}
    assert swapped == {(0, 0): '{"resolution":"resolved","ticket_id":8}', (0, 1): '{"resolution":"duplicate","ticket_id":7}', (1, 0): '{"account_id":"abuse","reason":2}'}
    other = replay.replay(calls.where("NOT (task = 9 AND step = 1)"), state)
    assert [tuple(r) for r in replay.differences(done, other).collect()] == [(9, "ticket", ["7"])]


CALLS = [{"tool": "assign_ticket", "args": {"ticket_id": 3, "agent": "eli"}}, {"tool": "close_ticket", "args": {"ticket_id": 3, "resolution": "resolved"}}]


def test_call_lists(spark: SparkSession) -> None:
    as_text, want = json.dumps(CALLS), json.dumps(CALLS, sort_keys=True, separators=(",", ":"))
    outputs = [
        (f"Sure!\n```json\n{json.dumps(CALLS, indent=2)}\n```\nDone.", want), (f"```\n{as_text}\n```", want), (f"<think>maybe [1, 2] first</think>\n```json\n{as_text}\n```", want),
        (f"so </think>```json\n{as_text}", want), (f"```json\n[]\n```\nActually:\n```json\n{as_text}\n```", want), (f"The calls are {as_text} as requested.", want), (as_text, want),
        ("```json\n[]\n```", "[]"), ("[]", "[]"), ("Nothing to do [] really", None), ("", None), (None, None), ("I cannot.", None), ("```json\n[1, 2]\n```", None), ("<think>open ```json\n[]\n```", None),
        ('```json\n{"tool": "a", "args": {}}\n```', '[{"args":{},"tool":"a"}]'), ('```json\n[{"tool": "a", "x": 2}]\n```', '[{"tool":"a","x":2}]'),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(outputs)], "i int, t string")
    assert [r[0] for r in df.select("i", replay.extracted_calls(F.col("t")).alias("c")).orderBy("i").select("c").collect()] == [w for _, w in outputs]


def brute_limit(times: list[tuple[int, int]], limit: int, width: int, daily: int | None) -> dict[int, bool]:
    taken, out = [], {}
    for at, request in sorted(times):
        today = sum(t // limits.Window.DAY == at // limits.Window.DAY for t in taken)
        out[request] = (daily is None or today < daily) and sum(at - t < width for t in taken) < limit
        taken += [at] if out[request] else []
    return out


@pytest.mark.parametrize("daily", [None, 5])
def test_rate_limit(spark: SparkSession, tmp_path: Path, daily: int | None) -> None:
    rng = random.Random(5)
    hour = 3_600_000_000
    rows = sorted(((k, i * 4 + k, rng.randrange(0, 72) * hour) for k in range(4) for i in range(60)), key=lambda r: r[2])
    schema = "key long, request_id long, at_us long"
    want = {}
    for k in range(4):
        want |= brute_limit([(at, r) for key, r, at in rows if key == k], 2, 3 * hour, daily)
    got = limits.decide(spark.createDataFrame(rows, schema), 2, 3 * hour, daily).collect()
    assert {r["request_id"]: r["allowed"] for r in got} == want and all((r["wait_us"] == 0) == r["allowed"] for r in got)
    times = sorted({r[2] for r in rows})
    cuts = [times[0], times[len(times) // 2], times[-1] + 1]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame([r for r in rows if a <= r[2] < b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = f"limits_{daily}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limits.watch(stream, 2, 3 * hour, daily).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r["request_id"]: r["allowed"] for r in spark.table(name).collect()} == want


def test_first_trips_and_calibration(spark: SparkSession) -> None:
    rng = np.random.default_rng(1)
    for _ in range(30):
        flags, w = (rng.random(40) < rng.random()).astype(np.int8), int(rng.integers(1, 9))
        least = int(rng.integers(1, 12))
        want = []
        for j in range(1, w + 1):
            hit = [t + 1 for t in range(len(flags)) if t + 1 >= least and flags[max(0, t + 1 - w) : t + 1].sum() * w >= j * min(t + 1, w)]
            want.append(hit[0] if hit else 0)
        assert simulate.first_trips(flags, w, least).tolist() == want
    rows = lambda flags: spark.createDataFrame([(i, bool(f)) for i, f in enumerate(flags)], "place long, deferred boolean")
    flags = rows(rng.random(500) < 0.2)
    found = simulate.calibrate(flags, 10, 1.0, n_streams=40, length=500)
    assert found == simulate.calibrate(flags, 10, 1.0, n_streams=40, length=500) and found["rate"] <= 1.0 < 1000
    assert found["tau_num"] >= simulate.calibrate(flags, 10, 50.0, n_streams=40, length=500)["tau_num"]
    with pytest.raises(ValueError, match="no share"):
        simulate.calibrate(rows(np.ones(50)), 10, 0.5, n_streams=5, length=200)
    drawn = simulate.blocks(spark, 7, 3, 45, 20, 1, 0).collect()
    assert len({(r["stream"], r["step"]) for r in drawn}) == 135 and all(0 <= r["place"] < 7 for r in drawn)
    at = {(r["stream"], r["step"]): r["place"] for r in drawn}
    assert all(at[s, k + 1] == (at[s, k] + 1) % 7 for s, k in at if (k + 1) % 20 and (s, k + 1) in at)


def test_burst(spark: SparkSession) -> None:
    rows = lambda deferred, correct: spark.createDataFrame([(0, deferred, correct)], "place long, deferred boolean, correct boolean")
    good, bad = rows(False, True), rows(True, False)
    report = simulate.burst(good, bad, Limits(window=10, tau_num=1, tau_den=2, least=10), 5, 50, 30)
    assert {(r["tripped_at"], r["latency"], r["false_alarm"], r["wrong_before"]) for r in report.collect()} == {(54, 5, False, 0)}
    assert simulate.verdict(report, 5, 0.0).first()["passes"] and not simulate.verdict(report, 4, 0.0).first()["passes"]
    quiet = simulate.burst(good, good, Limits(), 3, 20, 20)
    assert quiet.where("tripped_at IS NULL AND latency IS NULL").count() == 3 and not simulate.verdict(quiet, 5, 1.0).first()["passes"]
    assert [tuple(r) for r in simulate.sweep({"a": report}).collect()] == [("a", 5, 5, 5, 5, 5, 0)]
    routed = simulate.routes(spark.createDataFrame([("teacher", 0.9), (None, 0.9), (None, 0.1)], "served_by string, score double"), 0.5)
    assert [r["route"] for r in routed.collect()] == ["teacher", "student", "teacher"]


def test_ranks(spark: SparkSession) -> None:
    rng = random.Random(8)
    values = [rng.choice([rng.random(), rng.random() * 1e9, 5.0, -3.0, 1e-300]) for _ in range(3000)] + [None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    down = sorted((v for v in values if v is not None and v == v), reverse=True)
    wanted = [1, 2, 700, 1500, 2999, 3000, 3001, 0]
    assert ranks.largest(df, "v", wanted) == [down[k - 1] if 1 <= k <= 3000 else None for k in wanted]
    rows = spark.createDataFrame([(i * i,) for i in rng.sample(range(5000), 400)], "k long").repartition(5)
    got = ranks.numbered(rows, "k").orderBy("k").collect()
    assert [r["place"] for r in got] == list(range(400))


def test_signal_columns(spark: SparkSession) -> None:
    one = spark.range(1)
    logs = lambda tokens, values: one.select(text.answer_log_probs(F.array(*map(F.lit, tokens)), F.array(*map(F.lit, values)), 99, 7).alias("x")).select("x.*").first()
    assert tuple(logs([1, 7, 2, 3, 99, 4], [-9.0, -9.0, -1.0, -3.0, -9.0, -9.0])) == (-2.0, -3.0, 2)
    assert tuple(logs([1, 2], [-1.0, -2.0])) == (-1.5, -2.0, 2) and tuple(logs([99, 2], [-1.0, -2.0])) == (None, None, 0)
    assert one.select(text.unit(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2)).first()[0] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="without direction"):
        one.select(text.unit(F.array(F.lit(0.0)), 2)).collect()
    assert one.select(text.canonical_json(F.lit('{"b": 1, "a": [1, {"d": 2, "c": null}]}'))).first()[0] == '{"a":[1,{"c":null,"d":2}],"b":1}'
    assert one.select(text.frames(F.lit(3), F.lit("log"), F.lit("x\ny"))).first()[0] == "id: 3\nevent: log\ndata: x\ndata: y\n\n"


def test_faults_in_one_pass(spark: SparkSession) -> None:
    """As wrong answers that are written out, replayed one by one and joined with the right ones."""
    from lodestar.plans import stateful

    sf = "/root/testdata/sf0.001"
    calls = stateful.written(stateful.task_calls(spark, sf).where("step >= 0"), "calls")
    state = stateful.written(stateful.entities(spark, sf), "state")
    want = {}
    done = replay.replay(calls, state).select("task", F.struct("ok", "changed").alias("want"))
    for fault in replay.FAULTS:
        got = replay.replay(replay.corrupt(calls).where(F.col("fault") == fault), state).select("task", F.struct("ok", "changed").alias("did")).join(done, "task")
        want[fault] = tuple(got.agg(F.count("*"), F.count_if(F.col("did") != F.col("want")), F.count_if(F.col("did") == F.col("want"))).first())
    assert {r["fault"]: (r["n"], r["told"], r["same"]) for r in replay.told_faults(calls.drop("last"), state).collect()} == want
    found = replay.told_faults(calls, state)
    assert {r["fault"]: (r["n"], r["told"], r["same"]) for r in found.collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and all(n for n, _, _ in want.values())
