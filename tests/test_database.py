"""Guarded runs, verdicts and scoring of candidate SQL."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.operators import compare, evaluate, sqltext
from lodestar.operators.database import Batches, Database, Outcome, decoded, encoded, preview


@pytest.fixture(scope="module")
def db(spark: SparkSession) -> Iterator[Database]:
    own = spark.newSession()
    t = own.createDataFrame([(1, "a", 1.0), (2, None, 2.5), (2, None, 2.5), (3, "c", 0.1)], "x int, y string, z double")
    u = own.createDataFrame([(1, "p"), (3, "q")], "x int, w string")
    yield Database(own, {"t": t, "u": u}, max_rows=100, timeout_s=20)


REFUSED = [
    ("DELETE FROM t", "forbidden"), ("UPDATE t SET x = 1", "forbidden"), ("INSERT INTO t VALUES (1, 'x', 0)", "forbidden"), ("DROP TABLE t", "forbidden"), ("CREATE TABLE z (a INT)", "forbidden"), ("SET spark.sql.ansi.enabled = false", "forbidden"),
    ("SELECT 1; DELETE FROM t", "multi_statement"), ("SELECT 1; SELECT 2", "multi_statement"), ("WITH q AS (SELECT 1) DELETE FROM t", "forbidden"), ("WITH q AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM q", "forbidden"),
    ("", "syntax"), ("   ;  ", "syntax"), ("EXPLAIN SELECT 1", "forbidden"), ("VACUUM", "forbidden"), ("SELEC 1", "forbidden"), ("SELECT x FROM (", "syntax"),
    ("SELECT * FROM text.`/etc/passwd`", "forbidden"), ("SELECT * FROM parquet.`/tmp/x`", "forbidden"), ("SELECT * FROM default.t", "forbidden"), ("SELECT * FROM nope", "forbidden"), ("SELECT x FROM t WHERE x IN (SELECT x FROM nope)", "forbidden"),
    ("SELECT reflect('java.lang.System', 'exit', 1)", "forbidden"), ("SELECT x FROM t ORDER BY java_method('java.lang.System', 'nanoTime')", "forbidden"), ("SELECT * FROM range(5)", "forbidden"), ("SELECT * FROM read_files('/tmp')", "forbidden"),
    ("SELECT nope FROM t", "runtime"), ("FROM t SELECT x", "forbidden"), ("SELECT TRANSFORM (x) USING 'cat' AS (y) FROM t", "forbidden"), ("SELECT (SELECT max(x) FROM (SELECT * FROM csv.`/tmp/x`)) FROM t", "forbidden"), ("WITH q AS (SELECT * FROM secret) SELECT * FROM q", "forbidden"),
]


def test_guard(db: Database, spark: SparkSession) -> None:
    spark.range(3).write.mode("overwrite").saveAsTable("secret")
    try:
        assert {s: db.run(s).status for s, _ in REFUSED} == dict(REFUSED)
    finally:
        spark.sql("DROP TABLE secret")
    allowed = [
        "-- hi\nSELECT 1; -- bye\n", "/* c */ WITH q AS (SELECT x FROM t), r AS (SELECT x FROM q) SELECT x FROM r;", "SELECT ';'", "SELECT 'INSERT INTO', x FROM t", "(SELECT x FROM t) UNION (SELECT x FROM u)", "SELECT t.x, count(*) OVER (PARTITION BY y) FROM t LEFT JOIN u USING (x) WHERE EXISTS (SELECT 1 FROM u v WHERE v.x = t.x) GROUP BY ALL",
        "SELECT x, sum(z) AS s FROM t GROUP BY x HAVING sum(z) > 0 ORDER BY s DESC LIMIT 2", "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 5) SELECT k FROM n", "SELECT * FROM (VALUES (1), (2)) AS v(a)",
    ]
    assert [db.run(s).error for s in allowed if s != allowed[5]] == [None] * 8
    assert db.run("SELECT a.x FROM t a CROSS JOIN t b CROSS JOIN t c CROSS JOIN t d").status == "row_cap"
    quick = Database(db.spark, {"slow": db.spark.range(0, 300_000, 1, 2)}, timeout_s=1)
    assert quick.run("SELECT sum(sqrt(a.id * b.id)) FROM slow a JOIN slow b ON a.id < b.id").status == "timeout"


def test_batches_and_codec(db: Database) -> None:
    asked = ["SELECT 1", "DROP TABLE t", "SELECT 1", "SELECT x FROM t ORDER BY x", "nonsense"]
    got = db.run_all(asked)
    assert [o.status for o in got] == ["ok", "forbidden", "ok", "ok", "forbidden"] and got[3].rows == ((1,), (2,), (2,), (3,))
    full = db.run("SELECT X'00FF' AS b, CAST(1.50 AS DECIMAL(5, 2)) AS d, NULL AS n, 'ü' AS s, true AS f, 2.5D AS g")
    assert decoded(encoded(full)) == full and decoded(encoded(got[1])) == got[1]
    assert preview(got[3], 2) == {"columns": ["x"], "rows": [[1], [2]], "row_count": 4}


def test_verdicts(db: Database) -> None:
    match = lambda a, b, ordered=False: compare.verdict(db.run(a), db.run(b), ordered)
    gold = "SELECT x, y, z FROM t"
    assert match("SELECT x AS a, y AS b, z AS c FROM t", gold)[0] and match("SELECT 0.1D + 0.2D", "SELECT 0.3D")[0] and match("SELECT 1 = 1", "SELECT 1")[0] and not match("SELECT '1'", "SELECT 1")[0]
    assert match("SELECT x FROM t ORDER BY x DESC", "SELECT x FROM t ORDER BY x", True) == (False, "order differs")
    assert match("SELECT x FROM t", gold)[1].startswith("column count") and match("SELECT DISTINCT x, y, z FROM t", gold)[1] == "row count: 3, expected 4"
    assert match("SELECT x + 1, y, z FROM t", gold)[1] == "contents: 4 unexpected, 4 missing" and match("SELECT 1", "SELECT nope FROM t")[1].startswith("gold error") and match("DROP TABLE t", gold)[1].startswith("candidate error")
    miss = lambda a: compare.classify_miss(db.run(a), db.run(gold))
    assert [miss(s) for s in ("SELECT z, x, y FROM t", "SELECT x AS w, x, y, z FROM t", "SELECT DISTINCT * FROM t UNION ALL SELECT * FROM t WHERE x = 3", "SELECT x, coalesce(y, ''), z FROM t", "SELECT x, y, z + 0.001 FROM t", "SELECT x + 5, y, z FROM t", gold)] == [
        "column_order", "extra_columns", "duplicates", "null_or_empty", "rounded_to_2", "wrong_result", "order_not_required",
    ]
    a, none, bad = db.run(gold), db.run("SELECT x FROM t WHERE x > 9"), db.run("SELECT nope FROM t")
    assert [compare.gold_problem(o) for o in (a, none, bad)] == [None, "gold_empty", "gold_error"]
    assert [compare.reference_problem(o, a) for o in (a, none, bad, db.run("SELECT 1"))] == [None, "ref_empty", "ref_error", "ref_mismatch"]
    assert compare.agreed([a, a, a]) and not compare.agreed([a, a]) and not compare.agreed([a, a, none])
    assert compare.matches(db.frame(gold), db.tables["t"]) and not compare.matches(db.frame("SELECT DISTINCT * FROM t"), db.tables["t"])
    assert all(not compare.verdict(o, a, True)[0] for o in compare.corrupted(a, True).values())


def test_text_of_queries() -> None:
    sql = "SELECT 'a;b' AS \"x y\", [k], `q` -- note; x\nFROM t /* ORDER BY */ WHERE a = 'it''s'; "
    mask = sqltext.masked(sql)
    assert len(mask) == len(sql) and not set("b;k") & set(mask.split("FROM")[0]) and mask.rstrip().endswith(";") and len(sqltext.statements(sql)) == 1
    assert sqltext.first_keyword("-- x\n (select 1)") == "SELECT" and sqltext.bare("/* a */ SELECT 1 ; ;-- z") == "SELECT 1"
    assert sqltext.is_ordered("SELECT x FROM t ORDER  by x") and not sqltext.is_ordered("SELECT row_number() OVER (ORDER BY x) FROM (SELECT x FROM t ORDER BY x)")
    gold = "SELECT DISTINCT AVG(x), SUM(y), COUNT(*), COALESCE(t.z, 0) FROM t JOIN u ON t.a = u.a LEFT JOIN v ON v.a = t.a WHERE b > 1 AND c < 2 AND d >= 3 AND e IS NULL AND f IS NOT NULL AND g IN (1) AND NOT EXISTS (SELECT 1) AND h = ' AND > ' GROUP BY COUNT(DISTINCT k) ORDER BY x DESC, y ASC"
    made = sqltext.mutations(gold)
    assert set(made) == {n for n, *_ in sqltext.ONE_WAY} | {n for n, *_ in sqltext.BOTH_WAYS} | {n for *_, n in sqltext.BOTH_WAYS} | {"coalesce_zero_removed"} and len(made) == 18
    assert all(" AND > '" in m and m != gold for m in made.values()) and "t.z FROM" in made["coalesce_zero_removed"] and "FROM t LEFT JOIN u" in made["inner_to_left"] and "u.a JOIN v" in made["left_to_inner"]
    assert sqltext.literal_mutations("SELECT 5 FROM t1 WHERE a = '7'") == {"numeric_literal": "SELECT 6 FROM t1 WHERE a = '7'", "string_literal": "SELECT 5 FROM t1 WHERE a = '7x'"}
    assert set(sqltext.plain_mutations("SELECT DISTINCT x FROM t WHERE a > 1 AND b < 2 AND c = 3 ORDER BY x DESC LIMIT 5")) == {n for n, *_ in sqltext.PLAIN} | {"limit_plus_1", "number_plus_1"}


def test_mutation_filter_and_self_test(db: Database) -> None:
    sql = "SELECT x, SUM(z) AS s FROM t WHERE x > 1 AND y IS NULL GROUP BY x ORDER BY x"
    bad = compare.wrong_variants(db, sql)
    assert bad and all(db.run(s).ok and not compare.verdict(db.run(s), db.run(sql), True)[0] for s in bad.values()) and bad == compare.wrong_variants(db, sql)
    assert len(compare.wrong_variants(db, sql, most=1)) == 1 and compare.wrong_variants(db, "SELECT nope FROM t") == {}
    result = compare.self_test(db, [sql, "SELECT y FROM t"])
    assert result["gold"] == 2 and result["gold_rejected"] == result["accepted"] == 0 and result["corrupted"] > 5
    with pytest.raises(ValueError, match="nothing was tested"):
        compare.self_test(db, ["SELECT nope FROM t"])


def test_order_audit_and_shuffled_columns(db: Database) -> None:
    asked = ["SELECT x FROM t ORDER BY x", "SELECT x, y FROM t LIMIT 2", "SELECT count(*) FROM t"]
    found = compare.order_audit(db, asked)
    assert found[asked[0]] == [] and "limit_without_order" in found[asked[1]] and found[asked[2]] == []
    rows = db.spark.range(500).select("id", (F.col("id") * 2).alias("a"), F.concat(F.lit("v"), "id").alias("b"))
    mixed = compare.shuffled_columns(rows, ["id"], 3, block=60)
    assert mixed.columns == rows.columns and mixed.count() == 500
    for c in rows.columns:
        assert mixed.select(c).exceptAll(rows.select(c)).isEmpty()
    assert mixed.where("a = id * 2").count() < 60 and mixed.where("b = concat('v', id)").count() < 60


def test_right_by_chance(db: Database) -> None:
    """A wrong column that happens to hold the same values is found out once columns are permuted apart."""
    spark = db.spark.newSession()
    rows = spark.range(200).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 7).alias("b"))
    mine = Database(spark, {"s": rows})
    found = compare.by_chance(mine, {"s": ["id"]}, [("SELECT b FROM s WHERE id < 50", "SELECT a FROM s WHERE id < 50"), ("SELECT a FROM s", "SELECT a FROM s"), ("SELECT 1", "SELECT 2")])
    assert [(r["right"], r["by_chance"]) for r in found] == [(True, True), (True, False), (False, False)]
    numbered = compare.numbered(rows, F.xxhash64("a"), "n", block=9).orderBy("n").select("n", "a").collect()
    assert [r["n"] for r in numbered] == list(range(200)) and len({r["a"] for r in numbered[:28]}) <= 2


def test_chunks_of_queries(db: Database) -> None:
    """One outcome a text in input order, with one poisoned text in 200; equal to runs one by one."""
    texts = [f"SELECT x + {i}, y FROM t ORDER BY x DESC" for i in range(196)]
    texts[77:77] = ["SELECT x / 0 FROM t", "SELECT array(1) AS a", "DROP TABLE t", "SELECT CAST(1.50 AS DECIMAL(5,2)) AS d, DATE '2024-02-29' AS e, X'00FF' AS f, true AS g, CAST('NaN' AS DOUBLE) AS h, NULL AS i"]
    found = Batches(db).run([*texts, texts[0]])
    assert len(found) == 201 and found[200] == found[0]
    assert [o.status for o in found[77:81]] == ["runtime", "ok", "forbidden", "ok"] and all(o.ok for k, o in enumerate(found) if k not in (77, 79))
    for k in (0, 5, 76, 78, 81, 199):
        assert (found[k].columns, found[k].rows) == ((o := db.run(texts[k])).columns, o.rows)
    assert str(found[80].rows) == str(db.run(texts[80]).rows)
    small = Database(db.spark, db.tables, max_rows=1)
    assert [o.status for o in Batches(small, chunk=2).run(["SELECT x FROM t", "SELECT count(*) FROM t"])] == ["row_cap", "ok"]


def test_scoring(db: Database) -> None:
    spark = db.spark
    tasks = spark.createDataFrame([("a", "f1", "SELECT x FROM t ORDER BY x"), ("b", "f2", "SELECT count(*) FROM t")], "task_id string, family string, gold_sql string")
    answers = [("m", "a", "```sql\nSELECT x FROM t ORDER BY x\n```"), ("m", "b", "SELECT count(*) FROM u"), ("n", "a", "SELECT x FROM t ORDER BY x DESC"), ("n", "b", "no idea"), ("n", "z", "SELECT 1")]
    scored = evaluate.score(db, spark.createDataFrame(answers, "setup string, task_id string, output string"), tasks, block=2)
    got = {(r["setup"], r["task_id"]): (r["correct"], r["miss"]) for r in scored.collect()}
    assert got == {("m", "a"): (True, None), ("m", "b"): (False, "wrong_result"), ("n", "a"): (False, "order_not_required"), ("n", "b"): (False, "unparseable")}
    assert {r["setup"]: (r["n"], r["correct"], r["unparseable"]) for r in evaluate.accuracy(scored).collect()} == {"m": (2, 1, 0), "n": (2, 0, 1)}
    assert {r["setup"]: (r["unparseable"], r["order_not_required"]) for r in evaluate.misses(scored).collect()} == {"m": (0, 0), "n": (1, 1)}
    runs = spark.createDataFrame([("r1", 1, "completed", "q", "g1"), ("r2", 1, "completed", "q", "g2"), ("r0", 1, "failed", "q", "g0"), ("r0", 2, "completed", "q", "g9")], "run_id string, seed int, status string, question string, gold_sql string")
    assert [tuple(r) for r in evaluate.first_gold(runs, 1).collect()] == [("q", "g1")]
    chat = spark.sql("SELECT array(named_struct('role', 'user', 'content', 'old'), named_struct('role', 'user', 'content', 'Schema\nQuestion: how many? ')) AS m")
    assert chat.select(evaluate.question_of(F.col("m"), "Question:")).first()[0] == "how many?" and chat.select(evaluate.same_prompt(F.col("m"), F.slice("m", 1, 1))).first()[0]
    done = spark.createDataFrame([("split", "complete"), ("train", "failed")], "stage string, status string")
    assert [evaluate.may_score(done, "score", n) for n in (["split"], ["split", "train"])] == [None, "missing train"] and evaluate.may_score(done, "split", []) == "already scored"
    assert evaluate.target_families(["b", "a", "b", "c"], ["a", "b"], ["a"]) == ["b"]
    arms = spark.createDataFrame([("x", 5, 0.4, 1e-4), ("y", 9, 0.6, 1e-4), ("z", 9, 0.6, 1e-5)], "arm string, correct int, low double, rate double")
    assert evaluate.better_arm(arms, 0.5).first()["arm"] == "z" and evaluate.better_arm(arms, 0.7).isEmpty()
    draws = evaluate.balanced_draws(spark.range(100).select(F.col("id").cast("string").alias("task_id"), (F.col("id") % 4).cast("string").alias("family")), (8, 4), 1)
    assert {(r["draw"], r["family"]): r["count"] for r in draws.groupBy("draw", "family").count().collect()} == {(d, str(f)): 2 - d for d in (0, 1) for f in range(4)}
    power = evaluate.gate_power(spark, 200, (0.3, 0.6, 0.02), sims=8).first()
    assert tuple(power) == (8, 8) and evaluate.gate_power(spark, 200, (0.3, 0.02, 0.6), sims=8).first()[0] == 0
    rows = evaluate.with_tasks(spark.createDataFrame([("q1",), ("q2",)], "question string"), spark.createDataFrame([("q1", "t1", "f1")], "question string, task_id string, family string"))
    assert {r["question"]: (r["task_id"], r["family"]) for r in rows.collect()} == {"q1": ("t1", "f1"), "q2": ("row", "unknown")}


def test_outcome_of_an_error(tmp_path: Path) -> None:
    assert not Outcome("timeout").ok and Outcome("ok").ok
