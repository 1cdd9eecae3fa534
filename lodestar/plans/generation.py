"""Generation of questions with their SQL over the driver's tables: draws of parameters by rows, then the greedy choice of `operators.generate`.

Each template draws its parameters from rows of a table in order of a seeded digest, so a frequent parameter is drawn often, and is a duplicate.
What its SQL would give is worked out for all draws of a template at once, by one join with a count by parameter: no draw is a job of its own.
The oracle takes one draw after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import skeleton, task_id
from lodestar.operators import replay
from lodestar.operators.generate import generate
from lodestar.plans import toolcalls
from lodestar.plans.analytics import oracle, run_sql
from lodestar.plans.stateful import entities, task_calls, task_names
from lodestar.storage import written

#: Draws of a template at most, tasks wanted, caps and streaks.
ATTEMPTS, N, TEMPLATE_CAP, FAMILY_CAP, SKELETON_CAP, EXHAUSTED, WORN_OUT = 40, 90, 16, 24, 9, 6, 5

G: list[tuple[str, str, str]] = []
#: The same draws for Spark: each template's first ATTEMPTS rows are taken by every task, so no task puts a whole table in order.
FIRST: list[str] = []


def g(family: str, template: str, source: str, question: str, sql: str, rows: str, ok: str = "TRUE", counts: str = "") -> None:
    """A template: a source of rows as s with a key, and its question, SQL, number of result rows and success as SQL expressions over s.

    `counts` names the source's join side that has a row for each parameter only, such as a date: it goes to all tasks, and no table is shuffled for it.
    """
    drawn = source.replace("SELECT", f"SELECT /*+ BROADCAST({counts}) */", 1) if counts else source
    cells = f"{question} AS question, {sql} AS sql, {ok} AS ok, CAST({rows} AS BIGINT) AS n_rows, SHA(concat('seed-1|{template}|', CAST(key AS STRING))) AS seeded, key"
    first = f"SELECT {cells} FROM ({drawn}) s ORDER BY seeded, key, question, sql LIMIT {ATTEMPTS}"
    FIRST.append(f"SELECT '{family}' AS family, '{template}' AS template, {len(FIRST)} AS place, row_number() OVER (ORDER BY seeded, key, question, sql) - 1 AS round, question, sql, ok, n_rows FROM ({first}) f")
    turn = f"row_number() OVER (ORDER BY SHA(concat('seed-1|{template}|', CAST(key AS STRING))), key, {question}, {sql}) - 1"
    G.append((family, template, f"SELECT '{family}' AS family, '{template}' AS template, {turn} AS round, {question} AS question, {sql} AS sql, {ok} AS ok, CAST({rows} AS BIGINT) AS n_rows FROM ({source}) s"))


def worded(*ways: str) -> str:
    """One of several wordings, by the row's key."""
    return f"CASE key % {len(ways)} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(ways)) + " END"


QUOTE = "chr(39)"
ORDERS_OF = "SELECT o_orderkey AS key, o.o_orderstatus AS a, o.o_orderpriority AS b, n FROM {orders} o JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_orderstatus, o_orderpriority) c ON c.o_orderstatus = o.o_orderstatus AND c.o_orderpriority = o.o_orderpriority"
g("filters", "orders_status_priority", ORDERS_OF, worded(f"concat('Which orders are ', {QUOTE}, a, {QUOTE}, ' with priority ', {QUOTE}, b, {QUOTE}, '?')", f"concat('List orders of priority ', {QUOTE}, b, {QUOTE}, ' that are ', {QUOTE}, a, {QUOTE}, '.')"),
  f"concat('SELECT o_orderkey FROM orders WHERE o_orderstatus = ', {QUOTE}, a, {QUOTE}, ' AND o_orderpriority = ', {QUOTE}, b, {QUOTE})", "n", counts="c")
g("filters", "orders_priority_status", ORDERS_OF, worded(f"concat('Which orders are ', {QUOTE}, a, {QUOTE}, ' with priority ', {QUOTE}, b, {QUOTE}, '?')", f"concat('Orders by ', {QUOTE}, b, {QUOTE}, ' and ', {QUOTE}, a, {QUOTE}, '?')"),
  f"concat('SELECT o_orderkey FROM orders WHERE o_orderpriority = ', {QUOTE}, b, {QUOTE}, ' AND o_orderstatus = ', {QUOTE}, a, {QUOTE})", "n", counts="c")
g("aggregates", "lines_per_flag", "SELECT l_orderkey * 8 + l_linenumber AS key, l_returnflag AS a, l_linestatus AS b FROM {lineitem}", f"concat('How many lines have flag ', {QUOTE}, a, {QUOTE}, ' and status ', {QUOTE}, b, {QUOTE}, '?')",
  f"concat('SELECT count(*) FROM lineitem WHERE l_returnflag = ', {QUOTE}, a, {QUOTE}, ' AND l_linestatus = ', {QUOTE}, b, {QUOTE})", "1")
g("dates", "orders_in_month", "SELECT o_orderkey AS key, substring(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 7) AS a FROM {orders}", worded("concat('How many orders came in ', a, '?')", "concat('Count the orders of ', a, '.')", "concat('Orders placed during ', a, ': how many?')"),
  f"concat('SELECT count(*) FROM orders WHERE strftime(', {QUOTE}, '%Y-%m', {QUOTE}, ', o_orderdate) = ', {QUOTE}, a, {QUOTE})", "1")
g("dates", "lines_shipped_on", "SELECT l.l_orderkey * 8 + l.l_linenumber AS key, CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS a, l.l_returnflag AS b, coalesce(n, 0) AS n FROM {lineitem} l LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM {lineitem} WHERE l_quantity > 45 GROUP BY CAST(l_shipdate AS DATE)) c ON c.d = CAST(l.l_shipdate AS DATE)",
  "concat('Which lines of over 45 pieces were shipped on ', a, '?')", f"concat('SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_shipdate = ', {QUOTE}, a, {QUOTE})", "n", counts="c")
g("joins", "customers_nation_segment", "SELECT u.c_custkey AS key, n.n_name AS a, u.c_mktsegment AS b, m AS n FROM {customer} u JOIN {nation} n ON n.n_nationkey = u.c_nationkey JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS m FROM {customer} GROUP BY c_nationkey, c_mktsegment) c ON c.c_nationkey = u.c_nationkey AND c.c_mktsegment = u.c_mktsegment",
  worded(f"concat('Customers of segment ', {QUOTE}, b, {QUOTE}, ' in ', {QUOTE}, a, {QUOTE}, '?')", f"concat('Who in ', {QUOTE}, a, {QUOTE}, ' buys for ', {QUOTE}, b, {QUOTE}, '?')"),
  f"concat('SELECT c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = ', {QUOTE}, a, {QUOTE}, ' AND c_mktsegment = ', {QUOTE}, b, {QUOTE})", "n", counts="c")
g("anti_joins", "customers_without_orders", "SELECT u.c_custkey AS key, u.c_nationkey AS a, coalesce(m, 0) AS n FROM {customer} u LEFT JOIN (SELECT c_nationkey, count(*) AS m FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey) GROUP BY c_nationkey) w ON w.c_nationkey = u.c_nationkey",
  "concat('Which customers of nation ', a, ' never ordered?')", "concat('SELECT c_custkey FROM customer WHERE c_nationkey = ', a, ' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)')", "n", counts="w")
g("arithmetic", "value_ratio", "SELECT event_id AS key, user_id AS a, FIELD_K(props) % 4 AS b FROM {events}", worded("concat('Values of user ', a, ' divided by ', b, '?')", "concat('What is a ', b, 'th of the values of user ', a, '?')"),
  "concat('SELECT value / ', b, ' FROM events WHERE user_id = ', a)", "1", ok="b <> 0")
g("filters", "parts_brand_size", "SELECT p.p_partkey AS key, p.p_brand AS a, p.p_size AS b, coalesce(m, 0) AS n FROM {part} p LEFT JOIN (SELECT p_brand, p_size, count(*) AS m FROM {part} WHERE p_retailprice > 1500 GROUP BY p_brand, p_size) c ON c.p_brand = p.p_brand AND c.p_size = p.p_size",
  f"concat('Parts of ', {QUOTE}, a, {QUOTE}, ' in size ', b, ' over 1500?')", f"concat('SELECT p_partkey FROM part WHERE p_retailprice > 1500 AND p_brand = ', {QUOTE}, a, {QUOTE}, ' AND p_size = ', b)", "n", counts="c")

DRAWS = " UNION ALL ".join(f"SELECT family, template, {i} AS place, round, question, sql, ok, n_rows FROM ({sql}) d{i} WHERE round < {ATTEMPTS}" for i, (_, _, sql) in enumerate(G))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, " UNION ALL ".join(FIRST)).withColumns({"round": F.col("round").cast("long"), "skeleton": skeleton(F.col("question"))})


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate(draws(spark, sf_dir), N, TEMPLATE_CAP, FAMILY_CAP, SKELETON_CAP, EXHAUSTED, WORN_OUT)


def generated_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted draws as tasks."""
    rows = _judged(spark, sf_dir).where("verdict = 'accepted'")
    return rows.select("round", "family", "template", task_id(F.col("family"), F.col("sql")).alias("task_id"), "question", F.col("sql").alias("gold_sql"))


def generation_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of each round by what became of them."""
    return _judged(spark, sf_dir).where("verdict <> 'retired'").groupBy("round", "verdict").agg(F.count("*").alias("n"))


#: Families whose tasks may ask for no call at all.
GUARDS = ("eg", "cd", "dc", "ce", "bk")


def toolcall_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of all tool-call templates: of each its first ATTEMPTS tasks in hashed order, with what a replay of their calls gives.

    Tasks are drawn by their names; calls are written for the drawn ones alone, and of the state what these calls name.
    An answer is named by the digest of its calls, as those of a bulk template are never gathered. A draw is ok if its calls run through, and gives
    something if they change the state, or if there are none and its family has such tasks.
    """
    turn = F.row_number().over(Window.partitionBy("template").orderBy(F.xxhash64(F.lit("seed-1"), "task"), "task"))
    drawn = written(task_names(spark, sf_dir).withColumn("turn", turn).where(F.col("turn") <= ATTEMPTS), "tasks")
    calls = written(task_calls(spark, sf_dir, drawn.select("task")), "calls")
    tasks = calls.groupBy("template", "task").agg(F.count_if(F.col("step") >= 0).alias("n"), F.sum(F.xxhash64("step", "tool", "args").cast("decimal(38,0)")).alias("answer"))
    drawn = drawn.join(tasks, ["template", "task"])
    asked = calls.where("step >= 0")
    state = entities(spark, sf_dir).join(F.broadcast(replay.named_by(asked)), ["kind", "id"], "left_semi")
    done = replay.replay(asked, written(state, "state")).select("task", "ok", (F.col("changed") != "{}").alias("changes"))
    place = F.create_map(*[F.lit(x) for i, t in enumerate(toolcalls.T) for x in (t, i)])
    family = F.substring_index("template", "_", 1)
    gives = F.coalesce("changes", family.isin(*GUARDS))
    return drawn.join(done, "task", "left").select(
        family.alias("family"), "template", place[F.col("template")].alias("place"), (F.col("turn") - 1).cast("long").alias("round"), F.concat("template", F.lit(" "), F.col("task").cast("string")).alias("question"),
        F.concat(F.col("n").cast("string"), F.lit(":"), F.col("answer").cast("string")).alias("sql"), F.col("template").alias("skeleton"), F.coalesce("ok", F.lit(True)).alias("ok"), gives.cast("long").alias("n_rows"),
    )


def toolcall_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the draws of each template: accepted, duplicates, errors (calls that don't run through), empty (calls without effect)."""
    judged = generate(toolcall_draws(spark, sf_dir), 6 * N, TEMPLATE_CAP, 6 * FAMILY_CAP, None, EXHAUSTED, WORN_OUT)
    return judged.where("verdict <> 'retired'").groupBy("template", "verdict").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (generated_tasks, generation_drops, toolcall_tasks)}


#: One draw after the other; lists and maps hold what was accepted and how long the streaks are.
ONE_BY_ONE = f"""WITH RECURSIVE draws AS MATERIALIZED ({DRAWS}),
    steps AS MATERIALIZED (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(question), '''[^'']*''', '<s>', 'g'), '\\$?[0-9][0-9,.:-]*', '<n>', 'g'), '\\s+', ' ', 'g') AS skeleton, row_number() OVER (ORDER BY round, place) AS i FROM draws),
    g AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS STRING) AS verdict, CAST([] AS VARCHAR[]) AS sqls, CAST([] AS VARCHAR[]) AS questions, CAST([] AS VARCHAR[]) AS skeletons, CAST([] AS VARCHAR[]) AS templates, CAST([] AS VARCHAR[]) AS families,
               CAST(MAP() AS MAP(VARCHAR, INTEGER)) AS dups, CAST(MAP() AS MAP(VARCHAR, INTEGER)) AS worn
        UNION ALL
        SELECT i, verdict, CASE WHEN verdict = 'accepted' THEN list_append(sqls, sql) ELSE sqls END, CASE WHEN verdict = 'accepted' THEN list_append(questions, question) ELSE questions END,
               CASE WHEN verdict = 'accepted' THEN list_append(skeletons, skeleton) ELSE skeletons END, CASE WHEN verdict = 'accepted' THEN list_append(templates, template) ELSE templates END,
               CASE WHEN verdict = 'accepted' THEN list_append(families, family) ELSE families END,
               CASE WHEN verdict = 'retired' THEN dups ELSE map_concat(dups, MAP([template], [CASE WHEN verdict LIKE 'dup%' THEN nd + 1 ELSE 0 END])) END,
               CASE WHEN verdict = 'retired' OR verdict LIKE 'dup%' THEN worn ELSE map_concat(worn, MAP([template], [CASE WHEN verdict = 'skeleton_cap' THEN nw + 1 ELSE 0 END])) END
        FROM (SELECT *, CASE WHEN nd >= {EXHAUSTED} OR nw >= {WORN_OUT} OR len(templates) >= {N} OR len(list_filter(templates, lambda x: x = template)) >= {TEMPLATE_CAP} OR len(list_filter(families, lambda x: x = family)) >= {FAMILY_CAP} THEN 'retired'
                  WHEN list_contains(sqls, sql) THEN 'duplicate_sql' WHEN list_contains(questions, question) THEN 'duplicate_question' WHEN len(list_filter(skeletons, lambda x: x = skeleton)) >= {SKELETON_CAP} THEN 'skeleton_cap'
                  WHEN NOT ok THEN 'error' WHEN n_rows = 0 THEN 'empty' ELSE 'accepted' END AS verdict
              FROM (SELECT s.*, g.sqls, g.questions, g.skeletons, g.templates, g.families, g.dups, g.worn, coalesce(list_extract(map_extract(g.dups, s.template), 1), 0) AS nd, coalesce(list_extract(map_extract(g.worn, s.template), 1), 0) AS nw FROM g JOIN steps s ON s.i = g.i + 1) x) y)"""
ORACLE = {
    "generated_tasks": ONE_BY_ONE + " SELECT round, family, template, concat('sql-', substring(sha256(concat(family, '|', sql)), 1, 12)) AS task_id, question, sql AS gold_sql FROM g JOIN steps USING (i) WHERE g.verdict = 'accepted'",
    "generation_drops": ONE_BY_ONE + " SELECT round, g.verdict, count(*) AS n FROM g JOIN steps USING (i) WHERE g.verdict <> 'retired' GROUP BY round, g.verdict",
}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in ORACLE.items()}
