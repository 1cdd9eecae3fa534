"""Further curation, evaluation, monitoring and ledger reports as SQL over the driver's tables; the conventions are those of `workloads`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import ranks
from lodestar.functions.text import unit
from lodestar.operators import evaluate, routing
from lodestar.plans.analytics import oracle, run_sql
from lodestar.plans.toolcalls import T
from lodestar.plans.workloads import CALLS, NORMAL
from lodestar.streaming import simulate

R: dict[str, tuple[str, dict]] = {}


def r(name: str, sql: str, **params: object) -> None:
    R[name] = (" ".join(sql.split()), params)


def normal(alias: str) -> str:
    return NORMAL.replace("text", f"{alias}.text")


MASKED = "regexp_replace({}, '[0-9]+', '?'{})"

# generation and splits
r("invoices_by_month_series", """WITH RECURSIVE m(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM m WHERE k < 12)
    SELECT m.k, count(i.invoice_id) AS n FROM m LEFT JOIN {invoices} i ON CAST(substring(i.issued_date, 6, 2) AS INT) = m.k GROUP BY m.k""")
r("toolcall_generation", "SELECT template, count(*) AS made, count(CASE WHEN calls = '[]' THEN 1 END) AS none, count(CASE WHEN calls <> '[]' AND rn <= :cap THEN 1 END) AS kept FROM (SELECT template, calls, row_number() OVER (PARTITION BY template, calls = '[]' ORDER BY SHA(concat(template, '|', CAST(task_key AS STRING)))) AS rn FROM ("
  + " UNION ALL ".join(f"SELECT '{t}' AS template, task_key, calls FROM ({T[t]}) {t}" for t in ("sc_refund", "sc_close", "cd_plan", "eg_suspend", "ms_assign_close", "dc_onboard")) + ") u) k GROUP BY template", cap=25)
r("capacity_probe", f"SELECT source, count(DISTINCT SHA({NORMAL})) AS distinct_texts, count(*) AS draws FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY SHA(concat('probe', CAST(doc_id AS STRING)))) AS rn FROM {{documents}}) d WHERE rn <= 200 GROUP BY source")
r("reserved_families", "SELECT source FROM (SELECT source, row_number() OVER (ORDER BY SHA(concat('stress', source)), source) AS rn FROM (SELECT DISTINCT source FROM {documents} WHERE source IS NOT NULL) s) t WHERE rn <= 2")
r("sealed_set_drops", f"""SELECT b.item_id, CASE WHEN t.h IS NOT NULL THEN 'train' WHEN d.h IS NOT NULL THEN 'dev' WHEN g.h IS NOT NULL THEN 'gate' ELSE 'kept' END AS reason
    FROM (SELECT item_id, SHA({NORMAL}) AS h FROM {{benchmark}}) b
    LEFT JOIN (SELECT DISTINCT SHA({NORMAL}) AS h FROM {{documents}} WHERE doc_id % 10 < 7) t ON t.h = b.h LEFT JOIN (SELECT DISTINCT SHA({NORMAL}) AS h FROM {{documents}} WHERE doc_id % 10 = 7) d ON d.h = b.h
    LEFT JOIN (SELECT DISTINCT SHA({NORMAL}) AS h FROM {{documents}} WHERE doc_id % 10 > 7) g ON g.h = b.h""")
# Which natural questions may be trained on: the first set, in this order, that holds a question is why it is left out.
SEALED = {
    "heldout": "SELECT text FROM {benchmark}", "stress": "SELECT text FROM {documents} WHERE doc_id % 20 = 19", "human": "SELECT text FROM {conversations} WHERE role = 'user'",
    "dev": "SELECT text FROM {documents} WHERE doc_id % 20 = 9", "exclude_files": "SELECT d.text FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.toxic = 1",
}
r("keep_mask_reasons", f"SELECT coalesce(reason, 'keep') AS reason, count(*) AS n FROM (SELECT d.doc_id, CASE min(s.priority) {' '.join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(SEALED))} END AS reason FROM (SELECT doc_id, SHA({NORMAL}) AS h FROM {{documents}} WHERE doc_id % 10 < 9) d LEFT JOIN ("
  + " UNION ".join(f"SELECT {i} AS priority, SHA({NORMAL}) AS h FROM ({sql}) s{i}" for i, sql in enumerate(SEALED.values())) + ") s ON s.h = d.h GROUP BY d.doc_id) k GROUP BY coalesce(reason, 'keep')")
# Originals first, then others, sampled by a seeded digest so that there are :cap in all; originals are sampled only if they alone are more.
r("capped_selection", """WITH k AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 0 ELSE 1 END AS kind FROM {documents} d LEFT JOIN (SELECT DISTINCT doc_id FROM {labels} WHERE quality = 1) l ON l.doc_id = d.doc_id),
    n AS (SELECT count(*) AS m FROM k WHERE kind = 0) SELECT doc_id, kind FROM (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY SHA(concat('11|', CAST(doc_id AS STRING))), doc_id) AS place FROM k) p CROSS JOIN n
    WHERE place <= :cap AND (kind = 0 OR place <= :cap - m)""", cap=500)
r("leakage_matrix", """WITH d AS (SELECT doc_id % 2 AS side, SHA(lower(text)) AS exact, SHA(DIGITS(lower(text))) AS masked, SHA(text) AS spelled, SHA(DIGITS(text)) AS spelled_masked, source AS template FROM {documents})
    SELECT count(*) AS n, count_if(exact IN (SELECT exact FROM d WHERE side = 0)) AS exact_question, count_if(masked IN (SELECT masked FROM d WHERE side = 0)) AS masked_question,
    count_if(spelled IN (SELECT spelled FROM d WHERE side = 0)) AS exact_sql, count_if(spelled_masked IN (SELECT spelled_masked FROM d WHERE side = 0)) AS masked_sql, count_if(template IN (SELECT template FROM d WHERE side = 0)) AS same_template FROM d WHERE side = 1""")
r("rows_to_tasks", f"SELECT c.conv_id, c.turn, coalesce(CAST(d.doc_id AS STRING), 'row') AS task_id, coalesce(d.source, 'unknown') AS family FROM {{conversations}} c LEFT JOIN (SELECT h, doc_id, source FROM (SELECT SHA({NORMAL}) AS h, doc_id, source, row_number() OVER (PARTITION BY SHA({NORMAL}) ORDER BY doc_id) AS rn FROM {{documents}}) f WHERE rn = 1) d ON d.h = SHA({normal('c')}) WHERE c.role = 'user'")
r("exact_split_sizes", "SELECT doc_id, CASE WHEN place <= :train THEN 'train' WHEN place <= :train + :dev THEN 'dev' WHEN place <= :train + :dev + :gate THEN 'gate' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY first, h, doc_id) AS place FROM (SELECT doc_id, SHA(CAST(doc_id AS STRING)) AS h, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY SHA(CAST(doc_id AS STRING)), doc_id) = 1 THEN 0 ELSE 1 END AS first FROM {labels_docs}) x) y WHERE place <= :train + :dev + :gate".replace("{labels_docs}", "(SELECT d.doc_id, d.source FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id) j"), train=60, dev=15, gate=25)
# evaluation
r("accuracy_cuts", "SELECT cut, name, count(*) AS n, sum(CAST(quality AS BIGINT)) AS correct FROM (SELECT 'all' AS cut, 'all' AS name, quality FROM {labels} UNION ALL SELECT 'family', d.source, l.quality FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id UNION ALL SELECT 'class', d.lang, l.quality FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id UNION ALL SELECT 'set', CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END, quality FROM {labels}) u GROUP BY cut, name")
r("misses_by_setup", "SELECT user_id % 4 AS setup, count(CASE WHEN event_type = 'error' THEN 1 END) AS runtime, count(CASE WHEN event_type = 'click' AND value < 5 THEN 1 END) AS wrong_result, count(CASE WHEN event_type = 'click' AND value >= 5 THEN 1 END) AS column_order FROM {events} WHERE event_type IN ('error', 'click') GROUP BY user_id % 4")
r("first_gold_of_question", "SELECT h, gold FROM (SELECT SHA(text) AS h, turn AS gold, row_number() OVER (PARTITION BY SHA(text) ORDER BY conv_id, turn) AS rn FROM {conversations} WHERE role = 'user') x WHERE rn = 1")
r("arm_decision", "SELECT lang FROM (SELECT d.lang, sum(CAST(l.quality AS BIGINT)) AS correct, avg(CAST(l.quality AS DOUBLE)) - 1.96 * sqrt(avg(CAST(l.quality AS DOUBLE)) * (1 - avg(CAST(l.quality AS DOUBLE))) / count(*)) AS low FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY d.lang) a WHERE low > :base ORDER BY correct DESC, lang LIMIT 1", base=0.5)
r("target_families", "SELECT DISTINCT source FROM {documents} WHERE source IN (SELECT source FROM {documents} WHERE doc_id % 3 = 0) AND source NOT IN (SELECT source FROM {documents} WHERE doc_id = 1 AND source IS NOT NULL) AND source IS NOT NULL")
r("scored_once", "SELECT doc_id, count(*) AS times, CASE WHEN count(*) > 1 THEN 'already scored' WHEN max(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) = 1 THEN 'missing quality' ELSE 'may score' END AS verdict FROM {labels} GROUP BY doc_id")
r("one_shot_evaluation", "SELECT user_id % 3 AS kind, count(*) AS n, count(CASE WHEN value >= :t THEN 1 END) AS served, count(CASE WHEN value >= :t AND event_type = 'error' THEN 1 END) AS wrong, count(CASE WHEN value < :t AND event_type = 'error' THEN 1 END) AS wrong_deferred, count(CASE WHEN value < :t AND event_type <> 'error' THEN 1 END) AS right_deferred, count(CASE WHEN value < :t OR event_type <> 'error' THEN 1 END) AS system_right FROM {events} GROUP BY user_id % 3", t=10.0)
# monitoring
r("recent_incidents", "SELECT event_id, user_id, value FROM {events} WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20")
r("recorded_routes", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'student' WHEN event_id % 3 = 1 THEN 'teacher' END, CASE WHEN value >= :t THEN 'student' ELSE 'teacher' END) AS route FROM {events} WHERE value IS NOT NULL", t=10.0)
BUCKET = "CASE " + " ".join(f"WHEN latency_ms <= {b} THEN {b}" for b in (5, 10, 25, 50, 100, 250, 500, 1000, 2500)) + " ELSE 1000000 END"
r("latency_quantile_bounds", f"SELECT route, min(CASE WHEN 2 * upto >= m THEN bucket END) AS p50_bound, min(CASE WHEN 100 * upto >= 95 * m THEN bucket END) AS p95_bound FROM (SELECT route, bucket, sum(n) OVER (PARTITION BY route ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY route) AS m FROM (SELECT route, {BUCKET} AS bucket, count(*) AS n FROM {CALLS} c GROUP BY route, {BUCKET}) b) q GROUP BY route")
r("telemetry_status_classes", f"SELECT route, status_class, count(*) AS n, round(avg(latency_ms), 4) AS mean_ms FROM (SELECT route, latency_ms, CASE WHEN ok THEN 2 WHEN request_id % 2 = 0 THEN 4 ELSE 5 END AS status_class FROM {CALLS} c) s GROUP BY route, status_class")
r("health_checks", "SELECT user_id, CASE WHEN beat_age > 20 * 86400 THEN 'dead' WHEN progress_age > 20 * 86400 THEN 'stalled' WHEN memory > 60 THEN 'memory' WHEN beat_age > 5 * 86400 THEN 'slow' ELSE 'ok' END AS health FROM (SELECT user_id, 1706486400 - SECONDS(max(ts)) AS beat_age, 1706486400 - SECONDS(max(CASE WHEN event_type = 'purchase' THEN ts END)) AS progress_age, max(value) AS memory FROM {events} GROUP BY user_id) u")
r("window_stats", "SELECT user_id, event_id, n, deferred, audits, disagreements, n >= 10 AS armed FROM (SELECT user_id, event_id, count(*) OVER w AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS deferred, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS audits, sum(CASE WHEN event_type = 'purchase' AND value > 12 THEN 1 ELSE 0 END) OVER w AS disagreements, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) s WHERE back = 1")
r("change_feed", "SELECT user_id, seq, kind, event_id FROM (SELECT user_id, event_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id, kind) AS seq FROM (SELECT user_id, event_id, event_type AS kind FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM {events}) s WHERE prev IS NULL OR prev <> event_type UNION ALL SELECT user_id, max(event_id), 'z_done' FROM {events} GROUP BY user_id) e) f WHERE seq > :after", after=2)
r("throughput_rates", "SELECT user_id % 8 AS level, count(*) AS n, round(count(*) / 28.0, 6) AS per_day, round(sum(value) / 28.0, 4) AS tokens_per_day FROM {events} GROUP BY user_id % 8")
# ledgers
r("counterfactual_costs", f"SELECT served_by, count(*) AS n, sum(coalesce(teacher_nano, route_mean, all_mean)) AS counterfactual FROM (SELECT c.served_by, c.teacher_nano, m.mean AS route_mean, a.mean AS all_mean FROM {CALLS} c LEFT JOIN (SELECT route, CAST(floor(avg(teacher_nano)) AS BIGINT) AS mean FROM {CALLS} r WHERE ok GROUP BY route) m ON m.route = c.route CROSS JOIN (SELECT CAST(floor(avg(teacher_nano)) AS BIGINT) AS mean FROM {CALLS} t WHERE ok) a) x GROUP BY served_by")
r("spend_lines", "SELECT event_type AS kind, CASE WHEN event_type = 'purchase' THEN 'tokens' WHEN event_type = 'signup' THEN 'hours' ELSE 'calls' END AS basis, count(*) AS n, sum(CAST(round(value * CASE WHEN event_type = 'purchase' THEN 1000 WHEN event_type = 'signup' THEN 3600 ELSE 1 END) AS BIGINT)) AS units FROM {events} GROUP BY event_type")
r("finetune_split", "SELECT o_custkey AS run, sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS billed, sum(CASE WHEN l_returnflag = 'N' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS ceiling FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey GROUP BY o_custkey")
r("reservation_fold", "SELECT user_id, reserved - settled - released AS held, spent FROM (SELECT user_id, sum(CASE WHEN event_type = 'view' THEN nano ELSE 0 END) AS reserved, sum(CASE WHEN event_type = 'purchase' THEN nano ELSE 0 END) AS settled, sum(CASE WHEN event_type = 'error' THEN nano ELSE 0 END) AS released, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN nano ELSE 0 END) AS spent FROM (SELECT user_id, event_type, CAST(round(value * 1000) AS BIGINT) AS nano FROM {events}) e GROUP BY user_id) f")
r("teacher_stats", f"SELECT route, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms) AS p50_ms, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_ms, round(avg(latency_ms), 4) AS mean_ms, round(avg(cost_nano) * 1000, 2) AS nano_per_1k FROM (SELECT route, latency_ms, cost_nano, row_number() OVER (PARTITION BY route ORDER BY request_id DESC) AS back FROM {CALLS} c WHERE served_by = 'teacher') l WHERE back <= 100 GROUP BY route")
r("estimate_totals", "SELECT count(*) AS models, CASE WHEN count(price) = count(*) THEN sum(n * price) END AS total, sum(n * coalesce(price, 0)) AS known FROM (SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type) e LEFT JOIN (SELECT 'view' AS m, 3 AS price UNION ALL SELECT 'click', 5) p ON m = event_type")
r("audit_listing", "SELECT event_id, user_id, FIELD_K(props) AS k FROM {events} WHERE event_type = 'signup' AND props IS NOT NULL")
r("manifest_rows", "SELECT o_orderkey AS stage, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM {orders} WHERE o_orderstatus = 'F'")
r("experiment_rows", "SELECT event_id, concat(event_type, '-', CAST(user_id % 10 AS STRING)) AS name, FIELD_K(props) AS k FROM {events} WHERE (concat(event_type, '-', CAST(user_id % 10 AS STRING)) LIKE 'view-1%' OR concat(event_type, '-', CAST(user_id % 10 AS STRING)) LIKE 'error-%') AND FIELD_K(props) IS NOT NULL")
r("action_costs", "SELECT event_id, coalesce(CASE WHEN event_type = 'signup' THEN CAST(500 AS BIGINT) END, CAST(user_id % 3 + 1 AS BIGINT) * 120) AS cost FROM {events}")
r("burst_counts", "SELECT count(*) AS n, count(CASE WHEN event_type = 'error' AND value >= 10 THEN 1 END) AS served_wrong, count(CASE WHEN event_type = 'error' AND value < 10 THEN 1 END) AS deferred_wrong, count(CASE WHEN event_type <> 'error' AND value < 10 THEN 1 END) AS deferred_right FROM {events}")
r("spend_without_kinds", "SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, coalesce(sum(CASE WHEN event_type <> 'signup' THEN CAST(round(value * 1000) AS BIGINT) END), 0) AS spend, coalesce(sum(CAST(round(value * 1000) AS BIGINT)), 0) AS total FROM {events} GROUP BY CAST(CAST(ts AS DATE) AS STRING)")
r("usage_delta", "SELECT coalesce(a.event_type, b.event_type) AS purpose, coalesce(b.nano, 0) - coalesce(a.nano, 0) AS nano FROM (SELECT event_type, sum(CAST(round(value * 1000) AS BIGINT)) AS nano FROM {events} WHERE event_id % 2 = 0 GROUP BY event_type) a FULL JOIN (SELECT event_type, sum(CAST(round(value * 1000) AS BIGINT)) AS nano FROM {events} GROUP BY event_type) b ON b.event_type = a.event_type WHERE coalesce(b.nano, 0) <> coalesce(a.nano, 0)")
r("cap_checks", "SELECT run, spent, CASE WHEN spent > :run THEN 'run' WHEN project > :project THEN 'project' WHEN top_day > :daily THEN 'daily' ELSE 'ok' END AS cap, :run - spent AS remaining FROM (SELECT run, sum(nano) AS spent, sum(sum(nano)) OVER (PARTITION BY run % 7) AS project, max(nano) AS top_day FROM (SELECT user_id AS run, CAST(ts AS DATE) AS day, sum(CAST(round(value * 1000) AS BIGINT)) AS nano FROM {events} GROUP BY user_id, CAST(ts AS DATE)) d GROUP BY run) r", run=400_000, project=5_000_000, daily=60_000)
r("ledger_summary", "SELECT kind, run, n, nano FROM (SELECT 'kind' AS kind, event_type AS run, count(*) AS n, sum(CAST(round(value * 1000) AS BIGINT)) AS nano FROM {events} GROUP BY event_type UNION ALL SELECT 'run', CAST(user_id AS STRING), count(*), sum(CAST(round(value * 1000) AS BIGINT)) FROM {events} GROUP BY user_id UNION ALL SELECT 'total', 'all', count(*), sum(CAST(round(value * 1000) AS BIGINT)) FROM {events}) u")
r("ledger_differences", "SELECT user_id, event_type, sum(side) AS surplus FROM (SELECT user_id, event_type, 1 AS side FROM {events} WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, -1 FROM {events} WHERE event_id % 2 = 1) s GROUP BY user_id, event_type HAVING sum(side) <> 0")
r("duplicate_ledger_rows", "SELECT event_type, sum(n - 1) AS duplicates FROM (SELECT event_type, user_id, value, props, count(*) AS n FROM {events} GROUP BY event_type, user_id, value, props) g GROUP BY event_type")
r("evidence_status", "SELECT event_id, CASE WHEN FIELD_K(props) IS NULL THEN 'missing' WHEN FIELD_K(props) < 30 THEN 'failed' WHEN FIELD_K(props) < 60 THEN 'partial' ELSE 'passed' END AS status FROM {events}")
r("price_estimates", "SELECT l_returnflag AS model, sum(CAST(l_quantity AS BIGINT)) AS tokens, CASE WHEN price IS NOT NULL THEN sum(CAST(l_quantity AS BIGINT)) * price END AS cost, price IS NULL AS unknown_price FROM {lineitem} LEFT JOIN (SELECT 'A' AS m, 2 AS price UNION ALL SELECT 'N', 7) p ON m = l_returnflag GROUP BY l_returnflag, price")
r("planned_steps_known", "SELECT source, CASE WHEN count(n_chars) = count(*) THEN CAST(ceil(sum(n_chars) / 4.0) * 3 AS BIGINT) END AS tokens, CASE WHEN source IS NOT NULL THEN CAST(ceil(count(*) / 8.0) * 3 AS BIGINT) END AS steps FROM {documents} GROUP BY source")
r("blend_curve", "SELECT volume, student * volume + 1000000 AS fixed_and_student, teacher * volume AS teacher_only, student * volume + 1000000 < teacher * volume AS pays FROM (SELECT CAST(floor(avg(value)) AS BIGINT) AS student, CAST(floor(avg(value)) AS BIGINT) * 30 AS teacher FROM {events}) c CROSS JOIN (SELECT 100 AS volume UNION ALL SELECT 1000 UNION ALL SELECT 10000 UNION ALL SELECT 100000) v")
# nested
r("stage_tree", "SELECT user_id, event_id AS node, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS parent, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS depth FROM {events} WHERE event_type <> 'view'")
r("bounds_violations", "SELECT event_id, concat_ws(',', CASE WHEN value > 30 THEN 'value' END, CASE WHEN user_id % 10 > 7 THEN 'bucket' END, CASE WHEN FIELD_K(props) > 90 THEN 'k' END) AS violated FROM {events} WHERE value > 30 OR user_id % 10 > 7 OR FIELD_K(props) > 90")


def floor_index_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.createDataFrame([(x, ranks.floor_index(values, "value", x)) for x in (0.05, 0.5, 0.95)], "share double, value double")


def vectors_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut to 16 numbers and scaled to length 1; null and zero vectors are left out first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    some = rows.where(F.exists(F.slice("embedding", 1, 16), lambda x: x != 0))
    cut = some.withColumn("v", unit(F.col("embedding"), 16))
    return cut.select("vec_id", F.round(F.get("v", F.lit(0)).cast("double"), 4).alias("first"), F.round(F.get("v", F.lit(15)).cast("double"), 4).alias("last"))


def balanced_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("source IS NOT NULL").select(F.col("doc_id").cast("string").alias("task_id"), F.col("source").alias("family"))
    return evaluate.balanced_draws(rows, (64, 16), 7)


def prompt_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each training row (the messages of a conversation up to an answer) begins with the prompt that evaluation gives for its question: by
    conversation and answer, the messages before it in the table and in what is built anew from the questions and answers by turn."""
    turns = run_sql(spark, sf_dir, "SELECT conv_id, turn, role, text FROM {conversations}")
    messages = lambda rows: F.transform(F.array_sort(F.collect_list(rows)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    message = F.struct("turn", "role", F.col("text").alias("content"))
    train = turns.groupBy("conv_id").agg(messages(message).alias("train"))
    clean = F.struct("turn", "role", F.trim(F.regexp_replace("text", " +", " ")).alias("content"))
    prompts = turns.groupBy("conv_id").agg(messages(clean).alias("all"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"))
    evaluation = prompts.withColumn("evaluation", F.when(F.col("last").isNull(), F.col("all")).otherwise(F.slice("all", 1, F.greatest(F.size("all") - 1, F.lit(0)))))
    both = train.join(evaluation, "conv_id")
    return both.agg(F.count("*").alias("n"), F.count_if(evaluate.same_prompt(F.col("train"), F.col("evaluation"))).alias("same"))


def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", (F.col("user_id") % 10).cast("double").alias("user_bucket"), (F.col("event_type") != "error").cast("int").alias("correct"))
    scored = routing.out_of_fold(ranks.numbered(rows, "event_id"), ["value", "user_bucket"], "correct", "place")
    return scored.select("event_id", (F.col("place") % 5).alias("fold"), F.round("score", 6).alias("score"))


def gate_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often gates of several sizes would promote, at the rates that the labels show."""
    n, both, a, b = spark.read.parquet(f"{sf_dir}/labels.parquet").agg(F.count("*"), *[F.count_if((F.col("quality") == q) & (F.col("toxic") == t)) for q, t in ((1, 0), (1, 1), (0, 0))]).first()
    out, n = None, max(n, 1)
    for size in (50, 100, 300):
        part = evaluate.gate_power(spark, size, (both / n, b / n, a / n), sims=60).select(F.lit(size).alias("n_items"), "promoted", "sims")
        out = part if out is None else out.unionByName(part)
    return out


def seed_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.plans.stateful import burst_rows
    from lodestar.streaming.drift import Limits

    rows, odd = burst_rows(spark, sf_dir)
    return simulate.sweep({f"tau {n}/10": simulate.burst(rows, odd, Limits(tau_num=n), 60, 100, 100) for n in (5, 7, 9)})


#: Other SQL with the same rows, for tables of any size: as many of a template's answers are kept as the cap allows, so none of them is put in order.
AT_SCALE = {
    "toolcall_generation": "SELECT template, count(*) AS made, count(CASE WHEN calls = '[]' THEN 1 END) AS none, least(count(CASE WHEN calls <> '[]' THEN 1 END), :cap) AS kept FROM (" + R["toolcall_generation"][0].partition(" AS rn FROM (")[2].rpartition(") k")[0] + " GROUP BY template",
}


FRAMES = (floor_index_quantile, prompt_parity, vectors_unit, balanced_draws, out_of_fold_scores, gate_power, seed_sweep)
ORACLE = {
    "floor_index_quantile": "SELECT CAST(share AS DOUBLE) AS share, value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM {events} WHERE value IS NOT NULL) v JOIN (SELECT 0.05 AS share UNION ALL SELECT 0.5 UNION ALL SELECT 0.95) s ON place = least(n - 1, CAST(floor(share * n) AS BIGINT))",
    "prompt_parity": "SELECT count(*) AS n, count_if(ok) AS same FROM (SELECT conv_id, min(CASE WHEN (place = m AND answered) OR text = trim(regexp_replace(text, ' +', ' ', 'g')) THEN 1 ELSE 0 END) = 1 AS ok FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS m, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) = 1 AS answered FROM {conversations}) t GROUP BY conv_id) c",
    "vectors_unit": "SELECT vec_id, round(CAST(v[1] AS DOUBLE) / sqrt(DOT(v, v)), 4) AS first, round(CAST(v[16] AS DOUBLE) / sqrt(DOT(v, v)), 4) AS last FROM (SELECT vec_id, embedding[1:16] AS v FROM {embeddings}) s WHERE DOT(v, v) > 0",
    "balanced_draws": "SELECT task_id, family, CAST(CASE WHEN place <= 64 THEN 0 ELSE 1 END AS INT) AS draw FROM (SELECT task_id, family, row_number() OVER (ORDER BY turn, SHA(concat('7|', family))) AS place FROM (SELECT CAST(doc_id AS STRING) AS task_id, source AS family, row_number() OVER (PARTITION BY source ORDER BY SHA(concat('7|', source, '|', CAST(doc_id AS STRING))), CAST(doc_id AS STRING)) AS turn FROM {documents} WHERE source IS NOT NULL) t) p WHERE place <= 80",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, sql=AT_SCALE.get(name, sql), params=params: run_sql(spark, sf_dir, sql, params) for name, (sql, params) in R.items()} | {f.__name__: f for f in FRAMES}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql, params) for name, (sql, params) in R.items()} | {name: oracle(sql) for name, sql in ORACLE.items()}
