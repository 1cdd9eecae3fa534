"""Curation, evaluation, routing, monitoring and ledger workloads as SQL over the driver's tables.

Route events are `events` in order of event_id: an error was deferred to the teacher, a purchase was audited. Scores are event
values, scaled; correctness is the absence of an error. Money is nano-units, as longs, so that sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import ranks
from lodestar.operators import vector_index
from lodestar.plans.analytics import oracle, run_sql
from lodestar.storage import shared_dir, written

W: dict[str, tuple[str, dict]] = {}


def w(name: str, sql: str, **params: object) -> None:
    W[name] = (" ".join(sql.split()), params)


NORMAL = "lower(trim(replace(replace(text, chr(10), ' '), chr(9), ' ')))"
CALLS = "(SELECT event_id AS request_id, CAST(CAST(ts AS DATE) AS STRING) AS day, CASE WHEN event_type = 'error' THEN 'teacher' ELSE 'student' END AS served_by, event_type <> 'signup' AS ok, CAST(round(value * 1000) AS BIGINT) AS cost_nano, CASE WHEN event_id % 5 <> 0 THEN CAST(round(value * 3000) AS BIGINT) END AS teacher_nano, CAST(floor(value * 10) AS BIGINT) AS latency_ms, user_id % 8 AS route FROM {events})"
# Vectors are taken whole; functions.text.unit cuts them where that is wanted.
CORPUS = "(SELECT vec_id, label, slice_v AS v, sqrt(DOT(slice_v, slice_v)) AS norm FROM (SELECT vec_id, label, embedding AS slice_v FROM {embeddings}) s)"

# curation
w("dedupe_keep_first", f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM {{documents}} GROUP BY SHA({NORMAL})")
w("task_ids", "SELECT doc_id, concat('sql-', substring(SHA(concat(lang, '|', text)), 1, 12)) AS task_id FROM {documents}")
w("capped_by_family", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY SHA(concat('seed', CAST(doc_id AS STRING)))) AS rn FROM {documents}) r WHERE rn <= :cap", cap=20)
w("split_train_dev_gate", """SELECT doc_id, CASE WHEN in_family = 1 THEN 'train' WHEN place % 10 < 7 THEN 'train' WHEN place % 10 < 8 THEN 'dev' ELSE 'gate' END AS split
    FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY source ORDER BY h) AS in_family, row_number() OVER (PARTITION BY source ORDER BY h) AS place FROM (SELECT doc_id, source, SHA(concat('split', CAST(doc_id AS STRING))) AS h FROM {documents}) x) y""")
w("decontaminate_exact", f"SELECT doc_id FROM {{documents}} d WHERE NOT EXISTS (SELECT 1 FROM {{benchmark}} b WHERE {NORMAL.replace('text', 'b.text')} = {NORMAL.replace('text', 'd.text')})")
w("leakage_counts", f"WITH d AS (SELECT doc_id, SHA({NORMAL}) AS h, doc_id % 2 AS side FROM {{documents}}) SELECT count(*) AS n, count_if(h IN (SELECT h FROM d WHERE side = 0)) AS leaked FROM d WHERE side = 1")
w("fit_union_first_wins", "SELECT h, source_kind FROM (SELECT h, source_kind, row_number() OVER (PARTITION BY h ORDER BY priority, id) AS rn FROM (SELECT SHA(text) AS h, 'train' AS source_kind, 1 AS priority, doc_id AS id FROM {documents} UNION ALL SELECT SHA(text), 'bench', 2, item_id FROM {benchmark}) u) r WHERE rn = 1")
w("few_shot_round_robin", "SELECT doc_id, depth FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY SHA(CAST(doc_id AS STRING))) AS depth FROM {documents}) r WHERE depth <= 3")
w("yield_by_family", "SELECT d.source, count(*) AS generated, count(l.quality) AS verified, round(count(l.quality) / CAST(count(*) AS DOUBLE), 6) AS yield FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id AND l.quality = 1 GROUP BY d.source")
w("chat_last_assistant", "SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS rn FROM {conversations} WHERE role = 'assistant') r WHERE rn = 1")
# A seal of the content whatever the order of rows: the count and the sum of 60 bits of each row's digest.
w("seal_digest", "SELECT source, n, SHA(mark) AS seal FROM (SELECT source, count(*) AS n, concat(CAST(count(*) AS STRING), '|', CAST(sum(HEX15(substring(h, 1, 15))) AS STRING)) AS mark FROM (SELECT source, SHA(concat(CAST(doc_id AS STRING), '|', coalesce(text, ''))) AS h FROM {documents}) d GROUP BY source) m")
w("paraphrase_clean_counts", f"WITH p AS (SELECT conv_id, turn, {NORMAL} AS t FROM {{conversations}}), o AS (SELECT p.*, row_number() OVER (PARTITION BY conv_id, t ORDER BY turn) AS rn FROM p) SELECT count_if(t = '') AS empty, count_if(t <> '' AND rn > 1) AS duplicate, count_if(t <> '' AND rn = 1) AS kept FROM o")
w("overlap_counts", f"WITH b AS (SELECT DISTINCT SHA({NORMAL}) AS h FROM {{benchmark}}), d AS (SELECT SHA({NORMAL}) AS h FROM {{documents}}) SELECT count(*) AS n, count(b.h) AS shared FROM d LEFT JOIN b ON b.h = d.h")
w("router_split", """SELECT doc_id, CASE WHEN l.label IS NOT NULL THEN 'labelled' WHEN rn > 1 THEN 'duplicate' WHEN half % 2 = 0 THEN 'cal' ELSE 'test' END AS part
    FROM (SELECT doc_id, h, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn, row_number() OVER (PARTITION BY source ORDER BY SHA(CAST(doc_id AS STRING))) AS half FROM (SELECT doc_id, source, SHA(text) AS h FROM {documents}) x) d
    LEFT JOIN (SELECT doc_id AS label FROM {labels}) l ON l.label = d.doc_id""")
w("template_caps", "SELECT user_id, event_type, count(*) AS made, least(count(*), :cap) AS kept FROM {events} GROUP BY user_id, event_type", cap=5)
w("chat_training_rows", "SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM {conversations} q JOIN {conversations} a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
w("targeted_filter", f"SELECT doc_id FROM {{documents}} d WHERE NOT EXISTS (SELECT 1 FROM {{labels}} l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AND NOT EXISTS (SELECT 1 FROM {{benchmark}} b WHERE SHA(b.text) = SHA(d.text))")
# evaluation
w("accuracy_by_family", "SELECT d.lang, count(*) AS n, round(avg(l.quality), 6) AS accuracy FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY d.lang")
w("example_buckets", "SELECT bucket, doc_id FROM (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS rn FROM (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'fixed' WHEN quality = 0 AND toxic = 1 THEN 'regressed' WHEN quality = 0 THEN 'still_wrong' ELSE 'still_right' END AS bucket FROM {labels}) b) r WHERE rn <= 20 AND bucket <> 'still_right'")
w("paired_counts", "SELECT count_if(quality = 1 AND toxic = 1) AS both_right, count_if(quality = 1 AND toxic = 0) AS only_a, count_if(quality = 0 AND toxic = 1) AS only_b, count_if(quality = 0 AND toxic = 0) AS both_wrong FROM {labels}")
w("identical_output_rate", "SELECT round(count_if(a.event_type = b.event_type) / CAST(count(*) AS DOUBLE), 6) AS rate FROM {events} a JOIN {events} b ON b.event_id = a.event_id + 1")
w("wilson_interval", "SELECT n, k, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS k, avg(CAST(quality AS DOUBLE)) AS p, CAST(1.959963984540054 AS DOUBLE) AS z FROM {labels}) x")
w("failure_algebra", "SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'both' WHEN quality = 0 THEN 'only_a' ELSE 'only_b' END AS part FROM {labels} WHERE quality = 0 OR toxic = 0")
w("risk_coverage", "SELECT score, sum(n) OVER (ORDER BY score DESC) AS covered, sum(errors) OVER (ORDER BY score DESC) AS errors FROM (SELECT floor(value) AS score, count(*) AS n, count_if(event_type = 'error') AS errors FROM {events} GROUP BY floor(value)) s")
w("selective_evaluation", "SELECT count_if(value >= :t) AS served, count_if(value >= :t AND event_type = 'error') AS wrong, count_if(value < :t AND event_type = 'error') AS wrong_deferred, count(*) AS n FROM {events}", t=10.0)
w("nearest_rank_percentiles", "SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM {events} GROUP BY event_type")
w("parity_table", "SELECT count(*) AS n, count_if(a.quality = b.quality) AS agree, count_if(a.quality = 1 AND b.quality = 0) AS only_first, count_if(a.quality = 0 AND b.quality = 1) AS only_second FROM {labels} a JOIN {labels} b ON b.doc_id = a.doc_id + 1")
w("strongest_source", "SELECT source, accuracy FROM (SELECT d.source, round(avg(CAST(l.quality AS DOUBLE)), 6) AS accuracy FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY d.source) a ORDER BY accuracy DESC, source DESC LIMIT 1")
w("best_round", "SELECT user_id, day, n FROM (SELECT user_id, day, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, day) AS rn FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS n FROM {events} GROUP BY user_id, CAST(CAST(ts AS DATE) AS STRING)) c) r WHERE rn = 1")
w("weighted_loss", "SELECT lang, round(sum(CAST(n_chars AS DOUBLE) * quality) / sum(n_chars), 6) AS loss FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY lang")
# vectors and routing
w("nn_similarity", f"SELECT q.vec_id, round(max(DOT(q.v, c.v) / (q.norm * c.norm)), 5) AS nn_sim FROM {CORPUS} q JOIN {CORPUS} c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id")
w("feature_standardise", "SELECT event_type, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END, 6) AS std FROM {events} GROUP BY event_type")
w("route_decisions", "SELECT event_id, CASE WHEN score >= :l THEN 'student' ELSE 'teacher' END AS served_by, round(score, 6) AS score FROM (SELECT event_id, 1 / (1 + exp(-(0.5 + 0.02 * value - 0.1 * (user_id % 10)))) AS score FROM {events}) s", l=0.6)
w("precheck_bound", "SELECT event_id, greatest(1 / (1 + exp(-(0.02 * value))), 1 / (1 + exp(-(0.02 * value + 1)))) >= :l AS may_serve FROM {events}", l=0.75)
w("vector_normalise", f"SELECT vec_id, round(norm, 5) AS norm, round(DOT(v, v) / (norm * norm), 5) AS unit FROM {CORPUS} c WHERE norm > 0")
w("decision_reasons", "SELECT event_id, CASE WHEN 0.5 + a + b >= :t THEN 'served' WHEN a <= b THEN 'low_value' ELSE 'user_bucket' END AS reason FROM (SELECT event_id, 0.02 * (value - 10) AS a, 0.1 * (5 - user_id % 10) AS b FROM {events}) s", t=0.6)
w("blend_costs", "SELECT event_type, n, teacher, student, CASE WHEN teacher > student THEN CAST(ceil(1000000.0 / (teacher - student)) AS BIGINT) END AS break_even FROM (SELECT event_type, count(*) AS n, CAST(300 AS BIGINT) AS teacher, CAST(floor(avg(value)) AS BIGINT) + 20 AS student FROM {events} GROUP BY event_type) s")
# monitoring
w("deferral_windows", "SELECT user_id, event_id, defers, n FROM (SELECT user_id, event_id, sum(d) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS defers, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS d FROM {events}) e) s WHERE defers * 10 >= n * 4")
# The first 8 bytes of the digest as a share of 2^64, under 0.1; compared as hex.
w("audit_sample", "SELECT event_id FROM {events} WHERE substring(SHA(concat('drift-audit:', CAST(event_id AS STRING))), 1, 16) < :cut", cut="1999999999999999")
w("latest_per_stage", "SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) r WHERE rn = 1")
w("status_changes", "SELECT user_id, event_id, prev, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM {events}) s WHERE prev IS NULL OR prev <> event_type")
w("latency_histogram", f"SELECT bucket, sum(n) OVER (ORDER BY bucket) AS cumulative FROM (SELECT CASE WHEN latency_ms <= 50 THEN 50 WHEN latency_ms <= 100 THEN 100 WHEN latency_ms <= 250 THEN 250 WHEN latency_ms <= 500 THEN 500 ELSE 1000000 END AS bucket, count(*) AS n FROM {CALLS} c GROUP BY bucket) b")
w("telemetry_by_route", f"SELECT route, count(*) AS n, count_if(NOT ok) AS failed, round(avg(latency_ms), 4) AS mean_ms, percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95_ms FROM {CALLS} c GROUP BY route")
w("daily_cap", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS k FROM {events}) s WHERE k <= :cap", cap=1)
w("health_classes", "SELECT event_id, CASE WHEN value > 60 THEN 'dead' WHEN value > 30 THEN 'stalled' WHEN value > 10 THEN 'slow' ELSE 'ok' END AS health FROM {events}")
w("stage_snapshot_delta", "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT user_id, count(*) AS n FROM {events} WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id) a FULL JOIN (SELECT user_id, count(*) AS n FROM {events} WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id) b ON b.user_id = a.user_id WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)")
w("throughput_levels", "SELECT user_id % 8 AS level, count(*) AS n, count_if(event_type = 'error') AS errors, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM {events} GROUP BY user_id % 8")
w("stream_slots", "SELECT user_id, max(open) AS peak FROM (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY us, d ROWS UNBOUNDED PRECEDING) AS open FROM (SELECT user_id, MICROS(ts) AS us, 1 AS d FROM {events} UNION ALL SELECT user_id, MICROS(ts) + CAST(floor(value) AS BIGINT) * 3600000000, -1 FROM {events}) e) s GROUP BY user_id")
w("heartbeat_counters", "SELECT user_id, count(*) AS beats, count_if(event_type = 'view') AS views, MICROS(max(ts)) AS last_us FROM {events} GROUP BY user_id")
# ledgers
w("served_by_counts", f"SELECT day, served_by, count(*) AS n FROM {CALLS} c WHERE ok GROUP BY day, served_by")
w("gateway_totals", f"SELECT count(*) AS n, count_if(ok) AS ok, sum(cost_nano) AS cost, sum(CASE WHEN teacher_nano IS NOT NULL THEN cost_nano END) AS comparable, sum(teacher_nano) AS counterfactual, count_if(teacher_nano IS NULL) AS excluded FROM {CALLS} c")
w("savings_by_day", f"SELECT day, actual, counterfactual, CASE WHEN counterfactual > 0 THEN round(100.0 * (counterfactual - actual) / counterfactual, 4) END AS pct FROM (SELECT day, sum(CASE WHEN teacher_nano IS NOT NULL THEN cost_nano END) AS actual, sum(teacher_nano) AS counterfactual FROM {CALLS} c GROUP BY day) d")
w("spend_by_kind", "SELECT event_type AS kind, count(*) AS n, coalesce(sum(CAST(round(value * 1000) AS BIGINT)), 0) AS spend FROM {events} GROUP BY event_type")
w("cap_breaches", f"SELECT day, spent FROM (SELECT day, sum(cost) OVER (ORDER BY day) AS spent FROM (SELECT day, sum(cost_nano) AS cost FROM {CALLS} c GROUP BY day) d) r WHERE spent > :cap", cap=1_000_000)
w("reprice", "SELECT event_type AS model, count(*) AS calls, sum(FIELD_K(props)) AS tokens, max(price) AS price, CASE WHEN max(price) IS NULL THEN NULL ELSE sum(FIELD_K(props)) * max(price) END AS cost FROM {events} LEFT JOIN (SELECT 'view' AS m, 3 AS price UNION ALL SELECT 'click', 5 UNION ALL SELECT 'purchase', 11) p ON m = event_type GROUP BY event_type")
w("reprice_total", "SELECT CASE WHEN count_if(price IS NULL) > 0 THEN NULL ELSE sum(FIELD_K(props) * price) END AS total, count_if(price IS NULL) AS missing FROM {events} LEFT JOIN (SELECT 'view' AS m, 3 AS price UNION ALL SELECT 'click', 5) p ON m = event_type")
w("active_reservations", "SELECT user_id, count(*) AS n, sum(FIELD_K(props)) AS held FROM {events} WHERE event_type = 'purchase' AND (FIELD_K(props) < 10 OR ts + INTERVAL '2' HOUR > TIMESTAMP '2024-01-29 00:00:00') GROUP BY user_id")
w("idempotent_seed", "SELECT a.event_id FROM {events} a WHERE a.event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM {events} b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND b.event_id < a.event_id)")
w("ledger_delta", "SELECT user_id, event_type FROM {events} WHERE event_id % 2 = 0 EXCEPT SELECT user_id, event_type FROM {events} WHERE event_id % 2 = 1 AND value < 5")
w("duplicate_spend_rows", "SELECT event_type, count(*) - count(DISTINCT concat(CAST(user_id AS STRING), '|', CAST(floor(value) AS STRING))) AS duplicates FROM {events} GROUP BY event_type")
w("operations_by_hour", "SELECT substring(CAST(date_trunc('hour', ts) AS STRING), 1, 13) AS hour, count(*) AS n FROM {events} GROUP BY hour")
w("json_path_counts", "SELECT FIELD_K(props) AS k, count(*) AS n FROM {events} GROUP BY k")

w("cost_by_model", "SELECT l_returnflag AS model, count(*) AS calls, sum(CAST(l_quantity AS BIGINT)) AS tokens, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM {lineitem} GROUP BY l_returnflag")
w("late_cost_updates", f"SELECT request_id, sum(nano) AS nano FROM (SELECT request_id, cost_nano AS nano FROM {CALLS} c UNION ALL SELECT request_id, CAST(500 AS BIGINT) FROM {CALLS} c WHERE served_by = 'teacher') u GROUP BY request_id")
w("mean_output_tokens", "SELECT event_type AS purpose, count(*) AS n, round(avg(FIELD_K(props)), 4) AS mean_tokens, count_if(props IS NULL) AS excluded FROM {events} GROUP BY event_type")
w("planned_steps", "SELECT lang, count(*) AS n, CAST(ceil(count(*) / 8.0) * 3 AS BIGINT) AS steps, CAST(ceil(sum(n_chars) / 4.0) * 3 AS BIGINT) AS tokens FROM {documents} GROUP BY lang")
w("run_listing", "SELECT o_custkey AS run, count(*) AS n, max(CAST(CAST(o_orderdate AS DATE) AS STRING)) AS last_day, count(l.l_orderkey) AS reports FROM {orders} o LEFT JOIN (SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_returnflag = 'R') l ON l.l_orderkey = o.o_orderkey GROUP BY o_custkey")
w("audit_counts", "SELECT user_id % 10 AS actor, event_type AS action, count(*) AS n FROM {events} GROUP BY user_id % 10, event_type")


def placed(rows: str, group: str, digest: str, name: str) -> str:
    """rows with their place in a group by a hex digest, in two passes: rows are counted by the first digits of the digest, then numbered within them,
    so that no window holds a group. A group may be null."""
    block = f"substring({digest}, 1, 3)"
    counts = f"SELECT {group} AS g, {block} AS blk, count(*) AS n FROM ({rows}) q1 GROUP BY {group}, {block}"
    before = f"SELECT g, blk, sum(n) OVER (PARTITION BY g ORDER BY blk) - n AS before FROM ({counts}) q2"
    return f"(SELECT b.*, o.before + row_number() OVER (PARTITION BY b.{group}, {block} ORDER BY b.{digest}) AS {name} FROM ({rows}) b JOIN ({before}) o ON o.blk = {block} AND o.g IS NOT DISTINCT FROM b.{group})"


#: What Spark runs in place of the text above, which is the oracle's: the same rows without a window over a whole group.
AT_SCALE = {
    "split_train_dev_gate": f"""SELECT doc_id, CASE WHEN place = 1 OR place % 10 < 7 THEN 'train' WHEN place % 10 < 8 THEN 'dev' ELSE 'gate' END AS split
        FROM {placed("SELECT doc_id, source, SHA(concat('split', CAST(doc_id AS STRING))) AS h FROM {documents}", "source", "h", "place")} y""",
    "router_split": f"""SELECT d.doc_id, CASE WHEN l.label IS NOT NULL THEN 'labelled' WHEN d.doc_id > f.first THEN 'duplicate' WHEN half % 2 = 0 THEN 'cal' ELSE 'test' END AS part
        FROM {placed("SELECT doc_id, source, SHA(text) AS h, SHA(CAST(doc_id AS STRING)) AS seeded FROM {documents}", "source", "seeded", "half")} d
        JOIN (SELECT SHA(text) AS h, min(doc_id) AS first FROM {{documents}} GROUP BY SHA(text)) f ON f.h = d.h LEFT JOIN (SELECT doc_id AS label FROM {{labels}}) l ON l.label = d.doc_id""",
}


def with_percentiles(base: DataFrame, rows: DataFrame, group: str, column: str, shares: dict[str, float]) -> DataFrame:
    """base, a row for each group, with the nearest-rank percentiles of a column of rows."""
    found = ranks.percentiles(rows, group, column, list(shares.values())).toDF("_g", *shares)
    return base.join(found, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return with_percentiles(rows.select("event_type").distinct(), rows, "event_type", "value", {"p50": 0.5, "p95": 0.95})


def telemetry_by_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run_sql(spark, sf_dir, f"SELECT route, count(*) AS n, count_if(NOT ok) AS failed, round(avg(latency_ms), 4) AS mean_ms FROM {CALLS} c GROUP BY route")
    return with_percentiles(base, run_sql(spark, sf_dir, f"SELECT route, latency_ms FROM {CALLS} c"), "route", "latency_ms", {"p95_ms": 0.95})


def throughput_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = run_sql(spark, sf_dir, "SELECT user_id % 8 AS level, count(*) AS n, count_if(event_type = 'error') AS errors FROM {events} GROUP BY user_id % 8")
    return with_percentiles(base, run_sql(spark, sf_dir, "SELECT user_id % 8 AS level, value FROM {events}"), "level", "value", {"p50": 0.5, "p95": 0.95})


#: Vectors of a block; two blocks are held at once.
BLOCK = 1024


def _blocks(vectors: DataFrame, ids: str, unit: str) -> DataFrame:
    """(ids, unit): blocks of at most BLOCK vectors, scaled to length 1, as bytes. Null ids, null and zero vectors have no direction and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            at = np.array([i for i, _ in held], np.int64).tobytes()
            return pa.record_batch([pa.array([at], pa.binary()), pa.array([np.stack([v for _, v in held]).tobytes()], pa.binary())], names=[ids, unit])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.array(x.as_py() or [0], np.float64)
                if i is not None and (norm := np.sqrt(v @ v)) > 0:
                    held.append((i, v / norm))
                if len(held) == BLOCK:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, f"{ids} binary, {unit} binary")


def nn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest cosine of each query (every twentieth vec_id) to any row of another vec_id: blocks of queries against blocks of all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    # Written once: a task that pairs blocks would else run the readers of both sides beside its own, three Python workers in place of one.
    pairs = written(_blocks(vectors.where("vec_id % 20 = 0"), "q_ids", "q"), "queries").crossJoin(written(_blocks(vectors, "c_ids", "c"), "blocks"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x, b, y in zip(*batch.columns, strict=True):
                q_ids, c_ids = np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64)
                q, c = np.frombuffer(x.as_buffer()).reshape(len(q_ids), -1), np.frombuffer(y.as_buffer()).reshape(len(c_ids), -1)
                top = np.where(q_ids[:, None] == c_ids, -np.inf, q @ c.T).max(axis=1)
                some = top > -np.inf
                yield pa.record_batch([pa.array(q_ids[some]), pa.array(top[some])], names=["vec_id", "nn_sim"])

    return pairs.mapInArrow(best, "vec_id bigint, nn_sim double").groupBy("vec_id").agg(F.round(F.max("nn_sim"), 5).alias("nn_sim"))


def nn_index_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index, kept in the shared folder under the name of the vectors' content."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    centres = vector_index.centres_of(vectors)
    if not len(centres):
        return spark.createDataFrame([], "vec_id bigint, nn_sim double")
    index = vector_index.build(vectors, f"{shared_dir(spark)}/lodestar/index-{vector_index.key_of(vectors, centres)}", centres)
    found = vector_index.search(vectors.where("vec_id % 20 = 0"), index, centres)
    return found.where("nn_sim IS NOT NULL").select("vec_id", F.round("nn_sim", 5).alias("nn_sim"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = {name: lambda spark, sf_dir, sql=AT_SCALE.get(name, sql), params=params: run_sql(spark, sf_dir, sql, params) for name, (sql, params) in W.items()}
    return plain | {f.__name__: f for f in (nn_similarity, nn_index_similarity, nearest_rank_percentiles, telemetry_by_route, throughput_levels)}


def oracle_sql() -> dict[str, str]:
    found = {name: oracle(sql, params) for name, (sql, params) in W.items()}
    return found | {"nn_index_similarity": found["nn_similarity"]}
