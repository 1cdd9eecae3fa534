"""Decisions that hang on those before them (admission, reservations), and the router's split with its whole priority order.

The oracles of the folds take one event after the other: by user where ledgers don't touch each other, else in one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.analytics import oracle, run_sql
from lodestar.plans.workloads import NORMAL
from lodestar.streaming import budget, slots

HOUR_US = 3_600_000_000
STREAMS = f"SELECT user_id AS key, event_id AS id, MICROS(ts) AS open_us, MICROS(ts) + CAST(floor(value) AS BIGINT) * {HOUR_US} AS close_us FROM {{events}}"
PER_KEY, TOTAL = 3, 100


def slot_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of a user that are refused, as the user has PER_KEY open. A refused one takes no slot."""
    found = slots.admit(run_sql(spark, sf_dir, STREAMS), PER_KEY, 1 << 62)
    return found.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.col("open_us").alias("us"), (~F.col("admitted")).alias("refused"))


def slot_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cap for all as well, which is asked first."""
    found = slots.admit(run_sql(spark, sf_dir, STREAMS), PER_KEY, TOTAL)
    return found.select(F.col("id").alias("event_id"), "admitted", "reason", "open_all", "open_key")


CAP = 60_000
#: A view reserves, for half an hour to two days or for good; what follows spends, settles or releases the user's last reservation.
LEDGER = f"""SELECT user_id AS key, event_id AS seq, MICROS(ts) AS at_us, CASE event_type WHEN 'view' THEN 'reserve' WHEN 'purchase' THEN 'settle' WHEN 'error' THEN 'release' ELSE 'spend' END AS action,
    concat('r', CAST(CASE WHEN event_type = 'view' THEN event_id ELSE max(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY MICROS(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS STRING)) AS id,
    CAST(round(value * 1000) AS BIGINT) AS nano, CASE event_id % 4 WHEN 0 THEN {HOUR_US // 2} WHEN 1 THEN {24 * HOUR_US} WHEN 2 THEN {48 * HOUR_US} END AS ttl_us FROM {{events}}"""


def reservation_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = run_sql(spark, sf_dir, LEDGER).withColumn("ttl_us", F.col("ttl_us").cast("long"))
    return budget.fold(events, CAP).where("seq IS NOT NULL").select(F.col("seq").alias("event_id"), "outcome", "spent", "held")


# The router's pool: candidates of three kinds; the sets whose questions they must not share, in order of priority; two splits of exact sizes.
#: (reason, its rows); the first that has a candidate's question is why it is dropped.
SETS = (
    ("train", "SELECT text FROM {conversations} WHERE role = 'user'"),
    ("dev", "SELECT text FROM {documents} WHERE doc_id % 10 = 8"),
    ("gate", "SELECT text FROM {documents} WHERE doc_id % 10 = 9"),
    ("stress", "SELECT text FROM {documents} WHERE doc_id % 10 = 7"),
    ("fit", "SELECT d.text FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id WHERE l.toxic = 1"),
    ("sealed", "SELECT text FROM {benchmark}"),
)
KINDS = ("templated", "natural", "reserved")
TARGETS = {"templated": 400, "natural": 150, "reserved": 60}
CAL, TEST = 3, 2
KIND = "CASE WHEN lang = 'en' THEN 'templated' WHEN lang = 'de' THEN 'natural' ELSE 'reserved' END"
CANDIDATES = f"SELECT doc_id, {KIND} AS kind, CASE {KIND} " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + f" END AS place, SHA({NORMAL}) AS h, substring(SHA(concat('task|', text)), 1, 5) AS task_id FROM {{documents}} WHERE doc_id % 10 < 7 AND text IS NOT NULL"
REFERENCES = " UNION ALL ".join(f"SELECT {i} AS priority, SHA({NORMAL}) AS h FROM ({sql}) s{i}" for i, (_, sql) in enumerate(SETS))
REASON = "CASE priority " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(SETS)) + " END"
SEEDED = "SHA(concat('11:', kind, ':', CAST(doc_id AS STRING)))"
WANTED = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in TARGETS.items()) + " END"
#: Positions of candidates: kinds in order, then ids.
POSITION = "place * CAST(1000000000000000 AS BIGINT) + doc_id"


def part_of(kept: str) -> str:
    """doc_id, kind, reason and part of rows (doc_id, kind, k: place in seeded order, m: rows of the kind)."""
    pool = f"least(m, {WANTED})"
    return f"SELECT doc_id, kind, CAST(NULL AS STRING) AS reason, CASE WHEN k > {pool} THEN 'spare' WHEN k <= CAST(floor({pool} * {CAL} / {CAL + TEST}.0 + 0.5) AS BIGINT) THEN 'cal' ELSE 'test' END AS part FROM ({kept}) n"


#: In one pass: the least priority by aggregation, the first of a question and of a task id by least positions, and places in seeded order
#: from counts by the first digits of the digest and places within them, so that no window holds a whole kind.
CASCADE = f"""WITH c AS ({CANDIDATES}), r AS (SELECT h, min(priority) AS priority FROM ({REFERENCES}) u GROUP BY h),
    firsts AS (SELECT h, min({POSITION}) AS first FROM c GROUP BY h),
    judged AS (SELECT c.*, CASE WHEN r.priority IS NOT NULL THEN {REASON} WHEN {POSITION} > f.first THEN 'pool_duplicate' END AS reason FROM c JOIN firsts f ON f.h = c.h LEFT JOIN r ON r.h = c.h),
    ids AS (SELECT task_id, min({POSITION}) AS first FROM judged WHERE reason IS NULL GROUP BY task_id),
    all_rows AS (SELECT j.doc_id, j.kind, {SEEDED.replace("kind", "j.kind").replace("doc_id", "j.doc_id")} AS seeded, coalesce(j.reason, CASE WHEN {POSITION} > i.first THEN 'task_id_collision' END) AS reason FROM judged j LEFT JOIN ids i ON i.task_id = j.task_id),
    kept AS (SELECT doc_id, kind, seeded, substring(seeded, 1, 3) AS block FROM all_rows WHERE reason IS NULL),
    blocks AS (SELECT kind, block, count(*) AS n FROM kept GROUP BY kind, block),
    offsets AS (SELECT kind, block, sum(n) OVER (PARTITION BY kind ORDER BY block) - n AS before, sum(n) OVER (PARTITION BY kind) AS m FROM blocks),
    placed AS (SELECT k.doc_id, k.kind, o.before + row_number() OVER (PARTITION BY k.kind, k.block ORDER BY k.seeded, k.doc_id) AS k, o.m FROM kept k JOIN offsets o ON o.kind = k.kind AND o.block = k.block)
    SELECT doc_id, kind, reason, 'dropped' AS part FROM all_rows WHERE reason IS NOT NULL UNION ALL {part_of("SELECT * FROM placed")}"""


def router_pool_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's part of the router's pool, cal, test or spare, or why it was dropped."""
    return run_sql(spark, sf_dir, CASCADE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (slot_refusals, slot_admissions, reservation_decisions, router_pool_split)}


OPEN = "CAST([] AS STRUCT(key BIGINT, until BIGINT)[])"
BY_USER = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY open_us, id) AS i FROM ({STREAMS}) x),
    g AS (SELECT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS us, CAST([] AS BIGINT[]) AS held, false AS refused FROM (SELECT DISTINCT key FROM s) k
        UNION ALL SELECT key, i, id, open_us, CASE WHEN len(live) < {PER_KEY} THEN list_append(live, close_us) ELSE live END, len(live) >= {PER_KEY}
        FROM (SELECT s.*, list_filter(g.held, lambda x: x > s.open_us) AS live FROM g JOIN s ON s.key = g.key AND s.i = g.i + 1) n)"""
ONE_ROW = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY open_us, id) AS i FROM ({STREAMS}) x),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS STRING) AS reason, {OPEN} AS held, CAST(0 AS BIGINT) AS mine
        UNION ALL SELECT i, id, reason, CASE WHEN reason IS NULL THEN list_append(live, struct_pack(key := key, until := close_us)) ELSE live END, CASE WHEN reason IS NULL THEN mine + 1 ELSE mine END
        FROM (SELECT *, CASE WHEN len(live) >= {TOTAL} THEN 'total' WHEN mine >= {PER_KEY} THEN 'key' END AS reason FROM (SELECT *, len(list_filter(live, lambda x: x.key = key)) AS mine
            FROM (SELECT s.*, list_filter(g.held, lambda x: x.until > s.open_us) AS live FROM g JOIN s ON s.i = g.i + 1) a) b) c)"""
HOLD = "STRUCT(id VARCHAR, nano BIGINT, ends BIGINT)"
RESERVED = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_us, seq) AS i FROM ({LEDGER}) x),
    g AS (SELECT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS STRING) AS outcome, CAST(0 AS BIGINT) AS spent, CAST([] AS {HOLD}[]) AS holds FROM (SELECT DISTINCT key FROM s) k
        UNION ALL SELECT key, i, seq, outcome, CASE WHEN outcome = 'spent' THEN spent + nano ELSE spent END,
            CASE WHEN outcome = 'held' THEN list_append(live, CAST(struct_pack(id := id, nano := nano, ends := at_us + ttl_us) AS {HOLD}))
                 WHEN outcome = 'released' OR (outcome = 'spent' AND (action = 'settle' OR mine <= nano)) THEN list_filter(live, lambda x: x.id <> id)
                 WHEN outcome = 'spent' THEN list_transform(live, lambda x: CASE WHEN x.id = id THEN CAST(struct_pack(id := x.id, nano := x.nano - nano, ends := x.ends) AS {HOLD}) ELSE x END) ELSE live END
        FROM (SELECT *, CASE WHEN action = 'release' THEN CASE WHEN mine IS NULL THEN 'gone' ELSE 'released' END WHEN nano IS NULL OR nano < 0 THEN 'invalid'
                  WHEN action = 'reserve' THEN CASE WHEN mine IS NOT NULL THEN 'duplicate' WHEN spent + held + nano > {CAP} THEN 'refused' ELSE 'held' END ELSE 'spent' END AS outcome
              FROM (SELECT *, coalesce(list_sum(list_transform(live, lambda x: x.nano)), 0) AS held, list_extract(list_transform(list_filter(live, lambda x: x.id = id), lambda x: x.nano), 1) AS mine
                    FROM (SELECT s.*, g.spent, list_filter(g.holds, lambda x: x.ends IS NULL OR x.ends > s.at_us) AS live FROM g JOIN s ON s.key = g.key AND s.i = g.i + 1) a) b) c)"""
ORACLE = {
    "slot_refusals": f"{BY_USER} SELECT key AS user_id, id AS event_id, us, refused FROM g WHERE i > 0",
    "slot_admissions": f"{ONE_ROW} SELECT id AS event_id, reason IS NULL AS admitted, reason, CAST(len(held) AS BIGINT) AS open_all, CAST(mine AS BIGINT) AS open_key FROM g WHERE i > 0",
    "reservation_decisions": f"{RESERVED} SELECT seq AS event_id, outcome, spent, CAST(coalesce(list_sum(list_transform(holds, lambda x: x.nano)), 0) AS BIGINT) AS held FROM g WHERE i > 0",
    # One candidate's reasons asked for one after the other, places by one window a kind.
    "router_pool_split": f"""WITH c AS ({CANDIDATES}), hit AS (SELECT c.*, """
    + "CASE " + " ".join(f"WHEN h IN (SELECT SHA({NORMAL}) FROM ({sql}) s) THEN '{name}'" for name, sql in SETS) + f""" END AS reason FROM c),
        dup AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY h ORDER BY place, doc_id) > 1 THEN 'pool_duplicate' ELSE reason END AS reason) FROM hit),
        col AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY task_id, reason IS NULL ORDER BY place, doc_id) > 1 THEN 'task_id_collision' ELSE reason END AS reason) FROM dup),
        placed AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {SEEDED}, doc_id) AS k, count(*) OVER (PARTITION BY kind) AS m FROM col WHERE reason IS NULL)
        SELECT doc_id, kind, reason, 'dropped' AS part FROM col WHERE reason IS NOT NULL UNION ALL {part_of("SELECT * FROM placed")}""",
}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in ORACLE.items()}
