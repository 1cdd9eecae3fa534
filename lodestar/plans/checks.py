"""Queries over the guard, verdicts, mutations, restored states and feeds, on rows of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as texts
from lodestar.operators import compare, sqltext, tree
from lodestar.operators.database import Database, Outcome
from lodestar.plans import generation
from lodestar.plans.analytics import oracle, run_sql
from lodestar.plans.workloads import placed
from lodestar.storage import written
from lodestar.streaming import drift, feed

# The guard, on statements that hold the text of documents as literals, comments and quoted names: whatever those say, only what stands around
# them counts.
LITERAL = "concat(chr(39), replace(coalesce(text, ''), chr(39), concat(chr(39), chr(39))), chr(39))"
COMMENT = "concat('/* ', replace(replace(coalesce(text, ''), '*', ' '), '/', ' '), ' */')"
NAME = "concat(chr(34), replace(coalesce(text, ''), chr(34), concat(chr(34), chr(34))), chr(34))"
STATEMENTS = {
    "plain": (f"concat('SELECT ', {LITERAL}, ' AS t')", "allowed"),
    "comment_first": (f"concat({COMMENT}, ' SELECT 1')", "allowed"),
    "quoted_name": (f"concat('SELECT a AS ', {NAME}, ' FROM b')", "allowed"),
    "end_mark": (f"concat('SELECT ', {LITERAL}, ' ;  ', {COMMENT})", "allowed"),
    "cte": (f"concat('WITH c AS (SELECT ', {LITERAL}, ' AS t) SELECT t FROM c')", "allowed"),
    "two": (f"concat('SELECT ', {LITERAL}, '; SELECT 2')", "multi_statement"),
    "drop_after": (f"concat('SELECT ', {LITERAL}, '; DROP TABLE b')", "multi_statement"),
    "insert": (f"concat('INSERT INTO b VALUES (', {LITERAL}, ')')", "forbidden"),
    "cte_insert": (f"concat('WITH c AS (SELECT ', {LITERAL}, ' AS t) INSERT INTO b SELECT t FROM c')", "forbidden"),
    "only_comment": (COMMENT, "syntax"),
}
ASKED = " UNION ALL ".join(f"SELECT '{name}' AS form, doc_id, {sql} AS sql FROM {{documents}}" for name, (sql, _) in STATEMENTS.items())


def guard_status_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guard says of each form of statement, by how many documents."""

    @F.pandas_udf("string")
    def status(sqls: pd.Series) -> pd.Series:
        return sqls.map(lambda s: sqltext.refused(s) or "allowed")

    return run_sql(spark, sf_dir, ASKED).withColumn("status", status("sql")).groupBy("form", "status").agg(F.count("*").alias("n"))


# Mutations as a table function.
class Variants:
    """One row for each changed form of a query."""

    def eval(self, sql: str, seed: int) -> Iterator[tuple[str, str]]:
        if sql is None:
            return
        for kind, changed in (sqltext.mutations(sql, seed or 0) | sqltext.literal_mutations(sql, seed or 0)).items():
            if changed != sql:
                yield kind, changed


def variants(queries: DataFrame, seed: int = 0) -> DataFrame:
    """queries(sql, ...) with kind and mutated, a row for each variant, by a lateral join with the table function."""
    made = F.udtf(Variants, returnType="kind string, mutated string")
    return queries.lateralJoin(made(F.col("sql").outer(), F.lit(seed)))


#: The tables that the drawn queries read.
READ_BY = ("customer", "nation", "orders", "lineitem", "part", "events")


def own_session(spark: SparkSession) -> SparkSession:
    """A session for views of its own, set as the given one is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def mutation_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of change, how many gold texts it changes, how many of these the guard lets through, how many changed texts there are, how many changes keep the masked text, how many run over
    the tables, as their gold text does, and how many of these the verdict rejects: those that serve as wrong answers.

    A gold text that is drawn to fail has no changes that run.
    """

    @F.pandas_udf("boolean")
    def allowed(sqls: pd.Series) -> pd.Series:
        return sqls.map(lambda s: sqltext.refused(s) is None)

    gold = generation.draws(spark, sf_dir).groupBy("sql").agg(F.bool_and("ok").alias("ok"))
    same = texts.masked_sql(F.col("mutated")) == texts.masked_sql(F.col("sql"))
    made = written(variants(gold).withColumns({"allowed": allowed("mutated"), "masked": same}), "variants")
    asked = [tuple(r) for r in made.where("ok AND allowed").select("sql", "kind", "mutated").distinct().collect()]  # as many as there are draws of a template, whatever the tables' size
    own = own_session(spark)
    db = Database(own, {name: own.read.parquet(f"{sf_dir}/{name}.parquet") for name in READ_BY})
    results = [(sql, kind, *told) for (sql, kind, _), told in zip(asked, compare.rejected(db, asked), strict=True)]
    made = made.join(F.broadcast(spark.createDataFrame(results, "sql string, kind string, runs boolean, rejected boolean")), ["sql", "kind"], "left")
    counts = {"n_masked": "masked", "n_run": "runs", "n_rejected": "rejected"}
    return made.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("allowed").alias("n_allowed"), F.countDistinct("mutated").alias("n_distinct"), *[F.count_if(c).alias(name) for name, c in counts.items()])


# Verdicts over results that are rows of the tables: each user's events as a result set, and changed ones.
RESULTS = "SELECT user_id, event_type, count(*) AS n, CAST(floor(sum(value)) AS BIGINT) AS total, CASE WHEN count(*) > 3 THEN 'many' END AS size FROM {events} GROUP BY user_id, event_type"
KINDS = ("extra_row", "missing_row", "extra_column", "null_to_empty", "dropped_column", "swapped_columns", "reversed_order")


def _outcomes(rows: DataFrame, judge: Callable[[Outcome], list[tuple]], schema: str) -> DataFrame:
    """judge(result set of a user) gives rows; a user has one row for each type of event."""
    names = ("event_type", "n", "total", "size")
    whole = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for user, cells in batch.itertuples(index=False):
                got = tuple(tuple(None if isinstance(v := c[n], float) and v != v else v for n in names) for c in cells)
                out += [(user, *r) for r in judge(Outcome("ok", names, got))]
            yield pd.DataFrame(out, columns=columns)

    return whole.select("user_id", "rows").mapInPandas(run, schema)


def verifier_self_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gold result against itself, and against each corrupted form of it that differs: n, and how many the verdict accepts."""

    def judge(gold: Outcome) -> list[tuple]:
        out = [("gold", compare.verdict(gold, gold, ordered=True)[0])]
        for kind, wrong in compare.corrupted(gold, ordered=True).items():
            if (wrong.columns, compare.cells(wrong.rows)) != (gold.columns, compare.cells(gold.rows)):
                out.append((kind, compare.verdict(wrong, gold, ordered=True)[0]))
        return out

    found = _outcomes(run_sql(spark, sf_dir, RESULTS), judge, "user_id bigint, kind string, accepted boolean")
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"))


def miss_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which relaxation would make a changed result match, by how it was changed."""

    def judge(gold: Outcome) -> list[tuple]:
        rows, names = gold.rows, gold.columns
        changed = {
            "reversed": Outcome("ok", names, rows[::-1]),
            "columns_turned": Outcome("ok", (*names[1:], names[0]), tuple((*r[1:], r[0]) for r in rows)),
            "column_added": Outcome("ok", ("k", *names), tuple((-1 - i, *r) for i, r in enumerate(rows))),
            "cents_off": Outcome("ok", names, tuple((t, n, total + 0.004, s) for t, n, total, s in rows)),
            "nulls_filled": Outcome("ok", names, tuple((t, n, total, "" if s is None else s) for t, n, total, s in rows)),
            "rows_doubled": Outcome("ok", names, rows + rows),
            "totals_wrong": Outcome("ok", names, tuple((t, n, total + 1000, s) for t, n, total, s in rows)),
        }
        return [(how, compare.classify_miss(wrong, gold)) for how, wrong in changed.items()]

    found = _outcomes(run_sql(spark, sf_dir, RESULTS), judge, "user_id bigint, changed string, miss string")
    return found.groupBy("changed", "miss").agg(F.count("*").alias("n"))


# States restored from a log of each user's events.
LOG = """SELECT user_id AS stream, event_id AS seq, CASE event_type WHEN 'error' THEN 'rollback' WHEN 'signup' THEN 'recertify' ELSE 'teacher_only' END AS kind,
    CASE event_type WHEN 'error' THEN 'rollback' WHEN 'signup' THEN 'certified' ELSE 'teacher' END AS state_to, CASE WHEN event_type = 'error' THEN CASE WHEN value < 10 THEN 'deferral' ELSE 'audit' END END AS detector,
    CASE WHEN event_type IN ('error', 'signup') THEN concat('c', CAST(event_id % 7 AS STRING)) END AS cert FROM {events}"""


def restore_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = drift.restore(run_sql(spark, sf_dir, LOG))
    return state.select("stream", "state", "cert", F.array_join("revoked", ",").alias("revoked"), "detector")


# Events from snapshots: each event of a user is a snapshot of a run, whose stages are the types seen.
SNAPSHOTS = """SELECT user_id AS key, event_id AS seq, event_type AS stage, CASE WHEN value < 5 THEN 'running' WHEN value < 25 THEN 'done' ELSE 'failed' END AS stage_status, CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS paid,
    CASE WHEN event_type = 'error' AND value > 40 THEN 'failed' ELSE 'running' END AS status FROM {events}"""
COUNTED = f"SELECT key, seq, stage, stage_status, status, sum(paid) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS calls FROM ({SNAPSHOTS}) s"


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, COUNTED)
    stage = F.array(F.struct(F.col("stage").alias("name"), F.col("stage_status").alias("status")))
    shots = rows.select("key", "seq", stage.alias("stages"), (F.col("calls") * 30).alias("spend"), "calls", F.lit(None).cast("array<string>").alias("logs"), "status")
    return feed.fold(shots).select(F.col("key").alias("run"), "id", "seq", "kind", "name", "value")


# The whole pool in exact shares: the first document of each family trains, the others follow in seeded order.
HASHED = "SELECT doc_id, source, SHA(CAST(doc_id AS STRING)) AS h, 1 AS one, SHA(lower(coalesce(text, ''))) AS q FROM {documents}"
OTHERS = f"SELECT d.* FROM ({HASHED}) d LEFT JOIN (SELECT min(h) AS h FROM ({HASHED}) e GROUP BY source) f ON f.h = d.h WHERE f.h IS NULL"
FIRSTS = f"SELECT d.*, row_number() OVER (ORDER BY d.h, d.doc_id) AS place FROM ({HASHED}) d JOIN (SELECT min(h) AS h FROM ({HASHED}) e GROUP BY source) f ON f.h = d.h"
SHARES = "CASE WHEN place <= CAST(floor(m * 0.7) AS BIGINT) THEN 'train' WHEN place <= CAST(floor(m * 0.85) AS BIGINT) THEN 'dev' ELSE 'gate' END"
POOL = f"""WITH p AS (SELECT doc_id, q, place FROM ({FIRSTS}) a UNION ALL SELECT doc_id, q, place + (SELECT count(*) FROM ({FIRSTS}) c) FROM {placed(OTHERS, 'one', 'h', 'place')} b),
    s AS (SELECT doc_id, q, {SHARES} AS split FROM p CROSS JOIN (SELECT count(*) AS m FROM p) n),
    train AS (SELECT DISTINCT q FROM s WHERE split = 'train')
    SELECT s.split, count(*) AS n, count(t.q) AS in_train FROM s LEFT JOIN train t ON t.q = s.q AND s.split <> 'train' GROUP BY s.split"""


def pool_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each split of all documents, and how many share their question with train."""
    return run_sql(spark, sf_dir, POOL)


# The accounts that belong to others, as trees with the balances below each.
NODES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 AND c_custkey > 0 THEN CAST(floor(c_custkey / 9.0) AS BIGINT) END AS parent, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM {customer}"


def account_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = written(tree.placed(run_sql(spark, sf_dir, NODES)), "nodes")
    return nodes.select("id", "parent", "root", "depth").join(tree.subtree_totals(nodes, F.col("cents")), "id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (guard_status_matrix, mutation_catalogue, verifier_self_test, miss_classification, restore_states, run_events, pool_split, account_tree)}


EXPECTED = "CASE form " + " ".join(f"WHEN '{name}' THEN '{status}'" for name, (_, status) in STATEMENTS.items()) + " END"
PER_USER = f"SELECT user_id, count(*) AS k, count(size) AS sized, count(DISTINCT floor(n * 1000000) + total) AS apart FROM ({RESULTS}) r GROUP BY user_id"
ORACLE = {
    "guard_status_matrix": f"SELECT form, {EXPECTED} AS status, count(*) AS n FROM ({ASKED}) a GROUP BY form",
    # A result with one row has no other order; one without nulls has none to fill.
    "verifier_self_test": f"""SELECT kind, count(*) AS n, count(CASE WHEN kind = 'gold' THEN 1 END) AS accepted FROM ({PER_USER}) u CROSS JOIN (SELECT unnest({['gold', *KINDS]}) AS kind) s
        WHERE NOT (kind = 'reversed_order' AND k = 1) AND NOT (kind = 'null_to_empty' AND sized = k) GROUP BY kind""",
    "miss_classification": f"""SELECT changed, CASE changed WHEN 'reversed' THEN 'order_not_required' WHEN 'columns_turned' THEN 'column_order' WHEN 'column_added' THEN 'extra_columns' WHEN 'cents_off' THEN 'rounded_to_2'
            WHEN 'nulls_filled' THEN CASE WHEN sized = k THEN 'order_not_required' ELSE 'null_or_empty' END WHEN 'rows_doubled' THEN 'duplicates' ELSE 'wrong_result' END AS miss, count(*) AS n
        FROM ({PER_USER}) u CROSS JOIN (SELECT unnest(['reversed', 'columns_turned', 'column_added', 'cents_off', 'nulls_filled', 'rows_doubled', 'totals_wrong']) AS changed) s GROUP BY ALL""",
    "restore_states": f"""WITH l AS ({LOG}) SELECT stream, CASE WHEN last = 'rollback' THEN 'teacher' ELSE last END AS state, cert, revoked, CASE WHEN last <> 'certified' THEN tripped END AS detector
        FROM (SELECT stream, arg_max(state_to, seq) AS last, arg_max(cert, seq) FILTER (WHERE kind = 'recertify') AS cert, coalesce(array_to_string(list_sort(list(DISTINCT cert) FILTER (WHERE kind = 'rollback')), ','), '') AS revoked,
              arg_max(detector, seq) FILTER (WHERE kind = 'rollback') AS tripped FROM l GROUP BY stream) f""",
    "run_events": f"""WITH c AS ({COUNTED}), o AS (SELECT *, lag(stage_status) OVER (PARTITION BY key, stage ORDER BY seq) AS was, lag(calls) OVER (PARTITION BY key ORDER BY seq) AS had,
            count(CASE WHEN status = 'failed' THEN 1 END) OVER (PARTITION BY key ORDER BY seq) AS ends FROM c),
        e AS (SELECT key, seq, 1 AS turn, 'stage' AS kind, stage AS name, stage_status AS value FROM o WHERE was IS NULL OR was <> stage_status
            UNION ALL SELECT key, seq, 2, 'spend', CAST(calls AS STRING), CAST(calls * 30 AS STRING) FROM o WHERE had IS NULL OR had <> calls
            UNION ALL SELECT key, seq, 3, 'done', NULL, 'failed' FROM o WHERE status = 'failed' AND ends = 1)
        SELECT key AS run, row_number() OVER (PARTITION BY key ORDER BY seq, turn) AS id, seq, kind, name, value FROM e""",
    "account_tree": f"""WITH RECURSIVE n AS MATERIALIZED ({NODES}), up AS (SELECT id, id AS root, parent AS next, CAST(0 AS BIGINT) AS depth FROM n
            UNION ALL SELECT up.id, n.id, n.parent, up.depth + 1 FROM up JOIN n ON n.id = up.next)
        SELECT n.id, n.parent, t.root, t.depth, b.n, b.total
        FROM n JOIN (SELECT id, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY id) t ON t.id = n.id
        JOIN (SELECT u.root AS id, count(*) AS n, CAST(sum(c.cents) AS BIGINT) AS total FROM up u JOIN n c ON c.id = u.id GROUP BY u.root) b ON b.id = n.id""",
    "pool_split": f"""WITH p AS (SELECT doc_id, q, row_number() OVER (ORDER BY first, h, doc_id) AS place FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY h) = 1 THEN 0 ELSE 1 END AS first FROM ({HASHED}) x) y),
        s AS (SELECT doc_id, q, {SHARES} AS split FROM p CROSS JOIN (SELECT count(*) AS m FROM p) n)
        SELECT split, count(*) AS n, count(CASE WHEN split <> 'train' AND q IN (SELECT q FROM s WHERE split = 'train') THEN 1 END) AS in_train FROM s GROUP BY split""",
}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in ORACLE.items()}
