"""Guarded runs of candidate SQL: a read-only database of named frames, one outcome for each text, never an exception."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date
from decimal import Decimal
from functools import cache

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.sqltext import bare, refused

MAX_ROWS, TIMEOUT_S = 10_000, 60.0
#: Nodes that a query's parsed plan may have. All else (commands, writes, table functions, scripts) is refused.
NODES = {
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedSubqueryColumnAliases",
    "UnresolvedRelation", "UnresolvedHaving", "UnresolvedWith", "WithWindowDefinition", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "LateralJoin", "Generate", "Pivot", "Unpivot", "UnresolvedOrderedSet",
}
#: Groups of the engine's own functions that a query may call: they work on their arguments alone. Those of other groups, and functions that aren't the engine's, are refused.
GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs",
    "operator_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs",
}
#: Of the rest, those that do too; and those of the groups that don't: they fail at will, or tell of the session.
MORE, FEWER = {"typeof", "equal_null"}, {"raise_error", "assert_true", "current_timezone", "now"}
#: What a Spark failure says that isn't the query's fault.
INFRASTRUCTURE = ("ExecutorLostFailure", "FetchFailed", "Connection refused", "SparkContext was shut down", "No space left", "OutOfMemoryError")


@dataclass(frozen=True)
class Outcome:
    """status: ok, or syntax, multi_statement, forbidden, runtime, timeout, row_cap; infra is no verdict on the query."""

    status: str
    columns: tuple[str, ...] = ()
    rows: tuple[tuple, ...] = ()
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.status == "ok"


def _each(seq: JavaObject) -> Iterator[JavaObject]:
    return (seq.apply(i) for i in range(seq.size()))


def _simple(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


@cache
def _functions(spark: SparkSession) -> frozenset[str]:
    """The names of functions that a query may call, of the engine's own catalogue."""
    own = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
    of_group = {name.funcName().lower() for name in _listed(own.listFunction()) if own.lookupFunction(name).get().getGroup() in GROUPS}
    return frozenset((of_group | MORE) - FEWER)


def _listed(seq: JavaObject) -> Iterator[JavaObject]:
    """A Scala sequence that may be a linked list, in one pass."""
    each = seq.iterator()
    while each.hasNext():
        yield each.next()


def _walk(plan: JavaObject, names: frozenset[str], functions: frozenset[str]) -> None:
    """Raise PermissionError for anything in a parsed plan but a query over the named relations, by the given functions."""
    kind = _simple(plan)
    if kind not in NODES:
        raise PermissionError(f"{kind} isn't allowed")
    if kind == "UnresolvedWith":
        for pair in _each(plan.cteRelations()):
            name = pair._1().lower()
            _walk(pair._2(), names | {name} if plan.allowRecursion() else names, functions)
            names |= {name}
    if kind == "UnresolvedRelation":
        parts = list(_each(plan.multipartIdentifier()))
        if len(parts) != 1 or parts[0].lower() not in names:
            raise PermissionError(f"no table {'.'.join(parts)}")
    for child in _each(plan.children()):
        _walk(child, names, functions)
    todo = list(_each(plan.expressions()))
    while todo:
        e = todo.pop()
        if _simple(e) == "UnresolvedFunction":
            called = list(_each(e.nameParts()))
            if len(called) != 1 or called[0].lower() not in functions:
                raise PermissionError(f"function {'.'.join(called)} isn't allowed")
        if _simple(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            _walk(e.plan(), names, functions)
        todo.extend(_each(e.children()))


class Database:
    """Frames under the names that queries read them by. Only one query at a time of the given tables is allowed: no other table, file or command.

    The frames become temporary views of their session, which should be one of its own (`spark.newSession()`).
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], max_rows: int = MAX_ROWS, timeout_s: float = TIMEOUT_S) -> None:
        self.spark, self.tables, self.max_rows, self.timeout_s = spark, dict(tables), max_rows, timeout_s
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def checked(self, sql: str) -> Outcome | None:
        """The outcome of a text that may not run, else None."""
        if why := refused(sql):
            return Outcome(why, error=why)
        try:
            _walk(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(bare(sql)), frozenset(n.lower() for n in self.tables), _functions(self.spark))
        except PermissionError as e:
            return Outcome("forbidden", error=str(e))
        except (PySparkException, Py4JJavaError, Py4JError) as e:
            return Outcome("syntax", error=str(e).split("\n", 1)[0])
        return None

    def frame(self, sql: str) -> DataFrame:
        """The frame of a text that may run."""
        if (no := self.checked(sql)) is not None:
            raise PermissionError(f"{no.status}: {no.error}")
        return self.spark.sql(bare(sql))

    def run(self, sql: str) -> Outcome:
        """At most max_rows rows; more is an error. A run over time is cancelled by its own tag."""
        if (no := self.checked(sql)) is not None:
            return no
        tag, late, done = f"query-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def watch() -> None:
            if not done.wait(self.timeout_s):
                late.set()
                while not done.wait(0.2):  # a job may start after its tag was first cancelled
                    context.cancelJobsWithTag(tag)

        context = self.spark.sparkContext
        context.addJobTag(tag)
        threading.Thread(target=watch, daemon=True).start()
        try:
            df = self.spark.sql(bare(sql))
            rows = df.limit(self.max_rows + 1).collect()
            if len(rows) > self.max_rows:
                return Outcome("row_cap", error=f"over {self.max_rows} rows")
            return Outcome("ok", tuple(df.columns), tuple(map(tuple, rows)))
        except ParseException as e:
            return Outcome("syntax", error=str(e).split("\n", 1)[0])
        except AnalysisException as e:
            return Outcome("runtime", error=str(e).split("\n", 1)[0])
        except (PySparkException, Py4JJavaError) as e:
            if late.is_set():
                return Outcome("timeout", error=f"over {self.timeout_s} s")
            text = str(e)
            return Outcome("infra" if any(x in text for x in INFRASTRUCTURE) else "runtime", error=text.split("\n", 1)[0])
        finally:
            done.set()
            context.removeJobTag(tag)

    def run_all(self, sqls: Sequence[str], at_once: int = 8, retries: int = 2) -> list[Outcome]:
        """One outcome for each text, in their order; equal texts run once. Runs that the cluster failed are tried again, alone at the last."""
        texts = list(dict.fromkeys(sqls))
        with ThreadPoolExecutor(at_once) as pool:
            done = dict(zip(texts, pool.map(self.run, texts), strict=True))
        for _ in range(retries):
            for sql in [s for s, o in done.items() if o.status == "infra"]:
                done[sql] = self.run(sql)
        return [done[s] for s in sqls]


#: How a cell that came as text is read back, by the type of its column; others (nested ones) are run alone.
READ = {
    T.BooleanType: lambda x: x == "true", T.ByteType: int, T.ShortType: int, T.IntegerType: int, T.LongType: int, T.FloatType: float, T.DoubleType: lambda x: float(x.replace("Infinity", "inf")), T.DecimalType: Decimal,
    T.StringType: str, T.DateType: date.fromisoformat, T.BinaryType: bytes.fromhex, T.NullType: str,
}


class Batches:
    """Runs of many texts in chunks: the queries of a chunk are one Spark job, whose rows come as texts and are read back by type.

    At most in_flight chunks run at once, whatever number of callers there are, in a scheduler pool of their own. A chunk that fails or is late is
    halved until the text that breaks it is alone, and that is run as any other. What the cluster failed is tried again after a pause that doubles.
    """

    def __init__(self, db: Database, chunk: int = 25, in_flight: int = 40, retries: int = 3, pause_s: float = 0.5, pool: str = "batches") -> None:
        self.db, self.chunk, self.retries, self.pause_s, self.pool = db, chunk, retries, pause_s, pool
        self.gate, self.workers = threading.BoundedSemaphore(in_flight), in_flight

    def run(self, sqls: Sequence[str]) -> list[Outcome]:
        """One outcome for each text, in their order; equal texts run once."""
        texts = list(dict.fromkeys(sqls))
        done = {s: no for s in texts if (no := self.db.checked(s)) is not None}
        ready = [s for s in texts if s not in done]
        chunks = [ready[i : i + self.chunk] for i in range(0, len(ready), self.chunk)]
        with ThreadPoolExecutor(max(1, min(self.workers, len(chunks)))) as pool:
            for found in pool.map(self._some, chunks):
                done |= found
        return [done[s] for s in sqls]

    def _some(self, sqls: list[str]) -> dict[str, Outcome]:
        if len(sqls) == 1:
            return {sqls[0]: self._alone(sqls[0])}
        try:
            return self._job(sqls)
        except (PySparkException, Py4JJavaError, ValueError):
            half = len(sqls) // 2
            return self._some(sqls[:half]) | self._some(sqls[half:])

    def _alone(self, sql: str) -> Outcome:
        for attempt in range(self.retries + 1):
            with self.gate:
                outcome = self.db.run(sql)
            if outcome.status != "infra" or attempt == self.retries:
                return outcome
            time.sleep(self.pause_s * 2**attempt)
        raise AssertionError

    def _job(self, sqls: list[str]) -> dict[str, Outcome]:
        """All texts as one job; an error of any is an error of the job."""
        spark, context = self.db.spark, self.db.spark.sparkContext
        frames = [spark.sql(bare(s)) for s in sqls]
        readers = [[READ.get(type(f.dataType)) for f in df.schema] for df in frames]
        if any(r is None for row in readers for r in row):
            raise ValueError("a type that isn't read back from text")
        whole = None
        for i, df in enumerate(frames):
            named = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
            cells = F.array(*[(F.hex(c) if isinstance(f.dataType, T.BinaryType) else F.col(c).cast("string")) for c, f in zip(named.columns, df.schema, strict=True)])
            part = named.limit(self.db.max_rows + 1).select(F.lit(i).alias("i"), cells.alias("cells"))
            whole = part if whole is None else whole.unionAll(part)
        tag, done = f"chunk-{uuid.uuid4().hex}", threading.Event()

        def watch() -> None:
            if not done.wait(self.db.timeout_s):
                while not done.wait(0.2):
                    context.cancelJobsWithTag(tag)

        with self.gate:
            context.setLocalProperty("spark.scheduler.pool", self.pool)
            context.addJobTag(tag)
            threading.Thread(target=watch, daemon=True).start()
            try:
                rows = whole.collect()
            finally:
                done.set()
                context.removeJobTag(tag)
                context.setLocalProperty("spark.scheduler.pool", None)
        held: list[list[tuple]] = [[] for _ in sqls]
        for i, cells in rows:
            held[i].append(tuple(None if x is None else read(x) for x, read in zip(cells, readers[i], strict=True)))
        too_many = Outcome("row_cap", error=f"over {self.db.max_rows} rows")
        return {s: too_many if len(held[i]) > self.db.max_rows else Outcome("ok", tuple(frames[i].columns), tuple(held[i])) for i, s in enumerate(sqls)}


def encoded(outcome: Outcome) -> str:
    """An outcome as JSON; bytes as hex, decimals and dates as texts that say so."""

    def cell(v: object) -> object:
        if isinstance(v, (bytes, bytearray)):
            return {"hex": bytes(v).hex()}
        if isinstance(v, Decimal):
            return {"decimal": str(v)}
        return v if v is None or isinstance(v, (bool, int, float, str)) else {"text": str(v)}

    return json.dumps({"status": outcome.status, "columns": outcome.columns, "rows": [[cell(v) for v in r] for r in outcome.rows], "error": outcome.error}, ensure_ascii=False, separators=(",", ":"))


def decoded(text: str) -> Outcome:
    """What encoded was given; dates come back as texts."""

    def cell(v: object) -> object:
        if not isinstance(v, dict):
            return v
        ((kind, x),) = v.items()
        return bytes.fromhex(x) if kind == "hex" else Decimal(x) if kind == "decimal" else x

    d = json.loads(text)
    return Outcome(d["status"], tuple(d["columns"]), tuple(tuple(cell(v) for v in r) for r in d["rows"]), d["error"])


def preview(outcome: Outcome, n: int = 5) -> dict:
    """The first n rows and how many there are."""
    return {"columns": list(outcome.columns), "rows": [list(r) for r in outcome.rows[:n]], "row_count": len(outcome.rows)}
