"""Readers and writers of the engine's files. All go through Spark, so that any store which Spark reads will do."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import normal_question

MAX_QUESTION = 500


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a text file read whole, as line numbers are of the file; for files of questions, which people write."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line", "text"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, question, n): distinct questions in order of first occurrence. Blank lines and those that start with # go.

    A question of over 500 characters is an error. n: how often it occurs.
    """
    lines = numbered_lines(spark, path).select("line", normal_question(F.col("text")).alias("question")).where("question <> '' AND NOT startswith(question, '#')")
    checked = lines.withColumn("question", F.when(F.length("question") <= MAX_QUESTION, F.col("question")).otherwise(F.raise_error(F.concat(F.lit("question too long at line "), F.col("line") + 1)).cast("string")))
    once = checked.groupBy("question").agg(F.min("line").alias("line"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy("line")) - 1  # of a file that people wrote
    return once.select(F.concat(F.lit("h-"), place, F.lit("-"), F.substring(F.sha2("question", 256), 1, 8)).alias("task_id"), "question", "n")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def signal_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON list, of an object with `rows` or `items`, or of JSON lines. A file without rows is an error."""
    if path.endswith(".jsonl"):
        rows = json_lines(spark, path, schema)
    else:
        text = spark.read.text(path, wholetext=True)
        listed = F.from_json("value", f"array<struct<{as_fields(schema)}>>", {"mode": "FAILFAST"})
        held = F.from_json("value", f"rows array<struct<{as_fields(schema)}>>, items array<struct<{as_fields(schema)}>>", {"mode": "FAILFAST"})
        rows = text.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(held["rows"], held["items"]))).alias("r")).select("r.*")
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows


def as_fields(schema: str) -> str:
    """A flat DDL schema, as the fields of a struct."""
    return ", ".join(":".join(c.strip().split(None, 1)) for c in schema.split(","))


def last_decisions(log: DataFrame) -> DataFrame:
    """(task_id, decision, sql) by task: the decision of the highest seq, of an append-only log (seq, task_id, decision, sql)."""
    return log.groupBy("task_id").agg(F.max_by(F.struct("decision", "sql"), "seq").alias("d")).select("task_id", "d.*")


def tally(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """One row: confirmed, rejected, skipped and undecided tasks."""
    joined = tasks.select("task_id").join(last_decisions(log), "task_id", "left")
    return joined.agg(*[F.count_if(F.col("decision") == d).alias(d) for d in ("confirmed", "rejected", "skipped")], F.count_if(F.col("decision").isNull()).alias("undecided"))


PRICE = "map<string, struct<input:double, output:double, input_per_mtok:double, output_per_mtok:double, source:string, date:string>>"


def prices(spark: SparkSession, path: str) -> DataFrame:
    """(model, input_per_mtok, output_per_mtok) of one JSON object {"models": {name: {"input", "output"}}}, or of one with a model for each name."""
    return priced(spark, path).select("model", "input_per_mtok", "output_per_mtok")


def priced(spark: SparkSession, path: str) -> DataFrame:
    """The same with where each price is from: (model, input_per_mtok, output_per_mtok, source, date). Entries without prices, such as notes, are left out."""
    text = spark.read.text(path, wholetext=True)
    held = F.from_json("value", f"models {PRICE}", {"mode": "FAILFAST"})["models"]
    entries = F.when(F.get_json_object("value", "$.models").isNotNull(), held).otherwise(F.from_json(only_objects(F.col("value")), PRICE, {"mode": "FAILFAST"}))
    each = text.select(F.explode(entries).alias("model", "p"))
    out = each.select("model", F.coalesce("p.input", "p.input_per_mtok").alias("input_per_mtok"), F.coalesce("p.output", "p.output_per_mtok").alias("output_per_mtok"), "p.source", "p.date")
    return out.where("input_per_mtok IS NOT NULL OR output_per_mtok IS NOT NULL")


def only_objects(text: Column) -> Column:
    """A JSON object without the fields that aren't objects themselves."""
    fields = F.from_json(text, "map<string,string>")
    entries = F.filter(F.map_entries(fields), lambda e: F.ltrim(e["value"]).startswith("{"))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), ","), F.lit("}"))


def with_prices(usage: DataFrame, prices: DataFrame, strict: bool = True) -> DataFrame:
    """usage(model, input_tokens, output_tokens, ...) with usd; a model without a price is an error, or has no usd where strict is off."""
    named = usage.join(prices.select("model", "input_per_mtok", "output_per_mtok"), "model", "left")
    usd = (F.col("input_tokens") * F.col("input_per_mtok") + F.col("output_tokens") * F.col("output_per_mtok")) / 1e6
    if strict:
        usd = F.when(F.col("input_per_mtok").isNull(), F.raise_error(F.concat(F.lit("no price for "), F.coalesce("model", F.lit("null")))).cast("double")).otherwise(usd)
    return named.withColumn("usd", usd).drop("input_per_mtok", "output_per_mtok")


def ledger_seed(spark: SparkSession, path: str) -> DataFrame:
    """(kind, run_id, usd, note, expires_at, source_root, evidence, id, holder) of {"spend": [...], "reservations": [...]}; kind is spend or reservation."""
    row = "array<struct<run_id:string, usd:double, note:string, expires_at:string, source_root:string, evidence:string, id:string, holder:string>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"spend {row}, reservations {row}", {"mode": "FAILFAST"}).alias("s"))
    part = lambda field, kind: text.select(F.explode(f"s.{field}").alias("r")).select(F.lit(kind).alias("kind"), "r.*")
    return part("spend", "spend").unionByName(part("reservations", "reservation"))


def add_missing(ledger: DataFrame, seed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows skipped as their key is there): seeding twice changes nothing."""
    known = ledger.select(*key).distinct()
    return seed.join(known, key, "left_anti").dropDuplicates(key), seed.join(known, key, "left_semi")


def write_once(df: DataFrame, path: str) -> None:
    """A sink that is never overwritten: a second write is an error."""
    df.write.mode("errorifexists").parquet(path)


def digest(df: DataFrame) -> str:
    """A digest of the rows whatever their order: the count and the sum of 128-bit row digests, hashed. Nothing is gathered."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    n, a, b = df.agg(F.count("*"), half(1), half(16)).first()
    return df.sparkSession.range(1).select(F.sha2(F.lit(f"{','.join(sorted(df.columns))}|{n}|{a}|{b}"), 256)).first()[0]


def write_addressed(df: DataFrame, folder: str) -> str:
    """Write df under its digest, unless it is there; returns the path."""
    path = f"{folder.rstrip('/')}/{digest(df)}"
    df.write.mode("ignore").parquet(path)
    return path


def read_addressed(spark: SparkSession, path: str) -> DataFrame:
    """Read what write_addressed wrote; rows that differ from the name are an error."""
    df = spark.read.parquet(path)
    if digest(df) != path.rstrip("/").rsplit("/", 1)[1]:
        raise ValueError(f"{path} isn't what its name says")
    return df


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def stage_key(stage: str, inputs: dict, upstream: list[str]) -> str:
    """The name of a stage's output: a digest of the stage, its inputs and the digests of what it builds on."""
    return hashlib.sha256(canonical({"inputs": inputs, "stage": stage, "upstream": upstream}).encode()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at path, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def memoised(spark: SparkSession, folder: str, stage: str, inputs: dict, upstream: list[str], build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(output, whether it was there already): a stage is built once for each key. A build that didn't end leaves no _SUCCESS and is built again."""
    path = f"{folder.rstrip('/')}/{stage_key(stage, inputs, upstream)}"
    if there := exists(spark, path):
        return spark.read.parquet(path), there
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), there


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log; each is stamped with the time of the job, so that logs of one table are told apart."""
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def references(spark: SparkSession, path: str) -> DataFrame:
    """(question, sql) of JSON lines {"question", "sql"}; a question that occurs twice, by its normal form, is an error."""
    rows = json_lines(spark, path, "question string, sql string").select(normal_question(F.col("question")).alias("question"), "sql")
    once = rows.groupBy("question").agg(F.min("sql").alias("sql"), F.count("*").alias("n"))
    return once.select("question", F.when(F.col("n") == 1, F.col("sql")).otherwise(F.raise_error(F.concat(F.lit("question occurs twice: "), "question")).cast("string")).alias("sql"))


def any_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question) of a file of questions in any of its forms: JSON with `items`, `kept_meta` or `questions`, a JSON list of texts or objects, JSON lines, or plain lines."""
    whole = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("t"))
    held = F.from_json("t", "items array<string>, kept_meta array<string>, questions array<string>")
    listed = F.when(F.col("t").startswith("["), F.from_json("t", "array<string>")).otherwise(F.coalesce(held["items"], held["kept_meta"], held["questions"]))
    first, has_list = whole.select(F.substring("t", 1, 1), listed.isNotNull()).first() or ("", False)
    if not has_list:  # lines, plain or of JSON
        return (json_lines(spark, path, "question string") if first == "{" else questions(spark, path)).select("question")
    each = whole.select(F.explode(listed).alias("q"))
    return each.select(normal_question(F.coalesce(F.get_json_object("q", "$.question"), F.col("q"))).alias("question"))


def natural_rows(spark: SparkSession, path: str) -> DataFrame:
    """(question, sql, family) of one JSON object with parallel lists `questions`, `sqls` and `families`; lists of other lengths are an error."""
    parsed = F.from_json("value", "questions array<string>, sqls array<string>, families array<string>", {"mode": "FAILFAST"})
    row = spark.read.text(path, wholetext=True).select(parsed.alias("p")).select("p.*")
    sizes = F.size("questions")
    good = (sizes == F.size("sqls")) & (sizes == F.size("families"))
    zipped = F.when(good, F.arrays_zip("questions", "sqls", "families")).otherwise(F.raise_error(F.lit("lists of different lengths")).cast("array<struct<questions:string,sqls:string,families:string>>"))
    return row.select(F.explode(zipped).alias("r")).select(F.col("r.questions").alias("question"), F.col("r.sqls").alias("sql"), F.col("r.families").alias("family"))


SIGNALS = "lodestar-signals/1"


def write_signals(rows: DataFrame, path: str) -> str:
    """Write signals under a header with the format and the digest of the rows; returns the digest."""
    mark = digest(rows)
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(SIGNALS, mark)], "format string, digest string").coalesce(1).write.mode("errorifexists").json(f"{path}/header")
    return mark


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """What write_signals wrote; another format or other rows than the header says are an error."""
    head = spark.read.schema("format string, digest string").json(f"{path}/header").first()
    rows = spark.read.parquet(f"{path}/rows")
    if head is None or head["format"] != SIGNALS:
        raise ValueError(f"{path} isn't a file of signals")
    if head["digest"] != digest(rows):
        raise ValueError(f"{path} isn't what its header says")
    return rows


def confirmed(drafts: DataFrame, log: DataFrame) -> DataFrame:
    """Drafts (task_id, question, sql) whose last decision confirms them, with the SQL that it gave, if any."""
    last = last_decisions(log).where("decision = 'confirmed'").select("task_id", F.col("sql").alias("_sql"))
    return drafts.join(last, "task_id").withColumn("sql", F.coalesce("_sql", "sql")).drop("_sql")


def embedding_key(model: str, dims: int, texts: DataFrame) -> str:
    """The name of an index of embedded texts: model, dimensions and the distinct texts, whatever their order."""
    return hashlib.sha256(canonical([model, dims, digest(texts.select("text").distinct())]).encode()).hexdigest()


def bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The parts of a replay bundle that are there, of report, run and tree, as VARIANT; and events (id, event, data) by id, of a JSON list
    (events.json, data being an object) or JSON lines (events.jsonl)."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    there = lambda name: (at := hadoop(f"{folder}/{name}")).getFileSystem(conf).exists(at)
    parts = {name: spark.read.text(f"{folder}/{name}.json", wholetext=True).select(F.try_parse_json("value").alias(name)) for name in ("report", "run", "tree") if there(f"{name}.json")}
    if there("events.jsonl"):
        events = json_lines(spark, f"{folder}/events.jsonl", "id long, event string, data string")
    else:
        listed = F.from_json("value", "array<struct<id:long, event:string, data:string>>", {"mode": "FAILFAST"})
        events = spark.read.text(f"{folder}/events.json", wholetext=True).select(F.explode(listed).alias("e")).select("e.*")
    return parts | {"events": events.orderBy("id")}
