"""Tool-call linking (operator 5). DataFrame functions only.

Calls and results are joined by (conv_id, call_id), each side first reduced to one row for each identifier. A call may
name a parent call; the level of a call is the length of its chain of parents, found by pointer doubling in as many
joins as the logarithm of the longest chain, so (conv_id, level, turn, call_id) is a topological order even where one
conversation holds most calls. Arguments are checked against the schema of the called tool and written as canonical
JSON: sorted keys, no spaces.

Defined cases: rows without an identifier are ignored; of calls (or results) with one identifier that of the least turn
(then text) stands and `copies` counts them all; results without a call are kept with status `orphan`, calls without a
result are `open`; a parent that isn't there makes the call a root (`parent_missing`); calls in or behind a cycle of
parents have a null level and status `cycle`; unknown tools, arguments that aren't a JSON object, missing, unknown or
mistyped ones and those out of their limits (allowed values, least and most, length) are listed in `errors`; empty tables
give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import materialize

#: Schema types and what schema_of_variant calls them.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT<.*>$", "array": "^ARRAY<.*>$"}


class Parameter(NamedTuple):
    """A parameter of a tool; a text's limits are of its length in characters, a number's of its value."""

    kind: str
    required: bool = False
    allowed: tuple[str | int, ...] = ()
    least: int | None = None
    most: int | None = None


Schemas = dict[str, dict[str, Parameter]]
ID = ["conv_id", "call_id"]


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def quoted(text: Column) -> Column:
    """text as a JSON string, or null as JSON."""
    array = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(array, F.lit(2), F.length(array) - 2))


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments of a call, sorted; an empty array if nothing is."""
    value = F.try_parse_json(arguments)
    whole = F.coalesce(F.schema_of_variant(value), F.lit("none"))
    keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
    found = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        checks = []
        for parameter, (kind, required, allowed, least, most) in ((k, Parameter(*p)) for k, p in parameters.items()):
            has = F.coalesce(F.array_contains(keys, parameter), F.lit(False))
            mine = F.schema_of_variant(F.try_variant_get(value, f"$['{parameter}']", "variant"))
            wrong = F.when(~F.coalesce(mine, F.lit("VOID")).rlike(TYPES[kind]), f"{parameter}: not {kind}")
            read = F.try_variant_get(value, f"$['{parameter}']", {"integer": "bigint", "number": "double", "string": "string"}.get(kind, "string"))
            size = F.length(read) if kind == "string" else read
            if allowed:
                wrong = wrong.when(~read.isin(*allowed), f"{parameter}: not allowed")
            if least is not None:
                wrong = wrong.when(size < least, f"{parameter}: under {least}")
            if most is not None:
                wrong = wrong.when(size > most, f"{parameter}: over {most}")
            checks.append(F.when(has, wrong).otherwise(F.lit(f"{parameter}: missing" if required else None)))
        extra = F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, parameters)) if parameters else F.array().cast("array<string>")), lambda k: F.concat(k, F.lit(": unknown")))
        mine = F.when(whole.startswith("OBJECT"), F.array_sort(F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), extra))).otherwise(F.array(F.lit("arguments: not an object")))
        found = F.when(name == tool, mine).otherwise(found)
    return found


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, parent_missing of calls (conv_id, call_id, parent_id) with distinct identifiers."""
    parents = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("_there"))
    up = F.when(F.col("_there"), F.col("parent_id"))
    linked = calls.select(*ID, "parent_id").join(parents, ["conv_id", "parent_id"], "left").select(
        *ID, up.alias("up"), up.isNotNull().cast("long").alias("level"), (F.col("parent_id").isNotNull() & F.col("_there").isNull()).alias("parent_missing")
    )
    nodes = materialize(linked, "levels")
    # After k rounds chains of 2^k are known; no chain without a cycle is longer than the number of calls.
    for _ in range(nodes.where("up IS NOT NULL").count().bit_length() + 1):
        above = nodes.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        done = nodes.where("up IS NULL")
        step = nodes.where("up IS NOT NULL").join(above, ["conv_id", "up"]).select("conv_id", "call_id", F.col("_up").alias("up"), (F.col("level") + F.col("_level")).alias("level"), "parent_missing")
        nodes = materialize(done.unionByName(step), "levels")
        if nodes.where("up IS NOT NULL").isEmpty():
            break
    return nodes.select(*ID, F.when(F.col("up").isNull(), F.col("level")).alias("level"), "parent_missing")


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each identifier: its call, level, result, errors, status and canonical JSON.

    calls: conv_id, call_id, parent_id, turn, name, arguments (JSON text); results: conv_id, call_id, turn, content.
    """
    valued = lambda df: df.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    one = valued(calls).groupBy(*ID).agg(F.min(F.struct("turn", "name", "arguments", "parent_id")).alias("c"), F.count("*").alias("copies")).select(*ID, "c.*", "copies")
    one = materialize(one, "calls")
    answer = valued(results).groupBy(*ID).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    ranked = one.join(levels(one), ID)
    both = ranked.withColumn("_call", F.lit(True)).join(answer, ID, "full")
    errors = F.when(F.col("_call"), argument_errors(F.col("name"), F.col("arguments"), schemas))
    status = (
        F.when(F.col("_call").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("r").isNull(), "open").when(F.col("r.turn") <= F.col("turn"), "early").otherwise("linked")
    )
    arguments = F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments")))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(arguments, F.lit("null")), F.lit(',"call_id":'), quoted(F.col("call_id")), F.lit(',"content":'), quoted(F.col("r.content")),
        F.lit(',"name":'), quoted(F.col("name")), F.lit(',"parent_id":'), quoted(F.col("parent_id")), F.lit("}"),
    )
    return both.select(
        *ID, "turn", "level", "parent_missing", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.col("r.turn").alias("result_turn"), errors.alias("errors"), status.alias("status"), json.alias("json"),
    )


#: Turns as calls: a user turn calls `reply`, or `open` at the start, with its text, the next turn answers it, its parent is the user turn before.
TURN_SCHEMAS: Schemas = {
    "open": {"text": Parameter("string", True, least=20), "turn": Parameter("integer", True, allowed=(0, 1))},
    "reply": {"text": Parameter("string", True, least=10, most=200), "turn": Parameter("integer", True, least=2, most=6)},
}


def turn_id(turn: Column) -> Column:
    return F.concat(F.lit("turn-"), turn.cast("string"))


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations(conv_id, turn, role, text)."""
    turn = F.col("turn")
    users = conversations.where("role = 'user'")
    pairs = users.select("conv_id", turn_id(turn).alias("call_id"), turn_id(turn - 2).alias("parent_id"), "turn", F.when(turn < 2, "open").otherwise("reply").alias("name"), F.to_json(F.struct("turn", "text")).alias("arguments"))
    replies = conversations.where("role = 'assistant'").select("conv_id", turn_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return pairs, replies
