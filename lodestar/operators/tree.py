"""Trees as tables (id, parent): the nodes of a run's report, and depth, root and subtree totals of trees of any size.

Chains of parents are followed by pointer doubling: each round joins every node's farthest known ancestor with that one's, so a chain of d
parents takes log2(d) rounds, each one join by ancestor. A cycle never reaches a root and is an error.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.storage import written


def placed(nodes: DataFrame) -> DataFrame:
    """nodes(id, parent, ...) with root and depth: the top of a node's chain of parents, and how many there are.

    A null id is left out; ids are unique; a parent that is no node, or null, makes a root. A cycle is an error.
    """
    known = nodes.where("id IS NOT NULL").withColumn("id", F.col("id"))
    there = known.select(F.col("id").alias("_there"))
    linked = known.select("id", F.col("parent").alias("up")).join(there, F.col("up") == F.col("_there"), "left").select("id", F.col("_there").alias("up"))
    # top: the farthest ancestor that is known; at: how far it is; open: whether it has a parent.
    hops = written(linked.select("id", F.coalesce("up", "id").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("at")), "tree")
    n = hops.count()
    for _ in range(ceil(log2(n + 1)) + 1):
        ends = hops.select(F.col("id").alias("_id"), F.col("top").alias("_top"), F.col("at").alias("_at"))
        further = hops.join(ends, F.col("top") == F.col("_id"))
        hops = written(further.select("id", F.col("_top").alias("top"), (F.col("at") + F.col("_at")).alias("at"), (F.col("_at") > 0).alias("open")), "tree")
        if hops.where("open").isEmpty():
            return known.join(hops.select("id", F.col("top").alias("root"), F.col("at").alias("depth")), "id")
        hops = hops.drop("open")
    looped = hops.join(hops.select(F.col("id").alias("_id"), F.col("at").alias("_at")), F.col("top") == F.col("_id")).where("_at > 0").select("id").first()
    raise ValueError(f"a cycle of parents at {looped['id']}")


def subtree_totals(nodes: DataFrame, value: Column, most_depth: int = 10_000) -> DataFrame:
    """(id, n, total): how many nodes are in the subtree of each, itself included, and the sum of a value over them; nodes as `placed` gives them.

    Levels are added to those above, the deepest first: a level is one aggregation and one join.
    """
    rows = written(nodes.select("id", "parent", "depth", F.coalesce(value, F.lit(0)).alias("total")), "tree")
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        return rows.select("id", F.lit(1).cast("long").alias("n"), "total")
    if deepest > most_depth:
        raise ValueError(f"deeper than {most_depth}")
    level = rows.where(F.col("depth") == deepest).select("id", "parent", F.lit(1).cast("long").alias("n"), "total")
    done = [level]
    for depth in range(deepest - 1, -1, -1):
        below = level.groupBy("parent").agg(F.sum("n").alias("_n"), F.sum("total").alias("_total")).withColumnRenamed("parent", "_of")
        mine = rows.where(F.col("depth") == depth).join(below, F.col("id") == F.col("_of"), "left")
        level = written(mine.select("id", "parent", (1 + F.coalesce("_n", F.lit(0))).alias("n"), (F.col("total") + F.coalesce("_total", F.lit(0))).alias("total")), "tree")
        done.append(level)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("id", "n", "total")


ROUND = "struct<round:bigint,dev_acc:double,targeted_new_rows:bigint,clusters:array<struct<description:string,target_families:array<string>>>>"
REPORT = f"struct<rounds:array<{ROUND}>,sandbox_lineage:array<struct<label:string,uuid:string,parent:string>>,headroom:struct<base_dev_acc:double>,candidate_round:bigint>"


def from_reports(reports: DataFrame) -> DataFrame:
    """(run, id, parent, label, round, hypothesis, added_rows, families, dev_score, image, selected) of reports(run, report), report being a VARIANT.

    A run's tree is a chain: the base, then a node for each round, whose id is that of the branch with its label where there is one. Reports
    without rounds have no nodes.
    """
    parsed = reports.select("run", F.from_json(F.to_json("report"), REPORT).alias("r")).where(F.size("r.rounds") > 0)
    base = F.coalesce(F.get("r.sandbox_lineage", F.lit(0))["parent"], F.lit("base"))
    branch = lambda label: F.get(F.filter("r.sandbox_lineage", lambda x: x["label"] == label), F.lit(0))["uuid"]
    label = lambda x: F.concat(F.lit("round-"), x["round"].cast("string"))
    ids = F.transform("r.rounds", lambda x: F.coalesce(branch(label(x)), label(x)))
    named = parsed.withColumns({"base": base, "ids": ids})
    root = named.select("run", F.col("base").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("base model").alias("label"), F.lit(None).cast("long").alias("round"), F.lit(None).cast("string").alias("hypothesis"),
                        F.lit(None).cast("long").alias("added_rows"), F.lit(None).cast("array<string>").alias("families"), F.col("r.headroom.base_dev_acc").alias("dev_score"), F.lit(None).cast("string").alias("image"), F.lit(False).alias("selected"))
    each = named.select("run", "base", "ids", F.col("r.candidate_round").alias("candidate"), F.col("r.sandbox_lineage").alias("lineage"), F.posexplode("r.rounds").alias("k", "x"))
    clusters = F.coalesce("x.clusters", F.array().cast("array<struct<description:string,target_families:array<string>>>"))
    said = F.filter(F.transform(clusters, lambda c: c["description"]), lambda d: d.isNotNull() & (d != ""))
    families = F.array_sort(F.array_distinct(F.flatten(F.transform(clusters, lambda c: F.coalesce(c["target_families"], F.array().cast("array<string>"))))))
    image = F.get(F.filter("lineage", lambda v: v["label"] == F.concat(F.lit("round-"), F.col("x.round").cast("string"))), F.lit(0))["uuid"]
    rounds = each.select(
        "run", F.get("ids", F.col("k")).alias("id"), F.when(F.col("k") == 0, F.col("base")).otherwise(F.get("ids", F.col("k") - 1)).alias("parent"), F.concat(F.lit("round "), F.col("x.round").cast("string")).alias("label"), F.col("x.round").alias("round"),
        F.nullif(F.array_join(said, "; "), F.lit("")).alias("hypothesis"), F.col("x.targeted_new_rows").alias("added_rows"), F.when(F.col("x.targeted_new_rows").isNotNull(), families).alias("families"), F.col("x.dev_acc").alias("dev_score"),
        image.alias("image"), F.coalesce(F.col("x.round") == F.col("candidate"), F.lit(False)).alias("selected"),
    )
    return root.unionByName(rounds)
