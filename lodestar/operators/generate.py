"""Generation in rounds with caps and retirement: a greedy choice over all draws, as a fixpoint of whole-table plans.

Draws are (family, template, place, round, question, sql, skeleton, ok, n_rows): in each round every template that is still in offers
its draw of that round, in order of place. An offer is dropped, for the first of these reasons that holds: its SQL was accepted
before (duplicate_sql), its question was (duplicate_question), its skeleton was accepted skeleton_cap times (skeleton_cap), its
SQL fails (error) or gives no rows (empty). Others are accepted. A template retires when it has template_cap accepted draws,
when its family has family_cap, after `exhausted` duplicates in a row, or after `worn_out` drops by skeleton without one that gets
past that test between them (duplicates don't count). All retire with the n-th accepted draw.

A verdict depends only on verdicts of earlier draws. So all verdicts are worked out at once from the last guess at what is
accepted, and again from the new one, until nothing changes: after j rounds of this every verdict that hangs on a chain of fewer
than j others is final, and what doesn't change is what one draw after the other would give. The first guess is that the first of each SQL
and question that gives rows is accepted.

Each step is aggregations by SQL, question, skeleton, template and family; the k-th accepted draw of a group is found with at most k rows a
task and group, streaks by sums over blocks of rounds, so no group is put in order as a whole.

Nulls: a draw without template, round, place, sql or question is left out; a null ok is a failure, a null n_rows no rows, and null families or
skeletons are one each. Draws that repeat (round, place) are taken in order of their sql and question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.storage import written

#: Rounds that one window looks at.
BLOCK = 1 << 14


def kth(rows: DataFrame, group: str | None, k: int, name: str) -> DataFrame:
    """(group, name): the k-th smallest pos of each group that has as many. Tasks hand on k rows of a group at most."""
    by = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    ranked = rows.withColumn("_k", F.row_number().over(by.orderBy("pos"))).where(F.col("_k") <= k)
    found = ranked.where(F.col("_k") == k)
    return found.select(F.col(group).alias(f"_{name}_of"), F.col("pos").alias(name)) if group else found.select(F.col("pos").alias(name))


def streak_end(rows: DataFrame, counts: Column, resets: Column, length: int, block: int = BLOCK) -> DataFrame:
    """(template, pos): where each template's sum of `counts` since the last row of `resets` first reaches length; rows are in order of round.

    Running sums go over blocks first, then within blocks.
    """
    mine = rows.select("template", "round", "pos", counts.cast("long").alias("_w"), resets.alias("_r"), F.expr(f"round div {block}").alias("_b"))
    before = Window.partitionBy("template").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    within = Window.partitionBy("template", "_b").orderBy("round", "pos")
    sums = mine.groupBy("template", "_b").agg(F.sum("_w").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    total = mine.join(sums, ["template", "_b"]).withColumn("_g", F.col("_before") + F.sum("_w").over(within))
    at_reset = F.when(F.col("_r"), F.col("_g"))
    last = total.groupBy("template", "_b").agg(F.max(at_reset).alias("_m")).withColumn("_upto", F.max("_m").over(before)).drop("_m")
    since = F.col("_g") - F.greatest(F.coalesce("_upto", F.lit(0)), F.coalesce(F.max(at_reset).over(within), F.lit(0)))
    reached = total.join(last, ["template", "_b"]).withColumn("_since", since).where(F.col("_since") >= length)
    return reached.groupBy("template").agg(F.min("pos").alias("pos"))


def generate(draws: DataFrame, n: int, template_cap: int, family_cap: int, skeleton_cap: int | None = None, exhausted: int = 12, worn_out: int = 12, most_rounds: int = 1000) -> DataFrame:
    """draws with pos and verdict: accepted, a reason for dropping, or retired (not offered any more)."""
    known = draws.where("template IS NOT NULL AND round IS NOT NULL AND place IS NOT NULL AND sql IS NOT NULL AND question IS NOT NULL")
    known = known.withColumns({"family": F.coalesce("family", F.lit("")), "skeleton": F.coalesce("skeleton", F.lit("")), "_good": F.coalesce(F.col("ok") & (F.col("n_rows") > 0), F.lit(False))})
    known = written(known, "offers")  # read several times
    width = (known.agg(F.max("place")).first()[0] or 0) + 1
    again = Window.partitionBy("round", "place").orderBy("sql", "question")
    known = known.withColumn("_copy", F.row_number().over(again) - 1)
    copies = (known.agg(F.max("_copy")).first()[0] or 0) + 1
    known = written(known.withColumn("pos", (F.col("round") * width + F.col("place")) * copies + F.col("_copy")).drop("_copy"), "draws")
    never = F.lit(None).cast("long")

    def verdicts(taken: DataFrame) -> DataFrame:
        sqls = taken.groupBy(F.col("sql").alias("_sql")).agg(F.min("pos").alias("_first_sql"))
        questions = taken.groupBy(F.col("question").alias("_question")).agg(F.min("pos").alias("_first_question"))
        rows = known.join(sqls, F.col("sql") == F.col("_sql"), "left").join(questions, F.col("question") == F.col("_question"), "left")
        if skeleton_cap is None:
            rows = rows.withColumn("_worn", never)
        else:
            rows = rows.join(kth(taken, "skeleton", skeleton_cap, "_worn"), F.col("skeleton") == F.col("__worn_of"), "left")
        pos = F.col("pos")
        duplicate = F.coalesce((F.col("_first_sql") < pos) | (F.col("_first_question") < pos), F.lit(False))
        worn = F.coalesce(F.col("_worn") < pos, F.lit(False))
        rows = rows.withColumns({"_dup": duplicate, "_sk": ~duplicate & worn, "_by_sql": F.coalesce(F.col("_first_sql") < pos, F.lit(False))})
        rows = written(rows.select(*known.columns, "_dup", "_sk", "_by_sql"), "judged")
        ends = [
            kth(taken, "template", template_cap, "pos").withColumnRenamed("_pos_of", "template"),
            streak_end(rows, F.col("_dup"), ~F.col("_dup"), exhausted),
        ]
        if skeleton_cap is not None:
            ends.append(streak_end(rows, F.col("_sk"), ~F.col("_dup") & ~F.col("_sk"), worn_out))
        end = ends[0]
        for e in ends[1:]:
            end = end.unionByName(e)
        end = end.groupBy(F.col("template").alias("_t")).agg(F.min("pos").alias("_end"))
        full = kth(taken, "family", family_cap, "_full")
        whole = kth(taken, None, n, "_pos").first()
        rows = rows.join(end, F.col("template") == F.col("_t"), "left").join(full, F.col("family") == F.col("__full_of"), "left")
        last = F.least("_end", "_full", F.lit(whole[0]).cast("long") if whole else never)
        verdict = (
            F.when(F.coalesce(F.col("pos") > last, F.lit(False)), "retired")
            .when(F.col("_by_sql"), "duplicate_sql").when(F.col("_dup"), "duplicate_question").when(F.col("_sk"), "skeleton_cap")
            .when(~F.coalesce("ok", F.lit(False)), "error").when(~F.col("_good"), "empty").otherwise("accepted")
        )
        return written(rows.select(*known.columns, verdict.alias("verdict")), "verdicts")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("pos").cast("decimal(38,0)"))).first())

    first = known.where("_good").groupBy("sql").agg(F.min_by("question", "pos").alias("question"), F.min("pos").alias("pos")).groupBy("question").agg(F.min("pos").alias("pos"))
    taken = known.join(first.select("pos"), "pos", "left_semi")
    last = mark(taken)
    for _ in range(most_rounds):
        judged = verdicts(taken)
        taken = judged.where("verdict = 'accepted'")
        now = mark(taken)
        if now == last:
            return judged.drop("_good")
        last = now
    raise RuntimeError(f"verdicts still change after {most_rounds} rounds")
