"""Changed queries are run over the tables, in whole, and judged as one by one."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import SparkSession

from lodestar.operators import compare, sqltext
from lodestar.operators.database import Batches, Database
from lodestar.plans import checks, generation

SF = "/root/testdata/sf0.001"


def test_marks_tell_what_verdicts_tell(spark: SparkSession) -> None:
    own = spark.newSession()
    t = own.createDataFrame([(1, "a", 1.0), (2, None, 2.5), (2, None, 2.5), (3, "c", 0.1 + 0.2)], "x int, y string, z double")
    u = own.createDataFrame([(1, "p", None), (3, "q", "c")], "x int, w string, y string")
    db = Database(own, {"t": t, "u": u}, max_rows=100, timeout_s=60)
    asked = [
        "SELECT x, y FROM t", "SELECT x AS k, y FROM t WHERE x < 9", "SELECT x, y FROM t WHERE x < 3", "SELECT DISTINCT x, y FROM t", "SELECT y, x FROM t", "SELECT x FROM t", "SELECT x + 0.0 FROM t", "SELECT CAST(x AS STRING) FROM t", "SELECT x FROM t WHERE x > 7", "SELECT x FROM t WHERE x > 8",
        "SELECT z FROM t WHERE x = 3", "SELECT 0.3D", "SELECT w, y FROM u", "SELECT y, w FROM u", "SELECT t.x FROM t JOIN u ON u.x = t.x WHERE w = 'p'", "SELECT t.x FROM t JOIN u ON u.x = t.x WHERE w = 'q'", "SELECT t.x FROM t LEFT JOIN u ON u.x = t.x WHERE w = 'q'",
        "SELECT count(*) FROM t WHERE y = 'a'", "SELECT count(*) FROM t WHERE y = 'it''s'", "SELECT count(*) FROM t WHERE y = 'a' OR x = 2", "SELECT x FROM t WHERE y = 'a' OR NOT EXISTS (SELECT 1 FROM u WHERE u.x = t.x)", "SELECT x FROM t WHERE y = 'c' OR NOT EXISTS (SELECT 1 FROM u WHERE u.x = t.x)",
        "SELECT 6 / x FROM t WHERE x > 0", "SELECT x / 2 FROM t", "SELECT x / 0 FROM t", "SELECT x / 4 FROM t", "SELECT nope FROM t", "DROP TABLE t", "SELECT x FROM t WHERE z > 1.5", "SELECT x FROM t WHERE z > 0.3000001",
    ]
    found, runs = compare.marks(db, dict.fromkeys(asked, "")), db.run_all(asked)
    assert [found[s] is not None for s in asked] == [r.ok for r in runs] and sum(r.ok for r in runs) == len(asked) - 3
    for a, x in zip(asked, runs, strict=True):
        for b, y in zip(asked, runs, strict=True):
            if x.ok and y.ok:
                assert (found[a] == found[b]) == compare.verdict(x, y)[0], (a, b)
    many = Database(own, {"t": own.range(300).selectExpr("CAST(id AS INT) AS x", "'a' AS y", "1.0D AS z")}, max_rows=100)
    assert many.run("SELECT x FROM t").status == "row_cap" and compare.rejected(many, [("SELECT x FROM t", "k", "SELECT x FROM t WHERE x > -1"), ("SELECT x FROM t", "k", "SELECT x FROM t WHERE x > 0")]) == [(True, False), (True, True)]
    db = Database(own, {"t": t, "u": u})
    assert compare.rejected(db, [("SELECT x FROM t ORDER BY x DESC", "k", "SELECT x FROM t ORDER BY x ASC"), ("SELECT x / 0 FROM t", "k", "SELECT x / 1 FROM t"), ("SELECT x FROM t", "k", "SELECT x / 0 FROM t")]) == [(True, True), (False, False), (False, False)]
    assert compare.for_engine("SELECT 'strftime(''%Y'', a)' FROM o WHERE strftime('%Y-%m', d) = '2024-02'") == "SELECT 'strftime(''%Y'', a)' FROM o WHERE replace(replace('%Y-%m', '%Y', lpad(year(d), 4, '0')), '%m', lpad(month(d), 2, '0')) = '2024-02'"


def test_catalogue_runs_the_changes(spark: SparkSession) -> None:
    """n_masked, n_run and n_rejected against runs in chunks and the verdict."""
    gold = {r["sql"]: r["ok"] for r in generation.draws(spark, SF).select("sql", "ok").distinct().collect()}
    made = [(s, k, m) for s in gold for k, m in (sqltext.mutations(s) | sqltext.literal_mutations(s)).items() if m != s and k not in ("string_literal", "and_to_or", "gt_to_gte")]
    own = spark.newSession()
    db = Database(own, {name: own.read.parquet(f"{SF}/{name}.parquet") for name in checks.READ_BY})
    texts = list(dict.fromkeys(compare.for_engine(x) for s, _, m in made for x in (s, m) if gold[s]))
    done = dict(zip(texts, Batches(db).run(texts), strict=True))
    run, rejected = Counter(), Counter()
    for s, k, m in made:
        a, b = (done.get(compare.for_engine(x)) for x in (m, s))
        if gold[s] and a.ok and b.ok:
            run[k] += 1
            rejected[k] += not compare.verdict(a, b)[0]
    got = {r["kind"]: r for r in checks.mutation_catalogue(spark, SF).collect()}
    kinds = {k for _, k, _ in made}
    assert {k: (got[k]["n_run"], got[k]["n_rejected"]) for k in kinds} == {k: (run[k], rejected[k]) for k in kinds} and len(kinds) >= 4
    assert {k: r["n_masked"] for k, r in got.items()} == {k: r["n"] if k.endswith("_literal") else 0 for k, r in got.items()}
    literal = got["string_literal"]
    # No date has an x after it.
    assert literal["n"] - literal["n_run"] == sum("l_shipdate = '" in s for s in gold) > 0 and got["numeric_literal"]["n"] - got["numeric_literal"]["n_run"] == sum(not ok for ok in gold.values())
