"""The pipeline stage by stage against brute force, each on its predecessor's whole output; SQL against the queries that have it."""

from __future__ import annotations

import random
from collections import defaultdict

import duckdb
from pyspark.sql import SparkSession

import corpus_pipeline
from lodestar.llm import lines, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark: SparkSession) -> None:
    docs = queries.table(spark, SF, "documents")
    rows = {0: docs.orderBy("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        rows[k + 1] = docs.collect()
        assert k == 4 or docs.columns == queries.table(spark, SF, "documents").columns
    text = {k: {r["doc_id"]: r["text"] for r in rows[k]} for k in range(5)}
    assert set(text[1]) <= {d for d, t in text[0].items() if not brute.quality(t)[-1]} and len(text[1]) > 0.7 * len(text[0])
    ordered = sorted(text[1].items())
    want = dict(zip([d for d, _ in ordered], brute.dedup_lines(ordered, lines.MIN_WORDS), strict=True))
    assert text[2] == {d: t for d, t in want.items() if t.strip() or t == text[1][d]}
    assert set(text[3]) == {d for d, _, c in brute.jaccard_components(sorted(text[2].items()), 80, 5) if d == c}
    items = [(str(r["item_id"]), r["text"]) for r in queries.table(spark, SF, "benchmark").collect()]
    assert set(text[4]) == {d for d, t in text[3].items() if not brute.decontaminate(t, items)[1]}
    fill: dict[int, int] = defaultdict(int)
    for r in rows[5]:
        fill[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in rows[5]} == set(text[4]) and max(fill.values()) <= 1024
    run = corpus_pipeline.run(spark, SF)
    whole = sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in run.collect())
    assert whole == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows[5])


def test_near_duplicate_stage_between_the_limits(spark: SparkSession) -> None:
    """Pairs that link at five words and 80 % but not at four words and 85 %, and the other way round by neither rule."""
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(100)]
        texts.append(" ".join(words))
        for at in range(0, rng.randint(0, 5)):
            words[7 + 19 * at] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    five, four = ({d for d, _, c in brute.jaccard_components(rows, p, w) if d == c} for p, w in ((80, 5), (85, 4)))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == five
    assert five != four


def test_chat_query_matches_sql(spark: SparkSession) -> None:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = queries.op5_chat_tool_links(spark, SF)
    result = con.execute(queries.oracle_sql()["op5_chat_tool_links"])
    cols = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(cols)
    cell = lambda v: str(v) if v is None or isinstance(v, (str, bool)) else f"{float(v):.9g}"
    want = sorted([[cell(v) for v in r] for r in result.fetchall()])
    assert sorted([[cell(r[c]) for c in cols] for r in df.collect()]) == want
