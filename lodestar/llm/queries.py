"""The registered queries of this subpackage: each applies one operator to its whole table; oracle SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import centroids, chat, jaccard, lines, packing, pii, quality, runs, secrets, sitestyle, suffixes, warc, winnow
from lodestar.llm.shared import new_path

#: In production the key comes from the cluster's secret store; this one makes the query repeatable.
PII_KEY = b"a key for repeatable query output"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the public byte-level BPE whose ids the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_index(spark, path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)
    kinds = F.transform("found", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return done.select("doc_id", "text", *counts)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer())


def op5_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_of_turns(table(spark, sf_dir, "conversations"))
    linked = chat.link_calls(calls, results, chat.TURN_SCHEMAS)
    return linked.withColumn("errors", F.array_join("errors", "; "))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(suffixes.kept_bytes(F.col("text"), F.col("spans")), 256).alias("kept_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = secrets.parts_of(F.col("spans"), tuple(r.kind for r in secrets.BASE))
    counts = [F.size(secrets.parts_of(F.col("spans"), (r.kind,))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), "spans")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = winnow.n_covered(F.col("hits.spans"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitestyle.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def periodic_tails(docs: DataFrame) -> DataFrame:
    """docs in which the words of every tenth text, by the hash of its id, repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    with_tail = """transform(_words, (w, i) -> if(i < _a, w, element_at(_words, cast(_a + pmod(i - _a, _p) + 1 AS int))))"""
    ready = docs.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, words)).withColumns({"_n": F.size("_words"), "_g": F.expr("_h div 10")})
    ready = ready.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    ready = ready.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    changed = F.when(F.col("_n") > 0, F.array_join(F.expr(with_tail), " ")).otherwise(F.col("text"))
    return ready.select("doc_id", changed.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(periodic_tails(table(spark, sf_dir, "documents")))
    best = F.expr("reduce(runs, runs[0], (a, r) -> if(r.length * a.period > a.length * r.period, r, a))")
    lines = F.array_join(F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))"), "")
    first = found.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("best"))
    return first.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_warc_archive, op2_quality_rules, op3_pii_pseudonyms, op4_best_fit_packing, op5_chat_tool_links, op6_suffix_dedup, op7_secret_scan, op8_ngram_jaccard, op9_line_dedup,
        op10_decontamination, op11_html_extraction, op12_centroid_clustering, op13_periodic_runs,
    )
    return {f.__name__: f for f in ops}


ORACLE = {
    "op5_chat_tool_links": """
        WITH users AS (SELECT conv_id, turn, min(text) AS text, count(*) AS copies FROM conversations WHERE role = 'user' GROUP BY ALL),
        replies AS (SELECT conv_id, turn - 1 AS asked, turn, min(text) AS content, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL),
        ranked AS (SELECT *, (turn - turn % 2) / 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM users),
        levels AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM ranked)
        SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, 'turn-' || coalesce(l.turn, r.asked) AS call_id, l.turn AS turn, l.level AS level,
               CASE WHEN l.turn IS NOT NULL THEN l.level = 0 END AS parent_missing,
               coalesce(l.copies, 0) AS copies, coalesce(r.n_results, 0) AS n_results, r.turn AS result_turn,
               CASE WHEN l.turn IS NOT NULL THEN concat_ws('; ', CASE WHEN l.turn < 2 AND length(l.text) < 20 THEN 'text: under 20' WHEN l.turn >= 2 AND length(l.text) < 10 THEN 'text: under 10'
                    WHEN l.turn >= 2 AND length(l.text) > 200 THEN 'text: over 200' END, CASE WHEN l.turn < 0 THEN 'turn: not allowed' WHEN l.turn > 6 THEN 'turn: over 6' END) END AS errors,
               CASE WHEN l.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'open' ELSE 'linked' END AS status,
               '{"arguments":' || CASE WHEN l.turn IS NULL THEN 'null' ELSE '{"text":' || to_json(l.text) || ',"turn":' || l.turn || '}' END
               || ',"call_id":"turn-' || coalesce(l.turn, r.asked) || '","content":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null')
               || ',"name":' || CASE WHEN l.turn IS NULL THEN 'null' WHEN l.turn < 2 THEN '"open"' ELSE '"reply"' END
               || ',"parent_id":' || CASE WHEN l.turn IS NULL THEN 'null' ELSE '"turn-' || (l.turn - 2) || '"' END || '}' AS json
        FROM levels l FULL JOIN replies r ON l.conv_id = r.conv_id AND l.turn = r.asked
    """,
}


def _centroid_sql(rounds: int) -> str:
    """The rounds one after the other; distances and floors are those of whole numbers."""
    nearest = """SELECT vec_id, rowid, v, unnest(min(struct_pack(d := d, j := j))) FROM (SELECT e.vec_id, e.rowid, e.v, c.j,
            list_sum(list_transform(list_zip(e.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept e CROSS JOIN {c} c) GROUP BY vec_id, rowid, v"""
    moved = """SELECT c.j, coalesce(n.c, c.c) AS c FROM {c} c LEFT JOIN (SELECT j, list(s ORDER BY k) AS c FROM
            (SELECT j, k, ((sum(x)::HUGEINT - (sum(x)::HUGEINT % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS s
             FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM {a}) GROUP BY j, k) GROUP BY j) n ON n.j = c.j"""
    steps = [
        """kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS rowid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS j, v AS c FROM kept ORDER BY 1 LIMIT 16)""",
    ]
    for r in range(rounds):
        steps += [f"a{r} AS MATERIALIZED ({nearest.format(c=f'c{r}')})", f"c{r + 1} AS MATERIALIZED ({moved.format(c=f'c{r}', a=f'a{r}')})"]
    steps.append(f"done AS MATERIALIZED ({nearest.format(c=f'c{rounds}')})")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, a.j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM done a JOIN c{rounds} c ON c.j = a.j"""


ORACLE["op12_centroid_clustering"] = _centroid_sql(3)


def oracle_sql() -> dict[str, str]:
    return ORACLE
