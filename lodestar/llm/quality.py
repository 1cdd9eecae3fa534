"""Quality rules by hashed n-gram importance (operator 2). DataFrame functions only.

Every text is read as words `[^\\x20\\x09-\\x0D]+`. Base rules: fewer than `min_words` words, or over
`max_repeat_percent` of the words within 5-word windows that the text holds twice or more.

The method: unigrams and bigrams are hashed into `buckets` buckets. Two multinomials over the buckets, with add-`alpha`
smoothing, are counted: trusted-target (all texts labelled as good) and raw corpus (every n-gram of every text). A text's score is the sum of its n-grams' log-likelihood ratios
divided by their number, rounded to 6 places; texts under the threshold go. The threshold comes from all labelled
bad and good texts that pass the base rules. As texts that are counted in the target score higher than others like
them, a good text is scored by the target counts less its own, scaled up to the whole (leaving one out). Of the scores that
keep `least_kept` percent of the good texts it is that which keeps fewest bad ones; of equals the lowest. Verdicts are by all counts. Bucket
tables have `buckets` entries at any corpus size, so they can be inlined in every task.

Texts are read twice. For the counts only those whose id may be a trusted one, by a bitmap, are shuffled to be joined with these ids; then measures
and scores of a text, with and without its own counts, are worked out where it is read, and written. Labels are joined with the numbers.

Defined cases: null or empty text has no words and fails the base rules; without trusted labels or n-grams the ratio is
0 for every bucket and, as where no good or no bad text is labelled, only the base rules decide; null ids and labels are ignored among labels; repeated doc_id rows are
judged each by itself; other columns are kept, whatever their names, but for those that are added (see `judge`), which are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import BITMAP_BITS, fresh, materialize

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Runs, as patterns go over a run in one loop where `translate` makes a string of every character.
SPACES, NO_SYMBOLS = r"[\x20\x09-\x0D]+", f"[^{SYMBOLS}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashes_of(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def joined(hashes: Column, k: int) -> Column:
    """The hash of every entry with that k places on. Entries are paired by position, which is cheaper than to look each up."""
    n = F.greatest(F.size(hashes) - k, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))


def _windows(pairs: Column) -> Column:
    """The hash of every window of WINDOW (5) words, by position, from the hashes of all pairs: of pairs two places apart are 4 words, of two of these 5."""
    return let(joined(pairs, 2), lambda fours: joined(fours, 1))


def _covered(windows: Column) -> Column:
    """How many words lie in windows that occur twice: sort (hash, position), keep those with an equal neighbour, add up the union."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        return F.sort_array(F.array_compact(F.transform(s, lambda x, i: F.when(same(x, i), x["i"]))))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
    return F.aggregate(let(by_hash, twice), start, step, lambda acc: acc["n"].cast("long"))


def base_measures(docs: DataFrame, hashes: str, pairs: str, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """docs with columns `hashes` and `pairs` (hashes of words and of pairs of them), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = docs.withColumns(
        {
            hashes: hashes_of(F.col("text")),
            "word_chars": F.length(F.regexp_replace(text, SPACES, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, NO_SYMBOLS, "")).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    (windows,) = fresh(out, "windows")
    out = out.withColumns({"n_words": F.size(hashes).cast("long"), pairs: joined(F.col(hashes), 1)}).withColumn(windows, _windows(F.col(pairs)))
    repeats = F.when(F.size(F.array_distinct(windows)) < F.size(windows), _covered(F.col(windows)))
    out = out.withColumn("n_repeat_words", F.coalesce(repeats, F.lit(0).cast("long"))).drop(windows)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def fold(hash_: Column, buckets: int) -> Column:
    """The bucket of a hash."""
    return hash_.bitwiseAND(F.lit(buckets - 1).cast("long")) if buckets & (buckets - 1) == 0 else F.pmod(hash_, F.lit(buckets))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all texts labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def with_mark(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs with a boolean `name`, true wherever doc_id is among the ids; it may be true for a few others.

    Hashed ids are a bitmap of 2^BITMAP_BITS bits at any input size, in rows of 4 KB that are broadcast (4 MB in all).
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << BITMAP_BITS))
    part, bits = fresh(docs, "part", "bits")
    table = ids.groupBy(F.bitmap_bucket_number(place).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bits))
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn(part, F.bitmap_bucket_number(place)).join(F.broadcast(table), part, "left")
    return found.withColumn(name, F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False))).drop(part, bits)


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """(b, raw, target) of every bucket. Spark broadcasts the trusted ids or, where they are too many, shuffles by id the texts that may be trusted ones."""
    marked = with_mark(docs.select("doc_id", "text"), trusted, "_m")
    others = marked.where("NOT _m").select(F.lit(None).cast("int").alias("_t"), "text")
    known = marked.where("_m").drop("_m").join(trusted.select("doc_id", F.lit(1).alias("_t")), "doc_id", "left").select("_t", "text")
    grams = others.unionByName(known).select("_t", let(hashes_of(F.col("text")), lambda h: F.concat(h, joined(h, 1))).alias("_h"))
    # Were the column itself exploded, Spark would first filter rows by its size, and so hash each text twice.
    each = F.explode(F.coalesce("_h", F.array().cast("array<bigint>")))
    counts = grams.select("_t", each.alias("_h")).groupBy(fold(F.col("_h"), buckets).cast("int").alias("b")).agg(F.count("*").alias("raw"), F.count("_t").alias("target"))
    return docs.sparkSession.range(0, buckets, 1, 8).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").fillna(0, ["raw", "target"])


def _log_p(n: Column, total: Column, buckets: int, alpha: float) -> Column:
    return F.log((n + F.lit(alpha)) / (total + F.lit(alpha * buckets)))


def fit_ratios(counts: DataFrame, buckets: int, alpha: float = 1.0) -> DataFrame:
    """One row with arrays over all buckets: `ratios`, the log-likelihood ratio; `target`, the target counts; `log_raw`, the log of the raw probability; and `n_raw` and `n_target`."""
    table = counts.agg(F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target"), F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("all"))
    log_raw = lambda x: _log_p(x["raw"], F.col("n_raw"), buckets, alpha)
    ratio = lambda x: F.round(_log_p(x["target"], F.col("n_target"), buckets, alpha) - log_raw(x), 9)
    usable = (F.col("n_target") > 0) & (F.col("n_raw") > 0)
    ratios = F.transform("all", lambda x: F.when(usable, ratio(x)).otherwise(F.lit(0.0)))
    return table.select(ratios.alias("ratios"), F.transform("all", lambda x: x["target"]).alias("target"), F.transform("all", log_raw).alias("log_raw"), "n_raw", "n_target")


def _left_out(at: Column, model: Column, buckets: int, alpha: float = 1.0) -> Column:
    """The score of a text by the target counts less its own, scaled up to the whole. Equal buckets are neighbours once they are sorted: each is added up at its first place."""
    n = F.size(at)
    left = model["n_target"] - n
    total = model["n_target"] + F.lit(alpha * buckets)
    firsts = lambda s: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(s, i) != F.coalesce(F.get(s, i - 1), F.lit(-1)))

    def summed(s: Column, starts: Column, up: Column, target: Column, log_raw: Column) -> Column:
        runs = F.transform(starts, lambda p, j: F.struct(F.get(s, p).alias("b"), (F.coalesce(F.get(starts, j + 1), n) - p).alias("k")))
        mine = lambda x: F.greatest(F.get(target, x["b"]) - x["k"], F.lit(0)) * up + F.lit(alpha)
        return F.aggregate(runs, F.lit(0.0), lambda acc, x: acc + x["k"] * (F.log(mine(x)) - F.get(log_raw, x["b"])))

    # What is the same for all buckets of a text is worked out once: the factor, the tables, and the divisor, whose logarithm is taken off at the end.
    by_table = lambda s, starts, up: let(model["target"], lambda target: let(model["log_raw"], lambda log_raw: summed(s, starts, up, target, log_raw)))
    found = let(model["n_target"] / F.greatest(left, F.lit(1)), lambda up: let(F.sort_array(at), lambda s: let(firsts(s), lambda starts: by_table(s, starts, up))))
    return F.when((n > 0) & (left > 0) & (model["n_raw"] > 0), F.round(found / n - F.log(total), 6)).otherwise(F.lit(0.0))


def score(docs: DataFrame, model: DataFrame, buckets: int, mark: str | None = None) -> DataFrame:
    """docs with the base measures and `score`; with `mark`, a boolean column, also `left_out` of texts that have it and pass the base rules."""
    hashes, pairs, of, both = fresh(docs, "hashes", "pairs", "model", "scores")
    tables = ["ratios", *(["target", "log_raw", "n_raw", "n_target"] if mark else [])]
    named = base_measures(docs, hashes, pairs).withColumn(of, model.select(F.struct(*tables)).scalar())

    def scores(m: Column) -> Column:
        summed = lambda grams, start, ratios: F.aggregate(grams, start, lambda acc, h: acc + F.get(ratios, fold(h, buckets)))
        total = let(m["ratios"], lambda ratios: summed(pairs, summed(hashes, F.lit(0.0), ratios), ratios))
        mine = F.round(total / F.greatest(F.size(hashes) + F.size(pairs), F.lit(1)), 6)
        at = F.transform(F.concat(hashes, pairs), lambda h: fold(h, buckets))
        left_out = F.when(F.col(mark), let(at, lambda x: _left_out(x, m, buckets))) if mark else F.lit(None).cast("double")
        return F.struct(mine.alias("score"), left_out.alias("left_out"))

    # The model is named once, in one expression with all that reads it: so Spark puts it there, and its 1.5 MB are not copied into each row.
    out = named.withColumn(both, let(F.col(of), scores)).drop(of, hashes, pairs)
    found = {"score": F.col(both)["score"]} | ({"left_out": F.when(F.col(mark) & ~F.col("base_failed"), F.col(both)["left_out"])} if mark else {})
    return out.withColumns(found).drop(both)


def labelled_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of all labelled texts, but for good ones that are toxic and ids whose labels contradict."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    good = F.when((F.col("low") == 1) & (F.col("toxic") == 0), 1).when(F.col("high") == 0, 0)
    return known.select("doc_id", good.alias("good")).where("good IS NOT NULL")


def fit_threshold(scored: DataFrame, labelled: DataFrame, least_kept: int = 98) -> DataFrame:
    """One row with `threshold`, null where no good or no bad text is labelled. scored: (doc_id, base_failed, score, left_out).

    The highest score that keeps enough good texts keeps fewest bad ones; of the scores that keep as few, the lowest is above the next bad text. Scores are
    added up by thousandths, whose number the ratios bound, then within the one that holds the wanted score (1,000 scores), so no window holds the texts.
    """
    known = scored.where("NOT base_failed").select("doc_id", "score", "left_out").join(labelled, "doc_id")
    scored = known.select("good", F.when(F.col("good") == 1, F.col("left_out")).otherwise(F.col("score")).alias("score"))
    steps = materialize(scored.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")), "steps").withColumn("part", F.floor(F.col("score") * 1000))
    parts = steps.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    every = Window.partitionBy()
    upto = parts.select("part", "good", F.sum("good").over(Window.orderBy(F.desc("part"))).alias("kept"), F.sum("good").over(every).alias("n_good"), F.sum("bad").over(every).alias("n_bad"))
    held = upto.where("n_good > 0 AND n_bad > 0").where(100 * F.col("kept") >= least_kept * F.col("n_good")).agg(F.max_by(F.struct("part", (F.col("kept") - F.col("good")).alias("above"), "n_good"), "part").alias("h"))
    inside = steps.join(F.broadcast(held.select("h.part", "h.above", "h.n_good")), "part").withColumn("kept", F.col("above") + F.sum("good").over(Window.orderBy(F.desc("score"))))
    top = inside.where(100 * F.col("kept") >= least_kept * F.col("n_good")).agg(F.max("score").alias("top"))
    next_bad = steps.crossJoin(F.broadcast(top)).where("bad > 0 AND score < top").agg(F.max("score").alias("next_bad"))
    near = steps.crossJoin(F.broadcast(top.crossJoin(next_bad))).where("score <= top AND (next_bad IS NULL OR score > next_bad)")
    return near.agg(F.min("score").alias("threshold"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, threshold: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """docs with the base measures (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed), `score` and `kept`. A threshold that is given takes the place of the fitted one.

    `columns` of docs are in the result, all by default. They are written with the measures, so a text that isn't wanted is left out better here than later.
    """
    wanted = [c for c in columns or docs.columns if c.lower() not in {*MEASURES, "kept"}]
    trusted = materialize(trusted_ids(labels), "trusted")
    counts = materialize(bucket_counts(docs, trusted, buckets), "counts")
    model = materialize(fit_ratios(counts, buckets), "model")
    if threshold is None:
        mark, doc, left = fresh(docs, "mark", "doc", "left")
        marked = score(with_mark(docs, trusted, mark), model, buckets, mark)
        named = marked.select(*[F.col(f"`{c}`") for c in wanted], *MEASURES, F.col("doc_id").alias(doc), F.col("left_out").alias(left))
        written = materialize(named, "scored")
        scores = written.select(F.col(doc).alias("doc_id"), "base_failed", "score", F.col(left).alias("left_out"))
        least = F.coalesce(fit_threshold(scores, labelled_ids(labels)).scalar(), F.lit(float("-inf")))
        scored = written.drop(doc, left)
    else:
        least = F.lit(threshold)
        scored = score(docs, model, buckets).select(*[F.col(f"`{c}`") for c in wanted], *MEASURES)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def keep(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """docs that the rules keep.

    The row mark isn't deterministic to Catalyst, so the filter stays above the projection that works out `kept`; pushed
    below it, every use of the verdict's parts would be worked out anew.
    """
    # The text alone is judged, beside the columns under other names, so that none of them is replaced.
    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    named = kept.withColumns({c: kept[f"c{docs.columns.index(c)}"] for c in ("doc_id", "text")})
    (mark,) = fresh(named, "mark")
    marked = judge(named, labels, columns=kept.columns, **options).withColumn(mark, F.monotonically_increasing_id())
    return marked.where(F.col("kept") & (F.col(mark) >= 0)).select(*kept.columns).toDF(*docs.columns)
