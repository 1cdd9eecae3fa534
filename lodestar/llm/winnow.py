"""Benchmark decontamination by winnowing (operator 10).

Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A window is SPAN consecutive words
of a benchmark item; an item of fewer words, but not none, is one window of its own length. The fingerprint of a window
is the minimum hash of its runs of GRAM words (a shorter item's is the hash of all its words), so any shared SPAN words
share one.

The benchmark's windows are a table (fingerprint, window), and their items another (window, item). Texts hand on those of their windows whose fingerprint
may be there: a bitmap of fixed size, at any size of the benchmark, keeps most others from being shuffled. The two are
joined on fingerprint and window, a window being named by 128 bits of its words: that is the extension of a hit to the whole
window. Spark broadcasts the benchmark's side only where it is small, and splits a very common passage otherwise. Hits are
gathered by the digest of the text, so copies cost little, and joined back; texts without hits are not shuffled. Items are joined to the
distinct windows of each text last.

Defined cases: a null or empty text or item has no words and hits nothing; equal item_ids count once; the windows of an item
with a null item_id hit like others, but the item is neither counted nor listed; repeated documents are judged each by itself; other columns are kept, whatever their names, but for the one
that the result is asked to be put in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import bitmap, fresh, in_bitmap, mark_of_id, materialize, text_id, text_id_column
from lodestar.llm.words import grams, word_hashes

SPAN, GRAM = 10, 5
#: A-Z to a-z; all other ASCII but digits and letters to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The same words, in a text that isn't folded.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows that a task gathers before it hands them on.
FLUSH_ROWS = 20_000
SPANS = "array<struct<start:int,end:int>>"


def fingerprints(hashes: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of every window of n words."""
    if n < SPAN:
        return grams(hashes, n) ^ np.uint64(n)
    g = grams(hashes, GRAM)
    m = len(g) - (SPAN - GRAM)
    if m <= 0:
        return np.empty(0, np.uint64)
    out = g[:m].copy()
    for i in range(1, SPAN - GRAM + 1):
        np.minimum(out, g[i : i + m], out=out)
    return out


def _window(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _rows(df: DataFrame, schema: pa.Schema, each) -> DataFrame:  # noqa: ANN001
    """mapInArrow: each(row of df) gives rows of the schema."""

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                for row in each(*[c.as_py() for c in cells]):
                    held.append(row)
                    if len(held) >= FLUSH_ROWS:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return df.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(fp, window, n, item) of every window of the benchmark(item_id, text), repeated ones once; a written table."""
    schema = pa.schema([("fp", pa.int64()), ("window", pa.binary()), ("n", pa.int32()), ("item", pa.string())])

    def windows(item: str | None, data: bytes) -> Iterator[tuple]:
        data = data.translate(FOLD)
        words = data.split()
        n = min(len(words), SPAN)
        marks = fingerprints(word_hashes(data), n).view(np.int64).tolist() if n else []
        return ((fp, _window(words[i : i + n]), n, item) for i, fp in enumerate(marks))

    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string"), F.encode("text", "UTF-8"))
    return materialize(_rows(items, schema, windows).distinct(), "benchmark")


def hits_by_text(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(text_id, spans, items) of every distinct text that holds a window: hit spans of words (merged), and the items, sorted."""
    owned = benchmark_windows(benchmark)
    windows = materialize(owned.select("fp", "window", "n").distinct(), "windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # of 1 to SPAN
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(windows, "fp"))
    schema = pa.schema([("fp", pa.int64()), ("window", pa.binary()), ("n", pa.int32()), ("text_id", pa.binary()), ("start", pa.int32())])

    def candidates(text: bytes) -> Iterator[tuple]:
        data = text.translate(FOLD)
        hashes, words, mine_id = word_hashes(data), None, None
        for n in lengths:
            mine = fingerprints(hashes, n)
            for i in np.flatnonzero(in_bitmap(marks.value, mine)).tolist():
                if words is None:
                    words, mine_id = data.split(), text_id(text)
                yield int(mine[i].view(np.int64)), _window(words[i : i + n]), n, mine_id, i

    texts = docs.where(F.length("text").isNotNull()).select(F.encode("text", "UTF-8"))
    found = materialize(materialize(_rows(texts, schema, candidates), "candidates").join(windows, ["fp", "window", "n"]), "found")
    span = F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("end"))
    per_text = found.groupBy("text_id").agg(F.collect_set(span).alias("spans"))
    named = owned.where("item IS NOT NULL").select("window", "item").distinct()
    of_text = found.select("text_id", "window").distinct().join(named, "window").select("text_id", "item").distinct()
    lists = of_text.groupBy(F.col("text_id").alias("_text")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    per_text = per_text.join(lists, F.col("text_id") == F.col("_text"), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))

    @F.arrow_udf(SPANS)
    def merge(cells: pa.Array) -> pa.Array:
        out = []
        for cell in cells:
            merged: list[list[int]] = []
            for a, b in sorted((r["start"], r["end"]) for r in cell.as_py()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out.append([{"start": a, "end": b} for a, b in merged])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return materialize(per_text.select("text_id", merge("spans").alias("spans"), "items"), "hits")


def find_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits") -> DataFrame:
    """docs with the column `name`: n_words, hit spans of words (merged), and ids of the items with occurring windows, sorted."""
    found = hits_by_text(docs, benchmark)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(found.select(mark_of_id("text_id").alias("mark")), "mark"))

    @F.arrow_udf("boolean")
    def may_have(marks: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits.value, marks.to_numpy(zero_copy_only=False).view(np.uint64)), pa.bool_())

    docs = docs.drop(name)
    of, may, spans, items = fresh(docs, "of", "may", "spans", "items")
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumn(may, may_have(F.xxhash64(text)))
    none = {spans: F.array().cast(SPANS), items: F.array().cast("array<string>")}
    clean = marked.where(~F.col(may)).withColumns(none)
    hit = marked.where(F.col(may)).withColumn(of, text_id_column(text)).join(found.toDF(of, spans, items), of, "left").drop(of).withColumns({c: F.coalesce(c, empty) for c, empty in none.items()})
    hits = F.struct(F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.col(spans).alias("spans"), F.col(items).alias("items"))
    return clean.unionByName(hit).withColumn(name, hits).drop(may, spans, items)


def n_covered(spans: Column) -> Column:
    """Words in spans that are merged."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a window of the benchmark."""
    (name,) = fresh(docs, "hits")
    return find_hits(docs, benchmark, name).where(F.size(f"{name}.spans") == 0).drop(name)
