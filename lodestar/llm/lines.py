"""Line dedup by distributed prefix doubling over line names (operator 9).

Lines are split at \\n, trimmed, and named by a digest; blank lines are passed over. A run of consecutive lines with at
least `min_words` words is repeated if an equal run starts earlier (by doc_id, text digest, line). Every line of a
repeated run goes, so of each run its first copy stays. Overlaps count, within a text too.

The method: level 0 has the names of single lines; the name of 2^(k+1) lines is made of two names of level k. A level
keeps only names that occur twice, so it shrinks to what is repeated; it ends when a level is empty or runs of
`min_words` are covered. The shortest qualifying runs from each line on, and back from each line, cover every longer
one; each is the overlap of two names of its level, and runs of equal names are an interval of common prefixes, whose
first member stays.

Names are digests, so the suffixes of a text are told apart but not put in order: deletion asks only which runs are equal
and which comes first. Counts are written before they are joined back, so that Spark can split the rows of a very common line.

Defined cases: null text stays null and empty text empty; null doc_id sorts first; rows equal in doc_id and text are
one document and have the same outcome; other columns are kept, whatever their names, but for n_lines and n_removed, which
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import discard, fresh, materialize, text_id, text_id_column

MIN_WORDS = 10
SPACE = " \t\n\x0b\x0c\r"


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line that isn't blank: doc_id, key (digest of the text), pos (counting these lines), line (counting all), name,
    and ahead, back: the lines of the shortest run with min_words words from here on, and that ends here (null: none)."""

    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("pos", pa.int32()), ("line", pa.int32()), ("name", pa.binary()), ("ahead", pa.int32()), ("back", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = cell.as_py()
                if not text:
                    continue
                key = text_id(text.encode())
                lines = [(i, s) for i, line in enumerate(text.split("\n")) if (s := line.strip(SPACE))]
                counts = np.array([len(s.encode().split()) for _, s in lines], np.int64)
                total = np.concatenate([[0], np.cumsum(counts)])
                ahead = np.searchsorted(total, total[:-1] + min_words) - np.arange(len(lines))
                back = np.arange(1, len(lines) + 1) - (np.searchsorted(total, total[1:] - min_words, side="right") - 1)
                for pos, (i, s) in enumerate(lines):
                    a = int(ahead[pos]) if pos + ahead[pos] <= len(lines) else None
                    b = int(back[pos]) if total[pos + 1] >= min_words else None
                    rows.append((doc_id, key, pos, i, xxhash.xxh3_128_digest(s), a, b))
                if len(rows) > 100_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(read, "doc_id bigint, key binary, pos int, line int, name binary, ahead int, back int")


def only_repeated(level: DataFrame) -> DataFrame:
    """Rows whose name occurs at another place too; a written table."""
    names = materialize(level.groupBy("name").count().where("count > 1").select("name"), "names")
    found = materialize(level.join(names, "name"), "level")
    discard(names)
    return found


def repeated_runs(lines: DataFrame) -> DataFrame:
    """doc_id, key, first, size of the repeated runs that aren't the first of their kind; first counts lines that aren't blank."""
    place = ["doc_id", "key", "pos"]
    level = only_repeated(lines.select(*place, "name", "ahead", "back"))
    wanted = level.where("ahead IS NOT NULL OR back IS NOT NULL")
    ahead = wanted.where("ahead IS NOT NULL").select("doc_id", "key", "pos", F.col("ahead").alias("size"))
    back = wanted.where("back > 1").select("doc_id", "key", (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").alias("size"))
    runs = ahead.unionByName(back).distinct()
    longest = runs.agg(F.max("size")).first()[0] or 0
    names, k = [], 0
    level = level.select(*place, "name")
    while True:
        span = 1 << k
        here = runs.where((F.col("size") >= span) & (F.col("size") < 2 * span))
        end = level.select("doc_id", "key", F.col("pos").alias("_p"), F.col("name").alias("_n"))
        tail = (F.col("a.key") == F.col("b.key")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
        starts = here.alias("a").join(level.alias("b"), tail & (F.col("a.pos") == F.col("b.pos"))).select("a.*", F.col("b.name").alias("_head"))
        both = starts.alias("a").join(end.alias("b"), tail & (F.col("a.pos") + F.col("size") - span == F.col("_p")))
        names.append(both.select("a.doc_id", "a.key", "a.pos", "size", F.unhex(F.md5(F.concat("_head", "_n", F.col("size").cast("string").cast("binary")))).alias("run")))
        if 2 * span > longest:
            break
        following = end.alias("b")
        doubled = level.alias("a").join(following, tail & (F.col("a.pos") + span == F.col("_p")))
        doubled = doubled.select("a.doc_id", "a.key", "a.pos", F.unhex(F.md5(F.concat("a.name", "_n"))).alias("name"))
        level = only_repeated(materialize(doubled, "doubled"))
        if level.isEmpty():
            break
        k += 1
    found = names[0]
    for more in names[1:]:
        found = found.unionByName(more)
    found = materialize(found, "runs")
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("key").alias("k"), F.col("pos").alias("p"))
    firsts = materialize(found.groupBy("run").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "firsts")
    return found.join(firsts, "run").where(order > F.col("_first")).select("doc_id", "key", F.col("pos").alias("first"), "size")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text less the later copies of repeated runs of lines, and n_lines, n_removed (lines that aren't blank)."""

    lines = materialize(line_table(docs, min_words), "lines")
    runs = repeated_runs(lines)
    gone = runs.select("doc_id", "key", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("pos")).distinct()
    key, id_, of, marks, left = fresh(docs, "key", "id", "of", "gone", "left")
    per_doc = gone.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(of)).agg(F.sort_array(F.collect_list("pos")).alias(marks))
    per_doc = materialize(per_doc, "gone")
    discard(lines)

    kept = docs.withColumn(key, text_id_column(F.coalesce("text", F.lit("")))).join(per_doc, (F.col(key) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    text_type = pa.struct([("text", pa.string()), ("n_lines", pa.int64())])

    @F.arrow_udf("struct<text:string,n_lines:bigint>")
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for cell, marks in zip(texts, gone, strict=True):
            text, drop, at, kept = cell.as_py(), set(marks.as_py() or ()), -1, []
            for line in (text or "").split("\n"):
                full = bool(line.strip(SPACE))
                at += full
                if not (full and at in drop):
                    kept.append(line)
            out.append({"text": "\n".join(kept) if drop else text, "n_lines": at + 1})
        return pa.array(out, text_type)

    done = kept.withColumn(left, without("text", marks))
    new = {"n_lines": F.col(f"{left}.n_lines"), "n_removed": F.coalesce(F.size(marks), F.lit(0)).cast("long"), "text": F.col(f"{left}.text")}
    return done.withColumns(new).drop(key, of, id_, marks, left)
