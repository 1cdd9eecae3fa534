"""Removal of long repeated byte strings (operator 6).

Every byte covered by a `length`-byte string that also starts anywhere else goes; strings don't cross texts, overlaps
count, and all are judged on the input.

Sorting all suffixes externally takes 16 bytes or more of disk for each byte of text (place, name and common prefix), so
only sampled suffixes are carried, as in induced sorting, and the others are induced from them:

1. Sampled suffixes ("anchors") start where the hash of GRAM bytes is least among REACH consecutive places. Whether a
   place is one depends on the bytes around it alone, and every `length`-byte window has one in its middle; the window
   belongs to the first of them. The windows of one anchor start at consecutive places.
2. An anchor is named by the bytes that all its windows have in common (key). Names that occur once are dropped: none
   of their windows repeat.
3. Of equal names, the bytes that any of its windows covers (cover) are named too. Where a cover repeats, so do all its
   windows. Other windows are induced in two steps, by runs of STEP windows and then one by one, from one anchor for
   each distinct cover; thousands of copies cost as much as one.

Names are 64-bit digests, compared within equal outer names: 128 bits and more decide. What is shuffled are names of
anchors that repeat, and the bytes around one anchor for each distinct cover whose name is unclear. The bitmaps only save
shuffles: where they are full, every anchor is shuffled once (some 40 bytes for each 64 bytes of text). Counts are written
before they are joined back, so that Spark can split the rows of a very common name.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; equal texts are treated alike (both lose
what the other has); repeated rows count as two places; other columns are kept, whatever their names, but for
n_bytes, n_removed, n_spans and spans, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import bitmap, discard, fresh, in_bitmap, mark_of_id, materialize, text_id_column
from lodestar.llm.shared import text_id as id_of

LENGTH, GRAM, STEP = 400, 16, 16
_M1, _M2, _M3 = (np.uint64(xxhash.xxh3_64_intdigest(f"anchor {i}") | 1) for i in range(3))


def reach_of(length: int) -> int:
    """The largest power of two for which every window has an anchor that it alone decides on."""
    reach = 1
    while 3 * (2 * reach) + GRAM <= length + 2:
        reach *= 2
    return reach


def anchors(data: bytes, reach: int) -> np.ndarray:
    """Places whose GRAM bytes hash least among some `reach` consecutive places."""
    n = len(data) - GRAM + 1
    if n < reach:
        return np.empty(0, np.int64)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 8)).view("<u8").ravel()
    h = eight[:n] * _M1 + (eight[8 : 8 + n] ^ (eight[8 : 8 + n] >> np.uint64(29))) * _M2
    h ^= h >> np.uint64(32)
    h *= _M3
    least, s = h, 1
    while s < reach:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    most = np.zeros(len(least) + 2 * (reach - 1), np.uint64)
    most[reach - 1 : reach - 1 + len(least)] = least
    s = 1
    while s < reach:
        most = np.maximum(most[:-s], most[s:])
        s *= 2
    return np.flatnonzero(most == h)


def windows_of(data: bytes, length: int, reach: int) -> list[tuple[int, int, int]]:
    """(anchor, first, last): the places where the windows of an anchor start."""
    if len(data) < length:
        return []
    at = anchors(data, reach)
    last = np.minimum(at - reach + 1, len(data) - length)
    first = np.concatenate([[0], np.maximum(at[:-1] - reach + 2, 0)])
    some = first <= last
    return list(zip(at[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True))


def _long(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed) - (1 << 63)


#: Rows and bytes that a task holds at most (and one row more) before it hands them on.
FLUSH_ROWS, FLUSH_BYTES = 20_000, 8_000_000
#: Digests that a task remembers.
SEEN = 1_000_000


def _rows(df: DataFrame, schema: str, each: Callable) -> DataFrame:
    """mapInArrow: each(row of df) gives tuples of the schema."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*[(c.split()[0], kinds[c.split()[1]]) for c in schema.split(",")], strict=True)
    blobs = [i for i, t in enumerate(types) if t == pa.binary()]

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                for row in each(*[c.as_py() for c in cells]):
                    held.append(row)
                    size += sum(len(row[i]) for i in blobs)
                    if len(held) >= FLUSH_ROWS or size >= FLUSH_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of(held)

    return df.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(text_id, start, end) of byte spans, covered by repeated windows, of the text with that digest; they may overlap."""
    reach = reach_of(length)
    context = docs.sparkSession.sparkContext
    texts = docs.where(F.length("text").isNotNull()).select(F.encode("text", "UTF-8").alias("data"))
    name_of = lambda data, a: _long(data[a - reach + 1 : a + length + 2 - 2 * reach])

    def keys(data: bytes) -> list[tuple[int]]:
        return [(name_of(data, a),) for a, _, _ in windows_of(data, length, reach)]

    may = context.broadcast(bitmap(_rows(texts, "key bigint", keys).groupBy("key").count().where("count > 1"), "key"))

    def covers(data: bytes) -> list[tuple]:
        mine = windows_of(data, length, reach)
        if not mine:
            return []
        key = np.array([name_of(data, a) for a, _, _ in mine], np.int64)
        text_id = id_of(data)
        out = []
        for i in np.flatnonzero(in_bitmap(may.value, key.view(np.uint64))).tolist():
            a, first, last = mine[i]
            out.append((int(key[i]), _long(data[first : last + length], (a - first) << 20 | a - last), text_id, a, first, last))
        return out

    found = materialize(_rows(texts, "key bigint,cover bigint,text_id binary,at int,first int,last int", covers), "anchors")
    place = F.struct("text_id", "at", "first", "last")
    by_cover = materialize(found.groupBy("key", "cover").agg(F.count("*").alias("n"), F.min(place).alias("place")), "covers")
    again = by_cover.where("n > 1").select("key", "cover")
    whole = materialize(found.join(again, ["key", "cover"]).select("text_id", F.col("first").alias("start"), (F.col("last") + length).alias("end")), "whole")
    discard(found)
    unclear = materialize(by_cover.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "unclear")
    members = materialize(by_cover.join(unclear, "key").select("key", "place.*"), "members")
    discard(by_cover, unclear)

    # The bytes around one anchor for each distinct cover of an unclear name.
    wanted = context.broadcast(bitmap(members.select(mark_of_id("text_id").alias("mark")), "mark"))
    seen: set[bytes] = set()  # a task's own copy

    def fetched(data: bytes) -> list[tuple]:
        text_id = id_of(data)
        if text_id in seen or not in_bitmap(wanted.value, np.array([int.from_bytes(text_id[1:8], "big")], np.uint64))[0]:
            return []
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(text_id)
        return [(text_id, data)]

    each_text = members.groupBy("text_id").agg(F.collect_list(F.struct("key", "at", "first", "last")).alias("rows"))
    bytes_of = _rows(texts, "text_id binary,data binary", fetched).dropDuplicates(["text_id"])

    def around(text_id: bytes, data: bytes, rows: list[dict]) -> Iterator[tuple]:
        return ((r["key"], text_id, r["at"], r["first"], r["last"], data[r["first"] : r["last"] + length]) for r in rows)

    contexts = _rows(bytes_of.join(each_text, "text_id").select("text_id", "data", "rows"), "key bigint,text_id binary,at int,first int,last int,data binary", around)
    contexts = materialize(contexts, "contexts")
    discard(members)

    def runs(key: int, text_id: bytes, at: int, first: int, last: int, data: bytes) -> list[tuple]:
        """Runs of at most STEP windows, dealt by their distance from the anchor: a name for what all windows of the run share, one for all its bytes."""
        out = []
        for block in range((at - last) // STEP, (at - first) // STEP + 1):
            far, near = min(at - first, block * STEP + STEP - 1), max(at - last, block * STEP)
            low, high = at - far - first, at - near - first
            core = data[at - block * STEP - first : at - (block * STEP + STEP - 1) - first + length]
            out.append((_long(core, block) ^ key, _long(data[low : high + length], far << 20 | near), text_id, at, first + low, first + high))
        return out

    blocks = materialize(_rows(contexts, "core bigint,cover bigint,text_id binary,at int,first int,last int", runs), "blocks")
    by_block = materialize(blocks.groupBy("core", "cover").agg(F.count("*").alias("n"), F.min(place).alias("place")), "runs")
    several = by_block.where("n > 1").select("core", "cover")
    part = materialize(blocks.join(several, ["core", "cover"]).select("text_id", F.col("first").alias("start"), (F.col("last") + length).alias("end")), "part")
    discard(blocks)
    open_ = materialize(by_block.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core"), "open")
    # The runs of one anchor are few: as many as its windows have steps.
    each_anchor = by_block.join(open_, "core").select("core", "place.*").groupBy("text_id", "at").agg(F.collect_list(F.struct("core", "first", "last")).alias("runs"))

    def single(text_id: bytes, at: int, base: int, data: bytes, runs: list[dict]) -> Iterator[tuple]:
        return ((r["core"], _long(data[p - base : p - base + length], at - p), text_id, p) for r in runs for p in range(r["first"], r["last"] + 1))

    around_open = contexts.select("text_id", "at", "first", "data").join(each_anchor, ["text_id", "at"])
    windows = materialize(_rows(around_open, "core bigint,window bigint,text_id binary,start int", single), "windows")
    discard(contexts, by_block, open_)
    twice = materialize(windows.groupBy("core", "window").count().where("count > 1").select("core", "window"), "twice")
    one = windows.join(twice, ["core", "window"]).select("text_id", "start", (F.col("start") + length).alias("end"))
    spans = materialize(whole.unionByName(part).unionByName(one), "spans")
    discard(whole, part, windows, twice)
    return spans


def kept_bytes(text: str | Column, spans: str | Column) -> Column:
    """The bytes of a text outside of its spans (merged, ascending), in order."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    edges = lambda of, whole: F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s[of])) if whole else F.concat(F.transform(spans, lambda s: s[of]), F.array(F.octet_length(data)))
    gaps = F.zip_with(edges("end", True), edges("start", False), lambda a, b: F.substring(data, a + 1, b - a).cast("string"))
    return F.when(F.size(spans) == 0, data).otherwise(F.array_join(gaps, "").cast("binary"))


SPANS = "array<struct<start:int,end:int>>"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and spans (maximal removed runs of bytes); kept_bytes cuts them out.

    Texts without any removed byte are not shuffled.
    """
    found = repeated_spans(docs, length)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(found.select(mark_of_id("text_id").alias("mark")), "mark"))

    @F.arrow_udf("boolean")
    def may_have(marks: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits.value, marks.to_numpy(zero_copy_only=False).view(np.uint64)), pa.bool_())

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

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
        return pa.array(out, kind)

    of, may, cut = fresh(docs, "of", "may", "cut")
    per_text = materialize(found.groupBy(F.col("text_id").alias(of)).agg(F.collect_set(F.struct("start", "end")).alias(cut)).select(of, merge(cut).alias(cut)), "cuts")
    discard(found)
    docs = docs.drop("spans").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumn(may, may_have(F.xxhash64(text)))
    none = F.array().cast(SPANS)
    clean = marked.where(~F.col(may)).withColumn("spans", none)
    rest = marked.where(F.col(may)).withColumn(of, text_id_column(text)).join(per_text, of, "left").drop(of).withColumn("spans", F.coalesce(cut, none))
    both = clean.unionByName(rest.drop(cut)).drop(may)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return both.withColumns({"n_removed": removed, "n_spans": F.size("spans").cast("long")})
