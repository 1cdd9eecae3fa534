"""Hierarchical best-fit packing (operator 4).

Texts become ids of a public byte-level BPE (read from its rank file; the same ids as its JSON form gives) with an end
id each. Longer ones are cut into pieces of `capacity` ids, the first of which may be shorter. Pieces are then packed:
every task packs its pieces best-fit, largest first, and emits nearly full bins; underfull bins, as items that stay
whole, meet in ever fewer tasks for further best-fit rounds until one is left. Only bins that can still join another
(at most half full) and, for each of them, one that has room go on, so what a task hands on is bounded by the number
of its small bins and falls round by round.

Defined cases: a null text is empty and becomes a piece of the end id alone; repeated rows are packed each by itself;
an empty table gives no pieces; other columns are not carried.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import materialize

CAPACITY, END_ID = 1024, 2
#: The vocabulary's added token; it is one id where a text spells it, as in the JSON form.
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces that a task of the first round packs; bins with at most this room left are full; tasks that meet in a later round.
TASK_PIECES, SLACK, FAN_IN = 100_000, 8, 8
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


@cache
def load_encoding(ranks_path: str, pattern: str) -> object:
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, and the ids as little-endian unsigned 32-bit numbers."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoding(ranks_path, pattern).encode_to_numpy
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or "", allowed_special=set(SPECIAL)), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc_id, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
                held += len(ids)
                if held > 2_000_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # rooms that some bin has, ascending
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(rooms, sizes[i])
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at], by_room[room]
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - sizes[i]:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def carried(fills: list[int], capacity: int, slack: int) -> set[int]:
    """The bins worth another round: those at most half full and as many of the emptiest others."""
    small = [b for b, fill in enumerate(fills) if 2 * fill <= capacity]
    others = sorted((fill, b) for b, fill in enumerate(fills) if 2 * fill > capacity and capacity - fill > slack)
    return {*small, *(b for _, b in others[: 8 * max(1, len(small))])}


def pack_round(items: DataFrame, capacity: int, slack: int, last: bool) -> DataFrame:
    """items(bin, size): each with the bin it joins and its offset there; `open` bins go on to another round."""
    schema = pa.schema([("item", pa.int64()), ("size", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64()), ("open", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sizes: list[int] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            sizes += batch.column(1).to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)  # the outcome doesn't depend on the order of arrival
        ids, sizes = [ids[i] for i in order], [sizes[i] for i in order]
        bins = best_fit(sizes, capacity)
        fills = [sum(sizes[i] for i in b) for b in bins]
        go_on = set() if last else carried(fills, capacity, slack)
        rows = []
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                rows.append((ids[i], sizes[i], ids[b[0]], at, fills[k], k in go_on))  # a bin is named after its first item
                at += sizes[i]
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return items.mapInArrow(run, "item bigint, size bigint, bin bigint, offset bigint, fill bigint, open boolean")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, task_pieces: int = TASK_PIECES, fan_in: int = FAN_IN) -> DataFrame:
    """pieces(item, size, ...) of distinct items with `sequence_id` and `offset`. pieces must be stable (a written table)."""
    full = pieces.where(F.col("size") >= capacity).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("bigint")})
    rest = pieces.where(F.col("size") < capacity)
    tasks = max(1, -(-rest.count() // task_pieces))
    spread = lambda df, n, key: df.repartition(n, F.xxhash64(key))
    placed = materialize(pack_round(spread(rest.select("item", "size"), tasks, "item"), capacity, slack, tasks == 1), "packed")
    out = placed.select("item", "bin", "offset")
    underfull = placed.where("open").select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        merged = materialize(pack_round(spread(underfull, tasks, "item"), capacity, slack, tasks == 1), "merged")
        up = merged.where("item <> bin").select(F.col("item").alias("_from"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        out = out.join(up, F.col("bin") == F.col("_from"), "left").select(
            "item", F.coalesce("_to", "bin").alias("bin"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset")
        )
        underfull = merged.where("open").select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
    placement = out.select("item", F.col("bin").alias("sequence_id"), "offset")
    return rest.join(placement, "item").unionByName(full)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, **sizes: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    The ids themselves are cut again from the texts by `tokenize` where sequences are written out.
    """
    pieces = tokenize(docs, ranks_path, pattern, capacity).select(
        F.monotonically_increasing_id().alias("item"), "doc_id", "piece", "start", F.col("length").alias("size"), F.crc32("ids").alias("ids_crc32")
    )
    packed = pack(materialize(pieces, "pieces"), capacity, **sizes)
    return packed.select("doc_id", "piece", "start", F.col("size").alias("length"), "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, packed: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and its ids: the pieces of `packed` cut again from docs (distinct doc_ids) and put in their places.

    A sequence has at most `capacity` ids, so a group is bounded.
    """
    cut = tokenize(docs, ranks_path, pattern, capacity).select("doc_id", "piece", "ids")
    placed = packed.join(cut, ["doc_id", "piece"]).select("sequence_id", F.struct("offset", "ids").alias("part"))
    return placed.groupBy("sequence_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: F.hex(p["ids"])), "").alias("_hex")).select(
        "sequence_id", F.unhex("_hex").alias("ids")
    )
