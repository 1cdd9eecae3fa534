"""N-gram Jaccard join with token-combination prefixes (operator 8).

A text's set: the distinct shingles of `width` words (A-Z lower-cased); with fewer words, the whole sequence as one.
Two texts link when 100 * |intersection| >= percent * |union|.

Texts with equal sets are one node. Shingles ("tokens") that many texts share are frequent: they are counted in every
task, and the classes they fall in are kept in a bitmap of fixed size. All sets are ordered alike, rare tokens first,
each by hash. A set of n tokens may lack t = n - ceil(n * percent / 100) of those of a linked one, so among a prefix
with more than t tokens one is shared. Rare tokens are indexed alone. Frequent ones are dealt to CLASSES classes and
indexed as pairs within a class; the prefix is extended until, over all classes, (tokens - 1) and the rare tokens add up
to more than t, so that linked sets share a rare token or a pair. Sets below SMALL tokens, which may be too small for
that, index single frequent tokens, as do those up to SMALL * 100 / percent, which they may link with.

A signature's place tells how many tokens lack before it; with the sizes of two sets it decides whether it may be the first
they share. Of each group with a common signature every member is verified against one, that with the fewest rare tokens; links join them into components; then
members of a group that lie in different components are verified against each other, so no link that matters to a
component is left out. In groups of more than HOT members, which frequent sentences make, sets of up to SHORT tokens are not
compared pair by pair but dealt by combinations of more tokens. All tokens of a set are dealt to more parts than it may differ
in from a linked one, so that linked sets agree in a whole part; sets that agree in one are compared (see `parts`). Longer sets
of such a group are compared where their sizes and places allow a link.

Defined cases: null, empty and blank texts have empty sets, link with nothing and are their own component; repeated
rows are equal sets; a null doc_id is ignored as smallest id (and is the id where a component has no other); long texts
are read whole. Nodes are told apart by 64-bit digests of their sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import bitmap, components, discard, fresh, in_bitmap, materialize
from lodestar.llm.words import grams, word_hashes

WIDTH, PERCENT = 4, 85
SMALL, CLASSES, FREQUENT, ROUNDS = 24, 16, 32, 1
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of the distinct shingles, ascending."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if 0 < len(h) < width:
        return grams(h, len(h)) ^ np.uint64(len(h))
    return np.unique(grams(h, width))


def digest(tokens: np.ndarray) -> int:

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def lacking(n: int, percent: int) -> int:
    """How many of its n tokens a set may lack of any linked one, and one more."""
    return n + percent * n // -100 + 1


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set is indexed by, and the place of each: how many tokens of the set lack if it is the first that is shared, and one more.

    `frequent` says which tokens are.
    """
    n = len(tokens)
    need = lacking(n, percent)
    rare = tokens[~frequent][:need]
    places = [np.arange(1, len(rare) + 1)]
    if len(rare) == need:
        return rare, places[0]
    out, common = [rare], tokens[frequent]
    if SMALL > n or n * percent < SMALL * 100:
        out.append(common[: need - len(rare)] ^ np.uint64(0x5555555555555555))
        places.append(np.arange(len(rare) + 1, len(rare) + 1 + len(out[-1])))
    if n >= SMALL:
        classes: dict[int, list[int]] = {}
        count, pairs, at = len(rare), [], []
        for t in common.tolist():
            mine = classes.setdefault((t >> BITS_OF_CLASS) % CLASSES, [])
            count += bool(mine)
            for other in mine:
                pairs += (other, t)
                at.append(count)
            mine.append(t)
            if count >= need:
                break
        if pairs:
            out.append(grams(np.array(pairs, np.uint64), 2)[::2])
            places.append(np.array(at))
    return np.concatenate(out), np.concatenate(places)


#: Members of a signature that are compared pair by pair; in larger groups, sets of up to SHORT tokens are dealt by parts.
HOT, SHORT = 4096, 256


def bands(n: int, percent: int) -> list[int]:
    """Edges of bands of set sizes, up to the band after that of n. Linked sets lie in one band or in neighbouring ones."""
    edges = [1]
    while len(edges) < 3 or edges[-3] <= n:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


def parts(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Names of parts of a set, of which it has one in common with every linked set.

    For either pair of neighbouring bands that its size lies in, tokens are dealt to a third more parts than the number of
    tokens that a set may differ in from a linked one, so linked sets agree in some parts. Parts of less than two tokens, which
    many sets agree in, are left out where so many are left that one must be agreed in.
    """
    n, out = len(tokens), []
    edges = bands(n, percent)
    band = bisect_right(edges, n) - 1
    apart = lambda size: size * (100 - percent) // percent
    for joint in (band, band + 1):  # the bands joint - 1 and joint
        count = apart(edges[joint + 1] - 1) * 4 // 3 + 2
        at = ((tokens * _DEAL) >> np.uint64(33)) % np.uint64(count)
        order = np.argsort(at, kind="stable")
        held, first, sizes = np.unique(at[order], return_index=True, return_counts=True)
        sums = np.zeros(count, np.uint64)
        sums[held.astype(np.int64)] = np.add.reduceat((tokens ^ (tokens >> np.uint64(31)))[order] * _DEAL, first)
        full = np.zeros(count, bool)
        full[held.astype(np.int64)] = sizes > 1
        if full.sum() <= apart(n):
            full[:] = True
        some = np.flatnonzero(full).astype(np.uint64)
        out.append(grams(np.stack([sums[full], some << np.uint64(20) | np.uint64(joint)], axis=1).ravel(), 2)[::2])
    return np.unique(np.concatenate(out))


_DEAL = np.uint64(0xD6E8FEB86659FD93)

#: Tokens that a task holds at once to find those met twice.
CHUNK = 4_000_000
#: Classes are dealt by bits of a token that its place in the bitmap doesn't use.
BITS_OF_CLASS = 40


def _per_text(docs: DataFrame, of_text, schema: str, flush: int = 200_000) -> DataFrame:  # noqa: ANN001
    """mapInArrow over whole texts: of_text(text, digests seen) gives arrays of equal length, one for each column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        seen: set[int] = set()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)

        for batch in batches:
            for x in batch.column(0):
                arrays = of_text(x.as_py(), seen)
                if arrays is not None:
                    held.append(arrays)
                    n += len(arrays[0])
                if n >= flush:
                    yield out()
                    held, n = [], 0
                    if len(seen) > 1_000_000:
                        seen.clear()
        if held:
            yield out()

    names = [c.split()[0] for c in schema.split(",")]
    return docs.select("text").mapInArrow(run, schema)


def survey(docs: DataFrame, width: int) -> DataFrame:
    """One pass: (doc_id, key, n, id) of every row, `key` a hash of its text, and (token, count) of tokens that a task meets in two sets among CHUNK tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("token", pa.int64()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def out() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1].view(np.int64), counts[counts > 1]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.record_batch([none, none, none, none, pa.array(tokens), pa.array(counts, pa.int64())], schema=schema)

        for batch in batches:
            ns, ids = [], []
            for x in batch.column(1):
                tokens = shingles(x.as_py(), width)
                ns.append(len(tokens))
                ids.append(digest(tokens))
                if len(tokens) and ids[-1] not in seen:
                    seen.add(ids[-1])
                    held.append(tokens)
                    size += len(tokens)
                if size >= CHUNK:
                    yield out()
                    held, size, seen = [], 0, set()
            none = pa.nulls(len(ns), pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()), none, none], schema=schema)
        if held:
            yield out()

    found = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text")).mapInArrow(run, "doc_id bigint, key bigint, n bigint, id bigint, token bigint, count bigint")
    return materialize(found, "survey")


def signature_rows(docs: DataFrame, frequent: Broadcast, width: int, percent: int, only: Broadcast | None = None) -> DataFrame:
    """(sig, id, own) of every set, `own` of its tokens rare; with `only`, a bitmap, (sig, id, place, n, parities) of signatures that may be in it."""

    def of_text(text: str | None, seen: set[int]) -> tuple[np.ndarray, ...] | None:
        tokens = shingles(text, width)
        if not len(tokens) or (d := digest(tokens)) in seen:
            return None
        seen.add(d)
        common = in_bitmap(frequent.value, tokens)
        sigs, places = signatures(tokens, common, percent)
        if only is not None:
            some = in_bitmap(only.value, sigs)
            sigs, places = sigs[some], places[some]
        whole = lambda value, kind: np.full(len(sigs), value, kind)
        if only is None:
            return sigs.view(np.int64), whole(d, np.int64), whole(len(tokens) - int(common.sum()), np.int32)
        return sigs.view(np.int64), whole(d, np.int64), places.astype(np.int32), whole(len(tokens), np.int32), *(whole(x, np.int64) for x in parities(tokens))

    return _per_text(docs, of_text, "sig bigint, id bigint, own int" if only is None else f"sig bigint, id bigint, place int, n int, {', '.join(f'{p} bigint' for p in PARITIES)}")


PARITIES = ("p0", "p1", "p2", "p3")


def parities(tokens: np.ndarray) -> np.ndarray:
    """256 bits: whether each class of tokens has an odd number. Two sets differ in as many tokens, at least, as in bits."""
    odd = np.bincount((tokens >> np.uint64(32) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def common_tokens(docs: DataFrame, counts: DataFrame, width: int, percent: int, rounds: int = ROUNDS) -> Broadcast:
    """The bitmap of frequent tokens. Those that tasks find are joined, round by round, by tokens that two sets have in their prefixes
    of rare tokens: the next prefixes pass them over, so that what two texts quote alike doesn't make them candidates."""
    context = docs.sparkSession.sparkContext
    found = bitmap(counts.groupBy("token").agg(F.sum("count").alias("n")).where(F.col("n") >= FREQUENT), "token")
    for _ in range(rounds):
        known = context.broadcast(found)

        def of_text(text: str | None, seen: set[int], known: Broadcast = known) -> tuple[np.ndarray, ...] | None:
            tokens = shingles(text, width)
            if not len(tokens) or (d := digest(tokens)) in seen:
                return None
            seen.add(d)
            rare = tokens[~in_bitmap(known.value, tokens)][: lacking(len(tokens), percent)]
            return rare.view(np.int64), np.full(len(rare), d, np.int64)

        prefixes = _per_text(docs, of_text, "token bigint, id bigint")
        twice = prefixes.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
        found = found | bitmap(twice, "token")
    return context.broadcast(found)


def token_sets(docs: DataFrame, keys: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, tokens) of the wanted ids. keys: (id, key) of every text, key being Spark's xxhash64 of it.

    One text of each wanted set is cut again. A bitmap of their keys keeps nearly all others from being read by Python.
    """
    mine = materialize(keys.join(wanted.select("id").distinct(), "id").groupBy("id").agg(F.min("key").alias("key")), "keys")
    may = docs.sparkSession.sparkContext.broadcast(bitmap(mine, "key"))

    @F.arrow_udf("boolean")
    def is_wanted(marks: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(may.value, marks.to_numpy(zero_copy_only=False).view(np.uint64)), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, size, seen = [], [], 0, set()
        for batch in batches:
            for x in batch.column(0):
                tokens = shingles(x.as_py(), width)
                d = digest(tokens)
                if len(tokens) and d not in seen:
                    seen.add(d)
                    ids.append(d)
                    sets.append(tokens.tobytes())
                    size += len(sets[-1])
                if size > 8_000_000:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "tokens"])
                    ids, sets, size = [], [], 0
        if ids:
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], names=["id", "tokens"])

    some = docs.select("text").where(F.col("text").isNotNull()).where(is_wanted(F.xxhash64("text")))
    found = some.mapInArrow(run, "id bigint, tokens binary").join(mine.select("id"), "id", "left_semi")
    return found.groupBy("id").agg(F.first("tokens").alias("tokens"))  # equal ids have equal tokens


def close(x: str, y: str, percent: int) -> Column:
    """Whether sets may link, by sizes and parities."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    shared = F.ceil(percent * (n + m) / (100 + percent))
    apart = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITIES), F.lit(0))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= n + m - 2 * shared)


def fitting(x: str, y: str, percent: int) -> Column:
    """Whether sets may link whose first shared signature is this one, by sizes, places and parities."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.place"), F.col(f"{y}.place")
    shared = F.ceil(percent * (n + m) / (100 + percent))
    return (i <= n - shared + 1) & (j <= m - shared + 1) & close(x, y, percent)


def verified(docs: DataFrame, keys: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. pairs must be a written table; sets are cut again from the texts that occur in it."""

    @F.arrow_udf("boolean")
    def linked(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(xs, ys, strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    ids = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    sets = materialize(token_sets(docs, keys, ids, width), "sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
    links = materialize(left.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b").where(linked("x", "y")).select("a", "b"), "links")
    discard(sets)
    return links


def link_components(docs: DataFrame, found: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, root) of every set that links with another. found: the survey of docs."""
    counts, keys = found.where("token IS NOT NULL").select("token", "count"), found.where("token IS NULL").select("id", "key")
    context = docs.sparkSession.sparkContext
    frequent = common_tokens(docs, counts, width, percent)
    # The member with the fewest rare tokens is, in a group of copies, the most typical one.
    rows = signature_rows(docs, frequent, width, percent)
    groups = rows.groupBy("sig").agg(F.min_by("id", "own").alias("pivot"), F.min("id").alias("low"), F.max("id").alias("high"))
    groups = materialize(groups.where("low <> high").select("sig", "pivot"), "groups")
    # Members are made distinct before they are joined, so that Spark can split those of a very common signature.
    members = signature_rows(docs, frequent, width, percent, context.broadcast(bitmap(groups, "sig")))
    members = materialize(members.groupBy("sig", "id").agg(*[F.min(c).alias(c) for c in ("place", "n", *PARITIES)]), "members")
    pivots = materialize(members.join(groups.withColumnRenamed("pivot", "id"), ["sig", "id"]), "pivots")
    stars = members.alias("x").join(pivots.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.id") != F.col("y.id"))).where(fitting("x", "y", percent))
    stars = materialize(stars.select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct(), "stars")
    discard(pivots, groups)
    links = verified(docs, keys, stars, width, percent)
    roots = components(links)
    placed = materialize(members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "placed")
    discard(members)
    apart = placed.groupBy("sig").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("_n")).where("_low <> _high AND _n > 2")
    apart = materialize(apart.select("sig", (F.col("_n") > HOT).alias("hot")), "apart")
    open_ = materialize(placed.join(apart, "sig"), "open")
    discard(placed, apart)
    # Of two members of a large group at least one is long here; two short ones meet by parts.
    x, y = open_.alias("x"), open_.alias("y")
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & (~F.col("x.hot") | (F.greatest("x.n", "y.n") > SHORT)) & fitting("x", "y", percent))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    by_parts = pairs_by_parts(docs, keys, open_.where(F.col("hot") & (F.col("n") <= SHORT)), width, percent)
    pairs = pairs.unionByName(by_parts.distinct())
    # Pairs that were verified lie apart in either order.
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    discard(open_)
    return roots if pairs.isEmpty() else components(links.unionByName(verified(docs, keys, pairs, width, percent)))


def pairs_by_parts(docs: DataFrame, keys: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of members (id, root, n, parities) of large groups that agree in a part and may link, a < b, of different roots."""
    nodes = materialize(members.select("id", "root", "n", *PARITIES).distinct(), "hot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names = parts(np.frombuffer(x.as_buffer(), np.uint64), percent).view(np.int64)
                yield pa.record_batch([pa.array(names), pa.array(np.full(len(names), i, np.int64))], names=["part", "id"])

    dealt = token_sets(docs, keys, nodes, width).mapInArrow(run, "part bigint, id bigint").join(nodes, "id")
    dealt = materialize(dealt, "parts")
    several = materialize(dealt.groupBy("part").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("part"), "several")
    shared = materialize(dealt.join(several, "part"), "shared")
    pairs = shared.alias("x").join(shared.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & close("x", "y", percent))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links reach) of every row."""
    found = survey(docs, width)
    nodes = found.where("token IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "id")
    full = nodes.where("n_shingles > 0")
    roots = link_components(docs, found, width, percent)
    firsts = full.groupBy("id").agg(F.min("doc_id").alias("low")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lows = firsts.groupBy("root").agg(F.min("low").alias("component_id"))
    by_id = materialize(firsts.join(lows, "root").select("id", "component_id"), "ids")  # so that Spark can split the rows of a very common text
    empty = nodes.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.join(by_id, "id").select("doc_id", "n_shingles", "component_id").unionByName(empty)


def keep_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, whatever ids they have: that with the smallest doc_id (null last), then the least hash of its text.

    Texts without a set are their own components; of rows equal in doc_id and text one stays.
    """
    found = survey(docs, width)
    id_, key, copies, place, mark = fresh(docs, "id", "key", "copies", "place", "mark")
    rows = found.where("token IS NULL").groupBy("doc_id", "key").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    roots = link_components(docs, found, width, percent)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "copies")
    firsts = rows.where("n > 0").groupBy("id").agg(F.min(first).alias("least")).join(roots, "id", "left")
    full = firsts.groupBy(F.coalesce("root", "id")).agg(F.min("least").alias("least"))
    keep = full.select("least").unionByName(rows.where("n = 0").select(first.alias("least")))
    keep = materialize(keep.select(F.col("least.doc_id").alias(id_), F.col("least.key").alias(key), F.col("least.copies").alias(copies)), "kept")
    kept = docs.withColumn(mark, F.xxhash64("text")).join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(mark) == F.col(key)))
    # Only repeated rows are dealt out again.
    single = kept.where(F.col(copies) == 1).select(docs.columns)
    several = kept.where(F.col(copies) > 1).withColumn(place, F.row_number().over(Window.partitionBy(id_, key).orderBy(copies)))
    return single.unionByName(several.where(F.col(place) == 1).select(docs.columns))
