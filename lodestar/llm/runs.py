"""Periodic runs of words within a text (operator 13).

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least max(MIN_LENGTH,
MIN_EXPONENT * q) words that no neighbouring word extends with period q. A word goes if any run holds it after that run's
first q words; the text that is left is the kept words joined by one space.

The method: a run of n words with period q has an overlap of n - q >= MASK words with itself q words on, so each of its
words lies in a MASK-gram that the text has twice (MASK = the least of max(MIN_LENGTH, MIN_EXPONENT * q) - q over all q).
Words outside repeated MASK-grams can't be in a run and cut the text into segments; most texts have none left. On the segments of a whole batch of texts, one
after the other with separators, Main and Lorentz's division runs level by level: the centres of a level lie halfway
between those above; at each centre, for each period up to a quarter of the node, a square may begin or end there. A
run of at least four periods holds a centre of a node twice as long as its period's double or longer, and reaches two
periods to its left or right. Squares are asked for by polynomial hashes of all centres and periods at once; of each
centre the smallest period is extended both ways, and its multiples within the run are passed over. Every run found is
checked word by word, and should hashes ever deceive, all squares are extended word by word.

Each text is a row's own work, so nothing is shuffled, and a text of n words takes O(n log n).

Defined cases: null text has no words, no runs and collapses to the empty text, as does an empty one; other columns are
kept, whatever their names, but for runs and collapsed, which are replaced. Ids don't matter: repeated rows have equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import grams, word_hashes

MIN_LENGTH, MIN_EXPONENT = 6, 4
MASK = min(max(MIN_LENGTH, MIN_EXPONENT * q) - q for q in range(1, MIN_LENGTH + 1))
#: Pairs of centre and period that are looked at together, or those of one centre.
CHUNK = 1 << 20
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def segments(hashes: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of at least MIN_LENGTH words that repeated MASK-grams cover."""
    h = grams(hashes, MASK)
    if len(h) < 2:
        return []
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    covered = np.zeros(len(hashes) + 2, np.int32)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]])) + 1
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + MASK, -1)
    inside = np.diff((np.cumsum(covered) > 0).astype(np.int8))
    return [(a, b) for a, b in zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True) if b - a >= MIN_LENGTH]


class Words:
    """A sequence of numbers with equality of its stretches by polynomial hashes modulo 2^64: equal ones are always told equal."""

    def __init__(self, x: np.ndarray, longest: int) -> None:
        self.x, self.n, self.bits = x, len(x), max(1, longest).bit_length()
        mixed = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        self.power = np.full(self.n + 1, 0xD1342543DE82EF95, np.uint64)
        self.power[0] = 1
        np.multiply.accumulate(self.power, out=self.power)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mixed ^ (mixed >> np.uint64(32))) * self.power[:-1], dtype=np.uint64)])

    def same(self, i: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether m words from i on and from i + q on are equal; all within bounds."""
        s = self.sums
        return (s[i + m] - s[i]) * self.power[q] == s[i + q + m] - s[i + q]

    def ahead(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The most words from i on that equal those from i + q on."""
        out = np.zeros_like(i)
        for b in range(self.bits, -1, -1):
            more = out + (1 << b)
            fits = i + q + more <= self.n
            out = np.where(fits & self.same(i, np.where(fits, q, 0), np.where(fits, more, 0)), more, out)
        return out

    def back(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The most words before i that equal those before i + q."""
        out = np.zeros_like(i)
        for b in range(self.bits, -1, -1):
            more = out + (1 << b)
            fits = more <= i
            m = np.where(fits, more, 0)
            out = np.where(fits & self.same(i - m, q, m), more, out)
        return out

    def true(self, s: int, e: int, q: int) -> bool:
        """Whether [s, e) is a run of period q, word by word."""
        x = self.x
        return bool((x[s : e - q] == x[s + q : e]).all()) and (s == 0 or x[s - 1] != x[s + q - 1]) and (e == self.n or x[e] != x[e - q])

    def extend(self, i: int, q: int) -> tuple[int, int]:
        """The run around the square at i, word by word; (i, i) if there is none."""
        x, e, s = self.x, i + q, i
        while e < self.n and x[e] == x[e - q]:
            e += 1
        while s and x[s - 1] == x[s + q - 1]:
            s -= 1
        return (s, e) if e >= i + 2 * q else (i, i)


def squares(w: Words, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(centre, period, start) of squares that begin, or that end, at a centre, level by level; all of a centre come together."""
    half = 2
    while half < w.n:
        most = min(half // 2, longest // MIN_EXPONENT)
        centres, periods = np.arange(half, w.n, 2 * half), np.arange(1, most + 1)
        step = max(1, CHUNK // max(1, most))
        for a in range(0, len(centres), step):
            m, q = (g.ravel() for g in np.meshgrid(centres[a : a + step], periods, indexing="ij"))
            for start in (m, m - 2 * q):
                fits = (start >= 0) & (start + 2 * q <= w.n)
                i, p, c = start[fits], q[fits], m[fits]
                found = w.same(i, p, p)
                yield c[found], p[found], i[found]
        half *= 2


def repetitions(x: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of x, whose separators occur once and whose stretches have at most `longest` words."""
    w, found = Words(x, longest), set()
    for centre, q, start in squares(w, longest):  # of one centre in order of period
        while len(q):
            head = np.concatenate([[True], centre[1:] != centre[:-1]])
            i, p = start[head], q[head]
            e, s = i + p + w.ahead(i, p), i - w.back(i, p)
            long = e - s >= np.maximum(MIN_LENGTH, MIN_EXPONENT * p)
            found.update(zip(s[long].tolist(), e[long].tolist(), p[long].tolist(), strict=True))
            of = np.cumsum(head) - 1
            left = ~head & ((q % p[of] != 0) | (start < s[of]) | (start + 2 * q > e[of]))
            centre, q, start = centre[left], q[left], start[left]
    if not all(w.true(*run) for run in found):
        by_words = (w.extend(int(i), int(p)) + (int(p),) for _, q, start in squares(w, longest) for i, p in zip(start, q, strict=True))
        found = {(s, e, p) for s, e, p in by_words if e - s >= max(MIN_LENGTH, MIN_EXPONENT * p)}
    least: dict[tuple[int, int], int] = {}
    for s, e, p in found:
        least[s, e] = min(p, least.get((s, e), p))
    return sorted((s, e, p) for (s, e), p in least.items())


def runs_of(texts: list[list[bytes] | None], found: list[list[tuple[int, int]]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) by start, then period, of the runs in each text's segments; texts as words."""
    parts, owner, at, begins = [], [], 0, []
    for k, (words, cuts) in enumerate(zip(texts, found, strict=True)):
        if not cuts:
            continue
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
        for a, b in cuts:
            parts += [ids[a:b], np.array([-1 - len(begins)])]
            begins.append(at)
            owner.append((k, a))
            at += b - a + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if parts:
        x = np.concatenate(parts)
        for s, e, p in repetitions(x, max(map(len, parts))):
            at = int(np.searchsorted(begins, s, side="right")) - 1
            k, a = owner[at]
            out[k].append((a + s - begins[at], e - s, p))
    return [sorted(r, key=lambda t: (t[0], t[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if not runs:
        return b" ".join(words).decode()
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([x for x, g in zip(words, np.cumsum(gone), strict=False) if not g]).decode()


def _found(texts: pa.Array) -> pa.Array:
    cut, words = [], []
    for cell in texts:
        data = (cell.as_py() or "").encode()
        mine = segments(word_hashes(data)) if len(data) > 2 * MIN_LENGTH - 2 else []
        cut.append(mine)
        words.append(data.split() if mine else None)
    runs = runs_of(words, cut)
    left = [collapsed((t.as_py() or "").encode().split() if w is None else w, r) for t, w, r in zip(texts, words, runs, strict=True)]
    flat = [r for of in runs for r in of]
    fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN.value_type)))
    return pa.StructArray.from_arrays([lists, pa.array(left, pa.string())], ["runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with runs: array<struct<start, length, period>> by start, then period, and collapsed: the text without the later periods."""
    found = F.arrow_udf(_found, "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    return docs.withColumn("runs", found(F.col("text"))).withColumns({"collapsed": F.col("runs.collapsed"), "runs": F.col("runs.runs")})
