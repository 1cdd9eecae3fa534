"""Secret scans with one combined automaton (operator 7).

Every rule is a head and a tail of `least` or more characters of one class. The heads of all rules (of a rule without a
head, its least tail) are compiled on the driver into one minimal automaton: subset construction, then minimisation. Its
transition arrays are broadcast; they have a fixed size. Each state names the rules whose heads are complete in it. One pass
over the bytes of a text steps through it and stops only where a head is complete; there a small automaton that reads the
rule's head backwards gives the leftmost start, and the run of the tail's class the end. All is linear in the text.

Matches are leftmost and don't overlap within a rule; a match whose tail is too short takes its place all the same, and is
then dropped. A head that a character of its tail follows must have only one end (as those of RULES).

Defined cases: a null or empty text has no spans; repeated rows are scanned each by itself; long texts are read
whole; spans of one kind do not overlap, spans of different kinds may; other columns are kept, `spans` is replaced.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.automata import compile_dfa


class Rule(NamedTuple):
    kind: str
    head: str
    tail: str
    least: int


BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 12),
    Rule("access", r"AKIA", r"[A-Z0-9]", 14),
    Rule("hex", r"", r"[0-9a-f]", 16),
)
ADDED = (
    Rule("repository", r"gh[oprsu]_", r"[A-Za-z0-9]", 36),
    Rule("workspace", r"xox[abeprs]-", r"[A-Za-z0-9-]", 20),
    Rule("cloud", r"AIza", r"[A-Za-z0-9_-]", 35),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]", 16),
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY", r"-", 5),
)
RULES = BASE + ADDED


class Scanner:
    """The transition arrays of all rules, and the scan of one text."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.heads = compile_dfa([r.head or f"{r.tail}{{{r.least}}}" for r in rules], anywhere=True)
        self.back = [compile_dfa([r.head], backwards=True) if r.head else None for r in rules]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _prepare(self) -> None:
        """Rows that hold the next rows; a state where heads are complete is an empty row, so that a step out of it raises IndexError."""
        table, rows, complete = self.heads
        self._table, self._rows = table, [[] for _ in rows]
        stops = [_Stop(mine, done) if done else mine for mine, done in zip(self._rows, complete, strict=True)]
        for mine, row in zip(self._rows, rows, strict=True):
            mine.extend(stops[t] for t in row)
        self._tails = [re.compile(f"{r.tail}*".encode()) for r in self.rules]

    def stops(self, data: bytes) -> list[tuple[int, tuple[int, ...]]]:
        """(place, rules): where the heads of which rules are complete. One step of the automaton a byte."""
        if not hasattr(self, "_rows"):
            self._prepare()
        out: list[tuple[int, tuple[int, ...]]] = []
        classes = data.translate(self._table)
        n, state, it = len(classes), self._rows[0], iter(classes)
        while True:
            try:
                for c in it:
                    state = state[c]
                if isinstance(state, _Stop):
                    out.append((n, state.complete))
                return out
            except IndexError:
                # The step after the stop has been read: the stop lies before it.
                out.append((n - it.__length_hint__() - 1, state.complete))
                state = state.row[c]

    def start(self, rule: int, data: bytes, end: int, floor: int) -> int | None:
        """The leftmost start, from floor on, of a head that ends at `end`."""
        table, rows, complete = self.back[rule]
        state, found, dead = 0, None, [not c and set(row) == {s} for s, (row, c) in enumerate(zip(rows, complete, strict=True))]
        for i in range(end - 1, floor - 1, -1):
            state = rows[state][table[data[i]]]
            if complete[state]:
                found = i
            elif dead[state]:
                break
        return found

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, by start and then rule."""
        data = (text or "").encode("utf-8", "surrogatepass")
        floors, out = [0] * len(self.rules), []
        for at, done in self.stops(data):
            for k in done:
                if at < floors[k]:
                    continue
                rule = self.rules[k]
                tail = at if rule.head else at - rule.least
                if tail < floors[k] or (end := self._tails[k].match(data, tail).end()) == tail:
                    continue
                start = self.start(k, data, at, floors[k]) if rule.head else tail
                if start is not None:
                    floors[k] = end
                    if end - tail >= rule.least:
                        out.append((start, end, k))
        if out and len(data) != len(text):
            places = sorted({p for a, b, _ in out for p in (a, b)})
            firsts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80  # the first bytes of characters
            counts = np.cumsum([np.count_nonzero(firsts[a:b]) for a, b in zip([0, *places], places, strict=False)]).tolist()
            point = dict(zip(places, counts, strict=True))
            out = [(point[a], point[b], k) for a, b, k in out]
        return sorted(out, key=lambda s: (s[0], s[2]))


class _Stop(list):
    """An empty row in the place of `row`, where the heads of some rules are complete."""

    def __init__(self, row: list, complete: tuple[int, ...]) -> None:
        self.row, self.complete = row, complete


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with `spans`: kind:start:end of every secret, comma-joined."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    @F.arrow_udf("string")
    def spans(texts: pa.Array) -> pa.Array:
        scanner = shared.value
        return pa.array([",".join(f"{scanner.rules[k].kind}:{a}:{b}" for a, b, k in scanner.spans(x.as_py())) for x in texts], pa.string())

    return docs.withColumn("spans", spans(F.col(text)))


def parts_of(spans: Column, kinds: tuple[str, ...]) -> Column:
    """The single spans of the given kinds."""
    return F.filter(F.split(spans, ","), lambda s: F.substring_index(s, ":", 1).isin(*kinds))
