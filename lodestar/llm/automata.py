"""Regular expressions to minimal deterministic automata over bytes: parse, subset construction, minimisation."""

from __future__ import annotations

from collections.abc import Iterable
from re import _constants as sre
from re import _parser as sre_parser

N_BYTES = 256


class Nfa:
    """Byte transitions and empty transitions, built piece by piece; every piece has one start and one end."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def chars(self, allowed: Iterable[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.steps[a].append((frozenset(allowed), b))
        return a, b

    def chain(self, pieces: list[tuple[int, int]]) -> tuple[int, int]:
        if not pieces:
            s = self.state()
            return s, s
        for (_, end), (start, _) in zip(pieces, pieces[1:], strict=False):
            self.empty[end].append(start)
        return pieces[0][0], pieces[-1][1]

    def either(self, pieces: list[tuple[int, int]]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        for start, end in pieces:
            self.empty[a].append(start)
            self.empty[end].append(b)
        return a, b

    def add(self, tree: Iterable, ignore_case: bool = False) -> tuple[int, int]:
        """A parsed expression. ASCII only; no anchors, look-around or back references."""
        return self.chain([self._item(op, arg, ignore_case) for op, arg in tree])

    def _item(self, op: object, arg: object, ic: bool) -> tuple[int, int]:
        if op is sre.LITERAL:
            return self.chars(_cases([arg], ic))
        if op is sre.NOT_LITERAL:
            return self.chars(set(range(N_BYTES)) - _cases([arg], ic))
        if op is sre.IN:
            return self.chars(_members(arg, ic))
        if op is sre.BRANCH:
            return self.either([self.add(x, ic) for x in arg[1]])
        if op is sre.SUBPATTERN:
            _, on, off, tree = arg
            return self.add(tree, (ic or bool(on & sre.SRE_FLAG_IGNORECASE)) and not off & sre.SRE_FLAG_IGNORECASE)
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, tree = arg
            pieces = [self.add(tree, ic) for _ in range(low)]
            if high is sre.MAXREPEAT:
                start, end = self.add(tree, ic)
                a, b = self.state(), self.state()
                self.empty[a] += [start, b]
                self.empty[end] += [start, b]
                pieces.append((a, b))
            else:
                for _ in range(high - low):
                    start, end = self.add(tree, ic)
                    self.empty[start].append(end)
                    pieces.append((start, end))
            return self.chain(pieces)
        raise ValueError(f"not supported in a rule: {op}")

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _cases(codes: Iterable[int], ic: bool) -> set[int]:
    out = set(codes)
    return out | {ord(f(chr(c))) for c in out for f in (str.lower, str.upper) if chr(c).isascii()} if ic else out


def _members(items: Iterable, ic: bool) -> set[int]:
    items = list(items)
    out: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(arg)
        elif op is sre.RANGE:
            out.update(range(arg[0], arg[1] + 1))
        elif op is not sre.NEGATE:
            raise ValueError(f"not supported in a class: {op}")
    out = _cases(out, ic)
    return set(range(N_BYTES)) - out if items[0][0] is sre.NEGATE else out


def byte_classes(sets: Iterable[frozenset[int]]) -> tuple[bytes, list[int]]:
    """Bytes that no rule tells apart share a class: the map from byte to class, and one byte of each class."""
    sets = list(set(sets))
    seen: dict[tuple[bool, ...], int] = {}
    table = bytes(seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(N_BYTES))
    return table, [table.index(k) for k in range(len(seen))]


def compile_dfa(patterns: list[str], anywhere: bool = False, backwards: bool = False) -> tuple[bytes, list[list[int]], list[tuple[int, ...]]]:
    """(byte -> class, next state by state and class, numbers of the patterns that are complete in each state) of the minimal automaton.

    State 0 is the start. anywhere: a match may start at any byte; backwards: the automaton reads from a match's end to its start.
    """
    nfa = Nfa()
    pieces = [nfa.add(sre_parser.parse(p)) for p in patterns]
    if backwards:
        steps, empty = nfa.steps, nfa.empty
        nfa.steps, nfa.empty = [[] for _ in steps], [[] for _ in empty]
        for s, (moves, jumps) in enumerate(zip(steps, empty, strict=True)):
            for allowed, t in moves:
                nfa.steps[t].append((allowed, s))
            for t in jumps:
                nfa.empty[t].append(s)
        pieces = [(end, start) for start, end in pieces]
    table, sample = byte_classes(s for steps in nfa.steps for s, _ in steps)
    # Sets of automaton states are bit masks: what each state reaches by each class is worked out once.
    bits = lambda states: sum(1 << s for s in nfa.closure(states))
    reach = [[bits([t for allowed, t in steps if byte in allowed]) for byte in sample] for steps in nfa.steps]
    moving = [s for s, steps in enumerate(nfa.steps) if steps]
    first = bits([start for start, _ in pieces])
    ids, rows, complete, todo = {first: 0}, [], [], [first]
    for states in todo:
        complete.append(tuple(k for k, (_, end) in enumerate(pieces) if states >> end & 1))
        mine = [reach[s] for s in moving if states >> s & 1]
        row = []
        for k in range(len(sample)):
            to = first if anywhere else 0
            for r in mine:
                to |= r[k]
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        rows.append(row)
    return (table, *minimise(rows, complete))


def minimise(rows: list[list[int]], complete: list[tuple[int, ...]]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """Merge states that no input tells apart, by refining the partition until it is stable. The start stays 0."""
    first: dict[tuple[int, ...], int] = {}
    block = [first.setdefault(c, len(first)) for c in complete]
    while True:
        seen: dict[tuple[int, ...], int] = {}
        new = [seen.setdefault((block[s], *[block[t] for t in row]), len(seen)) for s, row in enumerate(rows)]
        if len(seen) == len(set(block)):
            break
        block = new
    of = {b: s for s, b in reversed(list(enumerate(new)))}
    return [[new[t] for t in rows[of[b]]] for b in range(len(of))], [complete[of[b]] for b in range(len(of))]
