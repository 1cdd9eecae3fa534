"""Brute-force versions of the operators, in plain Python over small lists."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def secrets(text: str | None) -> list[tuple[int, int, str]]:
    rules = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    ]
    found = [(m.start(), m.end(), i) for i, (_, r, g, n) in enumerate(rules) for m in re.finditer(r, text or "") if len(m[g]) >= n]
    return [(a, b, rules[i][0]) for a, b, i in sorted(found, key=lambda x: (x[0], x[2]))]


def shingle_set(text: str | None, width: int = 4) -> frozenset:
    words = WORD.findall(lower(text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard_components(docs: list[tuple[int, str | None]], percent: int = 85, width: int = 4) -> list[tuple[int, int, int]]:
    sets = [shingle_set(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)]


def repeated_bytes(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return out


def dedup_lines(docs: list[tuple[int, str | None]], min_words: int) -> list[str | None]:
    """Every run of lines with min_words words that starts earlier too loses its later copies; docs are in order and distinct."""
    lines = [[(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for _, t in docs]
    first: dict[tuple[str, ...], tuple[int, int]] = {}
    gone = [set() for _ in docs]
    for d, mine in enumerate(lines):
        for a in range(len(mine)):
            words = 0
            for b in range(a, len(mine)):
                words += len(WORD.findall(mine[b][1]))
                if words >= min_words:
                    run = tuple(x for _, x in mine[a : b + 1])
                    if first.setdefault(run, (d, a)) != (d, a):
                        gone[d].update(i for i, _ in mine[a : b + 1])
    return [t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, (_, t) in enumerate(docs)]


def decontaminate(text: str | None, items: list[tuple[str | None, str | None]]) -> tuple[int, int, list[str]]:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(lower(text or ""))
    places = defaultdict(list)
    windows = defaultdict(set)
    for item, t in items:
        w = word.findall(lower(t or ""))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            places[tuple(words[i : i + n])].append(i)
    hit, found = set(), set()
    for w, owners in windows.items():
        for i in places.get(w, ()):
            hit.update(range(i, i + len(w)))
            found |= owners - {None}
    return len(words), len(hit), sorted(found)
