"""Format-preserving Feistel pseudonyms (operator 3).

Personal values are found by pattern and then validated: payment cards (13-19 digits in whole groups with a true Luhn
digit, also where further groups, such as an expiry date, stand beside), IBANs (of the countries of IBAN_LENGTH, with true
check digits), phone numbers (North American, valid area and exchange), social security numbers, public IPv4 addresses, dates
from 1900-01-01 to 2099-12-31 that exist, and e-mail addresses. Each is replaced by a keyed permutation of its own domain,
a balanced Feistel network of ROUNDS rounds; results out of the domain are permuted again until they are in it (cycle
walking), which keeps it a permutation. A card keeps its first digit and stays Luhn-valid, an IBAN its country and valid; a
date stays a date whose day and month have as many digits; signs and spacing stay. The permutation works on the value, not
the spelling, so equal values stay linked across documents and formats, and the holder of the key can turn them back
(`inverse`). A date with slashes is read month first, or day first where the first number is over 12 (its pseudonym's is then
too). Where a card's neighbour digits allow another reading of its pseudonym it is permuted again, so that it turns back, but
isn't linked there; where several values stand in one run of digits, the inverse may rarely read the run otherwise (5 of 3,000
random runs).

Defined cases: a null text stays null and an empty one empty; values that don't validate are left alone; repeated rows
get the same pseudonyms; long texts are read whole, and long local parts of addresses CHUNK characters at a time; other columns
are kept, whatever their names, but for `found`, which is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date
from functools import cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import fresh

ROUNDS = 10
#: Characters of an e-mail's local part that are permuted as one value.
CHUNK = 64
# The number of characters of an IBAN, by country.
IBAN_LENGTH = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26,
    "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-]))
    |(?P<iso>(?<![\w.-])(?:19|20)\d\d-[01]\d-[0-3]\d(?![\w-]))
    |(?P<iban>(?<![\w-])[A-Z]{2}\d\d(?=(?:\x20?[A-Z0-9]){11}))
    |(?P<us>(?<![\w./])[0-3]?\d/[0-3]?\d/(?:19|20)\d\d(?![\w/]))
    |(?P<dotted>(?<![\w.])[0-3]?\d\.[01]?\d\.(?:19|20)\d\d(?!\w|\.\d))
    |(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))
    |(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))
    |(?P<phone>(?<![\w+(])(?:\+?1[\x20.-]?)?(?:\(\d{3}\)\x20?|\d{3}[\x20.-])\d{3}[\x20.-]\d{4}(?!\w|[.-]\d))
    |(?P<card>(?<![\w.-])\d(?:[\x20-]?\d){12,60}(?!\w))""",
    re.VERBOSE | re.ASCII,
)
GROUP = re.compile(r"\d+")
#: How cards are commonly written, as digits of each group; these are tried before other runs of groups.
SPELLINGS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), *((n,) for n in range(13, 20))}
KINDS = ("email", "date", "ip", "ssn", "phone", "card", "iban")


class Permutation:
    """A keyed permutation of 0..size-1 and its inverse; the tweak keeps domains apart."""

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.size, self.side = size, isqrt(max(size - 1, 1)) + 1
        bits = self.side.bit_length() + 64  # so many that the remainder is even to one part in 2^64
        self.blocks = -(-bits // 512)
        self.hash = hashlib.blake2b(tweak.encode(), key=key, digest_size=16 if bits <= 128 else 64)

    def _f(self, i: int, half: int) -> int:
        out = b""
        for k in range(self.blocks):
            h = self.hash.copy()
            h.update(b"%d:%d" % (i, half) if k == 0 else b"%d:%d:%d" % (i, half, k))
            out += h.digest()
        return int.from_bytes(out, "big") % self.side

    def __call__(self, value: int) -> int:
        while True:
            a, b = divmod(value, self.side)
            for i in range(ROUNDS):
                a, b = b, (a + self._f(i, b)) % self.side
            value = a * self.side + b
            if value < self.size:
                return value

    def inverse(self, value: int) -> int:
        while True:
            a, b = divmod(value, self.side)
            for i in reversed(range(ROUNDS)):
                a, b = (b - self._f(i, a)) % self.side, a
            value = a * self.side + b
            if value < self.size:
                return value


@cache
def days() -> tuple[dict[date, tuple[int, int]], list[list[date]]]:
    """The class and place in it of every day, and the days of each class: those whose month and day have as many digits, days over 12 apart."""
    classes: list[list[date]] = [[] for _ in range(6)]
    at = {}
    for n in range(date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() + 1):
        d = date.fromordinal(n)
        k = (d.month > 9) * 3 + (d.day > 9) + (d.day > 12)
        at[d] = k, len(classes[k])
        classes[k].append(d)
    return at, classes


def shape_of(text: str) -> str:
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text)))


def permuted(text: str, shape: str, step: Callable[[int], Callable[[int], int]]) -> str:
    """text with its letters and digits permuted within their kinds as one number; step(size) is the permutation."""
    size, value = 1, 0
    radix = [10 if c == "0" else 26 if c in "aA" else 1 for c in shape]
    for c, s, r in zip(text, shape, radix, strict=True):
        size, value = size * r, value * r + (ord(c) - ord(s) if r > 1 else 0)
    value, out = step(size)(value), []
    for c, s, r in zip(reversed(text), reversed(shape), reversed(radix), strict=True):
        value, at = divmod(value, r)
        out.append(chr(ord(s) + at) if r > 1 else c)
    return "".join(reversed(out))


def iban_check(country: str, body: str) -> str:
    """The check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}"


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + it valid."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn_digit(digits[:-1]) == digits[-1]


def card_at(text: str, start: int, end: int) -> tuple[int, int] | None:
    """Where a card is among the groups of digits from start on that hold at most 19: whole groups, 13 to 19 digits, a true Luhn digit.

    Common spellings come first, then groups that no hyphen joins to further digits, then longer ones, then those further left.
    """
    groups, n, found = [], 0, []
    for m in GROUP.finditer(text, start, end):
        n += m.end() - m.start()
        if n > 19:
            break
        groups.append(m.span())
    for i in range(len(groups)):
        sizes: tuple[int, ...] = ()
        for a, b in groups[i:]:
            sizes += (b - a,)
            if sum(sizes) >= 13 and not (text[b : b + 1] == "." and text[b + 1 : b + 2].isdigit()):
                joined = i > 0 and text[groups[i][0] - 1] == "-" or text[b : b + 1] == "-" and text[b + 1 : b + 2].isdigit()
                found.append((sizes not in SPELLINGS, joined, -sum(sizes), groups[i][0], b))
    return next(((a, b) for *_, a, b in sorted(found) if is_card(re.sub(r"\D", "", text[a:b]))), None)


def _walk(step: Callable[[int], int], value: int, valid: Callable[[int], bool]) -> int:
    value = step(value)
    while not valid(value):
        value = step(value)
    return value


def _phone_ok(n: int) -> bool:
    return n >= 2_000_000_000 and n // 10_000 % 1000 >= 200


def _ssn_ok(n: int) -> bool:
    area = n // 1_000_000
    return 0 < area < 900 and area != 666 and n // 10_000 % 100 > 0 and n % 10_000 > 0


def _ip_ok(n: int) -> bool:
    a, b = n >> 24, n >> 16 & 255
    return 0 < a < 224 and a not in (10, 127) and (a, b) not in ((192, 168), (169, 254)) and not (a == 172 and 16 <= b < 32)


class Pseudonyms:
    """Pseudonyms under one key; inverse=True turns them back."""

    def __init__(self, key: bytes, inverse: bool = False) -> None:
        self.key, self.back, self.made = key, inverse, {}

    def step(self, tweak: str, size: int) -> Callable[[int], int]:
        p = self.made.get((tweak, size)) or self.made.setdefault((tweak, size), Permutation(self.key, tweak, size))
        return p.inverse if self.back else p

    def _spell(self, found: str, digits: str) -> str:
        """found with its digits replaced in order."""
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in found)

    def card(self, text: str, a: int, b: int, windows: list[tuple[int, int]]) -> str:
        """The card at a..b; permuted again until the windows, of which the last alone holds it, show it in the new text too, so that the inverse finds it."""
        d = re.sub(r"\D", "", text[a:b])
        n = len(d) - 2
        step = self.step(f"card {d[0]}", 10**n)
        low, high = max(windows[0][0] - 1, 0), windows[-1][1] + 2

        def spelled(value: int) -> str:
            new = d[0] + str(value).zfill(n)
            return self._spell(text[a:b], new + luhn_digit(new))

        def same(value: int) -> bool:
            near = text[low:a] + spelled(value) + text[b:high]
            *passed, held = [card_at(near, x - low, y - low) for x, y in windows]
            return not any(passed) and held == (a - low, b - low)

        return spelled(_walk(step, int(d[1:-1]), same))

    def phone(self, found: str) -> str | None:
        d = re.sub(r"\D", "", found)
        local, lead = int(d[-10:]), d[:-10]
        return self._spell(found, lead + str(_walk(self.step("phone", 10**10), local, _phone_ok))) if _phone_ok(local) else None

    def ssn(self, found: str) -> str | None:
        n = int(found.replace("-", ""))
        return self._spell(found, str(_walk(self.step("ssn", 10**9), n, _ssn_ok)).zfill(9)) if _ssn_ok(n) else None

    def ip(self, found: str) -> str | None:
        parts = [int(x) for x in found.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
            return None
        n = int.from_bytes(bytes(parts), "big")
        return ".".join(map(str, _walk(self.step("ip", 1 << 32), n, _ip_ok).to_bytes(4, "big"))) if _ip_ok(n) else None

    def dated(self, found: str, year: int, month: int, day: int) -> str | None:
        """found with another day; year, month and day say which of its numbers is which."""
        parts = re.split(r"(\D)", found)
        y, m, d = (int(parts[2 * i]) for i in (year, month, day))
        at, classes = days()
        try:
            k, n = at[date(y, m, d)]
        except (ValueError, KeyError):
            return None
        new = classes[k][self.step(f"date {k}", len(classes[k]))(n)]
        for i, v in ((year, new.year), (month, new.month), (day, new.day)):
            parts[2 * i] = str(v).zfill(len(parts[2 * i]))
        return "".join(parts)

    def iso(self, found: str) -> str | None:
        return self.dated(found, 0, 1, 2)

    def us(self, found: str) -> str | None:
        return self.dated(found, 2, 1, 0) if int(found.split("/")[0]) > 12 else self.dated(found, 2, 0, 1)

    def dotted(self, found: str) -> str | None:
        return self.dated(found, 2, 1, 0)

    def iban(self, text: str, start: int) -> tuple[int, str] | None:
        """The end of an IBAN that starts there, single spaces between its characters, and its pseudonym."""
        left, end = IBAN_LENGTH.get(text[start : start + 2], 0), start
        if not left:
            return None
        while left and end < len(text):
            if not (text[end].isascii() and (text[end].isdigit() or text[end].isupper())) and (text[end] != " " or text[end - 1] == " "):
                return None
            left -= text[end] != " "
            end += 1
        if left or re.match(r"\w", text[end : end + 1]):
            return None
        found = text[start:end].replace(" ", "")
        country, check, body = found[:2], found[2:4], found[4:]
        if iban_check(country, body) != check:
            return None
        shape = shape_of(body)
        new = permuted(body, shape, lambda size: self.step(f"iban {country} {shape}", size))
        it = iter(country + iban_check(country, new) + new)
        return end, "".join(c if c == " " else next(it) for c in text[start:end])

    def email(self, found: str) -> str:
        """Letters and digits of the local part are permuted within their kind; case, signs and the domain stay."""
        local, _, domain = found.partition("@")
        shape, out = shape_of(local), []
        for k in range(0, len(local), CHUNK):
            part = shape[k : k + CHUNK]
            tweak = f"email {part}@{domain.lower()}" + (f" {k}" if k else "")
            out.append(permuted(local[k : k + CHUNK], part, lambda size, tweak=tweak: self.step(tweak, size)))
        return f"{''.join(out)}@{domain}"

    def replace(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of what was replaced, as places in the input."""
        found, out, done, at = [], [], 0, 0
        passed: list[tuple[int, int]] = []  # windows without a card

        def put(kind: str, start: int, end: int, new: str) -> None:
            nonlocal done
            out.extend((text[done:start], new))
            found.append((kind, start, end))
            done = end

        while m := PATTERN.search(text, at):
            kind, start, at = m.lastgroup, m.start(), m.end()
            if kind == "iban":
                if near := self.iban(text, start):
                    put(kind, start, *near)
                    at = near[0]
                continue
            if kind != "card":
                new = getattr(self, kind)(m[0])
                if new is not None:
                    put("date" if kind in ("iso", "us", "dotted") else kind, start, at, new)
                continue
            while True:
                near = card_at(text, start, m.end())
                passed = [w for w in passed[-18:] if w[1] > start]
                passed.append((start, m.end()))
                if near:
                    put("card", *near, self.card(text, *near, passed))
                    passed = []
                # A card may start at the next group; the search finds it itself, and other kinds, unless a hyphen is before it.
                at = near[1] if near else GROUP.match(text, start).end()
                start = at + 1
                if at >= m.end() or text[at] != "-" or PATTERN.match(text, start):
                    break
        return "".join([*out, text[done:]]), found


def pseudonymize(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """docs with pseudonyms in text, and `found`: kind, start, end of every value replaced (places in the input)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("text", pa.string()), ("found", pa.list_(span))])

    @F.arrow_udf("struct<text:string,found:array<struct<kind:string,start:int,end:int>>>")
    def replaced(texts: pa.Array) -> pa.Array:
        names = Pseudonyms(key, inverse)
        out = []
        for x in texts:
            text = x.as_py()
            new, found = names.replace(text) if text is not None else (None, [])
            out.append({"text": new, "found": [{"kind": k, "start": a, "end": b} for k, a, b in found]})
        return pa.array(out, kind)

    (new,) = fresh(docs, "new")
    return docs.withColumn(new, replaced("text")).withColumns({"text": F.col(f"{new}.text"), "found": F.col(f"{new}.found")}).drop(new)
