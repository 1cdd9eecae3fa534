"""Cards beside other digits."""

from __future__ import annotations

import random
import re

import pytest

from lodestar.llm import pii

CARDS = ("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "5500 0000 0000 0004")


@pytest.mark.parametrize("card", CARDS)
@pytest.mark.parametrize("around", ["{} 05/27", "{} 123", "{}-123", "{} 05/27 123", "{} 0527 123", "ref 12 {}", "12-{}", "2024 {}", "2024-{}-0527-99", "{} 123456", "1 2 3 {} 4 5 6"])
def test_cards_beside_digits(card: str, around: str) -> None:
    text = around.format(card)
    new, found = pii.Pseudonyms(b"key").replace(text)
    a = text.index(card)
    assert found == [("card", a, a + len(card))] and new[a : a + len(card)] != card
    assert pii.Pseudonyms(b"key", inverse=True).replace(new)[0] == text


def test_values_after_a_failed_run() -> None:
    new, found = pii.Pseudonyms(b"key").replace("1234 212-555-0100 and 4111-1111-1111-1111-5500-0000-0000-0004 and 4111 1111 1111 1111 05/27/2026")
    assert [k for k, _, _ in found] == ["phone", "card", "card", "card", "date"]


def test_cards_among_random_digits_turn_back() -> None:
    rng = random.Random(4)
    wrong = 0
    for _ in range(3000):
        groups = ["".join(rng.choice("0123456789") for _ in range(rng.choice((1, 2, 3, 4, 4, 4, 6, 10)))) for _ in range(rng.randint(0, 5))]
        groups.insert(rng.randint(0, len(groups)), rng.choice(CARDS))
        text = "".join(g + rng.choice(" -") for g in groups) + "end"
        new, found = pii.Pseudonyms(b"key").replace(text)
        assert len(new) == len(text) and re.sub(r"\d", "", new) == re.sub(r"\d", "", text)
        wrong += pii.Pseudonyms(b"key", inverse=True).replace(new)[0] != text
    assert wrong <= 10  # phones and cards that make an earlier run valid
