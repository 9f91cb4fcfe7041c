"""What the stemmers of Romance languages share: regions of a word, and the longest of some endings."""

from __future__ import annotations

from collections.abc import Iterable


def after_vowel_and_consonant(word: str, vowels: frozenset[str], start: int) -> int:
    """The place after the first consonant that follows a vowel, from start on; the word's length if there is none."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def standard_regions(word: str, vowels: frozenset[str]) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    r1 = after_vowel_and_consonant(word, vowels, 0)
    return r1, after_vowel_and_consonant(word, vowels, r1)


def longest(word: str, endings: Iterable[str]) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)
