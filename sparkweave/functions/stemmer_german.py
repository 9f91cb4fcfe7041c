"""The German (Snowball) stemming algorithm, from its published description."""

from __future__ import annotations

import functools

# Fixed values of the published algorithm.
VOWELS = "aeiouyäöü"
S_ENDINGS = "bdfghklmnrt"
ST_ENDINGS = "bdfghklmnt"


def _region(word: str, start: int) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _longest(word: str, endings: tuple[str, ...]) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


@functools.lru_cache(maxsize=200_000)
def stem_german(word: str) -> str:
    """The stem of a lower-case word."""
    w = word.replace("ß", "ss")
    # u and y between vowels are consonants
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in VOWELS and w[i + 1] in VOWELS else c for i, c in enumerate(w))
    first = _region(w, 0)
    r2 = _region(w, first)
    r1 = max(first, 3)

    end = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    at = len(w) - len(end)
    if end and at >= r1:
        if end in ("em", "ern", "er"):
            w = w[:at]
        elif end == "s":
            if w[at - 1] in S_ENDINGS:
                w = w[:at]
        else:
            w = w[:at]
            if w.endswith("niss"):
                w = w[:-1]

    end = _longest(w, ("en", "er", "est", "st"))
    at = len(w) - len(end)
    if end and at >= r1 and (end != "st" or at >= 4 and w[at - 1] in ST_ENDINGS):
        w = w[:at]

    end = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    at = len(w) - len(end)
    if end and at >= r2:
        if end in ("end", "ung"):
            w = w[:at]
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            if w[at - 1 : at] != "e":
                w = w[:at]
        elif end in ("lich", "heit"):
            w = w[:at]
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = w[:at]
            inner = _longest(w, ("lich", "ig"))
            if inner and len(w) - len(inner) >= r2:
                w = w[: -len(inner)]
    return w.lower().replace("ä", "a").replace("ö", "o").replace("ü", "u")
