"""Content-chosen sample positions of a text (minimizers), for the suffix order of suffix_dedup."""

from __future__ import annotations

import numpy as np

from .common import BYTE_TABLE, mix

#: Bytes of an anchor's leading tokens.
K = 24
_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _gram(data: np.ndarray, length: int, shift: int = 0) -> np.ndarray:
    """Unmixed hash of the `length` bytes from each position, by doubling; the last length - 1 positions have none."""
    h, width, out, covered, i = BYTE_TABLE[data], 1, None, 0, 0
    left = length
    while True:
        if left & width:
            if out is None:
                out, covered = h, width
            else:
                n = len(data) - covered - width + 1
                out, covered = out[:n] * _A[(i + shift + 3) % 7] + h[covered : covered + n], covered + width
            left -= width
            if not left:
                return out
        n = len(h) - width
        if n <= 0:
            return h[:0]
        h = h[:n] * _A[(i + shift) % 7] + h[width:]
        width, i = width * 2, i + 1


def gram_hashes(data: np.ndarray, length: int, shift: int = 0) -> np.ndarray:
    return mix(_gram(data, length, shift)) if len(data) >= length else np.zeros(0, np.uint64)


def anchor_runs(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each text data[off[i]:off[i+1]], its windows of `length` bytes grouped by the leftmost smallest
    K-gram hash inside the window. Equal windows choose the same place, so windows that are equal share the
    hash. Returns per group: text, anchor position, first window, number of windows, hash."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    n = len(data)
    if n < length:
        return none
    h = _gram(data, K)
    # 32 bits of hash above the place: the smallest value is the leftmost of the smallest hashes
    value = h & np.uint64(0xFFFFFFFF00000000)
    value |= np.arange(len(h), dtype=np.uint64)
    grams, width = length - K + 1, 1
    while width < grams:
        step = min(width, grams - width)
        value = np.minimum(value[:-step], value[step:])
        width += step
    at = value.astype(np.uint32)
    lengths = np.diff(off)
    inside = np.zeros(len(at) + 1, np.int8)
    fits = lengths >= length
    np.add.at(inside, off[:-1][fits], 1)
    np.add.at(inside, off[1:][fits] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[1:] |= ~inside[:-1]
    start = np.flatnonzero(new & inside)
    if not len(start):
        return none
    owner = np.searchsorted(off, start, "right") - 1
    last = off[owner + 1] - length + 1
    count = np.minimum(np.append(start[1:], len(at)), last) - start
    return owner, at[start].astype(np.int64), start, count, mix(h[at[start]])
