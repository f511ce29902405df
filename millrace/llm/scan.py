"""Vectorised reading of Arrow text columns: words, word hashes and shingles without Python strings.

A word is a run of ``[^\\x20\\x09-\\x0D]+`` in the UTF-8 bytes. Texts are read whole, in slices of rows
of about SLICE bytes; a longer text is hashed piecewise, so memory stays in proportion to a slice
(or to the longest single text, at 8 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between the terms of a text: all of ASCII but letters, digits and the underscore.
_GAP = np.zeros(256, bool)
_GAP[:128] = [not (chr(x).isalnum() or x == 95) for x in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower-case letters as they are, all other ASCII as a space.
LOWERED = np.where(_GAP | (np.arange(256) == 95) | ((np.arange(256) >= 48) & (np.arange(256) < 58)), 32, _LOWER).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n keyed 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15))


_BYTE = stream(7, 256)
_BASE = int(stream(11, 1)[0]) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _STEP + 1), _powers(_INVERSE, _STEP + 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(offsets: np.ndarray, data: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of all words; words of row i are first[i]:first[i + 1].

    offsets: of the rows of one slice; positions are relative to data.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    solid = ~gap[data[low:high]]
    edge = np.ones(len(solid) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    inner = offsets[1:-1] - low
    edge[inner] = True  # a row's end parts words also where no space stands
    at = np.flatnonzero(edge)
    first, last = at[:-1], at[1:]
    take = solid[first] & (last > first) if len(first) else np.zeros(0, bool)
    starts, ends = first[take] + low, last[take] + low
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word: a polynomial with byte weights, taken from prefix sums, then mixed."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        i = 0
        while i < len(starts):
            low = int(starts[i])
            k = int(np.searchsorted(ends, low + _STEP, "right"))
            if k <= i:  # one word longer than a step: fold it block by block
                total, at, place = _U(0), low, 1
                while at < ends[i]:
                    block = data[at : min(at + _STEP, int(ends[i]))]
                    v = _BYTE[_LOWER[block] if lower else block]
                    total = total + (v * _POW[: len(v)]).sum(dtype=np.uint64) * _U(place)
                    place = place * pow(_BASE, len(block), 1 << 64) % (1 << 64)
                    at += len(block)
                out[i] = total
                i += 1
                continue
            block = data[low : int(ends[k - 1])]
            v = _BYTE[_LOWER[block] if lower else block]
            sums = np.zeros(len(v) + 1, np.uint64)
            np.cumsum(v * _POW[: len(v)], out=sums[1:])
            s, e = starts[i:k] - low, ends[i:k] - low
            out[i:k] = (sums[e] - sums[s]) * _INV[s]
            i = k
        return mix(out + (ends - starts).astype(np.uint64))


_PLACE = stream(13, 16) | _U(1)


def terms(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words(), for runs of letters and digits (every byte beyond ASCII is a letter here)."""
    return words(offsets, data, _GAP)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (the caller drops runs that cross rows)."""
    n = max(0, len(h) - width + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total += mix(h[j : j + n] * _PLACE[j])
        return mix(total)


def shingle_sets(h: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row: its sorted distinct shingles; fewer words than width: the whole row as one; no word: none."""
    grams, out = windows(h, width), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(windows(h[a:b], b - a) ^ _PLACE[b - a])
        else:
            out.append(h[:0])
    return out
