"""Hashes of words and terms, for many texts in one sweep over their bytes.

A run is a maximal stretch of bytes that belong to words (or terms); all bytes beyond ASCII do. Its hash is a polynomial
over a random number per byte, A-Z read as a-z: the sums of one sweep give every run's hash by a subtraction, wherever
the run stands. So texts need no Python object per word. 64-bit hashes stand for the runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tableloom.llm.words import mix

SWEEP = 1 << 20  # bytes of texts handled at a time
_BASE = 0x9E3779B97F4A7C13  # odd, so it has an inverse modulo 2 ** 64
_CODES = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class _Powers:
    """Powers of the base and of its inverse; as many as the longest sweep asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < size:
            steps = np.ones(max(size, SWEEP), np.uint64)
            steps[1:] = _BASE
            cls.up = np.cumprod(steps)
            steps[1:] = pow(_BASE, -1, 1 << 64)
            cls.down = np.cumprod(steps)
        return cls.up[:size], cls.down[:size]


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the runs ``[start, end)``; swept in parts that begin and end between runs."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SWEEP, "right")))
        low, high = starts[at], ends[to - 1]
        up, down = _Powers.of(int(high - low))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_CODES[data[low:high]] * up, out=total[1:])
        first, last = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
        at = to
    return out


def run_hashes(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' runs, one after the other, and where each text's begin (one more entry at the end)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    within = np.zeros(len(data) + 1, bool)
    within[1:] = inside[data]
    edges = np.flatnonzero(within[1:] != within[:-1])  # a separator follows every text, so edges come in pairs
    starts, ends = edges[::2], edges[1::2]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return _hashes(data, starts, ends), np.searchsorted(starts, bounds)


def sweeps(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """A batch's texts as UTF-8 in parts of about ``SWEEP`` bytes, each with the row it starts at; NULL reads as empty."""
    start, part, size = 0, [], 0
    for row, x in enumerate(column.cast(pa.binary())):
        part.append(x.as_py() or b"")
        size += len(part[-1])
        if size >= SWEEP:
            yield start, part
            start, part, size = row + 1, [], 0
    if part:
        yield start, part


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of ``width`` words in a row; fewer words are one shingle, no words none."""
    words, bounds = run_hashes(texts, WORD)
    code = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for k in range(width):
        code = mix(code + words[k : len(code) + k])
    out = []
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        if high - low >= width or high == low:
            out.append(np.unique(code[low : max(low, high - width + 1)]))
            continue
        short = np.full(1, high - low, np.uint64)
        for word in words[low:high]:
            short = mix(short + word)
        out.append(short)
    return out
