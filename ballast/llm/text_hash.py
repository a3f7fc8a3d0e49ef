"""Hashes of the words of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

#: Text bytes hashed at once.
CHUNK = 1 << 18

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20))
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_byte[32] = 0
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps))
        _powers = tuple(tables)
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the place where it begins; words lie between spaces."""
    codes = np.frombuffer(data, np.uint8)
    powers, inverse = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_byte[codes] * powers[: len(codes)], out=sums[1:])
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = codes != 32
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _slices(data: bytes):
    """The text in slices of about CHUNK bytes that end at spaces."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def word_arrays(texts: list[str | None], table: bytes, prepare=str):
    """The word hashes of every text, in order; ``table`` maps bytes, separators to the space."""
    held, size = [], 0

    def flush():
        words, starts = word_hashes(b" ".join(held))
        begins = np.cumsum([0] + [len(h) + 1 for h in held])
        cuts = np.searchsorted(starts, begins)
        for k in range(len(held)):
            yield words[cuts[k] : cuts[k + 1]]

    for text in texts:
        data = prepare(text or "").encode("utf-8", "surrogatepass").translate(table)
        if len(data) > CHUNK:
            if held:
                yield from flush()
                held, size = [], 0
            yield np.concatenate([word_hashes(s)[0] for s in _slices(data)])
            continue
        held.append(data)
        size += len(data)
        if size >= CHUNK:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()
