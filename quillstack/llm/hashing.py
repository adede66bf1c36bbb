"""Vectorised word and window hashes over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: ASCII white space: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 20
_STEP = U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * _STEP)
_POWERS = np.cumprod(np.concatenate(([U(1)], np.full(4095, _STEP, dtype=U))), dtype=U)


def _powers(n: int) -> np.ndarray:
    if n <= len(_POWERS):
        return _POWERS
    return np.cumprod(np.concatenate(([U(1)], np.full(n - 1, _STEP, dtype=U))), dtype=U)


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space."""
    edge = np.diff(np.concatenate((np.zeros(1, np.int8), (~SPACE[b]).view(np.int8), np.zeros(1, np.int8))))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash_piece(b: np.ndarray) -> np.ndarray:
    starts, ends = word_bounds(b)
    if not len(starts):
        return np.zeros(0, U)
    size = ends - starts
    offset = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)[:-1]))
    at = np.arange(int(size.sum())) - np.repeat(offset, size)
    h = np.add.reduceat(BYTE[b[~SPACE[b]]] * _powers(int(size.max()))[at], offset)
    return mix(h + size.astype(U) * _STEP)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, worked off in pieces that end at white space."""
    b = np.frombuffer(data, np.uint8)
    if len(b) <= CHUNK:
        return _hash_piece(b)
    out, at = [], 0
    while at < len(b):
        end = min(at + CHUNK, len(b))
        while end < len(b):
            gap = np.flatnonzero(SPACE[b[end : end + CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + CHUNK, len(b))
        out.append(_hash_piece(b[at:end]))
        at = end
    return np.concatenate(out)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` consecutive words; empty if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for i in range(size):
        h *= _STEP
        h += words[i : i + n]
    return mix(h)


def sequence_hash(words: np.ndarray) -> int:
    """A hash of a whole sequence of words."""
    n = len(words)
    return int(mix(np.array([(words * _powers(n)[:n][::-1]).sum(dtype=U) + U(n)], U))[0]) if n else 0
