"""Words and shingles of a text as 64-bit hashes, without an object for each word."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on unsigned 64-bit integers (shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(33))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


#: A random number for each byte value, and powers of a random odd base.
_BYTE = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * _M1))
_POWERS = np.multiply.accumulate(np.full(1 << 12, _M2 | np.uint64(1), dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.full(2 * n, _M2 | np.uint64(1), dtype=np.uint64))
    return _POWERS


_INVERSES = np.zeros(0, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """Powers, from 0 on, of the inverse of the base modulo 2^64."""
    global _INVERSES
    if n > len(_INVERSES):
        base = np.full(max(2 * n, 1 << 12), pow(int(_M2 | np.uint64(1)), -1, 1 << 64), dtype=np.uint64)
        base[0] = 1
        _INVERSES = np.multiply.accumulate(base)
    return _INVERSES


def sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each stretch of values; starts are ascending and stretches follow each other without gaps."""
    if not len(lengths):
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    return mixed(np.add.reduceat(values * powers(int(lengths.max()))[place], starts) ^ lengths.astype(np.uint64))


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch [start, end) of values; stretches may overlap."""
    n = len(values)
    sums_to = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(n)[:n], out=sums_to[1:])
    return mixed((sums_to[ends] - sums_to[starts]) * inverse_powers(n + 1)[starts] ^ (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word of a UTF-8 text; words end at ASCII white space."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = ~_BLANK[b]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    lengths = ends - starts
    return sums(_BYTE[b[inside[1:-1].view(bool)]], np.cumsum(lengths) - lengths, lengths), starts, ends


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mixed(out * _M1 + hashes[k : k + n])
    return out
