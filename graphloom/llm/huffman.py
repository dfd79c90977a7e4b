"""Canonical length-limited Huffman codes over token ids, with checkpointed independent blocks."""

from __future__ import annotations

import numpy as np

#: A bit offset is kept for every so many ids of a block.
STRIDE = 256
#: Ids that are coded at a time; a multiple of STRIDE.
CHUNK = 1 << 14


def code_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur.

    Ties go to the smaller id. A single id gets one bit; the limit is raised where it can't hold all ids.
    """
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves, n = counts[order], len(order)
    levels, packages = [], np.zeros(0, dtype=np.int64)
    for _ in range(limit):
        both = np.concatenate([leaves, packages])
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        both = both[place]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, lengths = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for level in reversed(levels):
        leaf = int(level[:take].sum())
        lengths[:leaf] += 1
        take = 2 * (take - leaf)
    out[order] = lengths
    return out


class Codebook:
    """Codes fixed by the lengths alone: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype=np.uint8)
        self.bits = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        spans = np.left_shift(1, self.bits - self.lengths[order].astype(np.int64))
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(self.lengths), dtype=np.uint64)
        self.codes[order] = (starts >> (self.bits - self.lengths[order].astype(np.int64))).astype(np.uint64)
        self.symbol = np.zeros(1 << self.bits, dtype=np.uint32)
        self.symbol[: int(spans.sum())] = np.repeat(order, spans)
        self.taken = np.zeros(1 << self.bits, dtype=np.uint8)
        self.taken[: int(spans.sum())] = np.repeat(self.lengths[order], spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, and the bit offset of every STRIDE-th id."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.int64)
        checkpoints = np.zeros(-(-len(ids) // STRIDE), dtype=np.int64)
        words = np.zeros((len(ids) * self.bits >> 5) + 3, dtype=np.float64)
        bit = 0
        for at in range(0, len(ids), CHUNK):  # chunks keep the working arrays in the processor's cache
            part = ids[at : at + CHUNK]
            lengths = self.lengths[part].astype(np.int64)
            if not lengths.all():
                raise ValueError("an id without a code")
            ends = np.cumsum(lengths)
            start = ends - lengths + (bit & 31)
            value = self.codes[part] << (64 - lengths - (start & 31)).astype(np.uint64)
            word, first = start >> 5, bit >> 5
            size = int(word[-1]) + 2
            words[first : first + size] += np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
            words[first + 1 : first + 1 + size] += np.bincount(word, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
            checkpoints[at // STRIDE : at // STRIDE + -(-len(part) // STRIDE)] = start[::STRIDE] - (bit & 31) + bit
            bit += int(ends[-1])
        return words[: (bit + 31 >> 5) + 1].astype(np.uint64).astype(">u4").tobytes(), checkpoints

    def decode(self, payload: bytes, n: int, checkpoints: np.ndarray) -> np.ndarray:
        """All stretches between checkpoints advance together, one id each a step."""
        if not n:
            return np.zeros(0, dtype=np.uint32)
        words = np.concatenate([np.frombuffer(payload, dtype=">u4").astype(np.uint64), np.zeros(2, dtype=np.uint64)])
        at = np.asarray(checkpoints, dtype=np.int64).copy()
        out = np.zeros((STRIDE, len(at)), dtype=np.uint32)
        drop = np.uint64(64 - self.bits)
        last = len(words) - 2
        for k in range(min(STRIDE, n)):
            word = np.minimum(at >> 5, last)
            window = (words[word] << np.uint64(32) | words[word + 1]) << (at & 31).astype(np.uint64) >> drop
            window = window.astype(np.int64)
            out[k] = self.symbol[window]
            at += self.taken[window]
        return out.T.reshape(-1)[:n]
