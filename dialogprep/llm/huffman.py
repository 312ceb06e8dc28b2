"""Canonical length-limited Huffman codes, coded and decoded with array operations."""

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the best prefix code in which no code has more than ``limit`` bits.

    Package-merge: at each of ``limit`` levels the packages of the level below
    (pairs of neighbours in order of weight) are merged with the symbols; a
    symbol's length is how often it is part of the first ``2 n - 2`` entries.
    A symbol that never occurs has length 0.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    below, levels = np.zeros(0), []
    for _ in range(limit):
        merged = np.concatenate([weights, below])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))  # which entries are symbols
        merged = merged[order]
        below = merged[0:len(merged) // 2 * 2:2] + merged[1::2]
    taken, depth = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:taken].sum())
        depth[:symbols] += 1
        taken = 2 * (taken - symbols)
    lengths[used] = depth
    return lengths


class Code:
    """A canonical code: codes of one length are consecutive, in the order of symbols."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.limit = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = np.uint64(1) << (self.limit - lengths[order]).astype(np.uint64)
        starts = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.uint64)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = starts >> (self.limit - lengths[order]).astype(np.uint64)
        # by the next bits: the symbol and the length of its code
        self._next = np.full(1 << self.limit, 1, np.uint32)
        both = order.astype(np.uint32) << np.uint32(5) | lengths[order].astype(np.uint32)
        self._next[:int(spans.sum())] = np.repeat(both, spans.astype(np.int64))

    def encode(self, symbols: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of each ``every``-th symbol), most significant bit first."""
        if not len(symbols):
            return b"", np.zeros(0, np.int64)
        lengths, codes = self.lengths[symbols].astype(np.int64), self.codes[symbols]
        if not lengths.all():
            raise ValueError("a symbol has no code")
        ends = np.cumsum(lengths)
        starts = ends - lengths
        word, room = starts >> 6, 64 - (starts & 63)
        over = np.maximum(lengths - room, 0).astype(np.uint64)  # bits in the next word
        left = np.maximum(room - lengths, 0).astype(np.uint64)
        words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.add.reduceat((codes >> over) << left, first)
        split = np.flatnonzero(over)  # at most one symbol begins the word after another
        words[word[split] + 1] |= codes[split] << (np.uint64(64) - over[split])
        return words.astype(">u8").tobytes()[:int(ends[-1] + 7) >> 3], starts[::every]

    def decode(self, bits: bytes, offsets: np.ndarray, n: int, every: int) -> np.ndarray:
        """The ``n`` symbols; all stretches between offsets are decoded side by side."""
        out = np.empty((len(offsets), every), np.uint32)
        data = np.frombuffer(bits + bytes(-len(bits) % 4 + 12), ">u4").astype(np.uint64)
        pairs = (data[:-1] << np.uint64(32)) | data[1:]
        at, drop = offsets.astype(np.int64), np.uint64(64 - self.limit)
        last = len(pairs) - 1
        for step in range(min(every, n)):
            window = pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)
            found = self._next[window >> drop]
            out[:, step] = found
            at += found & np.uint32(31)
        return (out >> np.uint32(5)).reshape(-1)[:n]
