"""Weighted acyclic automata over word sequences of bounded length, held as arrays.

An automaton accepts sequences of exactly ``DEPTH`` symbols and gives each a
weight. States lie in levels; the edges of a level are stored side by side, in
the order of their states and then of their symbols, each with the number of
edges that leave the state it enters. The weight of a prefix is the sum of what
lies behind it, so the counts of all shorter sequences need no states of their
own.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dialogprep.llm.common import text_bytes

DEPTH = 4
# Stands behind the last word of a sequence that is shorter; sorts before all words.
END = -1


def _order(symbols: np.ndarray) -> np.ndarray:
    """Rows in the order of their symbols, two columns of 32 bits compared at once."""
    first, second = (
        (symbols[d].astype(np.int64) + 1) << 32 | (symbols[d + 1].astype(np.int64) + 1) for d in (0, 2))
    return np.lexsort((second, first))


@dataclass
class Automaton:
    """``symbols[d]`` and ``leaving[d]`` of the edges of level ``d``; weights of the last level."""

    symbols: list[np.ndarray]
    leaving: list[np.ndarray]
    weights: np.ndarray

    @classmethod
    def of(cls, sequences: np.ndarray, weights: np.ndarray, ordered: bool = False) -> "Automaton":
        """Built from (DEPTH, n) symbols; weights of equal sequences are summed.

        In sorted order a sequence adds edges from the first place on where it
        differs from the one before, as when sequences are added one by one.
        """
        if not ordered:
            order = _order(sequences)
            sequences, weights = sequences[:, order], weights[order]
        n = len(weights)
        new = np.zeros(n, bool)
        new[:1] = True
        symbols, added = [], []
        for column in sequences:
            new[1:] |= column[1:] != column[:-1]
            places = np.flatnonzero(new)
            symbols.append(column[places])
            added.append(places)
        leaving = [np.diff(np.searchsorted(below, np.append(above, n)))
                   for above, below in zip(added, added[1:])]
        return cls(symbols, leaving, _sums(weights, added[-1]))

    def sequences(self) -> np.ndarray:
        """(DEPTH, n) symbols of all accepted sequences, in order."""
        behind = [np.ones(len(self.weights), np.int64)]
        for leaving in reversed(self.leaving):
            behind.append(_sums(behind[-1], np.cumsum(leaving) - leaving))
        return np.array([np.repeat(s, n) for s, n in zip(self.symbols, reversed(behind))], np.int32)

    def prefixes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """((length, n) symbols, weights) of all prefixes of so many symbols."""
        weights = self.weights
        for leaving in reversed(self.leaving[length - 1:]):
            weights = _sums(weights, np.cumsum(leaving) - leaving)
        out, at = [self.symbols[length - 1]], np.arange(len(weights))
        for symbols, leaving in zip(self.symbols[:length - 1][::-1], self.leaving[:length - 1][::-1]):
            at = np.repeat(np.arange(len(symbols)), leaving)[at]
            out.append(symbols[at])
        return np.array(out[::-1], np.int32), weights


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins) if len(begins) else values[:0]


def restricted(words: pa.Array, sequences: np.ndarray, weights: np.ndarray) -> tuple[pa.Array, Automaton]:
    """The automaton of some sorted sequences, with the words they use alone."""
    present = np.zeros(len(words) + 1, bool)
    present[sequences] = True
    used = np.flatnonzero(present[:-1])
    place = np.full(len(words) + 1, END, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    return words.take(pa.array(used)), Automaton.of(place[sequences], weights, ordered=True)


def union(parts: list[tuple[pa.Array, Automaton]]) -> tuple[pa.Array, Automaton]:
    """The automaton whose weights are the sums of all parts.

    A part comes with its own words, which its symbols number; the result has
    the words of all parts, sorted.
    """
    coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    places = rank[coded.indices.to_numpy()]
    columns, weights, at = [], [], 0
    for own, part in parts:
        columns.append(np.append(places[at:at + len(own)], np.int32(END))[part.sequences()])
        weights.append(part.weights)
        at += len(own)
    words = coded.dictionary.take(pa.array(order))
    return words, Automaton.of(np.concatenate(columns, axis=1), np.concatenate(weights))


_ARRAYS = 2 * DEPTH + 1


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(t[2])))


def packed(words: pa.Array, automaton: Automaton) -> bytes:
    """Words and automaton as compressed bytes: widths and lengths, arrays, words."""
    offsets, data = text_bytes(words)
    arrays = [_narrow(a) for a in (
        *(s + 1 for s in automaton.symbols), *automaton.leaving, automaton.weights, np.diff(offsets))]
    head = np.array([[a.itemsize, len(a)] for a in arrays], "<u8")
    raw = b"".join([head.tobytes(), *(a.tobytes() for a in arrays), data.tobytes()])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[pa.Array, Automaton]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    at, arrays = 16 * _ARRAYS, []
    for width, n in np.frombuffer(raw, "<u8", 2 * _ARRAYS).reshape(-1, 2).tolist():
        arrays.append(np.frombuffer(raw, f"<u{width}", n, at).astype(np.int64))
        at += width * n
    words = binary_array(np.frombuffer(raw, np.uint8, offset=at), arrays[-1])
    return words, Automaton(
        [a.astype(np.int32) - 1 for a in arrays[:DEPTH]], arrays[DEPTH:-2], arrays[-2])


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte strings that lie one behind the other."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
