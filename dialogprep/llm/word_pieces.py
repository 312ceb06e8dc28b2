"""Operator 2: counts of greedy word pieces by a linear longest-match automaton.

A word is a run between ASCII white space. It is cut into the longest piece
that begins it, then the longest that continues it, and so on; a word that
cannot be cut completely is one unknown token. The automaton is the trie of the
vocabulary with a failure link and a count at every node: leaving a node by its
link means that so many pieces have ended. Both are known before a text is read,
so each character is looked at once and no piece is built.

A null or empty text has no words; repeated rows are counted each. Columns other
than the id and the text are not read.
"""

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import binaries, per_worker, record_batch, row_slices, share, word_lists

# Words whose counts each worker keeps; longer words are counted anew.
MAX_REMEMBERED = 400_000
REMEMBERED_LENGTH = 32

START, INSIDE = 0, 1
UNKNOWN = 1 << 40  # added to a word's count of tokens


class Automaton(dict):
    """Counts by word (``UNKNOWN + 1`` for an unknown one), made when first asked for.

    ``begins`` are the pieces that begin words, one of which may be empty;
    ``continues`` are those inside words.
    """

    def __init__(self, begins: Iterable[str], continues: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        whole = {self._add(START, piece) for piece in begins}
        whole |= {self._add(INSIDE, piece) for piece in continues if piece}
        size = len(self.child)
        self.link: list[int | None] = [None] * size
        self.popped = [0] * size
        if START in whole:
            self.link[START], self.popped[START] = INSIDE, 1
        waiting = deque([START, INSIDE])
        while waiting:
            node = waiting.popleft()
            for char, after in self.child[node].items():
                waiting.append(after)
                if after in whole:
                    self.link[after], self.popped[after] = INSIDE, 1
                    continue
                link, popped = self.link[node], self.popped[node]
                while link is not None and char not in self.child[link]:
                    popped += self.popped[link]
                    link = self.link[link]
                if link is not None:
                    self.link[after], self.popped[after] = self.child[link][char], popped

    def _add(self, node: int, piece: str) -> int:
        for char in piece:
            if char not in self.child[node]:
                self.child[node][char] = len(self.child)
                self.child.append({})
            node = self.child[node][char]
        return node

    def count(self, word: str) -> int:
        node, n = START, 0
        for char in word:
            while (after := self.child[node].get(char)) is None:
                n += self.popped[node]
                node = self.link[node]
                if node is None:
                    return UNKNOWN + 1
            node = after
        while node != INSIDE:
            n += self.popped[node]
            node = self.link[node]
            if node is None:
                return UNKNOWN + 1
        return n

    def __missing__(self, word: bytes) -> int:
        n = self.count(word.decode())
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= MAX_REMEMBERED:
                self.clear()
            self[word] = n
        return n

    def total(self, text: bytes) -> tuple[int, int, int]:
        """(words, tokens, unknown words)"""
        words = both = 0
        for some in word_lists(text):
            words += len(some)
            both += sum(map(self.__getitem__, some))
        return words, both % UNKNOWN, both // UNKNOWN


def count(docs: DataFrame, begins: list[str], continues: list[str],
          id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of whole texts.

    The vocabulary, of fixed size, is broadcast; there is no shuffle.
    """
    shared = share(docs.sparkSession, (begins, continues))
    schema = pa.schema([(name, pa.int64()) for name in
                        ("doc_id", "n_words", "n_tokens", "n_unknown")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = per_worker(shared, lambda pieces: Automaton(*pieces))
        for batch in row_slices(batches, "text"):
            totals = [automaton.total(t) for t in binaries(batch.column("text"))]
            yield record_batch(schema, batch.column("doc_id"), *map(list, zip(*totals)))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def marked_pieces(pieces: Iterable[str], mark: str = "▁") -> tuple[list[str], list[str]]:
    """(pieces that begin words, other pieces) of a vocabulary that marks the beginnings."""
    pieces = list(pieces)
    return ([p.removeprefix(mark) for p in pieces if p.startswith(mark)],
            [p for p in pieces if not p.startswith(mark)])
