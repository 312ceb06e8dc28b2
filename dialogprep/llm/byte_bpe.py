"""Operator 7: byte-level BPE encoding by a lazily determinised transducer, and decoding.

The ranks define, for every prefix of a piece of text, the last token of that
prefix's encoding. It starts at a *live* place: one from which the bytes up to
here begin some token. All encodings of all continuations pass through the
chains of the live places, so a token boundary common to these chains is final
and the tokens before it are emitted; the lookahead is bounded by the longest
token. What remains (the bytes since that boundary and the live chains) is a
state of the transducer. States and transitions are made when they are first
needed and kept in a bounded table.

Texts that are null count as empty; repeated rows are encoded each; an empty
text has no ids. Columns other than the id and the text are not read.
"""

import base64
import re
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.llm import utf8
from dialogprep.llm.common import Remembered, per_worker, record_batch, row_slices, share

# Transitions, steps of live places, pairs and whole matches kept in each worker; pairs start anew
# when full, and of matches those met longest ago go.
MAX_TRANSITIONS = 20_000
MAX_STEPS = 200_000
MAX_PAIRS = 400_000
MAX_REMEMBERED = 800_000
REMEMBERED_LENGTH = 24
DECODED_AT_ONCE = 512
UNKEPT_AT_ONCE = 256

NEVER = float("inf")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a rank file, a small file at a path of the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


# A token boundary: (the token that ends here, the boundary where it begins, depth).
Link = tuple[int | None, "Link | None", int]
# The live places: (bytes that go on from there in the vocabulary, boundary there), oldest
# first. The bytes lead to (token that ends, bytes that go on).
Live = list[tuple[dict, Link]]


class _State:
    """Live places, known transitions, and the tokens that follow if the piece ends here."""

    __slots__ = ("live", "next", "flush")

    def __init__(self, live: Live):
        self.live = live
        self.next: dict[int, tuple[bytes, _State]] = {}
        self.flush: bytes | None = None


class _Places:
    """Where live places stand in the vocabulary, oldest first: the bytes that go on from there
    and how many led there; known steps to what follows."""

    __slots__ = ("trees", "depths", "next")

    def __init__(self, trees: list[dict], depths: list[int]):
        self.trees, self.depths = trees, depths
        self.next: dict[int, tuple[list[tuple[int, int]], _Places]] = {}


_depth = itemgetter(2)


def _pair(first: int | None, second: int) -> int:
    return ~second if first is None else first << 32 | second


class Transducer:
    """Encodes pieces of text byte by byte.

    Transitions are kept while there is room, so the commonest ones are; any
    other is followed from the live places and not kept. Which places are live,
    and which tokens end there, follows from the oldest one: these steps are
    kept by themselves.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.packed = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}
        self._tree: dict = {}
        self._depths = {id(self._tree): 0}
        self._places: dict[int, _Places] = {}
        self._steps = 0
        self._fits: dict[int, bool] = {}
        self._history: dict[int, list[tuple[float, bytes, bytes]]] = {}
        for token, rank in ranks.items():
            self._add(token, rank)
        self._remembered = Remembered(
            lambda match: self.encode_piece(match.encode()), MAX_REMEMBERED, REMEMBERED_LENGTH)
        self._states: dict = {}
        self._transitions = 0
        self.root = self._state([(self._tree, (None, None, 0))])

    def _add(self, token: bytes, rank: int) -> None:
        tree = self._tree
        for depth, byte in enumerate(token[:-1], 1):
            known, more = tree.get(byte, (None, None))
            if more is None:
                more = {}
                tree[byte] = known, more
                self._depths[id(more)] = depth
            tree = more
        tree[token[-1]] = rank, tree.get(token[-1], (None, None))[1]
        self._history[rank] = token  # replaced by its merges when they are first needed

    def _state(self, live: Live) -> _State:
        key = tuple([(id(tree), *self._path(link)) for tree, link in live])
        if key not in self._states:
            self._states[key] = _State(live)
        return self._states[key]

    @staticmethod
    def _path(link: Link | None) -> Iterator[int | None]:
        while link is not None:
            yield link[0]
            link = link[1]

    def merges(self, data: bytes) -> Iterator[tuple[float, list[bytes]]]:
        """The definition: join the neighbours of lowest rank, the first of equals, until none
        can be joined. Yields the parts and the rank of the merge that comes next."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while True:
            joined = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(joined, default=NEVER)
            yield best, parts
            if best == NEVER:
                return
            at = joined.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _merges_of(self, rank: int) -> list[tuple[float, bytes, bytes]]:
        known = self._history[rank]
        if isinstance(known, bytes):
            known = [(following, p[0], p[-1]) for following, p in self.merges(known)]
            self._history[rank] = known
        return known

    def _follows(self, first: int | None, second: int) -> bool:
        """Whether merges alone make ``second`` and leave it behind ``first``; remembered."""
        if len(self._fits) >= MAX_PAIRS:
            self._fits.clear()
        made = self._merges_of(second)[-1]
        known = made[1] is made[2] and (first is None or self._apart(first, second))
        self._fits[_pair(first, second)] = known
        return known

    def _apart(self, first: int, second: int) -> bool:
        """Merges within each go on as if it stood alone, in the order of their ranks, unless
        one across the border comes first."""
        left, right, get = self._merges_of(first), self._merges_of(second), self.ranks.get
        i = j = 0
        while True:
            in_left, _, a = left[i]
            in_right, b, _ = right[j]
            across = get(a + b, NEVER)
            if across < in_left and across <= in_right:
                return False
            if in_left <= in_right:
                if in_left == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def _advance(self, live: Live, byte: int) -> Live:
        """The live places after one more byte; the last is the new end of the text."""
        out, here, fits = [], None, self._fits
        for tree, link in live:
            found = tree.get(byte)
            if found is None:
                continue
            token, more = found
            if more is not None:
                out.append((more, link))
            if token is not None and here is None:
                first = link[0]
                known = fits.get(~token if first is None else first << 32 | token)
                if known is None:
                    known = self._follows(first, token)
                if known:
                    here = token, link, link[2] + 1
        out.append((self._tree, here))
        return out

    def _settle(self, live: Live) -> tuple[bytes, Live]:
        """Emits what the chains of all live places share and bases them on its end."""
        open_links, between = {id(link): link for _, link in live}, []
        while len(open_links) > 1:
            link = max(open_links.values(), key=_depth)
            del open_links[id(link)]
            between.append(link)
            open_links[id(link[1])] = link[1]
        (cut,) = open_links.values()
        if cut[1] is None:
            return b"", live
        emitted = self._tokens(cut)
        needed = any(link is cut for _, link in live)
        moved = {id(cut): (cut[0] if needed else None, None, 0)}
        for link in reversed(between):
            back = moved[id(link[1])]
            moved[id(link)] = link[0], back, back[2] + 1
        return emitted, [(tree, moved[id(link)]) for tree, link in live]

    def _tokens(self, link: Link) -> bytes:
        out = b""
        while link[1] is not None:
            out = self.packed[link[0]] + out
            link = link[1]
        return out

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        if piece in self.ranks:
            return self.packed[self.ranks[piece]]
        state, out = self.root, []
        for at, byte in enumerate(piece):
            found = state.next.get(byte)
            if found is None:
                if self._transitions >= MAX_TRANSITIONS:
                    return b"".join(out) + self._unkept(state.live, piece[at:])
                emitted, live = self._settle(self._advance(state.live, byte))
                found = state.next[byte] = emitted, self._state(live)
                self._transitions += 1
            if found[0]:
                out.append(found[0])
            state = found[1]
        if state.flush is None:
            state.flush = self._tokens(state.live[-1][1])
        out.append(state.flush)
        return b"".join(out)

    def _unkept(self, live: Live, rest: bytes) -> bytes:
        out = []
        while len(rest) > UNKEPT_AT_ONCE:
            links, ends, places = self._follow(live, rest[:UNKEPT_AT_ONCE])
            begins = [len(links) - 1 - depth for depth in places.depths]
            emitted, live = self._settle(
                [(tree, self._end(links, ends, i)) for tree, i in zip(places.trees, begins)])
            out.append(emitted)
            rest = rest[UNKEPT_AT_ONCE:]
        links, ends, _ = self._follow(live, rest)
        out.append(self._tokens(self._end(links, ends, len(links) - 1)))
        return b"".join(out)

    def _follow(self, live: Live, data: bytes) -> "tuple[list, list, _Places]":
        """By place from the oldest live one on: (boundaries if known, tokens that end there and
        their sizes), and what is live after ``data``."""
        places = self._places_of([tree for tree, _ in live])
        links: list[Link | None] = [None] * (places.depths[0] + 1)
        for depth, (_, link) in zip(places.depths, live):
            links[~depth] = link
        ends: list = links.copy()  # the first are known
        for byte in data:
            step = places.next.get(byte)
            if step is None:
                step = self._step(places, byte)
            found, places = step
            ends.append(found)
        links.extend([None] * len(data))
        return links, ends, places

    def _end(self, links: list, ends: list, at: int) -> Link:
        """The last token before place ``at``; only places that it needs are looked at."""
        known = links[at]
        if known is not None:
            return known
        fits = self._fits
        for token, size in ends[at]:
            link = links[at - size] or self._end(links, ends, at - size)
            first = link[0]
            known = fits.get(~token if first is None else first << 32 | token)
            if known is None:
                known = self._follows(first, token)
            if known:
                links[at] = link = token, link, link[2] + 1
                return link
        raise ValueError("a byte that is no token")

    def _places_of(self, trees: list[dict], depths: list[int] | None = None) -> "_Places":
        key = id(trees[0])
        if key not in self._places:
            if depths is None:
                depths = [self._depths[id(tree)] for tree in trees]
            self._places[key] = _Places(trees, depths)
        return self._places[key]

    def _step(self, places: "_Places", byte: int) -> "tuple[list[tuple[int, int]], _Places]":
        """(tokens that end with the next byte and their sizes, the longest first; what is live)"""
        ends, trees, depths = [], [], []
        for tree, depth in zip(places.trees, places.depths):
            token, more = tree.get(byte, (None, None))
            if token is not None:
                ends.append((token, depth + 1))
            if more is not None:
                trees.append(more)
                depths.append(depth + 1)
        step = ends, self._places_of([*trees, self._tree], [*depths, 0])
        if self._steps < MAX_STEPS:
            places.next[byte] = step
            self._steps += 1
        return step

    def ids_of(self, matches: list[str]) -> bytes:
        """Ids of matches in order; short ones are remembered."""
        return b"".join(map(self._remembered.__getitem__, matches))


class Splitter:
    """Matches of a pattern.

    Texts of characters up to U+00FF, the commonest, are split by the ``re``
    module, in whose pattern the Unicode classes are written out for them.
    """

    def __init__(self, pattern: str):
        self.any = regex.compile(pattern)
        self.latin = _latin(pattern)

    def split(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def parts(self, text: str, size: int = 1 << 16) -> Iterator[list[str]]:
        """The same in lists of bounded length, for very long texts."""
        found = (m.group() for m in self._for(text).finditer(text))
        while some := list(islice(found, size)):
            yield some

    def _for(self, text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any
        return self.latin


def _latin(pattern: str):
    """``pattern`` for ``re``, its classes spelled out as characters up to U+00FF."""
    if regex.search(r"\\[pP](?!\{[LN]\})|\\[^pPsS{}]|\(\?[^!:]|[+*?][+]", pattern):
        return regex.compile(pattern)
    members = {
        name: "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c)))
        for name in (r"\p{L}", r"\p{N}", r"\s")
    }
    out, inside = [], False
    for part in regex.split(r"(\\p\{[LN]\}|\\s|\\S|[\[\]])", pattern):
        if part in members:
            part = members[part] if inside else f"[{members[part]}]"
        elif part == r"\S":
            part = f"[^{members[chr(92) + 's']}]"
        elif part in ("[", "]"):
            inside = part == "["
        out.append(part)
    return re.compile("".join(out))


class Decoder:
    """Ids to text; a character may begin in one token and end in a later one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = {rank: token for token, rank in ranks.items()}
        self._steps: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self._whole = np.full(max(ranks.values(), default=0) + 1, None)

    def decode(self, ids: np.ndarray) -> str:
        pending, out = b"", []
        for start in range(0, len(ids), DECODED_AT_ONCE):
            some = ids[start:start + DECODED_AT_ONCE]
            if not pending:
                try:  # usually every token ends a character
                    out.append("".join(self._whole[some].tolist()))
                    continue
                except TypeError:  # a token that is not known to do so
                    pass
            for token in some.tolist():
                text, pending = self._step(pending, token)
                out.append(text)
        out.append(utf8.close(pending))
        return "".join(out)

    def _step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        steps = self._steps.setdefault(pending, {})
        if token not in steps:
            steps[token] = utf8.feed(pending, self.pieces[token])
            if not pending and not steps[token][1]:
                self._whole[token] = steps[token][0]
        return steps[token]


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
UNPACKED = pa.schema([*list(ENCODED)[:2], ("ids", pa.list_(pa.int32()))])
DECODED = pa.schema([*ENCODED, ("decoded", pa.string())])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str,
           id_col: str = "doc_id", text: str = "text", packed: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids): ``ids`` packs unsigned 32-bit little-endian integers, or
    is an array of integers.

    Each match of ``pattern`` is encoded by itself; there are no special tokens.
    The vocabulary is a file of fixed size and is broadcast. No shuffle.
    """
    shared = share(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known = Splitter(pattern), per_worker(shared, Transducer)
        for batch in row_slices(batches, "text"):
            ids = [encoded(splitter, known, t or "") for t in batch.column("text").to_pylist()]
            sizes = [len(i) // 4 for i in ids]
            if packed:
                yield record_batch(ENCODED, batch.column("doc_id"), sizes, ids)
            else:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield record_batch(UNPACKED, batch.column("doc_id"), sizes, lists)

    kind = "binary" if packed else "array<int>"
    return _narrow(docs, id_col, text).mapInArrow(run, f"doc_id long, n_tokens long, ids {kind}")


def encoded(splitter: Splitter, known: Transducer, text: str) -> bytes:
    if len(text) < 1 << 20:
        return known.ids_of(splitter.split(text))
    return b"".join(map(known.ids_of, splitter.parts(text)))


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``, to (doc_id, n_tokens, ids). No shuffle."""
    shared = share(encoded.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker(shared, Decoder)
        for batch in row_slices(batches, "ids"):
            texts = [known.decode(np.frombuffer(i, "<u4")) for i in batch.column("ids").to_pylist()]
            yield record_batch(DECODED, *batch.columns, texts)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string"
    )


def _narrow(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
