"""Operator 4: benchmark passages in documents, by q-gram counts in diagonal bands.

Texts are normalised: letters in lower case (ASCII and the Latin letters next to
it), every run of other ASCII characters one space. A document holds a passage
of an item if some window of ``WINDOW`` bytes of the item (all of a shorter item)
is within ``EDITS`` edits, or in proportion fewer for a shorter item, of a string
in the document.

A window with e edits has at least ``window + 1 - q (e + 1)`` q-grams in common
with such a string, on diagonals (place in the document less place in the item)
that differ by at most e. So the q-grams common to a document and an item are
counted in bands of 2 e diagonals that overlap by e; stretches of an item whose
count meets the bound are kept, and their windows are aligned with the document
within the band. The filter loses nothing.

A text and an item that both repeat themselves have very many equal q-grams; such
a text is searched in overlapping slices, equal ones once, and within a slice
some items and places at a time, so that memory stays bounded.

Items whose normalised text has fewer than ``GRAM`` bytes, or is null, are too
short to tell and match nothing; a null document is empty. Repeated documents
and repeated items are each reported. Empty tables give empty results.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import per_worker, record_batch, share, slices, stored, text_bytes
from dialogprep.llm.suffix_dedup import CHUNK, Hashes

WINDOW = 80
EDITS = 5
GRAM = 12
# Bytes of items broadcast at once; more are looked for in further passes.
BLOCK_BYTES = 4 << 20
# Windows aligned at once.
ALIGNED = 4096
# Pairs of equal q-grams taken at once; a text that alone makes more is cut into slices.
PAIRS = 1 << 20
SLICE, OVERLAP, SHIFT = 2048, WINDOW + 4 * EDITS, 128

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("0"):ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def normalised(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, places in ``data``) of texts that lie one after the other."""
    folded = _FOLD[data]
    if len(data):
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
                                 & (data[1:] != 0x97)) + 1
        folded[capital] += 0x20
    space = folded == 0x20
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True
    kept = ~space
    kept[1:] |= space[1:] & ~space[:-1] & ~begins[1:-1]
    places = np.flatnonzero(kept)
    return folded[places], np.searchsorted(places, offsets), places


def _distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct columns in order."""
    low = rows.min(axis=1, initial=0)
    bits = [int(top - least).bit_length() for top, least in zip(rows.max(axis=1, initial=0), low)]
    if sum(bits) > 62:
        rows = rows[:, np.lexsort(rows[::-1])]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        return rows[:, new]
    packed = np.zeros(rows.shape[1], np.int64)
    for row, least, width in zip(rows, low, bits):
        packed = packed << width | (row - least)
    packed.sort()
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    packed, out = packed[new], []
    for least, width in zip(low[::-1], bits[::-1]):
        out.append((packed & ((1 << width) - 1)) + least)
        packed = packed >> width
    return np.array(out[::-1])


class Items:
    """q-grams of a block of items and where they stand."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        texts = pa.array([t or "" for _, t in rows], pa.string())
        offsets, data = text_bytes(texts)
        self.data, self.offsets, _ = normalised(data, offsets)
        self.ids = [i for i, _ in rows]
        self.size = np.diff(self.offsets)
        self.window = np.minimum(self.size, WINDOW)
        self.edits = np.maximum(0, np.minimum(EDITS * self.window // WINDOW,
                                              self.window // GRAM - 1))
        self.least = self.window + 1 - GRAM * (self.edits + 1)
        owner, place, hashes = [], [], []
        for item in np.flatnonzero(self.size >= GRAM).tolist():
            part = self.data[self.offsets[item]:self.offsets[item + 1]]
            for start in range(0, len(part) - GRAM + 1, CHUNK):
                grams = Hashes(part[start:start + CHUNK + GRAM - 1], 0).grams(GRAM)
                owner.append(np.full(len(grams), item))
                place.append(np.arange(start, start + len(grams)))
                hashes.append(grams)
        none = [np.zeros(0, np.int64)]
        hashes = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        by = np.argsort(hashes, kind="stable")
        self.owner = np.concatenate(owner or none)[by]
        self.place = np.concatenate(place or none)[by]
        self.hashes, first, count = np.unique(hashes[by], return_index=True, return_counts=True)
        self.first, self.count = first, count
        self.present = np.zeros(1 << 20, bool)
        self.present[self.hashes >> np.uint64(44)] = True

    def _common(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the texts, number of the q-gram) of q-grams that items have too."""
        none = np.zeros(0, np.int64)
        if len(data) < GRAM or not len(self.hashes):
            return none, none
        grams = Hashes(data, 0).grams(GRAM)
        at = np.flatnonzero(self.present[grams >> np.uint64(44)])
        gram = np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)
        same = self.hashes[gram] == grams[at]
        return at[same], gram[same]

    def find(self, data: np.ndarray, offsets: np.ndarray):
        """(text, item, least edits, first and last window, end in the text) of what matches.

        ``data`` is normalised; the texts lie at ``offsets``. Texts are taken
        together as long as they make at most ``PAIRS`` pairs of equal q-grams.
        """
        at, gram = self._common(data)
        text = np.searchsorted(offsets, at, "right") - 1
        pairs = np.bincount(text, self.count[gram], len(offsets) - 1).astype(np.int64)
        out = []
        for start, stop in slices(pairs, PAIRS):
            low, high = int(offsets[start]), int(offsets[stop])
            if pairs[start:stop].sum() > PAIRS:
                out += [(start, *rest, low + end) for _, *rest, end in self._by_slices(data[low:high])]
                continue
            some = slice(*np.searchsorted(at, [low, high]))
            found = self._search(data[low:high], offsets[start:stop + 1] - low, at[some] - low, gram[some],
                                 (self.first, self.count, self.owner, self.place))
            out += [(t + start, *rest, low + end) for t, *rest, end in found]
        return out

    def _by_slices(self, data: np.ndarray):
        """``find`` in one text that has very many q-grams in common with items.

        Slices overlap by more than any window and its edits. Such a text repeats
        itself, so what was found in an equal slice is taken over.
        """
        known: dict[bytes, list] = {}
        best: dict[int, list] = {}
        # A slice begins where the q-gram of least hash in reach does, at the same place of each
        # repetition.
        grams = Hashes(data, 0).grams(GRAM)
        after = 0
        while True:
            start = after
            part = np.ascontiguousarray(data[start:start + SLICE])
            name = hashlib.blake2b(part, digest_size=16).digest()
            if name not in known:
                known[name] = self._bounded(part, (0, len(self.ids)), (0, int(self.size.max())))
            for _, item, edits, first, last, end in known[name]:
                _merge(best, item, edits, first, last, start + end)
            if start + SLICE >= len(data):
                break
            after = start + SLICE - OVERLAP
            after -= int(grams[after - SHIFT + 1:after + 1][::-1].argmin())
        return [(0, item, *values) for item, values in sorted(best.items())]

    def _bounded(self, data: np.ndarray, items: tuple[int, int], places: tuple[int, int]):
        """``find`` in one slice, for some items and places, in halves where pairs are too many."""
        at, gram = self._common(data)
        kept = ((self.owner >= items[0]) & (self.owner < items[1])
                & (self.place >= places[0]) & (self.place < places[1]))
        before = np.concatenate([[0], np.cumsum(kept)])
        first, count = before[self.first], before[self.first + self.count] - before[self.first]
        low, high = places
        if count[gram].sum() <= PAIRS or (items[1] - items[0] == 1 and high - low <= 4 * WINDOW):
            return self._search(data, np.array([0, len(data)]), at, gram,
                                (first, count, self.owner[kept], self.place[kept]))
        best: dict[int, list] = {}
        if items[1] - items[0] > 1:
            middle = sum(items) // 2
            halves = [((items[0], middle), places), ((middle, items[1]), places)]
        else:
            middle = (low + high) // 2
            halves = [(items, (low, middle + WINDOW)), (items, (middle, high))]
        for half in halves:
            for _, item, *values in self._bounded(data, *half):
                _merge(best, item, *values)
        return [(0, item, *values) for item, values in sorted(best.items())]

    def _search(self, data, offsets, at, gram, entries):
        """``find`` for the q-grams ``gram`` at places ``at``, where items have them at ``entries``."""
        first, count, owner, places = entries
        count = count[gram]
        entry = np.repeat(first[gram] - np.cumsum(count) + count, count) + np.arange(count.sum())
        at, item, place = np.repeat(at, count), owner[entry], places[entry]
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + GRAM <= offsets[text + 1]
        # no band of an item has more q-grams than the text has with the item
        _, pair, common = np.unique(text * len(self.ids) + item, return_inverse=True,
                                    return_counts=True)
        inside &= common[pair] >= self.least[item]
        at, item, place, text = at[inside], item[inside], place[inside], text[inside]
        step = np.maximum(self.edits[item], 1)
        diagonal = at - place + WINDOW  # WINDOW, so that it is not negative in the first text
        band = (diagonal + self.size[item]) // step
        # each band of two steps begins at a multiple of the step
        rows = np.concatenate([np.stack([text, item, band, place]),
                               np.stack([text, item, band - 1, place])], axis=1)
        rows = _distinct(rows)
        text, item, band, place = rows
        if not len(text):
            return []
        new = np.ones(len(text), bool)
        new[1:] = (np.diff(rows[:3], axis=1) != 0).any(0)
        group = np.cumsum(new) - 1
        ahead = np.arange(len(text)) + self.least[item] - 1
        within = np.minimum(ahead, len(text) - 1)
        full = ((ahead < len(text)) & (group[within] == group)
                & (place[within] - place <= self.window[item] - GRAM))
        first = np.flatnonzero(full)
        if not len(first):
            return []
        low = np.maximum(0, place[within[first]] + GRAM - self.window[item[first]])
        high = np.minimum(place[first], self.size[item[first]] - self.window[item[first]])
        # Both rise within a band, so that what the stretch before has tried is left out.
        low[1:] = np.where(np.diff(group[first]) == 0, np.maximum(low[1:], high[:-1] + 1), low[1:])
        count = np.maximum(high - low + 1, 0)
        start = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        tries = np.stack([np.repeat(text[first], count), np.repeat(item[first], count),
                          np.repeat(band[first], count), start])
        if not tries.shape[1]:
            return []
        return self._best(data, offsets, tries)

    def _best(self, data, offsets, tries):
        """What the tries find, from the last to the first.

        A try that can neither lower the edits of its text and item nor widen
        what is known of them is left out.
        """
        pair = tries[0] * len(self.ids) + tries[1]
        pairs, own = np.unique(pair, return_inverse=True)
        least = np.full(len(pairs), 1 << 20)
        first, last = np.full(len(pairs), 1 << 40), np.full(len(pairs), -1)
        ends = np.full(len(pairs), -1)
        reach = np.minimum(self._base(tries) + 4 * EDITS + 2 + WINDOW, offsets[tries[0] + 1])
        waiting = np.arange(tries.shape[1])[::-1]
        while len(waiting):
            some, waiting = waiting[:ALIGNED], waiting[ALIGNED:]
            edits, stops = self._aligned(data, offsets, tries[:, some])
            close = edits <= self.edits[tries[1, some]]
            at, start = own[some][close], tries[3, some][close]
            np.minimum.at(least, at, edits[close])
            np.minimum.at(first, at, start)
            np.maximum.at(last, at, start)
            np.maximum.at(ends, at, stops[close])
            at, start = own[waiting], tries[3, waiting]
            waiting = waiting[(least[at] > 0) | (start < first[at]) | (start > last[at]) | (reach[waiting] > ends[at])]
        found = np.flatnonzero(last >= 0)
        return [(p // len(self.ids), p % len(self.ids), e, a, b, end) for p, e, a, b, end in zip(
            *(x[found].tolist() for x in (pairs, least, first, last, ends)))]

    def _base(self, tries) -> np.ndarray:
        """The place in the texts of the first diagonal of a try's band at its first byte."""
        _, item, band, start = tries
        edits = self.edits[item]
        return band * np.maximum(edits, 1) - self.size[item] - WINDOW - edits + start

    def _aligned(self, data, offsets, tries) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end in the texts) of windows aligned within their bands.

        A column is a diagonal. An item byte too many moves to the one before, a
        text byte too many to the one after. The alignment begins and ends on
        any diagonal of the band.
        """
        text, item, _, start = tries
        window = self.window[item]
        width = int(4 * np.maximum(self.edits[item], 1).max() + 2)
        base = self._base(tries)
        span = base[:, None] + np.arange(width + int(window.max()))
        there = np.where((span >= offsets[text][:, None]) & (span < offsets[text + 1][:, None]),
                         data[np.clip(span, 0, len(data) - 1)].astype(np.int16), -1).astype(np.int16)
        own = np.minimum((self.offsets[item] + start)[:, None] + np.arange(int(window.max())), len(self.data) - 1)
        here = self.data[own].astype(np.int16)
        # Where texts repeat themselves, so do tries: equal bytes are aligned once.
        whole = np.ascontiguousarray(np.hstack([there, here, window[:, None].astype(np.int16)]))
        _, some, same = np.unique(whole.view(f"V{2 * whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
        there, here, window = there[some], here[some], window[some]
        column = np.arange(width)
        cost = np.zeros((len(some), width), np.int32)
        best, ends = np.full(len(some), 1 << 20), np.zeros(len(some), np.int64)
        for row in range(int(window.max())):
            after = cost + (there[:, row:row + width] != here[:, row:row + 1])
            after[:, :-1] = np.minimum(after[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(after - column, axis=1) + column
            done = window == row + 1
            if done.any():
                least = cost[done].argmin(1)
                best[done] = cost[done].min(1)
                ends[done] = least + row + 1
        return best[same], np.clip(base + ends[same], offsets[text], offsets[text + 1])


def _merge(best: dict, key, edits: int, first: int, last: int, end: int) -> None:
    """Keeps the least edits, the first and last window and the last end."""
    known = best.setdefault(key, [edits, first, last, end])
    known[0], known[1] = min(known[0], edits), min(known[1], first)
    known[2], known[3] = max(known[2], last), max(known[3], end)


def _found(texts: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, edits, first and last window, end in the text as it is)."""
    offsets, data = text_bytes(texts)
    for start, stop in slices(np.diff(offsets), CHUNK):
        low, high = int(offsets[start]), int(offsets[stop])
        if stop - start == 1 and high - low > CHUNK:
            yield from _long_found(data[low:high], start, items)
            continue
        folded, borders, places = normalised(data[low:high], offsets[start:stop + 1] - low)
        for text, item, edits, first, last, end in items.find(folded, borders):
            yield text + start, item, edits, first, last, int(
                places[end - 1] + 1 - (offsets[start + text] - low)) if end else 0


def _long_found(data: np.ndarray, row: int, items: Items):
    """A long text in chunks that overlap by more than any window and its edits."""
    best: dict[int, list] = {}
    for at in range(0, len(data), CHUNK // 2):
        part = data[at:at + CHUNK]
        folded, borders, places = normalised(part, np.array([0, len(part)]))
        for _, item, edits, first, last, end in items.find(folded, borders):
            _merge(best, item, edits, first, last, at + int(places[end - 1]) + 1 if end else at)
    for item, known in sorted(best.items()):
        yield (row, item, *known)


def blocks(benchmark: DataFrame, id_col: str, text: str) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, fetched one partition at a time."""
    rows, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), text).toLocalIterator():
        rows.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= BLOCK_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, first_window, last_window, text_end): passages in whole texts.

    ``edits`` is the least of the windows found, the windows are places in the
    normalised item, and ``text_end`` is the byte of the document behind the last
    of them. The documents are read once for each ``BLOCK_BYTES`` of items, which
    are broadcast; there is no shuffle.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ddl = ("doc_id long, item_id long, edits int, first_window long, last_window long, "
           "text_end long")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()),
                        ("first_window", pa.int64()), ("last_window", pa.int64()),
                        ("text_end", pa.int64())])

    def looking_for(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = per_worker(shared, Items)
            for batch in batches:
                rows = list(_found(batch.column("text"), items))
                if rows:
                    row, item, *rest = map(list, zip(*rows))
                    yield record_batch(schema, batch.column("doc_id").take(pa.array(row)),
                                       [items.ids[i] for i in item], *rest)

        return run

    parts = [narrow.mapInArrow(looking_for(share(spark, rows)), ddl)
             for rows in blocks(benchmark, item_id, item_text)]
    if len(parts) > 1:
        parts = [stored(part, "passages") for part in parts]
    out = parts[0] if parts else spark.createDataFrame([], ddl)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no passage of any item."""

    def without(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = per_worker(shared, Items)
            for batch in batches:
                hit = np.zeros(batch.num_rows, bool)
                hit[[row for row, *_ in _found(batch.column(text), items)]] = True
                yield batch.filter(pc.invert(pa.array(hit)))

        return run

    for rows in blocks(benchmark, item_id, item_text):
        docs = docs.mapInArrow(without(share(docs.sparkSession, rows)), docs.schema)
    return docs
