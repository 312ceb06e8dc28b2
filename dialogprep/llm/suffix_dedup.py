"""Operator 5: removal of repeated substrings by bucket-pointer refinement.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document with a smaller id, or earlier in the same document. Strings are
judged on the input.

Every window of ``length`` bytes is put into the bucket of one of its q-grams:
the one with the least hash, so that equal windows choose the same q-gram at the
same place. Neighbouring windows with a common choice form a *zone*, of which
there are about two in ``length - q`` bytes; only zones are shuffled, not
positions. Within a bucket

- zones with the same bytes are settled at once: all but the first are repeats.
  A zone is compared by two independent 64-bit identifiers, of its q-gram and of
  all its bytes, and only the first zone of each task reaches the shuffle, so
  that thousands of copies or one passage in a third of all documents are a row
  for each task;
- the first zones of buckets that still hold different bytes are refined over
  their bytes. Positions are sorted into buckets of short q-grams; then each
  bucket is split by the bucket identifiers (pointers) of the positions as many
  bytes further on as are settled already, and the new pointers serve the next
  split, which reaches twice as far, until ``length`` bytes are settled. The
  windows of one bucket are then equal, and all but the first are repeats;
- a bucket with more than ``HOT`` different zones is refined in one step, by two
  64-bit identifiers of each window, so that it does not meet in one task.

Rows with the same id and text are one document, and each of them gets its
result. Rows with the same id and different texts follow each other in the order
of a hash of the text; a null id comes before all others. A null text is empty.
Texts shorter than ``length`` lose nothing. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dialogprep.llm.common import record_batch, slices, stored, text_bytes

LENGTH = 100
HOT = 20_000
# Bytes refined together, if more than one bucket.
REFINED_BYTES = 1 << 20
# Zones of a task among which copies are settled before the shuffle.
ZONES_AT_ONCE = 1 << 18
CHUNK = 1 << 19

_PLACE = np.uint64((1 << 21) - 1)
_NO_ID = -(2**63)
_random = np.random.default_rng(20240501)
_BYTE_VALUE = _random.integers(0, 2**64, (2, 256), np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_tables(which: int) -> tuple[np.ndarray, np.ndarray]:
    if which not in _powers:
        base, n = _BASES[which], CHUNK + 4096
        _powers[which] = _geometric(base, n), _geometric(pow(base, -1, 2**64), n)
    return _powers[which]


class Hashes:
    """Polynomial hashes modulo 2^64 of all substrings of a chunk of bytes."""

    def __init__(self, data: np.ndarray, which: int):
        self.powers, self.inverse = _power_tables(which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[which][data] * self.powers[:len(data)], out=self.sums[1:])

    def grams(self, n: int) -> np.ndarray:
        """Of each substring of ``n`` bytes."""
        hashes = self.sums[n:] - self.sums[:-n]
        hashes *= self.inverse[:len(hashes)]
        return hashes

    def between(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def gram_of(length: int) -> int:
    return max(1, length * 32 // 100)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def zones(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int):
    """Zones of a chunk of texts that lie at ``begins`` to ``ends``.

    Returns (text, first window, last window, q-gram identifier, identifier of
    the bytes of all windows); places are counted from the start of the text.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    gram = gram_of(length)
    first_hash = Hashes(data, 0)
    grams = first_hash.grams(gram)
    mixed = grams ^ (grams >> np.uint64(31))
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed &= ~_PLACE
    mixed |= np.arange(len(mixed), dtype=np.uint64)
    anchor = (_sliding_min(mixed, length - gram + 1) & _PLACE).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int8)
    long = ends - begins >= length
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    inside = np.cumsum(edge)[:-1] > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begin[1:]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop)
    text = np.searchsorted(begins, first, "right") - 1
    place = anchor[first]
    whole = Hashes(data, 1).between(first, last + length)
    whole ^= ((place - first) << 32 | last - first).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    return (text, first - begins[text], last - begins[text],
            grams[place].view(np.int64), whole.view(np.int64))


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first text, last text + 1, start) of chunks; a long text has several starts."""
    for start, stop in slices(sizes, CHUNK):
        if stop - start > 1 or sizes[start] <= CHUNK:
            yield start, stop, 0
        else:
            yield from ((start, stop, at) for at in range(0, int(sizes[start]), CHUNK))


def _zones_of(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    offsets, data = text_bytes(texts)
    for start, stop, at in _chunks(np.diff(offsets)):
        low = offsets[start] + at
        high = min(low + CHUNK + length - 1, offsets[stop]) if stop - start == 1 else offsets[stop]
        begins = offsets[start:stop] + at - low
        ends = np.minimum(offsets[start + 1:stop + 1], high) - low
        text, first, last, gram, whole = zones(data[low:high], begins, ends, length)
        yield text + start, first + at, last + at, gram, whole


ZONE, REPEAT, REFINE, REFINE_HOT = range(4)
MARKS = "kind int, gram long, whole long, d long, h int, first long, last long"
_MARKS = pa.schema([("kind", pa.int32()), ("gram", pa.int64()), ("whole", pa.int64()),
                    ("d", pa.int64()), ("h", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])


def _marks(kind, gram, whole, d, h, first, last) -> pa.RecordBatch:
    return record_batch(_MARKS, np.full(len(d), kind, np.int32), gram, whole, d, h, first, last)


def _first_of_equals(columns: list[np.ndarray], order: list[np.ndarray]):
    """(sort order, whether a row is the first with its ``columns``) by ``order``."""
    by = np.lexsort([*reversed(order), *reversed(columns)])
    first = np.ones(len(by), bool)
    if len(by):
        first[1:] = np.any([c[by][1:] != c[by][:-1] for c in columns], axis=0)
    return by, first


def _not_leaders(by, new, d, h, first) -> np.ndarray:
    """Rows that lie elsewhere than the first of their equals; rows with the same id and text
    bring the same place several times."""
    leader = by[new][np.cumsum(new) - 1]
    return by[(d[by] != d[leader]) | (h[by] != h[leader]) | (first[by] != first[leader])]


def _zone_rows(length: int):
    """Zones that are the first of their kind in a part of the task; repeats among them."""

    def settle(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        d, h, first, last, gram, whole = (np.concatenate(c) for c in zip(*parts))
        by, new = _first_of_equals([gram, whole], [d, h, first])
        once = by[new]
        yield _marks(ZONE, gram[once], whole[once], d[once], h[once], first[once], last[once])
        again = _not_leaders(by, new, d, h, first)
        yield from _repeats(d[again], h[again], first[again], last[again])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            d, h = (batch.column(c).to_numpy() for c in ("d", "h"))
            for text, first, last, gram, whole in _zones_of(batch.column("text"), length):
                parts.append((d[text], h[text], first, last, gram, whole))
                size += len(text)
                if size >= ZONES_AT_ONCE:
                    yield from settle(parts)
                    parts, size = [], 0
        if parts:
            yield from settle(parts)

    return run


def _repeats(d, h, first, last) -> Iterator[pa.RecordBatch]:
    """Rows of stretches of repeated windows; neighbours are joined."""
    if len(d):
        by = np.lexsort([first, h, d])
        d, h, first, last = d[by], h[by], first[by], last[by]
        other = np.ones(len(d), bool)
        other[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        begin = other.copy()
        begin[1:] |= first[1:] > last[:-1] + 1
        at = np.flatnonzero(begin)
        d, h, first, last = d[at], h[at], first[at], last[np.append(at[1:], len(d)) - 1]
        # rows pass through the shuffle by buckets; this spreads them
        yield _marks(REPEAT, d * 31 + first, np.zeros(len(d), np.int64), d, h, first, last)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats and zones to refine among the zones of a shuffle partition."""
    table = pa.Table.from_batches(list(batches), _MARKS)
    kind = table.column("kind").to_numpy()
    passed = np.flatnonzero(kind == REPEAT)
    yield from table.take(passed).combine_chunks().to_batches()
    gram = table.column("gram").to_numpy()
    of_zones = np.flatnonzero(kind == ZONE)
    by = of_zones[np.argsort(gram[of_zones], kind="stable")]
    same = gram[by][1:] == gram[by][:-1]
    several = np.zeros(len(by), bool)
    several[1:] |= same
    several[:-1] |= same
    rows = table.take(np.sort(by[several]))
    gram, whole, d, h, first, last = (
        rows.column(c).to_numpy() for c in ("gram", "whole", "d", "h", "first", "last"))
    by, new = _first_of_equals([gram, whole], [d, h, first])
    again = _not_leaders(by, new, d, h, first)
    yield from _repeats(d[again], h[again], first[again], last[again])
    once = by[new]
    _, bucket, kinds = np.unique(gram[once], return_inverse=True, return_counts=True)
    for kind, chosen in ((REFINE, (kinds > 1) & (kinds <= HOT)), (REFINE_HOT, kinds > HOT)):
        some = once[chosen[bucket]]
        if len(some):
            yield _marks(kind, gram[some], whole[some], d[some], h[some], first[some], last[some])


def _contents(length: int):
    """Bytes of the zones to refine; of hot buckets the identifiers of each window."""
    schema = pa.schema([*_MARKS, ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            ds, hs, asked = (batch.column(c) for c in ("d", "h", "asked"))
            for i in range(batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]]
                rows = asked[i].values
                kind, gram, first, last = (
                    rows.field(c).to_numpy() for c in ("kind", "gram", "first", "last"))
                plain = np.flatnonzero(kind == REFINE)
                d, h = ds[i].as_py(), hs[i].as_py()
                if len(plain):
                    yield pa.RecordBatch.from_arrays([
                        *_marks(REFINE, gram[plain], np.zeros(len(plain), np.int64),
                                np.full(len(plain), d), np.full(len(plain), h, np.int32),
                                first[plain], last[plain]).columns,
                        pa.array([text[a:b + length].tobytes() for a, b in
                                  zip(first[plain].tolist(), last[plain].tolist())], pa.binary()),
                    ], schema=schema)
                for a, b in zip(first[kind == REFINE_HOT].tolist(), last[kind == REFINE_HOT].tolist()):
                    part, places = text[a:b + length], np.arange(a, b + 1)
                    yield pa.RecordBatch.from_arrays([
                        *_marks(REFINE_HOT, Hashes(part, 0).grams(length).view(np.int64),
                                Hashes(part, 1).grams(length).view(np.int64),
                                np.full(len(places), d), np.full(len(places), h, np.int32),
                                places, places).columns,
                        pa.nulls(len(places), pa.binary()),
                    ], schema=schema)

    return run


def refine(data: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers such that positions with equal pointers begin equal strings of
    ``length`` bytes, where these end within ``data``."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    depth = min(8, length)
    gram = np.zeros(n, np.uint64)
    for i in range(depth):
        gram = gram << np.uint64(8) | padded[i:i + n]
    order = np.argsort(gram, kind="stable")
    new = np.ones(n, bool)
    new[1:] = gram[order][1:] != gram[order][:-1]
    # A pointer is the place of its bucket's first position, so splits keep the others valid.
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    pointer = np.empty(n, np.int64)
    pointer[order] = starts
    while depth < length:
        ahead = min(depth, length - depth)
        alone = new & np.append(new[1:], True)
        open_places = np.flatnonzero(~alone)
        if not len(open_places):
            break
        positions = order[open_places]
        bucket = pointer[positions]
        later = pointer[np.minimum(positions + ahead, n - 1)]
        by = np.argsort(bucket * n + later, kind="stable")
        order[open_places] = positions = positions[by]
        bucket, later = bucket[by], later[by]
        split = np.ones(len(by), bool)
        split[1:] = (bucket[1:] != bucket[:-1]) | (later[1:] != later[:-1])
        new[open_places] = split
        pointer[positions] = np.maximum.accumulate(np.where(split, open_places, 0))
        depth += ahead
    return pointer


def _refined(length: int):
    """Repeats among the zones of whole buckets, which come in the order of buckets."""

    def windows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        d, h, first = (rows.column(c).to_numpy() for c in ("d", "h", "first"))
        offsets, data = text_bytes(rows.combine_chunks().column("content").chunk(0))
        pointer = refine(data, length)
        count = np.diff(offsets) - length + 1
        zone = np.repeat(np.arange(len(d)), count)
        within = np.arange(len(zone)) - np.repeat(np.cumsum(count) - count, count)
        rank = np.empty(len(d), np.int64)
        rank[np.lexsort([first, h, d])] = np.arange(len(d))
        by, new = _first_of_equals([pointer[offsets[zone] + within]], [rank[zone]])
        d, h, place = d[zone], h[zone], first[zone] + within
        again = _not_leaders(by, new, d, h, place)
        yield from _repeats(d[again], h[again], place[again], place[again])

    def hot(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, whole, d, h, first = (
            rows.column(c).to_numpy() for c in ("gram", "whole", "d", "h", "first"))
        by, new = _first_of_equals([gram, whole], [d, h, first])
        again = _not_leaders(by, new, d, h, first)
        yield from _repeats(d[again], h[again], first[again], first[again])

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = rows.column("kind").to_numpy()
        for wanted, how in ((REFINE, windows), (REFINE_HOT, hot)):
            some = np.flatnonzero(kind == wanted)
            if len(some):
                yield from how(rows.take(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            waiting = own if waiting is None else pa.concat_tables([waiting, own])
            if waiting.nbytes < REFINED_BYTES:
                continue
            gram = waiting.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last bucket may go on
            if cut:
                yield from settle(waiting.slice(0, cut))
                waiting = waiting.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield from settle(waiting)

    return run


def _kept(length: int, characters: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            marks = batch.column("repeats")
            for i in range(0, batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]]
                begins, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if marks[i].is_valid:
                    first = marks[i].values.field("first").to_numpy()
                    stop = marks[i].values.field("last").to_numpy() + length
                    by = np.argsort(first, kind="stable")
                    first, stop = first[by], np.maximum.accumulate(stop[by])
                    new = np.ones(len(first), bool)
                    new[1:] = first[1:] > stop[:-1]
                    begins = first[new]
                    ends = stop[np.append(np.flatnonzero(new)[1:], len(stop)) - 1]
                    if characters:
                        begins, ends = _whole_characters(text, begins, ends)
                edges = np.concatenate([[0], np.stack([begins, ends], 1).reshape(-1), [len(text)]])
                kept = b"".join(text[a:b].tobytes() for a, b in edges.reshape(-1, 2).tolist())
                yield record_batch(
                    schema, batch.column("rest").slice(i, 1), [len(text)],
                    [int((ends - begins).sum())], [len(begins)], [begins], [ends], [kept])

    return run


def _whole_characters(text: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """Spans cut back to the characters that lie in them completely."""
    padded = np.concatenate([text, np.zeros(4, np.uint8)])
    for _ in range(3):
        begins = begins + ((padded[begins] & 0xC0) == 0x80)
        ends = ends - ((padded[ends] & 0xC0) == 0x80)
    some = ends > begins
    return begins[some], ends[some]


def dedup(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",),
          characters: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(rest, n_bytes, n_removed, n_spans, begins, ends, kept) of every document.

    ``rest`` is a struct of the columns ``keep``; ``begins`` and ``ends`` are the
    byte spans removed and ``kept`` the remaining bytes. With ``characters`` a
    character stays unless all its bytes go.

    Shuffled are the zones, the bytes of those that need refinement, and the
    texts once, by document; both joins with the texts use that one exchange.
    """
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("d"),
        F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32).cast("int").alias("h"),
        F.coalesce(text, F.lit("")).alias("text"), F.struct(*keep).alias("rest"),
    )
    found = texts.select("d", "h", "text").mapInArrow(_zone_rows(length), MARKS)
    marks = stored(found.repartition("gram").mapInArrow(_settled, MARKS), "repeats")
    asked = (
        marks.where(F.col("kind") >= REFINE).groupBy("d", "h")
        .agg(F.collect_list(F.struct("kind", "gram", "first", "last")).alias("asked"))
    )
    contents = (
        texts.join(asked.hint("shuffle_hash"), ["d", "h"])
        .select("d", "h", "text", "asked").mapInArrow(_contents(length), MARKS + ", content binary")
    )
    refined = contents.repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _refined(length), MARKS)
    repeats = (
        marks.where(F.col("kind") == REPEAT).unionByName(refined).groupBy("d", "h")
        .agg(F.collect_list(F.struct("first", "last")).alias("repeats"))
    )
    rest = texts.select("rest").schema["rest"]
    out = "n_bytes long, n_removed long, n_spans long, begins array<long>, ends array<long>, kept binary"
    schema = pa.schema([
        pa.field("rest", to_arrow_type(rest.dataType)), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
        ("kept", pa.binary()),
    ])
    return (
        texts.join(repeats.hint("shuffle_hash"), ["d", "h"], "left")
        .select("text", "repeats", "rest")
        .mapInArrow(_kept(length, characters, schema),
                    f"rest {rest.dataType.simpleString()}, {out}")
    )
