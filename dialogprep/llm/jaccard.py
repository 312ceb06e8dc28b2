"""Operator 8: documents joined by the Jaccard similarity of their word n-grams.

Words are runs between ASCII white space, with A-Z in lower case. A document's
set holds its distinct n-word shingles, or the whole sequence if it has fewer
words. Documents link when the intersection is at least ``share`` of the union,
and the result names the component of each document.

Documents with the same set are one unit. Units are paired size-aware:

- a *light* set (size up to a boundary) writes down all its subsets of the sizes
  that a partner must have in common with it; equal subsets meet;
- a *heavy* set is found by scanning inverted lists. With ``c`` shingles in common
  the first ``n - c + 3`` shingles of both sets, in one order for all sets, have
  at least three in common, so only these are listed, and a pair must be met in
  three lists. Shingles that stand in many sets come last in that order, so that
  a common passage is listed only where nothing else is left;
- the boundary is the one with the least cost over the sizes of all documents:
  subsets written against entries written and scanned.

Lists are read twice. First each entry is paired with the leader of its list, the
unit of compatible size with the fewest rare shingles, which links a group of
copies without pairing all of them. Then all pairs of a list are looked at whose
units are not in one component yet. Each set has a bitmap that tells, for each of
``BITS`` classes of shingles, whether it holds an odd number of them; two sets
differ in at least as many shingles as their bitmaps in bits, so pairs whose
bitmaps differ too much are not made. No other pair is left out. Every candidate
is verified with the complete sets.

A null text, and one without words, has an empty set, links with nothing and is
its own component. Rows with the same set are in one component whatever their
ids; a component's id is its least id that is not null. An empty table gives an
empty result. Shingles and sets are told apart by 64-bit and 128-bit hashes.
"""

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm import graph
from dialogprep.llm.common import per_worker, record_batch, share, slices, stored, text_bytes
from dialogprep.llm.suffix_dedup import CHUNK, Hashes

MET = 3  # lists in which a heavy pair must meet
LIGHT_MOST = 40
SCAN_COST = 2.0
# Shingles counted as common: in at least COMMON sets, of which a task has seen SEEN at
# once; the MOST_COMMON commonest are broadcast. They only choose the order of shingles.
COMMON, SEEN, MOST_COMMON = 32, 4, 1 << 18
SHINGLES_AT_ONCE = 1 << 20
BITS = 512
# Pairs a task puts together before it writes them.
PAIRS_AT_ONCE = 1 << 20

_NO_ID = -(2**63)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    out = values + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    out = (out ^ (out >> np.uint64(30))) * _ODD[0]
    out = (out ^ (out >> np.uint64(27))) * _ODD[1]
    return out ^ (out >> np.uint64(31))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the words of a chunk of texts."""
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    begins = ~space[1:-1] & space[:-2]
    ends = ~space[1:-1] & space[2:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begins[borders] |= ~space[1:-1][borders]
    ends[borders - 1] |= ~space[1:-1][borders - 1]
    first, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = Hashes(_LOWER[data], 0).between(first, stop)
    return np.searchsorted(offsets, first, "right") - 1, _mixed(hashes, 1) + (stop - first).astype(np.uint64)


def _document_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, document, word hash) for row ranges; words of a long text are cut at
    white space into chunks and put together again."""
    offsets, data = text_bytes(texts)
    for start, stop in slices(np.diff(offsets), CHUNK):
        low, high = offsets[start], offsets[stop]
        if high - low <= CHUNK:
            yield start, stop, *_words(data[low:high], offsets[start:stop + 1] - low)
            continue
        parts, at = [], low
        while at < high:
            cut = min(at + CHUNK, high)
            if cut < high:
                back = np.flatnonzero(_SPACE[data[at:cut]])
                cut = at + int(back[-1]) + 1 if len(back) else cut
            if cut - at == CHUNK and cut < high and not _SPACE[data[cut - 1]]:
                # a word longer than a chunk: told apart by a digest of all its bytes
                more = np.flatnonzero(_SPACE[data[cut:high]])
                cut = cut + int(more[0]) if len(more) else high
                parts.append(np.array([_long_word(data[at:cut])]))
            else:
                parts.append(_words(data[at:cut], np.array([0, cut - at]))[1])
            at = cut
        words = np.concatenate(parts)
        yield start, stop, np.zeros(len(words), np.int64), words


def _long_word(data: np.ndarray) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(_LOWER[data].tobytes()).digest()[:8], "little"))


class Sets:
    """Shingle sets of a range of documents, one after the other."""

    def __init__(self, size: int, doc: np.ndarray, words: np.ndarray, n: int):
        count = np.bincount(doc, minlength=size)
        begin = np.cumsum(count) - count
        place = np.arange(len(doc)) - begin[doc]
        whole = (count[doc] < n) & (place == 0)
        full = place + n <= count[doc]
        at = np.flatnonzero(full | whole)
        shingle = np.zeros(len(at), np.uint64)
        for i in range(n):
            here = np.minimum(at + i, max(len(words) - 1, 0))
            inside = i < count[doc[at]]
            shingle = np.where(inside, _mixed(shingle ^ words[here], i + 2), shingle)
        owner = doc[at]
        by = np.lexsort([shingle, owner])
        owner, shingle = owner[by], shingle[by]
        new = np.ones(len(by), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
        self.owner, self.shingle = owner[new], shingle[new]
        self.n = np.bincount(self.owner, minlength=size)
        self.begin = np.cumsum(self.n) - self.n
        self.marks = []
        for seed in (101, 102):
            mark = np.zeros(size, np.uint64)
            filled = self.n > 0
            if len(self.owner):
                mark[filled] = np.add.reduceat(_mixed(self.shingle, seed), self.begin[filled])
            self.marks.append(mark.view(np.int64))

    def bitmaps(self) -> list[bytes]:
        """For each class of shingles whether the set holds an odd number of them."""
        at = self.owner * BITS + (_mixed(self.shingle, 103) % np.uint64(BITS)).astype(np.int64)
        odd = np.bincount(at, minlength=len(self.n) * BITS).reshape(-1, BITS) & 1
        return [row.tobytes() for row in np.packbits(odd.astype(bool), axis=1)]

    def distinct(self) -> np.ndarray:
        """The first document of each set that is not empty."""
        _, first = np.unique(np.stack([*self.marks, self.n]), axis=1, return_index=True)
        return np.sort(first[self.n[first] > 0])


def sets_of(texts: pa.Array, n: int) -> Iterator[tuple[int, int, Sets]]:
    for start, stop, doc, words in _document_words(texts):
        yield start, stop, Sets(stop - start, doc, words, n)


class Rule:
    """Sizes and overlaps for a similarity of ``share[0] / share[1]``."""

    def __init__(self, share_: tuple[int, int]):
        self.num, self.den = share_

    def least(self, n):
        """The smallest partner, and overlap, of a set of ``n``."""
        return -(-self.num * n // self.den)

    def difference(self, both):
        """The most shingles that only one of two sets holds, of ``both`` sizes together."""
        return both * (self.den - self.num) // (self.den + self.num)

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def listed(self, n):
        return n - self.least(n) + np.minimum(MET, self.least(n))

    def subset_sizes(self, n: int) -> list[int]:
        largest = n * self.den // self.num
        return sorted({self.overlap(n, b) for b in range(n, largest + 1)}
                      | {self.overlap(a, n) for a in range(self.least(n), n + 1)})

    def subsets(self, n: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n))

    def boundary(self, sizes: dict[int, int]) -> int:
        """The light size up to which writing subsets costs least."""
        best, light, x_best = None, 0.0, 0
        heavy = {s: k * float(self.listed(s)) * (1 + SCAN_COST) for s, k in sizes.items()}
        for x in range(LIGHT_MOST + 1):
            light += sizes.get(x, 0) * self.subsets(x) if x else 0
            cost = light + sum(v for s, v in heavy.items() if s >= self.least(x + 1))
            if best is None or cost < best:
                best, x_best = cost, x
        return x_best


PROFILE = "kind int, a long, b long, doc_id long, h int, n long, bits binary"
_PROFILE = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()),
                      ("doc_id", pa.int64()), ("h", pa.int32()), ("n", pa.int64()),
                      ("bits", pa.binary())])


def _profiles(n: int):
    """Kind 0: a document's set (a, b) and its size. Kind 1: a shingle a seen in n sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = [], 0
        for batch in batches:
            for start, stop, sets in sets_of(batch.column("text"), n):
                yield record_batch(
                    _PROFILE, np.zeros(stop - start, np.int32), *sets.marks,
                    batch.column("doc_id").slice(start, stop - start),
                    batch.column("h").slice(start, stop - start), sets.n, sets.bitmaps())
                own = np.isin(sets.owner, sets.distinct())
                seen.append(sets.shingle[own])
                size += len(seen[-1])
                if size >= SHINGLES_AT_ONCE:
                    yield common(seen)
                    seen, size = [], 0
        if seen:
            yield common(seen)

    def common(seen: list[np.ndarray]) -> pa.RecordBatch:
        shingle, count = np.unique(np.concatenate(seen), return_counts=True)
        some = count >= SEEN
        shingle, count = shingle[some].view(np.int64), count[some]
        return record_batch(_PROFILE, np.ones(len(shingle), np.int32), shingle,
                            np.zeros(len(shingle), np.int64),
                            pa.nulls(len(shingle), pa.int64()), pa.nulls(len(shingle), pa.int32()),
                            count, pa.nulls(len(shingle), pa.binary()))

    return run


ENTRY = "key long, a long, b long, n long, rare long, weight int"
_ENTRY = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()),
                    ("rare", pa.int64()), ("weight", pa.int32())])


def _entries(n: int, rule: Rule, light: int, shared):
    """List entries of each distinct set of a batch: subsets if light, else first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = per_worker(shared, lambda rows: np.sort(rows))
        for batch in batches:
            for _, _, sets in sets_of(batch.column("text"), n):
                chosen = sets.distinct()
                yield from _listed(sets, chosen, rule, light, common)
                yield from _subsets(sets, chosen[sets.n[chosen] <= light], rule)

    return run


def _listed(sets: Sets, chosen: np.ndarray, rule: Rule, light: int, common: np.ndarray):
    chosen = chosen[sets.n[chosen] >= rule.least(light + 1)]
    own = np.isin(sets.owner, chosen)
    owner, shingle = sets.owner[own], sets.shingle[own]
    place = np.minimum(np.searchsorted(common, shingle), max(len(common) - 1, 0))
    frequent = common[place] == shingle if len(common) else np.zeros(len(shingle), bool)
    rare = np.bincount(owner[~frequent], minlength=len(sets.n))
    by = np.lexsort([_mixed(shingle, 7), frequent, owner])
    owner, shingle = owner[by], shingle[by]
    size = np.bincount(owner, minlength=len(sets.n))
    rank = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    first = rank < rule.listed(sets.n)[owner]
    owner, shingle = owner[first], shingle[first]
    yield record_batch(_ENTRY, shingle.view(np.int64), sets.marks[0][owner], sets.marks[1][owner],
                       sets.n[owner], rare[owner], np.ones(len(owner), np.int32))


def _subsets(sets: Sets, chosen: np.ndarray, rule: Rule):
    """A subset is known by its size and the sum of its members' hashes."""
    for doc in chosen.tolist():
        size = int(sets.n[doc])
        values = _mixed(sets.shingle[sets.begin[doc]:sets.begin[doc] + size], 11).tolist()
        total, keys = sum(values), []
        for c in rule.subset_sizes(size):
            keys += [((total - sum(left)) * 2654435769 + c) % 2**64
                     for left in combinations(values, size - c)]
        k = len(keys)
        yield record_batch(_ENTRY, _mixed(np.array(keys, np.uint64), 13).view(np.int64),
                           np.full(k, sets.marks[0][doc]), np.full(k, sets.marks[1][doc]),
                           np.full(k, size), np.zeros(k, np.int64), np.full(k, MET, np.int32))


def _changes(columns: dict[str, np.ndarray], keys: tuple[str, ...]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before."""
    new = np.ones(len(columns[keys[0]]), bool)
    new[1:] = np.any([columns[k][1:] != columns[k][:-1] for k in keys], axis=0)
    return new


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows in order of ``keys`` in tables that hold complete keys."""
    waiting = None
    for batch in batches:
        own = pa.Table.from_batches([batch])
        waiting = own if waiting is None else pa.concat_tables([waiting, own])
        cut = int(np.flatnonzero(_changes({k: waiting.column(k).to_numpy() for k in keys}, keys))[-1])
        if cut:
            yield waiting.slice(0, cut)
            waiting = waiting.slice(cut)
    if waiting is not None and waiting.num_rows:
        yield waiting


LIST = ENTRY + ", la long, lb long, ha long, hb long"
_LIST = pa.schema([*_ENTRY, *((c, pa.int64()) for c in ("la", "lb", "ha", "hb"))])


def _led(rule: Rule):
    """Entries of lists with several units, each with its leader (la, lb) and the list's
    first unit (ha, hb).

    Rows come in the order of key, size class, rare shingles and unit. Only the
    leader of the class at hand is kept, so that a list may have any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a first entry not written yet; the leader (key, class, a, b, n); the first unit
        held, last, head = None, None, None
        for batch in batches:
            key, a, b, n, rare, weight, band = (
                batch.column(c).to_numpy().tolist() for c in (*_ENTRY.names, "band"))
            out = []
            for row in zip(key, a, b, n, rare, weight, band):
                if held is not None and held[0] == row[0]:
                    if (row[1], row[2]) == held[1:3] and last[0] == row[0]:
                        continue  # the same unit from another task
                    if not last[6]:
                        out.append((*held[:6], held[1], held[2], *head))
                        last = (*last[:6], True)
                if last is None or last[0] != row[0]:
                    last = (row[0], row[6], row[1], row[2], row[3], row[4], False)
                    held, head = row, row[1:3]
                    continue
                if last[1] != row[6]:
                    last = (row[0], row[6], row[1], row[2], row[3], row[4], True)
                out.append((*row[:6], last[2], last[3], *head))
                held = row
            if out:
                yield record_batch(_LIST, *map(list, zip(*out)))

    return run


def _crossing(rule: Rule):
    """Pairs of lists whose units have different labels and can be similar.

    Rows come in the order of the lists' first units and of lists; a pair that is
    met in several lists with one first unit is written once, with its weight.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "la", "lb", "n")]
                       + [("weight", pa.int32())])

    def written(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if found:
            rows = np.concatenate(found, axis=1)
            rows = rows[:, np.lexsort(rows[3::-1])]
            new = np.ones(rows.shape[1], bool)
            new[1:] = (rows[:4, 1:] != rows[:4, :-1]).any(0)
            at = np.flatnonzero(new)
            if len(at):
                weight = np.add.reduceat(rows[5], at)
                yield record_batch(schema, *rows[:5, at], np.minimum(weight, MET).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, head, size = [], None, 0
        for rows in _groups(batches, ("ha", "hb", "key")):
            columns = {c: rows.column(c).to_numpy() for c in rows.column_names if c != "bits"}
            bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64)
            bits = bits.reshape(rows.num_rows, BITS // 64)
            ends = np.append(np.flatnonzero(_changes(columns, ("ha", "hb", "key"))[1:]) + 1,
                             rows.num_rows)
            start = 0
            for end in ends.tolist():
                own = columns["ha"][start], columns["hb"][start]
                if own != head or size > PAIRS_AT_ONCE:
                    yield from written(found)
                    found, head, size = [], own, 0
                for pairs in _pairs(rule, columns, bits, start, end):
                    found.append(pairs)
                    size += pairs.shape[1]
                start = end
        yield from written(found)

    return run


def _pairs(rule: Rule, columns: dict, bits: np.ndarray, start: int, end: int):
    """(a, b, la, lb, n, weight) of the entries ``start`` to ``end`` with later ones."""
    a, b, n, weight, ra, rb = (columns[c] for c in ("a", "b", "n", "weight", "ra", "rb"))
    for block in range(start, end, 1024):
        first = np.arange(block, min(block + 1024, end))
        for ahead in range(1, end - block):
            i = first[first + ahead < end]
            j = i + ahead
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            use = ((ra[i] != ra[j]) | (rb[i] != rb[j])) & (small >= rule.least(large))
            i, j, small = i[use], j[use], small[use]
            differ = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
            near = differ <= rule.difference(n[i] + n[j])
            i, j, small = i[near], j[near], small[near]
            if len(i):
                low = (a[i] < a[j]) | (a[i] == a[j]) & (b[i] < b[j])
                i, j = np.where(low, i, j), np.where(low, j, i)
                yield np.stack([a[i], b[i], a[j], b[j], small, weight[i].astype(np.int64)])


def _verified(rule: Rule):
    """Pairs whose sets are similar enough."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "la", "lb")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            own, other = batch.column("own"), batch.column("other")
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (own, other))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if rule.den * both >= rule.num * (len(x) + len(y) - both):
                    kept.append(i)
            yield record_batch(schema, *(batch.column(c).take(pa.array(kept, pa.int64()))
                                         for c in schema.names))

    return run


def _contents(n: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("own", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, sets in sets_of(batch.column("text"), n):
                parts = [sets.shingle[i:i + k].tobytes() for i, k in zip(sets.begin, sets.n)]
                yield record_batch(schema, *sets.marks, parts)

    return run


class Join:
    """The steps of one join; ``texts`` has doc_id, h (a hash of the text) and text."""

    def __init__(self, docs: DataFrame, words: int, share_: tuple[int, int],
                 id_col: str, text: str):
        self.spark, self.words, self.rule = docs.sparkSession, words, Rule(share_)
        self.texts = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32).cast("int").alias("h"),
            F.coalesce(text, F.lit("")).alias("text"))
        rows = stored(self.texts.mapInArrow(_profiles(words), PROFILE), "profiles")
        self.profiles = rows.where("kind = 0").drop("kind", "bits")
        self.bitmaps = rows.where("kind = 0 and n > 0").groupBy("a", "b").agg(
            F.first("bits").alias("bits"))
        commonest = (
            rows.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= COMMON).orderBy(F.desc("n"), "a").limit(MOST_COMMON)
        )
        common = commonest.select("a").toArrow().column("a").to_numpy().astype(np.int64)
        _kinds = self.profiles.where(f"n > 0 and n <= {2 * LIGHT_MOST * share_[1] // share_[0]}")
        sizes = {r.n: r["count"] for r in _kinds.groupBy("n").count().collect()}
        self.light = self.rule.boundary(sizes)
        self.common = share(self.spark, common.view(np.uint64))

    def lists(self) -> DataFrame:
        entries = self.texts.select("text").mapInArrow(
            _entries(self.words, self.rule, self.light, self.common), ENTRY)
        # classes of sizes: within one, the smallest set can be similar to the largest
        band = F.floor(F.log(F.col("n")) / float(np.log(self.rule.den / self.rule.num) * 0.999))
        order = ["key", "band", "rare", "a", "b"]
        ranged = entries.withColumn("band", band).repartition("key").sortWithinPartitions(*order)
        return stored(ranged.mapInArrow(_led(self.rule), LIST), "lists")

    def sets(self, units: DataFrame) -> DataFrame:
        """(a, b, own): the complete sets of ``units``, from one document of each."""
        one = self.profiles.where("n > 0").groupBy("a", "b").agg(
            F.min(F.struct("doc_id", "h")).alias("one"))
        wanted = units.join(one, ["a", "b"]).select("one.doc_id", "one.h")
        texts = self.texts.join(
            wanted.withColumnsRenamed({"doc_id": "_d", "h": "_h"}).hint("shuffle_hash"),
            F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left_semi")
        return texts.select("text").mapInArrow(
            _contents(self.words), "a long, b long, own binary").dropDuplicates(["a", "b"])

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of the distinct ``pairs`` (a, b, la, lb)."""
        units = pairs.select("a", "b").unionByName(
            pairs.select(F.col("la").alias("a"), F.col("lb").alias("b"))).distinct()
        sets = self.sets(units)
        leaders = sets.select(F.col("a").alias("la"), F.col("b").alias("lb"),
                              F.col("own").alias("other"))
        both = pairs.join(sets, ["a", "b"]).join(leaders, ["la", "lb"])
        return both.select("a", "b", "la", "lb", "own", "other").mapInArrow(
            _verified(self.rule), "a long, b long, la long, lb long")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(links between units, components of units)"""
        lists = self.lists()
        own, other = _units()
        unit = [own.alias("a"), other.alias("b")]
        led = lists.where("a <> la or b <> lb").groupBy("a", "b", "la", "lb").agg(
            F.sum("weight").alias("met"), F.first("n").alias("n"))
        close = led.where(F.col("met") >= F.least(F.lit(MET), self._least("n")))
        tried = stored(close.select("a", "b", "la", "lb"), "tried")
        links = stored(self.verify(tried), "links")
        roots = graph.components(links.select(*unit))
        named = roots.select("node.a", "node.b", F.col("root.a").alias("ra"),
                             F.col("root.b").alias("rb"))
        labelled = lists.join(named, ["a", "b"], "left").select(
            "key", "a", "b", "n", "weight", "ha", "hb", F.coalesce("ra", "a").alias("ra"),
            F.coalesce("rb", "b").alias("rb"))
        mixed = labelled.groupBy("key").agg(
            F.min(F.struct("ra", "rb")).alias("low"), F.max(F.struct("ra", "rb")).alias("high"))
        mixed = mixed.where("low <> high").select("key")
        crossing = (
            labelled.join(mixed, "key").join(self.bitmaps, ["a", "b"])
            .repartition("ha", "hb", F.pmod("key", F.lit(4)))
            .sortWithinPartitions("ha", "hb", "key", "n", "a", "b")
            .mapInArrow(_crossing(self.rule), "a long, b long, la long, lb long, n long, weight int")
            .groupBy("a", "b", "la", "lb").agg(F.sum("weight").alias("met"), F.first("n").alias("n"))
        )
        crossing = crossing.where(
            F.col("met") >= F.least(F.lit(MET), self._least("n")))
        done = tried.select(F.least(own, other).alias("x"), F.greatest(own, other).alias("y"))
        new = crossing.select("a", "b", "la", "lb").join(
            done, (own == F.col("x")) & (other == F.col("y")), "left_anti")
        more = stored(self.verify(stored(new, "crossing")), "links")
        links = links.unionByName(more)
        if more.isEmpty():
            return links, roots
        return links, graph.components(
            roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            .unionByName(more.select(*unit)))

    def _least(self, n: str):
        return F.ceil(F.col(n) * self.rule.num / self.rule.den - F.lit(1e-9)).cast("int")


def _units():
    """The two units of a pair, as structs of the same fields."""
    return (F.struct("a", "b"),
            F.struct(F.col("la").alias("a"), F.col("lb").alias("b")))


def join(docs: DataFrame, words: int, share_: tuple[int, int],
         id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, n_shingles, component_id, a, b) of every row of ``docs``.

    ``share_`` is the least similarity as a fraction. ``h`` is a hash of the text;
    ``a`` and ``b`` together name the component also where no id is known.
    """
    steps = Join(docs, words, share_, id_col, text)
    _, roots = steps.links()
    named = roots.select("node.a", "node.b", F.col("root.a").alias("ra"), F.col("root.b").alias("rb"))
    own = steps.profiles.join(named, ["a", "b"], "left").select(
        "doc_id", "h", "n", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    least = own.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("component_id"))
    return own.join(least, ["a", "b"], "left").select(
        "doc_id", "h", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "a", "b")


def one_of_each(docs: DataFrame, words: int, share_: tuple[int, int],
                id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that stand for their components.

    Of each component the row with the least id stays (a null id comes last, equal
    ids in the order of a hash of the text), of repeated rows one. Documents with
    an empty set are no copies of each other and stay. The texts are shuffled once.
    """
    joined = join(docs, words, share_, id_col, text)
    mine = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = joined.where("n_shingles > 0").groupBy("a", "b").agg(F.min(mine).alias("one"))
    empty = joined.where("n_shingles = 0").select("doc_id", "h").distinct()
    keys = first.select("one.doc_id", "one.h").unionByName(empty).select(
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("_d"), F.col("h").alias("_h"))
    marked = docs.withColumns({
        "_d": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)),
        "_h": F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32).cast("int")})
    kept = marked.join(keys.hint("shuffle_hash"), ["_d", "_h"], "left_semi")
    return kept.dropDuplicates(["_d", "_h"]).select(*docs.columns)
