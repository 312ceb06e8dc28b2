"""Operator 11: phrases of two to four words that belong together, by language.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and
those into words between spaces and tabs. Every shard of texts becomes a
weighted acyclic automaton of its sorted four-word sequences (shorter ones end
with a mark), in which the weight of a prefix is how often that phrase occurs.
Automata are split by prefix ranges, hashed from the first words, and those of
one range are united and their weights summed; where ranges would be too many
for one shard, in several rounds, each of which unites some shards and splits
finer. Phrases frequent in a range leave it as rows, and the parts of candidates
are looked up among them.

A range is named by the first two words and by as many more as it takes to meet
a word that is not common. So a range holds a bounded share of all sequences
however common its first words are; phrases of common words alone are counted in
several ranges, and their counts are summed afterwards.

A null or empty text has no words, a null language is ``und``. Repeated rows
count each. Empty tables give no rows, also texts without any frequent phrase.
Columns other than text and language are not read. A long text is taken in parts
that see the three words behind them.
"""

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.llm.automata import (
    DEPTH, END, Automaton, binary_array, packed, restricted, union, unpacked,
)
from dialogprep.llm.common import per_worker, record_batch, share, stored
from dialogprep.operators.skew import salted_join

UNKNOWN = "und"
# Bytes of text that make a shard, and words that a range holds at most on average.
SHARD_BYTES = 8 << 20
RANGE_WORDS = 1_000_000
# A shard is split into at most 2^10 ranges at once.
SPLIT_BITS = 10
# A word is common if it would fill a range and makes up more than this share of all words;
# so there are at most 50,000.
COMMON_SHARE = 2e-5

_CUT = re.compile(rb"[ \t.,;:!?\x0A-\x0D]")
_AHEAD = re.compile(rb"(?:[ \t]*+[^ \t.,;:!?\x0A-\x0D]++){0,3}")


def _bytes_where(pattern: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[b for b in range(256) if re.match(pattern, bytes([b]))]] = True
    return found


_BREAK = _bytes_where(rb"[.,;:!?\x0A-\x0D]")
_SPLIT = _bytes_where(_CUT.pattern)


def _parts(text: bytes, limit: int) -> Iterator[tuple[bytes, bytes]]:
    """(part, the words behind it that its last words' sequences reach)."""
    start = 0
    while start < len(text):
        cut = _CUT.search(text, start + limit) if len(text) - start > limit else None
        stop = cut.start() if cut else len(text)
        yield text[start:stop], _AHEAD.match(text, stop).group()
        start = stop


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list]]:
    """(language, parts of its texts) whenever about ``limit`` bytes have come."""
    held: dict[str, list] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = text.as_buffer()
            for part in _parts(data.to_pybytes(), limit) if data is not None else ():
                held.setdefault(UNKNOWN if lang is None else lang, []).append(part)
                size += len(part[0])
                if size >= limit:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _words(parts: list[tuple[bytes, bytes]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, number of the piece of each, whether it belongs to a part itself)."""
    data = np.frombuffer(b"\n".join([own + ahead for own, ahead in parts]).lower(), np.uint8)
    inside = np.concatenate([[False], ~_SPLIT[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    piece = np.cumsum(_BREAK[data], dtype=np.int64)[starts]
    own = np.ones(len(starts), bool)
    if any(ahead for _, ahead in parts):
        sizes = np.array([[len(a), len(b)] for a, b in parts])
        begins = np.cumsum(sizes.sum(1) + 1) - sizes.sum(1) - 1
        at = np.searchsorted(begins, starts, "right") - 1
        own = starts < begins[at] + sizes[at, 0]
    return binary_array(np.ascontiguousarray(data[inside[1:-1]]), lengths), piece, own


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, f) of every word of ``docs`` (lang, text): a row for each shard and word."""
    kind = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, parts in _shards(batches, SHARD_BYTES):
            words, _, own = _words(parts)
            counts = words.filter(pa.array(own)).value_counts()
            yield record_batch(
                kind, pa.array([lang] * len(counts)),
                counts.field("values").cast(pa.binary()).cast(pa.string()), counts.field("counts"))

    return docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, f long").groupBy(
        "lang", "phrase").agg(F.sum("f").alias("f"))


def shard_automaton(parts: list[tuple[bytes, bytes]]) -> tuple[pa.Array, Automaton]:
    """Sorted words of a shard and the automaton of its sequences of two words or more."""
    words, piece, own = _words(parts)
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    ids = rank[coded.indices.to_numpy()] if len(order) else np.zeros(0, np.int32)
    columns = [ids]
    for ahead in range(1, DEPTH):
        column = np.full(len(ids), END, np.int32)
        same = piece[ahead:] == piece[:-ahead]
        column[:-ahead][same] = ids[ahead:][same]
        columns.append(column)
    starts = own & (columns[1] != END)
    sequences = np.array(columns)[:, starts]
    return coded.dictionary.take(pa.array(order)), Automaton.of(
        sequences, np.ones(sequences.shape[1], np.int64))


def _range_hashes(lang: str, words: pa.Array, sequences: np.ndarray, common: np.ndarray) -> np.ndarray:
    """A number of 32 bits from the language and the words that name a sequence's range."""
    of_word = np.array([crc32(w) for w in words.to_pylist()] + [0], np.uint64)
    state = np.full(sequences.shape[1], crc32(lang.encode()), np.uint64)
    going = np.ones(sequences.shape[1], bool)
    for d, column in enumerate(sequences):
        mixed = (state ^ of_word[column]) * np.uint64(0x9E3779B97F4A7C15)
        state = np.where(going, mixed ^ (mixed >> np.uint64(29)), state)
        if d:
            going &= common[sequences[:d + 1]].all(axis=0)
    return state >> np.uint64(32)


def _common_flags(words: pa.Array, lang: str, common: dict[str, list[str]]) -> np.ndarray:
    """Whether each word is common; a last entry stands for the end mark."""
    listed = pa.array([w.encode() for w in common.get(lang, [])], pa.large_binary())
    return np.append(pc.is_in(words, value_set=listed).to_numpy(zero_copy_only=False), False)


_RANGED = pa.schema([("range", pa.int64()), ("lang", pa.string()), ("automaton", pa.binary())])


def _split(lang: str, words: pa.Array, automaton: Automaton, common, bits: int) -> Iterator[pa.RecordBatch]:
    """The automaton by ranges of ``bits`` bits."""
    if not len(automaton.weights):
        return
    sequences = automaton.sequences()
    hashes = _range_hashes(lang, words, sequences, _common_flags(words, lang, common))
    ranges = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(ranges, kind="stable")
    found, begins = np.unique(ranges[order], return_index=True)
    for key, start, stop in zip(found.tolist(), begins, [*begins[1:], len(order)]):
        some = order[start:stop]
        blob = packed(*restricted(words, sequences[:, some], automaton.weights[some]))
        yield record_batch(_RANGED, [key], [lang], [blob])


def _united(
    batches: Iterator[pa.RecordBatch], limit: int
) -> Iterator[tuple[str, pa.Array, Automaton]]:
    """(language, words, automaton) of neighbouring rows (range, lang, automaton) of one key.

    Parts are united as soon as they hold ``limit`` sequences more than their
    last union, so that repetitions never pile up.
    """
    key, parts, size, base = None, [], 0, 0
    for batch in batches:
        for *own, blob in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "automaton"))):
            if own != key and parts:
                yield key[1], *union(parts)
                parts, size, base = [], 0, 0
            key = own
            parts.append(unpacked(blob))
            size += len(parts[-1][1].weights)
            if size > 2 * base + limit:
                parts = [union(parts)]
                size = base = len(parts[0][1].weights)
    if parts:
        yield key[1], *union(parts)


def phrase_counts(docs: DataFrame, total: int, common: dict[str, list[str]], least: int) -> DataFrame:
    """(lang, phrase, n_words, f) of all phrases of two to four words that occur ``least`` times."""
    spark = docs.sparkSession
    shared = share(spark, common)
    bits = min(32, max(0, (total // RANGE_WORDS).bit_length()))
    levels = [min(bits, b) for b in range(SPLIT_BITS, bits + SPLIT_BITS, SPLIT_BITS)] or [0]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = per_worker(shared, lambda value: value)
        for lang, parts in _shards(batches, SHARD_BYTES):
            yield from _split(lang, *shard_automaton(parts), listed, levels[0])

    ddl = "range long, lang string, automaton binary"
    ranged = docs.select("lang", "text").mapInArrow(shards, ddl)
    for above, below in zip(levels, levels[1:]):
        # Some shards of a range at a time, as many as make about a range's words together.
        groups = max(1, total // (RANGE_WORDS << above))

        def finer(batches: Iterator[pa.RecordBatch], below=below) -> Iterator[pa.RecordBatch]:
            listed = per_worker(shared, lambda value: value)
            for lang, words, automaton in _united(batches, RANGE_WORDS):
                yield from _split(lang, words, automaton, listed, below)

        salt = F.pmod(F.xxhash64("automaton"), F.lit(groups))
        ranged = ranged.repartition("range", "lang", salt).sortWithinPartitions("range", "lang").mapInArrow(finer, ddl)

    kind = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("f", pa.int64())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = per_worker(shared, lambda value: value)
        for lang, words, automaton in _united(batches, RANGE_WORDS):
            flags = _common_flags(words, lang, listed)
            for n in range(2, DEPTH + 1):
                symbols, f = automaton.prefixes(n)
                # A prefix of common words alone has other parts in other ranges.
                kept = (symbols[-1] != END) & ((f >= least) | flags[symbols].all(axis=0))
                phrases = pc.binary_join_element_wise(
                    *(words.take(pa.array(s[kept])) for s in symbols), pa.scalar(b" ", pa.large_binary()))
                yield record_batch(
                    kind, pa.array([lang] * int(kept.sum()), pa.string()),
                    phrases.cast(pa.binary()).cast(pa.string()), np.full(int(kept.sum()), n, np.int32), f[kept])

    rows = ranged.repartition("range", "lang").sortWithinPartitions("range", "lang").mapInArrow(
        counted, "lang string, phrase string, n_words int, f long")
    return rows.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _runs(words: Column, first: Column, last: Column) -> Column:
    """The words from place ``first`` to ``last`` as a phrase; places count from 1."""
    return F.array_join(F.slice(words, first, last - first + 1), " ")


def with_cuts(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, a, l, r, score) of all candidates, at their worst cut.

    Every part of a candidate is as frequent as the candidate, so it is found.
    A part such as a common word is asked for by very many candidates: it is salted.
    """
    words = F.split("phrase", " ", -1)
    candidates = frequent.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    sides = F.array(
        F.struct(F.lit(True).alias("left"), _runs(words, F.lit(1), F.col("k")).alias("part")),
        F.struct(F.lit(False).alias("left"), _runs(words, F.col("k") + 1, F.col("n_words")).alias("part")))
    asked = cuts.select("*", F.inline(sides))
    known = frequent.select("lang", F.col("phrase").alias("part"), "f")
    found = salted_join(asked, known, ["lang", "part"], ["phrase", "k", "left"], "inner")
    both = found.groupBy("lang", "phrase", "n_words", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"),
        F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    # Decimals, since the product may pass 64 bits.
    score = F.expr("(2000000 * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + r)").cast("long")
    return (
        both.groupBy("lang", "phrase", "n_words", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_w"))
        .select("lang", "phrase", "n_words", "a", "_w.l", "_w.r", "_w.score"))


def covering(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longest): the largest count of a longer phrase that holds a phrase."""
    words = F.split("phrase", " ", -1)
    runs = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("n_words") - 1),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda i: _runs(words, i, i + n - 1))))
    return frequent.where("n_words > 2").select("lang", "f", F.explode(F.array_distinct(runs)).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of each language of
    ``docs`` (lang, text). A phrase within a longer one that occurs ``covered`` percent as
    often gives way to it."""
    named = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    singles = stored(word_counts(named), "words")
    sums = stored(singles.groupBy("lang").agg(F.sum("f").alias("n")), "sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    common: dict[str, list[str]] = {}
    often = max(RANGE_WORDS, total * COMMON_SHARE)
    for lang, word in singles.where(F.col("f") > often).select("lang", "phrase").collect():
        common.setdefault(lang, []).append(word)
    frequent = stored(
        singles.where(F.col("f") >= least).select("lang", "phrase", F.lit(1).alias("n_words"), "f")
        .unionByName(phrase_counts(named, total, common, least)), "phrases")
    judged = with_cuts(frequent).join(covering(frequent), ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longest") < covered * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        judged.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= best)
        .join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
