"""Operator 12: documents drawn by importance for a target distribution.

Features of a text are its runs of consecutive words, hashed to buckets. Counts
of all buckets over the documents and over the target texts give each bucket a
gain, the floored thousandfold log of the smoothed ratio; a document's weight is
the floored mean of the gains of its features, looked up as arrays. A Gumbel
draw hashed from the id is added, and the highest sums are a sample without
replacement.

The order of all documents long enough comes from a distributed radix sort,
least significant digit first, of the composite key (score falling, id rising).
A row's position tells its block; in each pass every block is counted and ranked
by digit, in the order of positions, and the counts before a (digit, block) give
the destination of each of its rows, and with that its next block. Blocks have a
fixed number of rows, so the hottest digit is spread over all blocks that hold
it, and a repeated task finds the same positions. After the last pass a position
is the final rank.

A null or empty text has no features: weight 0, not drawn. A null ``doc_id``
draws as the empty id and comes after all others among equal scores. Rows with
equal ids and scores are told apart by place only. Empty tables give no rows; an
empty target leaves gains that come from the documents alone. Columns other than
id and text are not read. A text is taken in parts cut between words, so a long
one needs no list of all its words.
"""

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialogprep.llm.common import SLICE_BYTES, per_worker, record_batch, share, stored

BUCKETS = 10_000
SEED = 2024
# Of one pass: values of a digit, and rows of a block, in bits.
DIGIT_BITS, BLOCK_BITS = 11, 17
# Features whose bucket a worker remembers.
REMEMBERED = 1 << 19

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BETWEEN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")

_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
    ("weight", pa.int64()), ("score", pa.int64()),
])
_COUNTED = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


class Buckets(dict):
    """Bucket of a feature; the latest features are remembered."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[feature] = crc32(feature) % self.size
        return found


def word_parts(text: bytes, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """Words of a text with A-Z lower-cased, in lists made of about ``limit`` bytes."""
    start = 0
    while start < len(text):
        cut = _BETWEEN.search(text, start + limit) if len(text) - start > limit else None
        stop = cut.start() if cut else len(text)
        yield _WORD.findall(text[start:stop].lower())
        start = stop


def features(
    text: bytes, lengths: tuple[int, int], buckets: Buckets, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs that end with them) of the parts of a text, one after the other."""
    shortest, longest = lengths
    carried: list[bytes] = []
    for words in word_parts(text, limit):
        known, whole = len(carried), carried + words
        found = []
        for n in range(shortest, longest + 1):
            first = max(0, known - n + 1)
            runs = whole[first:] if n == 1 else [
                b" ".join(whole[i:i + n]) for i in range(first, len(whole) - n + 1)]
            found += map(buckets.__getitem__, runs)
        yield len(words), np.array(found, np.int64)
        carried = whole[len(whole) - longest + 1:] if longest > 1 else []


def bucket_counts(texts: DataFrame, lengths: tuple[int, int], size: int) -> np.ndarray:
    """How many features of all texts (text) each bucket has: a sum for each task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(size), np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(_bytes(text), lengths, buckets):
                    np.add.at(total, found, 1)
        held = np.flatnonzero(total)
        yield record_batch(_COUNTED, held.astype(np.int32), total[held])

    counts = texts.select("text").mapInArrow(run, "bucket int, n long")
    out = np.zeros(size, np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def _bytes(text: pa.StringScalar) -> bytes:
    data = text.as_buffer()
    return data.to_pybytes() if data is not None else b""


def gains(held: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The gain of each bucket from its count in the documents and in the target."""
    size, s, t = len(held), int(held.sum()), int(wanted.sum())
    return np.array([
        math.floor(1000 * math.log((b + 1) * (s + size) / ((a + 1) * (t + size))))
        for a, b in zip(held.tolist(), wanted.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    key = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(key).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, lengths: tuple[int, int], seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    shared = share(docs.sparkSession, gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = per_worker(shared, lambda value: value)
        buckets = Buckets(len(gain))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc_id, text in zip(ids, batch.column(1)):
                n_words = n = total = 0
                for words, found in features(_bytes(text), lengths, buckets):
                    n_words, n = n_words + words, n + len(found)
                    total += int(gain[found].sum())
                weight = total // n if n else 0
                rows.append((doc_id, n_words, n, weight, weight + gumbel(doc_id, seed)))
            if rows:
                yield record_batch(_SCORED, *zip(*rows))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long")


class Key:
    """Digits of the composite key (score falling, null id last, id rising), lowest first."""

    def __init__(self, lowest: int, highest: int, first_id: int, last_id: int):
        self.highest, self.first_id = highest, first_id
        self.low = (last_id - first_id).bit_length()
        bits = self.low + (2 * (highest - lowest) + 1).bit_length()
        self.shifts = range(0, bits, DIGIT_BITS)

    def digits(self, score: np.ndarray, ids: pa.Array, shift: int) -> np.ndarray:
        absent = np.asarray(ids.is_null())
        # Differences of ids may pass 63 bits, so they are taken as unsigned.
        low = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        low = np.where(absent, np.uint64(0), low - np.uint64(self.first_id % 2**64))
        high = ((self.highest - score) * 2 + absent).astype(np.uint64)
        if shift >= self.low:
            digit = high >> np.uint64(shift - self.low)
        else:
            digit = low >> np.uint64(shift)
            if shift + DIGIT_BITS > self.low:
                digit |= high << np.uint64(self.low - shift)
        return (digit & np.uint64((1 << DIGIT_BITS) - 1)).astype(np.int64)


def _counting_pass(rows: DataFrame, key: Key, shift: int) -> DataFrame:
    """Adds ``digit`` and ``turn``, how many rows of the same block and digit come before."""
    kind = pa.schema([(c, pa.int64()) for c in [*rows.columns, "digit", "turn"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before = None, None
        for batch in batches:
            names = batch.schema.names
            score = batch.column(names.index("score")).to_numpy()
            digits = key.digits(score, batch.column(names.index("doc_id")), shift)
            blocks = batch.column(names.index("block")).to_numpy()
            turn = np.empty(len(digits), np.int64)
            borders = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for start, stop in zip(borders, borders[1:]):
                if start == stop:
                    continue
                if blocks[start] != block:
                    block, before = blocks[start], np.zeros(1 << DIGIT_BITS, np.int64)
                some = digits[start:stop]
                order = np.argsort(some, kind="stable")
                counts = np.bincount(some, minlength=1 << DIGIT_BITS)
                begins = np.cumsum(counts) - counts
                turn[start + order] = np.arange(stop - start) - begins[some[order]] + before[some[order]]
                before += counts
            yield record_batch(kind, *batch.columns, digits, turn)

    ddl = ", ".join(f"{name} long" for name in kind.names)
    return rows.repartition("block").sortWithinPartitions("pos").mapInArrow(run, ddl)


def _destinations(counted: DataFrame) -> DataFrame:
    """(digit, block, start): rows with a smaller digit, or this digit in an earlier block."""
    counts = counted.groupBy("digit", "block").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each value of a digit: a window over a fixed number of rows.
    below = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
        "digit", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("_below"))
    return counts.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        F.broadcast(digits), "digit").select(
        "digit", "block", (F.col("_below") + F.col("_inside")).alias("start"))


def radix_sorted(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, score and other longs) with ``place`` 0, 1, ... by falling score and
    rising id, nulls last. A column ``pos`` tells rows apart and was written with them."""
    lowest, highest, first_id, last_id = rows.agg(
        F.min("score"), F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    if lowest is None:
        return rows.withColumn("place", F.col("pos")).drop("pos")
    key = Key(lowest, highest, first_id or 0, last_id or 0)
    columns = rows.columns
    for shift in key.shifts:
        blocks = rows.withColumn("block", F.shiftright("pos", BLOCK_BITS))
        counted = stored(_counting_pass(blocks, key, shift), "radix")
        moved = counted.join(_destinations(counted), ["digit", "block"])
        rows = moved.withColumn("pos", F.col("start") + F.col("turn")).select(*columns)
    return rows.withColumnRenamed("pos", "place")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, fewest_words: int = 20,
    lengths: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document of ``docs`` (doc_id, text).

    ``rank`` is null unless the document is among the ``percent`` percent drawn
    of those with ``fewest_words`` words or more, towards the texts of ``target``.
    """
    held = bucket_counts(docs, lengths, buckets)
    gain = gains(held, bucket_counts(target, lengths, buckets))
    rows = stored(
        scored(docs, gain, lengths, seed).withColumn("pos", F.monotonically_increasing_id()), "scored")
    able = rows.where(F.col("n_words") >= fewest_words)
    drawn = able.count() * percent // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return radix_sorted(able).select(*columns, rank.alias("rank")).unionByName(
        rows.where(F.col("n_words") < fewest_words).select(*columns, F.lit(None).cast("long").alias("rank")))
