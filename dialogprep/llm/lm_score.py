"""Operator 6: log-probabilities of texts by a gated recurrent language model.

Tokens are the words between ASCII white space, with A-Z in lower case, and one
end after each text. All words of the learned texts are counted; a text's base
score gives each token (count + 1) / (all + distinct + 1).

The network reads ids of the commonest words, an end and an unknown word, and
its output softmax is factored by classes. An unknown word is spelled out by the
smoothed counts of all other words, so that the score is a log-probability of
the complete text. Training is truncated backpropagation: the state runs through
every text, and every window is learned from. Learned texts are dealt by a hash to
rounds, and in a round to trainers of about equal tokens, in an order of their
own, so that neither the split of the input nor the number of tasks matters and a
trainer learns from as much however large the corpus is. The trainers of a round
begin with the average of the round before, weighted by tokens and taken as whole
numbers, so that their order does not matter.

Counts of the commonest ``SHARED`` words are broadcast; other words meet their
counts in a join, one row for each text and word. A null text is empty and has
the end alone. Rows with the same id and text are one document to the join and
learned from each time. An empty table gives an empty result; with nothing to
learn from, the base score is 0 and the network knows only its start.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.llm import recurrent as net
from dialogprep.llm.common import (
    binaries, per_worker, record_batch, row_slices, share, stored, word_lists,
)

SHARED = 1 << 18
# Words a task counts before it passes them on.
COUNTED_AT_ONCE = 400_000
# Tasks that add up the parameters of all others before the driver does.
ADDERS = 64
# Bytes of text that are learned from, or scored, side by side: the steps of the longest text
# are made once for all of them.
TEXT_BYTES = 16 << 20
_SCALE, _WEIGHT = 1 << 24, 4096
# Times that parameters are averaged, and tokens that a trainer learns from before it.
ROUNDS, TRAINER_TOKENS = 3, 2_000_000


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all words of ``text``; the end is the empty word. Tasks add up first."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in row_slices(batches, "text"):
            texts = binaries(batch.column("text"))
            counts[b""] += len(texts)
            for text in texts:
                for words in word_lists(text.lower()):
                    counts.update(words)
            if len(counts) > COUNTED_AT_ONCE:
                yield record_batch(schema, list(counts), list(counts.values()))
                counts.clear()
        yield record_batch(schema, list(counts), list(counts.values()))

    counted = docs.select("text").mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")


class Lexicon:
    """Ids and counts of the commonest words."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.place = {word: i for i, word in enumerate(words)}
        self.log_count = np.log10(np.append(counts, 0) + 1.0)  # the last is for a word not here

    def read(self, text: bytes, others: Counter | None = None) -> np.ndarray:
        """Places of the words, -1 for words that are not here, which ``others`` counts."""
        get, parts = self.place.get, [np.zeros(0, np.int64)]
        for words in word_lists(text.lower()):
            places = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
            parts.append(places)
            if others is not None:
                others.update([words[i] for i in np.flatnonzero(places < 0).tolist()])
        return np.concatenate(parts)


    def read_all(self, texts: list[bytes]) -> tuple[list[np.ndarray], pa.Array, pa.Array]:
        """Places by text as ``read`` gives them; by text the words that are not here and how
        often they occur. Each different word is looked up once."""
        if len(texts) == 1 and len(texts[0]) > TEXT_BYTES:
            others: Counter = Counter()
            places = self.read(texts[0], others)
            return ([places], pa.array([list(others)], pa.list_(pa.binary())),
                    pa.array([list(others.values())], pa.list_(pa.int64())))
        words, cuts = _words(texts)
        known, which = words.dictionary, words.indices.to_numpy()
        different = known.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.place.get, different, repeat(-1)), np.int64, len(different))
        places = place[which]
        unknown = np.flatnonzero(places < 0)
        text = np.searchsorted(cuts, unknown, "right") - 1
        size = max(1, len(known))
        keys, times = np.unique(text * size + which[unknown], return_counts=True)
        text, word = np.divmod(keys, size)
        offsets = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
        return (np.split(places, cuts[1:-1]),
                pa.ListArray.from_arrays(offsets, known.take(pa.array(word))),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64))))


def _words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(lower-case words of all texts, how many are before each text and before the end)"""
    codes = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    inside = (codes != 0x20) & ((codes < 0x09) | (codes > 0x0D))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    data = codes[inside]
    offsets = np.append(np.flatnonzero(begins[inside]), len(data)).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words.dictionary_encode(), np.searchsorted(np.flatnonzero(begins), at)


def _ids(places: np.ndarray) -> np.ndarray:
    """Ids of the network: the end, unknown, and the first words of the lexicon."""
    known = (places >= 0) & (places < net.WORDS)
    return np.append(np.where(known, places + 2, net.UNKNOWN), net.END)


def _train(docs: DataFrame, shared, start: np.ndarray, trainers: int) -> np.ndarray:
    """The average of what ``trainers`` learn from the texts of (key, text), from ``start`` on."""
    size = len(start)
    schema = pa.schema([("task", pa.int32()), ("weight", pa.int64()), ("values", pa.binary())])
    ddl = "task int, weight long, values binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = shared[1].value
        lexicon = Lexicon(words[:net.WORDS], counts[:net.WORDS])
        adam, tokens = net.Adam(net.unpack(start)), 0
        for batch in row_slices(batches, "text", TEXT_BYTES):
            texts = [_ids(lexicon.read(t)) for t in binaries(batch.column("text"))]
            tokens += sum(map(len, texts))
            net.train(adam, texts)
        if adam.steps:
            weight = -(-tokens // _WEIGHT)
            values = np.rint(net.pack(adam.p).astype(np.float64) * _SCALE).astype(np.int64) * weight
            yield record_batch(schema, [TaskContext.get().partitionId()], [weight],
                               [values.tobytes()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, values = 0, np.zeros(size, np.int64)
        for batch in batches:
            weight += sum(batch.column("weight").to_pylist())
            for row in batch.column("values"):
                values += np.frombuffer(row.as_buffer(), np.int64)
        if weight:
            yield record_batch(schema, [0], [weight], [values.tobytes()])

    dealt = docs.repartition(trainers, "key").sortWithinPartitions("key", "text")
    parts = dealt.select("text").mapInArrow(learn, ddl)
    weight, values = 0, np.zeros(size, np.int64)
    for row in parts.repartition(ADDERS, "task").mapInArrow(add, ddl).toLocalIterator():
        weight += row["weight"]
        values += np.frombuffer(row["values"], np.int64)
    return (values / (weight * _SCALE)).astype(np.float32) if weight else start


ROWS = ("doc_id long, h int, n_tokens long, n_unknown long, n_rare long, common double, "
        "other double, model double, rare array<binary>, times array<long>")


def score(docs: DataFrame, learned: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of whole texts.

    ``learned`` is a condition on the columns of ``docs`` for the texts to learn from.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 32).cast("int").alias("h"),
        F.coalesce(learned, F.lit(False)).alias("learned"))
    lessons = narrow.where("learned").select(F.xxhash64("doc_id", "h").alias("key"), "text")
    words = stored(count_words(lessons), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = lessons.count()
    commonest = (words.where(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(SHARED)
                 .toArrow())
    known, counts = commonest.column("word").to_pylist(), commonest.column("c").to_numpy()
    own = counts[:net.WORDS]
    rest, rest_distinct = total - ends - int(own.sum()), distinct - (ends > 0) - len(own)
    shared = share(spark, (known, counts))
    start = net.pack(net.initial(np.concatenate([[ends, rest], own])))
    parameters, trainers = start, max(1, total // (ROUNDS * TRAINER_TOKENS))
    for turn in range(ROUNDS if ends else 0):
        part = lessons.where(F.pmod(F.shiftright("key", 32), F.lit(ROUNDS)) == turn)
        parameters = _train(part, shared, parameters, trainers)
    _, model = share(spark, parameters)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("h", pa.int32()), ("n_tokens", pa.int64()),
        ("n_unknown", pa.int64()), ("n_rare", pa.int64()), ("common", pa.float64()),
        ("other", pa.float64()), ("model", pa.float64()), ("rare", pa.list_(pa.binary())),
        ("times", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, p = per_worker(shared, lambda x: Lexicon(*x)), net.unpack(model.value)
        for batch in row_slices(batches, "text", TEXT_BYTES):
            places, rare, times = lexicon.read_all(binaries(batch.column("text")))
            texts = list(map(_ids, places))
            unknown = [x[(x < 0) | (x >= net.WORDS)] for x in places]
            yield record_batch(
                schema, batch.column("doc_id"), batch.column("h"), [len(x) for x in texts],
                [len(x) for x in unknown], [int((x < 0).sum()) for x in places],
                [float(lexicon.log_count[x].sum()) for x in places],
                [float(lexicon.log_count[x].sum()) for x in unknown],
                net.score(p, texts) / np.log(10), rare, times)

    scored = stored(narrow.select("doc_id", "h", "text").mapInArrow(read, ROWS), "scored")
    rare = _rare(scored, words)
    joined = scored.drop("rare", "times").join(
        rare.withColumnsRenamed({"doc_id": "_d", "h": "_h"}),
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    more, found = F.coalesce("logs", F.lit(0.0)), F.coalesce("found", F.lit(0))
    end = float(np.log10(ends + 1))
    ends_known = 1 if ends else 0
    return joined.select(
        "doc_id", "n_tokens",
        (F.col("n_tokens") - 1 - F.col("n_rare") + found + ends_known).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("common") + more + end
         - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("other") + more
         - F.col("n_unknown") * float(np.log10(rest + rest_distinct + 1))).alias("score"),
    )


def _rare(scored: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, h, logs, found): sums over the words of each text that are not broadcast."""
    spread = scored.select("doc_id", "h", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        F.col("w.rare").alias("word"), "doc_id", "h", F.col("w.times").alias("n"))
    # repeated rows count once; grouping and join use the one shuffle by word
    once = spread.repartition("word").groupBy("word", "doc_id", "h").agg(F.min("n").alias("n"))
    counted = once.join(words, "word").withColumn("logs", F.col("n") * F.log10(F.col("c") + 1.0))
    return counted.groupBy("doc_id", "h").agg(F.sum("logs").alias("logs"), F.sum("n").alias("found"))
