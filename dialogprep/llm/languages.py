"""Operator 1: language proportions of each document by expectation-maximisation.

A document is taken as n-grams drawn from a mixture of languages. Its features
are the byte trigrams around each letter of the lower-cased text, hashed to
``BUCKETS`` values; each language has a smoothed distribution over them, counted
over all labelled documents. For one document the languages are chosen step by
step: the language along which the likelihood rises fastest is added, the
proportions are fitted anew by expectation-maximisation, and the addition stays
only if the log-likelihood rises by more than a penalty. Because the likelihood
is concave in the proportions, N times the steepest slope bounds the rise, so
most documents need no second fit.

A document whose text is null or has no letter is ``und`` with score 0 and no
languages; rows with a null text or label teach nothing. Repeated rows teach and
are answered each. Ties go to the first language in alphabetical order. With
nothing to learn from, every document is ``und``. Columns other than the id, the
text and (for learning) the label are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import (
    SLICE_BYTES, per_worker, record_batch, row_slices, share, slices, text_bytes,
)

BUCKETS = 1 << 15
SMOOTHING = 0.5
# Neighbouring trigrams overlap, so a letter is told three times; likelihoods are scaled down.
OVERLAP = 3.0
# A language must raise the scaled log-likelihood by this times log(number of n-grams).
PENALTY = 3.0
ROUNDS = 25
# The model is broadcast: at most so many languages, 0.25 MB each.
MAX_LANGUAGES = 256

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _symbols() -> np.ndarray:
    table = np.full(256, 0x20, np.uint32)
    table[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


SYMBOLS = _symbols()


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the trigram around each letter; a text is bordered by spaces."""
    offsets, data = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    symbols = np.concatenate([[0x20], SYMBOLS[data], [0x20]]).astype(np.uint32)
    middle = np.flatnonzero(symbols[1:-1] != 0x20)
    rows = np.searchsorted(offsets, middle, "right") - 1
    before = np.where(middle == offsets[rows], 0x20, symbols[middle])
    after = np.where(middle + 1 == offsets[rows + 1], 0x20, symbols[middle + 2])
    code = (before << 16 | symbols[middle + 1] << 8 | after).astype(np.uint32)
    return rows, ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, n), in order of rows and buckets."""
    rows, found = trigrams(texts)
    keys, n = np.unique(rows * BUCKETS + found, return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, n


def _long_counted(text: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``counted`` of one long text, part by part; a part is seen with the characters beside
    it, whose own trigrams are left to the next part."""
    data, total = text.as_py(), np.zeros(BUCKETS, np.int64)
    letters = lambda some: int((SYMBOLS[text_bytes(pc.utf8_lower(pa.array([some])))[1]] != 0x20).sum())
    for start in range(0, len(data), SLICE_BYTES):
        stop = start + SLICE_BYTES
        before, behind = data[max(0, start - 1):start], data[stop:stop + 1]
        found = trigrams(pa.array([before + data[start:stop] + behind]))[1]
        own = found[letters(before):len(found) - letters(behind)]
        total += np.bincount(own, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return np.zeros(len(found), np.int64), found, total[found]


def batch_counts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int, tuple]]:
    """(start, stop, counts) of row ranges that hold about ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for start, stop in slices(sizes, limit):
        some = texts.slice(start, stop - start)
        if stop - start == 1 and sizes[start] > 2 * SLICE_BYTES:
            yield start, stop, _long_counted(some[0])
        else:
            yield start, stop, counted(some)


class Model:
    """Log-probabilities of buckets by language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.array([counts[name] for name in self.languages], np.float64).reshape(-1, BUCKETS)
        table = (table + SMOOTHING) / (table.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
        self.p = np.ascontiguousarray(table.T)
        self.log_p = np.log(self.p)
        self.slice_bytes = max(1 << 16, min(SLICE_BYTES, (4 << 20) // max(1, len(self.languages))))

    def mixtures(self, size: int, rows: np.ndarray, found: np.ndarray, n: np.ndarray):
        """(proportions, log-likelihood of each single language), a row for each document.

        Documents without features have proportions of zero.
        """
        width = len(self.languages)
        proportions, alone = np.zeros((size, width)), np.zeros((size, width))
        docs, begins = np.unique(rows, return_index=True)
        if not len(docs) or not width:
            return proportions, alone
        n = n / OVERLAP
        total = np.add.reduceat(n, begins)
        single = np.add.reduceat(n[:, None] * self.log_p[found], begins)
        alone[docs] = single
        pi = np.zeros_like(single)
        pi[np.arange(len(docs)), single.argmax(1)] = 1
        likelihood = single.max(1)
        penalty = PENALTY * np.log(total + 1)
        own = np.repeat(np.arange(len(docs)), np.diff([*begins, len(rows)]))
        p, active = self.p[found], np.ones(len(docs), bool)
        while width > 1 and active.any():
            picked = active[own]
            at, ids = np.unique(own[picked], return_index=True)
            active[at] = self._widen(
                p[picked], n[picked], own[picked], at, ids, pi, likelihood, total, penalty)
        proportions[docs] = pi
        return proportions, alone

    def _widen(self, p, n, own, at, begins, pi, likelihood, total, penalty) -> np.ndarray:
        """Tries to add one language to each document of ``at``; whether it stayed."""
        mixed = np.einsum("ij,ij->i", p, pi[own])
        slope = np.add.reduceat((n / mixed)[:, None] * p, begins) / total[at, None] - 1
        slope[pi[at] > 0] = -1
        best = slope.argmax(1)
        hopeful = total[at] * slope[np.arange(len(at)), best] > penalty[at]
        kept = np.zeros(len(at), bool)
        if not hopeful.any():
            return kept
        place = np.searchsorted(at, own)
        use = hopeful[place]
        p, n, at, best = p[use], n[use], at[hopeful], best[hopeful]
        place = np.searchsorted(at, own[use])
        begins = np.searchsorted(place, np.arange(len(at)))
        trial = pi[at] * 0.9
        trial[np.arange(len(at)), best] = 0.1
        for _ in range(ROUNDS):
            mixed = np.einsum("ij,ij->i", p, trial[place])
            trial *= np.add.reduceat((n / mixed)[:, None] * p, begins) / total[at, None]
        mixed = np.einsum("ij,ij->i", p, trial[place])
        reached = np.add.reduceat(n * np.log(mixed), begins)
        better = reached - likelihood[at] > penalty[at]
        pi[at[better]], likelihood[at[better]] = trial[better], reached[better]
        kept[np.flatnonzero(hopeful)[better]] = True
        return kept


def learn(docs: DataFrame, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """Counts of buckets by language, over all whole labelled texts.

    Each task adds up its own documents, so that a row for each language and
    bucket of a task is shuffled, whatever language is the commonest.
    """
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("lang")
            for start, stop, (rows, found, n) in batch_counts(batch.column("text"), SLICE_BYTES):
                names = labels.slice(start, stop - start).dictionary_encode()
                kinds = names.indices.to_numpy()[rows]
                for kind, name in enumerate(names.dictionary.to_pylist()):
                    own = total.setdefault(name, np.zeros(BUCKETS, np.int64))
                    mine = kinds == kind
                    own += np.bincount(found[mine], n[mine], BUCKETS).astype(np.int64)
        for name, own in total.items():
            present = np.flatnonzero(own)
            yield record_batch(schema, [name] * len(present), present, own[present])

    taught = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    taught = taught.where("text is not null and lang is not null")
    sums = taught.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        if row.lang not in counts and len(counts) == MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        counts.setdefault(row.lang, np.zeros(BUCKETS, np.int64))[row.bucket] = row.n
    return counts


def predict(docs: DataFrame, counts: dict[str, np.ndarray],
            id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages, proportions) of every whole text.

    ``score`` is the proportion of the predicted language; where it is the only
    one, the probability that it rather than the next best wrote the text. The
    model is broadcast; there is no shuffle.
    """
    shared = share(docs.sparkSession, counts)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()),
        ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_worker(shared, Model)
        names = np.array(model.languages, object)
        for batch in batches:
            texts = batch.column("text")
            for start, stop, features in batch_counts(texts, model.slice_bytes):
                some = texts.slice(start, stop - start)
                pi, alone = model.mixtures(stop - start, *features)
                out = []
                for i, own in enumerate(pi):
                    if not own.any() or not _LETTER.search(some[i].as_py() or ""):
                        out.append((UNKNOWN, 0.0, [], []))
                        continue
                    chosen = np.flatnonzero(own)
                    chosen = chosen[np.argsort(-own[chosen], kind="stable")]
                    score = min(1.0, float(own[chosen[0]]))
                    if len(chosen) == 1 and len(names) > 1:
                        second, first = np.partition(alone[i], -2)[-2:]
                        score = float(1 / (1 + np.exp(second - first)))
                    out.append((names[chosen[0]], score, names[chosen].tolist(), own[chosen].tolist()))
                ids = batch.column("doc_id").slice(start, stop - start)
                yield record_batch(schema, ids, *map(list, zip(*out)))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(
        run, "doc_id long, lang_pred string, score double, languages array<string>, "
             "proportions array<double>")


def accept(docs: DataFrame, counts: dict[str, np.ndarray], least: float,
           text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which one language makes up ``least``."""
    shared = share(docs.sparkSession, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_worker(shared, Model)
        for batch in batches:
            texts = batch.column(text)
            for start, stop, features in batch_counts(texts, model.slice_bytes):
                pi, _ = model.mixtures(stop - start, *features)
                good = [bool(own.any() and own.max() >= least
                             and _LETTER.search(texts[start + i].as_py() or ""))
                        for i, own in enumerate(pi)]
                yield batch.slice(start, stop - start).filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
