"""Operator 9: token ids in files of independent, Huffman-coded blocks.

``write`` encodes every text with a tokenizer of the ``tokenizers`` library,
appends an end id to each document and orders the documents by id. Counts of
all ids give one canonical code with codes of at most ``CODE_LIMIT`` bits. A
block holds whole documents and can be decoded by itself, from any of its
checkpoints (the bit offset of every ``EVERY``-th id).

A file set is a folder with two Parquet tables, so that Spark commits the work
of each task once however often executors are lost: ``code`` (the length of
each id's code) and ``blocks`` (shard, block, first_id, n_ids, doc_ids, lengths,
checkpoints, bits). Shards are ranges of document ids; ``first_id`` counts from
the start of the shard.

A null text is empty and has the end id alone. A null id comes first; rows with
equal ids follow each other in the order of their size and content. An empty
table makes an empty file set.
"""

import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dialogprep.llm.common import (
    SLICE_BYTES, Remembered, binaries, per_worker, record_batch, row_slices, share, slices, stored,
    word_lists,
)
from dialogprep.llm.huffman import Code, code_lengths

CODE_LIMIT = 20
EVERY = 256
BLOCK_IDS = 1 << 18

# Parts whose ids each worker keeps, their length, and words given to the library at once.
MAX_REMEMBERED = 800_000
REMEMBERED_LENGTH = 64
WORDS_AT_ONCE = 256
# Bytes of texts that are cut into parts together.
CUT_TOGETHER = 4 << 20


# How the tokenizer of ``word_bpe_49k.json`` prepares a text.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same with the commonest first; of all branches only the last can begin as others do.
SPLIT_ALIKE = r"[\p{L}]+|[\p{N}]|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+"


def _latin_parts() -> re.Pattern:
    """``SPLIT`` for lower-cased texts of characters up to U+00FF."""
    parts = re.split(r"(\\p\{[LN]\}|\\s)", SPLIT_ALIKE)  # every class stands within brackets
    return re.compile("".join(
        "".join(f"\\x{i:02x}" for i in range(256) if regex.match(part, chr(i))) if k % 2 else part
        for k, part in enumerate(parts)))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cutter:
    """The parts of many texts of characters up to U+00FF at once, found with array operations."""

    SPACE, LETTER, DIGIT, OTHER = range(4)

    def __init__(self):
        kinds = [(self.LETTER, r"\p{L}"), (self.DIGIT, r"\p{N}"), (self.OTHER, r"[^\s\p{L}\p{N}]")]
        self.kinds = np.zeros(256, np.uint8)
        for kind, members in kinds:
            self.kinds[[i for i in range(256) if regex.match(members, chr(i))]] = kind
        self.endings = re.compile(rb"'(?:s|t|re|ve|m|ll|d)")

    def cut(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of lower-case Latin-1: the different parts, which of them follow each other, and how
        many do so before each text and before the end."""
        blob = b" ".join(texts)
        codes = np.frombuffer(blob, np.uint8)
        kinds = self.kinds[codes]
        before = np.concatenate([[self.SPACE], kinds[:-1]])[:len(kinds)]
        begins = ((kinds != before) | (kinds == self.DIGIT)) & (kinds != self.SPACE)
        found = np.array([m.span() for m in self.endings.finditer(blob)], np.int64).reshape(-1, 2)
        found = found[before[found[:, 0]] != self.OTHER]  # else it goes on the part before it
        begins[found[:, 0] + 1] = False
        after = found[:, 1][found[:, 1] < len(kinds)]
        begins[after] = kinds[after] != self.SPACE
        inside = kinds != self.SPACE
        data = codes[inside]
        offsets = np.append(np.flatnonzero(begins[inside]), len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        found = parts.dictionary_encode()
        _, offsets, data = found.dictionary.buffers()
        ends = np.frombuffer(offsets, np.int32, len(found.dictionary) + 1).tolist()
        letters = data.to_pybytes().decode("latin-1") if data else ""
        return ([letters[a:b] for a, b in zip(ends, ends[1:])], found.indices.to_numpy(),
                np.searchsorted(np.flatnonzero(begins), at))


class WordTokenizer:
    """The library's encoding of whole texts, asked once for each distinct part.

    Valid for tokenizers that drop white space and split there, so that words
    between ASCII white space are encoded independently. If the tokenizer
    prepares texts as ``word_bpe_49k.json`` does, a text of characters up to
    U+00FF without ``<|`` is cut into the smaller parts that the library itself
    would make of it, and the library's model encodes those: such texts are in
    normal form C, and their characters are put in lower case one by one. Short
    texts are cut together, and the ids of each different part looked up once.
    """

    def __init__(self, definition: str, kind: str = "<u4"):
        self.kind, self.width = kind, np.dtype(kind).itemsize
        self.library = Tokenizer.from_str(definition)
        self.known: dict[bytes, bytes] = {}
        self.latin = _latin_parts() if _prepares_alike(definition) else None
        self.cutter = _Cutter()
        self._tokenize, self._letters = self.library.model.tokenize, _byte_letters()
        size = self.library.get_vocab_size()
        self._packed = [i.to_bytes(4, "little")[:self.width] for i in range(size)]
        self.parts = Remembered(self._part, MAX_REMEMBERED, REMEMBERED_LENGTH)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned integers of ``kind``."""
        out, others, short = [b""] * len(texts), [], []
        for i, data in enumerate(texts):
            text = self._lowered(data)
            if text is None:
                others.append(i)
            elif len(text) <= SLICE_BYTES:
                short.append((i, text.encode("latin-1")))
            else:
                out[i] = b"".join(
                    [b"".join(map(self.parts.__getitem__, some)) for some in self._cut(text)])
        sizes = np.array([len(text) for _, text in short], np.int64)
        for start, stop in slices(sizes, CUT_TOGETHER):
            some = short[start:stop]
            for (i, _), ids in zip(some, self._encode_short([text for _, text in some])):
                out[i] = ids
        if len(others) == 1:
            out[others[0]] = b"".join(
                b"".join(self._known([p])) for p in word_lists(texts[others[0]]))
        elif others:
            lists = [[p for some in word_lists(texts[i]) for p in some] for i in others]
            for i, ids in zip(others, self._known(lists)):
                out[i] = ids
        return out

    def _encode_short(self, texts: list[bytes]) -> list[bytes]:
        parts, which, cuts = self.cutter.cut(texts)
        found = list(map(self.parts.__getitem__, parts))
        flat = np.frombuffer(b"".join(found), self.kind)
        sizes = np.array([len(ids) for ids in found], np.int64) // self.width
        begins, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begins - (ends - n), n) + np.arange(len(n) and ends[-1])]
        packed, at = ids.tobytes(), (np.append(0, ends)[cuts] * self.width).tolist()
        return [packed[a:b] for a, b in zip(at, at[1:])]

    def _part(self, part: str) -> bytes:
        letters = part
        if not (part.isascii() and part.isprintable()):
            letters = part.encode().decode("latin-1").translate(self._letters)
        return b"".join([self._packed[token.id] for token in self._tokenize(letters)])

    def _lowered(self, data: bytes) -> str | None:
        """A text whose words may be cut, in lower case; None for any other."""
        if self.latin is None or b"<|" in data:
            return None
        text = data.decode()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return text.lower()

    def _parts(self, data: bytes) -> Iterator[list]:
        text = self._lowered(data)
        yield from word_lists(data) if text is None else self._cut(text)

    def _cut(self, text: str) -> Iterator[list[str]]:
        if len(text) <= SLICE_BYTES:
            yield self.latin.findall(text)
        else:
            found = (m.group() for m in self.latin.finditer(text))
            while some := list(islice(found, 1 << 16)):
                yield some

    def _known(self, lists: list[list[bytes]]) -> list[bytes]:
        new = set()
        for words in lists:
            new.update(set(words).difference(self.known))
        if new and len(self.known) + len(new) > MAX_REMEMBERED:
            self.known.clear()
            new = set().union(*lists)
        self._learn(list(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in lists]

    def _learn(self, new: list[bytes]) -> None:
        for start in range(0, len(new), WORDS_AT_ONCE):
            some = new[start:start + WORDS_AT_ONCE]
            texts = [w.decode() for w in some]
            encoded = self.library.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(encoded.ids, self.kind)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            at = np.array([begin for begin, _ in encoded.offsets], np.int64)
            cuts = np.searchsorted(at, begins).tolist()
            packed, width = ids.tobytes(), self.width
            self.known.update(
                (w, packed[width * a:width * b]) for w, a, b in zip(some, cuts, cuts[1:]))


def _prepares_alike(definition: str) -> bool:
    given = json.loads(definition)
    try:
        split, level = given["pre_tokenizer"]["pretokenizers"]
        steps = given["normalizer"]["normalizers"]
        return (
            [s["type"] for s in steps] == NORMALIZERS
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and (split["type"], split["pattern"]) == ("Split", {"Regex": SPLIT})
            and (split["behavior"], split["invert"]) == ("Removed", True)
            and (level["type"], level["use_regex"]) == ("ByteLevel", False)
            and not level["add_prefix_space"]
            and all(t["content"].startswith("<|") for t in given["added_tokens"])
        )
    except (KeyError, TypeError, ValueError):
        return False


def encode(docs: DataFrame, definition: str, end_id: int, id_col: str = "doc_id",
           text: str = "text", kind: str = "<u4") -> DataFrame:
    """(doc_id, n_tokens, ids): the ids of each text and the end id, packed. No shuffle."""
    shared = share(docs.sparkSession, (definition, kind))
    end, width = np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = per_worker(shared, lambda given: WordTokenizer(*given))
        for batch in row_slices(batches, "text", CUT_TOGETHER):
            ids = [i + end for i in tokenizer.encode(binaries(batch.column("text")))]
            yield record_batch(schema, batch.column("doc_id"), [len(i) // width for i in ids], ids)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(packed: DataFrame, size: int, wide: bool) -> np.ndarray:
    """How often each of ``size`` ids occurs: one row per id and task is shuffled."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in row_slices(batches, "ids", 4 * SLICE_BYTES):
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind)
            counts += np.bincount(ids, minlength=size)
        present = np.flatnonzero(counts)
        yield record_batch(schema, present, counts[present])

    rows = packed.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n"))
    counts = np.zeros(size, np.int64)
    for id_, n in rows.toLocalIterator():  # at most one row for each entry of the vocabulary
        counts[id_] = n
    return counts


BLOCKS = ("shard int, block int, first_id long, n_ids long, doc_ids array<long>, "
          "lengths array<long>, checkpoints array<long>, bits binary")


def write(docs: DataFrame, path: str, definition: str, end_id: int,
          id_col: str = "doc_id", text: str = "text", shards: int | None = None) -> None:
    """Writes the file set of ``docs`` to a new folder that all executors share.

    The ids are stored once, because counting must end before coding starts, and
    shuffled once, by ranges of document ids.
    """
    spark = docs.sparkSession
    size = max(Tokenizer.from_str(definition).get_vocab_size(), end_id + 1)
    wide = size > 1 << 16
    kind = "<u4" if wide else "<u2"  # stored ids need two bytes where the vocabulary allows it
    packed = stored(encode(docs, definition, end_id, id_col, text, kind), "token-ids",
                    compression="zstd")
    lengths = code_lengths(id_counts(packed, size, wide), CODE_LIMIT)
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(
        f"{path}/code")
    shared = share(spark, lengths)
    schema = pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()),
        ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.list_(pa.int64())),
        ("bits", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = per_worker(shared, Code), TaskContext.get().partitionId()
        block = first = 0
        for batch in row_slices(batches, "ids", BLOCK_IDS * (4 if wide else 2)):
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind)
            bits, checkpoints = code.encode(ids, EVERY)
            yield record_batch(
                schema, [shard], [block], [first], [len(ids)],
                [batch.column("doc_id").to_pylist()], [batch.column("n_tokens").to_pylist()],
                [checkpoints], [bits],
            )
            block, first = block + 1, first + len(ids)

    order = ["doc_id", "n_tokens", "_mark"]
    marked = packed.withColumn("_mark", F.xxhash64("ids"))
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = marked.repartitionByRange(count, *order).sortWithinPartitions(*order)
    ranged.select("doc_id", "n_tokens", "ids").mapInArrow(run, BLOCKS).write.parquet(
        f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a file set; ``start`` counts the ids before.

    Only the totals of the shards, as many rows as the writing had partitions,
    meet in one task and are broadcast.
    """
    (row,) = spark.read.parquet(f"{path}/code").collect()
    shared = share(spark, np.frombuffer(row["lengths"], np.uint8))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    schema = pa.schema([
        ("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()),
        ("n_tokens", pa.int64()), ("ids", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = per_worker(shared, Code)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                checkpoints = row["checkpoints"].values.to_numpy()
                n = row["n_ids"].as_py()
                ids = code.decode(row["bits"].as_py(), checkpoints, n, EVERY).astype("<u4")
                sizes = row["lengths"].values.to_numpy()
                ends = np.cumsum(sizes)
                yield record_batch(
                    schema, np.full(len(sizes), row["shard"].as_py()), row["doc_ids"].values,
                    row["first_id"].as_py() + ends - sizes, sizes,
                    [p.tobytes() for p in np.split(ids, ends[:-1])],
                )

    decoded = blocks.select("shard", "first_id", "n_ids", "doc_ids", "lengths", "checkpoints",
                            "bits").mapInArrow(
        run, "shard int, doc_id long, at long, n_tokens long, ids binary")
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return decoded.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids"
    )
