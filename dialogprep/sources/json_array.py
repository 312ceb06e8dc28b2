"""JSON arrays of any size in many tasks.

A file that is one array of objects is read by Spark's text reader with ``}`` as
the end of a line, so that it splits wherever Spark cuts files and no row is
longer than the text between two braces. Whether a brace ends a record depends
on the strings and brackets before it. A first pass finds, for each split, how
it changes both; sums over the splits of a file, a row for each, tell every
split the state it begins in. A second pass then cuts the records out, and those
that reach over splits are put together from their pieces.

Arrays that follow each other on lines of their own read the same. Text between
records must be what JSON allows there; a file where it is not is no array and
is left to the caller.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialogprep.sources.scratch import stored

# States of splits are broadcast, 17 bytes each.
MAX_SPLITS = 1 << 22

_FIRST = re.compile(rb"[ \t\r\n]*(?:\[[ \t\r\n]*\][ \t\r]*\n[ \t\r\n]*)*\[[ \t\r\n]*")
_BETWEEN = re.compile(
    rb"[ \t\r\n]*(?:,|\][ \t\r]*\n[ \t\r\n]*(?:\[[ \t\r\n]*\][ \t\r]*\n[ \t\r\n]*)*\[)[ \t\r\n]*")
_LAST = re.compile(rb"[ \t\r\n]*\](?:[ \t\r]*\n[ \t\r\n]*\[[ \t\r\n]*\])*[ \t\r\n]*")
_NONE = re.compile(rb"[ \t\r\n]*\[[ \t\r\n]*\](?:[ \t\r]*\n[ \t\r\n]*\[[ \t\r\n]*\])*[ \t\r\n]*")

RECORD, HEAD, TAIL, NO_ARRAY = 0, 1, 2, 3
_CUT = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("kind", pa.int32()),
    ("text", pa.binary()),
])
_CUT_DDL = "file string, block long, at long, kind int, text binary"
# Texts leave Python in batches of about so many bytes.
OUTPUT_BYTES = 1 << 22


def _steps() -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(b"[{")], table[list(b"]}")] = 1, -1
    return table


_STEP = _steps()


class Scan:
    """Strings and brackets of a text that comes part by part."""

    def __init__(self, in_string: bool = False, depth: int = 0):
        self.in_string, self.depth, self.escaped = in_string, depth, False

    def quoted(self, data: np.ndarray) -> np.ndarray:
        """For each byte, whether it lies in a string; a string's last quote does not."""
        quotes = np.flatnonzero(data == 0x22)
        slash = data == 0x5C
        if self.escaped or slash.any():
            other = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
            run = np.arange(len(data)) - other
            run[other < 0] += self.escaped  # slashes that began in the last part
            before = np.where(quotes > 0, run[quotes - 1], int(self.escaped))
            quotes = quotes[before % 2 == 0]
            self.escaped = bool(run[-1] % 2)
        turns = np.zeros(len(data), np.int32)
        turns[quotes] = 1
        inside = ((np.cumsum(turns) + self.in_string) % 2).astype(bool)
        self.in_string = bool(inside[-1])
        return inside

    def depths(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each byte lies in a string, the depth of brackets behind it)."""
        inside = self.quoted(data)
        depth = self.depth + np.cumsum(np.where(inside, 0, _STEP[data]), dtype=np.int64)
        self.depth = int(depth[-1])
        return inside, depth


def fragments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, block, value): texts that end before a brace, in order within a split."""
    return spark.read.option("lineSep", "}").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def begins_with_array(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, is_array): whether the first character of each file is a bracket.

    A pass over the files within the JVM; the first row of a split has its
    smallest number.
    """
    first = F.substring(F.ltrim(F.col("value").cast("string"), F.lit(" \t\r\n")), 1, 1) == "["
    numbered = fragments(spark, paths).where("block = 0").select(
        "file", (F.monotonically_increasing_id() * 2 + F.coalesce(first, F.lit(False)).cast("int")).alias("n"))
    return numbered.groupBy("file").agg((F.min("n") % 2 == 1).alias("is_array"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    """(file, block, fragments) of the rows of each split in each batch."""
    for batch in batches:
        files, blocks = batch.column(0), batch.column(1).to_numpy()
        names = files.dictionary_encode()
        places = names.indices.to_numpy()
        borders = np.flatnonzero((np.diff(places) != 0) | (np.diff(blocks) != 0)) + 1
        for start, stop in zip([0, *borders.tolist()], [*borders.tolist(), batch.num_rows]):
            if start < stop:
                yield (files[start].as_py(), int(blocks[start]),
                       batch.column(2).slice(start, stop - start).to_pylist())


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, turns, out, inside): quotes of a split, and how its brackets change the
    depth if it begins outside or inside a string."""
    own, scan, turns, sums = None, None, 0, [0, 0]

    def row():
        return pa.RecordBatch.from_pylist([{
            "file": own[0], "block": own[1], "turns": int(scan.in_string), "out": sums[0], "inside": sums[1]}])

    for file, block, parts in _by_split(batches):
        if (file, block) != own:
            if own is not None:
                yield row()
            own, scan, sums = (file, block), Scan(), [0, 0]
        data = np.frombuffer(b"}".join(parts) + b"}", np.uint8)
        inside = scan.quoted(data)
        steps = _STEP[data].astype(np.int64)
        sums[0] += int(steps[~inside].sum())
        sums[1] += int(steps[inside].sum())
    if own is not None:
        yield row()


def split_states(cut: DataFrame) -> DataFrame:
    """(file, block, in_string, depth, first, last): the state in which each split begins."""
    changes = stored(cut.mapInArrow(
        _changes, "file string, block long, turns long, out long, inside long"), "splits")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    quoted = changes.withColumn("in_string", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1)
    step = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("out"))
    return quoted.withColumn("step", step).select(
        "file", "block", "in_string", F.coalesce(F.sum("step").over(before), F.lit(0)).alias("depth"),
        F.lag("block").over(order).isNull().alias("first"), F.lead("block").over(order).isNull().alias("last"))


class _Split:
    """Cuts the records out of one split."""

    def __init__(self, file: str, block: int, state: tuple[bool, int, bool, bool]):
        self.file, self.block = file, block
        in_string, depth, self.first, self.last = state
        self.scan = Scan(in_string, depth)
        self.within = depth > 1
        self.sound = self.within or not in_string
        self.before, self.held, self.at = b"", None, 0

    def add(self, parts: list[bytes]) -> Iterator[tuple]:
        """Rows (file, block, at, kind, text) of the records that end in these fragments.

        The last fragment waits: no brace follows it if it is the last of the file.
        """
        if not self.sound:
            return
        if self.held is not None:
            parts = [self.held, *parts]
        self.held = parts[-1]
        if len(parts) > 1:
            yield from self._cut(b"}".join(parts[:-1]) + b"}")

    def _cut(self, text: bytes) -> Iterator[tuple]:
        data = np.frombuffer(text, np.uint8)
        inside, depth = self.scan.depths(data)
        ends = np.flatnonzero((data == 0x7D) & ~inside & (depth == 1)) + 1
        start = 0
        for stop in ends.tolist():
            piece = self.before + text[start:stop]
            start, self.before = stop, b""
            if self.within:
                self.within = False
                yield self.file, self.block, None, HEAD, piece
                continue
            row = self._begun(piece, RECORD)
            yield row
            if row[3] == NO_ARRAY:
                return
        self.before += text[start:]

    def _begun(self, piece: bytes, kind: int) -> tuple:
        """The record behind the text that leads to it, if that may stand there."""
        brace = piece.find(b"{")
        lead = _FIRST if self.first and not self.at else _BETWEEN
        if brace < 0 or not lead.fullmatch(piece, 0, brace):
            self.sound = False
            return self.file, self.block, None, NO_ARRAY, None
        self.at += 1
        return self.file, self.block, self.at - 1, kind, piece[brace:]

    def end(self) -> Iterator[tuple]:
        """What the split leaves: the begin of a record, or the end of the file."""
        if self.sound and not self.last:
            yield from self._cut(self.held + b"}")
            if self.sound and self.before:
                if self.within:
                    yield self.file, self.block, None, HEAD, self.before
                else:
                    yield self._begun(self.before, TAIL)
        elif self.sound:
            close = _NONE if self.first and not self.at else _LAST
            self.sound = not self.within and close.fullmatch(self.before + self.held) is not None
        if not self.sound:
            yield self.file, self.block, None, NO_ARRAY, None


def _batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4] or b"") + 100
        if size >= OUTPUT_BYTES:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)


def cut_records(spark: SparkSession, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """((file, block, at, text) of the objects of all files that are arrays, (file) of the others).

    ``block`` is the start of the split that a record begins in and ``at`` counts
    the records of a split. The cut texts are written once and read back.
    """
    cut = fragments(spark, names)
    listed = split_states(cut).limit(MAX_SPLITS + 1).toArrow()
    if len(listed) > MAX_SPLITS:
        raise ValueError("too many splits; raise spark.sql.files.maxPartitionBytes or read fewer files at once")
    columns = [listed[c].to_pylist() for c in ("file", "block", "in_string", "depth", "first", "last")]
    shared = spark.sparkContext.broadcast({(f, b): tuple(state) for f, b, *state in zip(*columns)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            split = None
            for file, block, parts in _by_split(batches):
                if split is None or (split.file, split.block) != (file, block):
                    if split is not None:
                        yield from split.end()
                    split = _Split(file, block, shared.value[file, block])
                yield from split.add(parts)
            if split is not None:
                yield from split.end()

        yield from _batched(rows())

    found = stored(cut.mapInArrow(run, _CUT_DDL), "cut")
    refused = found.where(F.col("kind") == NO_ARRAY).select("file").distinct()
    sound = found.join(refused, "file", "left_anti")
    # Two pieces for each split at most, so a file's pieces are few.
    order = Window.partitionBy("file").orderBy("block", "kind")
    pieces = sound.where(F.col("kind").isin(HEAD, TAIL)).withColumn(
        "record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    whole = pieces.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("_p"), F.max("at").alias("at"))
    spanning = whole.select(
        "file", F.col("_p")[0]["block"].alias("block"), "at",
        F.aggregate("_p", F.lit(b""), lambda text, p: F.concat(text, p["text"])).alias("text"))
    return sound.where(F.col("kind") == RECORD).select("file", "block", "at", "text").unionByName(spanning), refused
