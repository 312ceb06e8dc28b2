"""Operator 3: licence scan by the Dice coefficient over word bigrams.

Regions of a text are its lines, its paragraphs of several lines and, if it has
several paragraphs, the whole. A region's words are runs of ASCII letters and
digits in lower case. With A and B the sets of word pairs of a region and a
template, the score is 2 |A & B| / (|A| + |B|). A score of t or more needs
|B| t / (2 - t) <= |A| <= |B| (2 - t) / t, so templates outside these bounds are
not compared, nor are those that share no pair.

A template that no region reaches is also compared with every window of
consecutive words, across lines and paragraphs: a notice of several paragraphs
in a larger document, or a sentence within a longer line. A best window begins
and ends with a pair of the template, and neither pair occurs again in it, so
that only such windows are scored. A template within another one is found too.

The result has one row for each document and template that reaches t: the best
region, the first of equals, lines before paragraphs before the whole, or else
the best window with the lines it lies in, the first of equals. A null or
empty text matches nothing; repeated rows are scanned each. Columns other than
the id and the text are not read.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import binaries, per_worker, record_batch, row_slices, share

THRESHOLD = 0.8

# Notices and licence texts as they are published.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License");
        you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the
        License.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it
        under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This
        program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
        GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with
        or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
        DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this
        software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

_WORD = re.compile(rb"[a-z0-9]+")
_BLANK = re.compile(rb"[\x09\x0b-\x0d\x20]*")

Pairs = set[tuple[bytes, bytes]]


def pairs(data: bytes) -> Pairs:
    words = _WORD.findall(data.lower())
    return set(zip(words, words[1:]))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.templates = [(name, pairs(text.encode())) for name, text in sorted(templates.items())]
        self.templates = [(name, own) for name, own in self.templates if own]
        self.all = set().union(*(own for _, own in self.templates))
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.bounds = [(len(own) * low - 1e-9, len(own) * high + 1e-9) for _, own in self.templates]
        self.largest = max((high for _, high in self.bounds), default=0)

    def score(self, region: Pairs) -> Iterator[tuple[str, float]]:
        known = region & self.all
        if not known:
            return
        for (name, own), (low, high) in zip(self.templates, self.bounds):
            if low <= len(region) <= high:
                dice = 2 * len(known & own) / (len(region) + len(own))
                if dice >= self.threshold:
                    yield name, dice

    def regions(self, text: bytes, known: Pairs) -> Iterator[tuple[int, int, int, Pairs]]:
        """(kind, first line, lines, pairs). Regions with too many pairs for any template are
        left out. Words do not pair across lines: a pair that a line break cuts is added.
        ``known`` gets all pairs of the text that are a template's."""
        first, paragraphs, block, whole = 1, 0, _Union(self.largest), _Union(self.largest)
        lines, last = 0, b""
        for lines, line in enumerate(_lines(text), 1):
            if _BLANK.fullmatch(line):
                if lines - first > 1 and block.fits:
                    yield 1, first, lines - first, block.pairs
                first, block = lines + 1, _Union(self.largest)
                continue
            paragraphs += first == lines
            words = _WORD.findall(line.lower())
            own = set(zip(words, words[1:]))
            if words:
                known |= own & self.all
                if (last, words[0]) in self.all:
                    known.add((last, words[0]))
                last = words[-1]
            if len(own) <= self.largest:
                yield 0, lines, 1, own
            block.add(words, own)
            whole.add(words, own)
        if lines >= first + 1 and block.fits:
            yield 1, first, lines + 1 - first, block.pairs
        if paragraphs > 1 and whole.fits:
            yield 2, 1, lines, whole.pairs

    def scan(self, text: bytes, known: Pairs | None = None) -> list[tuple[str, float, int, int]]:
        """(template, score, first line, lines) of each template that a region reaches."""
        best: dict[str, tuple[float, int, int, int]] = {}
        for kind, first, n, region in self.regions(text, set() if known is None else known):
            for name, dice in self.score(region):
                found = (-dice, kind, first, n)
                if name not in best or found < best[name]:
                    best[name] = found
        return [(name, -dice, first, n) for name, (dice, _, first, n) in sorted(best.items())]

    def find(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """The same of each template that a region or else a window of words reaches."""
        known: Pairs = set()
        out = self.scan(text, known)
        found, words = {name for name, *_ in out}, None
        for (name, own), (low, high) in zip(self.templates, self.bounds):
            # a window has at least so many of the template's pairs
            if name not in found and len(known & own) >= low:
                words = words or _Words(text)
                dice, first, n = words.best(own, high)
                if dice >= self.threshold:
                    out.append((name, dice, first, n))
        return sorted(out)


class _Union:
    """Pairs of a growing region, given up once they are more than any template allows."""

    def __init__(self, most: float):
        self.most, self.pairs, self.last, self.fits = most, set(), None, True

    def add(self, words: list[bytes], own: Pairs) -> None:
        if not self.fits or not words:
            return
        self.pairs |= own
        if self.last is not None:
            self.pairs.add((self.last, words[0]))
        self.last = words[-1]
        self.fits = len(self.pairs) <= self.most


class _Words:
    """The pairs of a complete text in order, each with the nearest places of its equals."""

    def __init__(self, text: bytes):
        self.place: dict[bytes, int] = {}
        ids, lines = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, line in enumerate(_lines(text), 1):
            own = [self.place.setdefault(w, len(self.place)) for w in _WORD.findall(line.lower())]
            if own:
                ids.append(np.array(own, np.int64))
                lines.append(np.full(len(own), n))
        words, self.line = np.concatenate(ids), np.concatenate(lines)
        self.pairs = words[:-1] << 32 | words[1:]
        by = np.argsort(self.pairs, kind="stable")
        same = self.pairs[by][1:] == self.pairs[by][:-1]
        self.before, self.after = np.full(len(by), -1), np.full(len(by), len(by))
        self.before[by[1:][same]] = by[:-1][same]
        self.after[by[:-1][same]] = by[1:][same]

    def best(self, template: Pairs, most: float) -> tuple[float, int, int]:
        """(score, first line, lines) of the first of the best windows of at most ``most``
        different pairs."""
        codes = [self.place[a] << 32 | self.place[b] for a, b in template
                 if a in self.place and b in self.place]
        inside = np.isin(self.pairs, codes)
        out = 0.0, 0, 0
        for start in np.flatnonzero(inside).tolist():
            end, size = int(self.after[start]), 2 * int(most) + 2
            while True:
                stop = min(start + size, end)
                new = self.before[start:stop] < start
                different = np.cumsum(new)
                if stop == end or different[-1] > most:
                    break
                size *= 2
            shared = np.cumsum(new & inside[start:stop])
            dice = np.where(different <= most, 2 * shared / (different + len(template)), 0)
            at = int(dice.argmax())
            if dice[at] > out[0]:
                first, last = self.line[start], self.line[start + at + 1]
                out = float(dice[at]), int(first), int(last - first) + 1
        return out


def _lines(text: bytes) -> Iterator[bytes]:
    start = 0
    while (stop := text.find(b"\n", start)) >= 0:
        yield text[start:stop]
        start = stop + 1
    if start < len(text):
        yield text[start:]


def scan(docs: DataFrame, templates: dict[str, str], threshold: float = THRESHOLD,
         id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, dice, first_line, n_lines) of the templates found in whole texts.

    The templates, a list of fixed size, are broadcast; there is no shuffle.
    """
    shared = share(docs.sparkSession, (templates, threshold))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("dice", pa.float64()),
                        ("first_line", pa.int64()), ("n_lines", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker(shared, lambda given: Scanner(*given))
        for batch in row_slices(batches, "text"):
            rows = [
                (doc_id, *found)
                for doc_id, t in zip(batch.column("doc_id").to_pylist(), binaries(batch.column("text")))
                for found in scanner.find(t)
            ]
            if rows:
                yield record_batch(schema, *map(list, zip(*rows)))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(
        run, "doc_id long, license string, dice double, first_line long, n_lines long")
