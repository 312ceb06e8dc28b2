import random
import re

import pytest

from dialogprep.llm import licenses
from dialogprep.llm.queries import QUERIES
from tests.conftest import SF


def brute(text, templates, threshold):
    def words(t):
        return [w.lower() for w in re.findall("[A-Za-z0-9]+", t)]

    def pairs(t):
        w = words(t)
        return {(a, b) for a, b in zip(w, w[1:])}

    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    blank = [not line.strip(" \t\r\x0b\x0c") for line in lines]
    regions = [(0, i + 1, 1, line) for i, line in enumerate(lines) if not blank[i]]
    runs, start = [], None
    for i in range(len(lines) + 1):
        if i < len(lines) and not blank[i]:
            start = i if start is None else start
        elif start is not None:
            runs.append((start, i))
            start = None
    regions += [(1, a + 1, b - a, "\n".join(lines[a:b])) for a, b in runs if b - a > 1]
    if len(runs) > 1:
        regions.append((2, 1, len(lines), text))
    out = []
    for name, template in templates.items():
        own, best = pairs(template), None
        for kind, first, n, region in regions:
            other = pairs(region)
            dice = 2 * len(own & other) / (len(own) + len(other))
            if dice >= threshold and (best is None or (-dice, kind, first) < best[:3]):
                best = (-dice, kind, first, n)
        if best:
            out.append((name, -best[0], best[2], best[3]))
    return sorted(out)


def test_query_equals_brute_force(spark, con):
    want = []
    for doc_id, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        want += [(doc_id, *row) for row in brute(text, licenses.TEMPLATES, licenses.THRESHOLD)]
    got = [tuple(r) for r in QUERIES["op3_license_scan"](spark, SF).collect()]
    assert want and sorted(got) == sorted(want)


@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_regions(threshold):
    mit, line = licenses.TEMPLATES["mit"], licenses.TEMPLATES["mit-line"]
    texts = [mit, "\n".join(mit.split(".")), mit.replace(". ", ".\n\n"), f"x\n\n{line}\n{line}\n\ny z",
             mit[:600], "Released under\nthe MIT\nLicense.", "\n\n", " \n" + line.upper(), "word",
             mit + "\n\n" + mit, (mit + "\n") * 3]
    scanner = licenses.Scanner(licenses.TEMPLATES, threshold)
    for text in texts:
        assert scanner.scan(text.encode()) == brute(text, licenses.TEMPLATES, threshold)


def test_edges(spark):
    line = licenses.TEMPLATES["gpl-3.0-line"]
    rows = [(1, None, "a"), (2, "", "a"), (3, line, "a"), (3, line, "a"), (None, line, "b"),
            (4, "ab cd " * 400_000 + "\n" + line + "\n" + "x y " * 400_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licenses.scan(docs, licenses.TEMPLATES).collect()
    assert sorted((r.doc_id or 0, r.license, r.dice, r.first_line) for r in got) == [
        (0, "gpl-3.0-line", 1.0, 1), (3, "gpl-3.0-line", 1.0, 1), (3, "gpl-3.0-line", 1.0, 1),
        (4, "gpl-3.0-line", 1.0, 2)]
    assert licenses.scan(docs.limit(0), licenses.TEMPLATES).count() == 0


# Paragraphs as published, between other text.
BREAKS = {
    "mit": (" The above copyright", " THE SOFTWARE IS"),
    "gpl-3.0-notice": (" This program is distributed", " You should have"),
    "apache-2.0-notice": (" You may obtain", " Unless required"),
}


def every_window(text, template):
    words, lines = [], []
    for n, line in enumerate(text.split("\n"), 1):
        own = re.findall("[a-z0-9]+", line.lower())
        words += own
        lines += [n] * len(own)
    own = re.findall("[a-z0-9]+", template.lower())
    own, found = set(zip(own, own[1:])), []
    all_pairs = list(zip(words, words[1:]))
    for i in range(len(all_pairs)):
        for j in range(i, len(all_pairs)):
            seen = all_pairs[i:j + 1]
            dice = 2 * len(set(seen) & own) / (len(set(seen)) + len(own))
            tight = all(x in own and seen.count(x) == 1 for x in (seen[0], seen[-1]))
            found.append((-dice, not tight, i, j))
    dice, loose, i, j = min(found)
    assert not loose or not dice
    return -dice, lines[i], lines[j + 1] - lines[i] + 1


@pytest.mark.parametrize("name", BREAKS)
def test_headers_in_larger_documents(name):
    notice = " ".join(licenses.TEMPLATES[name].split())
    for at in BREAKS[name]:
        assert at in notice
        notice = notice.replace(at, "\n\n" + at[1:])
    other = "\n".join(f"line{i} of program{i} and text{i}\n" for i in range(300))
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    for text in (f"{notice}\n\n{other}", f"{other}\n{notice}\n\n{other}", f"/* Copyright A {notice} import b\n{other}"):
        found = {row[0]: row[1:] for row in scanner.find(text.encode())}
        assert found[name] == (1.0, text[:text.index(notice)].count("\n") + 1, 5)


def test_sentence_within_a_longer_line():
    text = "one\nSee below. " + licenses.TEMPLATES["mit-line"] + " All other rights are kept by their owners.\ntwo"
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    assert scanner.find(text.encode()) == [("mit-line", 1.0, 2, 1)]


def test_windows_equal_every_window():
    rng = random.Random(5)
    template = "a b c d e a c b f g"
    scanner = licenses.Scanner({"x": template}, 0.5)
    found = 0
    for _ in range(300):
        text = "".join(rng.choice("abcdefgh") + rng.choice([" ", " ", "\n", "\n\n"]) for _ in range(60))
        if brute(text, {"x": template}, 0.5):
            continue
        want = every_window(text, template)
        got = scanner.find(text.encode())
        assert got == ([("x", *want)] if want[0] >= 0.5 else [])
        found += bool(got)
    assert found > 20
