import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dialogprep import schemas
from dialogprep.sources import json_array, records

NASTY = ["", "}", "{", "[]", "\"", "\\", "\\\"}", "},{", "é{\U0001F600}", "\n", "]\n[", "a" * 70, "\\u007d", "{\"a\": [1, {}]}"]


def made(rng, n):
    turn = lambda: {"from": rng.choice(["human", "gpt", None]), "value": "".join(rng.choices(NASTY, k=rng.randint(0, 4)))}
    rows = []
    for i in range(n):
        row = {"sample_id": i, "image": rng.choice([None, *NASTY]),
               "conversations": rng.choice([None, [turn() for _ in range(rng.randint(0, 4))]])}
        row["extra"] = rng.choice([1, {}, [{}], {"x": [[], {"y": "}"}]}])
        rows.append({k: v for k, v in row.items() if v is not None or rng.random() < 0.5})
    return rows


def cut(body, splits):
    """What the tasks of ``splits`` (places) do, in one process: (records, is no array)."""
    parts = body.split(b"}")
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part) + 1
    if not parts[-1]:
        parts, starts = parts[:-1], starts[:-1]
    own = [max([s for s in splits if s <= at], default=0) for at in starts]
    blocks = sorted(set(own))
    states, scan = {}, json_array.Scan()
    for block in blocks:
        states[block] = (scan.in_string, scan.depth, block == blocks[0], block == blocks[-1])
        mine = b"".join(p + b"}" for p, b in zip(parts, own) if b == block)
        scan.depths(json_array.np.frombuffer(mine, json_array.np.uint8))
    rows = []
    for block in blocks:
        split, mine = json_array._Split("f", block, states[block]), [p for p, b in zip(parts, own) if b == block]
        step = 1 + block % 3
        for i in range(0, len(mine), step):
            rows += split.add(mine[i:i + step])
        rows += split.end()
    out, spanning = [], []
    for _, block, at, kind, text in sorted(rows, key=lambda r: (r[1], r[3] == json_array.TAIL, r[2] or 0)):
        if kind == json_array.NO_ARRAY:
            return None
        if kind == json_array.RECORD:
            out.append(text)
        elif kind == json_array.TAIL:
            spanning.append(text)
            out.append(None)
        else:
            spanning[-1] += text
    spanning = iter(spanning)
    return [t if t is not None else next(spanning) for t in out]


@pytest.mark.parametrize("seed", range(12))
def test_any_splits_give_the_same_records(seed):
    rng = random.Random(seed)
    rows = made(rng, rng.randint(0, 30))
    dump = lambda some: json.dumps(some, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))
    bodies = [dump(rows), " \n" + dump(rows) + " \n\n", "\n".join([dump(rows[:3]), "[]", dump(rows[3:])])]
    for body in bodies:
        data = body.encode()
        for _ in range(20):
            splits = [0, *sorted(rng.sample(range(1, len(data) + 1), min(len(data), rng.randint(0, 9))))]
            found = cut(data, splits)
            assert found is not None and [json.loads(t) for t in found] == rows


@pytest.mark.parametrize("body", [
    '[{"a": 1}', '[{"a": 1},]', '[{"a": 1} {"a": 2}]', '[{"a": 1}]]', '[{"a": 1}] [{"a": 2}]', '[1, {"a": 1}]',
    '[{"a": 1}, 2]', '[{"a": "}', '[[{"a": 1}]]', '[{"a": 1}]\n{"a": 2}', '["}"]', "[", "[[1]\n]", '[{"a": [}]', '[{}, "x}"]',
    '[{"a": 1}]\n[', '[,{"a": 1}]'])
def test_other_texts_are_refused(body):
    for step in (1, 2, 5, 100):
        assert cut(body.encode(), range(0, len(body), step)) is None


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_one_line_array_in_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(5)
    rows = made(rng, 300)
    rows[40]["extra"] = "long {" * 1_000  # a record over several splits
    path = str(tmp_path / "one.json")
    open(path, "w").write(json.dumps(rows, ensure_ascii=False))
    assert json_array.fragments(spark, path).rdd.getNumPartitions() > 20
    parsed = records.read_parsed(spark, path)
    got = records.positioned(parsed).orderBy("position").collect()
    assert [r.position for r in got] == list(range(300))
    for row, want in zip(got, rows):
        assert (row.sample_id, row.image) == (want["sample_id"], want.get("image"))
        turns = None if row.conversations is None else [(t["from"], t["value"]) for t in row.conversations]
        wanted = want.get("conversations")
        assert turns == (None if wanted is None else [(t["from"], t["value"]) for t in wanted])


def test_rows_stay_short(spark, tmp_path):
    path = str(tmp_path / "one.json")
    rows = [{"sample_id": i, "image": "a" * 50} for i in range(3_000)]
    open(path, "w").write(json.dumps(rows))
    longest = json_array.fragments(spark, path).select(F.max(F.length("value"))).first()[0]
    assert longest < 120
    assert records.read_records(spark, path).count() == 3_000


def test_records_of_an_array_are_held_alone(spark, tmp_path, small_splits):
    path = str(tmp_path / "one.json")
    bad = ['{"image": 5}', '{"image": tru}', r'{"image": "\ud800"}', '{"sample_id": 1.5}']
    good = [json.dumps({"image": f"{i}.png"}) for i in range(100)]
    open(path, "w").write("[" + ", ".join(good[:50] + bad + good[50:]) + "]")
    kept, held = records.read_with_quarantine(spark, path)
    assert sorted(r.image for r in kept.collect()) == sorted(f"{i}.png" for i in range(100))
    assert sorted(r[0] for r in held.collect()) == sorted(bad)


def test_broken_array_falls_back_to_lines(spark, tmp_path):
    path = str(tmp_path / "lines.json")
    lines = ['[{"image": "a"}]', '[{"image": "b"}, {"image": "c"}]', '{"image": "d"}', '[{"image": "e"', '[{"image": "f"}']
    open(path, "w").write("\n".join(lines))
    kept, held = records.read_with_quarantine(spark, path)
    assert sorted(r.image for r in kept.collect()) == ["a", "b", "c", "d"]
    assert sorted(r[0] for r in held.collect()) == sorted(lines[3:])


def test_half_surrogates_and_wrong_bytes_are_held(spark, tmp_path):
    path = str(tmp_path / "lines.json")
    lines = [b'{"image": "ok"}', rb'{"image": "\ud83d"}', rb'{"conversations": [{"from": "\udc00"}]}',
             '{"image": "\U0001F600"}'.encode(), b'{"image": "\xff"}']
    open(path, "wb").write(b"\n".join(lines))
    kept, held = records.read_with_quarantine(spark, path)
    assert sorted(r.image for r in kept.collect()) == ["ok", "\U0001F600"]
    assert sorted(r[0] for r in held.collect()) == sorted(
        [lines[1].decode(), lines[2].decode(), '{"image": "\\xff"}'])


def test_empty_inputs(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text("[]")
    (tmp_path / "c.json").write_text(" \n")
    kept, held = records.read_with_quarantine(spark, str(tmp_path))
    assert kept.count() == 0 and held.count() == 0
    assert kept.columns == schemas.RECORD.names


def test_positions_of_very_many_files(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i:03}.json").write_text(f'[{{"sample_id": {2 * i}}}, {{"sample_id": {2 * i + 1}}}]')
    rows = records.positioned(records.read_parsed(spark, str(tmp_path))).collect()
    assert all(r.position == r.sample_id for r in rows) and len(rows) == 120


def test_escapes_over_parts():
    scan = json_array.Scan()
    text = rb'{"a\\": "b\"} \\\" {", "c": "\\\\"} ['
    whole, depths = json_array.Scan().depths(json_array.np.frombuffer(text, "u1"))
    for step in (1, 2, 3):
        scan, found = json_array.Scan(), []
        for i in range(0, len(text), step):
            found += scan.depths(json_array.np.frombuffer(text[i:i + step], "u1"))[1].tolist()
        assert found == depths.tolist() and depths[-1] == 1
