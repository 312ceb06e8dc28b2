import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep.functions import pixels as px
from dialogprep.operators import validate
from dialogprep.plans import fixtures as fx
from dialogprep.sources import images, records

RECORDS = [
    {"image": "a.png", "conversations": [{"from": "human", "value": "Which colour is the door?"},
                                         {"from": "gpt", "value": "It looks green."}]},
    {"conversations": [{"from": "human", "value": "[no] {image}"}]},
    {"image": "c.png"},
]


def described(df):
    return sorted(
        (r.image or "", len(r.conversations or []), (r.conversations or [{"value": ""}])[0]["value"])
        for r in df.collect()
    )


WANT = [("", 1, "[no] {image}"), ("a.png", 2, "Which colour is the door?"), ("c.png", 0, "")]


LAYOUTS = [
    json.dumps(RECORDS),
    json.dumps(RECORDS, indent=2),
    "\n  \n" + json.dumps(RECORDS, indent=1),
    "\n".join(map(json.dumps, RECORDS)) + "\n",
    json.dumps(RECORDS[0]) + "\n" + json.dumps(RECORDS[1:]),
    "[" + ",\n".join(map(json.dumps, RECORDS)) + "]",
]


@pytest.mark.parametrize("body", LAYOUTS)
def test_layouts_give_the_same_records(spark, tmp_path, body):
    path = str(tmp_path / "data.json")
    open(path, "w").write(body)
    assert described(records.read_records(spark, path)) == WANT


def test_layouts_mix_in_a_folder(spark, tmp_path):
    for i, body in enumerate(LAYOUTS):
        (tmp_path / f"{i}.json").write_text(body)
    parsed = records.read_parsed(spark, str(tmp_path))
    assert described(records.read_records(spark, str(tmp_path))) == sorted(WANT * len(LAYOUTS))
    rows = records.positioned(parsed).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(3 * len(LAYOUTS)))
    assert [r.image for r in rows] == ["a.png", None, "c.png"] * len(LAYOUTS)
    assert [r.sample_id for r in records.identified(parsed).orderBy("sample_id").collect()] == [
        r.position for r in rows]


@pytest.mark.parametrize("body, n_records, held", [
    ('[{"image": "a.png"},\n{"image": "b.png"} ]', 2, []),
    ('[{"image": "a.png", "conversations": []\n}, {"image": "b.png"}]', 2, []),
    ('[[1]\n]', 0, ["[[1]", "]"]),
    ('{"image": "a.png",\n"conversations": null}', 1, []),
    ('{"image": "a.png"}\n{"image": "b.p', 1, ['{"image": "b.p']),
    ('{"image": "a.png"} {"image": "b.png"}', 0, ['{"image": "a.png"} {"image": "b.png"}']),
    ('{"image": 5}\n{"conversations": [1]}\n"text"', 0, ['"text"', '{"conversations": [1]}', '{"image": 5}']),
])
def test_every_text_is_a_record_or_held(spark, tmp_path, body, n_records, held):
    path = str(tmp_path / "data.json")
    open(path, "w").write(body)
    good, bad = records.read_with_quarantine(spark, path)
    assert good.count() == n_records and sorted(r[0] for r in bad.collect()) == held
    if held:
        with pytest.raises(ValueError):
            records.read_records(spark, path)


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(json.dumps({"image": f"{i}"}) + "\n" for i in range(500)))
    (tmp_path / "b.json").write_text(json.dumps([{"image": f"{i}"} for i in range(500, 520)], indent=1))
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = records.identified(records.read_parsed(spark, str(tmp_path))).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r.sample_id, r.image) for r in rows) == [(i, f"{i}") for i in range(520)]


def test_single_pretty_object(spark, tmp_path):
    path = str(tmp_path / "one.json")
    open(path, "w").write(json.dumps(RECORDS[0], indent=2))
    assert described(records.read_records(spark, path)) == WANT[1:2]


def test_quarantine_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "lines.json")
    bad = ['{"image": "x.png", "conversations": [', "not json"]
    open(path, "w").write("\n".join([json.dumps(RECORDS[0]), bad[0], "", bad[1], json.dumps(RECORDS[1:])]))
    good, held = records.read_with_quarantine(spark, path)
    assert described(good) == WANT
    assert sorted(r[0] for r in held.collect()) == sorted(bad)


def test_failing_source_is_reported(spark, tmp_path):
    path = str(tmp_path / "ok.json")
    open(path, "w").write(json.dumps(RECORDS[0]))
    bad = str(tmp_path / "bad.json.gz")
    open(bad, "wb").write(b"\x1f\x8b not compressed")
    df, problems = records.read_sources(spark, [str(tmp_path / "missing.json"), bad, path])
    assert df.count() == 1
    assert [os.path.basename(p) for p, _ in problems] == ["missing.json", "bad.json.gz"]
    with pytest.raises(ValueError):
        records.read_sources(spark, [str(tmp_path / "missing.json")])


@pytest.fixture
def folder(tmp_path):
    """An RGB, a grey and a translucent picture, junk, and one in a subfolder."""
    rng = np.random.default_rng(1)
    shapes = {"rgb": (3, 5, 3), "grey": (4, 2, 1), "alpha": (2, 2, 4), "sub/deep": (1, 1, 3)}
    pictures = {n: rng.integers(0, 256, size=s) for n, s in shapes.items()}
    pictures["alpha"][:, :, 3] = 255
    (tmp_path / "sub").mkdir()
    for name, values in pictures.items():
        (tmp_path / f"{name}.png").write_bytes(fx.png_bytes(values))
    (tmp_path / "junk.png").write_bytes(b"not a picture")
    return str(tmp_path), pictures


def test_decode_to_rgb(spark, folder):
    path, pictures = folder
    rows = {r.path.split(f"{path}/")[1][:-4]: r for r in images.rgb(images.read_images(spark, path)).collect()}
    assert not rows["junk"].readable and rows["junk"].rgb is None
    for name, values in pictures.items():
        want = np.repeat(values, 3, axis=2) if values.shape[2] == 1 else values[:, :, :3]
        r = rows[name]
        assert (r.height, r.width) == values.shape[:2]
        assert np.array_equal(np.frombuffer(r.rgb, np.uint8).reshape(want.shape), want)


def test_inventory_matches_decoded_paths_and_reads_no_content(spark, folder):
    listed = images.list_images(spark, folder[0])
    decoded = images.read_images(spark, folder[0])
    assert listed.count() == 5 and listed.join(decoded, "path").count() == 5
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_tensor_shape_and_values(spark, folder):
    path, pictures = folder
    made = images.pixel_values(images.read_images(spark, path)).filter("readable").collect()
    assert len(made) == 4 and all(r["shape"] == [3, 224, 224] for r in made)
    assert all(len(r.pixel_values) == 3 * 224 * 224 for r in made)
    grey = pictures["sub/deep"][0, 0] / 255.0
    deep = next(r for r in made if "deep" in r.path)
    planes = np.array(deep.pixel_values).reshape(3, -1)
    mean, std = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
    for c in range(3):
        assert np.allclose(planes[c], (grey[c] - mean[c]) / std[c], atol=1e-6)


def dense(source, target, method):
    places, weights = px.resize_taps(source, target, method)
    out = np.zeros((target, source))
    np.add.at(out, (np.broadcast_to(np.arange(target), places.shape), places), weights)
    return out


def test_resize_taps():
    for method in ("nearest", "bilinear", "bicubic"):
        for source, target in ((8, 8), (8, 16), (100, 7), (1, 5), (4000, 224)):
            w = dense(source, target, method)
            assert np.allclose(w.sum(axis=1), 1)
        assert np.allclose(dense(6, 6, method), np.eye(6))
    assert np.allclose(dense(2, 4, "bilinear") @ [0, 1], [0, 0.25, 0.75, 1])
    # hand values of the cubic kernel at 0.25, 0.75, 1.25 and 1.75, halfway up a ramp
    near = np.array([0.8671875, 0.2265625, -0.0703125, -0.0234375])
    assert np.allclose(dense(8, 16, "bicubic")[7, 2:6], near[[2, 0, 1, 3]])
    with pytest.raises(ValueError):
        px.resize_taps(2, 2, "other")


@pytest.mark.parametrize("method", ["bilinear", "bicubic"])
def test_default_tensor_equals_weights_by_definition(spark, folder, method):
    path, pictures = folder
    made = {r.path.split(f"{path}/")[1][:-4]: r for r in
            images.pixel_values(images.read_images(spark, path), method=method).collect()}
    assert made.pop("junk").pixel_values is None and len(made) == 4
    mean, std = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
    for name, values in pictures.items():
        want = np.repeat(values, 3, axis=2) if values.shape[2] == 1 else values[:, :, :3]
        got = np.array(made[name].pixel_values).reshape(3, 224, 224)
        for c in range(3):
            plane = dense(want.shape[0], 224, method) @ (want[:, :, c] / 255.0)
            plane = plane @ dense(want.shape[1], 224, method).T
            assert np.allclose(got[c], (plane - mean[c]) / std[c], atol=1e-5)


def test_salt_must_differ_from_the_key(spark):
    df = spark.createDataFrame([(1, "a")], "i int, image string")
    with pytest.raises(ValueError):
        validate.require_image(df, df.select("image"), "image", ["image"])


def test_records_are_accepted_or_rejected_with_a_reason(spark, folder):
    path, _ = folder
    asked = [(1, "rgb.png"), (2, None), (3, ""), (4, "none.png"), (5, "junk.png"), (6, "rgb.png")]
    df = spark.createDataFrame(asked, "sample_id int, image string")
    stored = images.read_images(spark, path).select(
        F.element_at(F.split("path", "/"), -1).alias("image"), "readable")
    checked = validate.require_image(df, stored, "image", "sample_id", "readable")
    reasons = {r.sample_id: r.reason for r in checked.collect()}
    assert reasons == {1: None, 6: None, 2: "no_image", 3: "no_image", 4: "not_found", 5: "unreadable"}
    assert validate.accepted(checked).count() + validate.rejected(checked).count() == len(asked)
    with pytest.raises(Exception, match="record rejected"):
        validate.strict(checked).collect()
    assert validate.strict(checked.filter("reason is null")).count() == 2


def test_partitioned_samples_prune(spark, tmp_path):
    out = str(tmp_path / "samples")
    records.write_samples(spark.range(10).withColumn("cut", F.col("id") % 2), out, ["cut"])
    kept = spark.read.parquet(out).filter("cut = 1")
    assert kept.count() == 5 and os.path.isdir(f"{out}/cut=1")
    assert "PartitionFilters: [isnotnull(cut" in kept._jdf.queryExecution().executedPlan().toString()
