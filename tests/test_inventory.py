import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialogprep.operators.features import FeatureStore, digest
from dialogprep.plans import fixtures as fx
from dialogprep.sources import images, records
from dialogprep.sources.inventory import Manifest, compared, list_files
from dialogprep.sources.samples import SampleStore


def png(seed, side=3):
    return fx.png_bytes(np.random.default_rng(seed).integers(0, 256, size=(side, side, 3)))


def names(frame):
    return sorted(r.path.split("/tree/")[1] for r in frame.collect())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for i, name in enumerate(["a.png", "b c.png", "d/e.png", "d/f/g [1].png", "d/f/h/i/j.png", "ü/k.png", "l%20.png"]):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(i))
    (root / "empty").mkdir()
    (root / "junk.png").write_bytes(b"none")
    return str(root)


@pytest.mark.parametrize("entries", [1, 3, 10_000])
def test_tasks_list_what_the_file_system_holds(spark, tree, entries):
    found = list_files(spark, tree, entries)
    want = sorted(os.path.relpath(os.path.join(d, f), tree) for d, _, fs in os.walk(tree) for f in fs)
    assert names(found) == want
    for row in found.collect():
        status = os.stat(re.sub("^file:", "", row.path))
        assert row.length == status.st_size and abs(row.modified.timestamp() - status.st_mtime) < 1e-3
    assert found.join(images.list_images(spark, tree), "path").count() == 8


def test_missing_and_empty_folders(spark, tmp_path):
    assert list_files(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "tree").mkdir()
    assert list_files(spark, str(tmp_path / "tree")).count() == 0


def test_refresh_works_on_changed_files_only(spark, tree, tmp_path):
    asked = []

    def work(some):
        asked.extend(some)
        raw = images.read_images(spark, [records.literal_path(n) for n in some])
        return raw.select("path", "height", "readable")

    manifest = Manifest(spark, str(tmp_path / "manifest"), "height int, readable boolean")
    assert manifest.read().count() == 0
    plain = lambda: list_files(spark, tree)
    first = manifest.refresh(plain(), work, names_at_once=2)
    assert {r.change for r in first.collect()} == {"added"} and len(asked) == len(set(asked)) == 8
    facts = {r.path.split("/tree/")[1]: (r.height, r.readable, r.version) for r in manifest.read().collect()}
    assert all(facts[n] == (3, True, 1) for n in facts if n != "junk.png") and facts["junk.png"] == (-1, False, 1)

    asked.clear()
    assert {r.change for r in manifest.refresh(plain(), work).collect()} == {"same"} and not asked

    with open(f"{tree}/a.png", "wb") as file:
        file.write(png(99, side=5))
    with open(f"{tree}/d/new.png", "wb") as file:
        file.write(png(100))
    now = plain().where(~F.col("path").endswith("d/e.png"))
    changes = {r.path.split("/tree/")[1]: r.change for r in manifest.refresh(now, work).collect()}
    assert {k: v for k, v in changes.items() if v != "same"} == {
        "a.png": "changed", "d/new.png": "added", "d/e.png": "removed"}
    assert sorted(n.split("/tree/")[1] for n in asked) == ["a.png", "d/new.png"]
    facts = {r.path.split("/tree/")[1]: (r.height, r.version) for r in manifest.read().collect()}
    assert facts["a.png"] == (5, 3) and facts["d/new.png"] == (3, 3) and facts["junk.png"] == (-1, 1)
    assert "d/e.png" not in facts


def test_broken_refresh_leaves_the_last_version(spark, tree, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "manifest"), "height int")
    listing = list_files(spark, tree).where("path LIKE '%a.png' OR path LIKE '%e.png'")
    height = lambda some: images.read_images(spark, some).select("path", "height")
    manifest.refresh(listing.where("path LIKE '%a.png'"), height)

    def fails(some):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        manifest.refresh(listing, fails)
    assert manifest.version() == 1 and names(manifest.read()) == ["a.png"]
    manifest.refresh(listing, height)
    assert manifest.version() == 2 and names(manifest.read()) == ["a.png", "d/e.png"]


def test_compared_by_size_and_time(spark):
    kind = "path string, length long, modified timestamp"
    at = lambda s: f"2024-01-01 00:00:{s:02}"
    frame = lambda rows: spark.createDataFrame([(p, n, t) for p, n, t in rows], "path string, length long, t string").selectExpr(
        "path", "length", "cast(t as timestamp) AS modified")
    before = frame([("a", 1, at(1)), ("b", 1, at(1)), ("c", 1, at(1)), ("d", 1, at(1))])
    now = frame([("a", 1, at(1)), ("b", 2, at(1)), ("c", 1, at(2)), ("e", 0, at(0))])
    assert {r.path: r.change for r in compared(before, now).collect()} == {
        "a": "same", "b": "changed", "c": "changed", "d": "removed", "e": "added"}
    assert compared(spark.createDataFrame([], kind), spark.createDataFrame([], kind)).count() == 0


def test_features_are_computed_once_for_each_picture(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for i in range(6):
        (root / f"{i}.png").write_bytes(png(i % 3))
    (root / "junk.png").write_bytes(b"none")
    calls = spark.sparkContext.accumulator(0)

    def encode(new):
        @F.udf("array<double>")
        def mean(data):
            calls.add(1)
            return [sum(data) / len(data)]
        return new.select("digest", mean("data").alias("features"))

    def pictures():
        raw = images.read_images(spark, str(root))
        return raw.withColumn("digest", digest(raw))

    store = FeatureStore(spark, str(tmp_path / "store"), "mean-1")
    rows = store.attach(pictures(), encode).collect()
    assert calls.value == 3 and len(rows) == 7
    values = {r.path.rsplit("/", 1)[1]: r.features for r in rows}
    assert values["junk.png"] is None and values["0.png"] == values["3.png"] != values["1.png"]
    (root / "again.png").write_bytes(png(2))
    (root / "new.png").write_bytes(png(9))
    rows = store.attach(pictures(), encode).collect()
    assert calls.value == 4 and len(rows) == 9 and sum(r.features is None for r in rows) == 1
    other = FeatureStore(spark, str(tmp_path / "store"), "mean-2")
    other.attach(pictures(), encode)
    assert calls.value == 8 and store.read().count() == 4


def test_same_picture_added_twice_is_read_once(spark, tmp_path):
    for _ in range(2):
        spark.createDataFrame([("d", [1.0])], "digest string, features array<double>").write.mode("append").parquet(
            str(tmp_path / "store/version=v"))
    assert FeatureStore(spark, str(tmp_path / "store"), "v").read().collect() == [("d", [1.0])]


@pytest.fixture
def store(spark, tmp_path):
    store = SampleStore(spark, str(tmp_path / "samples"))
    samples = spark.range(1_000).select((F.col("id") * 3).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    positions = spark.range(1_000).select((F.col("id") * 3).alias("key"), (999 - F.col("id")).alias("idx"))
    store.write(samples, positions, "key", rows_per_shard=300, row_group_bytes=4_000)
    return store


def read_rows(frame):
    """Rows that the scans of an executed plan gave out."""
    frame.collect()
    scans, total = [frame._jdf.queryExecution().executedPlan()], 0
    while scans:
        node = scans.pop()
        if "FileSourceScanExec" in node.getClass().getName():
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        scans += [children.apply(i) for i in range(children.size())]
    return total


def test_fetch_reads_the_row_groups_of_the_positions(spark, store):
    found = store.fetch([5, 299, 999])
    assert sorted((r.idx, r.key) for r in found.collect()) == [(5, 2982), (299, 2100), (999, 0)]
    assert len({re.search("shard=([0-9]+)", f)[1] for f in found.inputFiles()}) == 2
    assert 0 < read_rows(store.fetch([5])) < 300
    assert store.fetch([]).count() == 0 and store.fetch([7, 7]).count() == 1
    assert store.read().count() == 1_000
    for position in (-1, 1_000):
        with pytest.raises(IndexError):
            store.fetch([position])


def test_fetch_of_a_table_of_positions(spark, store):
    wanted = spark.range(0, 2_000, 7).select(F.col("id").alias("idx"))
    rows = store.fetch_all(wanted.unionByName(wanted)).collect()
    assert sorted(r.idx for r in rows) == list(range(0, 1_000, 7)) and all(r.key == 3 * (999 - r.idx) for r in rows)


def test_last_finished_version_counts(spark, store, tmp_path):
    spark.range(1).write.parquet(f"{store.path}/data/2/shard=0")  # a run that broke off
    assert store.read().count() == 1_000
    keys = spark.range(3).select(F.col("id").alias("key"), F.lit("x").alias("text"))
    assert store.write(keys, keys.select("key", F.col("key").alias("idx")), "key") == 2
    assert sorted(r.key for r in store.read().collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        SampleStore(spark, str(tmp_path / "none")).fetch([0])


def test_few_tasks_look_up_a_list_of_files(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.png").write_bytes(png(i % 3))
    context, key = spark.sparkContext, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    context.setJobGroup("looked-up", "files")
    try:
        found = images.read_images(spark, [str(tmp_path / f"{i}.png") for i in range(40)])
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("looked-up") for s in tracker.getJobInfo(j).stageIds]
    assert stages and sum(tracker.getStageInfo(s).numTasks for s in stages) <= images.LISTING_TASKS
    assert spark.conf.get(key) == before and found.where("readable").count() == 40


def test_pictures_are_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(n):
        calls.add(1)
        return f"digest {n % 3}" if n < 6 else None

    pictures = spark.range(8).select(F.col("id").alias("path"), name("id").alias("digest"))
    store = FeatureStore(spark, str(tmp_path / "store"), "v")
    made = store.attach(pictures, lambda new: new.select("digest", F.array(F.lit(1.0)).alias("features")))
    assert made.where("features IS NOT NULL").count() == 6 and store.read().count() == 3
    assert calls.value == 8
