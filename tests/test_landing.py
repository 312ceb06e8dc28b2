import json

import pytest
from pyspark.errors import StreamingQueryException

from dialogprep.sources import records
from dialogprep.streaming import landing


def fill(folder):
    row = lambda i: {"sample_id": i, "image": f"{i}.png"}
    (folder / "lines.json").write_text("\n".join([json.dumps(row(1)), '{"sample_id": 2, "ima', json.dumps(row(3))]))
    (folder / "array [é] {x}.json").write_text(json.dumps([row(4), {"image": 5}, row(6)]))
    (folder / "pretty.json").write_text(json.dumps([row(7), row(8)], indent=2))
    (folder / "one.json").write_text(json.dumps(row(9), indent=2))
    (folder / "empty.json").write_text("")


def seen(frame, column):
    return sorted(str(r[column]) for r in frame.collect())


def as_batch_reader(spark, folder, out):
    wanted = records.read_with_quarantine(spark, str(folder))
    got = landing.landed(spark, out)
    return [seen(f, c) for f, c in zip(wanted, ("sample_id", "_corrupt_record"))] == [
        seen(f, c) for f, c in zip(got, ("sample_id", "_corrupt_record"))]


@pytest.mark.parametrize("files_at_once", [3, 100])
def test_stream_lands_what_the_batch_reader_reads(spark, tmp_path, files_at_once):
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()
    fill(folder)
    for _ in range(2):  # nothing new, nothing twice
        landing.land(spark, str(folder), out, progress, files_at_once).awaitTermination()
        assert as_batch_reader(spark, folder, out)
    (folder / "later.json").write_text('[{"sample_id": 100}, {"sample_id": "x"}]')
    landing.land(spark, str(folder), out, progress, files_at_once).awaitTermination()
    good, held = landing.landed(spark, out)
    assert seen(good, "sample_id") == sorted(["1", "3", "4", "6", "7", "8", "9", "100"])
    assert seen(held, "_corrupt_record") == sorted(['{"sample_id": 2, "ima', '{"image": 5}', '{"sample_id": "x"}'])
    assert as_batch_reader(spark, folder, out)


@pytest.mark.parametrize("fails_after_data", [False, True])
def test_restart_in_the_middle_of_a_batch(spark, tmp_path, monkeypatch, fails_after_data):
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    folder.mkdir()
    fill(folder)
    landing.land(spark, str(folder), out, progress).awaitTermination()
    (folder / "new.json").write_text('{"sample_id": 50}\n{"sample_id": 51}\nnone')
    real = landing._write_batch

    def broken(names, batch, path):
        if fails_after_data:
            parsed = records.read_parsed(names.sparkSession, [records.literal_path(r["path"]) for r in names.collect()])
            parsed.selectExpr("*", "'good' AS status").write.mode("overwrite").partitionBy("status").parquet(
                f"{path}/data/batch={batch}")
        raise RuntimeError("lost in the middle")

    monkeypatch.setattr(landing, "_write_batch", broken)
    with pytest.raises(StreamingQueryException):
        landing.land(spark, str(folder), out, progress).awaitTermination()
    # What the broken batch has written does not count.
    assert "50" not in seen(landing.landed(spark, out)[0], "sample_id")
    monkeypatch.setattr(landing, "_write_batch", real)
    landing.land(spark, str(folder), out, progress).awaitTermination()
    assert as_batch_reader(spark, folder, out)


def test_file_names_are_taken_literally(spark, tmp_path):
    names = ["a b.json", "c*.json", "d[1].json", "e{x,y}.json", "f%20.json", "g?.json", "ü.json", "h^.json"]
    for i, name in enumerate(names):
        (tmp_path / name).write_text(f'[{{"sample_id": {i}}}]' if i % 2 else f'{{"sample_id":\n{i}}}')
    got = records.read_records(spark, str(tmp_path))
    assert seen(got, "sample_id") == [str(i) for i in range(len(names))]
