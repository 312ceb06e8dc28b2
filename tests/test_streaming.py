import json

from dialogprep import fixed
from dialogprep.operators.tokens import Codebook
from dialogprep.streaming import records


def test_new_files_are_processed_once(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    turn = lambda who, text: {"from": who, "value": text}

    def land(n):
        body = {"sample_id": n, "conversations": [turn("gpt", "b"), turn("human", f"a{n}")]}
        (landing / f"{n}.json").write_text(json.dumps(body) + "\n")
        records.drain(records.stream_dialogues(spark, str(landing)), out, progress)

    land(1)
    land(2)
    rows = spark.read.parquet(out).orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == [1, 2]
    assert rows[1].text == (
        "<|im_start|>user\na2<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    )


def test_samples_of_arriving_records(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    body = {"sample_id": 5, "image": "a.png", "conversations": [{"from": "human", "value": "Hi"}]}
    (landing / "1.json").write_text(json.dumps(body))
    words = list(fixed.RESERVED_TOKENS) + ["user", "\n", "Hi"]
    book = Codebook(spark, [{"id": i, "tok": t, "special": i < 4} for i, t in enumerate(words)])
    stream = records.stream_samples(spark, str(landing), book, 8)
    records.drain(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.input_ids == row.labels == [1, 4, 5, 6, 2, 5, 0, 0]
    assert row.attention_mask == [1] * 6 + [0] * 2
