from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep import schemas
from dialogprep.functions import text as tx

SCHEMA = T.StructType([T.StructField("c", T.ArrayType(schemas.TURN))])


def dialogue(spark, turns, render):
    df = spark.createDataFrame([(turns,)], SCHEMA)
    return df.select(render("c")).first()[0]


def test_grouped_puts_all_human_turns_first(spark):
    turns = [("human", "a"), ("gpt", "b"), ("tool", "x"), ("human", "c"), ("gpt", "d")]
    assert dialogue(spark, turns, tx.grouped_dialogue) == (
        "<|im_start|>user\na<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
        "<|im_start|>assistant\nb<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n"
    )


def test_interleaved_keeps_order(spark):
    turns = [("gpt", "b"), ("system", "x"), ("human", "a")]
    assert dialogue(spark, turns, tx.interleaved_dialogue) == (
        "<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\na<|im_end|>\n"
    )


def test_absent_conversations_render_as_nothing(spark):
    for turns in (None, [], [("system", "x")]):
        assert dialogue(spark, turns, tx.grouped_dialogue) == ""


def test_null_value_is_an_empty_turn(spark):
    assert dialogue(spark, [("human", None)], tx.grouped_dialogue) == (
        "<|im_start|>user\n<|im_end|>\n"
    )


def test_generation_prompt(spark):
    df = spark.createDataFrame([("Why?",), (None,)], "p string")
    got = [r[0] for r in df.select(tx.generation_prompt(F.col("p"))).collect()]
    assert got == [
        "<|im_start|>user\nWhy?<|im_end|>\n<|im_start|>assistant\n",
        "<|im_start|>user\nDescribe this image.<|im_end|>\n<|im_start|>assistant\n",
    ]


def test_image_path(spark):
    df = spark.createDataFrame([("a.jpg",), ("/x/a.jpg",), (None,)], "i string")
    for folder, joined in (("d", "d/a.jpg"), ("d/", "d/a.jpg"), ("", "a.jpg")):
        got = [r[0] for r in df.select(tx.image_path(folder, F.col("i"))).collect()]
        assert got == [joined, "/x/a.jpg", None]


def test_placeholder_is_kept_unless_stripped(spark):
    df = spark.createDataFrame([("<image>\nWhat?",)], "t string")
    assert df.select(tx.strip_image_placeholder(F.col("t"))).first()[0] == "\nWhat?"


def test_tokens_are_lossless(spark):
    text = "<|im_start|>user\nÉté 12, ça-va?\t日本語 😀 é<|im_end|>\n"
    df = spark.createDataFrame([(text,)], "t string")
    parts = df.select(tx.tokens(F.col("t"))).first()[0]
    assert "".join(parts) == text
    assert parts[:3] == ["<|im_start|>", "user", "\n"]
    assert parts[-2:] == ["<|im_end|>", "\n"]
    assert [p for p in parts if p.isdigit()] == ["1", "2"]
