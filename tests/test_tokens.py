import collections
import re

import pytest
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.functions import arrays as ar
from dialogprep.functions import text as tx
from dialogprep.operators import tokens
from dialogprep.plans import jobs
from tests.conftest import SF

RESERVED = list(fixed.RESERVED_TOKENS)


@pytest.fixture(scope="module")
def turns(spark):
    return spark.read.parquet(f"{SF}/conversations.parquet")


def codebook_of(spark, words):
    rows = [{"id": i, "tok": t, "special": i < 4} for i, t in enumerate(RESERVED + words)]
    return tokens.Codebook(spark, rows)


def test_vocabulary_ranks_by_count_then_token(spark):
    df = spark.createDataFrame([("b a a c b <|im_end|>",)], "t string")
    got = [(r.id, r.tok, r.n, r.special) for r in tokens.build_vocabulary(df, "t", 3).orderBy("id").collect()]
    assert got[:4] == [(i, t, 0, True) for i, t in enumerate(RESERVED)]
    assert got[4:] == [(4, " ", 5, False), (5, "a", 2, False), (6, "b", 2, False)]


def test_encode_decode(spark):
    book = codebook_of(spark, ["a", " ", "b"])
    df = spark.createDataFrame([(1, "a b<|im_end|>q"), (2, ""), (3, None)], "i int, t string")
    coded = df.withColumn("ids", book.encode(tx.tokens(F.col("t"))))
    rows = {r.i: r for r in coded.withColumn("back", book.decode(F.col("ids"))).withColumn(
        "all", book.decode(F.col("ids"), skip_special=False)).collect()}
    assert rows[1].ids == [4, 5, 6, 2, 3] and rows[1].back == "a b"
    assert rows[1]["all"] == "a b<|im_end|><|unk|>"
    assert rows[2].ids == [] and rows[3].ids == [] and rows[3].back == ""


def test_decode_inverts_encode_within_the_vocabulary(spark, turns):
    book = tokens.load_codebook(jobs.corpus_vocabulary(turns, 1 << 17))
    spoken = turns.filter("role <> 'system'")
    coded = spoken.select("text", book.encode(tx.tokens(F.col("text"))).alias("ids"))
    assert coded.filter(book.decode(F.col("ids")) != F.col("text")).count() == 0


def test_too_large_a_vocabulary_is_joined(spark, turns):
    vocabulary = jobs.corpus_vocabulary(turns, 50)
    assert tokens.load_codebook(vocabulary, limit=20) is None
    words = turns.withColumn("w", tx.tokens(F.col("text")))
    key = ["conv_id", "turn"]
    shared = tokens.Vocabulary(vocabulary).encode(words, key, F.col("w")).select(*key, "ids")
    joined = tokens.Vocabulary(vocabulary, 20).encode(words, key, F.col("w")).select(*key, "ids")
    assert sorted(map(str, shared.collect())) == sorted(map(str, joined.collect()))
    direct = tokens.sample_ids(turns, tokens.load_codebook(vocabulary), 32)
    through = tokens.sample_ids(turns, vocabulary, 32)
    assert sorted(map(str, direct.collect())) == sorted(map(str, through.collect()))


def test_ids_must_be_dense(spark):
    with pytest.raises(ValueError):
        tokens.Codebook(spark, [{"id": 1, "tok": "a", "special": False}])


def brute_sample(rows, ids, length):
    """(ids, supervised) of one dialogue, by plain Python."""
    pattern = re.compile(r"<\|im_start\|>|<\|im_end\|>|[^\W\d_]+|\d|\s|.", re.S)
    out, flags = [], []
    for r in sorted(rows, key=lambda r: (r.role == "assistant", r.turn)):
        if r.role == "system":
            continue
        for at, tok in enumerate(pattern.findall(f"<|im_start|>{r.role}\n{r.text}<|im_end|>\n")):
            out.append(ids.get(tok, 3))
            flags.append(int(r.role == "assistant" and at >= 3))
    return out[:length], flags[:length]


@pytest.mark.parametrize("length", [1, 17, 200])
def test_samples_against_plain_python(spark, turns, length):
    vocabulary = jobs.corpus_vocabulary(turns, 300)
    ids = {r.tok: r.id for r in vocabulary.collect()}
    by_dialogue = collections.defaultdict(list)
    for r in turns.collect():
        by_dialogue[r.conv_id].append(r)
    got = tokens.sample_ids(turns, tokens.load_codebook(vocabulary), length).collect()
    assert len(got) == len(by_dialogue)
    for r in got:
        assert (r.ids, r.supervised) == brute_sample(by_dialogue[r.conv_id], ids, length)


def test_fixed_length_arrays(spark, turns):
    book = tokens.load_codebook(jobs.corpus_vocabulary(turns, 300))
    made = {p: jobs.prepare_samples(turns, book, 300, labels=p) for p in jobs.LABELS}
    clone = {r.conv_id: r for r in made["clone"].collect()}
    masked = {r.conv_id: r.labels for r in made["mask_pad"].collect()}
    own = {r.conv_id: r.labels for r in made["assistant_only"].collect()}
    ragged = {r.conv_id: r for r in jobs.prepare_samples(turns, book, 300, pad=False).collect()}
    for key, r in clone.items():
        n = len(ragged[key].input_ids)
        assert len(r.input_ids) == len(r.attention_mask) == len(r.labels) == 300
        assert sum(r.attention_mask) == n and r.attention_mask == [1] * n + [0] * (300 - n)
        assert r.input_ids == ragged[key].input_ids + [0] * (300 - n) and r.labels == r.input_ids
        assert masked[key] == r.input_ids[:n] + [-100] * (300 - n)
        assert all(a in (b, -100) for a, b in zip(own[key], r.input_ids))
        assert ragged[key].attention_mask == [1] * n


def test_pad_right_leaves_longer_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert df.select(ar.pad_right(F.col("a"), 2, 9)).first()[0] == [1, 2, 3]
    assert df.select(ar.pad_right(F.col("a"), 5, 9)).first()[0] == [1, 2, 3, 9, 9]
    assert df.select(ar.truncate(F.col("a"), 2)).first()[0] == [1, 2]


def test_pad_id_reaches_ids_and_cloned_labels(spark, turns):
    book = tokens.load_codebook(jobs.corpus_vocabulary(turns, 50))
    row = jobs.prepare_samples(turns, book, 4000, pad_id=7).first()
    n = sum(row.attention_mask)
    assert row.input_ids[n:] == row.labels[n:] == [7] * (4000 - n)


def test_nested_and_long_forms_agree(spark, turns):
    from dialogprep.operators import render

    book = tokens.load_codebook(jobs.corpus_vocabulary(turns, 200))
    for order in ("grouped", "interleaved"):
        for policy in jobs.LABELS:
            nested = render.nest_turns(turns).select(
                F.col("conv_id").alias("sample_id"), F.lit(None).cast("string").alias("image"),
                "conversations")
            a = jobs.prepare_records(nested, book, 90, order, policy, pad=False).drop("image")
            b = jobs.prepare_samples(turns, book, 90, order, policy, pad=False)
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_all_jobs_take_a_vocabulary_of_any_size(spark, turns):
    from dialogprep.operators import inference, render

    table = jobs.corpus_vocabulary(turns, 60)
    shared, joined = tokens.Vocabulary(table), tokens.Vocabulary(table, limit=10)
    assert shared.shared is not None and joined.shared is None
    nested = render.nest_turns(turns).select(
        F.col("conv_id").alias("sample_id"), F.lit("a.png").alias("image"), "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    rows = asked.withColumn("f", F.array(F.lit(1.0)))

    makes = [
        lambda v: jobs.prepare_samples(turns, v, 80),
        lambda v: jobs.prepare_records(nested, v, 80),
        lambda v: v.decode(tokens.encode_turns(turns, v), ["conv_id", "turn"], "ids").drop("ids"),
        lambda v: v.decode(tokens.encode_turns(turns, v), ["conv_id", "turn"], "ids", skip_special=False),
        lambda v: inference.evaluate(rows, v, lambda f, i, c: i, "f", length=40)
        .select("conv_id", "turn", "response"),
    ]
    for make in makes:
        a, b = make(shared), make(joined)
        assert sorted(a.columns) == sorted(b.columns)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
