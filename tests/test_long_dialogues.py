"""One dialogue of more than ten thousand turns beside small ones, through queries and SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from dialogprep.operators import tokens
from dialogprep.plans import fixtures as fx
from dialogprep.plans import jobs
from tests.compare import compare

LONG = 10_050


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    turns = spark.range(LONG + 30).select(
        F.when(F.col("id") < LONG, 3).otherwise(10 + (F.col("id") - LONG) % 7).cast("long").alias("conv_id"),
        F.when(F.col("id") < LONG, F.col("id")).otherwise(((F.col("id") - LONG) / 7).cast("long")).alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").when(F.col("id") % 3 == 1, "assistant")
        .otherwise(F.when(F.col("id") % 2 == 0, "system").otherwise("user")).alias("role"),
        F.concat(F.lit("Word "), F.col("id").cast("string")).alias("text"))
    turns.repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.mark.parametrize("name", [
    "dialogue_grouped", "dialogue_interleaved", "dialogue_parts", "optional_defaults",
    "nested_records", "pad_fixed", "json_roundtrip", "stream_dialogues",
])
def test_matches_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    assert compare(spark, con, name, queries()[name], oracle_sql()[name], folder) >= 8


def test_records_and_turns_give_the_same_samples(spark, folder):
    turns = fx.table(spark, folder, "conversations")
    book = tokens.load_codebook(jobs.corpus_vocabulary(turns, 500))
    for order in ("grouped", "interleaved"):
        a = jobs.prepare_records(fx.records(spark, folder), book, order=order).drop("image")
        b = jobs.prepare_samples(turns, book, order=order)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
