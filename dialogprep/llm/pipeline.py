"""Stages of the corpus pipeline; all but the last return the columns of documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.llm import byte_bpe, decontaminate, jaccard, languages, suffix_dedup
from dialogprep.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
# A document stays if one language makes up this share of it.
LEAST_SHARE = 0.4


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: drops documents without letters and those without a main language."""
    return languages.accept(docs, languages.learn(docs), LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each component of similar ones, on five-word shingles."""
    return jaccard.one_of_each(docs, words=5, share_=(80, 100))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: cuts strings of 100 bytes that stood earlier, whole characters only.

    Drops documents of which nothing is left, and counts characters anew.
    """
    others = tuple(c for c in docs.columns if c != "text")
    cut = suffix_dedup.dedup(docs, keep=others, characters=True)
    columns = {c: F.col("rest").getField(c) for c in others}
    columns["text"] = F.col("kept").cast("string")
    if "n_chars" in columns:
        counted = F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, counted).otherwise(columns["n_chars"])
    left = cut.where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    return left.select(*(columns[c].alias(c) for c in docs.columns))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: drops documents that hold a passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: (doc_id, n_tokens, ids) of every remaining text."""
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path(RANKS))
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, packed=False)
