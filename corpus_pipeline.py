"""A corpus pipeline made of the training-data operators."""

from pyspark.sql import DataFrame, SparkSession

from dialogprep.llm import pipeline
from dialogprep.llm.common import stored, table

# (name, function of (spark, docs, sf_dir)); each stage reads what the one before it wrote.
STAGES = [
    ("language_id", pipeline.identify_languages),
    ("jaccard_join", pipeline.drop_near_duplicates),
    ("suffix_dedup", pipeline.cut_repeats),
    ("decontamination", pipeline.drop_benchmark_passages),
    ("byte_bpe", pipeline.encode_bytes),
]

# Likelihoods, edit distances and merges have no SQL form; tests/llm/test_pipeline.py has the
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
