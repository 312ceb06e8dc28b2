from pyspark.sql import functions as F

from dialogprep.plans.queries import QUERIES
from tests.conftest import SF


def test_a_rewritten_table_gets_its_own_vocabulary(spark, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").limit(20)
    counts = []
    for word in ("zebra", "quagga"):
        own = turns.withColumn("text", F.lit(" ".join([word] * 3)))
        own.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        rows = QUERIES["encode_tokens"](spark, str(tmp_path)).collect()
        counts.append(sorted(map(str, rows)))
    # one word of the same count in both tables: the ids agree if each has its own vocabulary
    assert counts[0] == counts[1]
