"""Connected components by alternating star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots themselves.

    ``root`` is the least node of the component. Each step moves every node's
    neighbours to the least of them, first the larger neighbours, then the
    smaller, and is written to the shared scratch folder; the number of steps
    grows with the logarithm of the longest path. Grouping combines map-side,
    and a node with very many links is a row for each task.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
                   .where("node <> root").distinct(), "links")
    before = None
    while True:
        turned = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = turned.groupBy("node").agg(F.min("root").alias("low"))
        least = least.select("node", F.least("node", "low").alias("low"))
        large = (
            turned.join(least, "node").where(F.col("root") > F.col("node"))
            .select(F.col("root").alias("node"), F.col("low").alias("root"))
            .where("node <> root").distinct()
        )
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node")
        edges = stored(
            small.select("node", F.col("low").alias("root"))
            .unionByName(small.select(F.col("root").alias("node"), F.col("low").alias("root")))
            .where("node <> root").distinct(), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root")),
                          F.countDistinct("node")).first()
        if state == before or state[0] == state[2] and _flat(edges):
            return edges
        before = state


def _flat(edges: DataFrame) -> bool:
    """Whether every node points at a root."""
    return edges.join(edges.select(F.col("node").alias("root")), "root", "left_semi").isEmpty()
