"""Operator 13: sources mixed to target weights by whole copies of documents.

Sizes (words) are summed by source. Sources, in order of their code points and
the null source last, take the given weights in turn and share the wanted words
by weight; a target stops at ``most`` times what its source holds and the excess
goes to the others by weight, until none is above. A source's rate is its target
divided by its size. A document is taken floor(rate) times, and once more if a
draw hashed from the seed and its id is below the rest of the rate, so that
every run takes the same copies whatever the partitions.

A null text has size 0, as has one without words; a document without words is
taken like any other and adds none. A source without words has target and rate 0.
A null ``doc_id`` draws as the empty id. Repeated rows are separate documents
with equal draws. An empty table gives none. Other columns are not read, but
``emitted`` hands them on, whatever their names.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.llm.common import stored
from dialogprep.operators.index import dense_index
from dialogprep.operators.skew import salted_join

_SPACES = " \t\n\x0b\x0c\r"
# Sources of which a table is broadcast; one of more is joined with salt.
MAX_BROADCAST = 10_000
SEED = 2024


def word_count(text) -> Column:
    """Number of runs of anything but ASCII white space; each run shrinks to one
    letter, so that a long text makes no long list."""
    runs = F.regexp_replace(F.ltrim(text, F.lit(_SPACES)), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.coalesce(F.length(runs).cast("long"), F.lit(0).cast("long"))


def draw(key, seed: int) -> Column:
    """A number from 0 to below 1 that depends on seed and id only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def weighted(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(source, source_size, weight) of sources: weights are given in turn by code point, null last.

    Sources are dealt by ranges and numbered by partition and place, so that no
    task sorts all of them.
    """
    placed = stored(
        sizes.where("source IS NOT NULL").repartitionByRange("source").sortWithinPartitions("source")
        .select("source", "source_size", F.monotonically_increasing_id().alias("at")), "sources")
    numbered = placed.join(dense_index(placed, "at"), "at").select("source", "source_size", "idx")
    nameless = sizes.where("source IS NULL").select(
        "source", "source_size", F.lit(placed.count()).alias("idx"))
    turns = F.array(*(F.lit(int(w)).cast("long") for w in weights))
    return numbered.unionByName(nameless).select(
        "source", "source_size",
        F.element_at(turns, (F.col("idx") % len(weights) + 1).cast("int")).alias("weight"))


def targets(sources: DataFrame, percent: int, most: int) -> DataFrame:
    """Adds ``target``: min(level * weight, most * source_size), summing to the wanted words.

    Each round gives what the stopped sources leave to the others; only sums
    come to the driver. The level never falls, so a stopped source stays so, and
    rounds end once a level stops no further one.
    """
    bound = F.col("source_size") * most
    wanted = (sources.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    level, stopped = 0.0, -1
    while True:
        held = bound <= F.col("weight") * F.lit(level)
        n, full, left = sources.agg(
            F.count(F.when(held, 1)), F.coalesce(F.sum(F.when(held, bound)), F.lit(0)),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0))).first()
        if n == stopped or not left:
            break
        level, stopped = (wanted - full) / left, n
    target = F.when(held, bound.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def source_rates(
    sized: DataFrame, weights: Sequence[int], percent: int, most: int
) -> DataFrame:
    """(source, source_size, target, rate) of the sources of ``sized`` (source, size)."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = stored(weighted(sizes, weights), "weights")
    return targets(sources, percent, most).select(
        "source", "source_size", "target", rate.alias("rate"))


def with_copies(rows: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """``rows`` (doc_id, source, ...) with source_size, target and ``copies``."""
    flat = [F.col("source").isNull().alias("_nameless"), F.coalesce("source", F.lit("")).alias("_source")]
    keys = ["_nameless", "_source"]
    rates = rates.select(*flat, "source_size", "target", "rate")
    if rates.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        joined = rows.select("*", *flat).join(F.broadcast(rates), keys)
    else:
        joined = salted_join(rows.select("*", *flat), rates, keys, ["doc_id"], "inner")
    whole = F.floor("rate")
    extra = (draw("doc_id", seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", whole + extra).drop("rate", *keys)


def plan(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), percent: int = 100, most: int = 3,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every document of ``docs``
    (doc_id, text, source). Texts are read once; a narrow row of each is kept."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return with_copies(sized, source_rates(sized, weights, percent, most), seed)


def emitted(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), percent: int = 100, most: int = 3,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, numbered by ``copy``
    from 0, which replaces a column of that name. Texts are read twice and not shuffled."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    rows = docs.select("doc_id", "source", F.struct("*").alias("_row"))
    taken = with_copies(rows, source_rates(sized, weights, percent, most), seed).where("copies > 0")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c != "copy"]
    return taken.select(*kept, F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("copy"))
