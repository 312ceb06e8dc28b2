"""Vocabulary, encoding, decoding, truncated samples and labels."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.functions import arrays as ar
from dialogprep.functions import text as tx
from dialogprep.operators.render import (
    ASSISTANT, USER, template_turn, turn_order,
)
from dialogprep.operators.skew import cut_heavy, keep_first, salted_join
from dialogprep.sources.scratch import stored

# Largest vocabulary held on every worker; a larger one is joined instead.
MAX_SHARED_VOCABULARY = 1 << 18
# Dialogues of more turns, and of a millionth of all, are cut before they are encoded.
HEAVY_TURNS = 10_000


def reserved_rows(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(F.lit(i).alias("id"), F.lit(tok).alias("tok"),
                 F.lit(0).cast("long").alias("n"), F.lit(True).alias("special"))
        for i, tok in enumerate(fixed.RESERVED_TOKENS)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def build_vocabulary(texts: DataFrame, text: str, size: int) -> DataFrame:
    """(id, tok, n, special): reserved rows, then the ``size`` commonest tokens.

    Counting combines map-side, so a token that makes up a third of the corpus
    is one row per task; the ranking window sees at most ``size`` rows.
    """
    commonest = (
        texts.select(F.explode(tx.tokens(F.col(text))).alias("tok"))
        .filter(~F.col("tok").isin(*fixed.RESERVED_TOKENS))
        .groupBy("tok").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "tok").limit(size)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "tok"))
    ranked = commonest.select(
        (rank + (len(fixed.RESERVED_TOKENS) - 1)).cast("int").alias("id"),
        "tok", "n", F.lit(False).alias("special"),
    )
    return reserved_rows(texts.sparkSession).unionByName(ranked)


class Codebook:
    """A vocabulary held by every worker; encodes and decodes without a shuffle."""

    def __init__(self, spark: SparkSession, rows):
        ordered = sorted(rows, key=lambda r: r["id"])
        if [r["id"] for r in ordered] != list(range(len(ordered))):
            raise ValueError("vocabulary ids must run from 0 without gaps")
        self.size = len(ordered)
        self._shared = spark.sparkContext.broadcast(
            ([r["tok"] for r in ordered], [r["special"] for r in ordered])
        )

    def encode(self, tokens: Column, unknown_id: int = fixed.UNKNOWN_ID) -> Column:
        shared = self._shared

        @F.arrow_udf("array<int>")
        def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = pa.array(shared.value[0], pa.string())
            for lists in batches:
                found = pc.index_in(lists.flatten(), value_set=known)
                flat = pc.fill_null(found, unknown_id).cast(pa.int32())
                yield pa.ListArray.from_arrays(_offsets(lists), flat)

        return ids_of(tokens)

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        shared = self._shared

        @F.arrow_udf("string")
        def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            words, special = shared.value
            shown = ["" if skip_special and s else w for w, s in zip(words, special)]
            words = pa.array(shown, pa.string())
            for lists in batches:
                taken = words.take(lists.flatten())
                joined = pa.ListArray.from_arrays(_offsets(lists), taken)
                yield pc.binary_join(joined, "")

        return text_of(ids)


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def load_codebook(vocabulary: DataFrame, limit: int = MAX_SHARED_VOCABULARY) -> Codebook | None:
    """Fetches a vocabulary of at most ``limit`` rows; None when it is larger."""
    rows = vocabulary.select("id", "tok", "special").limit(limit + 1).collect()
    return None if len(rows) > limit else Codebook(vocabulary.sparkSession, rows)


def encode_by_join(
    df: DataFrame, key: list[str], tokens: str, vocabulary: DataFrame, out: str = "ids",
    length: int | None = None, unknown_id: int = fixed.UNKNOWN_ID, **skew,
) -> DataFrame:
    """(key, ids) through a join, for a vocabulary too large to share.

    Frequent tokens are salted. ``key`` must identify a row.
    """
    wanted = F.col(tokens) if length is None else ar.truncate(F.col(tokens), length)
    spread = df.select(*key, F.posexplode_outer(wanted).alias("pos", "tok"))
    joined = salted_join(spread, vocabulary.select("tok", "id"), ["tok"], [*key, "pos"], **skew)
    entry = F.struct("pos", F.coalesce("id", F.lit(unknown_id)).cast("int").alias("id"))
    return (
        joined.groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), entry))).alias("_ids"))
        .select(*key, F.transform("_ids", lambda e: e["id"]).alias(out))
    )


def decode_by_join(
    df: DataFrame, key: list[str], ids: str, vocabulary: DataFrame, out: str = "text",
    skip_special: bool = True, **skew,
) -> DataFrame:
    """(key, text) through a join, equal to ``Codebook.decode``. ``key`` must identify a row."""
    shown = F.when(F.col("special"), F.lit("")).otherwise(F.col("tok")) if skip_special else F.col("tok")
    spread = df.select(*key, F.posexplode_outer(ids).alias("pos", "id"))
    table = vocabulary.select("id", shown.alias("tok"))
    joined = salted_join(spread, table, ["id"], [*key, "pos"], **skew)
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", "tok"))
    return (
        joined.groupBy(*key).agg(F.sort_array(F.collect_list(entry))["tok"].alias("_toks"))
        .select(*key, F.array_join("_toks", "").alias(out))
    )


class Vocabulary:
    """One handle for a vocabulary of any size.

    At most ``limit`` rows are held by every worker; a larger table is joined.
    Both ways give the same ids and texts, for repeated keys too.
    """

    def __init__(self, table: DataFrame, limit: int = MAX_SHARED_VOCABULARY):
        self.table = table
        self.shared = load_codebook(table, limit)

    def encode(self, df: DataFrame, key: list[str], tokens: Column, out: str = "ids") -> DataFrame:
        """Adds ``out``, the ids of an array of tokens."""
        if self.shared is not None:
            return df.withColumn(out, self.shared.encode(tokens))
        named = _numbered(df.withColumn("_tokens", tokens))
        ids = encode_by_join(named, [_ROW], "_tokens", self.table, out)
        return named.drop("_tokens", out).join(ids, _ROW).drop(_ROW)

    def decode(
        self, df: DataFrame, key: list[str], ids: str, out: str = "text", skip_special: bool = True
    ) -> DataFrame:
        """Adds ``out``, the text of an array of ids."""
        if self.shared is not None:
            return df.withColumn(out, self.shared.decode(F.col(ids), skip_special))
        named = _numbered(df)
        texts = decode_by_join(named, [_ROW], ids, self.table, out, skip_special)
        return named.drop(out).join(texts, _ROW).drop(_ROW)


_ROW = "_row"


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with a number each, written once: what is joined back is neither computed twice
    nor multiplied where a key is repeated."""
    return stored(df.withColumn(_ROW, F.monotonically_increasing_id()), "rows")


def as_vocabulary(given) -> "Vocabulary":
    """A handle from a handle, a shared codebook or a vocabulary table."""
    if given is None:
        raise ValueError("no vocabulary; load_codebook gives none where the table is too large: pass the table")
    if isinstance(given, Vocabulary):
        return given
    if isinstance(given, DataFrame):
        return Vocabulary(given)
    handle = Vocabulary.__new__(Vocabulary)
    handle.table, handle.shared = None, given
    return handle


def encode_turns(
    turns: DataFrame, vocabulary: "Vocabulary | Codebook | DataFrame", length: int | None = None,
    user=USER, assistant=ASSISTANT,
) -> DataFrame:
    """Adds ``ids`` per turn. Tokens never cross turns, so a dialogue's ids are
    its turns' ids in order; dropped roles have none."""
    tokens = F.coalesce(
        tx.tokens(template_turn(user, assistant)), F.array().cast("array<string>")
    )
    if length is not None:
        tokens = ar.truncate(tokens, length)
    return as_vocabulary(vocabulary).encode(turns, ["conv_id", "turn"], tokens)


def sample_ids(
    turns: DataFrame, vocabulary: "Vocabulary | Codebook | DataFrame",
    length: int = fixed.MAX_LENGTH,
    order: str = "grouped", user=USER, assistant=ASSISTANT,
    heavy_floor: int = HEAVY_TURNS, heavy_share: float = 1e-6,
) -> DataFrame:
    """(conv_id, ids, supervised): each dialogue cut to ``length`` ids.

    Every rendered turn has at least five tokens, so the first
    ``ceil(length / 5)`` turns are all a sample can use: the group collected
    per dialogue is bounded however long the dialogue is, and a heavy
    dialogue's other turns go before they are encoded. Turns are encoded where
    they are read, so at most ``length`` ids per turn are shuffled, once.
    ``supervised`` flags assistant tokens behind the turn header. Turns without a
    ``conv_id`` belong to no sample (``render.unkeyed``).
    """
    kept = F.col("role").isin(user, assistant)
    most = -(-length // fixed.MIN_TURN_TOKENS)
    placed = turns.filter(F.col("conv_id").isNotNull()).withColumn(
        "half", F.when(kept, turn_order(order, assistant)).otherwise(F.lit(2))
    )
    usable = cut_heavy(placed, "conv_id", ["half", "turn"], most, heavy_floor, heavy_share)
    encoded = encode_turns(usable, vocabulary, length, user, assistant).select(
        "conv_id", "half", "turn", "ids",
        F.when(F.col("role") == assistant, 1).otherwise(0).alias("reply"),
    )
    first = keep_first(encoded, ["conv_id"], ["half", "turn"], most)
    return (
        first.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("half", "turn", "ids", "reply"))).alias("_t"))
        .select(
            "conv_id",
            ar.truncate(F.flatten(F.col("_t")["ids"]), length).alias("ids"),
            supervised_flags(F.col("_t"), "ids", length).alias("supervised"),
        )
    )


def supervised_flags(turns: Column, items: str, length: int) -> Column:
    """1 for each item behind the header of an assistant turn, else 0.

    ``turns`` is an array of structs with ``reply`` and the array ``items``.
    """
    header = fixed.HEADER_TOKENS
    flags = F.transform(turns, lambda t: F.concat(
        ar.repeat(0, F.least(F.lit(header), F.size(t[items]))),
        F.transform(F.slice(t[items], header + 1, length), lambda _: t["reply"]),
    ))
    return ar.truncate(F.flatten(flags), length)


def labels_clone(ids, width: int | None = None, pad_id: int = fixed.PAD_ID) -> Column:
    """A copy of the ids, pads and user turns included."""
    return ids if width is None else ar.pad_right(ids, width, pad_id)


def labels_mask_pad(ids, width: int) -> Column:
    return ar.pad_right(ids, width, fixed.IGNORE_INDEX)


def labels_assistant_only(ids, supervised, width: int | None = None) -> Column:
    own = ar.keep_where(ids, supervised, fixed.IGNORE_INDEX)
    return own if width is None else ar.pad_right(own, width, fixed.IGNORE_INDEX)
