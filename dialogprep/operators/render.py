"""Dialogues kept as one row per turn: routing, templating, nesting."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep.functions import text as tx

USER, ASSISTANT = "user", "assistant"

TURNS_PER_BLOCK = 4_096
SECOND_HALF = 1 << 52

NO_KEY = "no_key"


def route_roles(turns: DataFrame, user=USER, assistant=ASSISTANT) -> DataFrame:
    """User turns become inputs, assistant turns targets; other roles go."""
    return turns.filter(F.col("role").isin(user, assistant)).withColumn(
        "slot", F.when(F.col("role") == user, "input").otherwise("target")
    )


def template_turn(user=USER, assistant=ASSISTANT) -> Column:
    """Rendered text of a (role, text) row; null for roles that are dropped."""
    header = F.when(F.col("role") == user, USER).when(F.col("role") == assistant, ASSISTANT)
    return tx.render_turn(header, F.col("text"))


def render_turns(turns: DataFrame, user=USER, assistant=ASSISTANT) -> DataFrame:
    return route_roles(turns, user, assistant).withColumn(
        "rendered", template_turn(user, assistant)
    )


def turn_order(order: str, assistant=ASSISTANT) -> Column:
    """0 or 1: which half of the dialogue a turn is placed in."""
    if order == "interleaved":
        return F.lit(0)
    if order != "grouped":
        raise ValueError(f"unknown turn order {order!r}")
    return F.when(F.col("role") == assistant, 1).otherwise(0)


def unkeyed(turns: DataFrame) -> DataFrame:
    """Turns of no dialogue, with a reason; ``nest_turns`` and samples leave them out."""
    return turns.filter(F.col("conv_id").isNull()).withColumn("reason", F.lit(NO_KEY))


def nest_turns(turns: DataFrame, user=USER, assistant=ASSISTANT) -> DataFrame:
    """(conv_id, conversations) from (conv_id, turn, role, text) rows, in turn order.

    Every dialogue is one row whatever its length, so its turns meet in the task
    that writes the row, as large as the row itself. ``dialogue_blocks`` is for
    dialogues that are too long for a row.
    """
    who = (
        F.when(F.col("role") == user, "human")
        .when(F.col("role") == assistant, "gpt")
        .otherwise(F.col("role"))
    )
    entry = F.struct("turn", who.alias("from"), F.col("text").alias("value"))
    return (
        turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("_turns"))
        .select("conv_id", F.transform(
            "_turns", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))
        ).alias("conversations"))
    )


def dialogue_blocks(
    turns: DataFrame, order: str = "grouped", user=USER, assistant=ASSISTANT,
    turns_per_block: int = TURNS_PER_BLOCK,
) -> DataFrame:
    """(conv_id, part, text): the rendered text of every dialogue in blocks of turns.

    For texts that are not wanted in one row. The text is the parts' text in the
    order of ``part``; in the grouped order a part holds turns of one half.
    """
    part = (
        turn_order(order, assistant) * F.lit(SECOND_HALF)
        + F.expr(f"turn div {int(turns_per_block)}") + 1
    )
    entry = F.struct("turn", template_turn(user, assistant).alias("text"))
    return (
        turns.filter(F.col("conv_id").isNotNull()).withColumn("part", part)
        .groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(entry))["text"].alias("_texts"))
        .select("conv_id", "part", F.array_join("_texts", "").alias("text"))
    )


def dialogue_text(nested: DataFrame, order: str = "grouped") -> DataFrame:
    """Adds the rendered dialogue as ``text``."""
    return nested.withColumn("text", tx.dialogue("conversations", order))
