"""Column expressions for dialogue text: all JVM-side, all row-local."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogprep import fixed


def render_turn(header, value) -> Column:
    """One templated turn; a null value renders as an empty turn."""
    return F.concat(
        F.lit(fixed.TURN_START), header, F.lit("\n"),
        F.coalesce(value, F.lit("")), F.lit(fixed.TURN_END + "\n"),
    )


def ordered_turns(conversations, order="grouped", human="human", gpt="gpt") -> Column:
    """The turns to render, in order; roles other than the two are left out."""
    turns = defaulted(conversations)
    if order == "interleaved":
        return F.filter(turns, lambda t: t["from"].isin(human, gpt))
    if order != "grouped":
        raise ValueError(f"unknown turn order {order!r}")
    return F.concat(
        F.filter(turns, lambda t: t["from"] == human), F.filter(turns, lambda t: t["from"] == gpt)
    )


def _render(turn: Column, human: str) -> Column:
    header = F.when(turn["from"] == human, F.lit("user")).otherwise(F.lit("assistant"))
    return render_turn(header, turn["value"])


def dialogue(conversations, order="grouped", human="human", gpt="gpt") -> Column:
    """Text of a nested dialogue: all human turns first, or in their own order."""
    turns = ordered_turns(conversations, order, human, gpt)
    return F.array_join(F.transform(turns, lambda t: _render(t, human)), "")


def grouped_dialogue(conversations, human="human", gpt="gpt") -> Column:
    return dialogue(conversations, "grouped", human, gpt)


def interleaved_dialogue(conversations, human="human", gpt="gpt") -> Column:
    return dialogue(conversations, "interleaved", human, gpt)


def turn_tokens(conversations, order="grouped", human="human", gpt="gpt") -> Column:
    """array<struct<reply, toks>>: each rendered turn's tokens, 1 for assistant turns."""
    return F.transform(
        ordered_turns(conversations, order, human, gpt),
        lambda t: F.struct(
            F.when(t["from"] == gpt, 1).otherwise(0).alias("reply"),
            tokens(_render(t, human)).alias("toks"),
        ),
    )


def defaulted(conversations) -> Column:
    """Absent or null conversations count as no turns."""
    col = F.col(conversations) if isinstance(conversations, str) else conversations
    return F.coalesce(col, F.array().cast("array<struct<from:string,value:string>>"))


def strip_image_placeholder(text) -> Column:
    """Optional clean-up; the default jobs keep the placeholder."""
    return F.replace(text, F.lit(fixed.IMAGE_PLACEHOLDER), F.lit(""))


def generation_prompt(prompt) -> Column:
    """A single user turn followed by an open assistant header."""
    asked = F.coalesce(prompt, F.lit(fixed.DEFAULT_PROMPT))
    return F.concat(
        render_turn(F.lit("user"), asked), F.lit(fixed.TURN_START + "assistant\n")
    )


def image_path(folder: str, image) -> Column:
    """Folder joined with the image name; an absolute name replaces the folder."""
    prefix = folder if folder == "" or folder.endswith("/") else folder + "/"
    return F.when(F.startswith(image, F.lit("/")), image).otherwise(
        F.concat(F.lit(prefix), image)
    )


def tokens(text) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.TOKEN_PATTERN), F.lit(0))
