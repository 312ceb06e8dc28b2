"""Column expressions for token arrays: truncate, pad, mask, label."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogprep import fixed


def truncate(ids, length: int) -> Column:
    return F.slice(ids, 1, length)


def repeat(value, times) -> Column:
    times = F.lit(times) if isinstance(times, int) else times
    return F.array_repeat(F.lit(value).cast("int"), F.greatest(times, F.lit(0)).cast("int"))


def pad_right(ids, width, value) -> Column:
    """Pads to ``width`` (an int or a column); longer arrays are left alone."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(ids, repeat(value, width - F.size(ids)))


def attention_mask(ids, width=None) -> Column:
    """1 per real id, then 0 per pad, from lengths only: pad may be a real id too."""
    ones = repeat(1, F.size(ids))
    return ones if width is None else pad_right(ones, width, 0)


def fuse_mask(mask, image_positions: int) -> Column:
    """Ones for the image positions in front; a null mask stays null."""
    return F.concat(repeat(1, image_positions), mask)


def fuse_labels(labels, image_positions: int) -> Column:
    """Image positions carry no loss; null labels stay null."""
    return F.concat(repeat(fixed.IGNORE_INDEX, image_positions), labels)


def fuse_sequence(image_vectors, text_vectors) -> Column:
    return F.concat(image_vectors, text_vectors)


def keep_where(values, flags, otherwise: int) -> Column:
    """``values`` where the matching flag is 1, else ``otherwise``."""
    return F.zip_with(
        values, flags, lambda v, f: F.when(f == 1, v).otherwise(F.lit(otherwise))
    )


def round_up(width, multiple) -> Column:
    if not multiple:
        return width
    return (F.ceil(width / F.lit(multiple)) * multiple).cast("int")


def as_text(values) -> Column:
    """Comma-joined form of a numeric array, for reports and comparisons."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
