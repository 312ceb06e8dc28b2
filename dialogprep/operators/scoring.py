"""Losses over logged logits.

A log row is (sample_id, pos, label, student). ``(sample_id, pos)`` is unique
and is the key of every join here, so a sample with very many positions still
spreads over all partitions; sums combine map-side.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.functions import logits as lg

POSITION = ["sample_id", "pos"]


def pair_logits(student: DataFrame, teacher: DataFrame, how: str = "inner") -> DataFrame:
    """Student and teacher outputs of the same position, side by side.

    Tables bucketed on (sample_id, pos) join without an exchange.
    """
    return student.join(teacher.select(*POSITION, "teacher"), POSITION, how)


def shift_labels(log: DataFrame) -> DataFrame:
    """Adds ``next_label``, the label one position on; null at the last position.

    Joins the narrow label column one position back instead of sorting whole
    samples in a window.
    """
    labels = log.select(
        "sample_id", (F.col("pos") - 1).alias("pos"), F.col("label").alias("next_label")
    )
    return log.join(labels, POSITION, "left")


def check_lengths(df: DataFrame, logits: str, labels: str) -> DataFrame:
    """Nested logs: logits and labels must cover the same positions."""
    failure = F.raise_error(F.lit("logits and labels differ in length")).cast("boolean")
    return df.filter(F.when(F.size(logits) == F.size(labels), F.lit(True)).otherwise(failure))


def explode_log(df: DataFrame, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """(sample_id, pos, label, student) from one row per sample."""
    zipped = F.arrays_zip(F.col(labels).alias("label"), F.col(logits).alias("student"))
    checked = check_lengths(df, logits, labels)
    return checked.select("sample_id", F.posexplode(zipped).alias("pos", "_z")).select(
        "sample_id", "pos", F.col("_z.label").alias("label"), F.col("_z.student").alias("student")
    )


def position_terms(
    paired: DataFrame, temperature: float = fixed.TEMPERATURE, with_teacher: bool = True,
    keep: Column | None = None,
) -> DataFrame:
    """Adds ``ce`` (null if ignored) and ``kl`` (null if not comparable).

    ``keep`` optionally limits KL to some positions, e.g. those not padding.
    """
    if not with_teacher:
        return paired.withColumn(
            "ce", lg.cross_entropy(F.col("student"), F.col("next_label"))
        ).withColumn("kl", F.lit(None).cast("double"))
    both = lg.loss_terms(F.col("student"), F.col("teacher"), F.col("next_label"), temperature)
    terms = paired.withColumn("_terms", both).withColumn("ce", F.col("_terms.ce"))
    kl = F.col("_terms.kl")
    if keep is not None:
        kl = F.when(keep, kl).otherwise(F.when(kl.isNotNull(), 0.0))
    return terms.withColumn("kl", kl).drop("_terms")


def mean_or_nan(total: Column, count: Column) -> Column:
    return F.when(count == 0, F.lit(float("nan"))).otherwise(
        F.coalesce(total, F.lit(0.0)) / F.nullif(count, F.lit(0))
    )


def losses(
    terms: DataFrame, by: list[str] = (), alpha: float = fixed.ALPHA,
    temperature: float = fixed.TEMPERATURE,
) -> DataFrame:
    """Per group: ce, kl (already times T^2), loss and the counts behind them.

    CE is a mean over counted positions, KL a sum over positions divided by the
    number of samples. Without a comparable teacher for every position the loss
    is CE alone. Terms are summed per sample first, so the sample count needs
    no distinct over raw rows.
    """
    by = list(by)
    samples = terms.groupBy(*by, "sample_id").agg(
        F.sum("ce").alias("ce"), F.count("ce").alias("counted"),
        F.sum("kl").alias("kl"), F.count("kl").alias("compared"), F.count("*").alias("rows"),
    )
    grouped = samples.groupBy(*by).agg(
        F.sum("ce").alias("_ce"), F.sum("counted").alias("n_counted"),
        F.sum("kl").alias("_kl"), F.sum("compared").alias("n_compared"),
        F.sum("rows").alias("n_positions"), F.count("*").alias("n_samples"),
    )
    comparable = F.col("n_compared") == F.col("n_positions")
    staged = grouped.select(
        *by, mean_or_nan(F.col("_ce"), F.col("n_counted")).alias("ce"),
        F.when(comparable, F.col("_kl") / F.col("n_samples") * (temperature ** 2)).alias("kl"),
        "n_counted", "n_positions", "n_samples",
    )
    mixed = (1 - alpha) * F.col("ce") + alpha * F.col("kl")
    return staged.withColumn("loss", F.when(F.col("kl").isNull(), F.col("ce")).otherwise(mixed))


def fuse_label_rows(log: DataFrame, positions: int) -> DataFrame:
    """A log of fused sequences, one row per position, whose first ``positions`` are image
    positions: their labels are ignored. Logits stay in their rows."""
    label = F.when(F.col("pos") < positions, F.lit(fixed.IGNORE_INDEX)).otherwise(F.col("label"))
    return log.withColumn("label", label)


def distillation_loss(
    student: DataFrame, teacher: DataFrame | None, by: list[str] = (),
    alpha: float = fixed.ALPHA, temperature: float = fixed.TEMPERATURE,
    keep: Column | None = None,
) -> DataFrame:
    """The whole job: pair, shift, score, summarise."""
    paired = shift_labels(student)
    if teacher is not None:
        paired = pair_logits(paired, teacher, "left")
    terms = position_terms(paired, temperature, teacher is not None, keep)
    return losses(terms, by, alpha, temperature)


def hidden_state_mse(pairs: DataFrame, teacher: str, student: str, by: list[str] = ()) -> DataFrame:
    """Mean squared difference over all elements of paired hidden vectors."""
    squares = F.aggregate(
        F.zip_with(teacher, student, lambda t, s: F.pow(t.cast("double") - s.cast("double"), F.lit(2.0))),
        F.lit(0.0), lambda acc, x: acc + x,
    )
    return (
        pairs.select(*by, squares.alias("_sq"), F.size(teacher).alias("_n"))
        .groupBy(*by).agg(F.sum("_sq").alias("_sq"), F.sum("_n").alias("_n"))
        .select(*by, mean_or_nan(F.col("_sq"), F.col("_n")).alias("mse"))
    )


def hidden_state_loss(ce: Column, mse: Column, alpha: float = fixed.ALPHA) -> Column:
    return (1 - alpha) * ce + alpha * mse
