"""Whole jobs composed of the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.functions import arrays as ar
from dialogprep.functions import text as tx
from dialogprep.operators import batching, fusion, index, render, tokens, validate
from dialogprep.operators.skew import salted_join
from dialogprep.sources import images
from dialogprep.sources.scratch import stored

LABELS = ("clone", "mask_pad", "assistant_only")


def corpus_vocabulary(turns: DataFrame, size: int) -> DataFrame:
    return tokens.build_vocabulary(render.render_turns(turns), "rendered", size)


def with_labels(
    samples: DataFrame, policy: str, length: int | None, pad_id: int = fixed.PAD_ID
) -> DataFrame:
    ids, flags = F.col("ids"), F.col("supervised")
    if policy == "clone":
        made = tokens.labels_clone(ids, length, pad_id)
    elif policy == "mask_pad":
        made = ids if length is None else tokens.labels_mask_pad(ids, length)
    elif policy == "assistant_only":
        made = tokens.labels_assistant_only(ids, flags, length)
    else:
        raise ValueError(f"unknown label policy {policy!r}")
    return samples.withColumn("labels", made)


def prepare_samples(
    turns: DataFrame, vocabulary, length: int = fixed.MAX_LENGTH, order: str = "grouped",
    labels: str = "clone", pad: bool = True, pad_id: int = fixed.PAD_ID,
) -> DataFrame:
    """(conv_id, input_ids, attention_mask, labels) from one row per turn.

    With ``pad=False`` arrays stay ragged, to be padded when batches form.
    """
    samples = tokens.sample_ids(turns, vocabulary, length, order)
    return _arrays(samples, ["conv_id"], labels, length if pad else None, pad_id)


def prepare_records(
    records: DataFrame, vocabulary, length: int = fixed.MAX_LENGTH,
    order: str = "grouped", labels: str = "clone", pad: bool = True, pad_id: int = fixed.PAD_ID,
    keep: tuple[str, ...] = ("sample_id", "image"),
) -> DataFrame:
    """The same from nested records: row-local, so no shuffle with a shared vocabulary.

    ``keep`` names columns that are handed on; a joined vocabulary needs a unique ``sample_id``.
    """
    split = records.withColumn("_turns", tx.turn_tokens("conversations", order))
    words = ar.truncate(F.flatten(F.col("_turns")["toks"]), length)
    flagged = split.select(
        *keep, words.alias("_words"),
        tokens.supervised_flags(F.col("_turns"), "toks", length).alias("supervised"),
    )
    handle = tokens.as_vocabulary(vocabulary)
    samples = handle.encode(flagged, ["sample_id"], F.col("_words"))
    return _arrays(samples, list(keep), labels, length if pad else None, pad_id)


def _arrays(samples: DataFrame, keep: list[str], labels: str, width: int | None, pad_id: int):
    ids = F.col("ids")
    return with_labels(samples, labels, width, pad_id).select(
        *keep,
        (ids if width is None else ar.pad_right(ids, width, pad_id)).alias("input_ids"),
        ar.attention_mask(ids, width).alias("attention_mask"),
        "labels",
    )


def batch_samples(
    samples: DataFrame, keys: DataFrame, key: str, size: int = fixed.BATCH_SIZE,
    seed: int | None = None,
) -> DataFrame:
    """Adds ``idx`` and ``batch_id``; a seed asks for the shuffled order.

    ``keys`` holds each sample's key once, so that positions are found from a
    narrow scan and only (key, idx) joins the samples.
    """
    positions = (
        index.dense_index(keys, key) if seed is None else index.shuffled_index(keys, key, seed)
    )
    return batching.micro_batches(samples.join(positions, key), size)


def collated_batches(
    samples: DataFrame, keys: DataFrame, key: str, size: int = fixed.BATCH_SIZE,
    seed: int | None = None, multiple_of: int | None = None, images: str | None = None,
) -> DataFrame:
    batched = batch_samples(samples, keys, key, size, seed)
    return batching.collate(batched, multiple_of=multiple_of, images=images)


def dataset_parts(
    records: DataFrame, folder: str, vocabulary, length: int = fixed.MAX_LENGTH,
    order: str = "grouped", labels: str = "clone", pad: bool = True,
    size: int = fixed.IMAGE_SIZE, method: str = "bilinear",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, rejects, pictures) of records and the images they name below ``folder``.

    Samples have the ``path`` of their picture, pictures (path, pixel_values) are
    a table of their own, for ``with_pictures``: a tensor is far larger than all
    else and should move last. Images that no record names are left before
    tensors are made, and tensors are made and written once.
    """
    path = images.normal_path(tx.image_path(folder, F.col("image")))
    named = records.withColumn("path", F.when(F.col("image") != "", path))
    wanted = named.where("path IS NOT NULL").select("path").distinct()
    raw = images.read_images(records.sparkSession, folder).join(wanted, "path", "left_semi")
    pictures = stored(images.pixel_values(raw, size, method), "pictures")
    checked = validate.require_image(named, pictures.select("path", "readable"), "path", ["sample_id"], "readable")
    samples = prepare_records(
        validate.accepted(checked), vocabulary, length, order, labels, pad,
        keep=("sample_id", "image", "path"),
    )
    rejects = validate.rejected(checked).select("sample_id", "image", "reason")
    return samples, rejects, pictures.where("readable").select("path", "pixel_values")


def with_pictures(samples: DataFrame, pictures: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples with the pixel values of their ``path``; a picture that many share is salted."""
    return salted_join(samples, pictures, ["path"], [key], "inner").drop("path")


def prepare_dataset(
    records: DataFrame, folder: str, vocabulary, length: int = fixed.MAX_LENGTH,
    order: str = "grouped", labels: str = "clone", pad: bool = True,
    size: int = fixed.IMAGE_SIZE, method: str = "bilinear",
) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of records and the images they name below ``folder``.

    A sample has sample_id, image, pixel_values, input_ids, attention_mask and
    labels. Images are found by their path. A reject has a ``reason``: no_image,
    not_found or unreadable. ``sample_id`` must be unique.
    """
    samples, rejects, pictures = dataset_parts(
        records, folder, vocabulary, length, order, labels, pad, size, method)
    return with_pictures(samples, pictures), rejects


def dataset_batches(
    records: DataFrame, folder: str, vocabulary, batch_size: int = fixed.BATCH_SIZE,
    seed: int | None = None, multiple_of: int | None = None, length: int = fixed.MAX_LENGTH,
    order: str = "grouped", labels: str = "clone", size: int = fixed.IMAGE_SIZE, method: str = "bilinear",
) -> tuple[DataFrame, DataFrame]:
    """(batches, rejects): collated batches of ``prepare_dataset``'s samples.

    Batch ids are found from the samples' keys; tensors join the batched samples.
    """
    samples, rejects, pictures = dataset_parts(
        records, folder, vocabulary, length, order, labels, False, size, method)
    samples = stored(samples, "samples")
    batched = batch_samples(samples, samples.select("sample_id"), "sample_id", batch_size, seed)
    return batching.collate(
        with_pictures(batched, pictures), multiple_of=multiple_of, images="pixel_values"), rejects


def with_image_features(
    samples: DataFrame, images: DataFrame, key: str, salt_by: str | list[str]
) -> tuple[DataFrame, DataFrame]:
    """(accepted samples with their image columns, rejected ones with a reason)."""
    checked = validate.require_image(samples, images, key, salt_by)
    return validate.accepted(checked), validate.rejected(checked)


def fuse_samples(
    samples: DataFrame, patches: str, layers, table: DataFrame, width: int, positions: int,
    key: str = "conv_id",
) -> DataFrame:
    """Model inputs: projected patches in front of embedded ids, with mask and labels.

    ``samples`` has input_ids, attention_mask, labels and ``patches``, an array
    of ``positions`` patch vectors; ``layers`` projects them to ``width``.
    """
    spark = samples.sparkSession
    embedded = fusion.embed(samples, [key], "input_ids", table, width, out="_text")
    projected = fusion.project(spark, F.col(patches), layers, sequence=True)
    return embedded.withColumn("_image", projected).select(
        key,
        ar.fuse_sequence(F.col("_image"), F.col("_text")).alias("inputs"),
        ar.fuse_mask(F.col("attention_mask"), positions).alias("attention_mask"),
        ar.fuse_labels(F.col("labels"), positions).alias("labels"),
    )
