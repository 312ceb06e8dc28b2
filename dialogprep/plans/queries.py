"""One named query per operator, over the driver's tables."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep import fixed, schemas
from dialogprep.functions import arrays as ar
from dialogprep.functions import logits as lg
from dialogprep.functions import text as tx
from dialogprep.operators import (
    account, batching, fusion, index, inference, render, scoring, tokens, validate,
)
from dialogprep.plans import fixtures as fx
from dialogprep.plans import jobs
from dialogprep.sources import images, records
from dialogprep.sources.scratch import scratch_dir, stored
from dialogprep.streaming import records as streaming

QUERIES = {}


def query(make):
    QUERIES[make.__name__] = make
    return make


def _turns(spark, sf):
    return fx.table(spark, sf, "conversations")


def _keys(spark, sf):
    return _turns(spark, sf).select("conv_id").distinct()


def _vocabulary(spark, sf):
    return jobs.corpus_vocabulary(_turns(spark, sf), fx.VOCABULARY_SIZE)


def _codebook(spark, sf):
    """The vocabulary of the corpus, built within each query that needs it."""
    return tokens.load_codebook(_vocabulary(spark, sf))


def _samples(spark, sf, order="grouped"):
    return tokens.sample_ids(_turns(spark, sf), _codebook(spark, sf), order=order)


def _batched(spark, sf, labels="mask_pad"):
    samples = jobs.prepare_samples(
        _turns(spark, sf), _codebook(spark, sf), labels=labels, pad=False
    )
    return jobs.batch_samples(samples, _keys(spark, sf), "conv_id")


def _or_minus_one(name):
    return F.coalesce(F.col(name), F.lit(-1)).alias(name)


def _round(col):
    return F.round(col, 6)


# Records, fields, text


@query
def sample_count(spark, sf):
    return _turns(spark, sf).agg(
        F.count_distinct("conv_id").alias("n_records"), F.count("*").alias("n_turns")
    )


@query
def sample_at_index(spark, sf):
    positions = index.dense_index(_keys(spark, sf), "conv_id")
    turns = index.fetch(_turns(spark, sf), positions, "conv_id", [0, 7, 19])
    return turns.select("idx", "conv_id", "turn", "role", "text")


@query
def optional_defaults(spark, sf):
    has_reply = F.exists("conversations", lambda t: t["from"] == "gpt")
    absent = fx.records(spark, sf).withColumn(
        "conversations", F.when(has_reply, F.col("conversations"))
    )
    return absent.select(
        "sample_id", F.size(tx.defaulted("conversations")).alias("n_turns"),
        tx.grouped_dialogue("conversations").alias("text"),
    )


@query
def image_path(spark, sf):
    name = F.concat((F.col("conv_id") * 7).cast("string"), F.lit(".png"))
    absolute = F.concat(F.lit("/elsewhere/"), name)
    image = F.when(F.col("role") == "system", absolute).otherwise(name)
    return _turns(spark, sf).select(
        "conv_id", "turn", tx.image_path("data/images", image).alias("path")
    )


@query
def missing_image_rejects(spark, sf):
    stored = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    checked = validate.require_image(fx.image_keys(spark, sf), stored, "image_id", "conv_id")
    return checked.select(
        "conv_id", _or_minus_one("image_id"), _or_minus_one("label"),
        F.coalesce("reason", F.lit("accepted")).alias("reason"),
    )


@query
def missing_image_rejects_salted(spark, sf):
    """Turns ask for images, so keys repeat; low limits make every key heavy."""
    wanted = _turns(spark, sf).select(
        "conv_id", "turn", (F.col("conv_id") % 5 * 7).alias("image_id")
    )
    stored = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    checked = validate.require_image(
        wanted, stored, "image_id", ["conv_id", "turn"], floor=3, share=0.01, salts=8
    )
    return checked.select(
        "conv_id", "turn", "image_id", _or_minus_one("label"),
        F.coalesce("reason", F.lit("accepted")).alias("reason"),
    )


@query
def role_routing(spark, sf):
    return render.route_roles(_turns(spark, sf)).select("conv_id", "turn", "slot", "text")


@query
def render_turns(spark, sf):
    return render.render_turns(_turns(spark, sf)).select("conv_id", "turn", "rendered")


@query
def dialogue_grouped(spark, sf):
    nested = render.nest_turns(_turns(spark, sf))
    return render.dialogue_text(nested, "grouped").select("conv_id", "text")


@query
def dialogue_interleaved(spark, sf):
    nested = render.nest_turns(_turns(spark, sf))
    return render.dialogue_text(nested, "interleaved").select("conv_id", "text")


@query
def dialogue_parts(spark, sf):
    """Grouped text of every dialogue in blocks of three turn numbers."""
    return render.dialogue_blocks(_turns(spark, sf), "grouped", turns_per_block=3)


@query
def generation_prompt(spark, sf):
    asked = F.when(F.col("role") == "user", F.col("text"))
    return _turns(spark, sf).select(
        "conv_id", "turn", tx.generation_prompt(asked).alias("prompt")
    )


# Tokens


@query
def vocab_topk(spark, sf):
    return _vocabulary(spark, sf)


@query
def encode_tokens(spark, sf):
    encoded = tokens.encode_turns(render.route_roles(_turns(spark, sf)), _codebook(spark, sf))
    return encoded.select("conv_id", "turn", ar.as_text("ids").alias("ids"))


@query
def encode_tokens_by_join(spark, sf):
    """The way taken by a vocabulary too large to share, on the same corpus."""
    words = render.render_turns(_turns(spark, sf)).withColumn("words", tx.tokens(F.col("rendered")))
    encoded = tokens.encode_by_join(
        words, ["conv_id", "turn"], "words", _vocabulary(spark, sf), floor=1000, share=0.01
    )
    return encoded.select("conv_id", "turn", ar.as_text("ids").alias("ids"))


@query
def truncate_tokens(spark, sf):
    return _samples(spark, sf).select(
        "conv_id", F.size("ids").alias("n_ids"), ar.as_text("ids").alias("ids")
    )


@query
def truncate_interleaved(spark, sf):
    return _samples(spark, sf, "interleaved").select(
        "conv_id", F.size("ids").alias("n_ids"), ar.as_text("ids").alias("ids")
    )


@query
def pad_fixed(spark, sf):
    samples = jobs.prepare_samples(_turns(spark, sf), _codebook(spark, sf))
    return samples.select("conv_id", ar.as_text("input_ids").alias("input_ids"))


@query
def attention_mask(spark, sf):
    samples = jobs.prepare_samples(_turns(spark, sf), _codebook(spark, sf))
    return samples.select("conv_id", ar.as_text("attention_mask").alias("attention_mask"))


def _labels(spark, sf, policy):
    samples = jobs.prepare_samples(_turns(spark, sf), _codebook(spark, sf), labels=policy)
    return samples.select("conv_id", ar.as_text("labels").alias("labels"))


@query
def labels_clone(spark, sf):
    return _labels(spark, sf, "clone")


@query
def labels_mask_pad(spark, sf):
    return _labels(spark, sf, "mask_pad")


@query
def labels_assistant_only(spark, sf):
    return _labels(spark, sf, "assistant_only")


@query
def decode_tokens(spark, sf):
    codebook = _codebook(spark, sf)
    encoded = tokens.encode_turns(render.route_roles(_turns(spark, sf)), codebook)
    return encoded.select("conv_id", "turn", codebook.decode(F.col("ids")).alias("decoded"))


@query
def decode_tokens_by_join(spark, sf):
    """The way taken by a vocabulary too large to share, there and back."""
    vocabulary = tokens.Vocabulary(_vocabulary(spark, sf), limit=100)
    encoded = tokens.encode_turns(render.route_roles(_turns(spark, sf)), vocabulary)
    decoded = vocabulary.decode(encoded, ["conv_id", "turn"], "ids", "decoded")
    return decoded.select("conv_id", "turn", "decoded")


@query
def nested_records(spark, sf):
    """Samples straight from nested records, without a shuffle of their own."""
    prepared = jobs.prepare_records(
        fx.records(spark, sf), _codebook(spark, sf), labels="assistant_only"
    )
    return prepared.select(
        "sample_id", "image", ar.as_text("input_ids").alias("input_ids"),
        ar.as_text("attention_mask").alias("attention_mask"), ar.as_text("labels").alias("labels"),
    )


# Positions and batches


@query
def dense_index(spark, sf):
    return index.dense_index(fx.table(spark, sf, "orders"), "o_orderkey")


@query
def epoch_shuffle(spark, sf):
    return index.shuffled_index(fx.table(spark, sf, "orders"), "o_orderkey", seed=17)


@query
def micro_batches(spark, sf):
    return batching.micro_batches(index.dense_index(_keys(spark, sf), "conv_id"))


@query
def accumulation_steps(spark, sf):
    return batching.accumulation_steps(micro_batches(spark, sf))


def _padded_column(spark, sf, column, multiple_of=None):
    fills = batching.collation_fills()
    padded = batching.pad_in_batch(_batched(spark, sf), {column: fills[column]}, multiple_of)
    return padded.select("batch_id", "idx", ar.as_text(column).alias(column))


@query
def collate_input_ids(spark, sf):
    return _padded_column(spark, sf, "input_ids")


@query
def collate_attention_mask(spark, sf):
    return _padded_column(spark, sf, "attention_mask")


@query
def collate_labels(spark, sf):
    return _padded_column(spark, sf, "labels")


@query
def collate_multiple_of(spark, sf):
    return _padded_column(spark, sf, "input_ids", multiple_of=8)


def _featured(spark, sf):
    """Accepted dialogues with their image vectors, joined and written once."""
    known = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.col("embedding").alias("pixel_values")
    )
    accepted, _ = jobs.with_image_features(
        fx.image_keys(spark, sf), known, "image_id", "conv_id"
    )
    return stored(accepted, "featured")


@query
def stack_features(spark, sf):
    featured = _featured(spark, sf)
    batched = jobs.batch_samples(featured, featured.select("conv_id"), "conv_id")
    stacked = batching.stack(batched, ["pixel_values"], ["pixel_values"])
    flat = F.flatten("pixel_values")
    return stacked.select(
        "batch_id", "n", F.size(flat).alias("n_values"),
        _round(F.aggregate(flat, F.lit(0.0), lambda acc, x: acc + x)).alias("total"),
    )


@query
def collate_batch(spark, sf):
    featured = _featured(spark, sf)
    samples = jobs.prepare_samples(
        _turns(spark, sf), _codebook(spark, sf), labels="mask_pad", pad=False
    ).join(featured, "conv_id")
    batches = jobs.collated_batches(
        samples, featured.select("conv_id"), "conv_id", images="pixel_values"
    )
    rows = lambda name: F.array_join(F.transform(name, ar.as_text), ";")
    return batches.select(
        "batch_id", "n", rows("input_ids").alias("input_ids"),
        rows("attention_mask").alias("attention_mask"), rows("labels").alias("labels"),
        F.array_join(F.transform("pixel_values", lambda v: F.size(v).cast("string")), ";").alias("sizes"),
    )


# Fusion


@query
def embedding_lookup(spark, sf):
    samples = _samples(spark, sf)
    return _looked_up(fusion.embed(samples, ["conv_id"], "ids", _vector_table(spark, sf), 64))


@query
def embedding_lookup_by_join(spark, sf):
    samples = _samples(spark, sf)
    vectors = fusion.lookup_by_join(
        samples, ["conv_id"], "ids", _vector_table(spark, sf), floor=200, share=0.01
    )
    return _looked_up(vectors)


def _vector_table(spark, sf):
    """A vector for every id of the vocabulary; the stored vectors are used in turn."""
    stored = fx.table(spark, sf, "embeddings")
    ids = spark.range(fx.VOCABULARY_SIZE + len(fixed.RESERVED_TOKENS))
    turn = ids.withColumn("vec_id", F.col("id") % stored.agg(F.count("*")).scalar())
    return turn.join(stored, "vec_id").select("id", F.col("embedding").alias("vec"))


def _looked_up(df):
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return df.select("conv_id", F.posexplode("vectors").alias("pos", "vec")).select(
        "conv_id", "pos", F.size("vec").alias("width"), _round(total).alias("total")
    )


@query
def linear_layer(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    out = fusion.linear(spark, F.col("embedding"), *fx.weights(8, 64))
    return vectors.select("vec_id", F.posexplode(out).alias("unit", "value")).withColumn(
        "value", _round("value")
    )


@query
def project_vectors(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    out = fusion.project(spark, F.col("embedding"), (fx.weights(8, 64, 4.0), fx.weights(8, 8, 4.0)))
    return vectors.select("vec_id", F.posexplode(out).alias("unit", "value")).withColumn(
        "value", _round("value")
    )


@query
def fuse_sequence(spark, sf):
    """Three quarters of a vector stand for image patches, the rest for text."""
    pieces = lambda first, last: F.transform(
        F.sequence(F.lit(first), F.lit(last)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16))
    )
    fused = ar.fuse_sequence(pieces(0, 2), pieces(3, 3))
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return fx.table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(fused).alias("pos", "vec")
    ).select("vec_id", "pos", F.size("vec").alias("width"), _round(total).alias("total"))


IMAGE_POSITIONS = 196


@query
def fuse_mask(spark, sf):
    samples = jobs.prepare_samples(_turns(spark, sf), _codebook(spark, sf))
    mask = F.when(F.col("conv_id") % 10 != 0, F.col("attention_mask"))
    return samples.select("conv_id", ar.as_text(ar.fuse_mask(mask, IMAGE_POSITIONS)).alias("mask"))


@query
def fuse_labels(spark, sf):
    samples = jobs.prepare_samples(_turns(spark, sf), _codebook(spark, sf))
    labels = F.when(F.col("conv_id") % 10 != 0, F.col("labels"))
    return samples.select(
        "conv_id", ar.as_text(ar.fuse_labels(labels, IMAGE_POSITIONS)).alias("labels")
    )


@query
def fused_samples(spark, sf):
    """Accepted dialogues as model inputs: four patches each, then the text."""
    samples = jobs.prepare_samples(_turns(spark, sf), _codebook(spark, sf), labels="mask_pad")
    patches = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("pixel_values", i * 16 + 1, F.lit(16))
    )
    with_patches = samples.join(_featured(spark, sf), "conv_id").withColumn("patches", patches)
    layers = (fx.weights(8, 16, 4.0), fx.weights(64, 8, 4.0))
    fused = jobs.fuse_samples(with_patches, "patches", layers, _vector_table(spark, sf), 64, 4)
    total = F.aggregate(F.flatten("inputs"), F.lit(0.0), lambda acc, x: acc + x)
    return fused.select(
        "conv_id", F.size("inputs").alias("n_positions"), _round(total).alias("total"),
        ar.as_text("attention_mask").alias("mask"), ar.as_text("labels").alias("labels"),
    )


# Scoring


@query
def pair_logits(spark, sf):
    paired = scoring.pair_logits(fx.student_log(spark, sf), fx.teacher_log(spark, sf))
    dot = F.aggregate(
        F.zip_with("student", "teacher", lambda s, t: s * t), F.lit(0.0), lambda acc, x: acc + x
    )
    return paired.select("sample_id", "pos", "label", _round(dot).alias("dot"))


@query
def shift_labels(spark, sf):
    shifted = scoring.shift_labels(fx.student_log(spark, sf)).filter("next_label is not null")
    return shifted.select("sample_id", "pos", "label", "next_label")


def _scores(log, scores):
    return log.select("sample_id", "pos", F.posexplode(scores).alias("unit", "value")).withColumn(
        "value", _round("value")
    )


@query
def log_softmax(spark, sf):
    return _scores(fx.student_log(spark, sf), lg.log_softmax("student", fixed.TEMPERATURE))


@query
def softmax(spark, sf):
    return _scores(fx.teacher_log(spark, sf), lg.softmax("teacher", fixed.TEMPERATURE))


def _by_batch(log):
    return log.withColumn("batch_id", F.expr("sample_id div 4"))


def _report(losses, *columns):
    rounded = [_round(c).alias(c) if c in ("ce", "kl", "loss") else F.col(c) for c in columns]
    return losses.select(*rounded)


@query
def ce_loss(spark, sf):
    return _report(
        scoring.distillation_loss(fx.student_log(spark, sf), None), "ce", "n_counted", "n_positions"
    )


@query
def kl_loss(spark, sf):
    losses = scoring.distillation_loss(fx.student_log(spark, sf), fx.teacher_log(spark, sf))
    return _report(losses, "kl", "n_samples")


@query
def kl_loss_mask_padding(spark, sf):
    losses = scoring.distillation_loss(
        fx.student_log(spark, sf), fx.teacher_log(spark, sf),
        keep=F.col("label") != fixed.IGNORE_INDEX,
    )
    return _report(losses, "kl", "n_samples")


@query
def distill_loss(spark, sf):
    losses = scoring.distillation_loss(fx.student_log(spark, sf), fx.teacher_log(spark, sf))
    return _report(losses, "ce", "kl", "loss")


@query
def distill_loss_per_batch(spark, sf):
    losses = scoring.distillation_loss(
        _by_batch(fx.student_log(spark, sf)), fx.teacher_log(spark, sf), ["batch_id"]
    )
    return _report(losses, "batch_id", "ce", "kl", "loss", "n_counted", "n_samples")


@query
def distill_loss_vocab_mismatch(spark, sf):
    """Every other batch has a teacher of half the width."""
    teacher = _by_batch(fx.teacher_log(spark, sf))
    cut = F.when(F.col("batch_id") % 2 == 0, F.slice("teacher", 1, 32)).otherwise(F.col("teacher"))
    losses = scoring.distillation_loss(
        _by_batch(fx.student_log(spark, sf)), teacher.withColumn("teacher", cut), ["batch_id"]
    )
    return _report(losses, "batch_id", "loss")


@query
def distill_loss_no_teacher(spark, sf):
    """Every third batch was logged without a teacher."""
    teacher = _by_batch(fx.teacher_log(spark, sf)).filter(F.col("batch_id") % 3 != 0)
    losses = scoring.distillation_loss(
        _by_batch(fx.student_log(spark, sf)), teacher, ["batch_id"]
    )
    return _report(losses, "batch_id", "loss")


@query
def hidden_state_mse(spark, sf):
    pairs = fx.table(spark, sf, "embeddings").select(
        "label", F.col("embedding").alias("student"), F.reverse("embedding").alias("teacher")
    )
    return scoring.hidden_state_mse(pairs, "teacher", "student", ["label"]).withColumn(
        "mse", _round("mse")
    )


@query
def hidden_state_loss(spark, sf):
    ce = scoring.distillation_loss(fx.student_log(spark, sf), None).select("ce")
    pairs = fx.table(spark, sf, "embeddings").select(
        F.col("embedding").alias("student"), F.reverse("embedding").alias("teacher")
    )
    mse = scoring.hidden_state_mse(pairs, "teacher", "student")
    return ce.select(_round(scoring.hidden_state_loss(F.col("ce"), mse.scalar())).alias("loss"))


@query
def fused_ce_loss(spark, sf):
    """Logs over four image and six text positions: labels are fused row by row."""
    fused = scoring.fuse_label_rows(fx.student_log(spark, sf), 4)
    losses = scoring.distillation_loss(fused, None)
    return _report(losses, "ce", "n_counted", "n_positions")


# Accounting


@query
def supervised_token_share(spark, sf):
    """What the turn order costs in supervised tokens after truncation."""
    codebook = _codebook(spark, sf)
    parts = []
    for order in ("grouped", "interleaved"):
        samples = jobs.prepare_samples(
            _turns(spark, sf), codebook, order=order, labels="assistant_only"
        )
        share = account.supervised_token_share(samples, "labels")
        parts.append(share.select(F.lit(order).alias("turn_order"), "flagged", "total", "percent"))
    return parts[0].unionByName(parts[1])


@query
def flagged_share(spark, sf):
    documents = fx.table(spark, sf, "documents")
    return account.flagged_share(
        documents, F.col("n_chars"), F.col("lang") == "en", ["source"]
    ).select("source", "flagged", "total", "percent")


# Predictors


def _make_head():
    weight, bias = fx.weights(8, 64)

    def predict(vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(np.float64) @ weight.T + bias

    return predict


@query
def batch_predict(spark, sf):
    head = inference.predictor(_make_head, T.ArrayType(T.DoubleType()), 128, [[64]])
    scored = fx.table(spark, sf, "embeddings").select("vec_id", head("embedding").alias("scores"))
    return scored.select(
        "vec_id", _round(F.array_max("scores")).alias("best_score"),
        _round(F.array_min("scores")).alias("worst_score"),
    )


def _make_echo():
    """Answers with the first words of the prompt: eight, or four, by the image."""

    def predict(features: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        answer = ids[:, 3:11].copy()
        answer[:, 4:][features[:, 0] <= 0] = fixed.PAD_ID
        return answer.astype(np.int32)

    return predict


@query
def batch_evaluate(spark, sf):
    asked = render.route_roles(_turns(spark, sf)).filter("slot = 'input'").select(
        "conv_id", "turn", F.col("text").alias("prompt")
    )
    rows = asked.join(_featured(spark, sf), "conv_id")
    echo = inference.predictor(_make_echo, T.ArrayType(T.IntegerType()), 64, [[64], [fixed.MAX_LENGTH], None])
    out = inference.evaluate(rows, _codebook(spark, sf), echo, "pixel_values")
    return out.select("conv_id", "turn", "response")


def _make_code_points():
    return lambda texts: [[ord(c) for c in text] for text in texts]


@query
def tokenizer_hook(spark, sf):
    encode = inference.tokenizer(_make_code_points)
    return _turns(spark, sf).select("conv_id", "turn", ar.as_text(encode("text")).alias("ids"))


# Sources and sinks


@query
def json_roundtrip(spark, sf):
    out = scratch_dir(spark, "records")
    records.write_records(fx.records(spark, sf), out)
    return _described(records.read_records(spark, out))


@query
def mixed_layouts(spark, sf):
    """A folder of JSON lines, arrays on a line, arrays over several lines, and cut lines."""
    out = scratch_dir(spark, "mixed")
    rows = fx.records(spark, sf).withColumn("kind", F.col("sample_id") % 4)
    record = F.struct("sample_id", "image", "conversations")
    lines = rows.filter("kind = 0").select(F.to_json(record).alias("value"))
    short = rows.filter("kind = 1").select(F.to_json(F.array(record)).alias("value"))
    pretty = (
        rows.filter("kind = 2").groupBy(F.expr("sample_id div 100").alias("file"))
        .agg(F.to_json(F.sort_array(F.collect_list(record)), {"pretty": "true"}).alias("value"))
    )
    cut = rows.filter("kind = 3").select(F.substring(F.to_json(record), 1, 50).alias("value"))
    for name, frame in (("lines", lines.unionByName(cut)), ("short", short)):
        frame.write.text(f"{out}/{name}")
    pretty.write.partitionBy("file").text(f"{out}/pretty")
    parsed = records.read_parsed(spark, [f"{out}/lines", f"{out}/short", f"{out}/pretty/*"])
    kept = records.positioned(parsed)
    held = parsed.filter(F.col(schemas.CORRUPT).isNotNull())
    return kept.agg(
        F.count("*").alias("n_rows"), F.countDistinct("position").alias("n_positions"),
        F.sum(F.size("conversations")).alias("n_turns"), F.sum("sample_id").alias("ids"),
    ).withColumn("status", F.lit("good")).unionByName(held.agg(
        F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("n_positions"),
        F.lit(0).cast("long").alias("n_turns"), F.lit(0).cast("long").alias("ids"),
    ).withColumn("status", F.lit("quarantined")))


def _described(df):
    return df.select(
        "sample_id", "image", F.size(tx.defaulted("conversations")).alias("n_turns"),
        tx.grouped_dialogue("conversations").alias("text"),
    )


@query
def corrupt_quarantine(spark, sf):
    """Every tenth line is cut off in the middle."""
    out = scratch_dir(spark, "landing")
    line = F.to_json(F.struct("sample_id", "image", "conversations"))
    cut = F.when(F.col("sample_id") % 10 == 0, F.substring(line, 1, 40)).otherwise(line)
    fx.records(spark, sf).select(cut.alias("value")).write.text(out)
    good, bad = records.read_with_quarantine(spark, out)
    kept = good.select(
        F.lit("good").alias("status"), F.size("conversations").alias("n_turns"),
        F.lit(0).alias("n_chars"),
    )
    held = bad.select(
        F.lit("quarantined").alias("status"), F.lit(0).alias("n_turns"),
        F.length(schemas.CORRUPT).alias("n_chars"),
    )
    return kept.unionByName(held).groupBy("status").agg(
        F.count("*").alias("n_rows"), F.sum("n_turns").alias("n_turns"),
        F.sum("n_chars").alias("n_chars"),
    )


@query
def parquet_samples(spark, sf):
    """Samples written in partitions by whether they were cut, then read back."""
    out = scratch_dir(spark, "samples")
    samples = _samples(spark, sf).withColumn(
        "cut", (F.size("ids") == fixed.MAX_LENGTH).cast("int")
    )
    records.write_samples(samples, out, ["cut"])
    return spark.read.parquet(out).select("conv_id", F.size("ids").alias("n_ids"), "cut")


def _image_folder(spark, sf):
    folder = scratch_dir(spark, "images")
    fx.write_images(fx.image_rows(spark, sf), folder)
    return folder


def _image_id(path):
    return F.regexp_extract(path, r"(\d+)\.png$", 1).cast("long")


@query
def image_inventory(spark, sf):
    folder = _image_folder(spark, sf)
    files = images.list_images(spark, folder).select(
        _image_id("path").alias("image_id"), (F.col("length") > 4).cast("int").alias("large")
    )
    wanted = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    attached = validate.attach_images(wanted, files, "image_id", "label")
    return attached.select(
        "image_id", F.col("found").cast("int").alias("found"), _or_minus_one("large")
    )


@query
def image_decode(spark, sf):
    decoded = images.rgb(images.read_images(spark, _image_folder(spark, sf)))
    return decoded.select(
        _image_id("path").alias("image_id"), "height", "width",
        F.col("readable").cast("int").alias("readable"), F.hex("rgb").alias("rgb"),
    )


@query
def image_tensor(spark, sf):
    raw = images.read_images(spark, _image_folder(spark, sf))
    made = images.pixel_values(raw, size=16, method="nearest").filter("readable")
    total = lambda plane: F.aggregate(
        F.slice("pixel_values", plane * 256 + 1, 256), F.lit(0.0), lambda acc, x: acc + x
    )
    return made.select(
        _image_id("path").alias("image_id"), F.size("pixel_values").alias("n_values"),
        _round(total(0)).alias("red"), _round(total(1)).alias("green"), _round(total(2)).alias("blue"),
    )


def _dataset(spark, sf):
    """(records, folder, vocabulary): records whose dialogue has a system turn name no image;
    others may lack theirs."""
    turns = _turns(spark, sf).groupBy("conv_id").agg(F.max(F.col("role") == "system").alias("none"))
    records = fx.records(spark, sf).join(turns, F.col("sample_id") == F.col("conv_id")).withColumn(
        "image", F.when(~F.col("none"), F.col("image"))).drop("conv_id", "none")
    return records, _image_folder(spark, sf), _codebook(spark, sf)


@query
def dataset_samples(spark, sf):
    """Whole samples from records and image files, joined by path, and the rejects."""
    samples, rejects = jobs.prepare_dataset(
        *_dataset(spark, sf), labels="mask_pad", pad=False, size=16, method="nearest")
    total = F.aggregate("pixel_values", F.lit(0.0), lambda acc, x: acc + x)
    kept = samples.select(
        "sample_id", F.lit("accepted").alias("reason"), ar.as_text("input_ids").alias("input_ids"),
        F.size("pixel_values").cast("long").alias("n_values"), F.round(total, 3).alias("total"))
    held = rejects.select(
        "sample_id", "reason", F.lit("").alias("input_ids"), F.lit(0).cast("long").alias("n_values"),
        F.lit(0.0).alias("total"))
    return kept.unionByName(held)


@query
def dataset_batches(spark, sf):
    batches, _ = jobs.dataset_batches(*_dataset(spark, sf), labels="mask_pad", size=16, method="nearest")
    rows = lambda name: F.array_join(F.transform(name, ar.as_text), ";")
    return batches.select(
        "batch_id", "n", rows("input_ids").alias("input_ids"), rows("labels").alias("labels"),
        F.array_join(F.transform("pixel_values", lambda v: F.size(v).cast("string")), ";").alias("sizes"))


def make_patch_means():
    """Stands for a frozen encoder: the mean of each colour in four patches."""

    def predict(pixels: np.ndarray) -> np.ndarray:
        patches = pixels.astype(np.float64).reshape(-1, 3, 2, 8, 2, 8).mean(axis=(3, 5))
        return patches.transpose(0, 2, 3, 1).reshape(len(pixels), 12)

    return predict


@query
def image_features(spark, sf):
    raw = images.read_images(spark, _image_folder(spark, sf))
    tensors = images.pixel_values(raw, size=16, method="nearest").filter("readable")
    encoder = inference.predictor(make_patch_means, T.ArrayType(T.DoubleType()), 32, [[768]])
    patches = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("features", i * 3 + 1, F.lit(3))
    )
    encoded = tensors.select(_image_id("path").alias("image_id"), encoder("pixel_values").alias("features"))
    return encoded.select("image_id", F.posexplode(patches).alias("patch_pos", "p")).select(
        "image_id", "patch_pos", _round(F.col("p")[0]).alias("red"),
        _round(F.col("p")[1]).alias("green"), _round(F.col("p")[2]).alias("blue"),
    )


@query
def stream_dialogues(spark, sf):
    landing, out = scratch_dir(spark, "landing"), scratch_dir(spark, "dialogues")
    records.write_records(fx.records(spark, sf), landing)
    stream = streaming.stream_dialogues(spark, landing)
    streaming.drain(stream, out, scratch_dir(spark, "progress"))
    return spark.read.parquet(out)
