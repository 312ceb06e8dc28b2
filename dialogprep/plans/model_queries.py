"""Queries around models: projected states, losses over pieces of logits, generation."""

import numpy as np
from pyspark.sql import functions as F

from dialogprep.functions import arrays as ar
from dialogprep.operators import alignment, chunked, generation, scoring
from dialogprep.plans import fixtures as fx
from dialogprep.plans.oracles import LOGS, ORACLES as WHOLE

QUERIES = {}
ORACLES = {}


def query(sql: str):
    def register(make):
        QUERIES[make.__name__] = make
        ORACLES[make.__name__] = sql
        return make

    return register


# Two normal equations solved by Cramer's rule, for each of the three teacher dimensions.
@query(f"""WITH {LOGS},
states AS (
  SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
         unnest([embedding[3], embedding[4], embedding[5]])::DOUBLE AS t, unnest([1, 2, 3]) AS dim
  FROM embeddings
),
moments AS (
  SELECT var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy,
         covar_pop(x, t) AS xt, covar_pop(y, t) AS yt, var_pop(t) AS tt
  FROM states GROUP BY dim
),
solved AS (
  SELECT tt - (xt * (xt * yy - yt * xy) + yt * (yt * xx - xt * xy)) / (xx * yy - xy * xy) AS mse FROM moments
)
SELECT round((SELECT avg(mse) FROM solved), 6) AS mse,
       round(0.5 * (SELECT sum(ce) / count(ce) FROM terms) + 0.5 * (SELECT avg(mse) FROM solved), 6) AS loss""")
def projected_hidden_state_loss(spark, sf):
    """Student states two wide, the teacher's three wide, with the best linear projector."""
    pairs = fx.table(spark, sf, "embeddings").select(
        F.slice("embedding", 1, 2).alias("student"), F.slice("embedding", 3, 3).alias("teacher"))
    projector = alignment.fit_projector(pairs, "student", "teacher")
    mse = alignment.projected_mse(pairs, "student", "teacher", projector)
    ce = scoring.distillation_loss(fx.student_log(spark, sf), None).select("ce")
    loss = scoring.hidden_state_loss(F.col("ce"), F.col("mse"))
    return ce.withColumn("mse", mse.scalar()).select(F.round("mse", 6).alias("mse"), F.round(loss, 6).alias("loss"))


PIECE = 24


def _pieces(spark, sf):
    student = fx.student_log(spark, sf)
    labels = student.select("sample_id", "pos", "label", F.expr("sample_id div 4").alias("batch_id"))
    return labels, chunked.cut_log(student, "student", PIECE)


def _teacher(spark, sf):
    return fx.teacher_log(spark, sf).withColumn("batch_id", F.expr("sample_id div 4"))


def _rounded(losses, *columns):
    return losses.select(*(F.round(c, 6).alias(c) if c in ("ce", "kl", "loss") else F.col(c) for c in columns))


@query(WHOLE["distill_loss_per_batch"])
def distill_loss_chunked(spark, sf):
    """64 scores in pieces of 24: the same losses as from whole vectors."""
    labels, student = _pieces(spark, sf)
    teacher = chunked.cut_log(fx.teacher_log(spark, sf), "teacher", PIECE)
    losses = chunked.distillation_loss(labels, student, teacher, ["batch_id"], width=PIECE)
    return _rounded(losses, "batch_id", "ce", "kl", "loss", "n_counted", "n_samples")


@query(WHOLE["distill_loss_vocab_mismatch"])
def distill_loss_chunked_mismatch(spark, sf):
    """Every other batch has a teacher of half the width: its last pieces are short or absent."""
    labels, student = _pieces(spark, sf)
    half = F.when(F.col("batch_id") % 2 == 0, F.slice("teacher", 1, 32)).otherwise(F.col("teacher"))
    teacher = chunked.cut_log(_teacher(spark, sf).withColumn("teacher", half), "teacher", PIECE)
    losses = chunked.distillation_loss(labels, student, teacher, ["batch_id"], width=PIECE)
    return _rounded(losses, "batch_id", "loss")


TOY_IDS, TOY_STEPS = 16, 20


def _make_toy():
    """A table of weights for the id that follows the last one; 0 ends an answer."""
    last, following = np.arange(TOY_IDS)[:, None], np.arange(TOY_IDS)[None, :]
    with np.errstate(divide="ignore"):
        table = np.log(((31 * last + 17 * following) % 13).astype(float))
    return lambda ids, lengths: table[ids[np.arange(len(ids)), lengths - 1]]


@query(f"""WITH RECURSIVE weights AS (
  SELECT p AS last, n AS following, pow((31 * p + 17 * n) % 13, 2)::DOUBLE AS w
  FROM (SELECT unnest(range({TOY_IDS})) AS p), (SELECT unnest(range({TOY_IDS})) AS n)
),
steps AS (
  SELECT last, following, sum(w) OVER up - w AS low, sum(w) OVER up AS high,
         sum(w) OVER (PARTITION BY last) AS total
  FROM weights WHERE w > 0 WINDOW up AS (PARTITION BY last ORDER BY following)
),
made AS (
  SELECT conv_id, turn, 0 AS step, turn % {TOY_IDS} AS last FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT m.conv_id, m.turn, m.step + 1, s.following
  FROM (SELECT *, CAST('0x' || substr(sha256('7:' || conv_id || ':' || turn || ':' || step), 1, 8) AS BIGINT)
                  / 4294967296::DOUBLE AS u FROM made WHERE step < {TOY_STEPS} AND (step = 0 OR last <> 0)) m
  JOIN steps s ON s.last = m.last AND u * total >= low AND u * total < high
)
SELECT conv_id, turn, string_agg(last, ',' ORDER BY step) FILTER (step > 0) AS ids
FROM made GROUP BY conv_id, turn""")
def generate_steps(spark, sf):
    """Answers drawn step by step from a table, until the stop id or twenty ids."""
    asked = fx.table(spark, sf, "conversations").where("role = 'user'")
    prompt = F.array((F.col("conv_id") % TOY_IDS).cast("int"), (F.col("turn") % TOY_IDS).cast("int"))
    made = generation.generate(
        prompt, F.concat_ws(":", "conv_id", "turn"), _make_toy, max_new_tokens=TOY_STEPS,
        temperature=0.5, stop_ids=[0], seed=7, pool=32)
    return asked.select("conv_id", "turn", ar.as_text(made).alias("ids"))
