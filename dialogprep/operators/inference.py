"""User-supplied predictors and tokenizers over columns."""

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogprep import fixed
from dialogprep.functions import arrays as ar
from dialogprep.functions import text as tx
from dialogprep.operators.tokens import as_vocabulary


def predictor(
    make_predict_fn: Callable, return_type, batch_size: int = 64, input_shapes=None
) -> Callable[..., Column]:
    """A column function; the model is made once per worker and fed batches.

    Stands for a frozen encoder, a teacher's logits or a generator alike.
    """
    return predict_batch_udf(
        make_predict_fn, return_type=return_type, batch_size=batch_size,
        input_tensor_shapes=input_shapes,
    )


_made: dict[str, Callable] = {}


def tokenizer(make_encode_fn: Callable, batch_size: int = 1024) -> Callable[[Column], Column]:
    """A column function from text to ids.

    ``make_encode_fn`` is called once in each Python worker and returns a
    function from a list of texts to a list of id lists.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if name not in _made:
            _made[name] = make_encode_fn()
        for texts in batches:
            ids: list = []
            for start in range(0, len(texts), batch_size):
                ids += _made[name]([t or "" for t in texts.iloc[start:start + batch_size]])
            yield pd.Series([list(i) for i in ids], index=texts.index, dtype=object)

    return encode


def tokenized(
    df: DataFrame, encode: Callable[[Column], Column], text: str,
    length: int = fixed.MAX_LENGTH, pad_id: int = fixed.PAD_ID,
) -> DataFrame:
    """Adds ``input_ids`` cut and padded to ``length``, and their ``attention_mask``."""
    cut = df.withColumn("_ids", ar.truncate(encode(F.col(text)), length))
    return cut.withColumns({
        "input_ids": ar.pad_right(F.col("_ids"), length, pad_id),
        "attention_mask": ar.attention_mask(F.col("_ids"), length),
    }).drop("_ids")


def evaluate(
    rows: DataFrame, vocabulary, predict: Callable[..., Column],
    features: str, prompt: str = "prompt", length: int = fixed.MAX_LENGTH,
    key: tuple[str, ...] = ("conv_id", "turn"),
) -> DataFrame:
    """Adds ``response``: prompt, ids, prediction from (features, ids, count), text.

    ``key`` identifies a row; only a vocabulary too large to share needs it.
    """
    handle = as_vocabulary(vocabulary)
    words = ar.truncate(tx.tokens(tx.generation_prompt(F.col(prompt))), length)
    asked = handle.encode(rows, list(key), words, "_ids")
    ready = asked.select(
        "*", ar.pad_right(F.col("_ids"), length, fixed.PAD_ID).alias("_padded"),
        F.size("_ids").alias("_count"),
    )
    generated = ready.withColumn(
        "generated_ids", predict(F.col(features), F.col("_padded"), F.col("_count")).cast("array<int>")
    )
    answered = handle.decode(generated, list(key), "generated_ids", "response")
    return answered.drop("_ids", "_padded", "_count")
