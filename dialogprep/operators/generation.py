"""Stepwise generation around a user's next-token function.

Rows are answered in pools of a fixed size; a row that meets a stop id or the
limit leaves and the next one takes its place. Which token a row draws depends on
the seed, its key, its step and the scores alone, so results do not depend on
pools, batches or partitions as long as the function scores each row by itself.
"""

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogprep import fixed
from dialogprep.functions import arrays as ar
from dialogprep.functions import text as tx
from dialogprep.operators.tokens import as_vocabulary

MAX_NEW_TOKENS, TEMPERATURE = 100, 0.7


def uniform(seed: int, key: str, step: int) -> float:
    """A number from 0 to below 1 for a row and step."""
    return int(hashlib.sha256(f"{seed}:{key}:{step}".encode()).hexdigest()[:8], 16) / 2**32


def pick(scores: np.ndarray, temperature: float, draws: np.ndarray) -> np.ndarray:
    """The token of each row of scores: the first whose summed probability exceeds the draw.

    At temperature 0 it is the highest, ties to the smallest id. A score of minus
    infinity is never drawn.
    """
    if temperature == 0:
        return scores.argmax(axis=1)
    warm = scores / temperature
    peaks = warm.max(axis=1, keepdims=True)
    if not np.isfinite(peaks).all():
        raise ValueError("a row of scores has no finite maximum")
    sums = np.cumsum(np.exp(warm - peaks), axis=1)
    found = (sums > (draws * sums[:, -1])[:, None])
    return found.argmax(axis=1)


class _Pool:
    """Rows that are being answered."""

    def __init__(self, prompts: list[np.ndarray], keys: list[str], features: list[list]):
        self.ids = [list(p) for p in prompts]
        self.begun = [len(p) for p in prompts]
        self.keys, self.features = keys, features

    def answer(self, step: Callable, size: int, most: int, temperature: float, stop: frozenset, seed: int):
        waiting = iter(range(len(self.ids)) if most > 0 else ())
        active: list[int] = []
        while True:
            active += [i for _, i in zip(range(size - len(active)), waiting)]
            if not active:
                break
            scores = np.asarray(step(*self._padded(active)), np.float64)
            draws = np.array([
                uniform(seed, self.keys[i], len(self.ids[i]) - self.begun[i]) for i in active])
            going = []
            for i, token in zip(active, pick(scores, temperature, draws).tolist()):
                self.ids[i].append(token)
                if token not in stop and len(self.ids[i]) - self.begun[i] < most:
                    going.append(i)
            active = going
        return [ids[n:] for ids, n in zip(self.ids, self.begun)]

    def _padded(self, active: list[int]) -> list:
        lengths = np.array([len(self.ids[i]) for i in active], np.int32)
        padded = np.full((len(active), max(1, lengths.max())), fixed.PAD_ID, np.int32)
        for row, i in enumerate(active):
            padded[row, :lengths[row]] = self.ids[i]
        return [padded, lengths, *([column[i] for i in active] for column in self.features)]


def generate(
    ids: Column, key: Column, make_step: Callable, features: Sequence[Column] = (),
    max_new_tokens: int = MAX_NEW_TOKENS, temperature: float = TEMPERATURE,
    stop_ids: Sequence[int] = (fixed.PAD_ID,), seed: int = 0, pool: int = 64,
) -> Column:
    """Column of generated ids, the stop id included, for prompts ``ids``.

    ``make_step`` is called once for each task and returns a function from
    (ids, lengths, one list for each feature) to scores of shape (rows, vocabulary).
    Ids are padded on the right. A null prompt has a null answer; an empty one is
    handed on with length 0. ``key`` tells rows apart; rows with equal keys draw alike.
    """
    stop = frozenset(stop_ids)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        step = make_step()
        for prompts, keys, *rest in batches:
            present = pa.array(prompts.is_valid())
            kept = [c.filter(present).to_pylist() for c in (prompts, keys, *rest)]
            answers = iter(_Pool(kept[0], kept[1], kept[2:]).answer(
                step, pool, max_new_tokens, temperature, stop, seed))
            yield pa.array([next(answers) if ok else None for ok in present.to_pylist()], pa.list_(pa.int32()))

    return run(ids, F.coalesce(key.cast("string"), F.lit("")), *features)


def answers(
    rows: DataFrame, vocabulary, make_step: Callable, prompt: str = "prompt",
    key: Sequence[str] = ("conv_id", "turn"), features: Sequence[Column] = (),
    length: int = fixed.MAX_LENGTH, **options,
) -> DataFrame:
    """Adds ``generated_ids`` and ``response``: template, ids, stepwise generation, text."""
    handle = as_vocabulary(vocabulary)
    words = ar.truncate(tx.tokens(tx.generation_prompt(F.col(prompt))), length)
    asked = handle.encode(rows, list(key), words, "_ids")
    name = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key))
    made = asked.withColumn("generated_ids", generate(F.col("_ids"), name, make_step, features, **options))
    return handle.decode(made, list(key), "generated_ids", "response").drop("_ids")
