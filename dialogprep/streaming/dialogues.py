"""Dialogues whose turns arrive one by one, in any order.

Turns are kept by dialogue in keyed state until the turn that is marked as the
last is there and none before it is missing; then the dialogue leaves as one
record. A timer sends out what has come of a dialogue that stays incomplete.
What comes for a dialogue that has left is reported as late, a turn number that
is already held as repeated, and a turn without key or number as no_key; nothing
is dropped without a row.

State holds each turn on its own, so a turn that arrives does not rewrite the
others. Of a dialogue that has left only a flag stays, for ``keep_ms``.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from dialogprep.operators.render import ASSISTANT, USER
from dialogprep.streaming.records import drain

COMPLETE, TIMEOUT, LATE, REPEATED, NO_KEY = "complete", "timeout", "late", "repeated", "no_key"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SCHEMA = (
    "conv_id long, status string, n_turns int, "
    "conversations array<struct<from:string,value:string>>"
)
HOUR_MS = 3_600_000


def drain_dialogues(stream: DataFrame, out: str, progress: str) -> None:
    """Processes all turns present, then stops; ``progress`` makes it exactly-once.

    Timers run out in batches that bring turns: batches without any would never
    end, since a timer may always follow. The stream takes the settings it starts with.
    """
    conf = stream.sparkSession.conf
    settings = {
        "spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER,
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {name: conf.get(name, None) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        drain(stream, out, progress)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


class Collector(StatefulProcessor):
    """The turns of one dialogue until it is whole, or ``wait_ms`` after its last turn came."""

    def __init__(self, wait_ms: int, keep_ms: int, names: dict[str, str]):
        self.wait_ms, self.keep_ms, self.names = wait_ms, keep_ms, names

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "turn long", "role string, text string")
        # Turns held, number of the last turn or -1, time of the timer.
        self.known = handle.getValueState("known", "n long, last long, timer long")
        self.left = handle.getValueState("left", "yes boolean", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        left = self.left.exists()
        n, last, timer = self.known.get() if self.known.exists() else (0, -1, 0)
        odd = []
        for frame in rows:
            # A batch comes in no fixed order; by number the outcome does not depend on it.
            for turn, role, text, is_last in frame[["turn", "role", "text", "is_last"]].itertuples(index=False):
                if left or self.turns.containsKey((int(turn),)):
                    odd.append((LATE if left else REPEATED, role, text))
                    continue
                self.turns.updateValue((int(turn),), (_text(role), _text(text)))
                n += 1
                if is_last is not None and not pd.isna(is_last) and bool(is_last):
                    last = max(last, int(turn))
        if odd:
            yield _frame(key, [(status, 1, [self._turn(role, text)]) for status, role, text in odd])
        if left:
            return
        if last >= 0 and n == last + 1:
            yield self._leave(key, COMPLETE, timer)
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        if timer:
            self.handle.deleteTimer(timer)
        self.known.update((n, last, now + self.wait_ms))
        self.handle.registerTimer(now + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.known.exists():
            yield self._leave(key, TIMEOUT, 0)

    def _turn(self, role, text) -> dict:
        return {"from": self.names.get(role, _text(role)), "value": _text(text)}

    def _leave(self, key, status: str, timer: int) -> pd.DataFrame:
        held = sorted((number, *value) for (number,), value in self.turns.iterator())
        if timer:
            self.handle.deleteTimer(timer)
        self.turns.clear()
        self.known.clear()
        self.left.update((True,))
        return _frame(key, [(status, len(held), [self._turn(role, text) for _, role, text in held])])

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return None if value is None or not isinstance(value, str) else value


def _frame(key, rows: list[tuple]) -> pd.DataFrame:
    status, n, turns = zip(*rows)
    return pd.DataFrame({"conv_id": [key[0]] * len(rows), "status": status, "n_turns": n, "conversations": turns})


def collect_dialogues(
    turns: DataFrame, wait_ms: int = HOUR_MS, keep_ms: int = 24 * HOUR_MS, user=USER, assistant=ASSISTANT
) -> DataFrame:
    """(conv_id, status, n_turns, conversations) of a stream (conv_id, turn, role, text, is_last).

    Turn numbers begin with 0; ``is_last`` is true for the turn with the highest.
    A stream that runs on needs the state store in ``STATE_PROVIDER``.
    """
    keyed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    names = {user: "human", assistant: "gpt"}
    collector = Collector(wait_ms, keep_ms, names)
    whole = turns.where(keyed).groupBy("conv_id").transformWithStateInPandas(
        collector, SCHEMA, "append", "ProcessingTime")
    who = F.when(F.col("role") == user, "human").when(F.col("role") == assistant, "gpt").otherwise(F.col("role"))
    keyless = turns.where(~keyed).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.lit(NO_KEY).alias("status"), F.lit(1).alias("n_turns"),
        F.array(F.struct(who.alias("from"), F.col("text").alias("value"))).alias("conversations"))
    return whole.unionByName(keyless)
