"""Conversations as a stream: what each turn sees of those before it, in keyed state with timers.

For every conversation the state keeps the last turns, the network and the order in force, and turns
that came too early: a turn waits until all before it are there, or until `patience` has passed
since it came, when those that are missing are given up. A conversation without a new turn for
`idle` is forgotten; turns below the last one that was given out come too late and are dropped.

Each turn gives one row, as the window operators of `operators.conversation` do over a table: the
history of the last k turns, the network in force, and the order of the same network.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROWS = "conv_id long, turn long, history string, ctx_network string, ctx_order string"
#: How network and order numbers are written.
NETWORK, ORDER = re.compile(r"\b(\d{10})\b", re.ASCII), re.compile(r"([0-9]{6}/[A-Za-z-]+/\d{4})", re.ASCII)
_TURN = StructType([StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])
_CONTEXT = StructType([StructField("next", LongType()), StructField("network", StringType()), StructField("order", StringType())])
_EARLY = StructType([StructField("turn", LongType())])
_SAID = StructType([StructField("role", StringType()), StructField("text", StringType()), StructField("until", LongType())])


class Conversations(StatefulProcessor):
    def __init__(self, k: int, patience: int, idle: int) -> None:
        self.k, self.patience, self.idle = k, patience, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.context = handle.getValueState("context", _CONTEXT)
        self.recent = handle.getListState("recent", _TURN)
        self.early = handle.getMapState("early", _EARLY, _SAID)
        self.timer = handle.getValueState("timer", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        first = self.context.get()[0] if self.context.exists() else 0
        for batch in rows:
            for turn, role, text in zip(batch["turn"], batch["role"], batch["text"], strict=True):
                if turn is not None and not pd.isna(turn) and turn >= first:
                    self.early.updateValue((int(turn),), (role, text, now + self.patience))
        yield from self._ready(int(key[0]) if key[0] else None, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if any(True for _ in self.early.keys()):
            yield from self._ready(int(key[0]) if key[0] else None, now)
        else:
            self.context.clear()
            self.recent.clear()
            self.timer.clear()

    def _ready(self, conv: int | None, now: int) -> Iterator[pd.DataFrame]:
        """Turns that need wait no longer, in order; then the timer for what still waits, or for the end."""
        due, network, order = self.context.get() if self.context.exists() else (0, None, None)
        recent = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        waiting = {k[0]: v for k, v in self.early.iterator()}
        out = []
        while waiting:
            least = min(waiting)
            if least > due and all(v[2] > now for v in waiting.values()):
                break
            role, text, _ = waiting.pop(least)
            self.early.removeKey((least,))
            due = least + 1
            recent = [*recent, (least, role, text)][-self.k :]
            said = NETWORK.search(text or "")
            if said and said[1] != network:
                network, order = said[1], None
            named = ORDER.search(text or "")
            order = named[1] if named else order
            out.append((conv, least, "\n".join(f"{r}: {t or ''}" for _, r, t in recent if r is not None), network, order))
        self.context.update((due, network, order))
        if recent:
            self.recent.put(recent)
        at = min((v[2] for v in waiting.values()), default=now + self.idle)
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "history", "ctx_network", "ctx_order"]).astype({"conv_id": "Int64"})

    def close(self) -> None:
        pass


def conversation_context(turns: DataFrame, k: int = 5, patience_ms: int = 60_000, idle_ms: int = 3_600_000) -> DataFrame:
    """A row for each turn of a stream of (conv_id, turn, role, text), in ROWS. Turns count from 0.

    Needs the RocksDB state store (see `BOUNDED`). Null conversations are one conversation; null
    turns give no row.
    """
    slim = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "turn", "role", "text")  # state has no null keys
    return slim.groupBy("key").transformWithStateInPandas(statefulProcessor=Conversations(k, patience_ms, idle_ms), outputStructType=ROWS, outputMode="Append", timeMode="ProcessingTime")


#: Settings of a bounded run: state in RocksDB, which keyed state with timers needs, and no batches
#: without rows, which timers would ask for one after another.
BOUNDED = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def write_available(made: DataFrame, folder: str, checkpoint: str, partitions: int | None = None) -> None:
    """Append what a stream of `conversation_context` gives for all input there is to Parquet files, then end.

    Timers that are due fire in the next batch with rows. partitions: state partitions of a new
    checkpoint. The session's settings are as before afterwards.
    """
    conf = made.sparkSession.conf
    wanted = BOUNDED | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        run = made.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
        finally:
            run.stop()
    finally:
        for k, v in before.items():
            conf.set(k, v)
