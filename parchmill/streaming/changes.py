"""A log of changes to messages, folded into one state a message that lives across batches.

Each message's state is a value in Spark's state store: how far its log is read, what has become of it, and its failed attempts. Rows
that were read before (a log that is sent again) change nothing. A message is done with its first success, and quarantined
by too many failures of either kind; from then on nothing changes it. A message without news for longer than `ttl` expires:
its state goes, and if it was still open, that is its last row. Time is the log's own, by a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parchmill.operators.intake import PERMANENT_LIMIT, TRANSIENT_LIMIT

STATE = "seq long, status string, transient int, permanent int, seen long"
OUT = "message string, seq long, status string, transient int, permanent int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def folded(state: tuple[int, str, int, int] | None, rows: list[tuple[int, str]]) -> tuple[int, str, int, int]:
    """(seq, status, transient, permanent) after the rows (seq, action), in order of seq. Actions other than success,
    transient and permanent are news and nothing else; of rows with one seq the first by action counts."""
    seq, status, transient, permanent = state or (-1, "open", 0, 0)
    for at, action in sorted(rows):
        if at <= seq:
            continue
        seq = at
        if status == "open":
            transient, permanent = transient + (action == "transient"), permanent + (action == "permanent")
            if action == "success":
                status = "done"
            elif transient >= TRANSIENT_LIMIT or permanent >= PERMANENT_LIMIT:
                status = "quarantined"
    return seq, status, transient, permanent


class Message(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("message", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        new, seen = (tuple(old[:4]), old[4]) if old else (None, 0)
        for frame in rows:
            frame = frame.dropna(subset=["seq"])
            new = folded(new, list(zip(frame["seq"].astype(int), frame["action"].fillna(""), strict=True)))
            seen = max([seen, *(int(t.timestamp() * 1000) for t in frame["at"].dropna())])
        if new is not None and (old is None or new != tuple(old[:4])):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(seen + self.ttl_ms)
            self.state.update((*new, seen))
            yield pd.DataFrame({"message": [key[0]], "seq": [new[0]], "status": [new[1]], "transient": [new[2]], "permanent": [new[3]]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        seq, status, transient, permanent, _ = self.state.get()
        self.state.clear()
        if status == "open":
            yield pd.DataFrame({"message": [key[0]], "seq": [seq], "status": ["expired"], "transient": [transient], "permanent": [permanent]})

    def close(self) -> None:
        pass


def message_states(log: DataFrame, message: str, seq: str, action: str, at: str, ttl: str, delay: str = "0 seconds") -> DataFrame:
    """A stream of OUT rows, one each time that a message's state changes in a batch. log: a stream. Rows without a message or a seq are
    left out. The session's state store must be the one that PROVIDER names."""
    log.sparkSession.conf.set(PROVIDER_KEY, PROVIDER)
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = log.select(F.col(message).cast("string").alias("message"), F.col(seq).cast("long").alias("seq"), F.col(action).alias("action"), F.col(at).cast("timestamp").alias("at"))
    keyed = rows.where("message is not null and seq is not null").withWatermark("at", delay).groupBy("message")
    return keyed.transformWithStateInPandas(Message(ttl_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def drain_states(states: DataFrame, write: Callable[[DataFrame, int, str], None], checkpoint: str) -> None:
    """Run a stream of `message_states` over all that is there now. `write` is one of `ledger`'s batch writers."""
    from parchmill.streaming.ledger import stream_name

    name = stream_name(checkpoint)
    states.writeStream.outputMode("update").foreachBatch(lambda batch, number: write(batch, number, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_states(rows: DataFrame) -> DataFrame:
    """The last of the rows that `message_states` gave for each message."""
    last = F.max(F.struct("seq", (F.col("status") == "expired").alias("_over"), "status", "transient", "permanent"))
    return rows.groupBy("message").agg(last.alias("_m")).select("message", "_m.seq", "_m.status", "_m.transient", "_m.permanent")
