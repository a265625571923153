"""Intake of messages: cursors, frontiers, attempts and quarantine, interrupted work, fingerprints still to make.

All of these are rules over tables; `streaming.ledger` applies the first ones to the batches of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSIENT_LIMIT, PERMANENT_LIMIT = 5, 2
INLINE_FINGERPRINTS = 16


def change_token(rows: DataFrame, at: str, size: Column) -> DataFrame:
    """One row (latest, rows, bytes) that differs whenever rows came, went or changed. An empty table has a null and zeros."""
    return rows.agg(F.max(at).alias("latest"), F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def lowered_cursors(cursors: DataFrame, batch: DataFrame, owner: str, at: str, drained: DataFrame) -> DataFrame:
    """(owner, cursor): cursors only move down, to the earliest positive time of a batch; owners whose backlog is drained start
    afresh and have none. cursors: (owner, cursor)."""
    seen = cursors.select(owner, "cursor").unionByName(batch.select(owner, F.col(at).cast("long").alias("cursor")))
    low = seen.where("cursor > 0").groupBy(owner).agg(F.min("cursor").alias("cursor"))
    return low.join(drained.select(owner), owner, "left_anti")


def frontiers(history: DataFrame, owner: str, seq: str, value: str, every: int) -> DataFrame:
    """(owner, frontier, sweeps): the last history id of each owner, which may move either way, and how many full sweeps its
    scans have had, one each `every` scans. Null ids leave the frontier as it was."""
    g = history.groupBy(owner).agg(F.max(F.when(F.col(value).isNotNull(), F.struct(seq, value))).alias("m"), F.count("*").alias("n"))
    return g.select(owner, F.col(f"m.{value}").alias("frontier"), F.expr(f"n div {every}").alias("sweeps"))


def unprocessed(batch: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The messages of a batch that the ledger does not hold, each once; null keys are nobody's and never pass."""
    known = batch.dropna(subset=keys).dropDuplicates(keys)
    return known.join(ledger.select(*keys), keys, "left_anti")


def quarantine(attempts: DataFrame, message: str, at: str, kind: str, requeued: DataFrame) -> DataFrame:
    """(message, transient, permanent, quarantined): failed attempts since the message was last requeued. Attempts that cost
    nothing (other kinds) do not count; `requeued` has (message, at)."""
    last = requeued.groupBy(message).agg(F.max(at).alias("_since"))
    open_ = attempts.join(last, message, "left").where(F.col("_since").isNull() | (F.col(at) > F.col("_since")))
    g = open_.groupBy(message).agg(F.count_if(F.col(kind) == "transient").alias("transient"), F.count_if(F.col(kind) == "permanent").alias("permanent"))
    return g.withColumn("quarantined", (F.col("transient") >= TRANSIENT_LIMIT) | (F.col("permanent") >= PERMANENT_LIMIT))


def reconciled(rows: DataFrame, status: str, started: str, has_result: Column, now: Column, grace: int) -> DataFrame:
    """Reviews in progress for longer than a grace are over: completed if their result is there, else interrupted. Nothing is
    started again, other rows stay, and a second run changes nothing."""
    over = (F.col(status) == "in_progress") & (F.col(started) < now - F.make_dt_interval(secs=F.lit(grace)))
    return rows.withColumn(status, F.when(over, F.when(has_result, "completed").otherwise("interrupted")).otherwise(F.col(status)))


def shown_status(status: Column, started: Column, now: Column, ttl: int) -> Column:
    """The status to show: work in progress beyond its time is stalled; an unknown start is never expired."""
    return F.when((status == "in_progress") & F.coalesce(started < now - F.make_dt_interval(secs=F.lit(ttl)), F.lit(False)), "stalled").otherwise(status)


def backfill(docs: DataFrame, prints: DataFrame, ident: str, inline: int = INLINE_FINGERPRINTS) -> DataFrame:
    """(ident, inline): documents without a fingerprint; the first few by id are made at once, the others later."""
    todo = docs.select(ident).join(prints.select(ident), ident, "left_anti")
    now = todo.orderBy(ident).limit(inline).select(ident, F.lit(True).alias("inline"))
    return todo.join(now, ident, "left").select(ident, F.coalesce("inline", F.lit(False)).alias("inline"))
