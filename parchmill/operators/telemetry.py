"""Counters, gauges, costs and health over a table of metric events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.functions.scalar import rate, usd


def metrics(events: DataFrame, name: str, value: str, at: str, tie: str) -> DataFrame:
    """Per name the sum (counter), the last value (gauge) and the greatest (high water)."""
    return events.groupBy(name).agg(F.count("*").alias("n"), F.sum(value).alias("counter"), F.max_by(value, F.struct(at, tie)).alias("gauge"), F.max(value).alias("high_water"))


def ai_costs(events: DataFrame, feature: str, micro: str, tokens: str) -> DataFrame:
    """Per feature dollars, tokens and share of all dollars, dearest first. Money is summed as whole micro-dollars."""
    per = events.groupBy(feature).agg(F.sum(micro).alias("micro"), F.sum(tokens).alias("tokens"))
    total = events.agg(F.sum(micro).alias("all_micro"))
    return per.crossJoin(F.broadcast(total)).select(feature, usd(F.col("micro")).alias("usd"), "tokens", F.round(rate(F.col("micro"), F.col("all_micro")), 6).alias("share")).orderBy(F.desc("usd"), feature)


def health(events: DataFrame, kind: str, failures: list[str], attempts: list[str], warn: float = 0.05, bad: float = 0.2) -> DataFrame:
    """The failure rate (0 without attempts) and its severity."""
    n = events.agg(F.count_if(F.col(kind).isin(*failures)).alias("failures"), F.count_if(F.col(kind).isin(*attempts)).alias("attempts"))
    r = rate(F.col("failures"), F.col("attempts"))
    return n.select("failures", "attempts", F.round(r, 6).alias("rate"), F.when(r >= bad, "critical").when(r >= warn, "warning").otherwise("ok").alias("severity"))
