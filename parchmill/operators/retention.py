"""Selections that look along an order: retention, rotation, caps, rate windows. All but the global ceiling are
windows over one owner or key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.session import settled, shuffle_width


def oldest_first(rows: DataFrame, owner: str, order: list[str], predicate: Column, confirmed: DataFrame, ident: str, limit: int = 200) -> DataFrame:
    """The first `limit` rows of every owner that fulfil the predicate and are confirmed."""
    chosen = rows.where(predicate).join(confirmed, ident, "left_semi")
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("rank") <= limit)


def pruned(rows: DataFrame, owner: str, closed: Column, order: list[str], limit: int) -> DataFrame:
    """What retention removes: of an owner above the limit the oldest closed rows, as many as it is over; active rows stay
    even if that leaves it above."""
    total = rows.groupBy(owner).agg(F.count("*").alias("_total")).where(F.col("_total") > limit)
    able = rows.where(closed).join(total, owner)
    return able.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("_r") <= F.col("_total") - limit).drop("_r", "_total")


def over_ceiling(rows: DataFrame, closed: Column, order: list[str], ceiling: int) -> DataFrame:
    """The global ceiling: the oldest closed rows of all owners, as many as there are rows above it. Rows are put in ranges of
    the order and counted; whole ranges go until one must be cut, and only that one is ranked."""
    over = rows.count() - ceiling
    able = rows.where(closed)
    ranged = settled(able.repartitionByRange(shuffle_width(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", (F.lit(over) - before).alias("_due"), "_n").where("_due > 0")  # a row a range
    whole = ranged.join(F.broadcast(offsets.where("_n <= _due").select("_range")), "_range", "left_semi")
    cut = ranged.join(F.broadcast(offsets.where("_n > _due").select("_range", "_due")), "_range")
    part = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).where(F.col("_r") <= F.col("_due"))
    return whole.select(*rows.columns).unionByName(part.select(*rows.columns))


def running(rows: DataFrame, owner: str, order: list[str], size: str) -> DataFrame:
    """rows with _left and _rank, bytes and rows from each one on to the youngest of its owner. Rows are put in ranges of the
    order; a range's totals behind it come from one row a (range, owner), and windows run inside these only, so an owner
    with a great part of all rows is no single task."""
    ranged = settled(rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(owner, "_range").agg(F.sum(size).alias("_s"), F.count("*").alias("_n"))
    later = Window.partitionBy(owner).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    behind = totals.select(owner, "_range", F.coalesce(F.sum("_s").over(later), F.lit(0)).alias("_s"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_n"))
    inside = Window.partitionBy(owner, "_range").orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = ranged.withColumn("_own", F.sum(size).over(inside)).withColumn("_k", F.count("*").over(inside)).alias("a")
    both = own.join(behind.alias("b"), F.col(f"a.{owner}").eqNullSafe(F.col(f"b.{owner}")) & (F.col("a._range") == F.col("b._range")))
    return both.select(*[F.col(f"a.{c}") for c in rows.columns], (F.coalesce("_own", F.lit(0)) + F.col("_s")).alias("_left"), (F.col("_k") + F.col("_n")).alias("_rank"))


def rotated(files: DataFrame, owner: str, order: list[str], size: str, target_bytes: int, keep_newest: int) -> DataFrame:
    """What rotation removes: from the oldest on while what is left exceeds the target, never the newest few. The bytes
    left after a row's removal are the running sum of the younger ones, so removal stops at the first survivor. `order` names
    a row: equal ones have no order of their own."""
    out = running(files, owner, order, size)
    return out.where((F.col("_left") > target_bytes) & (F.col("_rank") > keep_newest)).select(*files.columns)


def most_recent(rows: DataFrame, owner: str, order: list[str], keep: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= keep).drop("_r")


def round_robin(owners: DataFrame, owner: str, offset: int) -> DataFrame:
    """Owners in their order, begun at another one each poll. The owners are few: one row an account."""
    w = Window.orderBy(owner)
    listed = owners.select(owner, (F.row_number().over(w) - 1).alias("_k"))
    n = owners.count()
    return listed.select(owner, F.pmod(F.col("_k") - offset, F.lit(max(1, n))).alias("turn"))


def sequence_numbers(rows: DataFrame, owner: str, order: list[str]) -> DataFrame:
    return rows.withColumn("sequence", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))


def rate_limited(hits: DataFrame, client: str, bucket: str, at: str, ident: str, limit: int, seconds: int) -> DataFrame:
    """Which hits a fixed window refuses. The window of a client and bucket starts at its first hit and the next one at
    the first hit after its end, so it follows the data and not the clock: one pass over each client's hits, which carries
    two numbers from row to row. Rows come sorted by the shuffle and pass in batches, so a busy client needs no memory."""
    kinds = dict(hits.dtypes)
    rows = hits.select(F.col(client).cast("string").alias("client"), F.col(bucket).cast("string").alias("bucket"), F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), F.col(ident).alias("id"))
    dealt = rows.repartition(F.col("client"), F.col("bucket")).sortWithinPartitions("client", "bucket", "ms", "id")

    def judge(frames):
        last, start, n = None, 0, 0
        for f in frames:
            refused, wait = [], []
            for key, ms in zip(zip(f["client"], f["bucket"], strict=True), f["ms"], strict=True):
                if key != last or ms >= start + 1000 * seconds:
                    last, start, n = key, ms, 0
                n += 1
                refused.append(n > limit)
                wait.append((start + 1000 * seconds - ms + 999) // 1000 if n > limit else 0)
            yield pd.DataFrame({"client": f["client"], "bucket": f["bucket"], "id": f["id"], "refused": refused, "retry_after": wait})

    return dealt.mapInPandas(judge, f"client string, bucket string, id {kinds[ident]}, refused boolean, retry_after long")
