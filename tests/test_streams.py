"""Polls with budgets and change logs against plain loops, restarts in the middle, logs that are sent again."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from parchmill.session import scratch_path
from parchmill.sources import mailbox as B
from parchmill.streaming import changes as C
from parchmill.streaming import ledger as L


def kinds(n, seed, weights):
    return random.Random(seed).choices(B.KINDS, weights, k=n)


BOXES = {"few": kinds(30, 1, (1, 1, 1, 0)), "new": kinds(300, 2, (1, 1, 4, 0)), "seen": ["seen"] * 300, "known": ["known"] * 1500, "slow": kinds(200, 5, (3, 3, 1, 1)), "a/b=c": kinds(40, 6, (1, 2, 1, 0)), "last limited": ["limited"] * 3}


@pytest.fixture(scope="module")
def listing(spark):
    rows = [(o, n - k, kind) for o, ks in BOXES.items() for n in [len(ks)] for k, kind in enumerate(ks)]
    df = spark.createDataFrame(rows, "owner string, at int, kind string").repartition(4).withColumn("id", F.xxhash64("owner", "at"))
    path = scratch_path(spark, "listing")
    B.write_listing(df, path, "owner", "id", ["at"], F.col("kind"))
    return path


def prefix(ks, limit):
    """The walk by its words."""
    new = looked = 0
    for n, kind in enumerate(ks):
        if new == limit or looked == max(5 * limit, limit + 100) or n == max(10 * max(5 * limit, limit + 100), 500) or (kind == "limited" and n):
            return n
        looked += kind != "known"
        new += kind in ("new", "limited")
    return len(ks)


@pytest.mark.parametrize("limit", [1, 3, 40])
def test_budgets(limit):
    assert [B.walked(ks, limit) for ks in BOXES.values()] == [prefix(ks, limit) for ks in BOXES.values()]
    assert B.walked([], limit) == 0


def test_walk_by_windows(spark, listing):
    rows = spark.read.parquet(listing)
    got = {r.owner: r.n for r in B.walk(rows, 3).groupBy("owner").agg(F.count("*").alias("n")).collect()}
    assert got == {o: prefix(ks, 3) for o, ks in BOXES.items()}


def test_polls_go_on_and_survive_a_crash(spark, listing):
    table, cursor, checkpoint = scratch_path(spark, "walked"), scratch_path(spark, "cursor") + "/c.json", scratch_path(spark, "stream")
    at = dict.fromkeys(BOXES, 0)

    def held():
        return {o: sorted(r.position for r in rows) for o, rows in group(L.read_ledger(spark, table, B.SCHEMA).collect()).items()}

    def group(rows):
        out = {}
        for r in rows:
            out.setdefault(r.owner, []).append(r)
        return out

    for turn in range(5):
        if turn == 2:  # the writer fails before anything is kept; the next run walks the same messages
            def broken(batch):
                raise RuntimeError("lost")

            with pytest.raises(Exception, match="lost"):
                B.poll(spark, listing, table, cursor, 3, checkpoint, broken)
        if turn == 3:  # rows are kept, and the driver is lost before the cursor moves
            keep = B.write_cursor
            B.write_cursor = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
            try:
                with pytest.raises(Exception, match="lost"):
                    B.poll(spark, listing, table, cursor, 3, checkpoint)
            finally:
                B.write_cursor = keep
        B.poll(spark, listing, table, cursor, 3, checkpoint)
        for o, ks in BOXES.items():
            at[o] += prefix(ks[at[o] :], 3)
        got = held()
        assert {o: got.get(o, []) for o in BOXES} == {o: list(range(n)) for o, n in at.items()}


def test_a_new_stream_goes_on_at_the_cursor(spark, listing):
    table, cursor = scratch_path(spark, "walked"), scratch_path(spark, "cursor") + "/c.json"
    B.poll(spark, listing, table, cursor, 3)
    B.poll(spark, listing, table, cursor, 3)
    rows = L.read_ledger(spark, table, B.SCHEMA).collect()
    assert len({(r.owner, r.position) for r in rows}) == len(rows)
    B.write_cursor(cursor, {"x": 4})
    B.write_cursor(cursor, {"x": 2})
    assert B.read_cursor(cursor)["x"] == 4


def plain(rows):
    """Final (seq, status, transient, permanent) by message, without expiry."""
    out = {}
    for m, seq, action in sorted(rows, key=lambda r: (r[0], r[1])):
        s = out.setdefault(m, [-1, "open", 0, 0])
        if seq <= s[0]:
            continue
        s[0] = seq
        if s[1] == "open":
            s[2] += action == "transient"
            s[3] += action == "permanent"
            s[1] = "done" if action == "success" else "quarantined" if s[2] >= 5 or s[3] >= 2 else "open"
    return {m: tuple(s) for m, s in out.items()}


def test_states_across_batches(spark):
    r = random.Random(4)
    day = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    log, table, checkpoint = (scratch_path(spark, x) for x in ("log", "states", "stream"))
    schema = "message string, seq long, action string, at timestamp"
    rows = [(f"m{r.randrange(12)}", k, r.choice(["success", "transient", "transient", "transient", "permanent", "news", None]), day + datetime.timedelta(minutes=k)) for k in range(120)]
    parts = [rows[:40] + [(None, 5, "success", day), ("m1", None, "success", day)], rows[40:80] + rows[30:40], rows[80:]]
    run = lambda: C.drain_states(C.message_states(spark.readStream.schema(schema).parquet(log), "message", "seq", "action", "at", "30 days", "1 day"), L.append(table), checkpoint)
    states = lambda: {x.message: (x.seq, x.status, x.transient, x.permanent) for x in C.latest_states(L.read_ledger(spark, table, C.OUT)).collect()}
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(log)
        run()
        assert states() == plain([x[:3] for x in rows[: 40 * (k + 1)]])
    before = L.read_ledger(spark, table, C.OUT).count()
    spark.createDataFrame(rows, schema).write.mode("append").parquet(log)  # all of it again
    run()
    assert L.read_ledger(spark, table, C.OUT).count() == before


def test_open_messages_expire(spark):
    day = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    log, table, checkpoint = (scratch_path(spark, x) for x in ("log", "states", "stream"))
    schema = "message string, seq long, action string, at timestamp"
    rows = [("old", 1, "transient", day), ("over", 2, "success", day), ("young", 3, "transient", day + datetime.timedelta(days=9))]
    spark.createDataFrame(rows, schema).write.parquet(log)
    C.drain_states(C.message_states(spark.readStream.schema(schema).parquet(log), "message", "seq", "action", "at", "5 days"), L.append(table), checkpoint)
    got = {x.message: x.status for x in C.latest_states(L.read_ledger(spark, table, C.OUT)).collect()}
    assert got == {"old": "expired", "over": "done", "young": "open"}
