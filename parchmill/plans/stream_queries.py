"""Polls with budgets and change logs on the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchmill.session import read_table, scratch_path
from parchmill.sources import mailbox as B
from parchmill.streaming import changes as C
from parchmill.streaming import ledger as L

QUERIES: dict = {}
SQL: dict[str, str] = {}

LIMIT = 4
TTL = "5 days"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


NEW, LOOKED, PAGED = B.budgets(LIMIT)
POLL = f"""SELECT *, row_number() OVER o AS k, coalesce(sum(CASE WHEN kind IN ('new', 'limited') THEN 1 ELSE 0 END) OVER b, 0) AS had, coalesce(sum(CASE WHEN kind <> 'known' THEN 1 ELSE 0 END) OVER b, 0) AS looked FROM %s WINDOW o AS (PARTITION BY owner ORDER BY position), b AS (PARTITION BY owner ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
OPEN = f"had < {NEW} AND looked < {LOOKED} AND k <= {PAGED} QUALIFY max(CASE WHEN kind = 'limited' AND k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY position) = 0"
PAGED_SQL = f"""WITH m AS (SELECT CAST(user_id % 7 AS VARCHAR) AS owner, event_id AS id, CASE WHEN user_id % 7 = 0 THEN CASE WHEN event_id % 20 = 0 THEN 'seen' ELSE 'known' END WHEN user_id % 7 = 1 THEN 'seen' WHEN user_id % 7 = 5 AND event_id % 50 = 5 THEN 'limited'
  WHEN event_id % 10 < user_id % 7 THEN 'new' WHEN event_id % 3 = 0 THEN 'known' ELSE 'seen' END AS kind, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, event_id DESC) - 1 AS position FROM events),
a AS ({POLL % 'm'}), first AS (SELECT * FROM a WHERE {OPEN}), rest AS (SELECT owner, id, kind, position FROM m WHERE (owner, position) NOT IN (SELECT (owner, position) FROM first)),
b AS ({POLL % 'rest'}), second AS (SELECT * FROM b WHERE {OPEN})
SELECT 1 AS poll, owner, position, id, kind FROM first UNION ALL SELECT 2, owner, position, id, kind FROM second"""


@query("i1_paged_scan", PAGED_SQL)
def i1(spark, d):
    listing, table, cursor = (scratch_path(spark, x) for x in ("listing", "walked", "cursor"))
    box, e = F.col("user_id") % 7, F.col("event_id")
    kind = F.when(box == 0, F.when(e % 20 == 0, "seen").otherwise("known")).when(box == 1, "seen").when((box == 5) & (e % 50 == 5), "limited").when(e % 10 < box, "new").when(e % 3 == 0, "known").otherwise("seen")
    events = read_table(spark, d, "events").withColumn("owner", box)
    B.write_listing(events, listing, "owner", "event_id", ["ts", "event_id"], kind)
    for number in (1, 2):  # the second goes on where the first one stopped
        B.poll(spark, listing, table, f"{cursor}/cursor.json", LIMIT, then=lambda batch, n=number: batch.withColumn("poll", F.lit(n)))
    return L.read_ledger(spark, table, B.SCHEMA + ", poll int").drop("mailbox")


CHANGES_SQL = f"""WITH e AS (SELECT event_id % 997 AS m, event_id AS seq, ts, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'permanent' WHEN 'click' THEN 'transient' ELSE 'news' END AS action FROM events),
c AS (SELECT *, count(*) FILTER (WHERE action = 'transient') OVER w AS t, count(*) FILTER (WHERE action = 'permanent') OVER w AS p FROM e WINDOW w AS (PARTITION BY m ORDER BY seq)),
o AS (SELECT m, min(seq) FILTER (WHERE action = 'success' OR t >= 5 OR p >= 2) AS over, max(seq) AS seq, max(ts) AS seen FROM c GROUP BY 1),
s AS (SELECT o.m, o.seq, o.over, seen, max(t) AS t, max(p) AS p, bool_or(c.seq = o.over AND action = 'success') AS done FROM o JOIN c ON c.m = o.m AND c.seq <= coalesce(o.over, o.seq) GROUP BY ALL)
SELECT CAST(m AS VARCHAR) AS message, seq, CASE WHEN over IS NULL THEN CASE WHEN seen + INTERVAL {TTL} <= (SELECT max(ts) FROM e) THEN 'expired' ELSE 'open' END WHEN done THEN 'done' ELSE 'quarantined' END AS status, CAST(t AS INT) AS transient, CAST(p AS INT) AS permanent FROM s"""


@query("i2_change_log", CHANGES_SQL)
def i2(spark, d):
    log, table, checkpoint = (scratch_path(spark, x) for x in ("log", "states", "stream"))
    action = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "permanent").when(F.col("event_type") == "click", "transient").otherwise("news")
    rows = read_table(spark, d, "events").select((F.col("event_id") % 997).alias("message"), F.col("event_id").alias("seq"), action.alias("action"), F.col("ts").cast("timestamp").alias("at"))
    for _ in range(2):  # the log is sent twice
        rows.write.mode("append").parquet(log)
        stream = spark.readStream.schema(rows.schema).parquet(log)
        C.drain_states(C.message_states(stream, "message", "seq", "action", "at", TTL), L.append(table), checkpoint)
    return C.latest_states(L.read_ledger(spark, table, C.OUT))
