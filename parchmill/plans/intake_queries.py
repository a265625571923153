"""Intake, stores and comparisons of texts on the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.functions import scalar as S
from parchmill.functions import text as X
from parchmill.operators import comparison as M
from parchmill.operators import corpus, dedup
from parchmill.operators import intake as I
from parchmill.plans.text_queries import DUCK_BITS, spread
from parchmill.session import read_table, scratch_path
from parchmill.sources.json_files import write_json_atomically
from parchmill.streaming import ledger as L

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def stream(spark, d, name) -> DataFrame:
    """A table, which may be one file, as a stream of its files; a stream's path must be a folder or a pattern."""
    return spark.readStream.schema(read_table(spark, d, name).schema).parquet(f"{d.rstrip('/')}/{name}.parque[t]")


@query("s4_change_token", "SELECT max(o_orderdate) AS latest, count(*) AS rows, CAST(sum(length(o_orderpriority)) AS BIGINT) AS bytes FROM orders")
def s4(spark, d):
    return I.change_token(read_table(spark, d, "orders"), "o_orderdate", F.length("o_orderpriority"))


INSERT_SQL = """WITH r AS (SELECT o_custkey AS k, o_orderkey AS id, o_custkey % 40 AS owner, CASE WHEN o_orderkey % 10 = 0 THEN 'active' ELSE 'done' END AS status FROM orders),
s AS (SELECT * FROM r WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1), n AS (SELECT * FROM r WHERE id % 3 <> 0 AND k NOT IN (SELECT k FROM s) QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1),
u AS (SELECT *, FALSE AS new FROM s UNION ALL SELECT *, TRUE FROM n), c AS (SELECT *, count(*) OVER (PARTITION BY owner) AS total, row_number() OVER (PARTITION BY owner, new OR status = 'active' ORDER BY id) AS age FROM u)
SELECT k, id, owner, status, NOT new AND status <> 'active' AND age <= total - 30 AS archived FROM c"""


@query("s5_insert", INSERT_SQL)
def s5(spark, d):
    schema = "k long, id long, owner long, status string"
    rows = read_table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("owner"), F.when(F.col("o_orderkey") % 10 == 0, "active").otherwise("done").alias("status"))
    store = L.Store(scratch_path(spark, "store"), schema, "k", "owner", ["id"], "status", ["active"], 30)
    store.put(rows.where("id % 3 = 0"), 0)
    store.put(rows.where("id % 3 <> 0"), 1)
    return store.rows(spark).withColumn("archived", F.lit(False)).unionByName(store.archive(spark).withColumn("archived", F.lit(True)))


@query("s6_json_sink", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def s6(spark, d):
    path, nations = scratch_path(spark, "json"), read_table(spark, d, "nation").select("n_nationkey", "n_name")
    write_json_atomically(nations, path)
    write_json_atomically(nations.where("n_nationkey % 2 = 0"), path)
    return spark.read.schema(nations.schema).json(path)


@query("i3_drain_cursor", "SELECT user_id, min(epoch_us(ts) // 1000) AS cursor FROM events WHERE user_id % 10 <> 0 GROUP BY 1")
def i3(spark, d):
    e = read_table(spark, d, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    before = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.min("ms").alias("cursor"))
    return I.lowered_cursors(before, e.where("event_id % 2 = 1"), "user_id", "ms", e.where("user_id % 10 = 0").select("user_id").distinct())


@query("i4_frontier", "SELECT user_id, arg_max(v, event_id) FILTER (WHERE v IS NOT NULL) AS frontier, count(*) // 7 AS sweeps FROM (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(round_even(value * 100, 0) AS BIGINT) END AS v FROM events) GROUP BY 1")
def i4(spark, d):
    h = read_table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 != 0, F.bround(F.col("value") * 100).cast("long")).alias("v"))
    return I.frontiers(h, "user_id", "event_id", "v", 7)


@query("i5_exactly_once", "SELECT DISTINCT user_id, event_type FROM events")
def i5(spark, d):
    table, schema = scratch_path(spark, "ledger"), "user_id long, event_type string"
    write = L.once(table, ["user_id", "event_type"], schema)
    L.drain(stream(spark, d, "events").select("user_id", "event_type"), write)
    L.drain(stream(spark, d, "events").where("event_id % 2 = 0").select("user_id", "event_type"), write)  # all of it known by now
    return L.read_ledger(spark, table, schema)


@query("i6_quarantine", """WITH a AS (SELECT user_id AS message, event_id AS moment, CASE event_type WHEN 'error' THEN 'permanent' WHEN 'click' THEN 'transient' ELSE 'free' END AS kind FROM events), r AS (SELECT message, max(moment) AS since FROM a WHERE moment % 50 = 0 GROUP BY 1)
SELECT a.message, count(*) FILTER (WHERE kind = 'transient') AS transient, count(*) FILTER (WHERE kind = 'permanent') AS permanent, count(*) FILTER (WHERE kind = 'transient') >= 5 OR count(*) FILTER (WHERE kind = 'permanent') >= 2 AS quarantined FROM a LEFT JOIN r ON a.message = r.message WHERE since IS NULL OR moment > since GROUP BY 1""")
def i6(spark, d):
    kind = F.when(F.col("event_type") == "error", "permanent").when(F.col("event_type") == "click", "transient").otherwise("free")
    a = read_table(spark, d, "events").select(F.col("user_id").alias("message"), F.col("event_id").alias("at"), kind.alias("kind"))
    return I.quarantine(a, "message", "at", "kind", a.where("at % 50 = 0").select("message", "at"))


REVIEWS_SQL = "(SELECT o_orderkey, o_orderdate, o_custkey % 2 = 0 AS has_result, CASE o_orderstatus WHEN 'P' THEN 'in_progress' WHEN 'O' THEN 'in_progress' ELSE 'completed' END AS status FROM orders)"


def reviews(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), (F.col("o_custkey") % 2 == 0).alias("has_result"), F.when(F.col("o_orderstatus").isin("P", "O"), "in_progress").otherwise("completed").alias("status"))


@query("i8_interrupted", f"SELECT o_orderkey, CASE WHEN status = 'in_progress' AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 3600 SECOND THEN CASE WHEN has_result THEN 'completed' ELSE 'interrupted' END ELSE status END AS status FROM {REVIEWS_SQL}")
def i8(spark, d):
    once = I.reconciled(reviews(spark, d), "status", "o_orderdate", F.col("has_result"), F.lit("1997-01-01").cast("timestamp"), 3600)
    return I.reconciled(once, "status", "o_orderdate", F.col("has_result"), F.lit("1997-01-01").cast("timestamp"), 3600).select("o_orderkey", "status")


@query("i9_backfill", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= 16 AS inline FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def i9(spark, d):
    return I.backfill(read_table(spark, d, "documents"), read_table(spark, d, "labels"), "doc_id")


@query("i10_stalled", f"SELECT o_orderkey, CASE WHEN status = 'in_progress' AND o_orderkey % 7 <> 0 AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 900 SECOND THEN 'stalled' ELSE status END AS status FROM {REVIEWS_SQL}")
def i10(spark, d):
    started = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    return reviews(spark, d).select("o_orderkey", I.shown_status(F.col("status"), started, F.lit("1997-01-01").cast("timestamp"), 900).alias("status"))


@query("i11_append", "SELECT event_id, user_id, event_type FROM events")
def i11(spark, d):
    table = scratch_path(spark, "timeline")
    L.drain(stream(spark, d, "events").select("event_id", "user_id", "event_type"), L.append(table))
    return L.read_ledger(spark, table, "event_id long, user_id long, event_type string")


def revisions(spark, d):
    """Each turn of a conversation beside the one that follows it."""
    t = read_table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new"))
    return t.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("old"), "new")


@query("t15_token_diff")
def t15(spark, d):
    return revisions(spark, d).select("conv_id", "turn", F.to_json(M.inline_diff(F.col("old"), F.col("new"), whole=True)).alias("operations"))


@query("t16_letter_diff")
def t16(spark, d):
    return revisions(spark, d).select("conv_id", "turn", F.to_json(M.inline_diff(F.col("old"), F.col("new"), letters=True, whole=True)).alias("operations"))


@query("t19_nested_strings", "SELECT conv_id, turn, role || '|' || text || '|' || role AS strings FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def t19(spark, d):
    value = F.to_json(F.struct(F.col("role").alias("a"), F.struct(F.array("text", "role").alias("c"), "turn").alias("b")))
    return read_table(spark, d, "conversations").where("text is not null and role is not null").select("conv_id", "turn", F.array_join(M.nested_strings(value), "|").alias("strings"))


@query("j8_all_pairs_oracle", f"WITH {DUCK_BITS} SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(CAST(xor(a.sim, b.sim) AS UBIGINT)) AS INT) AS bits FROM f a JOIN f b ON a.doc_id < b.doc_id AND bit_count(CAST(xor(a.sim, b.sim) AS UBIGINT)) <= 4")
def j8(spark, d):
    return dedup.all_pairs(dedup.fingerprints(spread(spark, d)), "doc_id", "simhash")


COVER_SQL = """WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations), a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM s WHERE text <> ''),
b AS (SELECT conv_id, text AS given, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN conv_id % 4 = 1 AND turn < 2 THEN 1 - turn ELSE turn END) AS k FROM s WHERE text <> '' AND NOT (conv_id % 4 = 2 AND turn > 0) AND conv_id % 4 <> 3),
g AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(sum(length(text)), 0) + greatest(count(text) - 1, 0) AS whole, coalesce(sum(length(given)), 0) + greatest(count(given) - 1, 0) AS part, min(CASE WHEN text IS DISTINCT FROM given THEN coalesce(a.k, b.k) END) AS first FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.k = b.k GROUP BY 1),
v AS (SELECT *, CASE WHEN whole = 0 THEN 'covered' WHEN part = 0 THEN 'empty' WHEN part < 0.9 * whole THEN 'short' WHEN first IS NOT NULL THEN 'diverging' ELSE 'covered' END AS verdict FROM g) SELECT conv_id, verdict, CAST(CASE WHEN verdict = 'diverging' THEN first END AS INTEGER) AS first FROM v"""


@query("j16_coverage", COVER_SQL)
def j16(spark, d):
    t, c = read_table(spark, d, "conversations").select("conv_id", F.col("turn").alias("index"), "text"), F.col("conv_id") % 4
    swapped = F.when((c == 1) & (F.col("index") < 2), 1 - F.col("index")).otherwise(F.col("index"))
    return M.coverage(t, t.where(~((c == 2) & (F.col("index") > 0)) & (c != 3)).withColumn("index", swapped), "conv_id")


@query("j15_matching")
def j15(spark, d):
    items = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("edit"), F.explode(F.array(F.col("l_suppkey") % 4, F.col("l_partkey") % 4)).alias("place"))
    return M.matched(items, "doc", "edit", "place")


@query("f2_scalars", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, round(o_custkey % 7 / nullif(o_custkey % 3, 0), 6) AS share, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN lower(o_orderpriority) END AS known, array_to_string(list_transform(range(o_custkey % 4, least(o_custkey % 4 + 2, 5) + 1), lambda x: x::VARCHAR), ',') AS numbers FROM orders")
def f2(spark, d):
    o = read_table(spark, d, "orders")
    low = F.col("o_custkey") % 4
    return o.select("o_orderkey", S.month_key(F.col("o_orderdate")).alias("month"), F.round(F.try_divide(F.col("o_custkey") % 7, F.nullif(F.col("o_custkey") % 3, F.lit(0))), 6).alias("share"), S.one_of(F.col("o_orderpriority"), ["1-urgent", "2-high"]).alias("known"), F.array_join(S.numbers_between(low, F.least(low + 2, F.lit(5))), ",").alias("numbers"))


LABEL_SQL = """SELECT o_orderkey, CASE o_custkey % 31 WHEN 0 THEN '0' WHEN 30 THEN 'thirty' ELSE coalesce(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen', 'twenty'][o_custkey % 31], CAST(o_custkey % 31 AS VARCHAR)) END || ' (' || o_custkey % 31 || ')' || CASE o_custkey % 31 WHEN 1 THEN ' year' ELSE ' years' END AS label,
CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a or b' WHEN 2 THEN 'a, b, or c' ELSE '' END AS choice, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE o_orderkey % 5 WHEN 1 THEN '+02:00' ELSE '+00:00' END END AS sent,
CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS given FROM orders"""


@query("f3_scalars", LABEL_SQL)
def f3(spark, d):
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 31
    items = F.slice(F.array(*map(F.lit, "abc")), 1, F.when(k % 4 == 3, 0).otherwise((k % 4 + 1).cast("int")))
    zone = F.when(k % 5 == 1, " +0200").when(k % 5 == 2, " GMT").when(k % 5 == 3, "").otherwise(" +0000")
    date = F.when(k % 5 == 4, F.when(k % 2 == 0, "soon").otherwise(None)).otherwise(F.concat(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), zone))
    body = F.concat(F.lit('{"k": '), F.when(k % 3 != 0, F.col("o_custkey").cast("string")).when(k % 2 == 0, "NaN").otherwise("-Infinity"), F.lit(', "t": "NaN"}'))
    return read_table(spark, d, "orders").select("o_orderkey", S.year_label(n, digits=True).alias("label"), X.joined_with_and(items, "or").alias("choice"), S.email_time(date).alias("sent"), S.finite_json(body, "k long, t string")["k"].alias("given"))


@query("f4_counts_by_key", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def f4(spark, d):
    found = S.counts_by_key(read_table(spark, d, "events"), "user_id", "event_type")
    return found.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))
