"""Verdicts, filters, facets, ranking, retention, reconciliation and telemetry on the driver's tables, with their SQL.

The stand-ins: order lines are clauses (return flag A a fail, R a review, N a pass), orders are matters, documents with
their labels are corpus rows, events are activity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parchmill.functions import scalar as S
from parchmill.functions import text as X
from parchmill.operators import clauses as K
from parchmill.operators import corpus as C
from parchmill.operators import dedup, reconcile, retention, telemetry
from parchmill.operators import verdicts as V
from parchmill.operators.structure import paragraphs
from parchmill.plans.agreements import WITH, agreements
from parchmill.session import read_table, settled

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def T(spark, d, name):
    return read_table(spark, d, name)


CLAUSE_SQL = "(SELECT l_orderkey AS doc, l_linenumber AS clause, CASE l_returnflag WHEN 'A' THEN 'fail' WHEN 'R' THEN 'review' ELSE 'pass' END AS decision, 'r' || (l_partkey % 6) AS reason, l_quantity AS qty, l_partkey AS part FROM lineitem)"


def clauses(spark, d):
    decision = F.when(F.col("l_returnflag") == "A", "fail").when(F.col("l_returnflag") == "R", "review").otherwise("pass")
    return T(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("clause"), decision.alias("decision"), F.concat(F.lit("r"), F.col("l_partkey") % 6).alias("reason"), F.col("l_quantity").alias("qty"), F.col("l_partkey").alias("part"))


CORPUS_SQL = "(SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, quality, toxic, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'has_fail' WHEN quality = 0 THEN 'needs_review' ELSE 'clean' END AS outcome FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def corpus(spark, d):
    ran = F.col("l").isNotNull()
    labels = T(spark, d, "labels").withColumn("l", F.lit(True))
    return T(spark, d, "documents").join(labels, "doc_id", "left").withColumn("outcome", V.review_outcome(ran, F.col("toxic"), 1 - F.col("quality")))


@query("a1_arbitrate", f"""SELECT doc, clause, CASE WHEN decision = 'fail' THEN 'fail' WHEN decision = 'review' AND qty > 25 AND qty % 3 = 0 THEN 'pass' WHEN decision = 'review' THEN 'review' WHEN qty % 5 = 0 THEN 'review' ELSE 'pass' END AS final,
CASE WHEN decision = 'fail' THEN 'deterministic' WHEN decision = 'review' AND qty > 25 AND qty % 3 = 0 THEN 'ai' WHEN decision = 'review' AND qty > 25 THEN 'semantic_crosscheck' WHEN decision = 'review' THEN 'deterministic' WHEN qty % 5 = 0 THEN 'ai' ELSE 'deterministic' END AS origin FROM {CLAUSE_SQL}""")
def a1(spark, d):
    ai_status = F.when(F.col("qty") % 5 == 0, "escalated").otherwise("agreed")
    ai_decision = F.when(F.col("qty") % 3 == 0, "pass").otherwise("review")
    r = V.arbitrate(F.col("decision"), ai_status, ai_decision, F.col("qty") > 25)
    return clauses(spark, d).select("doc", "clause", r["decision"].alias("final"), r["source"].alias("origin"))


STATE_SQL = f"SELECT doc, count(*) FILTER (decision = 'pass') AS pass, count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decision = 'fail') AS chk, count(*) AS total FROM {CLAUSE_SQL} GROUP BY 1"


@query("a2_review_state", f"SELECT *, CASE WHEN chk > 0 THEN 'check' WHEN review > 0 THEN 'review' WHEN total > 0 THEN 'pass' ELSE 'pending' END AS state FROM ({STATE_SQL})")
def a2(spark, d):
    return V.review_state(clauses(spark, d), "doc", "clause", "decision").select("doc", "pass", "review", F.col("check").alias("chk"), "total", "state")


@query("a3_tallies", f"SELECT doc, count(*) FILTER (decision = 'pass') AS passed, count(*) FILTER (decision = 'fail') AS failed, count(*) FILTER (decision = 'review') AS needs_review FROM {CLAUSE_SQL} GROUP BY 1")
def a3(spark, d):
    return V.tallies(clauses(spark, d), "doc", "decision")


@query("a4_human_gate", f"SELECT doc, chk + review > 0 OR total = 0 OR doc % 10 = 0 AS blocked FROM ({STATE_SQL})")
def a4(spark, d):
    s = V.review_state(clauses(spark, d), "doc", "clause", "decision")
    return s.select("doc", V.human_gate(F.col("state"), F.col("total"), F.col("doc") % 10 == 0, F.lit(None).cast("boolean")).alias("blocked"))


@query("a5_reason_codes", f"""WITH r AS (SELECT DISTINCT doc, CASE decision WHEN 'fail' THEN 0 WHEN 'review' THEN 1 ELSE 2 END AS rank, reason FROM {CLAUSE_SQL}),
f AS (SELECT doc, reason, min(rank) AS rank FROM r GROUP BY 1, 2) SELECT doc, array_to_string(list(reason ORDER BY rank, reason), ',') AS reason_codes FROM f GROUP BY 1""")
def a5(spark, d):
    return V.review_state(clauses(spark, d), "doc", "clause", "decision", "reason").select("doc", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("a6_triage", f"""SELECT s.doc, CASE WHEN chk = 0 AND review = 0 THEN 'ready_to_sign' WHEN review > 0 OR coalesce(p, false) THEN 'legal_review' ELSE 'needs_redline' END AS triage_status,
CASE WHEN chk = 0 AND review = 0 THEN 'Ready for signature' WHEN review > 0 AND chk = 0 THEN 'Needs human review' WHEN review > 0 OR coalesce(p, false) THEN 'Needs legal review' ELSE 'Review redline' END AS next_action, chk + review AS issue_count
FROM ({STATE_SQL}) s LEFT JOIN (SELECT doc, bool_or(decision = 'fail' AND clause = 1) AS p FROM {CLAUSE_SQL} GROUP BY 1) q ON s.doc = q.doc""")
def a6(spark, d):
    c = clauses(spark, d)
    s = c.groupBy("doc").agg(F.count_if(F.col("decision") == "fail").alias("f"), F.count_if(F.col("decision") == "review").alias("r"), F.bool_or((F.col("decision") == "fail") & (F.col("clause") == 1)).alias("p"))
    t = V.triage(F.col("f"), F.col("r"), F.col("p"), F.lit(False))
    return s.select("doc", t["triage_status"].alias("triage_status"), t["next_action"].alias("next_action"), t["issue_count"].alias("issue_count"))


MATTER_SQL = "(SELECT o_orderkey AS k, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS executed, CASE WHEN o_orderkey % 7 = 0 THEN 'review' WHEN o_orderkey % 11 = 0 THEN 'sent' END AS err, o_orderkey % 13 = 0 AS nego, o_orderkey % 17 = 0 AS voided, o_orderstatus = 'F' AS sent, o_orderstatus = 'P' AS approved, o_totalprice > 50000 AS reviewed, o_totalprice > 150000 AS blocks FROM orders)"


@query("a7_workflow_state", f"""SELECT k, CASE WHEN executed THEN 'executed' WHEN err IS NOT NULL THEN err WHEN nego THEN 'negotiation' WHEN voided THEN 'approval' WHEN sent THEN 'sent' WHEN approved THEN 'approval' WHEN reviewed THEN 'review' ELSE 'intake' END AS phase,
CASE WHEN executed THEN 'fully_signed' WHEN err = 'review' THEN 'review_failed' WHEN err = 'sent' THEN 'send_failed' WHEN nego THEN 'counter_received' WHEN voided THEN 'signature_voided' WHEN sent THEN 'awaiting_counterparty' WHEN approved THEN 'approved' WHEN reviewed AND blocks THEN 'awaiting_human' WHEN reviewed THEN 'auto_cleared' ELSE 'received' END AS status FROM {MATTER_SQL}""")
def a7(spark, d):
    return matters(spark, d).select("k", "w.phase", "w.status")


def matters(spark, d):
    k = F.col("o_orderkey")
    err = F.when(k % 7 == 0, "review").when(k % 11 == 0, "sent")
    w = V.workflow_state((F.col("o_orderstatus") == "F") & (k % 2 == 0), err, k % 13 == 0, k % 17 == 0, F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P", F.col("o_totalprice") > 50000, F.col("o_totalprice") > 150000)
    return T(spark, d, "orders").select(k.alias("k"), "o_custkey", "o_orderdate", "o_totalprice", w.alias("w"))


@query("a8_board", f"""SELECT board, count(*) AS matters FROM (SELECT CASE WHEN phase = 'executed' THEN NULL WHEN status IN ('review_failed', 'send_failed') AND k % 3 <> 0 THEN 'inbox' WHEN phase = 'intake' THEN CASE WHEN k % 3 <> 0 THEN 'inbox' ELSE 'in_review' END WHEN phase = 'review' THEN 'in_review' WHEN phase = 'approval' THEN 'reviewed' ELSE 'sent' END AS board FROM ({'{A7}'})) GROUP BY 1""")
def a8(spark, d):
    b = V.board_column(F.col("w.phase"), F.col("w.status"), F.when(F.col("k") % 3 != 0, "inbox").otherwise("unknown"))
    return matters(spark, d).groupBy(b.alias("board")).agg(F.count("*").alias("matters"))


SQL["a8_board"] = SQL["a8_board"].replace("{A7}", SQL["a7_workflow_state"])


@query("a9_timeline_summary", "SELECT user_id, count(*) AS event_count, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_at FROM events GROUP BY 1")
def a9(spark, d):
    return V.timeline_summary(T(spark, d, "events"), "user_id", "ts", "event_type", "event_id")


@query("a10_capped_timeline", """WITH r AS (SELECT user_id, ts, event_type, CASE WHEN value > 50 THEN 'system' ELSE event_type END AS actor, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, ts, event_type, actor, CAST(NULL AS BIGINT) AS dropped_count FROM r WHERE r <= 20 UNION ALL
SELECT user_id, max(ts), 'timeline_truncated', coalesce(arg_max(actor, (ts, event_id)) FILTER (actor <> 'system'), 'system'), count(*) FROM r WHERE r > 20 GROUP BY 1""")
def a10(spark, d):
    e = T(spark, d, "events").withColumn("actor", F.when(F.col("value") > 50, "system").otherwise(F.col("event_type")))
    return V.capped_timeline(e, "user_id", "ts", "event_type", "event_id", "actor", keep=20)


@query("a11_term_band", "SELECT CASE WHEN l_quantity / 5 - 1 <= 0 THEN NULL WHEN l_quantity / 5 - 1 <= 2 THEN 'up_to_2' WHEN l_quantity / 5 - 1 <= 5 THEN 'up_to_5' ELSE 'over_5' END AS band, count(*) AS lines FROM lineitem GROUP BY 1")
def a11(spark, d):
    return T(spark, d, "lineitem").groupBy(S.term_band(F.col("l_quantity") / 5 - 1).alias("band")).agg(F.count("*").alias("lines"))


@query("a12_review_outcome", f"SELECT outcome, count(*) AS documents FROM {CORPUS_SQL} GROUP BY 1")
def a12(spark, d):
    return corpus(spark, d).groupBy("outcome").agg(F.count("*").alias("documents"))


@query("a13_signed", f"SELECT CASE WHEN status = 'fully_signed' THEN true WHEN status IN ('awaiting_counterparty', 'signature_voided') THEN false END AS signed, count(*) AS matters FROM ({{A7}}) GROUP BY 1".replace("{A7}", SQL["a7_workflow_state"]))
def a13(spark, d):
    return matters(spark, d).groupBy(V.signed(F.col("w.status")).alias("signed")).agg(F.count("*").alias("matters"))


@query("a13_mutuality", WITH + "SELECT k AS doc_id, CASE WHEN NOT leaflet THEN CASE st WHEN 'O' THEN 'one_way' WHEN 'F' THEN 'mutual' END END AS mutuality FROM o")
def a13_mutuality(spark, d):
    """From the paragraphs of composed agreements that bind one party alone, and those that bind both."""
    agreed = settled(agreements(spark, d), "agreements")
    parts = settled(paragraphs(agreed), "paragraphs")
    ids = lambda rule: K.paragraph_matches(parts, K.RULES[rule]).groupBy("doc_id").agg(F.collect_list("id").alias(rule))
    both = agreed.select("doc_id").join(ids("one_way"), "doc_id", "left").join(ids("strong_mutual"), "doc_id", "left")
    return both.select("doc_id", V.mutuality_facet(F.col("one_way"), F.col("strong_mutual")).alias("mutuality"))


@query("a13_origin", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'generated' WHEN o_orderpriority = '3-MEDIUM' OR o_custkey % 3 = 0 THEN 'received' END AS origin FROM orders")
def a13_origin(spark, d):
    p = F.col("o_orderpriority")
    source = F.when(p == "1-URGENT", " Generated").when(p == "2-HIGH", "send_document").when(p == "3-MEDIUM", F.when(F.col("o_orderkey") % 2 == 0, "Gmail_inbound").otherwise("EMAIL ")).when(p == "4-NOT SPECIFIED", "other")
    return T(spark, d, "orders").select("o_orderkey", V.origin(source, F.when(F.col("o_custkey") % 3 == 0, True)).alias("origin"))


@query("a14_clause_ids", f"SELECT doc, array_to_string(list(clause ORDER BY r, clause), ',') AS ids FROM (SELECT doc, clause, min(CASE decision WHEN 'pass' THEN 0 WHEN 'review' THEN 1 ELSE 2 END) AS r FROM {CLAUSE_SQL} GROUP BY 1, 2) GROUP BY 1")
def a14(spark, d):
    s = V.review_state(clauses(spark, d).withColumn("clause", F.col("clause").cast("string")), "doc", "clause", "decision")
    return s.select("doc", F.array_join(V.clause_ids(F.col("pass_ids"), F.col("review_ids"), F.col("fail_ids")), ",").alias("ids"))


@query("a15_facet_counts", f"""SELECT facet, value, count(*) AS matters FROM (SELECT 'lang' AS facet, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'outcome', outcome FROM {CORPUS_SQL}
UNION ALL SELECT 'marks', m FROM (SELECT DISTINCT doc_id, unnest([CASE WHEN contains(text, '@') THEN 'at' END, CASE WHEN contains(text, '|') THEN 'bar' END]) AS m FROM documents)) WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2""")
def a15(spark, d):
    rows = corpus(spark, d).withColumn("marks", F.array(F.when(F.contains("text", F.lit("@")), "at"), F.when(F.contains("text", F.lit("|")), "bar")))
    return C.facet_counts(rows, "doc_id", ["lang", "source", "outcome"], ["marks"])


@query("a15_grouping_sets", "SELECT lang, source, count(*) AS matters FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def a15_sets(spark, d):
    return T(spark, d, "documents").groupingSets([["lang"], ["source"]], "lang", "source").agg(F.count("*").alias("matters"))


@query("a16_groups", "SELECT source, CAST(max(n) AS BIGINT) AS n, array_to_string(list(doc_id ORDER BY r) FILTER (r <= 5), ',') AS newest FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY 1")
def a16(spark, d):
    return C.grouped(T(spark, d, "documents"), "source", "doc_id", "n_chars", 5).select("source", "n", F.array_join(F.col("newest").cast("array<string>"), ",").alias("newest"))


@query("a18_first_appearance", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY source = 'src0', min(doc_id)) AS place FROM documents GROUP BY 1")
def a18(spark, d):
    return C.by_first_appearance(T(spark, d, "documents"), "source", "doc_id", last="src0")


@query("a19_month_buckets", "SELECT coalesce(strftime(o_orderdate, '%Y-%m'), '0000-00') AS month, count(*) AS matters FROM orders GROUP BY 1")
def a19(spark, d):
    return T(spark, d, "orders").groupBy(S.month_key(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("matters"))


@query("a20_lifecycle_rail")
def a20(spark, d):
    seen = matters(spark, d).groupBy("o_custkey").agg(F.collect_set("w.phase").alias("seen"))
    return seen.select("o_custkey", F.array_join(F.transform(F.array(*map(F.lit, V.LIFECYCLE)), lambda p: F.concat(p, F.when(F.array_contains(F.col("seen"), p), "+").otherwise("-"))), ",").alias("rail"))


SQL["a20_lifecycle_rail"] = "SELECT o_custkey, " + " || ',' || ".join(f"'{p}' || CASE WHEN bool_or(phase = '{p}') THEN '+' ELSE '-' END" for p in V.LIFECYCLE) + f" AS rail FROM ({SQL['a7_workflow_state']}) a JOIN orders o ON a.k = o.o_orderkey GROUP BY 1"


@query("a21_metrics", "SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS counter, arg_max(CAST(round(value * 100) AS BIGINT), (ts, event_id)) AS gauge, max(CAST(round(value * 100) AS BIGINT)) AS high_water FROM events GROUP BY 1")
def a21(spark, d):
    return telemetry.metrics(T(spark, d, "events").withColumn("v", F.round(F.col("value") * 100).cast("long")), "event_type", "v", "ts", "event_id")


@query("a22_ai_costs", """WITH e AS (SELECT event_type, CAST(round(value * 1000) AS BIGINT) AS micro, user_id AS tokens FROM events)
SELECT event_type, round_even(sum(micro) / 1e6, 4) AS usd, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(micro) / (SELECT sum(micro) FROM e), 6) AS share FROM e GROUP BY 1""")
def a22(spark, d):
    e = T(spark, d, "events").select("event_type", F.round(F.col("value") * 1000).cast("long").alias("micro"), F.col("user_id").alias("tokens"))
    return telemetry.ai_costs(e, "event_type", "micro", "tokens")


@query("a23_health", "SELECT f AS failures, n AS attempts, round(f / n, 6) AS rate, CASE WHEN f / n >= 0.2 THEN 'critical' WHEN f / n >= 0.05 THEN 'warning' ELSE 'ok' END AS severity FROM (SELECT count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) AS f, count(*) AS n FROM events)")
def a23(spark, d):
    e = T(spark, d, "events")
    least = e.agg(F.min("event_type").alias("least"))
    return telemetry.health(e.crossJoin(F.broadcast(least)).withColumn("kind", F.when(F.col("event_type") == F.col("least"), "failed").otherwise("done")), "kind", ["failed"], ["failed", "done"])


@query("a24_grounding", f"""SELECT ground, downgraded, count(*) AS n FROM (SELECT *, CASE WHEN decision = 'fail' AND ground = 'ungrounded' THEN 'review' ELSE decision END AS downgraded FROM (SELECT decision, CASE WHEN decision = 'pass' THEN NULL WHEN qty > 10 THEN 'grounded' WHEN reason = 'r1' THEN 'absence' ELSE 'ungrounded' END AS ground FROM {CLAUSE_SQL})) GROUP BY 1, 2""")
def a24(spark, d):
    g = V.grounding(F.col("decision"), F.when(F.col("reason") == "r1", "missing").otherwise("unclear"), F.col("qty") > 10)
    return clauses(spark, d).withColumn("ground", g).groupBy("ground", V.downgraded(F.col("decision"), F.col("ground")).alias("downgraded")).agg(F.count("*").alias("n"))


@query("a25_primary_citation", "SELECT l_orderkey AS doc, CAST(arg_min(l_comment, (l_linenumber, l_comment)) FILTER (l_quantity > 20) AS VARCHAR) AS quote FROM (SELECT l_orderkey, l_linenumber, l_partkey AS l_comment, l_quantity FROM lineitem) GROUP BY 1")
def a25(spark, d):
    e = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", F.when(F.col("l_quantity") > 20, F.col("l_partkey").cast("string")).alias("quote"))
    return V.primary_citations(e, "doc", "quote", ["l_linenumber", "l_partkey"])


@query("a26_stale_reasons", "SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN o_orderkey % 3 <> 1 THEN 'engine_version_changed' END, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_clauses' END, CASE WHEN o_orderkey % 7 = 0 THEN 'rule_set_changed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders) GROUP BY 1")
def a26(spark, d):
    k = F.col("o_orderkey")
    r = V.stale_reasons(k % 3, F.lit(1), k % 7 == 0, F.lit(False), k % 5 != 0, F.lit(True))
    return T(spark, d, "orders").groupBy(F.array_join(r, ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("a27_label_metrics", "SELECT lang, count(*) AS total, count(*) FILTER (a = b) AS correct, count(*) FILTER (a = 'fail' AND b = 'pass') AS false_clears, count(*) FILTER (a = 'pass' AND b = 'fail') AS false_flags, count(*) FILTER (a = b) / count(*) AS accuracy FROM (SELECT lang, CASE WHEN toxic = 1 THEN 'fail' ELSE 'pass' END AS a, CASE WHEN n_chars < 500 THEN 'fail' ELSE 'pass' END AS b FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def a27(spark, d):
    rows = T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id")
    rows = rows.select("lang", F.when(F.col("toxic") == 1, "fail").otherwise("pass").alias("a"), F.when(F.col("n_chars") < 500, "fail").otherwise("pass").alias("b"))
    return V.label_metrics(rows, "lang", "a", "b")


@query("a28_top_reasons", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 3")
def a28(spark, d):
    return V.top_reasons(T(spark, d, "events"), "event_type", "event_id")


BLOCK_SQL = """SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'engine_version_changed' END, CASE WHEN o_orderstatus = 'P' THEN 'missing_clauses' END, CASE WHEN o_custkey % 4 = 0 THEN 'missing_review_state' END, CASE WHEN o_orderkey % 7 IN (0, 1) THEN 'rule_set_changed' END], lambda x: x IS NOT NULL), ',') AS reasons,
CASE WHEN o_orderkey % 7 IN (0, 1) THEN 'stale_playbook' ELSE '' END AS blocks FROM orders"""


@query("a29_approval_blocks", BLOCK_SQL)
def a29(spark, d):
    k = F.col("o_orderkey")
    engine, rules = F.when(k % 5 == 0, 1).otherwise(2), F.when(k % 7 == 0, "old").when(k % 7 != 1, "now")
    clauses, state = F.when(F.col("o_orderstatus") != "P", True), F.when(F.col("o_custkey") % 4 != 0, True).otherwise(F.when(k % 2 == 0, False))
    stale = V.stale_reasons(engine, F.lit(2), rules, F.lit("now"), clauses, state)
    return T(spark, d, "orders").select("o_orderkey", F.array_join(stale, ",").alias("reasons"), F.array_join(V.approval_blocks(stale), ",").alias("blocks"))


@query("a30_rule_set_hash", """SELECT sha256(string_agg('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}', chr(10) ORDER BY '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}')) AS etag FROM nation""")
def a30(spark, d):
    return V.rule_set_hash(T(spark, d, "nation"), "n_nationkey", "n_name")


SPEC = {"governing_law": "en", "review_outcome": "clean", "text": "the of", "nonsense": 1, "min_age_days": float("nan")}


@query("q2_filter", f"SELECT doc_id FROM {CORPUS_SQL} WHERE lang = 'en' AND outcome = 'clean' AND contains(lower(source || ' ' || text), 'the') AND contains(lower(source || ' ' || text), 'of')")
def q2(spark, d):
    return corpus(spark, d).where(C.matches(SPEC, {"governing_law": F.col("lang"), "review_outcome": F.col("outcome")}, F.concat_ws(" ", "source", "text"))).select("doc_id")


NOW = dt.datetime(1998, 12, 31)


@query("q3_client_filter", "SELECT o_orderkey FROM orders WHERE greatest(0, floor((epoch_ms(TIMESTAMP '1998-12-31') - epoch_ms(o_orderdate)) / 86400000)) >= 300 AND o_orderpriority = '1-URGENT'")
def q3(spark, d):
    fields = {"min_age_days": S.age_days(F.col("o_orderdate"), F.lit(NOW)), "governing_law": F.col("o_orderpriority")}
    return T(spark, d, "orders").where(C.matches({"min_age_days": 300, "governing_law": "1-URGENT"}, fields, F.lit(""), empty_matches_all=False)).select("o_orderkey").orderBy("o_orderkey")


@query("q4_has_issues", f"SELECT doc_id FROM {CORPUS_SQL} WHERE toxic > 0 OR quality = 0")
def q4(spark, d):
    return corpus(spark, d).where(C.has_issues(F.col("l").isNotNull(), F.col("toxic"), 1 - F.col("quality"))).select("doc_id")


@query("q5_corpus_count", f"SELECT count(*) FILTER (lang = 'fr' AND outcome = 'needs_review') AS matching, count(*) AS total FROM {CORPUS_SQL}")
def q5(spark, d):
    return C.corpus_count(corpus(spark, d), C.matches({"governing_law": "fr", "review_outcome": "needs_review"}, {"governing_law": F.col("lang"), "review_outcome": F.col("outcome")}, F.lit("")))


@query("q6_phase_count", f"SELECT count(*) AS in_review FROM ({SQL['a7_workflow_state']}) WHERE phase = 'review'")
def q6(spark, d):
    return C.phase_count(matters(spark, d), F.col("w.phase"), "review").withColumnRenamed("matters", "in_review")


@query("q7_last_sent", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def q7(spark, d):
    return C.last_sent(T(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("q8_keyword_and", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'version')")
def q8(spark, d):
    return T(spark, d, "documents").where(C.all_terms(F.col("text"), "License version")).select("doc_id")


@query("q9_ranked_search", """SELECT doc_id, source, score FROM (SELECT doc_id, source, h + CASE WHEN h = 3 THEN 3 ELSE 0 END AS score FROM (SELECT doc_id, source, CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'apache') AS INT) + CAST(contains(lower(text), 'version') AS INT) AS h FROM documents)) WHERE score > 0 ORDER BY score DESC, source, doc_id LIMIT 8""")
def q9(spark, d):
    return C.ranked(T(spark, d, "documents"), "doc_id", "source", ["text"], ["license", "apache", "version"])


@query("q10_best_match", """WITH s AS (SELECT p_partkey, 3 * h + CASE WHEN h = 2 THEN 4 ELSE 0 END + CASE WHEN p_partkey = 7 THEN 100 ELSE 0 END AS score FROM (SELECT p_partkey, CAST(contains(lower(p_name), 'blue') AS INT) + CAST(contains(lower(p_name), 'steel') AS INT) AS h FROM part)),
b AS (SELECT score, count(*) AS n, min(p_partkey) AS p_partkey FROM s WHERE score > 0 GROUP BY 1 ORDER BY 1 DESC LIMIT 1) SELECT p_partkey, score FROM b WHERE n = 1""")
def q10(spark, d):
    return C.best_match(T(spark, d, "part"), "p_partkey", ["p_name"], ["blue", "steel"], "7")


@query("q12_plain_question", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND greatest(0, floor((epoch_ms(TIMESTAMP '1998-12-31') - epoch_ms(o_orderdate)) / 86400000)) >= 365")
def q12(spark, d):
    spec = C.spec_from_text("Which signed NDAs are older than 13 months?")
    fields = {"signed": F.col("o_orderstatus") == "F", "min_age_days": S.age_days(F.col("o_orderdate"), F.lit(NOW))}
    return T(spark, d, "orders").where(C.matches(spec, fields, F.lit(""))).select("o_orderkey")


@query("q14_faceted_filter", "SELECT doc_id FROM documents WHERE lang IN ('fr', 'en') AND source IN ('src0', 'src2', 'src3') AND (contains(text, '@') OR contains(text, '!') OR contains(text, '%'))")
def q14(spark, d):
    mark = lambda letter, name: F.when(F.contains("text", F.lit(letter)), name)
    rows = T(spark, d, "documents").withColumn("marks", F.array_compact(F.array(mark("@", "at"), mark("!", "call"), mark("%", "share"), mark("|", "bar"))))
    return rows.where(C.faceted({"lang": ["fr", "en"], "source": ["src0", "src2", "src3"], "marks": ["at", "call", "share"], "phase": []}, ("marks",))).select("doc_id")


@query("q15_status_chip", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def q15(spark, d):
    return C.with_status(T(spark, d, "orders"), F.col("o_orderstatus"), "P").select("o_orderkey")


@query("q16_recency", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END, l_commitdate) DESC, l_linenumber, l_partkey) AS place FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_shipdate + INTERVAL 3 DAY AS l_commitdate FROM lineitem)")
def q16(spark, d):
    from pyspark.sql import Window

    at = C.recency(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")), F.expr("l_shipdate + interval 3 days"), F.lit(None).cast("timestamp"))
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc(at), "l_linenumber", "l_partkey")).cast("long").alias("place"))


@query("q17_clause_roster", f"SELECT doc, clause, part, row_number() OVER (PARTITION BY doc ORDER BY CASE decision WHEN 'fail' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, clause, part) AS place FROM {CLAUSE_SQL}")
def q17(spark, d):
    from pyspark.sql import Window

    return clauses(spark, d).select("doc", "clause", "part", F.row_number().over(Window.partitionBy("doc").orderBy(C.severity(F.col("decision")), "clause", "part")).cast("long").alias("place"))


@query("q18_clause_counts", f"SELECT doc, count(*) AS clauses FROM {CLAUSE_SQL} GROUP BY 1")
def q18(spark, d):
    return V.clause_counts(clauses(spark, d), "doc")


@query("q19_corpus_tool", f"SELECT doc_id, source, (SELECT count(*) FROM {CORPUS_SQL} WHERE lang = 'es' AND outcome = 'clean') AS matching FROM {CORPUS_SQL} WHERE lang = 'es' AND outcome = 'clean' ORDER BY doc_id LIMIT 5")
def q19(spark, d):
    hit = corpus(spark, d).where(C.matches({"governing_law": "es", "review_outcome": "clean"}, {"governing_law": F.col("lang"), "review_outcome": F.col("outcome")}, F.lit("")))
    return hit.select("doc_id", "source").orderBy("doc_id").limit(5).crossJoin(F.broadcast(hit.agg(F.count("*").alias("matching"))))


@query("q21_board_list", f"SELECT k, o_orderdate FROM ({SQL['a7_workflow_state']}) a JOIN orders o ON a.k = o.o_orderkey WHERE phase <> 'executed' AND o_custkey = 7")
def q21(spark, d):
    return matters(spark, d).where("w.phase <> 'executed' and o_custkey = 7").select("k", "o_orderdate")


@query("q22_backfill_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 5000")
def q22(spark, d):
    return T(spark, d, "documents").where("n_chars > 5000").join(T(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


ELIGIBLE_SQL = """SELECT o_orderkey, CASE WHEN o_custkey >= 1000 THEN 'other_owner' WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'too_old' WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 'too_new' WHEN o_orderstatus = 'O' THEN 'active' WHEN o_orderkey % 5 = 0 THEN 'human_activity' END AS reason FROM orders"""


@query("q23_archive_eligibility", f"SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n FROM ({ELIGIBLE_SQL}) GROUP BY 1")
def q23(spark, d):
    return eligible(spark, d).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


def eligible(spark, d):
    o = T(spark, d, "orders").withColumn("owner", F.when(F.col("o_custkey") < 1000, "us").otherwise("them"))
    r = C.exclusion_reason(F.col("owner"), "us", F.col("o_orderstatus") == "O", F.col("o_orderdate"), F.lit(dt.datetime(1994, 1, 1)), F.lit(dt.datetime(1996, 1, 1)), F.col("o_orderkey") % 5 == 0)
    return o.select("o_orderkey", r.alias("reason"))


@query("q24_selection_hash", f"SELECT sha256('us' || chr(10) || string_agg(i, chr(10) ORDER BY i)) AS selection_hash, count(*) AS selected FROM (SELECT CAST(o_orderkey AS VARCHAR) AS i FROM ({ELIGIBLE_SQL}) WHERE reason IS NULL ORDER BY 1 LIMIT 200)")
def q24(spark, d):
    return C.selection_hash(eligible(spark, d).where("reason is null"), "us", "o_orderkey")


@query("w1_oldest_first", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) QUALIFY rank <= 3")
def w1(spark, d):
    confirmed = T(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return retention.oldest_first(T(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F", confirmed, "o_orderkey", 3).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("w2_retention", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE o_orderstatus = 'F') WHERE r <= n - 8")
def w2(spark, d):
    return retention.pruned(T(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"], 8).select("o_custkey", "o_orderkey")


@query("w3_global_ceiling", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT (SELECT greatest(0, count(*) - count(*) * 9 // 10) FROM orders)")
def w3(spark, d):
    o = T(spark, d, "orders")
    return retention.over_ceiling(o, F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"], o.count() * 9 // 10).select("o_orderkey")


@query("w4_rotation", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE l > 20000 AND r > 5")
def w4(spark, d):
    return retention.rotated(T(spark, d, "documents"), "source", ["doc_id"], "n_chars", 20000, 5).select("source", "doc_id")


@query("w5_rate_limit", """WITH RECURSIVE h AS (SELECT CAST(user_id AS VARCHAR) AS client, event_type AS bucket, event_id AS id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),
w AS (SELECT client, bucket, id, r, ms, ms AS start, 1 AS n FROM h WHERE r = 1
      UNION ALL SELECT h.client, h.bucket, h.id, h.r, h.ms, CASE WHEN h.ms >= w.start + 86400000 THEN h.ms ELSE w.start END, CASE WHEN h.ms >= w.start + 86400000 THEN 1 ELSE w.n + 1 END FROM w JOIN h ON h.client = w.client AND h.bucket = w.bucket AND h.r = w.r + 1)
SELECT client, bucket, id, n > 2 AS refused, CASE WHEN n > 2 THEN (start + 86400000 - ms + 999) // 1000 ELSE 0 END AS retry_after FROM w""")
def w5(spark, d):
    return retention.rate_limited(T(spark, d, "events"), "user_id", "event_type", "ts", "event_id", 2, 86400)


@query("w6_sequence", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS sequence FROM lineitem")
def w6(spark, d):
    return retention.sequence_numbers(T(spark, d, "lineitem"), "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_partkey", F.col("sequence").cast("long").alias("sequence"))


@query("w7_most_recent", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def w7(spark, d):
    return retention.most_recent(T(spark, d, "events"), "user_id", ["ts", "event_id"], 10).select("user_id", "event_id")


@query("w8_round_robin", "SELECT n_name, ((row_number() OVER (ORDER BY n_name) - 1 - 4) % 25 + 25) % 25 AS turn FROM nation")
def w8(spark, d):
    return retention.round_robin(T(spark, d, "nation"), "n_name", 4).select("n_name", F.col("turn").cast("long").alias("turn"))


@query("w9_cache_bound", "SELECT lang, doc_id FROM (SELECT lang, doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS r FROM documents) WHERE l > 100000 AND r > 1")
def w9(spark, d):
    return retention.rotated(T(spark, d, "documents"), "lang", ["doc_id"], "n_chars", 100000, 1).select("lang", "doc_id")


@query("j1_reconcile", """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey END AS k, 'other ' || c_name AS name, c_mktsegment AS segment, 'link/' || c_custkey AS link FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.name, b.name) AS name, coalesce(a.segment, b.segment) AS segment, link, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL THEN 'app' ELSE 'other' END AS origin FROM a FULL JOIN (SELECT * FROM b WHERE k IS NOT NULL) b ON a.k = b.k UNION ALL SELECT k, name, segment, link, 'orphan' FROM b WHERE k IS NULL""")
def j1(spark, d):
    c, k = T(spark, d, "customer"), F.col("c_custkey")
    a = c.where(k % 3 != 0).select(k.alias("k"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"))
    b = c.where(k % 2 == 0).select(F.when(k % 50 != 0, k).alias("k"), F.concat(F.lit("other "), "c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("link/"), k).alias("link"))
    return reconcile.reconciled(a, b, "k", ["name", "segment"], "link")


@query("j2_filled_urls", "SELECT l_orderkey AS doc, l_linenumber AS artifact, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN 'own' END, CASE WHEN max(l_quantity) > 25 THEN 'sum' END) AS url FROM lineitem GROUP BY 1, 2")
def j2(spark, d):
    items = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("artifact")).agg(F.max("l_quantity").alias("l_quantity"))
    items = items.select("doc", "artifact", F.when(F.col("artifact") % 2 == 0, "own").otherwise("").alias("url"), "l_quantity")
    return reconcile.filled_urls(items.drop("l_quantity"), items.where("l_quantity > 25").select("doc", "artifact", F.lit("sum").alias("url")), "doc", "artifact", "url")


@query("j10_component_dedup", """WITH RECURSIVE k AS (SELECT doc_id, sha256(lower(text)) AS a, sha256(nullif(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss'), '')) AS b FROM documents), e AS (SELECT x.doc_id AS s, y.doc_id AS t FROM k x JOIN k y ON x.doc_id <> y.doc_id AND (x.a = y.a OR x.b = y.b)),
r(s, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s), c AS (SELECT s AS doc_id, min(t) AS component FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT doc_id, component FROM c JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY component ORDER BY n_chars DESC, doc_id) > 1""")
def j10(spark, d):
    form = F.nullif(X.hash_form(F.col("text")), F.lit(""))
    rows = T(spark, d, "documents").select("doc_id", "n_chars", F.sha2(F.lower("text"), 256).alias("a"), F.sha2(form, 256).alias("b"))
    return reconcile.duplicates_to_remove(rows, "doc_id", ["a", "b"], ["n_chars"])


@query("j11_first_sharing", "SELECT p.o_orderkey, min(o.o_orderkey) AS first FROM orders p JOIN orders o ON p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority GROUP BY 1")
def j11(spark, d):
    o = T(spark, d, "orders")
    return reconcile.first_sharing(o, o.select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", "o_custkey").select("o_orderkey", "first")


@query("j12_lineage", """WITH RECURSIVE a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 2 AND turn > 4 THEN 99 ELSE turn - 1 END AS up FROM conversations),
t AS (SELECT conv_id, turn, 0 AS depth FROM a WHERE up IS NULL OR up = 99 OR NOT EXISTS (SELECT 1 FROM a p WHERE p.conv_id = a.conv_id AND p.turn = a.up) UNION ALL SELECT a.conv_id, a.turn, t.depth + 1 FROM t JOIN a ON a.conv_id = t.conv_id AND a.up = t.turn) SELECT conv_id, turn, depth FROM t""")
def j12(spark, d):
    turn = F.col("turn")
    rows = T(spark, d, "conversations").select("conv_id", "turn", F.when(turn % 3 == 0, None).when((turn % 3 == 2) & (turn > 4), 99).otherwise(turn - 1).alias("up_turn"), "role")
    return reconcile.lineage(rows, "turn", "up_turn", ["role"], "conv_id").select("conv_id", "turn", "depth")


@query("j13_latest_per_role", "SELECT conv_id, role, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def j13(spark, d):
    return dedup.latest_by(T(spark, d, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn")


@query("j14_parity", "SELECT k, 'missing_in_orders' AS violation FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT k, 'missing_in_customers' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT c_custkey FROM customer WHERE true)")
def j14(spark, d):
    return reconcile.missing_on_either(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), T(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k", ("customers", "orders"))


@query("u1_ledger_union", """WITH a AS (SELECT DISTINCT user_id AS k, CAST(min(value) AS BIGINT) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id AS k, CAST(max(value) AS BIGINT) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT k, CASE WHEN k % 5 <> 0 THEN greatest(a.n, b.n) END AS n FROM a FULL JOIN b USING (k) WHERE k % 7 <> 0""")
def u1(spark, d):
    e = T(spark, d, "events")
    a = e.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("k")).agg(F.min("value").alias("n")).select("k", F.bround("n").cast("long").alias("n"))
    b = e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("k")).agg(F.max("value").alias("n")).select("k", F.bround("n").cast("long").alias("n"))
    return reconcile.merged_ledger(a, b, e.where("user_id % 7 = 0").select(F.col("user_id").alias("k")), "k", "n", F.col("k") % 5 == 0)


SQL["u1_ledger_union"] = SQL["u1_ledger_union"].replace("CAST(min(value) AS BIGINT)", "CAST(round_even(min(value), 0) AS BIGINT)").replace("CAST(max(value) AS BIGINT)", "CAST(round_even(max(value), 0) AS BIGINT)")


@query("u2_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u2(spark, d):
    o = T(spark, d, "orders")
    return C.confirmed(o.where("o_orderstatus = 'P'"), o, F.col("o_orderpriority") == "1-URGENT", "o_custkey")


@query("u3_distinct_ordered", "SELECT conv_id, turn, array_to_string(list_filter(w, lambda t, i: list_position(w, t) = i), ' ') AS words FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\\pL\\pN]+') AS w FROM conversations)")
def u3(spark, d):
    w = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return T(spark, d, "conversations").select("conv_id", "turn", F.array_join(w, " ").alias("words"))


@query("u4_except", "SELECT conv_id, array_to_string(list_sort(list_filter(list(DISTINCT role), lambda r: r NOT IN ('user', 'assistant'))), ',') AS foreign_roles FROM conversations GROUP BY 1")
def u4(spark, d):
    seen = T(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("seen"))
    return seen.select("conv_id", F.array_join(F.array_sort(F.array_except("seen", F.array(F.lit("user"), F.lit("assistant")))), ",").alias("foreign_roles"))


@query("f1_scalars", """SELECT o_orderkey, regexp_replace(regexp_replace(o_orderpriority || '?.doc', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file_name, round(o_totalprice / nullif(o_custkey % 3, 0), 6) AS none_rate, least(greatest(o_totalprice, 1000), 100000) AS clamped, (o_custkey % 40) / 12.0 AS years FROM orders""")
def f1(spark, d):
    o = T(spark, d, "orders")
    none = F.try_divide("o_totalprice", F.nullif(F.col("o_custkey") % 3, F.lit(0)))
    return o.select("o_orderkey", X.safe_file_name(F.concat("o_orderpriority", F.lit("?.doc"))).alias("file_name"), F.round(none, 6).alias("none_rate"), S.clamped(F.col("o_totalprice"), 1000, 100000).alias("clamped"), S.months_as_years(F.col("o_custkey") % 40).alias("years"))
