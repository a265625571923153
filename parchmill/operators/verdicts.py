"""From clause decisions to document verdicts: ordered conditions and grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
AI_ESCALATIONS = ("escalated", "needs_review", "disagreed", "low_confidence")
AI_UNTRUSTED = ("error", "failed", "invalid", "unavailable")
FAILED_STATUS = {"intake": "extraction_failed", "review": "review_failed", "approval": "approval_failed", "sent": "send_failed"}
LIFECYCLE = ("intake", "review", "approval", "sent", "negotiation", "executed")


def arbitrate(det: Column, ai_status: Column, ai_decision: Column, crosscheck: Column) -> Column:
    """(decision, source). A deterministic fail is a floor; a pass may be escalated to review; a review that only the
    cross-check raised may be cleared by a trustworthy AI pass; anything else is a review."""
    trusted = (ai_decision == "pass") & ~F.coalesce(ai_status.isin(*AI_UNTRUSTED), F.lit(False))
    one = lambda d, s: F.struct(F.lit(d).alias("decision"), F.lit(s).alias("source"))
    return (
        F.when(det == "fail", one("fail", "deterministic"))
        .when((det == "review") & F.coalesce(crosscheck, F.lit(False)) & F.coalesce(trusted, F.lit(False)), one("pass", "ai"))
        .when((det == "review") & F.coalesce(crosscheck, F.lit(False)), one("review", "semantic_crosscheck"))
        .when(det == "review", one("review", "deterministic"))
        .when((det == "pass") & F.coalesce(ai_status.isin(*AI_ESCALATIONS), F.lit(False)), one("review", "ai"))
        .when(det == "pass", one("pass", "deterministic"))
        .otherwise(one("review", "arbiter_default"))
    )


def state_of(failed: Column, review: Column, total: Column) -> Column:
    return F.when(failed > 0, "check").when(review > 0, "review").when(total > 0, "pass").otherwise("pending")


def review_state(clauses: DataFrame, doc: str, clause: str, decision: str, reason: str | None = None) -> DataFrame:
    """One row a document: counts, state, the clause ids of each decision and the reason codes, fails first. Lists hold
    the clauses of one document and are as short as a rule table."""
    ids = lambda d: F.sort_array(F.collect_list(F.when(F.col(decision) == d, F.col(clause))))
    codes = [F.array_sort(F.collect_set(F.when(F.col(decision) == d, F.col(reason)))) for d in ("fail", "review", "pass")] if reason else [F.array().cast("array<string>")] * 3
    out = clauses.groupBy(doc).agg(
        *[F.count_if(F.col(decision) == d).alias(d if d != "fail" else "check") for d in ("pass", "review", "fail")],
        *[ids(d).alias(f"{d}_ids") for d in ("pass", "review", "fail")],
        *[c.alias(f"_c{k}") for k, c in enumerate(codes)],
    )
    out = out.withColumn("total", F.col("pass") + F.col("review") + F.col("check"))
    return out.withColumn("state", state_of(F.col("check"), F.col("review"), F.col("total"))).withColumn("reason_codes", F.array_distinct(F.concat("_c0", "_c1", "_c2"))).drop("_c0", "_c1", "_c2")


def human_gate(state: Column, total: Column, tracked_changes: Column, truncated: Column) -> Column:
    """Whether a person must look: an empty review, a fail or review, unresolved changes or a cut-off source."""
    return (total == 0) | state.isin("check", "review", "pending") | F.coalesce(tracked_changes, F.lit(False)) | F.coalesce(truncated, F.lit(False))


def triage(failed: Column, review: Column, prohibited_failed: Column, forced: Column) -> Column:
    waiting = F.when(review > 0, review).when(forced, F.lit(1)).otherwise(F.lit(0)).cast("long")
    status = F.when((failed == 0) & (waiting == 0), "ready_to_sign").when((waiting > 0) | prohibited_failed, "legal_review").otherwise("needs_redline")
    action = F.when((failed == 0) & (waiting == 0), "Ready for signature").when((waiting > 0) & (failed == 0), "Needs human review").when((waiting > 0) | prohibited_failed, "Needs legal review").otherwise("Review redline")
    return F.struct(status.alias("triage_status"), action.alias("next_action"), (failed + waiting).alias("issue_count"))


def workflow_state(executed: Column, error_phase: Column, negotiation: Column, voided: Column, sent: Column, approved: Column, reviewed: Column, blocks_send: Column) -> Column:
    """(phase, status), the latest stage first, so a matter never reads as an earlier one than it has reached."""
    one = lambda p, s: F.struct(F.lit(p).alias("phase"), (F.lit(s) if isinstance(s, str) else s).alias("status"))
    out = F.when(executed, one("executed", "fully_signed"))
    for phase, status in FAILED_STATUS.items():
        out = out.when(error_phase == phase, one(phase, status))
    return (
        out.when(negotiation, one("negotiation", "counter_received"))
        .when(voided, one("approval", "signature_voided"))
        .when(sent, one("sent", "awaiting_counterparty"))
        .when(approved, one("approval", "approved"))
        .when(reviewed & blocks_send, one("review", "awaiting_human"))
        .when(reviewed, one("review", "auto_cleared"))
        .otherwise(one("intake", "received"))
    )


def board_column(phase: Column, status: Column, current: Column) -> Column:
    """The board column of a phase; a failure keeps the current one; executed matters leave the board."""
    known = F.when(current.isin("inbox", "in_review", "reviewed", "sent"), current)
    return (
        F.when(phase == "executed", F.lit(None).cast("string"))
        .when(status.isin(*FAILED_STATUS.values()) & known.isNotNull(), known)
        .when(phase == "intake", F.coalesce(known, F.lit("in_review")))
        .when(phase == "review", "in_review")
        .when(phase == "approval", "reviewed")
        .when(phase.isin("sent", "negotiation"), "sent")
        .otherwise(F.coalesce(known, F.lit("in_review")))
    )


def timeline_summary(events: DataFrame, doc: str, at: str, kind: str, tie: str) -> DataFrame:
    return events.groupBy(doc).agg(F.count("*").alias("event_count"), F.max_by(kind, F.struct(at, tie)).alias("last_type"), F.max(at).alias("last_at"))


def capped_timeline(events: DataFrame, doc: str, at: str, kind: str, tie: str, actor: str, keep: int = 499) -> DataFrame:
    """The newest `keep` events of every document and one marker that counts the dropped ones and takes over the last
    actor among them that is not the system."""
    w = Window.partitionBy(doc).orderBy(F.desc(at), F.desc(tie))
    ranked = events.withColumn("_r", F.row_number().over(w))
    kept = ranked.where(F.col("_r") <= keep).select(doc, at, kind, actor, F.lit(None).cast("long").alias("dropped_count"))
    marker = ranked.where(F.col("_r") > keep).groupBy(doc).agg(F.max(at).alias(at), F.count("*").alias("dropped_count"), F.max_by(F.when(F.col(actor) != "system", F.col(actor)), F.when(F.col(actor) != "system", F.struct(at, tie))).alias(actor))
    return kept.unionByName(marker.select(doc, at, F.lit("timeline_truncated").alias(kind), F.coalesce(actor, F.lit("system")).alias(actor), "dropped_count"))


def review_outcome(ai_ran: Column, failed: Column, review: Column) -> Column:
    """Null unless an AI review ran."""
    return F.when(ai_ran & (failed > 0), "has_fail").when(ai_ran & (review > 0), "needs_review").when(ai_ran, "clean")


def origin(source_type: Column, has_mail: Column) -> Column:
    return F.when(has_mail | (source_type == "gmail"), "inbound").when(source_type.isin("generated", "template"), "outbound").when(source_type == "upload", "uploaded")


def signed(status: Column) -> Column:
    """Three-valued: null where the status does not tell."""
    return F.when(status.isin("fully_signed", "executed"), True).when(status.isin("awaiting_counterparty", "signature_voided", "signature_declined"), False)


def mutuality_facet(one_way: Column, strong: Column) -> Column:
    """one_way if any paragraph is, else mutual if any binds both, else null: weak words and roles tell nothing. Arrays of ids, in which
    blank ones do not count."""
    some = lambda ids: F.coalesce(F.exists(ids, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(False))
    return F.when(some(one_way), "one_way").when(some(strong), "mutual")


def origin(source: Column, has_mail: Column) -> Column:
    """Whether a document was generated here or received; null where the source does not tell."""
    token = F.lower(F.trim(F.coalesce(source, F.lit(""))))
    return F.when(token.isin("generated", "send_document"), "generated").when(token.startswith("gmail") | token.isin("manual_upload", "upload", "email") | F.coalesce(has_mail, F.lit(False)), "received")


def clause_ids(passed: Column, review: Column, check: Column) -> Column:
    return F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in (passed, review, check)]))


def grounding(decision: Column, issue: Column, has_quote: Column) -> Column:
    """grounded with a quote, absence where a missing clause is the finding, else ungrounded; null for a pass."""
    return F.when(decision == "pass", None).when(has_quote, "grounded").when(issue == "missing", "absence").otherwise("ungrounded")


def downgraded(decision: Column, ground: Column) -> Column:
    return F.when((decision == "fail") & (ground == "ungrounded"), "review").otherwise(decision)


def stale_reasons(engine: Column, engine_now: Column, rules: Column, rules_now: Column, has_clauses: Column, has_state: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(~engine.eqNullSafe(engine_now), "engine_version_changed"), F.when(~F.coalesce(has_clauses, F.lit(False)), "missing_clauses"), F.when(~F.coalesce(has_state, F.lit(False)), "missing_review_state"), F.when(~rules.eqNullSafe(rules_now), "rule_set_changed")
        )
    )


def approval_blocks(stale: Column) -> Column:
    """The only block is a stale rule set."""
    return F.when(F.array_contains(stale, "rule_set_changed"), F.array(F.lit("stale_playbook"))).otherwise(F.array().cast("array<string>"))


def label_metrics(rows: DataFrame, clause: str, label: str, system: str) -> DataFrame:
    """Per clause: totals, matches, accuracy (0 if empty), fails that the system passed and passes that it failed."""
    return rows.groupBy(clause).agg(
        F.count("*").alias("total"),
        F.count_if(F.col(label) == F.col(system)).alias("correct"),
        F.count_if((F.col(label) == "fail") & (F.col(system) == "pass")).alias("false_clears"),
        F.count_if((F.col(label) == "pass") & (F.col(system) == "fail")).alias("false_flags"),
    ).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)))


def top_reasons(rows: DataFrame, reason: str, position: str, k: int = 3) -> DataFrame:
    """The k most frequent reasons, ties by first appearance, empty ones left out."""
    return rows.where(F.coalesce(F.col(reason), F.lit("")) != "").groupBy(reason).agg(F.count("*").alias("n"), F.min(position).alias("_first")).orderBy(F.desc("n"), "_first").limit(k).drop("_first")


def rule_set_hash(rules: DataFrame, *cols: str) -> DataFrame:
    """One digest of a rule table (small by nature), whatever its order."""
    return rules.select(F.to_json(F.struct(*cols)).alias("x")).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("x"))), 256).alias("etag"))


def tallies(clauses: DataFrame, doc: str, decision: str) -> DataFrame:
    """(doc, passed, failed, needs_review): a document's clauses by their decisions."""
    of = lambda d: F.count_if(F.col(decision) == d)
    return clauses.groupBy(doc).agg(of("pass").alias("passed"), of("fail").alias("failed"), of("review").alias("needs_review"))


def clause_counts(clauses: DataFrame, doc: str) -> DataFrame:
    return clauses.groupBy(doc).agg(F.count("*").alias("clauses"))


def primary_citations(evidence: DataFrame, doc: str, quote: str, order: list[str]) -> DataFrame:
    """(doc, quote): the first evidence by `order` that holds a quote; null if a document has none. One pass, nothing gathered."""
    first = F.min_by(F.col(quote), F.when(F.coalesce(F.col(quote), F.lit("")) != "", F.struct(*order)))
    return evidence.groupBy(doc).agg(first.alias("quote"))
