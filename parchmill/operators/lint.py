"""Checks of rule sets before they are published: each finds rows that break a rule, all of them over any number of books at once.

Books are tables: clauses (book, clause, engine, search_terms, template, fallback_wording, option_source, template_field, template_value,
preferred, prose), conditions (book, clause, field, position, id, decision, issue_type, description, redline_action), options
(book, clause, id, value, aliases). A violation is (book, clause, check, detail, severity). Ids are compared without case
and blanks at their ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ISSUE_TYPES = ("none", "missing", "present_but_wrong", "unclear")
REDLINE_ACTIONS = ("no_change", "replace_paragraph", "insert_after_paragraph", "delete_paragraph")
NEED_TEMPLATE = ("replace_paragraph", "insert_after_paragraph")
DECISIONS = ("pass", "fail", "review")
DECISION_OF = {"pass_conditions": "pass", "fail_conditions": "fail", "review_triggers": "review"}
APPROVED_PROSE = r"(?i)\bapproved\s+(?:options?|laws?|jurisdictions?)\b"

KEY = ["book", "clause"]


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def described(c: Column) -> Column:
    """A description's form for comparison: blanks squeezed, lower case, no marks at its ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " "), r"^[\s.,;:!?]+|[\s.,;:!?]+$", "")


def option_key(c: Column) -> Column:
    """The short id that an option's value gives."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), F.lit("")), F.lit("option"))


def _found(rows: DataFrame, check: str, detail: Column | str, severity: str = "error") -> DataFrame:
    return rows.select(*KEY, F.lit(check).alias("check"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"), F.lit(severity).alias("severity"))


def _prepared(clauses: DataFrame, conditions: DataFrame, options: DataFrame) -> DataFrame:
    """A row a clause with what the checks ask of its conditions and options."""
    has = lambda *fields: F.max(F.col("field").isin(*fields))
    c = conditions.groupBy(*KEY).agg(has("pass_conditions").alias("has_pass"), has("fail_conditions", "review_triggers").alias("has_flag"))
    named = text(F.col("value")) != ""
    o = options.where(named).groupBy(*KEY).agg(F.collect_set(text(F.col("value"))).alias("values"))  # one clause's options
    return clauses.join(c, KEY, "left").join(o, KEY, "left").withColumn("values", F.coalesce("values", F.array().cast("array<string>")))


def violations(clauses: DataFrame, conditions: DataFrame, options: DataFrame, native: list[str]) -> DataFrame:
    """All violations, each once. native: the clauses that have a check of their own, so that a book which has one of them must have
    all, none of them as a `dynamic` one."""
    book = _prepared(clauses, conditions, options)
    cond = conditions.withColumn("_id", text(F.col("id"))).withColumn("_label", F.when(F.col("_id") != "", F.col("_id")).otherwise(F.concat(F.lit("<"), "field", F.lit(" entry>"))))
    out = [
        _found(book.where(~F.coalesce("has_pass", F.lit(False))), "decision_space_coverage", "never passes"),
        _found(book.where(~F.coalesce("has_flag", F.lit(False))), "decision_space_coverage", "never flagged"),
    ]
    for field in ("id", "description", "decision", "issue_type"):
        out.append(_found(cond.where(text(F.col(field)) == ""), "condition_well_formed", F.concat("_label", F.lit(f": no {field}"))))
    for field, allowed in (("decision", DECISIONS), ("issue_type", ISSUE_TYPES), ("redline_action", REDLINE_ACTIONS)):
        bad = (text(F.col(field)) != "") & ~text(F.col(field)).isin(*allowed)
        out.append(_found(cond.where(bad), "condition_well_formed", F.concat("_label", F.lit(f": unknown {field} "), text(F.col(field)))))
    due = reduce(lambda a, kv: a.when(F.col("field") == kv[0], kv[1]), list(DECISION_OF.items())[1:], F.when(F.col("field") == "pass_conditions", "pass"))
    out.append(_found(cond.where(text(F.col("decision")).isin(*DECISIONS) & (text(F.col("decision")) != due)), "condition_well_formed", F.concat("_label", F.lit(": decision "), text(F.col("decision")), F.lit(" in "), "field")))
    again = cond.where("_id <> ''").groupBy(*KEY, F.lower("_id").alias("_low")).agg(F.count("*").alias("n"))
    out.append(_found(again.where("n > 1"), "condition_well_formed", F.concat(F.lit("id used again: "), "_low")))

    builds = (text(F.col("template")) != "") | ((F.size("values") > 0) & (text(F.col("option_source")) != "")) | (text(F.col("fallback_wording")) != "")
    needs = cond.where(F.col("field").isin("fail_conditions", "review_triggers") & text(F.col("redline_action")).isin(*NEED_TEMPLATE))
    out.append(_found(needs.join(book.where(~builds).select(*KEY), KEY), "redline_template_present", F.concat("_label", F.lit(": nothing to build "), text(F.col("redline_action")))))
    named = text(F.col("option_source")) != ""
    talks = text(F.col("prose")).rlike(APPROVED_PROSE)
    out.append(_found(book.where((named | talks) & (F.size("values") == 0)), "approved_options_present", F.when(named, "source without options").otherwise("prose without options")))
    out.append(_found(book.where((text(F.col("template_field")) != "") & (text(F.col("template_value")) == "")), "referential_integrity", F.concat(F.lit("no field "), text(F.col("template_field")))))
    out.append(_found(book.where(named & (F.size("values") == 0)), "referential_integrity", F.concat(F.lit("no options for "), text(F.col("option_source")))))
    out.append(_found(book.where((text(F.col("preferred")) != "") & (F.size("values") > 0) & ~F.array_contains("values", text(F.col("preferred")))), "referential_integrity", F.concat(F.lit("not approved: "), text(F.col("preferred")))))

    value = options.select(*KEY, text(F.col("id")).alias("_id"), text(F.col("value")).alias("_value"), "aliases").where("_value <> ''")
    derived = value.groupBy(*KEY, option_key(F.col("_value")).alias("_key")).agg(F.countDistinct("_value").alias("n"))
    out.append(_found(derived.where("n > 1"), "option_id_collision", F.concat(F.lit("values give one id: "), "_key")))
    given = value.where("_id <> ''").groupBy(*KEY, "_id").agg(F.countDistinct("_value").alias("n"))
    out.append(_found(given.where("n > 1"), "option_id_collision", F.concat(F.lit("id of several values: "), "_id")))
    alias = value.select(*KEY, F.lower("_value").alias("_owner"), F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("_value"))).alias("_alias"))
    shared = alias.withColumn("_alias", described(F.col("_alias"))).where("_alias <> ''").groupBy(*KEY, "_alias").agg(F.countDistinct("_owner").alias("n"))
    out.append(_found(shared.where("n > 1"), "law_alias_collision", F.concat(F.lit("shared: "), "_alias"), "warning"))

    # A term must leave something once characters that print nothing are gone.
    terms = F.filter(F.coalesce("search_terms", F.array().cast("array<string>")), lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"[\p{Cf}\p{Cc}\s]+", "") != "")
    out.append(_found(clauses.where(F.size(terms) == 0), "trigger_terms_present", "no term that prints"))
    state = cond.select(*KEY, "field", described(F.col("description")).alias("_state")).where("_state <> ''")
    sides = state.groupBy(*KEY, "_state").agg(F.max(F.col("field") == "pass_conditions").alias("passes"), F.max(F.col("field") != "pass_conditions").alias("flags"))
    out.append(_found(sides.where("passes and flags"), "condition_contradiction", F.concat(F.lit("passes and is flagged: "), "_state")))

    ids = clauses.where(text(F.col("clause")) != "").withColumn("_low", F.lower(text(F.col("clause"))))
    twice = ids.groupBy("book", "_low").agg(F.count("*").alias("n"), F.min("clause").alias("clause")).where("n > 1")
    out.append(_found(twice, "clause_id_uniqueness", F.concat(F.lit("id used again: "), "_low")))
    own = ids.where(F.col("_low").isin(*native)).withColumn("_dynamic", F.lower(text(F.col("engine"))) == "dynamic")
    out.append(_found(own.where("_dynamic"), "native_clause_inventory", "has a check of its own"))
    present = own.where("not _dynamic").groupBy("book").agg(F.collect_set("_low").alias("_have"))  # at most all of `native`
    missing = present.select("book", F.explode(F.array_except(F.array(*map(F.lit, sorted(native))), F.col("_have"))).alias("clause"))
    out.append(_found(missing, "native_clause_inventory", "missing"))
    return reduce(DataFrame.unionByName, out).distinct()
