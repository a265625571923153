"""Questions to a corpus: filter specifications, facets, groups, ranked search."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STATUSES = ("received", "extracting", "extracted", "ai_reviewing", "awaiting_human", "auto_cleared", "awaiting_approval", "approval_blocked", "approved", "awaiting_counterparty", "counter_received", "fully_signed")
PHASES = ("intake", "review", "approval", "sent", "negotiation", "executed")
OUTCOMES = ("clean", "needs_review", "has_fail")
SORTS = ("newest", "oldest")
SPEC_KEYS = ("status", "phase", "governing_law", "review_outcome", "signed", "has_issues", "needs_attention", "term_years", "min_age_days", "restraint", "text", "sort")


def validated(spec: dict | None) -> dict:
    """A specification with every dimension: unknown keys ignored, values outside their list null, numbers clamped,
    booleans strict, NaN and infinities null, texts trimmed and capped."""
    given = spec if isinstance(spec, dict) else {}

    def choice(key, allowed):
        v = given.get(key)
        v = v.strip().lower() if isinstance(v, str) else None
        return v if v in allowed else None

    def number(key, low, high):
        v = given.get(key)
        if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
            return None
        return min(max(int(v), low), high)

    def text(key, most=200):
        v = given.get(key)
        return (v.strip()[:most] or None) if isinstance(v, str) else None

    flag = lambda key: given.get(key) if isinstance(given.get(key), bool) else None
    return {
        "status": choice("status", STATUSES), "phase": choice("phase", PHASES), "governing_law": text("governing_law"), "review_outcome": choice("review_outcome", OUTCOMES),
        "signed": flag("signed"), "has_issues": flag("has_issues"), "needs_attention": flag("needs_attention"), "term_years": number("term_years", 1, 100), "min_age_days": number("min_age_days", 1, 365),
        "restraint": text("restraint"), "text": text("text"), "sort": choice("sort", SORTS),
    }


def has_issues(ai_ran: Column, failed: Column, review: Column) -> Column:
    return F.coalesce(ai_ran & ((failed > 0) | (review > 0)), F.lit(False))


def all_terms(haystack: Column, text: str) -> Column:
    """Every term of the text is somewhere in the haystack."""
    return reduce(lambda a, b: a & b, [F.contains(F.lower(haystack), F.lit(t)) for t in text.lower().split()], F.lit(True))


def matches(spec: dict, fields: dict[str, Column], haystack: Column, empty_matches_all: bool = True) -> Column:
    """The specification as a predicate over a matter's fields; a field that is unknown never matches. `fields` may leave
    dimensions out, which then match nothing."""
    use = {k: v for k, v in validated(spec).items() if v is not None and k not in ("sort", "text")}
    text = validated(spec)["text"]
    if not use and text is None:
        return F.lit(empty_matches_all)
    parts = []
    for key, value in use.items():
        c = fields.get(key, F.lit(None))
        if key == "min_age_days":
            parts.append(F.coalesce(c >= value, F.lit(False)))
        elif key == "restraint":
            parts.append(F.coalesce(F.array_contains(c, value), F.lit(False)))
        else:
            parts.append(F.coalesce(c == F.lit(value), F.lit(False)))
    if text is not None:
        parts.append(F.coalesce(all_terms(haystack, text), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def described(spec: dict) -> str:
    """The specification in words."""
    use = {k: v for k, v in validated(spec).items() if v is not None}
    return "; ".join(f"{k.replace('_', ' ')}: {'yes' if v is True else 'no' if v is False else v}" for k, v in use.items()) or "everything"


def spec_from_text(query: str) -> dict:
    """A plain question as a specification, by phrases: status, phase, flags, term, age, order and what is left as text."""
    import re

    low, spec = " ".join(query.lower().split()), {}
    phrases = [("fully signed", "status", "fully_signed"), ("awaiting approval", "status", "awaiting_approval"), ("auto cleared", "status", "auto_cleared"), ("in review", "phase", "review"), ("in negotiation", "phase", "negotiation"), ("unsigned", "signed", False), ("not signed", "signed", False), ("signed", "signed", True), ("with issues", "has_issues", True), ("no issues", "has_issues", False), ("needs attention", "needs_attention", True), ("newest", "sort", "newest"), ("latest", "sort", "newest"), ("oldest", "sort", "oldest")]
    for phrase, key, value in phrases:
        if key not in spec and re.search(rf"\b{phrase}\b", low):
            spec[key] = value
            low = re.sub(rf"\b{phrase}\b", " ", low)
    if m := re.search(r"\bolder than (\d+) (day|week|month)s?\b", low):
        spec["min_age_days"] = int(m[1]) * {"day": 1, "week": 7, "month": 30}[m[2]]
        low = low.replace(m[0], " ")
    if m := re.search(r"\b(\d+)[- ]years?(?: terms?)?\b", low):
        spec["term_years"] = int(m[1])
        low = low.replace(m[0], " ")
    from parchmill.functions.text import STOP_WORDS

    rest = [w for w in re.findall(r"[\w'-]+", low) if len(w) > 1 and w not in STOP_WORDS and w not in ("ndas", "nda", "documents", "matters", "many", "all")]
    return validated(spec | ({"text": " ".join(rest)} if rest else {}))


def corpus_count(rows: DataFrame, predicate: Column) -> DataFrame:
    return rows.agg(F.count_if(predicate).alias("matching"), F.count("*").alias("total"))


def _entry(name: str):
    return lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value"))


def facet_rows(rows: DataFrame, ident: str, scalars: list[str], lists: list[str] = ()) -> DataFrame:
    """(id, facet, value): null and empty values left out, a list's value once a row."""
    entries = [F.array(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))) for c in scalars]
    entries += [F.transform(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))), _entry(c)) for c in lists]
    return rows.select(ident, F.explode(F.concat(*entries)).alias("e")).select(ident, "e.facet", "e.value").where("value is not null and value <> ''")


def facet_counts(rows: DataFrame, ident: str, scalars: list[str], lists: list[str] = ()) -> DataFrame:
    return facet_rows(rows, ident, scalars, lists).groupBy("facet", "value").agg(F.count("*").alias("matters"))


def faceted(chosen: dict[str, list[str]], lists: tuple[str, ...] = ()) -> Column:
    """All keys, any value of a key."""
    parts = [F.coalesce(F.arrays_overlap(F.col(k), F.array(*map(F.lit, v))) if k in lists else F.col(k).cast("string").isin(*v), F.lit(False)) for k, v in chosen.items() if v]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def grouped(rows: DataFrame, party: str, ident: str, order: str, members: int = 100) -> DataFrame:
    """One row a party: how many matters and its newest `members`; a listing's page, so the array is bounded."""
    from pyspark.sql import Window

    w = Window.partitionBy(party).orderBy(F.desc(order), F.desc(ident))
    ranked = rows.select(party, ident, order).withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(party).agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.when(F.col("_r") <= members, F.struct("_r", ident)))), lambda x: x[ident]).alias("newest"))


def ranked(rows: DataFrame, ident: str, title: str, fields: list[str], terms: list[str], k: int = 8, bonus: int = 3, extra: int = 0) -> DataFrame:
    """The k best rows by matched terms (a bonus if all match), ties by title and id. A top-k: nothing else is sorted."""
    text = F.lower(F.concat_ws(" ", *fields))
    hit = reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])
    score = hit + F.when(hit == len(terms), bonus).otherwise(0) + F.when(hit > 0, extra).otherwise(0)
    return rows.select(ident, title, score.alias("score")).where("score > 0").orderBy(F.desc("score"), title, ident).limit(k)


def best_match(rows: DataFrame, ident: str, fields: list[str], terms: list[str], exact: str | None = None) -> DataFrame:
    """The single best row: 3 a term, 4 more for all, 100 for the exact id; no row if the best is shared."""
    text = F.lower(F.concat_ws(" ", *fields))
    hit = reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms], F.lit(0))
    score = 3 * hit + F.when((hit == len(terms)) & (F.lit(len(terms)) > 0), 4).otherwise(0) + (F.when(F.col(ident).cast("string") == exact, 100).otherwise(0) if exact else F.lit(0))
    scored = rows.select(ident, score.alias("score")).where("score > 0")
    best = scored.groupBy("score").agg(F.count("*").alias("n"), F.min(ident).alias(ident)).orderBy(F.desc("score")).limit(1)
    return best.where("n = 1").select(ident, "score")


def recency(received: Column, created: Column, updated: Column) -> Column:
    return F.coalesce(received, created, updated, F.timestamp_seconds(F.lit(0)))


def severity(decision: Column) -> Column:
    return F.when(decision == "fail", 0).when(decision == "review", 1).when(decision == "pass", 2).otherwise(3)


def exclusion_reason(owner: Column, wanted: str, active: Column, created: Column, after: Column, before: Column, human_events: Column) -> Column:
    """Why a row is not eligible for bulk archiving; null if it is. Unknown values exclude."""
    return (
        F.when(~F.coalesce(owner == wanted, F.lit(False)), "other_owner")
        .when(created.isNull(), "unknown_date")
        .when(created < after, "too_old")
        .when(created >= before, "too_new")
        .when(F.coalesce(active, F.lit(True)), "active")
        .when(F.coalesce(human_events, F.lit(True)), "human_activity")
    )


def selection_hash(selected: DataFrame, owner: str, ident: str, limit: int = 200) -> DataFrame:
    """A digest of the first `limit` selected ids, to hold a dry run against the real one."""
    first = selected.select(F.col(ident).cast("string").alias("i")).orderBy("i").limit(limit)
    return first.agg(F.sha2(F.concat_ws("\n", F.lit(owner), F.array_sort(F.collect_list("i"))), 256).alias("selection_hash"), F.count("*").alias("selected"))


def by_first_appearance(rows: DataFrame, key: str, ident: str, last: str) -> DataFrame:
    """(key, n, place): groups in the order in which they first appear, the one named `last` behind all others. Groups are counted
    first; the order is one over groups."""
    from pyspark.sql import Window

    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(ident).alias("_first"))
    return g.select(key, "n", F.row_number().over(Window.orderBy(F.col(key) == last, "_first")).cast("long").alias("place"))


def phase_count(rows: DataFrame, phase: Column, wanted: str) -> DataFrame:
    """One row: how many matters are in a phase."""
    return rows.agg(F.count_if(phase == wanted).alias("matters"))


def last_sent(rows: DataFrame, at: str, ident: str) -> DataFrame:
    """The row that was sent last, the least id of equal ones; none if nothing was sent."""
    return rows.where(F.col(at).isNotNull()).orderBy(F.desc(at), ident).limit(1)


def with_status(rows: DataFrame, status: Column, wanted: str | None) -> DataFrame:
    """What a status chip leaves; all rows without one."""
    return rows if wanted is None else rows.where(F.coalesce(status == wanted, F.lit(False)))


def confirmed(chosen: DataFrame, rows: DataFrame, predicate: Column, ident: str) -> DataFrame:
    """The distinct ids that were confirmed and still fulfil the predicate."""
    return chosen.select(ident).intersect(rows.where(predicate).select(ident))
