"""Structure, concepts and clause checks over the agreements composed from the orders. The SQL says from the columns what stands in
an agreement; `tests/clause_texts` holds the same functions against seven written texts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.functions import text as X
from parchmill.operators import clauses as C
from parchmill.operators import concepts as N
from parchmill.operators import corpus
from parchmill.operators import structure as S
from parchmill.plans.agreements import WITH, agreements
from parchmill.session import read_table, settled, shuffle_width

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def joined(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


def docs(spark, d):
    return settled(agreements(spark, d), "agreements")


def parts(spark, d):
    return S.paragraphs(agreements(spark, d))


#: Words that paragraphs are marked by: those of citations first, then those of each concept.
WORDS = [S.KIND_WORDS, *N.CONCEPT_WORDS.values()]


def outlines(spark, d, *fields, words=None):
    """(paragraphs, sections), a row an agreement; fields: what the sections are to have."""
    return S.outlines(agreements(spark, d), fields=fields, words=words)


def sections(spark, d, *fields):
    return S.opened(outlines(spark, d, *fields), F.col("sections"), "ordinal")


#: What of the sections resolving a citation reads.
CITABLE = ("ordinal", "kind", "number", "paragraphs")


def cited(spark, d, *fields):
    """Agreements with their citations (`refs`) as rows' lists, and whether a citation is its own section's heading."""
    return outlines(spark, d, *CITABLE, *fields, words=WORDS[:1]).withColumn("refs", S.resolved_list(F.col("paragraphs"), F.col("sections"), 0))


def refs(spark, d):
    return S.opened(cited(spark, d), F.col("refs"), "kind")


@query("t4_paragraphs", r"""WITH p AS (SELECT doc_id, unnest(CASE WHEN regexp_matches(text, '\n\s*\n') THEN regexp_split_to_array(text, '\n\s*\n+') ELSE regexp_split_to_array(text, '\n+') END) AS piece, generate_subscripts(CASE WHEN regexp_matches(text, '\n\s*\n') THEN regexp_split_to_array(text, '\n\s*\n+') ELSE regexp_split_to_array(text, '\n+') END, 1) AS i FROM documents)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS index, trim(piece, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS text FROM p WHERE regexp_matches(piece, '\S')""")
def t4(spark, d):
    return S.paragraphs(read_table(spark, d, "documents").select("doc_id", "text").repartition(shuffle_width(spark))).select("doc_id", "index", "text")


@query("t5_alignment", WITH + "SELECT k AS doc_id, 'p' || i AS id, start, start + length(text) AS end FROM p")
def t5(spark, d):
    whole = docs(spark, d)
    return S.aligned(S.paragraphs(whole).select("doc_id", "index", "text"), whole).select("doc_id", "id", "start", "end")


@query("t10_continuation", WITH + "SELECT k AS doc_id, i AS index FROM p WHERE kind IN ('h1', 'h2', 'line', 'h4', 'term', 'h5', 'leaflet1', 'leaflet3') OR (kind = 'h3' AND k % 19 <> 0)")
def t10(spark, d):
    return S.continued(parts(spark, d)).where("is_heading").select("doc_id", "index")


#: Every written form of a subject with the party that it names, for a reader whose own names are Ownco and Ownco Money; {} is a customer's name.
SUBJECTS = [
    ("{}", "{}"), ("Fwd: {} <> Ownco", "{}"), ("Fwd: Ownco - {} - Introduction - Sponsorship", "{}"), ("Fwd: Ownco | {} Follow Up", "{}"), ("Fwd: CALL: Ownco x {}", "{}"), ("Fwd: {} Ownco", "{} Ownco"),
    ("Fwd: {} - Ownco", "{}"), ("Fwd: Updated invitation: Ownco <> {} @ Wed May 13, 2026 7:30pm - 8:00pm", "{}"), ("Fwd: {} | Ownco Connect: Ann<>Neil", "{}"), ("Re: Fwd: Ownco x {} - follow up", "{}"), ("RE: NDA - Ownco and {}", "{}"),
    ("Fwd: Ownco <> Ownco Money", "Ownco <> Ownco Money"), ("{} <> Ownco <> Beam Pay", "{}"), ("Owncolike{} Inc", "Owncolike{} Inc"), ("Fwd: Owncolike{} <> Ownco", "Owncolike{}"), ("Fwd: {} – Ownco", "{}"), ("Fwd: {} / Ownco", "{}"),
    ("NDA between {} and Globe", "NDA between {} and Globe"), ("Ownco|{}", "{}"), ("vs Ownco", "vs Ownco"), ("Fwd: Ownco <>", "Ownco <>"), ("Ownco", "Ownco"), ("Fwd:", ""), ("Re: Re: Fwd:", ""), ("", ""), ("   ", ""), (None, ""),
]
SUBJECT_SQL = f"""SELECT c_custkey, form, coalesce(replace(named, '{{}}', c_name), '') AS party FROM customer, (VALUES {", ".join(f"(CAST({k} AS INT), '{party}')" for k, (_, party) in enumerate(SUBJECTS))}) AS forms(form, named)"""


@query("t13_subject_party", SUBJECT_SQL)
def t13(spark, d):
    forms = F.posexplode(F.array(*[F.lit(subject).cast("string") for subject, _ in SUBJECTS])).alias("form", "subject")
    rows = read_table(spark, d, "customer").repartition(shuffle_width(spark), "c_custkey").select("c_custkey", "c_name", forms)
    return rows.select("c_custkey", "form", X.subject_party(F.replace("subject", F.lit("{}"), F.col("c_name")), ["Ownco", "Ownco Money"]).alias("party"))


FRAGMENT_SQL = """WITH l AS (SELECT l_suppkey AS doc_id, l_returnflag AS flag, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INT) AS index FROM lineitem),
t AS (SELECT *, CASE flag WHEN 'A' THEN 'The part ends.' WHEN 'R' THEN 'Then it starts' ELSE 'and goes on' END AS text, lag(flag) OVER (PARTITION BY doc_id ORDER BY index) AS before FROM l),
c AS (SELECT *, sum(CASE WHEN flag = 'N' AND before <> 'A' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY index) AS chain FROM t),
g AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, chain ORDER BY index) - 1) // 6 AS run FROM c)
SELECT doc_id, min(index) AS index, string_agg(CAST(index AS VARCHAR), ',' ORDER BY index) AS members, string_agg(text, ' ' ORDER BY index) AS text FROM g GROUP BY doc_id, chain, run"""


@query("t18_fragments", FRAGMENT_SQL)
def t18(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    text = F.when(F.col("l_returnflag") == "A", "The part ends.").when(F.col("l_returnflag") == "R", "Then it starts").otherwise("and goes on")
    rows = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.row_number().over(order).alias("index"), text.alias("text"))
    return S.merged_fragments(rows).select("doc_id", "index", joined("members"), "text")


@query("t20_reading_order", "SELECT page_id % 40 AS doc, CASE WHEN bool_or(length(html) % 11 = 0) THEN least(min((page_id % 10) / 10.0), 0.3) ELSE min((page_id % 10) / 10.0) END AS confidence, max(length(url) % 4) AS columns, bool_or(length(html) % 11 = 0) AS garbled, CASE WHEN bool_or(length(html) % 11 = 0) THEN least(min((page_id % 10) / 10.0), 0.3) ELSE min((page_id % 10) / 10.0) END < 0.8 AS degraded FROM pages GROUP BY 1")
def t20(spark, d):
    pages = read_table(spark, d, "pages").select((F.col("page_id") % 40).alias("doc"), ((F.col("page_id") % 10) / F.lit(10.0)).alias("c"), (F.length("url") % 4).cast("long").alias("n"), (F.length("html") % 11 == 0).alias("g"))
    return S.reading_order(pages, "doc", "c", "n", "g")


ROLE = "CASE WHEN kind = 'heading' AND ordinal = 1 THEN 'recital' WHEN kind = 'heading' THEN CASE WHEN k % 4 = 0 THEN 'signature' ELSE 'body' END WHEN number = '1' AND head = 'Definitions' THEN 'definitions' WHEN head IN ('Confidentiality', 'Governing Law') OR number LIKE '3.%' THEN 'operative' ELSE 'body' END"


@query("c1_sections", WITH + "SELECT k AS doc_id, ordinal, kind, number, head AS heading, CASE WHEN number LIKE '%.%' THEN 2 ELSE 1 END AS level, CASE WHEN kind = 'heading' THEN 'medium' ELSE 'high' END AS confidence, array_to_string(range(first, last + 1), ',') AS paragraphs FROM s")
def c1(spark, d):
    return sections(spark, d, "ordinal", "kind", "number", "heading", "level", "confidence", "paragraphs").select("doc_id", "ordinal", "kind", "number", "heading", "level", "confidence", joined("paragraphs"))


@query("c2_parents", WITH + "SELECT k AS doc_id, ordinal, CASE WHEN number LIKE '3.%' THEN 4 WHEN number = '4.1' THEN ordinal - 1 END AS parent FROM s")
def c2(spark, d):
    return S.opened(outlines(spark, d, "ordinal", "number"), S.parent_list(F.col("sections")), "ordinal")


@query("c3_roles", WITH + f"SELECT k AS doc_id, ordinal, {ROLE} AS role FROM s")
def c3(spark, d):
    return sections(spark, d, "ordinal", "role")


@query("c4_aliases", WITH + "SELECT k AS doc_id, a || ':' || number AS alias, CASE WHEN count(*) = 1 THEN min(ordinal) END AS ordinal, count(*) > 1 AS ambiguous FROM s, (SELECT unnest(['number', 'section']) AS a) WHERE number IS NOT NULL GROUP BY k, a, number")
def c4(spark, d):
    return S.opened(outlines(spark, d, "ordinal", "kind", "number"), S.alias_list(F.col("sections")), "alias")


@query("c5_demotion", WITH + "SELECT k AS doc_id, s.ordinal FROM s JOIN o USING (k) WHERE leaflet")
def c5(spark, d):
    return S.opened(outlines(spark, d, "ordinal", "kind", "confidence", "body"), S.demoted_list(F.col("sections")), "ordinal").where("confidence = 'low'").select("doc_id", "ordinal")


@query("c6_references", WITH + "SELECT k AS doc_id, 'p' || i AS paragraph, kind, number, own AS opening FROM cited")
def c6(spark, d):
    return S.references(parts(spark, d))


@query("c7_resolution", WITH + "SELECT k AS doc_id, 'p' || i AS paragraph, kind, number, ordinal, ambiguous FROM found WHERE NOT own")
def c7(spark, d):
    return refs(spark, d).where("not own").drop("opening", "own")


@query("c8_status", WITH + "SELECT k AS doc_id, 'p' || i AS paragraph, kind, CASE count(ordinal) WHEN count(*) THEN 'resolved' WHEN 0 THEN 'unresolved' ELSE 'partial' END AS status FROM found WHERE NOT own GROUP BY k, i, kind")
def c8(spark, d):
    return S.reference_status(refs(spark, d).where("not own"))


@query("c9_dangling", WITH + "SELECT k AS doc_id, count(*) FILTER (WHERE ordinal IS NULL AND NOT ambiguous) AS dangling, count(*) FILTER (WHERE ambiguous) AS ambiguous FROM found GROUP BY k")
def c9(spark, d):
    found = cited(spark, d).select("doc_id", F.inline_outer(F.array(S.dangling_of(F.col("refs"), F.col("sections")))))
    return found.where("dangling is not null")


#: tag: what a reader finds in a paragraph, (k, i, kind, concept, place in the list of concepts).
TAG = """, tag AS (SELECT p.k, i, p.kind, unnest(CASE p.kind WHEN 'title' THEN CASE WHEN p.k % 5 = 0 THEN ['mutuality'] ELSE [] END WHEN 'recital' THEN ['governing_law'] WHEN 'h5' THEN ['governing_law'] WHEN 'law' THEN CASE WHEN law <> 5 THEN ['governing_law'] ELSE [] END
  WHEN 'definition' THEN CASE pri WHEN 5 THEN [] WHEN 2 THEN ['confidential_information_definition'] ELSE ['confidential_information_definition', 'confidential_information_exclusion'] END WHEN 'duty' THEN CASE st WHEN 'F' THEN ['mutuality', 'confidentiality_obligation'] ELSE [] END
  WHEN 'h4' THEN ['term_or_survival'] WHEN 'term' THEN CASE WHEN p.k % 7 = 3 THEN ['trade_secret_or_legal_carveout'] ELSE [] END WHEN 'signature' THEN ['execution'] ELSE [] END) AS concept FROM p JOIN o USING (k)),
place AS (SELECT unnest(['mutuality', 'confidential_information_definition', 'confidential_information_exclusion', 'confidentiality_obligation', 'term_or_survival', 'trade_secret_or_legal_carveout', 'governing_law', 'execution']) AS concept, unnest(range(8)) AS nth),
own AS (SELECT DISTINCT s.k, s.ordinal, concept FROM tag JOIN s ON s.k = tag.k AND i BETWEEN first AND last JOIN o ON o.k = s.k WHERE NOT leaflet) """


@query("c10_concepts", WITH + TAG + "SELECT p.k AS doc_id, 'p' || p.i AS id, coalesce(string_agg(tag.concept, ',' ORDER BY nth), '') AS concepts FROM p LEFT JOIN tag ON tag.k = p.k AND tag.i = p.i LEFT JOIN place ON place.concept = tag.concept GROUP BY p.k, p.i")
def c10(spark, d):
    return N.tagged(parts(spark, d)).select("doc_id", "id", joined("concepts"))


def tagged_outlines(spark, d, *fields):
    """Outlines with the concepts of their paragraphs (`tags`)."""
    return outlines(spark, d, "ordinal", "heading", "confidence", "paragraphs", *fields, words=WORDS).withColumn("tags", F.transform("paragraphs", lambda p: N.concepts(p["text"], p["marks"], 1)))


def section_tags():
    return N.section_concept_list(F.col("sections"), F.col("tags"), F.col("paragraphs"), 1)


@query("c11_section_concepts", WITH + TAG + "SELECT k AS doc_id, ordinal, string_agg(concept, ',' ORDER BY concept) AS concepts FROM own GROUP BY k, ordinal")
def c11(spark, d):
    rows = tagged_outlines(spark, d)
    return S.opened(rows, section_tags(), "ordinal").select("doc_id", "ordinal", joined("concepts"))


@query("c12_concept_counts", WITH + TAG + "SELECT concept, count(*) AS n FROM (SELECT concept FROM tag UNION ALL SELECT concept FROM own) GROUP BY 1")
def c12(spark, d):
    rows = tagged_outlines(spark, d)
    of_sections = F.transform(section_tags(), lambda r: r["concepts"])
    return N.concept_counts(rows.select(F.explode_outer(F.concat("tags", of_sections)).alias("concepts")))


@query("c13_by_concept", WITH + TAG + "SELECT DISTINCT k AS doc_id, 'p' || i AS id FROM tag WHERE concept IN ('governing_law', 'execution')")
def c13(spark, d):
    return N.with_concepts(N.tagged(parts(spark, d)), ["governing_law", "execution"]).select("doc_id", "id")


@query("c14_merged_groups", WITH + TAG + "SELECT k AS doc_id, 'p' || i AS id, min(CASE concept WHEN 'governing_law' THEN 0 WHEN 'mutuality' THEN 1 ELSE 2 END) AS place FROM tag WHERE concept IN ('governing_law', 'mutuality', 'confidentiality_obligation') GROUP BY k, i")
def c14(spark, d):
    t = settled(N.tagged(parts(spark, d)), "tags")
    return N.merged([N.with_concepts(t, [c]) for c in ("governing_law", "mutuality", "confidentiality_obligation")]).select("doc_id", "id", F.col("group").alias("place"))


@query("c15_localisation", WITH + "SELECT k AS doc_id, CASE head WHEN 'Governing Law' THEN 'law' WHEN 'Term' THEN 'term' ELSE 'parties' END AS clause, ordinal FROM s WHERE head IN ('Governing Law', 'Term', 'SIGNED FOR THE PARTIES')")
def c15(spark, d):
    cues = {"law": ["governing law", "law"], "term": ["term"], "parties": ["parties"]}
    return S.opened(outlines(spark, d, "ordinal", "heading"), S.localised_list(F.col("sections"), cues, most=1), "clause")


@query("k1_paragraph_match", WITH + "SELECT k AS doc_id, 'p' || i AS id FROM p JOIN o USING (k) WHERE kind = 'duty' AND st = 'F'")
def k1(spark, d):
    return C.paragraph_matches(parts(spark, d), C.RULES["strong_mutual"]).select("doc_id", "id")


@query("k2_hit_count", WITH + "SELECT k AS doc_id, 'p' || i AS id, CASE WHEN kind IN ('recital', 'h5') OR (kind = 'law' AND law <> 5) OR (kind = 'term' AND k % 11 = 0) THEN 1 ELSE 0 END AS hits FROM p JOIN o USING (k)")
def k2(spark, d):
    return parts(spark, d).select("doc_id", "id", C.hit_count(F.col("text"), [C.RULES["indefinite"], r"\blaws?\b"]).alias("hits"))


@query("k3_evidence", WITH + "SELECT k AS doc_id, 'p' || i AS id, CASE kind WHEN 'h5' THEN 'law' ELSE 'Confidential Information' END AS term, start + CASE kind WHEN 'h5' THEN 13 ELSE 0 END AS start FROM p JOIN o USING (k) WHERE kind = 'h5' OR (kind = 'definition' AND pri < 5)")
def k3(spark, d):
    found = C.evidence_spans(parts(spark, d), ["Confidential Information", "law"])
    return found.select("doc_id", "id", F.explode("evidence").alias("e")).select("doc_id", "id", "e.term", "e.start")


MUTUAL = "CASE WHEN leaflet THEN 'not_present' WHEN st = 'F' THEN 'match' WHEN st = 'O' THEN 'check' ELSE 'review' END"
SECRET = "CASE WHEN leaflet OR pri = 5 THEN 'not_present' WHEN pri = 1 THEN 'match' WHEN pri = 3 THEN 'check' ELSE 'review' END"
GOVERNED = "CASE WHEN leaflet THEN 'not_present' WHEN law IN (0, 1, 4) THEN 'match' WHEN law = 2 THEN 'check' ELSE 'review' END"
LASTS = "CASE WHEN leaflet THEN 'not_present' WHEN k % 11 = 0 OR q > 5 THEN 'check' ELSE 'match' END"
MARKS = "CASE WHEN leaflet OR k % 4 > 1 THEN 'not_present' WHEN k % 4 = 0 THEN 'match' ELSE 'check' END"


@query("k4_mutuality", WITH + f"SELECT k AS doc_id, {MUTUAL} AS status FROM o")
def k4(spark, d):
    return C.mutuality(docs(spark, d))


@query("k5_confidential_information", WITH + f"SELECT k AS doc_id, {SECRET} AS status, CAST(CASE WHEN leaflet THEN 0 ELSE CASE pri WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 4 THEN 4 ELSE 0 END + CASE WHEN k % 7 = 3 THEN 1 ELSE 0 END END AS INT) AS coverage, NOT leaflet AND pri = 3 AS poisoned, NOT leaflet AND pri = 4 AS unqualified FROM o")
def k5(spark, d):
    return C.confidential_information(docs(spark, d))


@query("k6_independent_development", WITH + "SELECT k AS doc_id, NOT leaflet AND pri = 4 AS unqualified FROM o")
def k6(spark, d):
    return docs(spark, d).select("doc_id", C.unqualified_development(F.col("text")).alias("unqualified"))


LAW_NAMED = "SELECT k AS doc_id, CASE law WHEN 0 THEN 'england and wales' WHEN 1 THEN 'delaware' WHEN 2 THEN 'norway' WHEN 3 THEN 'a place to be agreed' ELSE 'ontario' END AS law{} FROM o WHERE NOT leaflet AND law <> 5"


@query("k7_law_values", WITH + LAW_NAMED.format(""))
def k7(spark, d):
    return docs(spark, d).select("doc_id", F.explode(C.law_candidates(F.col("text"))).alias("law"))


@query("k8_law_buckets", WITH + LAW_NAMED.format(", CASE law WHEN 2 THEN 'unapproved' WHEN 3 THEN 'unclear' ELSE 'approved' END AS bucket"))
def k8(spark, d):
    return docs(spark, d).select("doc_id", F.explode(C.law_candidates(F.col("text"))).alias("law")).withColumn("bucket", C.law_bucket(F.col("law")))


@query("k9_governing_law", WITH + f"SELECT k AS doc_id, {GOVERNED} AS status FROM o")
def k9(spark, d):
    return C.governing_law(docs(spark, d)).select("doc_id", "status")


@query("k10_recitals", WITH + "SELECT k AS doc_id, string_agg(CASE WHEN kind = 'recital' THEN split_part(text, 'incorporated', 1) || ' .' ELSE text END, chr(10) || chr(10) ORDER BY i) AS text FROM p GROUP BY k")
def k10(spark, d):
    return docs(spark, d).select("doc_id", C.stripped_recitals(F.col("text")).alias("text"))


TERM = """, t AS (SELECT k, CAST(q AS DOUBLE) AS years, start + length('4.1. The duties last ') AS start, CASE k % 3 WHEN 0 THEN 7 WHEN 1 THEN 7 + length(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][q]) + 3 ELSE length(CAST(q * 12 AS VARCHAR)) + 7 END AS size, FALSE AS carved FROM p JOIN o USING (k) WHERE kind = 'term' AND k % 11 <> 0
UNION ALL SELECT k, 20.0, start + length(text) - 9, 8, TRUE FROM p WHERE kind = 'term' AND k % 7 = 3) """


@query("k11_year_terms", WITH + TERM + "SELECT k AS doc_id, years, CAST(start AS INT) AS start, CAST(start + size AS INT) AS end FROM t")
def k11(spark, d):
    return docs(spark, d).select("doc_id", F.explode(C.year_terms(F.col("text"))).alias("t")).select("doc_id", "t.years", "t.start", "t.end")


@query("k12_term_verdict", WITH + f"SELECT k AS doc_id, {LASTS} AS status FROM o")
def k12(spark, d):
    return C.term_and_survival(docs(spark, d)).select("doc_id", "status")


@query("k13_detected_term", WITH + "SELECT k AS doc_id, CASE WHEN NOT leaflet AND k % 11 <> 0 THEN CAST(q AS DOUBLE) END AS years FROM o")
def k13(spark, d):
    return C.term_and_survival(docs(spark, d)).select("doc_id", "years")


@query("k14_carve_outs", WITH + TERM + "SELECT k AS doc_id, years, CAST(start AS INT) AS start, CAST(start + size AS INT) AS end, carved FROM t")
def k14(spark, d):
    return docs(spark, d).select("doc_id", F.explode(C.year_terms(F.col("text"))).alias("t")).select("doc_id", "t.years", "t.start", "t.end", "t.carved")


@query("k15_indefinite", WITH + "SELECT k AS doc_id, NOT leaflet AND k % 11 = 0 AS endless FROM o")
def k15(spark, d):
    return docs(spark, d).select("doc_id", C.indefinite(F.col("text")).alias("endless"))


@query("k16_survival_references", WITH + "SELECT DISTINCT k AS doc_id, ordinal FROM found JOIN o USING (k) WHERE (ordinal = 2 AND pri < 5) OR (ordinal = 3 AND st = 'F')")
def k16(spark, d):
    rows = tagged_outlines(spark, d, "kind", "number").withColumn("refs", S.resolved_list(F.col("paragraphs"), F.col("sections"), 0))
    return S.opened(rows, C.surviving(F.col("refs"), section_tags()), "ordinal")


@query("k17_law_references", WITH + "SELECT DISTINCT k AS doc_id, CASE law WHEN 2 THEN 'unapproved' WHEN 3 THEN 'unclear' ELSE 'approved' END AS law_status FROM found JOIN o USING (k) WHERE ordinal = 7 + n AND law <> 5")
def k17(spark, d):
    chosen = X.bound(F.col("refs"), lambda refs: F.filter("sections", lambda s: F.exists(refs, lambda r: r["ordinal"] == s["ordinal"])))
    bodies = cited(spark, d, "body").select("doc_id", F.explode_outer(chosen).alias("s")).where("s is not null")
    status = bodies.select("doc_id", F.explode_outer(C.law_candidates(F.col("s.body"))).alias("law")).where("law is not null").select("doc_id", C.law_bucket(F.col("law")).alias("law_status"))
    return C.law_of_references(status)


@query("k18_signatures", WITH + f"SELECT k AS doc_id, {MARKS} AS status, CASE {MARKS} WHEN 'match' THEN 2 WHEN 'check' THEN 1 ELSE 0 END AS by, CASE {MARKS} WHEN 'match' THEN 2 ELSE 0 END AS title, CASE {MARKS} WHEN 'match' THEN 2 ELSE 0 END AS date FROM o")
def k18(spark, d):
    return C.signatures(docs(spark, d))


@query("k19_prohibited", WITH + "SELECT k AS doc_id, array_to_string(list_filter([CASE WHEN NOT leaflet AND coalesce(bool_or(flag = 'R'), FALSE) THEN 'non_compete' END, CASE WHEN NOT leaflet AND k % 11 = 0 THEN 'perpetual_confidentiality' END, CASE WHEN NOT leaflet AND coalesce(bool_or(flag = 'A'), FALSE) THEN 'penalty' END], lambda x: x IS NOT NULL), ',') AS labels FROM o LEFT JOIN ln USING (k) GROUP BY k, leaflet")
def k19(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(C.prohibited(F.col("text")), ",").alias("labels"))


FACET = "CASE WHEN NOT leaflet THEN CASE law WHEN 0 THEN 'england' WHEN 1 THEN 'delaware' WHEN 4 THEN 'ontario' END END"


@query("k20_law_forum", WITH + f"SELECT k AS doc_id, {FACET} AS law, CASE forum WHEN 0 THEN 'difc' ELSE 'england' END AS foreign FROM o WHERE {FACET} IS NOT NULL AND (forum = 0 OR (forum = 1 AND law <> 0))")
def k20(spark, d):
    return C.law_forum_mismatch(docs(spark, d))


@query("k21_poison", WITH + "SELECT k AS doc_id, 'p' || i AS id FROM p JOIN o USING (k) WHERE kind = 'definition' AND pri = 3")
def k21(spark, d):
    return parts(spark, d).where(C.poison(X.rule_form(F.col("text")))).select("doc_id", "id")


ORDER_CLAUSES = "(SELECT l_orderkey AS doc, l_linenumber AS clause, min(CASE l_returnflag WHEN 'A' THEN 'fail' WHEN 'R' THEN 'review' ELSE 'pass' END) AS decision, CAST(NULL AS VARCHAR) AS reason FROM lineitem GROUP BY 1, 2)"


def order_clauses(spark, d):
    decision = F.when(F.col("l_returnflag") == "A", "fail").when(F.col("l_returnflag") == "R", "review").otherwise("pass")
    return read_table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("clause")).agg(F.min(decision).alias("decision")).withColumn("reason", F.lit(None).cast("string"))


@query("k22_crosscheck", f"SELECT doc, clause, CASE WHEN decision = 'pass' AND s.l_orderkey IS NOT NULL THEN 'review' ELSE decision END AS decision FROM {ORDER_CLAUSES} c LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30) s ON c.doc = s.l_orderkey AND c.clause = s.l_linenumber")
def k22(spark, d):
    suspects = read_table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("clause"))
    return C.crosschecked(order_clauses(spark, d).drop("reason"), suspects, ["doc", "clause"])


@query("k23_overlay", f"SELECT doc, clause, CASE WHEN decision = 'pass' AND code IS NOT NULL THEN 'review' ELSE decision END AS decision, CASE WHEN decision = 'pass' AND code IS NOT NULL THEN code END AS reason FROM {ORDER_CLAUSES} c LEFT JOIN (SELECT l_orderkey, l_linenumber, min('coverage_' || l_linestatus) AS code FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2) s ON c.doc = s.l_orderkey AND c.clause = s.l_linenumber")
def k23(spark, d):
    found = read_table(spark, d, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("clause"), F.concat(F.lit("coverage_"), "l_linestatus").alias("code"))
    return C.overlaid(order_clauses(spark, d), found, ["doc", "clause"]).select("doc", "clause", "decision", "reason")


MAIL_SQL = """SELECT doc_id, score, CASE WHEN score >= 70 AND content > 0 THEN 'accept' WHEN score >= 40 THEN 'triage' ELSE 'ignore' END AS lane FROM (SELECT k AS doc_id, content, greatest(0, content + CASE WHEN k % 2 = 1 THEN 35 ELSE 0 END - CASE WHEN k % 3 = 0 AND content < 55 THEN 40 ELSE 0 END) AS score FROM (
SELECT k, CASE WHEN leaflet THEN 0 ELSE CASE WHEN pri < 5 THEN 30 ELSE 0 END + CASE WHEN st = 'O' THEN 25 ELSE 0 END + 10 END AS content FROM o))"""


def mail(spark, d):
    file = F.concat(F.when(F.col("doc_id") % 3 == 0, "price list ").otherwise(""), F.when(F.col("doc_id") % 2 == 1, "NDA.docx").otherwise("scan.docx"))
    return docs(spark, d).select("doc_id", C.mail_score(file, F.col("text")).alias("m")).select("doc_id", "m.score", "m.lane")


@query("k24_mail_score", WITH + MAIL_SQL)
def k24(spark, d):
    return mail(spark, d)


@query("k25_law_facet", WITH + f"SELECT k AS doc_id, {FACET} AS law FROM o")
def k25(spark, d):
    return docs(spark, d).select("doc_id", C.law_facet(F.col("text")).alias("law"))


@query("i13_intake_lane", WITH + f"SELECT doc_id, ai, CASE ai WHEN 'uncertain' THEN 'triage' WHEN 'nda' THEN CASE lane WHEN 'ignore' THEN 'triage' ELSE 'accept' END WHEN 'not_nda' THEN CASE lane WHEN 'accept' THEN 'triage' ELSE 'ignore' END ELSE lane END AS lane FROM ({MAIL_SQL}), (SELECT unnest(['nda', 'not_nda', 'uncertain', 'error', NULL]) AS ai)")
def i13(spark, d):
    rows = mail(spark, d).select("doc_id", "lane", F.explode(F.array(*[F.lit(x).cast("string") for x in ("nda", "not_nda", "uncertain", "error", None)])).alias("ai"))
    return rows.select("doc_id", "ai", C.lane(F.col("lane"), F.col("ai")).alias("lane"))


@query("e1_checks", WITH + " UNION ALL ".join(f"SELECT k AS doc_id, '{c}' AS clause, {s} AS status FROM o" for c, s in (("mutuality", MUTUAL), ("confidential_information", SECRET), ("governing_law", GOVERNED), ("term_and_survival", LASTS), ("signatures", MARKS))))
def e1(spark, d):
    return C.checked(agreements(spark, d))


@F.pandas_udf(T.StringType())
def spec_words(specs: pd.Series) -> pd.Series:
    """Specifications as JSON, validated, in words; what is no JSON is an empty one."""

    def words(x: str | None) -> str:
        try:
            return corpus.described(corpus.validated(json.loads(x or "")))
        except ValueError:
            return corpus.described(corpus.validated(None))

    return specs.map(words)


SPEC_SQL = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 7 THEN 'everything' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN o_orderstatus = 'F' THEN 'status: approved' END, CASE o_orderkey % 3 WHEN 0 THEN 'signed: yes' WHEN 1 THEN 'signed: no' END,
  CASE WHEN o_custkey % 4 <> 3 THEN 'term years: ' || greatest(1, least(100, o_custkey % 300)) END, CASE WHEN o_orderstatus = 'P' THEN 'min age days: 365' END, 'text: ' || lower(o_orderpriority), CASE WHEN o_orderkey % 2 = 0 THEN 'sort: newest' END), ''), 'everything') END AS words FROM orders"""


@query("q1_validated", SPEC_SQL)
def q1(spark, d):
    """Specifications with values out of bounds, of wrong kinds, unknown or not finite."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    fields = [
        field("status", quoted(F.when(F.col("o_orderstatus") == "F", " Approved ").otherwise("lost"))), field("signed", F.when(k % 3 == 0, "true").when(k % 3 == 1, "false").otherwise('"yes"')), field("term_years", F.when(c % 4 == 3, F.when(c % 8 == 3, "NaN").otherwise("true")).otherwise((c % 300).cast("string"))),
        field("min_age_days", F.when(F.col("o_orderstatus") == "P", "99999").otherwise("Infinity")), field("text", quoted(F.concat(F.lit("  "), F.lower("o_orderpriority"), F.lit(" ")))), field("sort", F.when(k % 2 == 0, '"NEWEST"').otherwise("7")), field("odd", F.lit("[1]")),
    ]
    spec = F.when(k % 10 == 7, "{broken").otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    return read_table(spark, d, "orders").select(k.alias("k"), spec_words(spec).alias("words"))
