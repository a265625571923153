"""Structure, concepts and clause checks over the seven agreements of `clause_cases`, each with the SQL or the rows that a reader
of them expects. `test_clause_texts` holds them against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchmill.functions import text as X
from parchmill.operators import clauses as C
from parchmill.operators import concepts as N
from parchmill.operators import structure as S
from tests.clause_cases import DOCUMENTS_SQL, PARAGRAPHS, PARAGRAPHS_SQL, documents, values
from parchmill.session import read_table, shuffle_width

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


def parts(spark):
    return S.paragraphs(documents(spark))


def secs(spark):
    return S.sections(parts(spark))


def refs(spark):
    return S.resolved(S.references(parts(spark)), S.aliases(secs(spark)))


def tags(spark):
    return N.tagged(parts(spark))


@query("t5_alignment", f"SELECT p.doc_id, p.id, CAST(instr(d.text, p.text) - 1 AS INTEGER) AS start, CAST(instr(d.text, p.text) - 1 + length(p.text) AS INTEGER) AS end FROM {PARAGRAPHS_SQL} p JOIN {DOCUMENTS_SQL} d ON p.doc_id = d.doc_id")
def t5(spark, d):
    pieces = spark.createDataFrame(PARAGRAPHS, "doc_id long, id string, index int, text string").drop("id")
    return S.aligned(pieces, documents(spark)).select("doc_id", "id", "start", "end")


@query("t10_continuation", values("doc_id BIGINT, index INTEGER", [(1, 3), (1, 5), (1, 7), (1, 8), (1, 9), (3, 1), (3, 3)]))
def t10(spark, d):
    return S.continued(parts(spark)).where("is_heading").select("doc_id", "index")


FRAGMENTS = [(1, 1, "The duties"), (1, 2, "go on and"), (1, 3, "end here."), (1, 4, "then again"), (2, 1, "a"), *((2, k, "b") for k in range(2, 9)), (3, 1, "Done;"), (3, 2, "(so it is)"), (3, 3, "Next")]


#: (subject, the other party) for a reader whose own names are Ownco and Ownco Money.
SUBJECTS = [
    ("Plain name", "Plain name"), ("Fwd: Air Nine <> Ownco", "Air Nine"), ("Fwd: Ownco - Reed bank - Introduction - Sponsorship", "Reed bank"), ("Fwd: Ownco | Netty Follow Up", "Netty"), ("Fwd: CALL: Ownco x Pisco", "Pisco"), ("Fwd: Moor Ownco", "Moor Ownco"),
    ("Fwd: slate stack - Ownco", "slate stack"), ("Fwd: Updated invitation: Ownco <> Nyma @ Wed May 13, 2026 7:30pm - 8:00pm", "Nyma"), ("Fwd: Zed | Ownco Connect: Ann<>Neil", "Zed"), ("Re: Fwd: Ownco x Beam Pay - follow up", "Beam Pay"), ("RE: NDA - Ownco and Acre Tech", "Acre Tech"),
    ("Fwd: Ownco <> Ownco Money", "Ownco <> Ownco Money"), ("Cover <> Ownco <> Beam Pay", "Cover"), ("Owncolike Inc", "Owncolike Inc"), ("Fwd: Owncolike <> Ownco", "Owncolike"), ("Fwd: Cover – Ownco", "Cover"), ("Fwd: Stark Works / Ownco", "Stark Works"),
    ("NDA between Acre and Globe", "NDA between Acre and Globe"), ("Ownco|Pisco", "Pisco"), ("vs Ownco", "vs Ownco"), ("Fwd: Ownco <>", "Ownco <>"), ("Ownco", "Ownco"), ("Fwd:", ""), ("Re: Re: Fwd:", ""), ("", ""), ("   ", ""), (None, ""),
]


@query("t13_subject_party", values("subject VARCHAR, party VARCHAR", SUBJECTS))
def t13(spark, d):
    rows = spark.createDataFrame([s[:1] for s in SUBJECTS], "subject string")
    return rows.withColumn("party", X.subject_party(F.col("subject"), ["Ownco", "Ownco Money"]))


@query("t18_fragments", values("doc_id BIGINT, index INTEGER, members VARCHAR, text VARCHAR", [(1, 1, "1,2,3", "The duties go on and end here."), (1, 4, "4", "then again"), (2, 1, "1,2,3,4,5,6", "a b b b b b"), (2, 7, "7,8", "b b"), (3, 1, "1", "Done;"), (3, 2, "2", "(so it is)"), (3, 3, "3", "Next")]))
def t18(spark, d):
    return S.merged_fragments(spark.createDataFrame(FRAGMENTS, "doc_id long, index int, text string")).select("doc_id", "index", joined("members"), "text")


SECTIONS = [
    (1, 1, "heading", None, "MUTUAL DISCLOSURE AGREEMENT", 1, "medium", "recital", "1,2"), (1, 2, "numbered", "1", "Definitions", 1, "high", "definitions", "3,4"), (1, 3, "numbered", "2", "Confidentiality", 1, "high", "operative", "5,6"),
    (1, 4, "numbered", "3", "Term", 1, "high", "body", "7"), (1, 5, "numbered", "3.1", "The duties survive for five (5) years, subject to clause 2.", 2, "high", "operative", "8"), (1, 6, "numbered", "4", "Governing Law", 1, "high", "operative", "9,10"),
    (1, 7, "heading", None, "SIGNED FOR THE PARTIES", 1, "medium", "signature", "11,12,13"), (2, 1, "section", "1", "Scope", 1, "high", "operative", "1,2"), (2, 2, "section", "2", "Law", 1, "high", "operative", "3,4"),
    (2, 3, "section", "2", "Orders", 1, "high", "body", "5,6"), (2, 4, "section", "2(a)", "Forms", 2, "high", "operative", "7,8"), (3, 1, "numbered", "1", "Our Product", 1, "high", "body", "1,2"), (3, 2, "numbered", "2", "Our Market", 1, "high", "body", "3,4"),
    *((k, 0, "preamble", None, "", 1, "medium", "recital", p) for k, p in ((4, "1,2,3,4,5"), (5, "1,2,3,4"), (6, "1,2,3,4"), (7, "1"))),
]


@query("c1_sections", values("doc_id BIGINT, ordinal BIGINT, kind VARCHAR, number VARCHAR, heading VARCHAR, level INTEGER, confidence VARCHAR, paragraphs VARCHAR", [(*s[:7], s[8]) for s in SECTIONS]))
def c1(spark, d):
    return secs(spark).select("doc_id", "ordinal", "kind", "number", "heading", "level", "confidence", joined("paragraphs"))


@query("c2_parents", values("doc_id BIGINT, ordinal BIGINT, parent BIGINT", [(s[0], s[1], {(1, 5): 4, (2, 4): 3}.get(s[:2])) for s in SECTIONS]))
def c2(spark, d):
    return S.parents(secs(spark))


@query("c3_roles", values("doc_id BIGINT, ordinal BIGINT, role VARCHAR", [(*s[:2], s[7]) for s in SECTIONS]))
def c3(spark, d):
    return secs(spark).select("doc_id", "ordinal", "role")


ALIASES = [(1, "1", 2), (1, "2", 3), (1, "3", 4), (1, "3.1", 5), (1, "4", 6), (2, "1", 1), (2, "2", None), (2, "2(a)", 4), (3, "1", 1), (3, "2", 2)]


@query("c4_aliases", values("doc_id BIGINT, alias VARCHAR, ordinal BIGINT, ambiguous BOOLEAN", [(d, f"{kind}:{n}", o, o is None) for d, n, o in ALIASES for kind in ("number", "section")]))
def c4(spark, d):
    return S.aliases(secs(spark))


@query("c5_demotion", values("doc_id BIGINT, ordinal BIGINT", [(3, 1), (3, 2)]))
def c5(spark, d):
    return S.demoted(secs(spark)).where("confidence = 'low'").select("doc_id", "ordinal")


CITED = [
    (1, "p10", "annex", "A", None, False), (1, "p6", "section", "3.1", 5, False), (1, "p6", "section", "4", 6, False), (1, "p6", "section", "6", None, False), (1, "p6", "section", "7", None, False), (1, "p6", "section", "8", None, False),
    (1, "p8", "clause", "2", 3, False), (2, "p1", "section", "1", 1, False), (2, "p3", "section", "2", None, True), (2, "p5", "section", "2", None, True), (2, "p6", "article", "9", None, False), (2, "p6", "section", "2", None, True), (2, "p7", "section", "2(a)", 4, False),
]
OWN_HEADINGS = {(2, "p1"), (2, "p7")}


@query("c6_references", values("doc_id BIGINT, paragraph VARCHAR, kind VARCHAR, number VARCHAR, opening BOOLEAN", [(*r[:4], (r[0], r[1]) in OWN_HEADINGS | {(2, "p3"), (2, "p5")}) for r in CITED]))
def c6(spark, d):
    return S.references(parts(spark))


@query("c7_resolution", values("doc_id BIGINT, paragraph VARCHAR, kind VARCHAR, number VARCHAR, ordinal BIGINT, ambiguous BOOLEAN", [r for r in CITED if r[:2] not in OWN_HEADINGS]))
def c7(spark, d):
    return S.without_own_headings(refs(spark), secs(spark), parts(spark))


@query("c8_status", values("doc_id BIGINT, paragraph VARCHAR, kind VARCHAR, status VARCHAR", [(1, "p10", "annex", "unresolved"), (1, "p6", "section", "partial"), (1, "p8", "clause", "resolved"), (2, "p3", "section", "unresolved"), (2, "p5", "section", "unresolved"), (2, "p6", "article", "unresolved"), (2, "p6", "section", "unresolved")]))
def c8(spark, d):
    return S.reference_status(S.without_own_headings(refs(spark), secs(spark), parts(spark)))


@query("c9_dangling", values("doc_id BIGINT, dangling BIGINT, ambiguous BIGINT", [(1, 4, 0), (2, 1, 3)]))
def c9(spark, d):
    return S.dangling(refs(spark), secs(spark))


TAGS_SQL = "(" + " UNION ALL ".join(f"SELECT doc_id, id, index, '{c}' AS concept, {k} AS place FROM p WHERE regexp_matches(text, '(?i){'|'.join(ps).replace(chr(39), chr(39) * 2)}')" for k, (c, ps) in enumerate(N.CONCEPTS.items())) + ")"
WITH_P = f"WITH p AS {PARAGRAPHS_SQL} "


@query("c10_concepts", WITH_P + f"SELECT p.doc_id, p.id, coalesce(string_agg(concept, ',' ORDER BY place), '') AS concepts FROM p LEFT JOIN {TAGS_SQL} t ON p.doc_id = t.doc_id AND p.id = t.id GROUP BY 1, 2")
def c10(spark, d):
    return tags(spark).select("doc_id", "id", joined("concepts"))


SECTION_TAGS = [
    (1, 1, "mutuality"), (1, 2, "confidential_information_definition,confidential_information_exclusion"), (1, 3, "confidentiality_obligation,mutuality"), (1, 4, "term_or_survival"), (1, 5, "term_or_survival"), (1, 6, "governing_law"), (1, 7, "execution"), (2, 2, "governing_law"),
    (4, 0, "confidential_information_definition,confidential_information_exclusion,governing_law,non_circumvention,trade_secret_or_legal_carveout"), (5, 0, "confidential_information_definition,confidential_information_exclusion,governing_law,term_or_survival"),
    (6, 0, "confidential_information_definition,confidential_information_exclusion,execution,governing_law,party_role_definition"),
]


@query("c11_section_concepts", values("doc_id BIGINT, ordinal BIGINT, concepts VARCHAR", SECTION_TAGS))
def c11(spark, d):
    return N.section_concepts(secs(spark), tags(spark)).select("doc_id", "ordinal", joined("concepts"))


@query("c12_concept_counts", WITH_P + f"SELECT concept, CAST(count(*) AS BIGINT) AS n FROM (SELECT concept FROM {TAGS_SQL} UNION ALL SELECT unnest(string_split(concepts, ',')) FROM ({values('doc_id BIGINT, ordinal BIGINT, concepts VARCHAR', SECTION_TAGS)})) GROUP BY 1")
def c12(spark, d):
    t = tags(spark)
    return N.concept_counts(t.select("concepts").unionByName(N.section_concepts(secs(spark), t).select("concepts")))


@query("c13_by_concept", WITH_P + f"SELECT DISTINCT doc_id, id FROM {TAGS_SQL} WHERE concept IN ('governing_law', 'execution')")
def c13(spark, d):
    return N.with_concepts(tags(spark), ["governing_law", "execution"]).select("doc_id", "id")


@query("c14_merged_groups", WITH_P + f"SELECT doc_id, id, CAST(min(CASE concept WHEN 'governing_law' THEN 0 WHEN 'mutuality' THEN 1 ELSE 2 END) AS INTEGER) AS place FROM {TAGS_SQL} WHERE concept IN ('governing_law', 'mutuality', 'confidentiality_obligation') GROUP BY 1, 2")
def c14(spark, d):
    t = tags(spark)
    return N.merged([N.with_concepts(t, [c]) for c in ("governing_law", "mutuality", "confidentiality_obligation")]).select("doc_id", "id", F.col("group").alias("place"))


@query("c15_localisation", values("doc_id BIGINT, clause VARCHAR, ordinal BIGINT", [(1, "law", 6), (1, "parties", 7), (1, "term", 4), (2, "law", 2)]))
def c15(spark, d):
    cues = spark.createDataFrame([("law", "governing law"), ("law", "law"), ("term", "term"), ("parties", "parties")], "clause string, cue string")
    return S.localised(secs(spark), cues, most=1)


def one_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''")


@query("k1_paragraph_match", WITH_P + f"SELECT doc_id, id FROM p WHERE regexp_matches(text, '{one_of(C.RULES['strong_mutual'])}')")
def k1(spark, d):
    return C.paragraph_matches(parts(spark), C.RULES["strong_mutual"]).select("doc_id", "id")


@query("k2_hit_count", WITH_P + f"SELECT doc_id, id, CAST(len(regexp_extract_all(text, '(?i){C.RULES['indefinite']}')) + len(regexp_extract_all(text, '(?i)\\blaws?\\b')) AS INTEGER) AS hits FROM p")
def k2(spark, d):
    return parts(spark).select("doc_id", "id", C.hit_count(F.col("text"), [C.RULES["indefinite"], r"\blaws?\b"]).alias("hits"))


@query("k3_evidence", WITH_P + f"""SELECT p.doc_id, p.id, t.term, CAST(instr(lower(d.text), lower(p.text)) - 1 + instr(regexp_replace(lower(p.text), '\\blaws\\b', '####', 'g'), lower(t.term)) - 1 AS INTEGER) AS start
FROM p JOIN {DOCUMENTS_SQL} d ON p.doc_id = d.doc_id, (VALUES ('Confidential Information'), ('law')) t(term) WHERE regexp_matches(p.text, '(?i)\\b' || t.term || '\\b')""")
def k3(spark, d):
    found = C.evidence_spans(parts(spark), ["Confidential Information", "law"])
    return found.select("doc_id", "id", F.explode("evidence").alias("e")).select("doc_id", "id", "e.term", "e.start")


def statuses(name: str, rows: list[str]) -> str:
    return values("doc_id BIGINT, status VARCHAR", [(k, {"m": "match", "c": "check", "r": "review", "-": "not_present"}[s]) for k, s in enumerate(rows, 1)])


@query("k4_mutuality", statuses("mutuality", "mc--mr-"))
def k4(spark, d):
    return C.mutuality(documents(spark))


@query("k5_confidential_information", values("doc_id BIGINT, status VARCHAR, coverage INTEGER, poisoned BOOLEAN, unqualified BOOLEAN", [(1, "match", 4, False, False), (2, "not_present", 0, False, False), (3, "not_present", 0, False, False), (4, "check", 1, True, False), (5, "review", 2, False, False), (6, "review", 4, False, True), (7, "not_present", 0, False, False)]))
def k5(spark, d):
    return C.confidential_information(documents(spark))


@query("k6_independent_development", values("doc_id BIGINT, unqualified BOOLEAN", [(k, k == 6) for k in range(1, 8)]))
def k6(spark, d):
    return documents(spark).select("doc_id", C.unqualified_development(F.col("text")).alias("unqualified"))


LAWS = [(1, "england and wales", "approved"), (2, "delaware", "approved"), (4, "delaware or such other place as is to be agreed", "unclear"), (5, "to be agreed", "unclear"), (6, "norway", "unapproved")]


@query("k7_law_values", values("doc_id BIGINT, law VARCHAR", [r[:2] for r in LAWS]))
def k7(spark, d):
    return documents(spark).select("doc_id", F.explode(C.law_candidates(F.col("text"))).alias("law"))


@query("k8_law_buckets", values("doc_id BIGINT, law VARCHAR, bucket VARCHAR", LAWS))
def k8(spark, d):
    return documents(spark).select("doc_id", F.explode(C.law_candidates(F.col("text"))).alias("law")).withColumn("bucket", C.law_bucket(F.col("law")))


@query("k9_governing_law", statuses("governing_law", "mm-rrc-"))
def k9(spark, d):
    return C.governing_law(documents(spark)).select("doc_id", "status")


@query("k10_recitals", f"SELECT doc_id, regexp_replace(text, 'incorporated under the laws of Ontario', ' ') AS text FROM {DOCUMENTS_SQL}")
def k10(spark, d):
    return documents(spark).select("doc_id", C.stripped_recitals(F.col("text")).alias("text"))


TERMS = [(1, "five (5) years", 5.0, False), (4, "18 months", 1.5, False), (4, "ten years", 10.0, True), (5, "seven years", 7.0, False)]
SPOT = f"SELECT t.doc_id, years, CAST(instr(text, term) - 1 AS INTEGER) AS start, CAST(instr(text, term) - 1 + length(term) AS INTEGER) AS end{{}} FROM ({values('doc_id BIGINT, term VARCHAR, years DOUBLE, carved BOOLEAN', TERMS)}) t JOIN {DOCUMENTS_SQL} d ON t.doc_id = d.doc_id"


@query("k11_year_terms", SPOT.format(""))
def k11(spark, d):
    return documents(spark).select("doc_id", F.explode(C.year_terms(F.col("text"))).alias("t")).select("doc_id", "t.years", "t.start", "t.end")


@query("k12_term_verdict", statuses("term", "mc-mc--"))
def k12(spark, d):
    return C.term_and_survival(documents(spark)).select("doc_id", "status")


@query("k13_detected_term", values("doc_id BIGINT, years DOUBLE", [(1, 5.0), (2, None), (3, None), (4, 1.5), (5, 7.0), (6, None), (7, None)]))
def k13(spark, d):
    return C.term_and_survival(documents(spark)).select("doc_id", "years")


@query("k14_carve_outs", SPOT.format(", carved"))
def k14(spark, d):
    return documents(spark).select("doc_id", F.explode(C.year_terms(F.col("text"))).alias("t")).select("doc_id", "t.years", "t.start", "t.end", "t.carved")


@query("k15_indefinite", values("doc_id BIGINT, endless BOOLEAN", [(k, k == 2) for k in range(1, 8)]))
def k15(spark, d):
    return documents(spark).select("doc_id", C.indefinite(F.col("text")).alias("endless"))


@query("k16_survival_references", values("doc_id BIGINT, ordinal BIGINT", [(1, 3)]))
def k16(spark, d):
    return C.survival_references(refs(spark), N.section_concepts(secs(spark), tags(spark)))


@query("k17_law_references", values("doc_id BIGINT, law_status VARCHAR", [(1, "approved")]))
def k17(spark, d):
    status = secs(spark).select("doc_id", "ordinal", F.explode(F.transform(C.law_candidates(F.col("body")), lambda x: C.law_bucket(x))).alias("law_status"))
    return C.reference_law(refs(spark), status)


@query("k18_signatures", values("doc_id BIGINT, status VARCHAR, by INTEGER, title INTEGER, date INTEGER", [(1, "match", 2, 2, 2), *((k, "not_present", 0, 0, 0) for k in (2, 3, 4, 5, 7)), (6, "check", 1, 0, 0)]))
def k18(spark, d):
    return C.signatures(documents(spark))


@query("k19_prohibited", f"SELECT doc_id, coalesce(string_agg(label, ',' ORDER BY place), '') AS labels FROM (SELECT doc_id, text FROM {DOCUMENTS_SQL}) d LEFT JOIN (" + " UNION ALL ".join(f"SELECT doc_id AS k, '{label}' AS label, {place} AS place FROM {DOCUMENTS_SQL} WHERE regexp_matches(text, '(?i){p}')" for place, (label, p) in enumerate(C.PROHIBITED)) + ") f ON d.doc_id = f.k GROUP BY 1")
def k19(spark, d):
    return documents(spark).select("doc_id", F.array_join(C.prohibited(F.col("text")), ",").alias("labels"))


@query("k20_law_forum", values("doc_id BIGINT, law VARCHAR, foreign VARCHAR", [(2, "delaware", "difc")]))
def k20(spark, d):
    return C.law_forum_mismatch(documents(spark))


@query("k21_poison", WITH_P + f"SELECT doc_id, id FROM p WHERE regexp_matches(text, '(?i){C.RULES['poison']}') AND NOT regexp_matches(text, '(?i){C.RULES['poison_negated']}')")
def k21(spark, d):
    return parts(spark).where(C.poison(X.rule_form(F.col("text")))).select("doc_id", "id")


MAIL_SQL = f"""SELECT doc_id, score, CASE WHEN score >= 70 AND content > 0 THEN 'accept' WHEN score >= 40 THEN 'triage' ELSE 'ignore' END AS lane FROM (SELECT doc_id, content, CAST(greatest(0, content + CASE WHEN doc_id % 2 = 1 THEN 35 ELSE 0 END - CASE WHEN doc_id % 3 = 0 AND content < 55 THEN 40 ELSE 0 END) AS INTEGER) AS score FROM (
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)confidential information') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)disclosing party|receiving party') THEN 25 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)governing law') THEN 10 ELSE 0 END AS content FROM {DOCUMENTS_SQL}))"""


def mail(spark):
    file = F.concat(F.when(F.col("doc_id") % 3 == 0, "price list ").otherwise(""), F.when(F.col("doc_id") % 2 == 1, "NDA.docx").otherwise("scan.docx"))
    return documents(spark).select("doc_id", C.mail_score(file, F.col("text")).alias("m")).select("doc_id", "m.score", "m.lane")


@query("k24_mail_score", MAIL_SQL)
def k24(spark, d):
    return mail(spark)


@query("k25_law_facet", values("doc_id BIGINT, law VARCHAR", [(1, "england"), (2, "delaware"), (3, None), (4, "delaware"), (5, None), (6, None), (7, None)]))
def k25(spark, d):
    return documents(spark).select("doc_id", C.law_facet(F.col("text")).alias("law"))


@query("i13_intake_lane", f"SELECT doc_id, ai, CASE ai WHEN 'uncertain' THEN 'triage' WHEN 'nda' THEN CASE lane WHEN 'ignore' THEN 'triage' ELSE 'accept' END WHEN 'not_nda' THEN CASE lane WHEN 'accept' THEN 'triage' ELSE 'ignore' END ELSE lane END AS lane FROM ({MAIL_SQL}), (VALUES ('nda'), ('not_nda'), ('uncertain'), ('error'), (NULL)) v(ai)")
def i13(spark, d):
    rows = mail(spark).select("doc_id", "lane", F.explode(F.array(*[F.lit(x).cast("string") for x in ("nda", "not_nda", "uncertain", "error", None)])).alias("ai"))
    return rows.select("doc_id", "ai", C.lane(F.col("lane"), F.col("ai")).alias("lane"))


@query("e1_checks", " UNION ALL ".join(f"SELECT doc_id, '{c}' AS clause, status FROM ({statuses(c, s)})" for c, s in (("mutuality", "mc--mr-"), ("confidential_information", "m--crr-"), ("governing_law", "mm-rrc-"), ("term_and_survival", "mc-mc--"), ("signatures", "m----c-"))))
def e1(spark, d):
    return C.checked(documents(spark))
