"""What a document says of itself is found within its row; guards by words lose no match."""

import pytest
from pyspark.sql import functions as F

from parchmill.operators import concepts as N
from parchmill.operators import structure as S
from parchmill.plans import registry
from parchmill.plans.agreements import agreements
from tests.clause_cases import DOCUMENTS

FOLDER = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("name", ["c1_sections", "c2_parents", "c3_roles", "c4_aliases", "c5_demotion", "c6_references", "c7_resolution", "c9_dangling", "c11_section_concepts", "k16_survival_references", "c10_concepts"])
def test_structure_does_not_shuffle_texts(spark, name):
    got = registry.QUERIES[name](spark, FOLDER)
    assert exchanges(got) == exchanges(agreements(spark, FOLDER))
    assert got.rdd.getNumPartitions() >= 8


PHRASES = [
    "Mutually agreed confidential matter", "Reciprocal", "each party receives", "both parties disclose", "The disclosing party means A", "receiving party shall mean B", "Confidential Information includes C", "definition of confidential information",
    "public domain", "prior possession", "independent development", "lawful third party", "excludes all confidential information", "confidentiality duties", "protect it as confidential", "no disclosure", "non disclosure", "uses: used for the purpose", "only for the purpose",
    "permitted disclosures", "disclose to agents", "representatives see confidential information", "return of materials", "destroy confidential information", "certify destruction of confidential information", "delete confidential information", "expiry", "expiration", "effective date",
    "survival", "remain so after", "continue following", "in effect after", "trade secret", "requires by law", "applicable law", "legal obligation", "personal data", "data-protection", "governing law", "laws of India", "executed", "authorised signatory", "by :", "title:", "date:",
    "non-circumvention", "nonsolicitation", "bypass", "direct dealing", "deals directly", "exclusively with", "substitute for transacting", "introduced parties", "parties made known", "persons disclosed hereunder", "In witness whereof", "signed by", "signature", "for and on behalf",
    "authorized signatory", "duly authorised", "executed as", "recital", "background", "in consideration of", "plain words",
]


def test_words_lose_no_match(spark):
    texts = [v for p in PHRASES for v in (p, p.upper())] + [t for _, t in DOCUMENTS]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_compact(F.array(*[F.when(F.col("t").rlike("(?i)" + "|".join(ps)), F.lit(n)) for n, ps in N.CONCEPTS.items()]))
    role = F.when(F.col("t").rlike(S.SIGNATURES), "signature").when(F.col("t").rlike(S.RECITALS), "recital").otherwise("body")
    got = rows.select("t", N.concepts(F.col("t")).alias("a"), plain.alias("b"), S.role(F.lit("x"), F.lit(None).cast("string"), F.lit(""), F.col("t")).alias("c"), role.alias("d")).collect()
    assert [r.t for r in got if r.a != r.b or r.c != r.d] == []
    assert {n for r in got for n in r.b} == set(N.CONCEPTS)


def test_a_filter_on_foreign_courts_is_not_computed_twice(spark):
    from parchmill.operators import clauses as C

    rows = spark.createDataFrame(DOCUMENTS, "doc_id long, text string")
    plan = C.law_forum_mismatch(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("arbitrat") <= 2  # the guard and the pattern


def test_words_of_prohibited_positions(spark):
    from parchmill.operators import clauses as C

    said = ["Non-compete", "competing business", "shall not solicit", "may well solicit", "refrain from soliciting", "non circumvent", "noncircumvent", "bypass the disclosing party", "deal directly", "introduced party", "sole and exclusive", "EXCLUSIVITY provision", "hereby assigns", "assignment of intellectual property", "all title and interest in", "in perpetuity", "perpetual", "indefinitely", "never expire", "forever", "for an unlimited time", "liquidated damages", "penalties", "automatically renew", "evergreen", "may not be terminated", "none"]
    plain = F.array_compact(F.array(*[F.when(F.col("t").rlike(f"(?i){p}"), F.lit(k)) for k, p in C.PROHIBITED]))
    got = spark.createDataFrame([(x,) for x in said], "t string").select(C.prohibited(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert {n for r in got for n in r.b} == set(C.PROHIBITED_WORDS)
