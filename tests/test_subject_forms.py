"""The query of subjects has every written form, for every customer."""

from parchmill.plans import clause_queries, registry
from tests.clause_texts import SUBJECTS

FOLDER = "/root/testdata/sf0.001"


def test_no_written_form_is_left_out(spark):
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    assert len(clause_queries.SUBJECTS) == len(SUBJECTS)
    assert registry.QUERIES["t13_subject_party"](spark, FOLDER).count() == customers * len(SUBJECTS)
