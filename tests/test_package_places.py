"""Packages are read from a table of their places, so the driver holds no list of files."""

from parchmill.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_the_driver_lists_no_packages(spark):
    rows = registry.QUERIES["s8_docx_paragraphs"](spark, FOLDER)
    assert not [f for f in rows.inputFiles() if f.endswith(".docx")]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert rows.select("doc_id").distinct().count() == docs
