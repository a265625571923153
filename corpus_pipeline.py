"""From raw documents to packed sequences: quality rules, near-duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import ngram_join, packing, pii, quality
from parchmill.session import discard, read_table, settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and common lines leave the others."""
    return quality.clean_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words a shingle, a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    spans, masked = (f"{name}{'_' * max(map(len, docs.columns))}" for name in ("spans", "masked"))  # longer than any name there is
    found = pii.find_spans(docs, "text", spans, mask=masked)
    counted = F.when(F.size(spans) > 0, F.length(masked)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col(masked), "n_chars": counted}
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokenising, the random field and packing are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settled(docs, name)
            discard(before)
    return docs
