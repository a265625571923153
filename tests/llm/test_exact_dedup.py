"""Progressive refinement against a dictionary of texts: nulls, empty and long texts, repeated rows, hot groups, clashing names."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parchmill.llm import exact_dedup

BLANKS = re.compile("[\x20\x09-\x0d]+")


def form(text):
    return BLANKS.sub(" ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[form(text)].append(doc)
    out = []
    for docs in groups.values():
        order = sorted(docs, key=lambda d: (d is None, d or 0))
        out += [(d, order[0], len(docs), k == 0) for k, d in enumerate(order)]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def cases():
    begin = "a b " * 100
    rows = [(k, t) for k, t in enumerate([None, "", " ", "\t\n", "x", " x", "x y", "x\ny", "x \t y", "é", "é", "\xa0", "x\x00y", "X"])]
    rows += [(100 + k, begin + str(k % 3)) for k in range(12)]  # equal length and beginning, three texts
    rows += [(200 + k, begin[: 300 + k % 2]) for k in range(6)]
    rows += [(1000 + k, "hot  text" if k % 2 else "hot text") for k in range(700)]
    rows += [(7, "same row"), (7, "same row"), (None, "no id"), (None, "no id"), (None, "x"), (3000, "long " * 200_000), (2999, "long  " * 200_000)]
    return rows


def test_copies(spark, cases):
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(cases)], "doc_id long, text string, n long")
    got = exact_dedup.copies(docs.repartition(5)).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got) == expected(cases)
    digests = {r.digest for r in got if r.group_size > 1}
    assert digests <= {hashlib.sha256(form(t).encode()).hexdigest() for _, t in cases}
    assert None not in digests


def test_all_bits_set_changes_nothing(spark, cases, monkeypatch):
    """A table of bits that is far too small only makes more rows be hashed."""
    monkeypatch.setattr(exact_dedup, "TABLE_BITS", 3)
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    got = exact_dedup.copies(docs).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got) == expected(cases)


def test_only_survivors_are_hashed(spark):
    docs = spark.createDataFrame([(k, "t" * k) for k in range(50)] + [(100, "a" * 400), (101, "b" + "a" * 399)], "doc_id long, text string")
    assert exact_dedup.copies(docs).where("digest is not null").count() == 0


def test_columns_with_clashing_names(spark, cases):
    names = ["digest", "slot", "bits", "bucket", "form", "left", "number", "kept", "carried", "a.b"]
    docs = spark.createDataFrame(cases, "doc_id long, text string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(form(r["text"]) for r in rows) == sorted({form(t) for _, t in cases})
    assert {(r["digest"], r["a.b"]) for r in rows} == {(0, 9)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.copies(docs).collect() == []
    assert exact_dedup.drop_copies(docs).collect() == []
