"""Small rules one by one: labels, mail dates, JSON, facets, laws in provisos, formats of files."""

import pytest
from pyspark.sql import functions as F

from parchmill.functions import scalar as S
from parchmill.functions import text as X
from parchmill.operators import clauses, rulesets, verdicts
from parchmill.sources import docx
from parchmill.sources.documents import read_documents


def column(spark, values, kind, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in df.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_labels(spark):
    assert column(spark, [0, 1, 5, 20, 21, 30, None], "int", S.number_words) == ["0", "one", "five", "twenty", "21", "thirty", None]
    assert column(spark, [1, 5], "int", lambda c: S.year_label(c, digits=True)) == ["one (1) year", "five (5) years"]
    assert column(spark, [[], ["a"], ["a", "b"], ["a", "b", "c"], None], "array<string>", X.joined_with_and) == ["", "a", "a and b", "a, b, and c", None]


def test_mail_dates(spark):
    given = ["Tue, 02 Jan 2024 10:00:00 +0200", "Tue, 02 Jan 2024 10:00:00 GMT", "2 Jan 2024 10:00:00", "Tue, 02 Jan 2024 10:00:00 -0000", "nonsense", "", None]
    assert column(spark, given, "string", S.email_time) == ["2024-01-02T10:00:00+02:00", "2024-01-02T10:00:00+00:00", "2024-01-02T10:00:00+00:00", "2024-01-02T10:00:00+00:00", "", "", ""]


def test_finite_json(spark):
    given = ['{"a": 1, "b": "NaN, it says: Infinity"}', '{"a": NaN}', '{"a": -Infinity }', '{"b": "x", "a": [1, Infinity]}', "nonsense", None, '{"a": 2.5}']
    got = column(spark, given, "string", lambda c: S.finite_json(c, "a double, b string")["a"])
    assert got == [1.0, None, None, None, None, None, 2.5]


def test_facets(spark):
    df = spark.createDataFrame([(["p1"], ["p2"]), ([" ", None], ["p2"]), ([], [""]), (None, None)], "one array<string>, both array<string>")
    assert [r[0] for r in df.select(verdicts.mutuality_facet(F.col("one"), F.col("both"))).collect()] == ["one_way", "mutual", None, None]
    assert column(spark, [" Generated", "SEND_DOCUMENT", "gmail_x", "email", "upload", "other", "", None], "string", lambda c: verdicts.origin(c, F.lit(False))) == ["generated", "generated", "received", "received", "received", None, None, None]
    assert column(spark, ["other", "generated", None], "string", lambda c: verdicts.origin(c, F.lit(True))) == ["received", "generated", "received"]


def test_laws_in_provisos(spark):
    text = ["This agreement is governed by the laws of England, provided that patents are governed by the laws of Norway.", "It is governed by the laws of England except that disputes are subject to the laws of Ontario.", "It is governed by the laws of England except as agreed."]
    assert column(spark, text, "string", clauses.law_candidates) == [["england", "norway"], ["england except that disputes are subject to the laws of ontario", "ontario"], ["england except as agreed"]]


def test_rule_sets(spark):
    rows = [("governing_law", [" ", None], None, "x", None), ("governing_law", ["A", " B "], {"B": "the B"}, " B", 3), ("term_and_survival", None, None, None, 0), ("other", None, None, None, 2)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "clause string, approved_laws array<string>, law_phrases map<string,string>, preferred_law string, max_term_years int, requirement string")
    got = rulesets.normalised(df).collect()
    assert [(r.preferred_law, r.acceptable_language) for r in got[:2]] == [("x", None), ("B", "This Agreement shall be governed by the laws of A or the B.")]
    assert got[2].requirement == "The NDA term and ordinary confidentiality survival must be fixed at up to five (5) years (60 months)."
    assert (got[3].requirement, got[3].acceptable_language, got[3].derived) == ("kept", None, [])


@pytest.mark.parametrize("name", ["A.DOCX", "x.docx?y=1#z"])
def test_files_by_name(spark, name):
    body = docx.package(f"<w:p>{docx.run('one')}</w:p><w:p>{docx.run('two')}</w:p>")
    files = [(name, body), ("b.docx", b"broken"), ("c.txt", "é one\n\ntwo".encode()), ("d.htm", b"<p>x &amp; y</p>"), ("e.pdf", b"%PDF"), ("f.txt", b" \n"), ("g.txt", None), ("h", b"x")]
    got = sorted((repr((r.path, r["format"], r.status, r["index"], r.text)) for r in read_documents(spark.createDataFrame(files, "path string, content binary")).collect()))
    assert got == sorted(repr(x) for x in [(name, "docx", "ok", 1, "one"), (name, "docx", "ok", 2, "two"), ("b.docx", "docx", "not a package", None, None), ("c.txt", "text", "ok", 1, "é one"), ("c.txt", "text", "ok", 2, "two"), ("d.htm", "html", "ok", 1, "x & y"), ("e.pdf", None, "unsupported", None, None), ("f.txt", "text", "no text", None, None), ("g.txt", "text", "no text", None, None), ("h", None, "unsupported", None, None)])
