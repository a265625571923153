"""Texts of one word over and over shrink further than a reader of packages allows; as files they are read back whole."""

import duckdb
import pytest

from parchmill.plans import registry
from parchmill.sources import docx as D


@pytest.mark.parametrize("name", ["s10_format_dispatch", "s8_docx_paragraphs"])
def test_query_equals_its_sql(spark, tmp_path, name):
    texts = ["La " * 20_000, "one\n\ntwo", "Is it\n" * 5_000, "THE!! AND!! " * 4_000, "x y\n" * 9_000, None, "", "so so " * 9_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_only_what_the_reader_refuses_is_stored():
    plain, bomb = D.package(f"<w:p>{D.run('word')}</w:p>"), D.package(f"<w:p>{D.run('a' * 300_000)}</w:p>")
    assert D.readable(plain) == plain
    with pytest.raises(D.PackageError, match="suspicious compression"):
        D.paragraphs(bomb)
    assert [p["text"] for p in D.paragraphs(D.readable(bomb))] == ["a" * 300_000]
