"""The seven agreements by the rows that a reader of them expects."""

import duckdb
import pytest

from tests import clause_texts
from tests.test_queries import FOLDER, rows


@pytest.mark.parametrize("name", sorted(clause_texts.QUERIES))
def test_agreement_texts(spark, name):
    got = clause_texts.QUERIES[name](spark, FOLDER)
    want = duckdb.connect().execute(clause_texts.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())
