"""Queries held against whole-job oracles: every row is looked up, every word is kept, whole texts decide."""

import re

import duckdb
import pytest

from parchmill.plans import registry

FOLDER = "/root/testdata/sf0.001"


def table(name, folder=FOLDER):
    return duckdb.connect().execute(f"select * from read_parquet('{folder}/{name}.parquet')")


def whole_text_duplicates(rows):
    """{(doc_id, component)} of rows (doc_id, text, n_chars): what shares a whole normal form, but for the longest (then first)."""
    groups = {}
    for doc, text, n_chars in rows:
        if text is not None:
            form = re.sub(r"\s+", " ", text).strip().lower().replace("ß", "ss")
            groups.setdefault(form or text, []).append((-n_chars, doc))
    return {(doc, min(d for _, d in g)) for g in groups.values() for _, doc in sorted(g)[1:]}


@pytest.fixture
def planted(spark, tmp_path):
    opening = "Licensed under the terms that stand below, all rights reserved. "
    texts = [f"{opening}Document number {k}." for k in range(30)] + [f"{opening}  DOCUMENT number 3.", f"{opening}Document number 3.", None, None, "", "", " \n"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), [(r[0], r[1], r[4]) for r in rows]


def test_j10_removes_whole_copies_only(spark, planted):
    folder, rows = planted
    got = {tuple(r) for r in registry.QUERIES["j10_component_dedup"](spark, folder).select("doc_id", "component").collect()}
    assert got == whole_text_duplicates(rows) and len(got) == 3


def test_j10_on_the_driver_table(spark):
    got = {tuple(r) for r in registry.QUERIES["j10_component_dedup"](spark, FOLDER).select("doc_id", "component").collect()}
    assert got == whole_text_duplicates(table("documents").df()[["doc_id", "text", "n_chars"]].itertuples(index=False, name=None))


def test_j11_answers_every_order(spark):
    want = duckdb.execute(f"select p.o_orderkey, min(o.o_orderkey) from '{FOLDER}/orders.parquet' p join '{FOLDER}/orders.parquet' o on p.o_custkey = o.o_custkey and p.o_orderpriority = o.o_orderpriority group by 1").fetchall()
    got = registry.QUERIES["j11_first_sharing"](spark, FOLDER).select("o_orderkey", "first").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == len(table("orders").fetchall())


def test_u3_keeps_every_distinct_word(spark):
    words = lambda text: " ".join(dict.fromkeys(re.findall(r"[^\W_]+", text or "")))
    got = {(r.conv_id, r.turn, r.words) for r in registry.QUERIES["u3_distinct_ordered"](spark, FOLDER).collect()}
    want = {(c, t, words(x)) for c, t, x in duckdb.execute(f"select conv_id, turn, text from '{FOLDER}/conversations.parquet'").fetchall()}
    assert got == want and any(len(w.split()) > 5 for _, _, w in want)
