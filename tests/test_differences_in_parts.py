"""Operations of many pairs leave a task in parts of a fixed size."""

from pyspark.sql import functions as F

from parchmill.operators import comparison as M


def test_parts_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(M, "OPERATIONS_AT_ONCE", 100)
    pairs = [("ab" * 20, "ba" * 20), (None, "x"), ("", None)] * 50
    parts = list(M.operation_lists(pairs, list, M.LETTER_CELLS))
    whole = [[(o["op"], o["token"]) for o in row] for part in parts for row in part.to_pylist()]
    assert whole == [M.operations(list(x or ""), list(y or "")) for x, y in pairs]
    assert max(len(p.values) for p in parts) < 200


def test_rows_stay_beside_their_operations(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "a" * (k % 50), "b" * 300) for k in range(1000)], "k int, x string, y string").coalesce(1)
    got = rows.select("k", F.size(M.inline_diff(F.col("x"), F.col("y"), letters=True)).alias("n")).collect()
    assert [(r.k, r.n) for r in got] == [(k, k % 50 + 300) for k in range(1000)]
