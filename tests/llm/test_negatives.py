"""Hard negatives against brute force in plain integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill.llm import negatives

SCHEMA = "vec_id long, label string, embedding array<double>"


def usable(row):
    vec, label, e = row
    if vec is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e):
        return False
    return sum(math.floor(256 * x) ** 2 for x in e) <= 2**62


def plain(rows, every, low=80, high=100, k=5):
    good = [(v, lab, [math.floor(256 * x) for x in e]) for v, lab, e in rows if usable((v, lab, e))]
    out = []
    for i, (a, lab, q) in enumerate(good):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=True)), b, m == lab) for j, (b, m, w) in enumerate(good) if j != i and len(w) == len(q))
        for p, b, _ in [x for x in scored if x[2]][:k]:
            fit = [x for x in scored if not x[2] and low * -p <= 100 * -x[0] <= high * -p][:k]
            out += [(a, b, rank + 1, n, -p, -s) for rank, (s, n, _) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, every):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % every == 0).collect())


def table(n, dim, labels, seed, spread=0.4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, dim))
    return [(k, str(int(r.integers(labels))), (centres[k % labels] + spread * r.normal(size=dim)).tolist()) for k in range(n)]


@pytest.mark.parametrize(("n", "dim", "labels", "chunk"), [(600, 8, 4, 100), (400, 3, 60, 64), (500, 16, 1, 200), (300, 2, 3, 8192)])
def test_against_brute_force(spark, monkeypatch, n, dim, labels, chunk):
    monkeypatch.setattr(negatives, "CHUNK_ROWS", chunk)
    rows = table(n, dim, labels, n)
    assert found(spark, rows, 20) == plain(rows, 20)


def test_hard_rows(spark):
    r = random.Random(4)
    rows = table(200, 4, 3, 1)
    rows += [(300, None, [1.0] * 4), (None, "1", [1.0] * 4), (301, "1", None), (302, "1", []), (303, "1", [1.0, None, 1.0, 1.0]), (304, "1", [math.nan] * 4), (305, "1", [math.inf, 1.0, 1.0, 1.0])]
    rows += [(400 + k, str(k % 2), [0.5, -0.25, 1.0, 2.0]) for k in range(60)]  # ties
    rows += [(500 + k, str(k % 2), [r.random(), r.random()]) for k in range(20)]  # other length
    rows += [(600, "1", [1e30] * 4), (602, "1", [1e6] * 4), (604, "2", [0.9e6] * 4), (606, "1", [1.1e6] * 4), (608, "2", [1e6, -1e6, 1e6, 1e6]), (620, "0", [0.0] * 4)]
    assert found(spark, rows, 20) == plain(rows, 20)


def test_large_numbers_stay_exact(spark):
    r = np.random.default_rng(9)
    rows = [(k, str(k % 3), (3e5 * (1 + 1e-7 * r.normal(size=6)) + r.integers(0, 4, size=6)).tolist()) for k in range(150)]
    assert found(spark, rows, 10) == plain(rows, 10)


def test_repeated_rows_of_one_id(spark):
    rows = table(80, 3, 2, 3) + [(200, "1", [0.5, 0.5, 0.5])] * 3 + [(201, "0", [0.5, 0.5, 0.5])] * 2
    got = found(spark, rows, 20)
    assert sorted(set(got)) == sorted(set(plain(rows, 20)))


def test_empty_and_clashing_columns(spark):
    assert found(spark, [(1, None, None)], 1) == []
    rows = table(60, 3, 2, 5)
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("chunk"), F.lit("x").alias("number"), F.lit(2).alias("rank"))
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 20 == 0).collect()) == plain(rows, 20)


def test_balls_are_pruned():
    """Clustered vectors: most leaves are never scored."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(32, 16)) * 300
    v = np.concatenate([centres[k] + r.normal(size=(128, 16)) for k in range(32)]).astype(np.int64)
    tree = negatives.BallTree(v, np.arange(len(v)), np.arange(len(v)), np.zeros(len(v), dtype=np.int64))
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, k):
            looked.append(k)
            return super().__getitem__(k)

    tree.rows = tree.rows.view(Counted)
    q = v[5:6]
    low, high = np.full((1, 1), negatives.NONE), np.full((1, 1), negatives.MOST)
    scores, ids, _ = tree.search(q, np.array([5]), np.array([0]), low, high, 5, True)
    want = sorted(((-int(x), k) for k, x in enumerate(v @ q[0]) if k != 5))[:5]
    assert [(-int(s), int(i)) for s, i in zip(scores[0, 0], ids[0, 0], strict=True)] == want
    assert len({(k.start, k.stop) for k in looked if isinstance(k, slice)}) < len(v) // negatives.LEAF_ROWS // 4
