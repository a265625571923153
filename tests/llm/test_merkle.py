"""The manifest against a plain recursion over lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from parchmill.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reduced(level):
    """(root, proof of each leaf as a list of (left, right, whether hashed))."""
    proofs, own = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for leaf, at in enumerate(own):
            low = at - at % 16
            proofs[leaf].append(("".join(level[low:at]), "".join(level[at + 1 : low + 16])))
        own = [at // 16 for at in own]
        level = [h("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], proofs


def plain(rows):
    """rows: (tree, key, leaf, claimed)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[0]].append(r)
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    below = {}
    for t in order:
        trees[t].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3] is not None, r[3] or ""))
        below[t] = reduced([r[2] for r in trees[t]])
    root, above = reduced([below[t][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for r, path in zip(trees[t], below[t][1], strict=True):
            path, node = path + above[k], r[3] or r[2]
            for left, right in path:
                node = h(left + node + right)
            out.append((r[1], r[2], below[t][0], root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(map(repr, out))


def test_leaf_digest(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "é", None), (-12, "", "x")], "a long, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [h("1:12:é-"), h("3:-120:1:x")]


@pytest.mark.parametrize("sizes", [[1], [2, 1], [16], [17], [256], [257, 1, 15, 16], [1] * 40, [4097, 3, 300]])
def test_proofs(spark, sizes):
    r = random.Random(len(sizes))
    names = [None, "", "é", "z", "Z", *[f"t{k}" for k in range(40)]]
    rows = [(names[k], r.choice([None, j, j // 2]), h(str(r.random())), h("other") if r.random() < 0.2 else None) for k, n in enumerate(sizes) for j in range(n)]
    df = spark.createDataFrame(rows, "tree string, key long, leaf string, claimed string").repartition(6)
    got = merkle.proofs(df).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain(rows)
    assert {x["verified"] for x in got} <= {True, False}
    assert sum(not x["verified"] for x in got) == sum(x[3] is not None for x in rows)


def test_repeated_rows_and_other_columns(spark):
    rows = [("a", 5, h("x"), None)] * 40 + [("a", 5, h("y"), None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "tree string, key long, leaf string, claimed string, place int")
    assert sorted(repr(tuple(x)) for x in merkle.proofs(df).collect()) == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "tree string, key long, leaf string, claimed string")
    assert merkle.proofs(df).collect() == []


def test_query_tampers_by_crc(spark, tmp_path):
    docs = [(k, t, "en", "s", 3) for k, t in enumerate(["Abc", None, "", "abc", "ÀB", "XyZ" * 50_000] * 8)] + [(None, "Abc", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["verified"] for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == {d: d is None or not (zlib.crc32(str(d).encode()) % 5 == 0 and t is not None and t.translate(low) != t) for d, t, *_ in docs}
    assert False in got.values()
