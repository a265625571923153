"""Every pair of texts is compared token by token, however large it is."""

import json
import random

import pytest

from parchmill.operators import comparison as M
from parchmill.plans import registry


def by_table(a, b):
    """Operations by the whole table of common lengths."""
    left = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            left[i][j] = left[i + 1][j + 1] + 1 if a[i] == b[j] else max(left[i + 1][j], left[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out, i, j = [*out, ("same", a[i])], i + 1, j + 1
        elif left[i + 1][j] >= left[i][j + 1]:
            out, i = [*out, ("delete", a[i])], i + 1
        else:
            out, j = [*out, ("insert", b[j])], j + 1
    return out + [("delete", t) for t in a[i:]] + [("insert", t) for t in b[j:]]


def test_rows_of_bits_are_the_table():
    r = random.Random(11)
    for k in range(600):
        a, b = ([r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 40 if k % 2 else 8))] for _ in range(2))
        assert M.operations(a, b) == by_table(a, b)
    a, b = ([r.choice("abcdefgh") for _ in range(n)] for n in (403, 380))
    assert M.operations(a, b) == by_table(a, b)


@pytest.mark.parametrize("name", ["t15_token_diff", "t16_letter_diff"])
def test_large_pairs_are_compared_too(spark, tmp_path, name):
    words = [f"w{k}" for k in range(700)]
    old, new = " ".join(words), " ".join(w for w in words if w != "w350")
    spark.createDataFrame([(1, 0, "user", old), (1, 1, "user", new)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    ops = json.loads(registry.QUERIES[name](spark, str(tmp_path)).first().operations)
    assert len(old) * len(new) > M.LETTER_CELLS and len(words) ** 2 > M.TOKEN_CELLS
    assert sorted("".join(o["token"] for o in ops if o["op"] == "delete")) == sorted(" w350")
    assert not [o for o in ops if o["op"] == "insert"] and sum(o["op"] == "same" for o in ops) == len(new if name == "t16_letter_diff" else words) - (name == "t15_token_diff")
