"""All pairs of near hashes in few blocks, against a plain matrix."""

import numpy as np

from parchmill.operators import dedup


def test_rows_are_sent_to_few_blocks():
    """With blocks of 2,048 a row of three million was sent 1,466 times."""
    assert [dedup.block_count(n, 65_536) for n in (0, 1, 2048, 2049, 10_000, 300_000, 3_000_000)] == [1, 1, 1, 2, 5, 24, 46]


def test_pairs_of_uneven_hashes(spark):
    """Hashes with few and with many ones, copies, and pairs whose numbers of ones are as far apart as they may be."""
    r = np.random.default_rng(4)
    ones = r.integers(0, 65, 2500)
    v = np.array([sum(1 << int(k) for k in r.choice(64, n, replace=False)) for n in ones], dtype=np.uint64)
    v[2000:2400] = v[:400] ^ np.array([(1 << int(k)) - 1 for k in r.integers(0, 6, 400)], dtype=np.uint64)
    v[2400:] = v[7]
    df = spark.createDataFrame(list(enumerate(v.view(np.int64).tolist())), "k long, v long")
    bits = np.bitwise_count(v[:, None] ^ v[None, :])
    a, b = np.nonzero(np.triu(bits <= dedup.NEAR_BITS, 1))
    got = sorted((x.a, x.b, x.bits) for x in dedup.all_pairs(df, "k", "v").collect())
    assert got == sorted(zip(a.tolist(), b.tolist(), bits[a, b].tolist(), strict=True)) and len(got) > 5000
