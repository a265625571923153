"""Near hashes by block combinations against all pairs, and duplicate documents against plain loops."""

import random

import pytest

from parchmill.operators import dedup

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def flipped(r, x, n):
    for k in r.sample(range(64), n):
        x ^= 1 << k
    return x


@pytest.fixture(scope="module")
def hashes():
    r = random.Random(6)
    out = {0, MASK, 1 << 63, 1}
    for _ in range(60):
        base = r.getrandbits(64)
        out.add(base)
        out |= {flipped(r, base, n) for n in (1, 2, 3, 4, 4, 5, 5, 6)}
    # Every way to spread four differing bits over the parts is found.
    base = r.getrandbits(64)
    out |= {base} | {base ^ (1 << 8 * a) ^ (1 << 8 * b + 1) ^ (1 << 8 * c + 2) ^ (1 << 8 * d + 3) for a in range(8) for b in range(8) for c in range(8) for d in range(8)}
    return sorted(map(signed, out))


def near(a, b):
    return ((a ^ b) & MASK).bit_count() <= dedup.NEAR_BITS


def test_near_values_are_all_near_pairs(spark, hashes):
    rows = [(k % 2, v) for k, v in enumerate(hashes)] + [(7, hashes[0]), (8, hashes[1])]
    got = dedup.near_values(spark.createDataFrame(rows, "g long, v long"), "g", "v").collect()
    want = [(g, a, b) for g in (0, 1) for xs in [[v for h, v in rows if h == g]] for i, a in enumerate(xs) for b in xs[i + 1 :] if near(a, b)]
    assert sorted((r.group, r.low, r.high) for r in got) == sorted((g, min(a, b), max(a, b)) for g, a, b in want)
    assert len(got) > 100_000


@pytest.mark.parametrize("block", [7, 100_000])
def test_all_pairs(spark, hashes, block):
    some = random.Random(1).sample(hashes, 300)
    df = spark.createDataFrame(list(enumerate(some)) + [(1000, None)], "k long, v long")
    got = {(r.a, r.b, r.bits) for r in dedup.all_pairs(df, "k", "v", block=block).collect()}
    assert got == {(i, j, ((a ^ b) & MASK).bit_count()) for i, a in enumerate(some) for j, b in enumerate(some) if i < j and near(a, b)}
    assert dedup.all_pairs(df.limit(0), "k", "v").collect() == []


def corpora():
    r = random.Random(20)
    base = [r.getrandbits(64) for _ in range(4)]
    for n in [0, 1, 2, 25, 60, 60, 60]:
        rows = []
        for doc in r.sample(range(1000), n):
            v = flipped(r, r.choice(base), r.choice([0, 0, 1, 2, 4, 5, 8]))
            exact = f"{v:x}{r.choice(['', '', 'x'])}" if r.random() < 0.9 else None
            rows.append((doc, r.choice("uv"), r.choice(["p", "q", "", None]), exact, signed(v) if r.random() < 0.9 else None))
        # One digest has one hash.
        known = {}
        yield [(d, o, p, e, known.setdefault(e, v)) for d, o, p, e, v in rows]


def test_duplicates_against_loops(spark):
    schema = "doc long, owner string, party string, exact string, simhash long"
    for rows in corpora():
        pair = {}
        for a, o, p, e, v in rows:
            for b, o2, p2, e2, v2 in rows:
                if a == b or o != o2 or e is None or e2 is None:
                    continue
                if e == e2:
                    pair[a, b] = 1.0
                elif p and p == p2 and v is not None and v2 is not None and near(v, v2):
                    pair[a, b] = 1 - ((v ^ v2) & MASK).bit_count() / 64
        df = spark.createDataFrame(rows, schema)
        best = {a: min((b, s) for (x, b), s in pair.items() if x == a) for a, _ in pair}
        got = {r.doc: (r.match, r.similarity) for r in dedup.earliest_match(df, "doc", "party", "owner").collect()}
        assert got == {a: (b, round(s, 4)) for a, (b, s) in best.items()}
        links = [(r.a, r.b) for r in dedup.duplicate_pairs(df, "doc", "party", "owner").collect()]
        assert len(set(links)) == len(links) and all(pair.get(x) is not None for x in links)

        def classes(edges):
            own = {}

            def find(x):
                while own.setdefault(x, x) != x:
                    x = own[x]
                return x

            for a, b in edges:
                own[find(a)] = find(b)
            return {frozenset(y for y in list(own) if find(y) == find(x)) for x in list(own)}

        assert classes(links) == classes(pair)


def test_hashes_are_not_broadcast(spark):
    """Each hash is sent 70 times; Spark's estimate does not see that."""
    from parchmill.operators import dedup

    rows = spark.createDataFrame([(1, k) for k in range(50)], "g long, v long")
    assert "BroadcastExchange" not in dedup.near_values(rows, "g", "v")._jdf.queryExecution().executedPlan().toString()
