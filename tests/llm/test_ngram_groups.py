"""The Jaccard join on large groups: texts that are alike but mostly below the threshold, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill.llm import differences, ngram_join
from parchmill.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def groups():
    """Groups of copies of one text with few to many edits, cut copies, and copies of copies; some groups share a passage."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abdegikmnorstu") for _ in range(r.randint(2, 9))) for _ in range(400)]
    out = []
    passage = r.choices(vocabulary, k=40)
    for size, edits, shared in [(150, 9, False), (90, 5, True), (60, 14, True), (40, 1, False)]:
        base = r.choices(vocabulary, k=r.randint(60, 160)) + passage * shared
        for k in range(size):
            x = list(base if k % 5 else out[-1].split() if out else base)
            for _ in range(r.randint(0, edits)):
                at = r.randrange(len(x))
                x[at : at + r.randint(0, 2)] = r.choices(vocabulary, k=r.randint(0, 2))
            out.append(" ".join(x[: len(x) - (r.randrange(12) if k % 7 == 0 else 0)]))
    return out


def components(texts, size, percent):
    sets = [set(shingle_set(t, size).tolist()) for t in texts]
    own = list(range(len(sets)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                own[high] = low
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize(("small", "block", "rare"), [(24, 1024, 16), (15, 7, 16), (40, 1024, 40)])
def test_large_groups_equal_brute_force(spark, monkeypatch, groups, size, percent, small, block, rare):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", small)
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(differences, "BLOCK", block)
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(groups)], SCHEMA).withColumn("lead", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, size, percent).collect()}
    want = components(groups, size, percent)
    assert len({c for _, c in want.values()}) > 50
    assert got == want


def test_differences_of_every_linked_pair_meet():
    """Whatever the leader: of a linked pair, at least one far from it, the indexed tokens share one."""
    r = np.random.default_rng(6)
    pairs = 0
    for _ in range(4000):
        percent = int(r.choice([80, 90]))
        base = np.unique(r.integers(0, 2**40, int(r.integers(2, 120))).astype(np.uint64))
        near = lambda x, share: np.unique(np.concatenate([x[r.random(len(x)) > share], r.integers(0, 2**40, r.poisson(share * len(x))).astype(np.uint64)]))
        x = near(base, r.choice([0.02, 0.1, 0.3]))
        y = near(x, r.choice([0.01, 0.05, 0.1]))
        common = len(np.intersect1d(x, y))
        if not common or 100 * common < percent * (len(x) + len(y) - common) or np.array_equal(x, y):
            continue
        dx, dy = np.setxor1d(x, base), np.setxor1d(y, base)
        (near_x, kx), (near_y, ky) = (differences.reach(len(s), len(base), len(d), percent) for s, d in ((x, dx), (y, dy)))
        if near_x and near_y:
            continue
        pairs += bool(len(dx) and len(dy))
        if len(dx) and len(dy):
            assert len(np.intersect1d(dx[:kx], dy[:ky]))
    assert pairs > 300


def test_blocks_leave_only_what_sketches_allow():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 3000, int(r.integers(1, 400))).astype(np.uint64)) for _ in range(60)]
    sets += [s[: int(len(s) * 0.97)] for s in sets]
    doc, n, label = np.arange(len(sets)), np.array([len(s) for s in sets]), np.arange(len(sets)) % 50
    a, b = differences.alike(doc, doc, doc, n, label, [differences.small_sketch(s) for s in sets], 90)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    linked = {(x, y) for y in range(len(sets)) for x in range(y) if label[x] != label[y] and 100 * (c := len(np.intersect1d(sets[x], sets[y]))) >= 90 * (n[x] + n[y] - c)}
    assert linked and linked <= got and all(label[x] != label[y] for x, y in got)


def test_what_leaves_blocks_is_no_square(spark):
    """Texts that are far from their leader and linked with each other: a block leaves fewer rows than it has members, not all pairs."""
    lead = [f"w{k}" for k in range(200)]
    core = lead[:140] + [f"v{k}" for k in range(60)]
    texts = [" ".join([*core[:k], f"own{k}", *core[k + 1 :]]) for k in range(150)]
    rows = spark.createDataFrame([(k + 1, 0, t, " ".join(lead)) for k, t in enumerate(texts)], "a long, b long, ta string, tb string")
    apart = differences.from_leaders(rows, 5, 80).cache()
    assert apart.where("near").isEmpty()
    met = differences.buckets(differences.prefixes(apart), apart, spark.createDataFrame([], "node long, component long"))
    got = differences.candidates(met, 80).collect()
    assert all(r.sure for r in got) and {x for r in got for x in (r.a, r.b)} == set(range(1, 151))
    assert len(got) < 10 * len(texts) < len(texts) * (len(texts) - 1) / 2 / 5


@pytest.mark.parametrize("held", [0, 1024])
def test_longer_differences_are_verified_on_whole_sets(spark, monkeypatch, groups, held):
    monkeypatch.setattr(differences, "HELD", held)
    monkeypatch.setattr(differences, "COLUMNS", 5)
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(groups)], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, 5, 80).collect()}
    assert got == components(groups, 5, 80)
