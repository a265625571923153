"""Vectors with thousands of planted links against blocked brute force, in blocks of several sizes."""

import numpy as np
import pytest

from parchmill.llm import embeddings


def planted(rows, dim, labels, seed):
    """Random vectors, half of them near to another one (cosine about 0.9 to 0.99), in a few groups many."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(rows, dim))
    for k in range(rows // 2, rows):
        base = x[k % 7] if k % 10 == 0 else x[r.integers(0, rows // 2)]
        unit = base / np.linalg.norm(base)
        x[k] = unit + r.normal(size=dim) * r.choice([0.1, 0.25, 0.35, 0.45]) / dim**0.5
    x[rows // 3] = x[rows // 3 + 1] * 2
    return x, r.integers(0, labels, rows)


def brute(x, label, threshold=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, own = np.zeros(len(x), dtype=int), np.arange(len(x))
    edges = []
    for k in range(0, len(x), 1000):
        a, b = np.nonzero((u[k : k + 1000] @ u.T >= threshold) & (label[k : k + 1000, None] == label[None, :]))
        a = a + k
        links += np.bincount(a[a != b], minlength=len(x))
        edges.append(np.stack([a, b]))
    a, b = np.concatenate(edges, axis=1)
    while True:
        low = own.copy()
        np.minimum.at(low, a, own[b])
        low = low[low]
        if (low == own).all():
            return links, own
        own = low


@pytest.mark.parametrize(("rows", "dim", "block"), [(9000, 32, 2048), (3000, 64, 100), (2000, 8, 2048)])
def test_planted_links_are_found(spark, monkeypatch, rows, dim, block):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    monkeypatch.setattr(embeddings, "BLOCK_QUERIES", block)
    x, label = planted(rows, dim, 3, rows)
    links, own = brute(x, label)
    assert links.sum() > 1000
    data = spark.createDataFrame([(k, v.tolist(), int(b)) for k, (v, b) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(data).collect()}
    found = sum(n for n, _ in got.values())
    assert found >= 0.9 * links.sum() and all(got[k][0] <= links[k] for k in range(rows))
    if found == links.sum():
        assert [got[k][1] for k in range(rows)] == own.tolist()
    print("recall", rows, dim, found / links.sum())
