"""Connected components: local forests first, then rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.session import discard, settled

#: Edges that one task contracts (16 bytes each).
EDGES_PER_TASK = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node of these edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, own = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = own.copy()
        np.minimum.at(low, x, own[y])
        np.minimum.at(low, y, own[x])
        np.minimum.at(low, own, low.copy())
        low = low[low]
        if (low == own).all():
            return nodes, nodes[own]
        own = low


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): for every node that an edge names, the least node it can reach.

    Each task first turns up to EDGES_PER_TASK edges into stars around the least node that they reach. If that took one
    task, the stars are the answer. Otherwise rounds of joins go on with the stars: each takes the least label among a
    node's neighbours and then jumps to the label's own label, so the number of rounds grows with the logarithm of the
    longest path. Rounds are cut by tables in the shared folder. Minima are combined before the shuffle; the joins put
    both sides through plain exchanges, which adaptive execution splits where one label is very common. Null ends are
    ignored, loops and repeats do no harm.
    """
    spark = edges.sparkSession
    pairs = settled(edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null and a <> b"), "cc-edges")
    tasks = -(-pairs.count() // EDGES_PER_TASK)
    if not tasks:
        return spark.createDataFrame([], "node long, component long")

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n > 2 * EDGES_PER_TASK:
                held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n > EDGES_PER_TASK:
                    yield star(*held.pop())
                    n = 0
        if held:
            yield star(*stars(*map(np.concatenate, zip(*held, strict=True))))

    def star(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    contracted = settled(pairs.coalesce(tasks).mapInArrow(contract, "a long, b long"), "cc-stars")
    discard(pairs)
    if tasks == 1:
        return contracted.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return _rounds(contracted)


def _rounds(pairs: DataFrame) -> DataFrame:
    """(node, component) from edges (a, b) by rounds of joins; every node stands in an edge, loops included."""
    both = settled(pairs.union(pairs.select("b", "a")).distinct(), "cc-both")
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        spread = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        lower = settled(labels.join(spread, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "cc-spread")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        discard(labels)
        after = settled(lower.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "cc-labels")
        discard(lower)
        if after.where("old <> label").isEmpty():
            discard(both)
            return after.select("node", F.col("label").alias("component"))
        labels = after.select("node", "label")
        labels._settled_at = after._settled_at
