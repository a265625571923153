"""Near-duplicate vectors by product quantisation.

Coarse centroids give inverted lists; what is left of a unit vector after its centroid is cut into subspaces, each
coded by its nearest codeword. A query goes to the lists whose centroids are nearly as near as its own, looks its
distances to the codes up in tables (asymmetric: the query itself is not coded), and what passes is ranked again by
the exact cosine in double precision. A code keeps its own error, so the table look-up never turns a true pair away;
only unprobed lists can lose one. The margin of probing follows from the threshold: two linked vectors are at most
a radius apart, and their distances to one centroid differ by about the radius over the root of the dimension.
Both centroids and codewords are trained on a bounded sample; every row is indexed.

Lists are gathered into cells of about BLOCK_ROWS rows, and a vector is sent once to each cell that holds a list it probes,
not once for each list; a longer list is split into several cells, and a cell's queries into blocks, so no task gets a
whole hot list. A block reports how many links each vector has and one edge from each linked vector to the least vector
of its component there, never pairs. Equal vectors of one label are one row with a multiplicity until the end.

Defined results: rows whose vector is null, zero, or holds null or non-finite components, and rows without a label,
link with nothing; vectors of different lengths never link; repeated rows with one id count as different rows of one
vector. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmill.operators.graph import connected_components
from parchmill.session import read_table, settled

THRESHOLD = 0.93
SUBSPACES = 8
CODEWORDS = 256
MAX_LISTS = 4096
#: Rows of the training sample for each list, and at least; its vectors never take more than SAMPLE_BYTES.
SAMPLE_PER_LIST, LEAST_SAMPLE, SAMPLE_BYTES = 32, 8192, 64 << 20
#: Lists are probed whose centroid is farther than the nearest by at most this multiple of the radius over the root of the
#: dimension (at least LEAST_PROBES lists).
PROBE_MARGIN, LEAST_PROBES = 2.5, 6
BLOCK_ROWS, BLOCK_QUERIES = 2048, 2048


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        total, n = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([_distances(x[k : k + 4096], c).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, dtype=np.int64)


class Quantiser:
    """Coarse centroids and, per subspace, codewords of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float):
        dim = sample.shape[1]
        self.margin = min(2.0, PROBE_MARGIN / dim**0.5) * radius  # twice the radius loses nothing at all
        self.parts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        self.coarse = _kmeans(sample, lists)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.words = [_kmeans(np.ascontiguousarray(rest[:, p]), CODEWORDS, 5) for p in self.parts]

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector."""
        own = _nearest(unit, self.coarse)
        rest = unit - self.coarse[own]
        codes = np.stack([_nearest(np.ascontiguousarray(rest[:, p]), w) for p, w in zip(self.parts, self.words, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1) if len(unit) else rest
        order = np.argsort(np.concatenate(self.parts))
        return own, codes, np.sqrt(((rest - back[:, order]) ** 2).sum(1))

    def probes(self, unit: np.ndarray) -> np.ndarray:
        """Boolean: vector x list."""
        d = np.sqrt(_distances(unit, self.coarse))
        kth = np.partition(d, min(LEAST_PROBES, d.shape[1]) - 1, axis=1)[:, min(LEAST_PROBES, d.shape[1]) - 1]
        return d <= np.maximum(kth, d.min(1) + self.margin)[:, None]

    def looked_up(self, query: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (not squared): query x code, all of one list."""
        rest = query - self.coarse[at]
        total = np.zeros((len(query), len(codes)))
        for k, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            total += _distances(rest[:, p], w)[:, codes[:, k]]
        return np.sqrt(total)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, unit vector as bytes, digest) of the vectors that can link."""
    for b in batches:
        out = []
        for vec, label, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x = np.array(values, dtype=np.float64)
            size = np.sqrt((x * x).sum())
            if size == 0 or not np.isfinite(size):  # very long or very short vectors: scale first
                top = np.abs(x).max(initial=0.0)
                if top == 0 or not np.isfinite(top):
                    continue
                x = x / top
                size = np.sqrt((x * x).sum())
            unit = (x / size + 0.0).astype("<f8").tobytes()
            out.append((vec, label, len(x), unit, hashlib.blake2b(unit, digest_size=16).digest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["vec_id", "label", "dim", "unit", "digest"])


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. Links join rows of one label whose cosine is at least the threshold."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    usable = rows.where("vec_id is not null and label is not null and e is not null and size(e) > 0 and not exists(e, x -> x is null or isnan(x))")
    units = settled(usable.mapInArrow(_unit_rows, "vec_id long, label string, dim int, unit binary, digest binary"), "units")
    classes = settled(units.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "vector-classes")
    found = None
    for dim in [r["dim"] for r in classes.select("dim").distinct().collect()]:
        part = _links(spark, classes.where(F.col("dim") == dim), dim, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = settled(found, "vector-links")
    counts = found.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("to is not null").select(F.col("rep").alias("src"), F.col("to").alias("dst")))
    judged = settled(
        classes.select("label", "dim", "digest", "rep", "copies").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("label", "dim", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "vector-verdicts",
    )
    linked = units.select("vec_id", "label", "dim", "digest").join(judged, ["label", "dim", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not coalesce(vec_id is not null and label is not null and e is not null and size(e) > 0 and not exists(e, x -> x is null or isnan(x)), false) or forall(e, x -> x = 0) or exists(e, x -> abs(x) = double('infinity'))")
    return linked.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def trained(classes: DataFrame, dim: int, radius: float) -> Quantiser:
    """A quantiser from a sample of the classes: those of the least hashes."""
    lists = int(min(MAX_LISTS, max(8, classes.count() ** 0.5)))
    size = min(max(LEAST_SAMPLE, SAMPLE_PER_LIST * lists), SAMPLE_BYTES // (8 * dim))
    sample = classes.select("unit", F.xxhash64("digest").alias("h")).orderBy("h").limit(size).collect()
    return Quantiser(np.frombuffer(b"".join(bytes(r["unit"]) for r in sample), dtype="<f8").reshape(-1, dim), lists, radius)


def _cells(coded: DataFrame) -> DataFrame:
    """label and `places`, an array that gives for each list its cell and the number of parts that the list is split into,
    null where no row is. A label's lists are at most MAX_LISTS."""
    sizes = coded.groupBy("label", F.col("own").alias("list")).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("label").orderBy("list")) - F.col("rows")
    placed = sizes.select("label", "list", F.expr(f"cast(ceil(rows / {BLOCK_ROWS}) as int)").alias("parts"), (before / BLOCK_ROWS).cast("int").alias("cell"))
    known = placed.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("list", F.struct("cell", "parts")))).alias("known"), F.max("list").alias("last"))
    return known.select("label", F.expr("transform(sequence(0, last), k -> known[k])").alias("places"))


def _edges(near: np.ndarray, row_ids: np.ndarray, column_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a boolean matrix the least id of its component."""
    rows, columns, far = row_ids.copy(), column_ids.copy(), np.iinfo(np.int64).max
    while True:
        new_rows, new_columns = rows.copy(), columns.copy()
        for k in range(0, len(rows), 256):
            part = near[k : k + 256]
            new_rows[k : k + 256] = np.minimum(rows[k : k + 256], np.where(part, columns[None, :], far).min(1))
            new_columns = np.minimum(new_columns, np.where(part, new_rows[k : k + 256, None], far).min(0))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def _links(spark: SparkSession, classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(rep, n, to): pieces of each class's number of links (copies of others counted), and edges that keep components."""
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    model = spark.sparkContext.broadcast(trained(classes, dim, radius))  # at most MAX_LISTS centroids

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                b = whole.slice(k, 2048)
                unit = _matrix(b.column(2), dim)
                own, codes, error = q.code(unit)
                probes = [np.flatnonzero(p).tolist() for p in q.probes(unit)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))], names=["label", "rep", "unit", "copies", "own", "codes", "error", "probes"])

    coded = settled(classes.select("label", "rep", "unit", "copies").mapInArrow(code, "label string, rep long, unit binary, copies long, own int, codes binary, error double, probes array<int>"), "coded")
    placed = coded.join(settled(_cells(coded), "cells"), "label")
    stored = placed.select("label", F.expr("places[own].cell").alias("cell"), F.expr("cast(pmod(xxhash64(rep), places[own].parts) as int)").alias("part"), "rep", "unit", "copies", "own", "codes", "error")
    asked = placed.select("label", "rep", "unit", "copies", "own", F.expr("array_distinct(flatten(transform(filter(transform(probes, p -> get(places, p)), x -> x is not null), x -> transform(sequence(0, x.parts - 1), k -> struct(x.cell as cell, k as part)))))").alias("to"))
    asked = asked.select("label", F.explode("to").alias("x"), "rep", "unit", "copies", "own").select("label", "x.cell", "x.part", "rep", "unit", "copies", "own")
    blocks = settled(asked.groupBy("label", "cell", "part").agg(F.expr(f"cast(ceil(count(*) / {BLOCK_QUERIES}) as int)").alias("blocks")), "cell-sizes")
    key = ["label", "cell", "part"]
    stored = stored.join(blocks, key).select(*key, F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("side"), "rep", "unit", "copies", "own", "codes", "error")
    asked = asked.join(blocks, key).select(*key, F.expr("cast(pmod(xxhash64(rep, 1), blocks) as int)").alias("block"), F.lit(1).alias("side"), "rep", "unit", "copies", "own", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"))

    def compare(table: pa.Table) -> pa.Table:
        q = model.value
        side = table.column("side").to_numpy()
        x, y = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        xi, yi = x.column("rep").to_numpy(), y.column("rep").to_numpy()
        if not len(xi) or not len(yi):
            return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        xu, yu = _matrix(x.column("unit"), dim), _matrix(y.column("unit"), dim)
        own_x, own_y = x.column("own").to_numpy(), y.column("own").to_numpy()
        codes = np.frombuffer(b"".join(x.column("codes").to_pylist()), dtype=np.uint8).reshape(len(xi), -1)
        limit = radius + x.column("error").to_numpy()
        asks = q.probes(yu)
        near = np.zeros((len(yi), len(xi)), dtype=bool)
        for at in np.unique(own_x):
            rows, columns = np.flatnonzero(asks[:, at]), np.flatnonzero(own_x == at)
            if len(rows):
                r, c = np.nonzero(q.looked_up(yu[rows], at, codes[columns]) <= limit[columns][None, :])
                r, c = rows[r], columns[c]
                for k in range(0, len(r), 1 << 16):
                    a, b = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
                    near[a, b] = (yi[a] != xi[b]) & ((yu[a] * xu[b]).sum(1) >= threshold)
        # A link also counts for the stored vector, unless that one asks the query's list itself.
        asks_back = q.probes(xu)[:, own_y].T
        for_query = near.astype(np.float64) @ x.column("copies").to_numpy().astype(np.float64)
        for_stored = (near & ~asks_back).astype(np.float64).T @ y.column("copies").to_numpy().astype(np.float64)
        to_y, to_x = _edges(near, yi, xi)
        ids, to, n = np.concatenate([yi, xi]), np.concatenate([to_y, to_x]), np.concatenate([for_query, for_stored]).astype(np.int64)
        use = (n > 0) | (to != ids)
        return pa.table({"rep": pa.array(ids[use]), "n": pa.array(n[use]), "to": pa.array(to[use], mask=(to == ids)[use])})

    return stored.unionByName(asked).groupBy(*key, "block").applyInArrow(compare, "rep long, n long, to long")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""
