"""Hard negatives by branch and bound over ball trees.

Rows are dealt out by ranges of (dimension, label, a sketch of the direction), so that a chunk of at most CHUNK_ROWS rows holds
few labels and vectors that point alike; each chunk becomes one ball tree. For a query q and a ball with centre c and radius r
every inner product lies within q.c - |q| r and q.c + |q| r. Anchors are searched in blocks: a block goes down a
tree together, and at each ball those anchors leave for which it lies outside every score window, strictly beneath the
current k-th score of every window, or holds no row of an asked label. Ties with the k-th are looked at, for a smaller id
wins. Scores are integers; products are exact in doubles while norms allow it, else in 64-bit integers.

The first search finds each anchor's positives in the chunks that hold its label; their scores are the windows of the second
search, which goes to all chunks that hold another label. Each pair of a chunk and a block of at most BLOCK_ANCHORS anchors is
one bounded task; the best k of all chunks are chosen by a window that Spark limits before its shuffle. Every anchor meets
every chunk, so the rows sent grow with anchors times chunks, in two bytes a component where these fit.

Defined results: rows whose id, label or vector is null, or whose vector is empty or holds a null or non-finite component, take no
part; nor do rows whose integer vector has a squared norm over 2**62, for their scores may not fit 64 bits. Vectors of
different lengths never meet. Repeated rows are rows of their own (each is its own anchor, and another's positive or
negative), ties between them go by their place in the table. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmill.session import discard, read_table, settled, shuffle_width

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 80, 100
CHUNK_ROWS, LEAF_ROWS, BLOCK_ANCHORS = 8192, 64, 4096
LARGEST = 2.0**62
NONE, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SKETCH_BITS = 12
FOUND = "anchor long, anchor_id long, place int, positive_id long, positive_score long, row long, id long, score long"


def _packed(v: np.ndarray) -> bytes:
    """An integer vector, two bytes a component where that holds all of them, else eight."""
    return v.astype("<i2" if np.abs(v).max(initial=0) < 1 << 15 else "<i8").tobytes()


def _unpacked(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), dim), dtype=np.int64)
    for k, x in enumerate(raw):
        out[k] = np.frombuffer(x, dtype="<i2" if len(x) == 2 * dim else "<i8")
    return out


def _integer_rows(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, dim, sketch, v) of rows with usable vectors."""
    planes: dict[int, np.ndarray] = {}
    for b in batches:
        out = []
        for vec, label, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x = np.floor(scale * np.array(values, dtype=np.float64))
            if not (x * x).sum() <= LARGEST:
                continue
            if len(x) not in planes:
                planes[len(x)] = np.random.default_rng(len(x)).standard_normal((len(x), SKETCH_BITS))
            sketch = int(((x @ planes[len(x)]) > 0) @ (1 << np.arange(SKETCH_BITS)))
            out.append((vec, label, len(x), sketch, _packed(x.astype(np.int64))))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["vec_id", "label", "dim", "sketch", "v"])


class BallTree:
    """Rows in an order in which every ball is a stretch; children of ball k are at left[k] and right[k], -1 of a leaf."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray):
        x = v.astype(np.float64)
        order, balls, todo = np.arange(len(v)), [], [(0, len(v), -1, 0)]
        left, right = [], []
        while todo:
            low, high, parent, side = todo.pop()
            here = order[low:high]
            centre = x[here].mean(0)
            away = ((x[here] - centre) ** 2).sum(1)
            k = len(balls)
            balls.append((low, high, centre, np.sqrt(away.max()), codes[here].min(), codes[here].max()))
            left.append(-1)
            right.append(-1)
            if parent >= 0:
                (left, right)[side][parent] = k
            if high - low > LEAF_ROWS and away.max() > 0:
                far = x[here[away.argmax()]]
                other = x[here[((x[here] - far) ** 2).sum(1).argmax()]]
                along = (x[here] @ (other - far)).argsort(kind="stable")
                order[low:high] = here[along]
                middle = (low + high) // 2
                todo += [(low, middle, k, 0), (middle, high, k, 1)]
        self.low, self.high = (np.array([b[k] for b in balls]) for k in (0, 1))
        self.centres, self.radii = np.stack([b[2] for b in balls]), np.array([b[3] for b in balls])
        self.least_code, self.last_code = (np.array([b[k] for b in balls]) for k in (4, 5))
        self.left, self.right = np.array(left), np.array(right)
        self.v, self.ids, self.rows, self.codes = v[order], ids[order], rows[order], codes[order]
        self.norm = float(np.sqrt((x * x).sum(1).max(initial=0)))

    def search(self, q: np.ndarray, own: np.ndarray, code: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and each of its windows (inclusive; query x window) the first k of the rows whose code is the query's
        (same) or is not, without the row `own`: scores (NONE where there are fewer), ids and rows."""
        shape = (*low.shape, k)
        scores, ids, rows = np.full(shape, NONE), np.full(shape, MOST), np.full(shape, MOST)
        x = q.astype(np.float64)
        size = np.sqrt((x * x).sum(1))
        exact = size.max(initial=0) * self.norm < 2.0**52
        points = self.v.astype(np.float64) if exact else self.v
        near, reach = x @ self.centres.T, size[:, None] * self.radii[None, :]
        slack = 1e-6 + 1e-9 * (reach + size[:, None] * self.norm)
        above, below = near + reach + slack, near - reach - slack
        todo = [(0, np.arange(len(q)))]
        while todo:
            ball, active = todo.pop()
            one = self.least_code[ball] == self.last_code[ball]
            if same:
                active = active[(code[active] >= self.least_code[ball]) & (code[active] <= self.last_code[ball])]
            elif one:
                active = active[code[active] != self.least_code[ball]]
            need = np.maximum(low[active], scores[active, :, k - 1])
            active = active[((above[active, ball, None] >= need) & (below[active, ball, None] <= high[active])).any(1)]
            if not len(active):
                continue
            if self.left[ball] >= 0:  # the child that promises more is looked at first
                a, b = self.left[ball], self.right[ball]
                first = above[active, a].sum() >= above[active, b].sum()
                todo += [(b, active), (a, active)] if first else [(a, active), (b, active)]
                continue
            at = slice(self.low[ball], self.high[ball])
            s = ((x if exact else q)[active] @ points[at].T).astype(np.int64)
            fit = (self.codes[at][None, :] == code[active, None]) == same
            fit &= self.rows[at][None, :] != own[active, None]
            for w in range(low.shape[1]):
                ok = fit & (s >= np.maximum(low[active, w], scores[active, w, k - 1])[:, None]) & (s <= high[active, w][:, None])
                hit = np.flatnonzero(ok.any(1))
                if not len(hit):
                    continue
                to = active[hit]
                wide = (len(hit), at.stop - at.start)
                all_scores = np.concatenate([scores[to, w], np.where(ok[hit], s[hit], NONE)], axis=1)
                all_ids = np.concatenate([ids[to, w], np.where(ok[hit], np.broadcast_to(self.ids[at], wide), MOST)], axis=1)
                all_rows = np.concatenate([rows[to, w], np.where(ok[hit], np.broadcast_to(self.rows[at], wide), MOST)], axis=1)
                best = np.lexsort((all_rows, all_ids, ~all_scores), axis=-1)[:, :k]
                scores[to, w], ids[to, w], rows[to, w] = (np.take_along_axis(a, best, 1) for a in (all_scores, all_ids, all_rows))
        return scores, ids, rows


def ball_trees(rows: DataFrame, dealt: int) -> DataFrame:
    """(chunk, dim, labels, tree): trees of at most CHUNK_ROWS rows of one dimension, settled."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held = TaskContext.get().partitionId(), 0, []

        def tree() -> pa.RecordBatch:
            nonlocal made, held
            table = pa.Table.from_batches(held)
            dim = table.column("dim")[0].as_py()
            labels = table.column("label").to_pylist()
            known = sorted(set(labels))
            codes = np.searchsorted(np.array(known, dtype=object), np.array(labels, dtype=object))
            ball = BallTree(_unpacked(table.column("v"), dim), table.column("vec_id").to_numpy(), table.column("number").to_numpy(), codes)
            made, held = made + 1, []
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made - 1]), pa.array([dim], pa.int32()), pa.array([known], pa.list_(pa.string())), pa.array([pickle.dumps(ball, 5)], pa.binary())], names=["chunk", "dim", "labels", "tree"])

        for b in batches:
            dims = b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                while start < stop:
                    if held and held[0].column(2)[0].as_py() != dims[start]:
                        yield tree()
                    take = min(stop - start, CHUNK_ROWS - sum(h.num_rows for h in held))
                    held.append(b.slice(start, take))
                    start += take
                    if sum(h.num_rows for h in held) == CHUNK_ROWS:
                        yield tree()
        if held:
            yield tree()

    order = ["dim", "label", "sketch", "number"]
    sorted_rows = rows.select("vec_id", "label", "dim", "v", "sketch", "number").repartitionByRange(dealt, *order).sortWithinPartitions(*order)
    return settled(sorted_rows.mapInArrow(build, "chunk long, dim int, labels array<string>, tree binary"), "trees")


def _searched(trees: DataFrame, asked: DataFrame, k: int, same: bool, low: int, high: int) -> DataFrame:
    """FOUND: the first k of each chunk for each asked (chunk, blocks, number, vec_id, label, v, positives). positives: array of
    (id, score), one window each; for `same` a single one without bounds."""
    width = shuffle_width(trees.sparkSession)
    sides = asked.select("chunk", F.expr("cast(pmod(xxhash64(number), blocks) as int)").alias("block"), F.lit(None).cast("binary").alias("tree"), F.lit(None).cast("array<string>").alias("labels"), "number", "vec_id", "label", "v", "positives")
    blocks = asked.select("chunk", F.expr("cast(pmod(xxhash64(number), blocks) as int)").alias("block")).distinct()
    stored = trees.join(blocks, "chunk").select("chunk", "block", "tree", "labels", *[F.lit(None).cast(t).alias(c) for c, t in asked.select("number", "vec_id", "label", "v", "positives").dtypes])
    both = stored.unionByName(sides).repartition(width, "chunk", "block")

    def search(table: pa.Table) -> pa.Table:
        is_tree = np.array([x is not None for x in table.column("labels").to_pylist()], dtype=bool)
        tree_row, anchors = table.filter(pa.array(is_tree)), table.filter(pa.array(~is_tree))
        known = tree_row.column("labels")[0].as_py()
        tree: BallTree = pickle.loads(tree_row.column("tree")[0].as_py())
        code_of = {x: c for c, x in enumerate(known)}
        code = np.array([code_of.get(x, -1) for x in anchors.column("label").to_pylist()])
        q = _unpacked(anchors.column("v"), tree.v.shape[1])
        own, own_id = anchors.column("number").to_numpy(), anchors.column("vec_id").to_numpy()
        positives = anchors.column("positives").to_pylist()
        n = max((len(p) for p in positives), default=0)
        base, known_id = np.full((len(q), n), NONE), np.zeros((len(q), n), dtype=np.int64)
        lows, highs = np.full((len(q), n), MOST), np.full((len(q), n), NONE)  # no window of its own: an empty one
        for i, ps in enumerate(positives):
            for j, p in enumerate(ps):
                base[i, j], known_id[i, j] = p["score"], p["id"]
                if same:
                    lows[i, j], highs[i, j] = NONE, MOST
                else:  # whole hundreds apart, so that nothing overflows
                    whole, rest = divmod(p["score"], 100)
                    lows[i, j], highs[i, j] = low * whole - (-low * rest // 100), high * whole + high * rest // 100
        scores, ids, rows = tree.search(q, own, code, lows, highs, k, same)
        a, w, c = np.nonzero(rows != MOST)
        cols = [own[a], own_id[a], w.astype(np.int32), known_id[a, w], base[a, w], rows[a, w, c], ids[a, w, c], scores[a, w, c]]
        return pa.table([pa.array(x) for x in cols], names=["anchor", "anchor_id", "place", "positive_id", "positive_score", "row", "id", "score"])

    return both.groupBy("chunk", "block").applyInArrow(search, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and place, with their rank."""
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, vec: str = "vec_id", label: str = "label", embedding: str = "embedding", scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that the condition `anchors` (over
    vec_id) names and each of its positives the first negatives within the window."""
    spark = vectors.sparkSession
    width = shuffle_width(spark)
    rows = vectors.select(F.col(f"`{vec}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("e"))
    usable = rows.where("vec_id is not null and label is not null and e is not null and size(e) > 0 and not exists(e, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    whole = settled(usable.mapInArrow(lambda bs: _integer_rows(bs, scale), "vec_id long, label string, dim int, sketch int, v binary").withColumn("number", F.monotonically_increasing_id()), "vectors")
    trees = ball_trees(whole, max(width, -(-whole.count() // CHUNK_ROWS)))
    wanted = settled(whole.where(anchors).select("number", "vec_id", "label", "dim", "v", F.expr(f"cast(pmod(xxhash64(number, 1), {width}) as int)").alias("salt")), "anchors")

    # Chunks are few rows; each meets the anchors in `width` shares, so that no label or dimension is one task.
    shares = F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("salt")
    chunks = trees.select("chunk", "dim", "labels")
    holds = chunks.select("chunk", "dim", F.explode("labels").alias("label"))
    asks = holds.join(wanted.groupBy("dim", "label").agg(F.count("*").alias("n")), ["dim", "label"]).groupBy("chunk").agg(F.sum("n").alias("n"))
    asks = asks.select("chunk", F.expr(f"cast(ceil(n / {BLOCK_ANCHORS}) as int)").alias("blocks"))
    one = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")))
    asked = wanted.join(holds.join(asks, "chunk").select("chunk", "dim", "label", "blocks", shares), ["dim", "label", "salt"]).select("chunk", "blocks", "number", "vec_id", "label", "v", one.alias("positives"))
    first = _first(_searched(trees, asked, positives, True, low, high), positives)
    ranked = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p")).select(F.col("anchor").alias("number"), F.expr("transform(p, x -> struct(x.id as id, x.score as score))").alias("positives"))  # at most `positives`
    having = settled(wanted.join(ranked, "number"), "positives")

    asks = chunks.join(having.groupBy("dim").agg(F.expr(f"cast(ceil(count(*) / {BLOCK_ANCHORS}) as int)").alias("blocks")), "dim")
    pairs = having.join(asks.select("chunk", "dim", "labels", "blocks", shares), ["dim", "salt"]).where("size(labels) > 1 or labels[0] <> label")
    found = settled(_searched(trees, pairs.select("chunk", "blocks", "number", "vec_id", "label", "v", "positives"), negatives, False, low, high), "negatives")
    discard(whole, trees, wanted, having)
    return _first(found, negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP11_SQL = f"""
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES})
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INT) AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
