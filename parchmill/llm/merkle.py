"""Merkle manifest of a dataset: supersteps up the trees, then supersteps down with the sibling paths.

A leaf is the digest of a row's fields. Each tree (a source) has its leaves in order; FAN consecutive nodes have one parent,
whose digest is that of their digests, until one node, the subroot, remains. The subroots, in order of their trees, are the
leaves of one more tree, whose remaining node is the root.

Leaf digests come from DataFrame expressions, so no text leaves the JVM. The trees are climbed as vertices of an RDD, named by
(tree, place in the level): in each superstep the nodes of a level send their digests to their parents, a parent with
all its messages hashes them and goes on to the next superstep, and a node that is alone in its level is its tree's
subroot. A level holds a sixteenth of the one below, and a vertex never gets more than FAN messages, so a source with a
third of all rows is as many small groups as it has runs. Then the supersteps run backwards: a parent sends its own
path, with the run of its children in front, to each of its children. The last one goes to a run of leaves as a whole, where
each leaf folds its claimed digest with its siblings up to the root.

Every level is a file in the shared folder, so a lost executor costs a reread. The driver gets two counts a partition
(where trees that span partitions begin) and the root.

Defined results: leaves of a tree ascend by key, null first, and by digest among equal keys; rows without a tree are one
tree, the first; a null field is a mark of its own, unlike an empty one; repeated rows are leaves of their own; an empty
table has no root and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.session import read_table, scratch_path, settled, shuffle_width

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every fifth document by this hash is held against a copy in lower case.
TAMPERED = 5
WIDTH = 32
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(*fields: Column) -> Column:
    """The digest of fields, each with its length in front, so that no two rows read alike."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def run_digest(run: bytes) -> bytes:
    """The digest of digests (end to end, as bytes) in their written form."""
    return hashlib.sha256(run.hex().encode()).digest()


def fold(digest: bytes, path: Iterable[tuple[int, bytes]]) -> bytes:
    """The root that a node's digest and its path, (place in the run, digests of the run) a level, lead to."""
    for place, run in path:
        digest = run_digest(run[: WIDTH * place] + digest + run[WIDTH * (place + 1) :])
    return digest


def siblings(path: Iterable[tuple[int, bytes]]) -> bytes:
    return b"".join(run[: WIDTH * place] + run[WIDTH * (place + 1) :] for place, run in path)


def _task(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def _saved(rdd: RDD, spark: SparkSession, what: str, level: int = 0) -> RDD:
    """The RDD from files in the shared folder, which cuts its lineage. A level with a sixteenth of the rows is a sixteenth of the
    tasks, so that a task has as many rows at each of them."""
    path, tasks = scratch_path(spark, what), max(1, shuffle_width(spark) // FAN**level)
    rdd.coalesce(tasks).saveAsPickleFile(path)
    return spark.sparkContext.pickleFile(path).coalesce(tasks)


def _placed(rows: DataFrame, tree: str, order: list[str]) -> RDD:
    """((tree, place), (last, row)) of every row. Rows are dealt out by ranges of (tree, order), so places count on from one
    partition to the next; `last` is whether a row is its tree's last."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(shuffle_width(spark), tree, *order).sortWithinPartitions(tree, *order).rdd

    def ends(part: int, it: Iterator) -> Iterator[tuple]:
        first = n_first = last = n_last = None
        for row in it:
            key = (row[tree],)
            if first is None:
                first, n_first = key, 0
            n_first += first == key
            n_last = n_last + 1 if last == key else 1
            last = key
        if first is not None:
            yield part, first, n_first, last, n_last

    begins, follows, running, before = {}, {}, 0, None
    for part, first, n_first, last, n_last in sorted(dealt.mapPartitionsWithIndex(ends).collect(), key=lambda x: x[0]):  # a row a partition
        begins[part] = running if before is not None and before[1] == first else 0
        if before is not None:
            follows[before[0]] = first
        running = begins[part] + n_first if first == last else n_last
        before = (part, last)

    def place(part: int, it: Iterator) -> Iterator[tuple]:
        held, at = None, begins.get(part, 0)
        for row in it:
            if held is not None:
                same = held[tree] == row[tree]
                yield (held[tree], at), (not same, tuple(held))
                at = at + 1 if same else 0
            held = row
        if held is not None:
            yield (held[tree], at), (follows.get(part) != (held[tree],), tuple(held))

    return dealt.mapPartitionsWithIndex(place)


@dataclass
class Forest:
    """levels[k]: ((tree, place), (last, digest, children's run)) of the nodes k + 1 above the leaves; roots: (tree, (height,
    digest)) of each tree's remaining node."""

    levels: list[RDD]
    roots: RDD


def climb(leaves: RDD, spark: SparkSession) -> Forest:
    """leaves: ((tree, place), (last, digest))."""
    width, levels, roots, level = shuffle_width(spark), [], [], leaves

    def sends(node: tuple) -> tuple:
        (tree, place), (last, digest) = node[0], node[1][:2]
        return (tree, place // FAN), (place % FAN, last, digest)

    def hashes(messages: Iterable[tuple]) -> tuple:
        ordered = sorted(messages)
        run = b"".join(m[2] for m in ordered)
        return ordered[-1][1], run_digest(run), run

    def alone(node: tuple) -> bool:
        return node[0][1] == 0 and node[1][0]

    while True:
        height = len(levels)
        roots.append(level.filter(alone).map(lambda x, h=height: (x[0][0], (h, x[1][1]))))
        going = level.filter(lambda x: not alone(x))
        if going.isEmpty():
            return Forest(levels, spark.sparkContext.union(roots))
        level = _saved(going.map(sends).groupByKey(width, _task).mapValues(hashes), spark, f"level{height + 1}", height + 1)
        levels.append(level)


def _meet(left: RDD, right: RDD, width: int) -> RDD:
    """(key, ([left], [right])): a key has one row on the right and at most FAN on the left."""
    both = left.mapValues(lambda v: (0, v)).union(right.mapValues(lambda v: (1, v)))
    return both.groupByKey(width, _task).mapValues(lambda vs: tuple([v for s, v in vs if s == side] for side in (0, 1)))


def descend(forest: Forest, starts: RDD, spark: SparkSession, stop: int) -> RDD:
    """((tree, place), (height of the tree, message, path)) of the nodes at `stop`, and of the roots of trees that are lower.
    starts: (tree, (height, message, path)) at each tree's root."""
    width = shuffle_width(spark)
    at_root = starts.map(lambda x: ((x[0], 0), x[1]))
    here = spark.sparkContext.emptyRDD()

    def sends(met: tuple) -> Iterator[tuple]:
        (tree, place), (nodes, got) = met
        for (_, _, run) in nodes:
            for height, message, path in got:
                for child in range(len(run) // WIDTH):
                    yield (tree, FAN * place + child), (height, message, [(child, run), *path])

    for k in range(len(forest.levels), stop, -1):
        here = here.union(at_root.filter(lambda x, k=k: x[1][0] == k))
        here = _saved(_meet(forest.levels[k - 1], here, width).flatMap(sends), spark, f"paths{k}", max(0, k - 2))
    return here.union(at_root.filter(lambda x: x[1][0] <= stop))


def proofs(leaves: DataFrame, tree: str = "tree", key: str = "key", leaf: str = "leaf", claimed: str = "claimed") -> DataFrame:
    """PROOFS (doc_id is the key) of every row: its digest's place under the root, and whether its claimed digest (null: the
    leaf itself) leads to that root with the leaf's own siblings. leaf and claimed are written in hex."""
    spark = leaves.sparkSession
    width = shuffle_width(spark)
    # On disk before they are put in order: the sort looks at its input twice, and digests of whole texts are made once.
    rows = settled(leaves.select(F.col(tree).cast("string").alias("tree"), F.col(key).cast("long").alias("key"), F.unhex(leaf).alias("leaf"), F.unhex(claimed).alias("claimed")), "digests")
    bottom = _saved(_placed(rows, "tree", ["key", "leaf", "claimed"]).mapValues(lambda v: (v[0], bytes(v[1][2]), v[1][1], v[1][3] and bytes(v[1][3]))), spark, "leaves")
    forest = climb(bottom, spark)
    subroots = settled(spark.createDataFrame(forest.roots.map(lambda x: (x[0], x[1][0], x[1][1])), "tree string, height int, digest binary", verifySchema=False), "roots")
    # All subroots are one tree, and each stays by its own tree's name in the rows.
    top_rows = _saved(_placed(subroots.select(F.lit(0).alias("all"), "tree", "height", "digest"), "all", ["tree"]), spark, "subroots")
    top = climb(top_rows.mapValues(lambda v: (v[0], bytes(v[1][3]))), spark)
    root = [digest for _, (_, digest) in top.roots.collect()]  # one row, none of an empty table
    if not root:
        return spark.createDataFrame([], PROOFS)
    root = root[0]
    top_paths = descend(top, top.roots.map(lambda x: (x[0], (x[1][0], None, []))), spark, 0)

    def begin(met: tuple) -> Iterator[tuple]:
        nodes, paths = met[1]
        for _, row in nodes:
            for _, _, path in paths:
                yield row[1], (row[2], bytes(row[3]), path)

    starts = _saved(_meet(top_rows, top_paths, width).flatMap(begin), spark, "starts")
    paths = descend(forest, starts, spark, 1)

    def check(met: tuple) -> Iterator[tuple]:
        members, got = met[1]
        members.sort()
        run = b"".join(m[1] for m in members)
        for height, subroot, path in got:
            parent = run_digest(run)
            above = {parent: fold(parent, path)}
            upper = siblings(path)
            for place, digest, ident, other in members:
                if height == 0:
                    folded, beside = fold(other or digest, path), b""
                else:
                    beside = siblings([(place, run)])
                    own = fold(other or digest, [(place, run)])
                    folded = above[own] if own in above else fold(own, path)
                proof = hashlib.sha256((beside + upper).hex().encode()).hexdigest()
                yield ident, digest.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root

    members = bottom.map(lambda x: ((x[0][0], x[0][1] // FAN), (x[0][1] % FAN, x[1][1], x[1][2], x[1][3])))
    return spark.createDataFrame(_meet(members, paths, width).flatMap(check), PROOFS, verifySchema=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    claimed = F.when(touched, leaf_digest(*fields[:-1], lowered))
    return proofs(docs.select(F.col("source").alias("tree"), F.col("doc_id").alias("key"), leaf_digest(*fields).alias("leaf"), claimed.alias("claimed")))


def _oracle(levels: int = 7) -> str:
    """The same rows for DuckDB: each level by windows. `levels` of 16 reach beyond the driver's tables; trees that are done
    earlier stay as they are."""
    crc = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: [CAST(-1 - ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INT), 1)) AS BIGINT), -1000, -1000, -1000, -1000, -1000, -1000, -1000, -1000]))), lambda a, x: CASE WHEN x = -1000 THEN CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END ELSE xor(a, -1 - x) END)"
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    digest = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:-1]), field(text)]) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [f"WITH a0 AS (SELECT doc_id, source AS t, {digest('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % {TAMPERED} = 0 THEN {digest(low)} END AS other FROM documents)"]
    out.append("b0 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS row FROM a0)")
    out.append("s0 AS (SELECT t, i, leaf AS h FROM b0)")

    def tree(name: str) -> None:
        for k in range(levels):
            out.append(f"{name}w{k} AS (SELECT t, i, h, count(*) OVER (PARTITION BY t) AS n, coalesce(string_agg(h, '') OVER (PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS x, coalesce(string_agg(h, '') OVER (PARTITION BY t, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS y FROM {name}{k})")
            out.append(f"{name}{k + 1} AS (SELECT t, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}w{k} GROUP BY 1, 2)")

    tree("s")
    out.append(f"r0 AS (SELECT 0 AS t, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS i, h, t AS source FROM s{levels})")
    tree("r")
    row = "b0"
    for name in "sr":
        for k in range(levels):
            use = f"f{name}{k}"
            base = row if row != "b0" else "(SELECT *, coalesce(other, leaf) AS fold, '' AS proof FROM b0)"
            if name == "s":
                joined = f"{base} f JOIN {name}w{k} w ON w.t IS NOT DISTINCT FROM f.t AND w.i = f.i // {16**k}"
            else:
                joined = f"{base} f JOIN r0 z ON z.source IS NOT DISTINCT FROM f.t JOIN rw{k} w ON w.i = z.i // {16**k}"
            out.append(f"{use} AS (SELECT f.* REPLACE (CASE WHEN w.n = 1 THEN f.fold ELSE sha256(w.x || f.fold || w.y) END AS fold, f.proof || w.x || w.y AS proof) FROM {joined})")
            row = use
    out.append(f"SELECT doc_id, leaf, z.h AS subroot, (SELECT h FROM r{levels}) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT h FROM r{levels}) AS verified FROM {row} f JOIN r0 z ON z.source IS NOT DISTINCT FROM f.t")
    return ",\n".join(out[:-1]) + "\n" + out[-1]


OP13_SQL = _oracle()
