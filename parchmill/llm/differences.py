"""Members of large buckets, told apart by their differences from a leader.

Texts that are much alike share nearly all of their tokens, so no combination of tokens that they hold tells them apart.
What tells them apart is how they differ from one text of the group, the leader: in (set xor leader) the tokens that all
share are gone, and the tokens in which two sets differ stay the same, for (x xor l) xor (y xor l) = x xor y. So the
members of a large bucket are joined once more, on these differences. One is far from the leader if it is not linked with
it; two near ones are in one component already. For a pair (x, y) with at least one far, the differences share a token,
and x lacks at most `reach` - 1 of its own in y: the rarest `reach` tokens of each, in the group's order of frequency, hold
one that both have. That is the prefix filter again, with the group's own rare tokens.

What shares such a token meets in numpy, in blocks of at most BLOCK members. Parity sketches turn most pairs away; the others are
verified where they met, for the differences say how many tokens two sets do not share. What leaves a block are the stars
of the components that its links join, fewer rows than it has members, and never its pairs. Only members with more than
HELD common tokens of difference are left to be verified on whole sets. A token that more than BLOCK members of one group keep
in their prefix is cut into pairs of blocks: exact, of bounded memory, but the work there grows with the square of that
token's members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.shingles import shingle_set
from parchmill.operators.graph import stars

#: Members of one bucket that meet in one task.
BLOCK = 1024
#: Words of sketches that are compared at once.
WORDS_AT_ONCE = 1 << 20
#: Tokens of a difference that a member brings to a block (8 kB); and tokens whose holders are counted at once.
HELD, COLUMNS = 1024, 4096


def reach(n: int, n_lead: int, differing: int, percent: int) -> tuple[bool, int]:
    """Whether a set of n tokens that differs from its leader's in so many tokens is linked with it; and how many of these, the
    rarest, must be indexed. With c = (100 - percent) / (100 + percent), sets x, y are linked if |x xor y| <= c (|x| + |y|).
    If y is far, x lacks (d_x - d_y + |x xor y|) / 2 < (d_x + c (|x| - |lead|)) / 2; else at most |x xor y| and d_x - 1."""
    less, more = 100 - percent, 100 + percent
    near = more * differing <= less * (n + n_lead)
    if near:
        return True, max(0, (more * differing + less * (n - n_lead)) // (2 * more) + 1)
    most = less * (n + 100 * n // percent) // more
    return False, min(differing, most + 1, (differing + most) // 2 + 1)


def small_sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in one or two bits a token, whole 64-bit words; longer ones fold to shorter ones by halves."""
    bits = max(64, 1 << len(tokens).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def from_leaders(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of (a, b, ta, tb), a member and its leader with their texts: (doc, lead, n, near, reach, sketch, tokens)."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, dtype=np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, close, most, bits, apart = [], [], [], [], []
                for lead, ta, tb in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                    if lead.as_py() != last:
                        last, held = lead.as_py(), shingle_set(tb.as_py(), size)
                    own = shingle_set(ta.as_py(), size)
                    d = np.setxor1d(own, held, assume_unique=True)
                    near, k = reach(len(own), len(held), len(d), percent)
                    n.append(len(own))
                    close.append(near)
                    most.append(k)
                    bits.append(small_sketch(own))
                    apart.append(d.view(np.int64) if k else d[:0].view(np.int64))
                ends = np.concatenate(([0], np.cumsum([len(d) for d in apart]))).astype(np.int32)
                flat = np.concatenate(apart)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(close, pa.bool_()), pa.array(most, pa.int32()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc", "lead", "n", "near", "reach", "sketch", "tokens"])

    return texts.mapInArrow(differ, "doc long, lead long, n long, near boolean, reach int, sketch binary, tokens array<long>")


def prefixes(differences: DataFrame) -> DataFrame:
    """(doc, lead, first, apart, tokens) of members with something to index: the rarest tokens of each difference that another
    member has too, how many tokens it has, and all of them that another member has too, null if they are more than HELD."""
    each = differences.where("reach > 0").select("doc", "lead", "reach", F.explode("tokens").alias("token"))
    counts = each.groupBy("lead", "token").agg(F.count("*").alias("c"))
    ordered = each.join(counts, ["lead", "token"]).groupBy("doc", "lead").agg(F.min("reach").alias("reach"), F.sort_array(F.collect_list(F.struct("c", "token"))).alias("all"))
    held = lambda x: f"transform(filter({x}, x -> x.c > 1), x -> x.token)"
    sets = ordered.select("doc", "lead", F.expr(held("slice(`all`, 1, reach)")).alias("first"), F.size("all").cast("long").alias("apart"), F.expr(held("`all`")).alias("tokens"))
    return sets.withColumn("tokens", F.when(F.size("tokens") <= HELD, F.col("tokens")))


def buckets(prefixed: DataFrame, differences: DataFrame, labels: DataFrame) -> DataFrame:
    """(lead, token, i, j, block, doc, n, label, sketch, apart, tokens): who meets whom. The rarest tokens of each difference, where
    they are shared by members of more than one component; block i of a bucket meets block j."""
    first = prefixed.select("doc", "lead", F.explode("first").alias("token"))
    named = first.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")
    mixed = named.groupBy("lead", "token").agg(F.count("*").alias("c"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("lead", "token", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    placed = named.join(mixed, ["lead", "token"]).withColumn("block", F.expr("cast(pmod(xxhash64(doc), blocks) as int)"))
    met = placed.select("lead", "token", "block", "doc", "label", F.explode(F.expr("transform(sequence(0L, blocks - 1), k -> struct(cast(least(k, block) as int) as i, cast(greatest(k, block) as int) as j))")).alias("x"))
    sets = differences.select("doc", "lead", "n", "sketch").join(prefixed.select("doc", "lead", "apart", "tokens"), ["doc", "lead"])
    return met.select("lead", "token", "x.i", "x.j", "block", "doc", "label").join(sets, ["doc", "lead"])


def _words(sketches: list[bytes], length: int) -> np.ndarray:
    x = np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(sketches), -1)
    while x.shape[1] > length:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def alike(left: np.ndarray, right: np.ndarray, doc: np.ndarray, n: np.ndarray, label: np.ndarray, sketches: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a row in left and a row in right of different components whose sizes and sketches allow a link."""
    lengths = np.array([len(s) // 8 for s in sketches])
    src, dst = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for la in np.unique(lengths[left]):
        for lb in np.unique(lengths[right]):
            x, y = left[lengths[left] == la], right[lengths[right] == lb]
            width = min(la, lb)
            a, b = _words([sketches[k] for k in x], width), _words([sketches[k] for k in y], width)
            step = max(1, WORDS_AT_ONCE // (len(y) * width))
            for at in range(0, len(x), step):
                own = x[at : at + step]
                apart = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
                n_a, n_b = n[own][:, None], n[y][None, :]
                good = ((100 + percent) * apart <= (100 - percent) * (n_a + n_b)) & (label[own][:, None] != label[y][None, :]) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
                p, q = np.nonzero(good)
                src.append(np.minimum(doc[own[p]], doc[y[q]]))
                dst.append(np.maximum(doc[own[p]], doc[y[q]]))
    return np.concatenate(src), np.concatenate(dst)


def linked(a: np.ndarray, b: np.ndarray, n: np.ndarray, apart: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of rows a and b are linked. Rows are sets of n tokens that differ from one leader's in `apart`; `tokens` holds,
    row after row, `sizes` of these tokens, among them all that two rows have in common. Their differences from each other are
    counted for all rows at once, COLUMNS tokens at a time."""
    used, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    place = np.full(len(n), -1)
    place[used] = np.arange(len(used))
    row = np.repeat(place, sizes)
    tokens, row = tokens[row >= 0], row[row >= 0]
    _, token, holders = np.unique(tokens, return_inverse=True, return_counts=True)
    row, token = row[holders[token] > 1], token[holders[token] > 1]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    common = np.zeros((len(used), len(used)), dtype=np.float32)  # whole numbers far below 2**24
    for at in range(0, int(token.max(initial=-1)) + 1, COLUMNS):
        x, y = np.searchsorted(token, [at, at + COLUMNS])
        holds = np.zeros((len(used), COLUMNS if y < len(token) else int(token[-1]) - at + 1), dtype=np.float32)
        holds[row[x:y], token[x:y] - at] = 1
        common += holds @ holds.T
    differ = apart[a] + apart[b] - 2 * common[ends[: len(a)], ends[len(a) :]].astype(np.int64)
    return (100 + percent) * differ <= (100 - percent) * (n[a] + n[b])


def candidates(met: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b, sure) that leave the blocks of `buckets`: components that a link joins, and pairs of members with
    too long differences, which may be linked."""
    keys = ["lead", "token", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
            own = rows.column("block").to_numpy()
            doc, n, label = (rows.column(k).to_numpy() for k in ("doc", "n", "label"))
            left, right = (np.flatnonzero(own == k) for k in (i, j))
            a, b = alike(left, right, np.arange(len(doc)), n, label, rows.column("sketch").to_pylist(), percent)
            brought = rows.column("tokens").combine_chunks()
            sure = brought.is_valid().to_numpy(zero_copy_only=False)
            sure = sure[a] & sure[b]
            sizes = pc.fill_null(pc.list_value_length(brought), 0).to_numpy()
            near = linked(a[sure], b[sure], n, rows.column("apart").to_numpy(), sizes, brought.flatten().to_numpy(), percent)
            node, root = stars(label[a[sure][near]], label[b[sure][near]])
            joined = node != root
            src, dst = np.concatenate([root[joined], doc[a[~sure]]]), np.concatenate([node[joined], doc[b[~sure]]])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst)), pa.array(np.arange(len(src)) < joined.sum())], names=["a", "b", "sure"])

        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            new = np.ones(t.num_rows, dtype=bool)
            for at, k in enumerate(keys):
                v = t.column(k).to_numpy()
                same = v[1:] == v[:-1]
                new[1:] = same if at == 0 else new[1:] & same
            starts = [0, *(np.flatnonzero(~new[1:]) + 1).tolist(), t.num_rows] if t.num_rows else [0]
            for x, y in zip(starts, starts[1:], strict=False):
                run = t.slice(x, y - x)
                if held and any(held[0].column(k)[0] != run.column(k)[0] for k in keys):
                    yield block(pa.concat_tables(held))
                    held = []
                held.append(run)
        if held:
            yield block(pa.concat_tables(held))

    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long, sure boolean").distinct()
