"""Content fingerprints and duplicate documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.functions.text import hash_form
from parchmill.session import settled

SHINGLE = 3
NEAR_BITS = 4
#: 64 bits cut into five bands, low bits first: at most four differing bits leave one band equal.
BANDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: For pairs: 64 bits cut into parts, and every choice of as many of them as two near hashes must have in common.
PARTS, PART_BITS = 8, 8
CHOICES = list(combinations(range(PARTS), PARTS - NEAR_BITS))
#: All with all: so many blocks at least (if each has SMALL_BLOCK rows), and matrices that a core's cache holds.
LEAST_BLOCKS, SMALL_BLOCK = 24, 2048
TILE_ROWS, TILE_COLUMNS = 16, 8192


@F.pandas_udf(T.LongType())
def simhash(forms: pd.Series) -> pd.Series:
    """64 votes over word 3-shingles (the first eight bytes of SHA-1, big-endian; a bit needs more ones than zeros); null
    under three words. Signed, as Spark has no unsigned long."""
    import re

    word = re.compile(r"\w+")
    out = []
    for form in forms:
        ws = word.findall(form) if form is not None else []
        if len(ws) < SHINGLE:
            out.append(None)
            continue
        heads = b"".join(hashlib.sha1(" ".join(ws[k : k + SHINGLE]).encode()).digest()[:8] for k in range(len(ws) - SHINGLE + 1))
        bits = np.unpackbits(np.frombuffer(heads, dtype=np.uint8).reshape(-1, 8), axis=1)
        votes = 2 * bits.sum(0, dtype=np.int64) > len(bits)
        out.append(int.from_bytes(np.packbits(votes).tobytes(), "big", signed=True))
    return pd.Series(out, dtype="Int64")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with exact (SHA-256 of the hash form), simhash and word_count; exact is null for texts without words. Rows are
    spread before the Python part, as a small file is one partition."""
    form = hash_form(F.col(text))
    return (
        docs.withColumn("_form", form)
        .withColumn("word_count", F.coalesce(F.regexp_count("_form", F.lit(r"(?U)\w+")), F.lit(0)))
        .withColumn("exact", F.when(F.col("word_count") > 0, F.sha2("_form", 256)))
        .withColumn("simhash", simhash("_form"))
        .drop("_form")
    )


def unsigned(c: Column) -> Column:
    """A signed 64-bit value as the decimal text of the unsigned one."""
    return F.when(c < 0, c.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(c.cast("decimal(20,0)")).cast("string")


def similarity(exact_a: Column, exact_b: Column, hash_a: Column, hash_b: Column) -> Column:
    """1 for equal digests, else the share of equal bits, 0 where either lacks a hash."""
    return F.when(exact_a == exact_b, 1.0).otherwise(F.coalesce(1 - F.bit_count(hash_a.bitwiseXOR(hash_b)) / F.lit(64.0), F.lit(0.0)))


def band_keys(h: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << n) - 1)) for low, n in BANDS])


def _equal_parts(x: Column) -> Column:
    """Of the xor of two hashes, which of its PARTS are zero: a bit each, the lowest part first."""
    bits = [F.when(F.shiftrightunsigned(x, PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1)) == 0, 1 << k).otherwise(0) for k in range(PARTS)]
    return reduce(lambda a, b: a + b, bits)


def near_values(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, low, high): the pairs of different hashes of one group with at most NEAR_BITS differing bits, each once. values: (group,
    value), both long and each pair of them once.

    A hash is cut into PARTS parts. Of two hashes that differ in NEAR_BITS bits, at least PARTS - NEAR_BITS parts are equal, so both
    have one of the CHOICES of so many parts in common. Each hash is sent once for each choice, under the 32 bits that it
    chooses: a million hashes of one group share such a key some hundred times in all, where a key of 13 bits is
    shared by hundreds each. Of the choices that two hashes have in common only the first one reports them. The join is told to go
    through plain exchanges, so adaptive execution splits a key that many hashes share: Spark takes the size of the rows for that
    of the hashes before they are sent for each choice, and would broadcast them all through the driver."""
    masks = [(k, sum(((1 << PART_BITS) - 1) << PART_BITS * p for p in parts)) for k, parts in enumerate(CHOICES)]
    signed = [(k, m - (1 << 64) if m >> 63 else m) for k, m in masks]
    rows = values.select(F.col(group).alias("g"), F.col(value).alias("v"))
    keyed = rows.select("g", "v", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for _, m in signed])).alias("choice", "key"))
    other = keyed.select("g", "choice", "key", F.col("v").alias("w"))
    first = F.array(*[F.lit(_first_choice(e)) for e in range(1 << PARTS)])  # 256 numbers, by rule
    x = F.col("v").bitwiseXOR(F.col("w"))
    near = keyed.join(other.hint("merge"), ["g", "choice", "key"]).where(F.col("v") < F.col("w")).where((F.bit_count(x) <= NEAR_BITS) & (F.get(first, _equal_parts(x)) == F.col("choice")))
    return near.select(F.col("g").alias("group"), F.col("v").alias("low"), F.col("w").alias("high"))


def _first_choice(equal: int) -> int:
    """The choice of the lowest equal parts, -1 if they are too few."""
    parts = tuple(k for k in range(PARTS) if equal >> k & 1)[: PARTS - NEAR_BITS]
    return CHOICES.index(parts) if len(parts) == PARTS - NEAR_BITS else -1


def block_count(rows: int, block: int) -> int:
    """Into how many blocks rows are cut. Each row is sent once a block and once more, so there are few: the number only grows when
    blocks would have more than `block` rows."""
    return max(1, -(-rows // block), min(LEAST_BLOCKS, -(-rows // SMALL_BLOCK)))


def all_pairs(values: DataFrame, ident: str, value: str, most: int = NEAR_BITS, block: int = 65_536) -> DataFrame:
    """(a, b, bits), a < b: every pair of rows with at most `most` differing bits, found by comparing all with all. It is the check
    of `near_values` and for small tables only: its work grows with the square, but not what a task holds. Rows are cut into
    blocks, equal blocks meet once, and a task goes over a pair of blocks in small matrices of differing bits, handing on the pairs of
    each. Two hashes whose numbers of ones are more than `most` apart differ in more bits than that: both blocks are ordered by
    this number, and such stretches are passed over. Null values match nothing."""
    rows = settled(values.where(F.col(value).isNotNull()).select(F.col(ident).alias("a"), F.col(value).alias("v")).withColumn("n", F.monotonically_increasing_id()), "all-pairs")
    n = block_count(rows.count(), block)
    dealt = rows.withColumn("k", F.pmod(F.xxhash64("n"), F.lit(n)).cast("int"))
    # Block k meets the blocks up to itself as the second one, and those from itself on as the first one.
    sides = [dealt.select(F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"), F.col("k").alias("j"), F.lit(1).alias("side"), "a", "v"), dealt.select(F.col("k").alias("i"), F.explode(F.sequence(F.col("k"), F.lit(n - 1))).alias("j"), F.lit(0).alias("side"), "a", "v")]
    kind = dict(rows.dtypes)["a"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        side, ids, v = table.column("side").to_numpy(), table.column("a").to_numpy(), table.column("v").to_numpy().view(np.uint64)
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()  # within a block each pair stands on both sides
        ones = np.bitwise_count(v).astype(np.int64)
        first, second = (at[np.argsort(ones[at], kind="stable")] for at in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)))
        w, known = v[second], ones[second]
        for k in range(0, len(first), TILE_ROWS):
            tile = first[k : k + TILE_ROWS]
            start, end = np.searchsorted(known, ones[tile[0]] - most, "left"), np.searchsorted(known, ones[tile[-1]] + most, "right")
            for m in range(start, end, TILE_COLUMNS):
                bits = np.bitwise_count(v[tile][:, None] ^ w[None, m : min(m + TILE_COLUMNS, end)])
                if bits.min() > most:
                    continue
                r, c = np.nonzero(bits <= most)
                a, b = ids[tile[r]], ids[second[m + c]]
                keep = a < b if within else a != b
                if keep.any():
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "bits": bits[r, c].astype(np.int32)[keep]})

    return sides[0].unionByName(sides[1]).groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}, bits int")


def _own(prints: DataFrame, doc: str, party: str, owner: str | None) -> DataFrame:
    """(doc, o, p, exact, simhash, g) of documents with words; g is a number for (o, p)."""
    whose = F.col(owner) if owner else F.lit("")
    own = prints.where("exact is not null").select(F.col(doc).alias("doc"), whose.alias("o"), F.col(party).alias("p"), "exact", "simhash")
    return settled(own.withColumn("g", F.xxhash64("o", "p")), "prints")


def _near_classes(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, near): the classes (g, o, p, simhash, exact, a) of equal digests of one party with their first document, and
    the pairs (group, low, high) of different hashes near each other."""
    classes = settled(own.where("p <> '' and simhash is not null").groupBy("g", "o", "p", "simhash", "exact").agg(F.min("doc").alias("a")), "classes")
    return classes, settled(near_values(classes.select("g", "simhash").distinct(), "g", "simhash"), "near")


def duplicate_pairs(prints: DataFrame, doc: str, party: str, owner: str | None = None) -> DataFrame:
    """(a, b, similarity), a < b: links from which every duplicate follows. Copies (equal digests under any party) are one row each,
    from the first of them: a group never turns into its pairs. Different digests with at most four differing bits under one
    party are one row a pair of digests, from the first document of each there. The owner, if any, is part of every key.
    The party `""` never matches."""
    own = _own(prints, doc, party, owner)
    first = own.groupBy("o", "exact").agg(F.min("doc").alias("a"))
    same = own.join(first.hint("merge"), ["o", "exact"]).where("a < doc").select("a", F.col("doc").alias("b"), F.lit(1.0).alias("similarity"))
    classes, near = _near_classes(own)
    one, two = (classes.select("g", F.col("o").alias(f"o{k}"), F.col("p").alias(f"p{k}"), F.col("simhash").alias(f"s{k}"), F.col("exact").alias(f"e{k}"), F.col("a").alias(f"a{k}")) for k in (1, 2))
    two = two.hint("merge")
    equal = one.join(two, (one.g == two.g) & (F.col("s1") == F.col("s2"))).where("o1 = o2 and p1 = p2 and a1 < a2 and e1 <> e2")
    apart = near.join(one.hint("merge"), (F.col("group") == one.g) & (F.col("low") == F.col("s1"))).drop("g").join(two, (F.col("group") == two.g) & (F.col("high") == F.col("s2"))).where("o1 = o2 and p1 = p2 and e1 <> e2 and a1 <> a2")
    score = similarity(F.col("e1"), F.col("e2"), F.col("s1"), F.col("s2")).alias("similarity")
    pairs = [x.select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b"), score) for x in (equal, apart)]
    return same.unionByName(pairs[0]).unionByName(pairs[1]).dropDuplicates(["a", "b"])


def exact_classes(prints: DataFrame, doc: str) -> DataFrame:
    """(doc, first, copies): the earliest document of every digest, by a grouping instead of pairs."""
    first = prints.where("exact is not null").groupBy("exact").agg(F.min(doc).alias("first"), F.count("*").alias("copies"))
    return prints.join(first, "exact").select(F.col(doc).alias("doc"), "first", "copies")


def earliest_match(prints: DataFrame, doc: str, party: str, owner: str | None = None) -> DataFrame:
    """(doc, match, similarity): for every document that has duplicates the earliest of them, not itself.

    No group turns into its pairs. Copies are grouped: the first of a digest is the match of the others, the second that of the
    first. Digests with one hash are grouped too: the first of them is the match of the others, and the next one with
    another digest that of the first. What is left are pairs of near hashes, which hand over their first documents."""
    own = _own(prints, doc, party, owner)
    first = own.groupBy("o", "exact").agg(F.min("doc").alias("first"), F.max("doc").alias("_last")).where("first < _last").drop("_last")
    second = own.join(first.hint("merge"), ["o", "exact"]).where("doc > first").groupBy("o", "exact", "first").agg(F.min("doc").alias("second"))
    same = own.join(second.hint("merge"), ["o", "exact"]).select("doc", F.when(F.col("doc") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("b"), F.lit(1.0).alias("similarity"))
    classes, near = _near_classes(own)
    key = ["g", "o", "p", "simhash"]
    heads = settled(classes.groupBy(*key).agg(F.min(F.struct("a", "exact")).alias("h")), "heads")
    nexts = classes.join(heads.hint("merge"), key).where("exact <> h.exact").groupBy(*key).agg(F.min(F.struct("a", "exact")).alias("n"))
    within = classes.join(heads.join(nexts.hint("merge"), key).hint("merge"), key).select("o", "p", "exact", F.when(F.col("exact") == F.col("h.exact"), F.col("n.a")).otherwise(F.col("h.a")).alias("b"), F.lit(1.0).alias("similarity"))
    both = near.unionByName(near.select("group", F.col("high").alias("low"), F.col("low").alias("high")))
    far = heads.select("g", F.col("o").alias("o2"), F.col("p").alias("p2"), F.col("simhash").alias("s2"), F.col("h.a").alias("b"))
    offered = both.join(far.hint("merge"), (F.col("group") == F.col("g")) & (F.col("high") == F.col("s2"))).groupBy("group", "low", "o2", "p2").agg(F.min(F.struct("b", "s2")).alias("m"))
    beyond = classes.join(offered.hint("merge"), (F.col("g") == F.col("group")) & (F.col("simhash") == F.col("low")) & (F.col("o") == F.col("o2")) & (F.col("p") == F.col("p2")))
    beyond = beyond.select("o", "p", "exact", F.col("m.b").alias("b"), (1 - F.bit_count(F.col("simhash").bitwiseXOR(F.col("m.s2"))) / F.lit(64.0)).alias("similarity"))
    best = within.unionByName(beyond).groupBy("o", "p", "exact").agg(F.min(F.struct("b", "similarity")).alias("m"))
    close = own.join(best.hint("merge"), ["o", "p", "exact"]).select("doc", F.col("m.b").alias("b"), F.col("m.similarity").alias("similarity"))
    return same.unionByName(close).groupBy("doc").agg(F.min(F.struct("b", "similarity")).alias("m")).select("doc", F.col("m.b").alias("match"), F.round("m.similarity", 4).alias("similarity"))


def repeat_entities(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """rows with repeat: whether the key names at least two distinct rows. Counted apart and joined back."""
    n = rows.where(F.col(key) != "").groupBy(key).agg(F.countDistinct(ident).alias("_n"))
    return rows.join(n, key, "left").withColumn("repeat", F.coalesce(F.col("_n") >= 2, F.lit(False))).drop("_n")


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order given."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
