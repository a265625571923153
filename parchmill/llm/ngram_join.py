"""Near-duplicate documents by an exact Jaccard join on word shingles.

Tokens (shingles) are ordered rare ones first, and by hash within a class. A pair at or above the threshold misses few
tokens of either side, so both must share something among the first tokens of each: rare tokens are indexed alone, all
others in combinations of two from one class, and the prefix is extended until, whatever tokens a partner misses, a
whole signature is left: the sum over classes of max(0, tokens - k + 1) must exceed the number that may be missing.
Rare are those tokens of the lowest hashes that fewer than RARE documents hold; only these hashes are counted, for
prefixes reach no further. The links are exact whatever tokens count as rare, as long as all documents agree.

Equal sets are one class from the start. Every document first meets the leader that it shares most signatures with, then
small buckets (all those of single tokens) compare what is still in different components. Members of large buckets are
joined by their differences from the bucket's leader (see `differences`), so that neither a group of near copies nor one of
texts that are alike but below the threshold turns into all its pairs. A pair is dropped when its prefixes have too little in
common for the threshold; verification compares whole shingle sets.

Defined results: null texts and texts without words have no shingles and link with nothing; rows without an id link
with nothing and have no component; repeated rows are copies; ties go to the least id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import differences
from parchmill.llm.shingles import overlap, shingle_set
from parchmill.operators.graph import connected_components
from parchmill.session import discard, read_table, settled

#: Tokens in at least this many documents are not rare.
RARE = 16
#: Bits of the table of common tokens that every task gets (16 MB); a token whose bit another one sets counts as common.
TABLE_BITS = 27
#: The lowest hashes, as a multiple of the share of tokens that a partner may miss.
COUNTED = 2.5
#: Shingles counted together before they are shuffled.
COUNT_AT_ONCE = 1_000_000
#: Tokens of a document for each class of common tokens, about.
TOKENS_PER_CLASS = 32
#: Members of a bucket that are compared with each other outright; at least RARE - 1, for buckets of a single token.
SMALL_BUCKET = 24
#: Tokens of sets that a verifying task keeps at hand.
TOKENS_HELD = 2_000_000
#: Ids that may be broadcast, eight bytes each.
BROADCAST_IDS = 1 << 20


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))


def counted_below(percent: int) -> np.uint64:
    """The hash below which tokens are counted."""
    return np.uint64(min(1.0, COUNTED * (100 - percent) / 100) * (2**64 - 1025))


def common_tokens(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    """A table of TABLE_BITS bits, packed: set where a counted token is held by RARE documents or more, so that a token whose bit
    is not set has fewer; the driver gets the table's filled pieces only."""
    limit, width = counted_below(percent), 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int64))], names=["token", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                own = shingle_set(text, size)
                held.append(own[: np.searchsorted(own, limit)])
                n += len(held[-1])
                if n >= COUNT_AT_ONCE:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE)
    found = counts.select(F.expr(f"token & {(1 << TABLE_BITS) - 1}").alias("place"))
    pieces = found.groupBy((F.col("place") / width).cast("int").alias("piece")).agg(F.collect_set(F.expr(f"cast(place % {width} as int)")).alias("bits"))  # at most `width` bits each

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                flags = np.zeros(width, dtype=bool)
                flags[b.column(1)[k].values.to_numpy()] = True
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["piece", "packed"])

    table = np.zeros((1 << TABLE_BITS) // 8, dtype=np.uint8)
    packed = settled(pieces.mapInArrow(pack, "piece int, packed binary"), "common")
    for r in packed.toLocalIterator():  # at most the table
        table[r["piece"] * width // 8 :][: width // 8] = np.frombuffer(bytes(r["packed"]), dtype=np.uint8)
    discard(packed)
    return table


def is_rare(tokens: np.ndarray, table: np.ndarray, limit: np.uint64) -> np.ndarray:
    place = tokens & np.uint64((1 << TABLE_BITS) - 1)
    bit = table[place >> np.uint64(3)] >> (7 - (place & np.uint64(7))).astype(np.uint8) & 1
    return (tokens < limit) & (bit == 0)


def signatures(tokens: np.ndarray, rare: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The signatures of a sorted token set, of which `rare` marks some: rare tokens as they are but for a last bit of 0, pairs
    of others as mixed hashes with a last bit of 1. And how many single tokens there are."""
    n = len(tokens)
    missing = n - -(-percent * n // 100)
    single = tokens[rare][: missing + 1]
    out = [single & ~np.uint64(1)]
    need = missing + 1 - len(single)
    if need > 0:
        often = tokens[~rare]
        width = math.log(100 / percent * 1.001)
        band = int(math.log(n) / width)
        for b in (band, band - 1):  # as the smaller and as the larger of a pair
            classes = max(1, int(math.exp(b * width) / TOKENS_PER_CLASS))
            kind = (often >> np.uint64(17)) % np.uint64(classes)
            _, first = np.unique(kind, return_index=True)
            adds = np.ones(len(often), dtype=np.int64)
            adds[first] = 0
            reached = np.searchsorted(np.cumsum(adds), need)
            own, kind = often[: reached + 1], kind[: reached + 1]
            order = np.argsort(kind, kind="stable")
            own, kind = own[order], kind[order]
            for gap in range(1, int(np.bincount(kind.astype(np.int64)).max(initial=1))):
                same = kind[gap:] == kind[:-gap]
                a, c = own[:-gap][same], own[gap:][same]
                out.append((a * np.uint64(0x9E3779B97F4A7C15)) ^ (c * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(b & 0xFFFF)) | np.uint64(1))
    return np.unique(np.concatenate(out)), len(single)


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens, by their low bits, in a power of two of bits that grows with the set. Bits in which two sketches
    differ are tokens in which the sets differ; a longer sketch folds to a shorter one by halves."""
    bits = max(64, 1 << (2 * len(tokens)).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The least number of tokens in which the sets of two sketches differ."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.unpackbits(x ^ y).sum())


def _signed(docs: DataFrame, table: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc, n, p, digest, sketch, sigs) of every row; p: its single tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # TABLE_BITS bits
    limit = counted_below(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                n, digest, p, bits, sigs = [], [], [], [], []
                for text in b.column(1).to_pylist():
                    tokens = shingle_set(text, size)
                    n.append(len(tokens))
                    digest.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                    own, single = signatures(tokens, is_rare(tokens, common, limit), percent) if len(tokens) else (tokens, 0)
                    sigs.append(own.view(np.int64))
                    p.append(single)
                    bits.append(sketch(tokens))
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sigs]))).astype(np.int32)
                flat = np.concatenate(sigs) if sigs else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(p, pa.int64()), pa.array(digest, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc", "n", "p", "digest", "sketch", "sigs"])

    return docs.mapInArrow(sign, "doc long, n long, p long, digest binary, sketch binary, sigs array<long>")


def _alike(percent: int) -> str:
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"


def _promising(percent: int) -> str:
    """SQL for whether sizes n_a, n_b and `common`, the single tokens that two prefixes of p_a and p_b share, allow the
    threshold. What two sets share lies in both prefixes or behind the one that ends first, so the overlap is at most
    `common` plus the longer rest."""
    return f"{_alike(percent)} and common >= cast(ceil({percent} * (n_a + n_b) / {100 + percent}) as bigint) - greatest(n_a - p_a, n_b - p_b)"


def _with_texts(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, ta, tb) of pairs (a, b), and two settled tables to discard later. Other texts are not moved where the ids are few
    enough to broadcast; then a pair's texts meet by two joins."""
    ids = settled(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = settled(rows.join(F.broadcast(ids) if few else ids, "doc").dropDuplicates(["doc"]), "texts")
    left = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return both, ids, texts


def _linked(pairs: DataFrame, own: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets reach the threshold. Sketches that differ in more bits than linked sets in
    tokens turn most of the others away. Only the texts of the rest are fetched, without moving other texts where the
    pairs' ids are few enough to broadcast; then a pair's texts meet by two joins. Rows come sorted by b, whose set is
    kept from one row to the next."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            most = n + 2 * (-percent * n // (100 + percent))  # of tokens in one set alone
            apart = [differing(x, y) for x, y in zip(b.column("s_a").to_pylist(), b.column("s_b").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(np.array(apart, dtype=np.int64) <= most))

    held = own.select("doc", "n", "sketch").dropDuplicates(["doc"])
    side = lambda k: held.select(F.col("doc").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}"))
    wanted = pairs
    pairs = settled(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(near, "a long, b long"), "near")
    both, *used = _with_texts(pairs, rows)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        known: dict[int, np.ndarray] = {}
        room = TOKENS_HELD
        for batch in batches:
            src, dst = [], []
            for a, b, ta, tb in zip(*(batch.column(k) for k in range(4)), strict=True):
                b = b.as_py()
                if b != last:
                    last, held = b, shingle_set(tb.as_py(), size)
                own = known.get(a.as_py())
                if own is None:
                    own = shingle_set(ta.as_py(), size)
                    room -= len(own)
                    if room < 0:
                        known, room = {}, TOKENS_HELD - len(own)
                    known[a.as_py()] = own
                common = overlap(own, held)
                if 100 * common >= percent * (len(own) + len(held) - common):
                    src.append(a.as_py())
                    dst.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["a", "b"])

    links = settled(both.mapInArrow(verify, "a long, b long"), "links")
    discard(wanted, pairs, *used)
    return links


def _named(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the label of their component."""
    labels = connected_components(links, "a", "b").withColumnRenamed("node", "doc")
    return members.join(labels, "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")


def _single() -> Column:
    return F.sum((F.col("sig") % 2 == 0).cast("long")).alias("common")


def _leaders(shared: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """(a, b): every document with the leader that it shares most signatures with, if that is enough already."""
    met = shared.where("doc <> lead").groupBy(F.col("doc").alias("a"), "lead", F.col("n").alias("n_a"), F.col("p").alias("p_a")).agg(F.count("*").alias("all"), _single())
    most = met.groupBy("a").agg(F.max(F.struct("all", (-F.col("lead")).alias("lead"), "n_a", "p_a", "common")).alias("top")).select("a", (-F.col("top.lead")).alias("b"), "top.n_a", "top.p_a", "top.common")
    sizes = own.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("p").alias("p_b")).dropDuplicates(["b"])
    return most.join(sizes, "b").where(_promising(percent)).select("a", "b")


def _in_small_buckets(named: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of different components that share a small bucket, of which no more than SMALL_BUCKET are in one."""
    little = named.where(F.col("c") <= SMALL_BUCKET)
    one = lambda k: little.select("sig", *[F.col(c).alias(f"{c}_{k}" if c != "doc" else k) for c in ("doc", "n", "p", "label")])
    met = one("a").join(one("b"), "sig").where(f"a < b and label_a <> label_b and {_alike(percent)}")
    return met.groupBy("a", "b", "n_a", "p_a", "n_b", "p_b").agg(_single()).where(_promising(percent)).select("a", "b")


def _with_leaders(named: DataFrame) -> DataFrame:
    """(a, b): the members of large buckets of more than one component, each with the leaders of its buckets. A bucket's leader is
    the member that has most company in large buckets, so that the buckets of one group agree on few leaders."""
    large = named.where(F.col("c") > SMALL_BUCKET)
    mixed = large.groupBy("sig").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("sig")
    members = settled(large.join(mixed, "sig").select("sig", "doc", "c"), "mixed")
    company = members.groupBy("doc").agg(F.sum("c").alias("company"))
    heads = members.join(company, "doc").groupBy("sig").agg(F.max(F.struct("company", (-F.col("doc")).alias("lead"))).alias("top")).select("sig", (-F.col("top.lead")).alias("b"))
    pairs = settled(members.join(heads, "sig").select(F.col("doc").alias("a"), "b").where("a <> b").distinct(), "led")
    discard(members)
    return pairs


def _in_large_buckets(named: DataFrame, links: DataFrame, own: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The links (a, b) that members of large buckets add to those there are."""
    pairs = _with_leaders(named)
    both, *used = _with_texts(pairs, rows)
    apart = settled(differences.from_leaders(both, size, percent), "differences")
    discard(pairs, *used)
    near = apart.where("near").select(F.col("doc").alias("a"), F.col("lead").alias("b"))
    labels = connected_components(links.select("a", "b").union(near), "a", "b")
    prefixed = settled(differences.prefixes(apart), "prefixes")
    met = settled(differences.candidates(differences.buckets(prefixed, apart, labels), percent), "met")
    sure, open_ = met.where("sure").select("a", "b"), met.where("not sure").select("a", "b")
    found = settled(near.union(sure).union(_linked(open_, own, rows, size, percent)), "links")
    discard(apart, prefixed, met)
    return found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when 100 * intersection >= percent * union of their
    sets of `size`-word shingles, and a component is named by its least id."""
    rows = _texts(docs, key, text)
    signed = settled(_signed(rows, common_tokens(rows, size, percent), size, percent), "signed")
    named = settled(signed.select("doc", "n", "digest"), "named")
    copies = settled(named.where("digest is not null and doc is not null").groupBy("digest").agg(F.min("doc").alias("rep")), "copies")
    own = settled(signed.join(copies, "digest").where("doc = rep").select("doc", "n", "p", "sketch", "sigs"), "own")
    discard(signed)
    index = own.select(F.explode("sigs").alias("sig"), "doc", "n", "p")
    buckets = settled(index.groupBy("sig").agg(F.min("doc").alias("lead"), F.max("doc").alias("_last"), F.count("*").alias("c")).where("lead < _last").drop("_last"), "buckets")
    shared = settled(index.join(buckets, "sig"), "shared")
    discard(buckets)
    links = _linked(settled(_leaders(shared, own, percent), "pairs"), own, rows, size, percent)
    members = shared.select("sig", "doc", "n", "p", "c")
    links = links.union(_linked(settled(_in_small_buckets(_named(members, links), percent), "pairs"), own, rows, size, percent))
    links = links.union(_in_large_buckets(_named(members.where(F.col("c") > SMALL_BUCKET), links), links, own, rows, size, percent))
    labels = connected_components(links, "a", "b").withColumnRenamed("node", "rep")
    components = settled(copies.join(labels, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "components")
    discard(shared, own, copies)
    out = named.join(components, "digest", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.expr("if(doc is null, null, coalesce(component_id, doc))").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id names their component, one row for each: one document of each group stays. Rows without
    an id stay too."""
    first = near_duplicates(docs, size, percent, key, text).where("doc_id = component_id").select(F.col("doc_id").cast(docs.schema[key].dataType).alias(key)).distinct()
    named = docs.where(F.col(key).isNotNull()).join(first, key, "left_semi").dropDuplicates([key])
    return named.unionByName(docs.where(F.col(key).isNull()))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=3, percent=90)
