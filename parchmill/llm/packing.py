"""Best-fit packing of token sequences.

Best-fit decreasing looks at nothing but lengths, and pieces of one length are interchangeable. So the packing is
planned over the histogram of lengths (one row a length, never more than the capacity) by best-fit decreasing with
a segment tree over remaining capacities, a whole run of equal pieces at a time; then every piece finds its place
from its rank among the pieces of its length, in parallel.

Defined results: null texts are empty and give the end mark alone; documents longer than the capacity are cut, the
first piece taking the remainder; repeated rows are packed as often as they stand; an empty table gives no rows.
Extra columns of the input are dropped by `token_pieces`, kept by `pack`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.session import read_table, settled, tokenizer_path

CAPACITY = 1024
END_ID = 2
#: Pieces of one length are ranked in groups of at most this many.
RANK_GROUP = 50_000


class Openings:
    """Segment tree over remaining capacities 0..capacity; a leaf holds the open sequences with that much room as
    ranges (first, count). `tightest` finds the least room of at least a length that is not empty."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.any = np.zeros(2 * self.size, dtype=bool)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        k = room + self.size
        self.any[k] = bool(self.ranges[room])
        while k > 1:
            k //= 2
            self.any[k] = self.any[2 * k] or self.any[2 * k + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if count > 0 and room > 0:
            self.ranges[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        out = self.ranges[room].pop()
        if not self.ranges[room]:
            self._mark(room)
        return out

    def tightest(self, length: int) -> int | None:
        k = length + self.size
        if self.any[k]:
            return length
        while k > 1:
            if k % 2 == 0 and self.any[k + 1]:
                k += 1
                break
            k //= 2
        else:
            return None
        while k < self.size:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        return k - self.size


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram. Steps (length, first rank, first sequence, pieces a sequence, offset):
    the pieces of that length from that rank on fill sequences from that one on, so many to each, starting at that
    offset; a step lasts to the next one of its length. And the number of sequences.

    In a sequence whose room is the tightest, equal pieces follow one another as long as they fit, for the room
    that is left is tighter still. A length takes whole ranges but for two cuts, so steps depend on the number of
    lengths and not on the number of pieces."""
    steps, made, open_ = [], 0, Openings(capacity)
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left > 0:
            room = open_.tightest(length)
            if room is None:
                room, first, have = capacity, made, -(-left // (capacity // length))
                made += have
            else:
                first, have = open_.take(room)
            each = room // length
            full = min(have, left // each)
            steps.append((length, rank, first, each, capacity - room))
            open_.put(room - each * length, first, full)
            rank, left, rest = rank + full * each, left - full * each, have - full
            if rest and left:  # fewer than `each` remain
                open_.put(room - left * length, first + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            open_.put(room, first + full, rest)
    return steps, made


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset (which replace columns of these names). Lengths lie in 1..capacity; null or other
    lengths are an error. The rows are settled first, each with a number of its own, so that repeated rows are told apart
    and a length's ranks come from groups of bounded size, whatever the columns hold."""
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    number = F.monotonically_increasing_id().alias("number")
    rows = settled(pieces.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(f"`{length}`").cast("long").alias("length"), number), "pieces")
    sizes = rows.groupBy("length").count().collect()  # at most `capacity` rows
    if any(r["length"] is None or not 1 <= r["length"] <= capacity for r in sizes):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    steps, made = plan({r["length"]: r["count"] for r in sizes if r["length"] < capacity}, capacity)
    steps.sort()
    kinds = np.array([s[0] for s in steps], dtype=np.int64)
    starts, firsts, eachs, offsets = (np.array([s[k] for s in steps], dtype=np.int64) for k in (1, 2, 3, 4))
    order = kinds << 45 | starts

    grouped = rows.withColumn("group", F.expr(f"number div {RANK_GROUP}"))
    counts = grouped.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = counts.select("length", "group", (F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "group").orderBy("number")) - 1
    ranked = grouped.withColumn("inside", inside).join(before, ["length", "group"]).select("row", "length", (F.col("inside") + F.col("before")).alias("rank"))
    schema = T.StructType([ranked.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
            whole = size == capacity
            seq, off = made + rank, np.zeros(len(size), dtype=np.int64)
            if len(order) and not whole.all():
                k = np.maximum(np.searchsorted(order, size << 45 | rank, side="right") - 1, 0)
                n = rank - starts[k]
                seq = np.where(whole, seq, firsts[k] + n // eachs[k])
                off = np.where(whole, 0, offsets[k] + n % eachs[k] * size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seq), pa.array(off)], names=["row", "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in own], "sequence_id", "offset")


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (packed as little-endian unsigned 32-bit integers) of each document's
    ids and the end mark, cut at `capacity`; the first piece is the shorter one."""
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = fast_encoder(path), np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                part = whole.slice(k, 256)
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    first = (n - 1) % capacity + 1
                    cuts = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = ids[4 * a : 4 * b]
                        out.append((doc, piece, a, b - a, zlib.crc32(own), own))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


_encoders: dict[str, object] = {}


def fast_encoder(path: str):
    """text -> packed ids, equal to the tokenizers library's on the same file. The compiled merger of tiktoken does
    the work where the file is a byte-level vocabulary whose ids follow its merges (as the public ones do); what its
    regular expressions give up on (runs of hundreds of thousands of blanks), the codec of `bpe` encodes."""
    if path not in _encoders:
        import tiktoken

        from parchmill.llm.bpe import codec

        c = codec(path)
        ranks = {b: k for k, b in enumerate(c.bytes_of) if b and k not in c.special.values()}
        own = tiktoken.Encoding("own", pat_str=TIKTOKEN_PATTERN, mergeable_ranks=ranks, special_tokens=c.special)
        specials = [*c.special]

        def encode(text: str) -> bytes:
            try:
                if any(s in text for s in specials):
                    return np.array(own.encode(text, allowed_special="all"), dtype="<u4").tobytes()
                return own.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:
                return c.encode(text)

        _encoders[path] = encode
    return _encoders[path]


#: Fixed value: the published pre-tokenisation pattern, as compiled merger's regular expressions write it.
TIKTOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: token_pieces, then pack."""
    pieces = token_pieces(docs, capacity, path)
    return pack(pieces if keep_ids else pieces.drop("ids"), "length", capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
