"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Native: DataFrame functions only. A first scan takes the length of every normal form (each run of blanks is one space) and
a hash of its first PREFIX characters; it writes two numbers a row. Lengths that only one row has are done. Among the rows
of shared lengths, pairs of length and beginning that only one row has are done too. A second scan computes the SHA-256 of
the whole normal form for the rows that are left, and those are grouped by it. No text is ever shuffled to find groups.

What is left after a step is handed to the next scan as a table of TABLE_BITS bits (16 MB at every size, broadcast): a row whose
key hits a set bit by chance is hashed in vain, which costs time and changes nothing, for the full hash decides. Counts and
least ids are aggregated before the shuffle, and a group with at least one row in HOT_SHARE is joined by a broadcast of at
most HOT_SHARE rows, so a hot group never meets in one task.

Defined results: a null text is an empty one, and empty texts are equal; of equal texts the row with the least id stays, rows
without an id come last, and of repeated rows of the least id exactly one stays; keep_id is null if no row of the group has an
id; an empty table gives an empty result; other columns, whatever their names, are ignored, or passed through by `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.session import discard, read_table, settled

PREFIX = 256
TABLE_BITS = 1 << 27
HOT_SHARE = 1000


def normal_form(text: Column) -> Column:
    """The text with each run of blanks as one space; empty for null."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(TABLE_BITS))


def _bits(keys: DataFrame) -> DataFrame:
    """Column `slot` of the keys as a table of bits: at most TABLE_BITS / 32768 rows of 4 KB."""
    return keys.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))


def _marked(rows: DataFrame, bits: DataFrame, name: str) -> DataFrame:
    """rows (with a column `slot`) and whether their bit is set."""
    at = F.expr("bitmap_bit_position(slot)")
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("bucket", F.bitmap_bucket_number("slot")).join(F.broadcast(bits), "bucket", "left").withColumn(name, hit).drop("bucket", "bits", "slot")


def repeated_beginnings(docs: DataFrame, text: str = "text") -> DataFrame:
    """The bits of those (length, hash of the beginning) that at least two rows share; lengths first."""
    form = normal_form(F.col(f"`{text}`"))
    sketches = settled(docs.select(F.length(form).alias("length"), F.xxhash64(F.substring(form, 1, PREFIX)).alias("head")), "sketches")
    shared = _bits(sketches.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select(_slot(F.col("length")).alias("slot")))
    left = _marked(sketches.withColumn("slot", _slot(F.col("length"))), shared, "shared").where("shared")
    heads = left.groupBy("length", "head").agg(F.count("*").alias("n")).where("n > 1")
    out = settled(_bits(heads.select(_slot(F.col("length"), F.col("head")).alias("slot"))), "beginnings")
    discard(sketches)
    return out


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for every row of docs: doc_id, keep_id, group_size, kept, digest (null where an earlier step told the text apart
    from all others), and the columns `carry`, which may look at all columns of docs."""
    carry = carry or {}
    bits = repeated_beginnings(docs, text)
    form = normal_form(F.col(f"`{text}`"))
    carried = F.struct(*[c.alias(n) for n, c in carry.items()]) if carry else F.lit(None).cast("int")
    forms = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), form.alias("form"), carried.alias("carried"))
    keyed = forms.withColumn("slot", _slot(F.length("form"), F.xxhash64(F.substring("form", 1, PREFIX))))
    hashed = _marked(keyed, bits, "left").withColumn("digest", F.when(F.col("left"), F.sha2("form", 256))).drop("form", "left")
    rows = settled(hashed.withColumn("number", F.monotonically_increasing_id()), "digests")
    discard(bits)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")
    groups = settled(rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")), "groups")
    hot = F.col("n") >= max(2, -(-rows.count() // HOT_SHARE))
    known = groups.select("digest", "n", "first")
    several = rows.where("digest is not null").join(F.broadcast(known.where(hot)), "digest", "left")
    cold = several.where("n is null").drop("n", "first").join(known.where(~hot), "digest")
    out = [F.col("doc_id"), "first.doc_id as keep_id", "n as group_size", "number = first.number as kept", "digest", "carried"]
    out = [c if isinstance(c, Column) else F.expr(c) for c in out]
    alone = rows.where("digest is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "carried")
    joined = alone.unionByName(several.where("n is not null").select(*out)).unionByName(cold.select(*out))
    return joined.select("doc_id", "keep_id", "group_size", "kept", "digest", *[F.col(f"carried.`{n}`").alias(n) for n in carry])


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return copies(docs, doc_id, text, {"row": whole}).where("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = copies(docs, carry={"text_sha256": F.sha2(normal_form(F.col("text")), 256)})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""
