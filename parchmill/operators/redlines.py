"""Edits that a review proposes: edits of paragraphs from failed clauses, edits of spans inside a text, and texts with edits applied.

Edits are rows, so is their conflict: two clauses that change one paragraph, or two spans that overlap, cannot both stand. Of
paragraphs the first clause by number has its way; of spans as many as possible stay, which taking the one that ends
first does. Everything here is expressions over one document's edits, a group that the document bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
DELETE, REPLACE, INSERT = "delete_paragraph", "replace_paragraph", "insert_after_paragraph"


def generated(results: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, number, clause, paragraph, action, text, standing): the edits of clause results (doc, clause, order, issue, action,
    wording, matched, anchor). matched: the clause's paragraphs. A wrong clause is deleted whole, or replaced: its first
    paragraph takes the wording and the others go. A missing one is inserted after the anchor, or at the end (-1) without
    one. Replacing and inserting need a wording. number counts the edits of a document. An edit of a paragraph that an
    earlier clause changes does not stand; what is inserted after a paragraph changes none."""
    wording = F.trim(F.coalesce("wording", F.lit("")))
    places = F.array_sort(F.array_distinct(F.filter(F.coalesce("matched", F.array().cast("array<int>")), lambda p: p.isNotNull())))
    wrong = F.coalesce(F.col("issue") == "present_but_wrong", F.lit(False))
    edit = lambda p, action, text: F.struct(p.cast("int").alias("paragraph"), action.alias("action"), text.alias("text"))
    none = F.lit(None).cast("string")
    deleted = F.transform("_p", lambda p: edit(p, F.lit(DELETE), none))
    replaced = F.transform("_p", lambda p, k: F.when(k == 0, edit(p, F.lit(REPLACE), F.col("_w"))).otherwise(edit(p, F.lit(DELETE), none)))
    inserted = F.array(edit(F.coalesce("anchor", F.lit(-1)), F.lit(INSERT), F.col("_w")))
    chosen = F.when(wrong & (F.col("action") == DELETE), deleted).when(wrong & (F.col("action") == REPLACE) & (F.col("_w") != ""), replaced).when((F.col("action") == INSERT) & (F.col("_w") != ""), inserted)
    rows = results.withColumn("_p", places).withColumn("_w", wording).select(F.col(doc).alias("doc"), "clause", "order", F.posexplode(chosen).alias("_k", "_e")).select("doc", "clause", "order", "_k", "_e.*")
    first = F.row_number().over(Window.partitionBy("doc", "paragraph", F.col("action") == INSERT).orderBy("order", "clause", "_k"))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("order", "clause", "_k"))
    return rows.withColumn("standing", (first == 1) | (F.col("action") == INSERT)).withColumn("number", number).select("doc", "number", "clause", "paragraph", "action", "text", "standing")


def redlined(paragraphs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, position, part, text): paragraphs (doc, position, text) after the standing edits. part is 0 for what was there and counts
    what is inserted after it; insertions at the end stand after the last position."""
    change = edits.where("standing and action <> '" + INSERT + "'").select("doc", F.col("paragraph").alias("position"), "action", F.col("text").alias("_new"))
    kept = paragraphs.select("doc", "position", "text").join(change, ["doc", "position"], "left").where(F.col("action").isNull() | (F.col("action") != DELETE))
    kept = kept.select("doc", "position", F.lit(0).alias("part"), F.when(F.col("action") == REPLACE, F.col("_new")).otherwise(F.col("text")).alias("text"))
    last = paragraphs.groupBy("doc").agg(F.max("position").alias("_last"))
    new = edits.where(F.col("standing") & (F.col("action") == INSERT)).join(last, "doc").withColumn("position", F.when(F.col("paragraph") < 0, F.col("_last")).otherwise(F.col("paragraph")))
    part = F.row_number().over(Window.partitionBy("doc", "position").orderBy(F.col("paragraph") < 0, "number"))
    return kept.unionByName(new.select("doc", "position", part.cast("int").alias("part"), "text"))


def standing_spans(edits: Column) -> Column:
    """Of an array of (start, end, text) those that stand, in order: as many as can without two of them overlapping, always the one
    that ends first. Spans are half open; empty ones insert, and stand between others. Spans that end before they start or
    begin below 0 are left out, and of equal spans the least text stays."""
    able = F.array_sort(F.transform(F.filter(edits, lambda e: (e["start"] >= 0) & (e["end"] >= e["start"])), lambda e: F.struct(e["end"].alias("end"), e["start"].alias("start"), e["text"].alias("text"))))
    kind = "array<struct<start:int,end:int,text:string>>"

    def take(held: Column, e: Column) -> Column:
        last = F.element_at(held["kept"], -1)
        fits = (F.size(held["kept"]) == 0) | ((e["start"] >= last["end"]) & ~((e["start"] == last["start"]) & (e["end"] == last["end"])))
        one = F.array(F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["text"].cast("string").alias("text"))).cast(kind)
        return F.struct(F.when(fits, F.concat(held["kept"], one)).otherwise(held["kept"]).alias("kept"))

    return F.aggregate(able, F.struct(F.array().cast(kind).alias("kept")), take)["kept"]


def shifted_starts(kept: Column) -> Column:
    """Where each standing span begins once those before it are applied."""
    grow = F.transform(kept, lambda e: F.length(F.coalesce(e["text"], F.lit(""))) - (e["end"] - e["start"]))
    return F.transform(kept, lambda e, k: e["start"] + F.aggregate(F.slice(grow, F.lit(1), k), F.lit(0), lambda a, x: a + x))


def with_spans(text: Column, kept: Column) -> Column:
    """The text with standing spans applied. Spans beyond its end reach to its end."""
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at(kept, F.greatest(k, F.lit(1)))["end"])
    pieces = F.transform(kept, lambda e, k: F.concat(F.substring(text, before(k) + 1, e["start"] - before(k)), F.coalesce(e["text"], F.lit(""))))
    tail = F.when(F.size(kept) == 0, text).otherwise(F.substring(text, F.element_at(kept, -1)["end"] + 1, F.length(text)))
    return F.concat(F.array_join(pieces, ""), tail)
