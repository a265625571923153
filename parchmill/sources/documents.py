"""Files of several formats as paragraphs: each goes to the reader of its format, by the end of its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions.mail import mail_texts
from parchmill.operators.structure import paragraphs
from parchmill.sources import docx

#: Ends of names by format.
FORMATS = {"docx": [".docx"], "text": [".txt", ".text", ".md"], "html": [".html", ".htm"]}
PARAGRAPHS = "path string, format string, status string, index int, text string"


def format_of(path: Column) -> Column:
    """The format of a file name, a query or fragment behind it left out; null if no reader takes it."""
    name = F.lower(F.regexp_extract(path, r"^([^?#]*)", 1))
    return F.coalesce(*[F.when(name.endswith(end), kind) for kind, ends in FORMATS.items() for end in ends])


def read_documents(files: DataFrame) -> DataFrame:
    """PARAGRAPHS of files (path, content). A file that no reader takes, or that its reader refuses, is a row with its status; a
    file without text is `no text`. Text is UTF-8, and what is not is replaced."""
    known = files.withColumn("format", format_of(F.col("path")))
    package = docx.from_bytes(known.where("format = 'docx'")).where("source_index is not null or status <> 'ok'").select("path", F.lit("docx").alias("format"), "status", F.col("source_index").alias("index"), "text")
    plain = known.where("format <> 'docx'").select("path", "format", F.decode(F.coalesce("content", F.lit("").cast("binary")), "UTF-8").alias("text"))
    whole = plain.withColumn("text", F.when(F.col("format") == "html", mail_texts("text")).otherwise(F.col("text")))
    found = paragraphs(whole, "path").select(F.col("doc_id").alias("path"), "index", "text").join(plain.select("path", "format"), "path").select("path", "format", F.lit("ok").alias("status"), "index", "text")
    none = F.lit(None)
    empty = whole.where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) == "").select("path", "format", F.lit("no text").alias("status"), none.cast("int").alias("index"), none.cast("string").alias("text"))
    other = known.where("format is null").select("path", "format", F.lit("unsupported").alias("status"), none.cast("int").alias("index"), none.cast("string").alias("text"))
    return package.unionByName(found).unionByName(empty).unionByName(other)
