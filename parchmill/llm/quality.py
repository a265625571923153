"""Quality rules: word and line figures of each document, and how often its lines stand in other documents of its host.

Native: DataFrame functions only. A line's normal form (blanks squeezed, trimmed, lower case) is hashed, and for
each host and line the distinct documents are counted. Copies of one document must not make its own lines look like
boilerplate, so texts that are equal in normal form count once: a document's identity is the hash of its whole normal form,
which no shared line decides. Lightly edited copies are different documents, and the lines they share count for each of
them. A line in at least `min_documents` documents is removed if these are at least `min_share` of its host's or, for a line
of `long_line` words or more, at least as many as the square root of its host's; the limit for long lines thus stays far
below the size of a large host. A document that loses more than half of its words is depleted and rejected.

Defined results: null texts have no words and fail the base rules; null hosts form one host; empty tables give empty
results; every row is judged by itself, so repeated rows and rows without an id each get their own verdict and stay or go
like any other; other columns, whatever their names, are passed through by `clean_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.session import read_table, settled

WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"
BLANK = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_DOCUMENTS = 20
MIN_SHARE = 0.05
#: Words of a line that is no phrase of everyday use, so that a small share of a large host's documents is enough.
LONG_LINE = 8


def line_form(line: str) -> str:
    """SQL for the hash of a line's normal form."""
    return f"xxhash64(lower(trim(regexp_replace({line}, '[\\\\x20\\\\x09-\\\\x0D]+', ' '))))"


def document_figures(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row a document: `row` (its columns `keep`, by default all), its figures, its identity (the hash of its whole normal
    form) and its lines as (h, words)."""
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
        .select(
            "row",
            "host",
            F.expr(f"regexp_extract_all(text, '{WORD}', 0)").alias("words"),
            F.expr("filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
            (F.length("text") - F.length(F.translate("text", BLANK, ""))).alias("blanks"),
            F.length("text").alias("chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("symbols"),
        )
        .select(
            "row",
            "host",
            F.expr("transform(words, w -> xxhash64(w))").alias("hashes"),
            F.expr("xxhash64(lower(array_join(words, ' ')))").alias("identity"),
            F.expr("cast(chars - blanks as bigint)").alias("word_chars"),
            F.expr("cast(symbols as bigint)").alias("n_symbols"),
            F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
            F.expr(f"transform(lines, x -> struct({line_form('x')} as h, size(regexp_extract_all(x, '{WORD}', 0)) as words))").alias("lines"),
        )
        .select(
            "*",
            F.expr("sort_array(if(size(hashes) >= 3, transform(sequence(0, size(hashes) - 3), i -> struct(xxhash64(hashes[i], hashes[i + 1], hashes[i + 2]) as h, i as i)), cast(array() as array<struct<h: bigint, i: int>>)))").alias("windows"),
        )
        .select(
            "*",
            F.expr("sort_array(transform(filter(windows, (x, k) -> (k > 0 and windows[k - 1].h = x.h) or (k + 1 < size(windows) and windows[k + 1].h = x.h)), x -> x.i))").alias("places"),
        )
        .select(
            "row",
            "host",
            "identity",
            F.expr("cast(size(hashes) as bigint)").alias("n_words"),
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            F.expr("aggregate(transform(places, (p, k) -> if(k + 1 < size(places), least(3, places[k + 1] - p), 3)), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
            "lines",
        )
        .withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words"))
    )


def common_lines(figures: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE, long_line: int = LONG_LINE) -> DataFrame:
    """(host, h): the lines above the limits. Pairs of a line and an identity are made distinct before they are counted,
    so no host and no line is gathered in one task."""
    documents = figures.groupBy("host").agg(F.countDistinct("identity").alias("of"))
    seen = figures.select("host", "identity", F.explode("lines").alias("line")).select("host", "identity", "line.h", "line.words")
    forms = seen.groupBy("host", "h", "words").agg(F.countDistinct("identity").alias("n")).where(F.col("n") >= min_documents)
    return forms.join(documents, "host").where(f"n >= {min_share} * of or (words >= {long_line} and n * n >= of)").select("host", "h")


def _numbered(figures: DataFrame) -> DataFrame:
    """Figures on disk, each row with a number of its own."""
    return settled(figures.withColumn("number", F.monotonically_increasing_id()), "figures")


def judge(figures: DataFrame, common: DataFrame) -> DataFrame:
    """Numbered figures with removed_words, taken (the lines to take out, an array that the document's length bounds) and kept."""
    lines = figures.select("number", "host", F.explode("lines").alias("line")).select("number", "host", "line.h", "line.words")
    lost = lines.join(common, ["host", "h"]).groupBy("number").agg(F.sum("words").alias("removed_words"), F.collect_set("h").alias("taken"))
    return (
        figures.drop("lines", "identity", "host")
        .join(lost, "number", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("kept", F.expr("not base_failed and 2 * removed_words <= n_words"))
    )


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """doc_id, figures and verdict of every row."""
    figures = _numbered(document_figures(docs, host, text, [doc_id]))
    judged = judge(figures, settled(common_lines(figures, **limits), "common-lines"))
    return judged.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def clean_documents(docs: DataFrame, host: str = "source", text: str = "text", chars: str = "n_chars", **limits) -> DataFrame:
    """The kept documents with their common lines taken out, all columns kept; a column `chars` of a changed text is counted anew."""
    figures = _numbered(document_figures(docs, host, text))
    kept = judge(figures, settled(common_lines(figures, **limits), "common-lines")).where("kept").select("row", "taken")
    whole = F.col(f"row.`{text}`")
    rest = F.expr(f"array_join(filter(split(row.`{text}`, '\\n'), x -> not array_contains(taken, {line_form('x')})), '\\n')")
    out = kept.select("row", "taken", F.when(F.col("taken").isNull(), whole).otherwise(rest).alias("left"))
    new = {text: F.col("left")}
    if chars in docs.columns:
        new[chars] = F.when(F.col("taken").isNull(), F.col(f"row.`{chars}`")).otherwise(F.length("left")).cast(docs.schema[chars].dataType)
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules(read_table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


#: The same verdicts for DuckDB, which counts the lines themselves where Spark counts their hashes.
OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
v AS (SELECT *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) AS win FROM w),
p AS (SELECT doc_id, unnest(win) AS g, unnest(range(1, len(win) + 1)) AS i FROM v WHERE len(ws) >= 3),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY 1),
f AS (SELECT w.doc_id, host, ls, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, lower(array_to_string(ws, ' ')) AS whole FROM w LEFT JOIN c USING (doc_id)),
l AS (SELECT doc_id, host, whole, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS form, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
      FROM (SELECT doc_id, host, whole, unnest(ls) AS x FROM f)),
h AS (SELECT host, count(DISTINCT whole) AS docs FROM f GROUP BY 1),
n AS (SELECT host, form, words, count(DISTINCT whole) AS n FROM l GROUP BY 1, 2, 3),
k AS (SELECT n.host, form FROM n JOIN h ON n.host = h.host
      WHERE n >= {MIN_DOCUMENTS} AND (n >= {MIN_SHARE} * docs OR (words >= {LONG_LINE} AND n * n >= docs))),
x AS (SELECT doc_id, sum(words) AS removed FROM l JOIN k ON l.host = k.host AND l.form = k.form GROUP BY 1)
SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 2 * coalesce(removed, 0) <= n_words AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed_words
FROM f LEFT JOIN x ON f.doc_id = x.doc_id
"""
