"""Agreements composed from the orders, one each, so that structure, concepts and clause checks run over given tables.

The wording of a clause follows a column: the definition the order's priority, the duty its status, the law and the forum its
customer's nation, the term and the signatures its key, and each line of the order is a numbered clause that cites another. One
in seventeen is a leaflet instead. SQL composes the same texts (`p`, a row a paragraph) from the same columns, and every
query's SQL says from the columns what a reader of such an agreement finds, without the patterns that find it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.session import read_table, shuffle_width

LEAFLET = ["1. Our Product", "Fast and light.", "2. Our Market", "Large and old."]
DEFINED = {
    1: "Confidential Information means business, financial, technical and customer material. It does not include matter in the public domain.",
    2: "Confidential Information means the business plan.",
    3: "Confidential Information includes information in the public domain.",
    4: "Confidential Information means business, financial, technical and customer material, whatever is independently developed. Nothing publicly available counts.",
    5: "Words have their usual sense.",
}
DUTY = {"F": "Each party shall keep the material confidential as set out in clause ", "O": "The receiving party alone shall protect what it learns.", "P": "Either party may mark its papers."}
LAW = {0: "England and Wales", 1: "Delaware", 2: "Norway", 3: "a place to be agreed", 4: "Ontario"}
CUE = {"A": " A penalty of ten units applies.", "R": " The buyer shall not compete.", "N": ""}
SIGNED = ["Signed by: Ann Title: Director Date: 2026-01-05", "Signed by: Bob Title: Director"]
WORDS = "one two three four five six seven eight nine".split()


def _pick(c: Column, choices: dict, default: str | None = None) -> Column:
    out = F.when(F.lit(False), "")
    for key, value in choices.items():
        out = out.when(c == key, value)
    return out.otherwise(default)


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): one row an order."""
    line = F.concat(F.lit(". Part "), "l_partkey", F.lit(" is delivered as set out in section "), F.col("l_linenumber") % 6 + 1, F.lit("."), _pick(F.col("l_returnflag"), CUE))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"]
    # As many parts as the session shuffles into: the rows are small, but not what is made of them. Orders and lines are dealt out once.
    width = shuffle_width(spark)
    parted = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), *order, line.alias("line")).repartition(width, "k")
    lines = parted.groupBy("k").agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("lines"))  # one order's lines
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"))
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("pri"))
    o = o.join(customers, "c", "left").repartition(width, "k").join(lines, "k", "left")
    k, q = F.col("k"), F.col("k") % 9 + 1
    word = F.element_at(F.array(*map(F.lit, WORDS)), q.cast("int"))
    term = F.when(k % 11 == 0, "in perpetuity").when(k % 3 == 0, F.concat(q, F.lit(" years"))).when(k % 3 == 1, F.concat(word, F.lit(" ("), q, F.lit(") years"))).otherwise(F.concat(q * 12, F.lit(" months")))
    law = F.coalesce(F.concat(F.lit("This agreement is governed by the laws of "), _pick(F.col("n") % 6, LAW), F.lit(".")), F.lit("Disputes are settled in good faith."))
    forum = F.when(F.col("n") % 4 == 0, " The seat of arbitration is Dubai.").when(F.col("n") % 4 == 1, " The courts of London shall decide.").otherwise("")
    duty = F.concat(_pick(F.col("o_orderstatus"), DUTY), F.when(F.col("o_orderstatus") == "F", F.concat(k % 7 + 1, F.lit(" and 9."))).otherwise(""))
    clauses = F.transform(F.coalesce("lines", F.array().cast(o.schema["lines"].dataType)), lambda x, i: F.concat(F.lit("3."), i + 1, x["line"]))
    pieces = F.concat(
        F.array(F.when(k % 5 == 0, "MUTUAL DISCLOSURE AGREEMENT").otherwise("DISCLOSURE AGREEMENT"), F.concat(F.lit("WHEREAS buyer "), "c", F.lit(" wishes to trade."))),
        F.when(F.col("c") % 10 == 0, F.array(F.concat(F.lit("Buyer "), "c", F.lit(" is a company incorporated under the laws of Ontario.")))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("1. Definitions"), _pick(F.col("pri"), DEFINED), F.lit("2. Confidentiality"), duty, F.when(k % 19 == 0, "Section 3: Goods").otherwise("3. Goods")),
        clauses,
        F.array(F.lit("4. Term"), F.concat(F.lit("4.1. The duties last "), term, F.when(k % 2 == 0, ", subject to clause 2").otherwise(""), F.lit("."), F.when(k % 7 == 3, " Trade secrets stay secret for 20 years.").otherwise(""))),
        F.array(F.when(k % 13 == 0, "4. Governing Law").otherwise("5. Governing Law"), F.concat(law, forum)),
        F.when(k % 4 == 0, F.array(*map(F.lit, ["SIGNED FOR THE PARTIES", *SIGNED]))).when(k % 4 == 1, F.array(F.lit("SIGNED FOR THE PARTIES"), F.lit("By: Cy"))).otherwise(F.array().cast("array<string>")),
    )
    return o.select(k.alias("doc_id"), F.array_join(F.when(k % 17 == 0, F.array(*map(F.lit, LEAFLET))).otherwise(pieces), "\n\n").alias("text"))


def _case(column: str, choices: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {key!r} THEN '{value}'" for key, value in choices.items()) + f" ELSE {default} END"


def _paragraph(kind: str, index: str, text: str, where: str, source: str = "o") -> str:
    return f"SELECT k, {index} AS i, '{kind}' AS kind, {'j' if source != 'o' else 'NULL'} AS j, {text} AS text FROM {source} WHERE {where}"


_TERM = "CASE WHEN k % 11 = 0 THEN 'in perpetuity' WHEN k % 3 = 0 THEN q || ' years' WHEN k % 3 = 1 THEN ['" + "', '".join(WORDS) + "'][q] || ' (' || q || ') years' ELSE (q * 12) || ' months' END"
_PARAGRAPHS = [
    *[_paragraph(f"leaflet{n}", str(n), f"'{x}'", "leaflet") for n, x in enumerate(LEAFLET, 1)],
    _paragraph("title", "1", "CASE WHEN k % 5 = 0 THEN 'MUTUAL ' ELSE '' END || 'DISCLOSURE AGREEMENT'", "NOT leaflet"),
    _paragraph("whereas", "2", "'WHEREAS buyer ' || c || ' wishes to trade.'", "NOT leaflet"),
    _paragraph("recital", "3", "'Buyer ' || c || ' is a company incorporated under the laws of Ontario.'", "NOT leaflet AND r = 1"),
    _paragraph("h1", "3 + r", "'1. Definitions'", "NOT leaflet"),
    _paragraph("definition", "4 + r", _case("pri", DEFINED), "NOT leaflet"),
    _paragraph("h2", "5 + r", "'2. Confidentiality'", "NOT leaflet"),
    _paragraph("duty", "6 + r", _case("st", DUTY) + " || CASE WHEN st = 'F' THEN (k % 7 + 1) || ' and 9.' ELSE '' END", "NOT leaflet"),
    _paragraph("h3", "7 + r", "CASE WHEN k % 19 = 0 THEN 'Section 3: Goods' ELSE '3. Goods' END", "NOT leaflet"),
    _paragraph("line", "7 + r + j", "'3.' || j || '. Part ' || part || ' is delivered as set out in section ' || x || '.' || " + _case("flag", CUE), "NOT leaflet", "(SELECT * FROM o JOIN ln USING (k))"),
    _paragraph("h4", "8 + r + n", "'4. Term'", "NOT leaflet"),
    _paragraph("term", "9 + r + n", f"'4.1. The duties last ' || {_TERM} || CASE WHEN k % 2 = 0 THEN ', subject to clause 2' ELSE '' END || '.' || CASE WHEN k % 7 = 3 THEN ' Trade secrets stay secret for 20 years.' ELSE '' END", "NOT leaflet"),
    _paragraph("h5", "10 + r + n", "CASE WHEN twice THEN '4. Governing Law' ELSE '5. Governing Law' END", "NOT leaflet"),
    _paragraph("law", "11 + r + n", "coalesce('This agreement is governed by the laws of ' || " + _case("law", LAW) + " || '.', 'Disputes are settled in good faith.') || CASE forum WHEN 0 THEN ' The seat of arbitration is Dubai.' WHEN 1 THEN ' The courts of London shall decide.' ELSE '' END", "NOT leaflet"),
    _paragraph("signed", "12 + r + n", "'SIGNED FOR THE PARTIES'", "NOT leaflet AND k % 4 < 2"),
    *[_paragraph("signature", f"{13 + m} + r + n", f"'{x}'", "NOT leaflet AND k % 4 = 0") for m, x in enumerate(SIGNED)],
    _paragraph("signature", "13 + r + n", "'By: Cy'", "NOT leaflet AND k % 4 = 1"),
]

#: o: a row an order; ln: its lines; p: its paragraphs (k, i, kind, j, text, start); s: its sections (k, ordinal, kind, number, head, first and last
#: paragraph); cited: what its clauses cite (k, i, kind, number, own). n is the number of lines and r whether there is a recital.
COMPOSED = f"""ln AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS j, l_partkey AS part, l_returnflag AS flag, l_linenumber % 6 + 1 AS x FROM lineitem),
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, CAST(substr(o_orderpriority, 1, 1) AS INT) AS pri, c_nationkey % 6 AS law, c_nationkey % 4 AS forum, CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS r, coalesce(m, 0) AS n, o_orderkey % 9 + 1 AS q, o_orderkey % 13 = 0 AS twice, o_orderkey % 17 = 0 AS leaflet
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT k, count(*) AS m FROM ln GROUP BY 1) z ON z.k = o_orderkey),
p AS (SELECT k, CAST(i AS INT) AS i, kind, j, text, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM ({' UNION ALL '.join(_PARAGRAPHS)})),
s AS (SELECT k, 1 AS ordinal, 'heading' AS kind, NULL AS number, CASE WHEN k % 5 = 0 THEN 'MUTUAL ' ELSE '' END || 'DISCLOSURE AGREEMENT' AS head, 1 AS first, 2 + r AS last FROM o WHERE NOT leaflet
  UNION ALL SELECT k, 2, 'numbered', '1', 'Definitions', 3 + r, 4 + r FROM o WHERE NOT leaflet UNION ALL SELECT k, 3, 'numbered', '2', 'Confidentiality', 5 + r, 6 + r FROM o WHERE NOT leaflet
  UNION ALL SELECT k, 4, CASE WHEN k % 19 = 0 THEN 'section' ELSE 'numbered' END, '3', 'Goods', 7 + r, 7 + r FROM o WHERE NOT leaflet
  UNION ALL SELECT k, 4 + p.j, 'numbered', '3.' || p.j, substr(text, length('3.' || p.j || '. ') + 1), i, i FROM p WHERE p.kind = 'line'
  UNION ALL SELECT k, 5 + n, 'numbered', '4', 'Term', 8 + r + n, 8 + r + n FROM o WHERE NOT leaflet
  UNION ALL SELECT k, 6 + n, 'numbered', '4.1', substr(text, 6), i, i FROM p JOIN o USING (k) WHERE p.kind = 'term'
  UNION ALL SELECT k, 7 + n, 'numbered', CASE WHEN twice THEN '4' ELSE '5' END, 'Governing Law', 10 + r + n, 11 + r + n FROM o WHERE NOT leaflet
  UNION ALL SELECT k, 8 + n, 'heading', NULL, 'SIGNED FOR THE PARTIES', 12 + r + n, 14 + r + n - k % 4 FROM o WHERE NOT leaflet AND k % 4 < 2
  UNION ALL SELECT k, 1, 'numbered', '1', 'Our Product', 1, 2 FROM o WHERE leaflet UNION ALL SELECT k, 2, 'numbered', '2', 'Our Market', 3, 4 FROM o WHERE leaflet),
cited AS (SELECT k, CAST(7 + r + j AS INT) AS i, 'section' AS kind, CAST(x AS VARCHAR) AS number, FALSE AS own FROM o JOIN ln USING (k) WHERE NOT leaflet
  UNION ALL SELECT k, CAST(6 + r AS INT), 'clause', CAST(unnest([k % 7 + 1, 9]) AS VARCHAR), FALSE FROM o WHERE NOT leaflet AND st = 'F'
  UNION ALL SELECT k, CAST(9 + r + n AS INT), 'clause', '2', FALSE FROM o WHERE NOT leaflet AND k % 2 = 0
  UNION ALL SELECT k, CAST(7 + r AS INT), 'section', '3', TRUE FROM o WHERE NOT leaflet AND k % 19 = 0),
found AS (SELECT k, i, cited.kind, number, own, CASE number WHEN '1' THEN 2 WHEN '2' THEN 3 WHEN '3' THEN 4 WHEN '4' THEN CASE WHEN NOT twice THEN 5 + n END WHEN '5' THEN CASE WHEN NOT twice THEN 7 + n END END AS ordinal, number = '4' AND twice AS ambiguous FROM cited JOIN o USING (k))"""
WITH = f"WITH {COMPOSED} "
