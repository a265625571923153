"""Queries over normal forms, sentences, search terms, fingerprints and duplicates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchmill.functions import text as X
from parchmill.operators import dedup
from parchmill.session import read_table, shuffle_width

QUERIES: dict = {}
SQL: dict[str, str] = {}

DUCK_FORM = "replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')"
DUCK_WORDS = f"regexp_extract_all({DUCK_FORM}, '[\\pL\\pN_]+')"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def docs(spark, d):
    return read_table(spark, d, "documents")


def spread(spark, d):
    """Documents for a Python stage: a small file is one partition, so its rows are dealt out first."""
    return docs(spark, d).select("doc_id", "text", "source", "lang").repartition(shuffle_width(spark))


@query("s1_record_scan", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey")
def s1(spark, d):
    return read_table(spark, d, "orders").where("o_custkey = 7").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("s2_point_lookup", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 42 AND source = (SELECT source FROM documents WHERE doc_id = 42)")
def s2(spark, d):
    t = docs(spark, d)
    owner = t.where("doc_id = 42").select(F.col("source").alias("own"))
    return t.where("doc_id = 42").join(owner, F.col("source") == F.col("own"), "left_semi").select("doc_id", "source", "n_chars").limit(1)


@query("s7_backup_manifest", "SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1")
def s7(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("s14_flatten_groups", "SELECT source, doc_id FROM documents")
def s14(spark, d):
    """Grouped payload and back: groups hold their members as an array, as the grouped listing does."""
    grouped = docs(spark, d).groupBy("source", F.pmod("doc_id", F.lit(64)).alias("part")).agg(F.collect_list("doc_id").alias("members"))
    return grouped.select("source", F.explode("members").alias("doc_id"))


@query("t1_hash_form", f"SELECT doc_id, sha256({DUCK_FORM}) AS digest, length({DUCK_FORM}) AS chars FROM documents")
def t1(spark, d):
    form = X.hash_form(F.col("text"))
    return docs(spark, d).select("doc_id", F.sha2(form, 256).alias("digest"), F.length(form).cast("long").alias("chars"))


@query("t2_rule_form", "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents")
def t2(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(X.rule_form(F.col("text")), 256).alias("digest"))


@query("t3_words", f"SELECT doc_id, CAST(len({DUCK_WORDS}) AS BIGINT) AS words, coalesce({DUCK_WORDS}[1], '') AS first_word FROM documents")
def t3(spark, d):
    w = X.words(X.hash_form(F.col("text")))
    return docs(spark, d).select("doc_id", F.size(w).cast("long").alias("words"), F.coalesce(F.get(w, F.lit(0)), F.lit("")).alias("first_word"))


def _sentence_sql(marks: str) -> str:
    cut = f"string_split_regex(regexp_replace(text, '({marks})\\s+', '\\1' || chr(10), 'g'), '\\n+')"
    return f"SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM (SELECT doc_id, list_filter(list_transform({cut}, lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)"


@query("t6_sentences", _sentence_sql("[.;]"))
def t6(spark, d):
    s = X.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query("t7_sentences_colon", _sentence_sql("[.;:]"))
def t7(spark, d):
    s = X.sentences(F.col("text"), colon=True)
    return docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query("t8_literal_pattern", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\\bgeneral\\s+public\\s+license\\b')")
def t8(spark, d):
    return docs(spark, d).where(F.lower("text").rlike(X.literal_pattern("general public license"))).select("doc_id")


@query("t9_leading_number", rf"""SELECT l_orderkey, l_linenumber, regexp_extract(line, '^({X.NUMBER})(\s*[:.\-–—]\s*|\s+)', 1) AS number, regexp_extract(line, '^({X.NUMBER})(\s*[:.\-–—]\s*|\s+)(.*)$', 3) AS rest
FROM (SELECT l_orderkey, l_linenumber, l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN '. ' ELSE ' ' END || l_returnflag AS line FROM lineitem)""")
def t9(spark, d):
    line = F.concat("l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, ". ").otherwise(" "), "l_returnflag")
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.leading_number(line).alias("n")).select("l_orderkey", "l_linenumber", "n.number", "n.rest")


@query("t11_neutral", "SELECT conv_id, turn, sha256(regexp_replace(regexp_replace(role || ': ' || text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '(?im)^(\\s*(?:system|assistant|user|developer|tool)\\s*):', '\\1 -', 'g')) AS digest FROM conversations")
def t11(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.sha2(X.neutral(F.concat("role", F.lit(": "), "text")), 256).alias("digest"))


@query("t12_snippet", """WITH c AS (SELECT doc_id, trim(regexp_replace(substr(text, 1, 4000), '\\s+', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id, t, least(nullif(strpos(lower(t), 'license'), 0), nullif(strpos(lower(t), 'licensed'), 0)) - 1 AS pos FROM c),
s AS (SELECT doc_id, t, greatest(0, pos - 70) AS a, least(length(t), pos + 180) AS b, pos FROM p)
SELECT doc_id, CASE WHEN pos IS NULL THEN '' ELSE substr((CASE WHEN a > 0 THEN '...' ELSE '' END) || substr(t, a + 1, b - a) || (CASE WHEN b < length(t) THEN '...' ELSE '' END), 1, 180) END AS snippet FROM s""")
def t12(spark, d):
    return docs(spark, d).select("doc_id", X.snippet(F.col("text"), ["license", "licensed"]).alias("snippet"))


@query("t14_entity_key", "SELECT DISTINCT lower(trim(source)) AS entity FROM documents")
def t14(spark, d):
    return docs(spark, d).select(X.entity_key(F.col("source")).alias("entity")).distinct()


@query("t17_longest_run", "SELECT doc_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(text, '[\\pL\\pN]+'), lambda x: length(x))), 0) AS BIGINT) AS longest FROM documents")
def t17(spark, d):
    return docs(spark, d).select("doc_id", X.longest_run(F.col("text")).cast("long").alias("longest"))


@query("q11_query_terms", f"""SELECT conv_id, turn, list_filter(list_distinct_ordered, lambda t: t NOT IN ({', '.join(f"'{w}'" for w in X.STOP_WORDS)})) AS terms FROM (
  SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(lower(text), '[\\pL\\pN][\\pL\\pN._''-]*'), lambda t: regexp_replace(t, '[._''-]+$', '')), lambda t: length(t) > 1) AS l,
         list_filter(l, lambda t, i: list_position(l, t) = i) AS list_distinct_ordered FROM conversations)""")
def q11(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", X.query_terms(F.col("text")).alias("terms"))


DUCK_BITS = """w AS (SELECT doc_id, source, form, regexp_extract_all(form, '[\\pL\\pN_]+') AS ws FROM (SELECT doc_id, source, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS form FROM documents)),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ('0x' || substr(sha1(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]), 1, 16))::UBIGINT)) AS h FROM w WHERE len(ws) >= 3),
v AS (SELECT doc_id, b, sum(CAST((h >> b) & 1 AS INT)) * 2 > count(*) AS bit FROM g, (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY doc_id, b),
s AS (SELECT doc_id, CAST(sum(CASE WHEN bit THEN (1::UBIGINT << b)::HUGEINT ELSE 0::HUGEINT END) AS UBIGINT) AS sim FROM v GROUP BY doc_id),
f AS (SELECT w.doc_id, source, CASE WHEN len(ws) > 0 THEN sha256(form) END AS exact, sim, len(ws) AS words FROM w LEFT JOIN s ON w.doc_id = s.doc_id)"""


@query("j3_fingerprint", f"WITH {DUCK_BITS} SELECT doc_id, exact, CAST(sim AS VARCHAR) AS simhash, CAST(words AS BIGINT) AS word_count FROM f")
def j3(spark, d):
    return dedup.fingerprints(spread(spark, d)).select("doc_id", "exact", dedup.unsigned(F.col("simhash")).alias("simhash"), F.col("word_count").cast("long").alias("word_count"))


@query("j4_similarity", f"WITH {DUCK_BITS} SELECT a.doc_id AS doc_id, CASE WHEN a.exact = b.exact THEN 1.0 ELSE coalesce(round(1 - bit_count(CAST(xor(a.sim, b.sim) AS UBIGINT)) / 64.0, 4), 0.0) END AS similarity FROM f a JOIN f b ON b.doc_id = a.doc_id + 1")
def j4(spark, d):
    p = dedup.fingerprints(spread(spark, d))
    q = p.select((F.col("doc_id") - 1).alias("doc_id"), F.col("exact").alias("e2"), F.col("simhash").alias("s2"))
    return p.join(q, "doc_id").select("doc_id", F.round(dedup.similarity(F.col("exact"), F.col("e2"), F.col("simhash"), F.col("s2")), 4).alias("similarity"))


PAIR_SQL = "(a.exact = b.exact OR (a.source = b.source AND bit_count(CAST(xor(a.sim, b.sim) AS UBIGINT)) <= 4))"


@query("j5_duplicate_pairs", f"""WITH {DUCK_BITS}, c AS (SELECT exact, min(doc_id) AS a FROM f WHERE exact IS NOT NULL GROUP BY 1), k AS (SELECT source, exact, any_value(sim) AS sim, min(doc_id) AS doc_id FROM f WHERE exact IS NOT NULL AND sim IS NOT NULL AND source <> '' GROUP BY 1, 2)
SELECT a, doc_id AS b, 1.0 AS similarity FROM f JOIN c ON f.exact = c.exact WHERE a < doc_id UNION ALL
SELECT a.doc_id, b.doc_id, round(1 - bit_count(CAST(xor(a.sim, b.sim) AS UBIGINT)) / 64.0, 4) FROM k a JOIN k b ON a.doc_id < b.doc_id AND a.source = b.source AND a.exact <> b.exact AND bit_count(CAST(xor(a.sim, b.sim) AS UBIGINT)) <= 4""")
def j5(spark, d):
    return dedup.duplicate_pairs(dedup.fingerprints(spread(spark, d)), "doc_id", "source").withColumn("similarity", F.round("similarity", 4))


@query("j6_band_keys", f"WITH {DUCK_BITS} SELECT doc_id, CAST(sim & 8191 AS BIGINT) AS b0, CAST((sim >> 13) & 8191 AS BIGINT) AS b1, CAST((sim >> 26) & 8191 AS BIGINT) AS b2, CAST((sim >> 39) & 8191 AS BIGINT) AS b3, CAST((sim >> 52) & 4095 AS BIGINT) AS b4 FROM f WHERE sim IS NOT NULL")
def j6(spark, d):
    p = dedup.fingerprints(spread(spark, d)).where("simhash is not null").withColumn("k", dedup.band_keys(F.col("simhash")))
    return p.select("doc_id", *[F.get("k", F.lit(i)).alias(f"b{i}") for i in range(5)])


@query("j9_earliest_match", f"""WITH {DUCK_BITS}, p AS (SELECT a.doc_id AS doc, b.doc_id AS match, CASE WHEN a.exact = b.exact THEN 1.0 ELSE round(1 - bit_count(CAST(xor(a.sim, b.sim) AS UBIGINT)) / 64.0, 4) END AS similarity FROM f a JOIN f b ON a.doc_id <> b.doc_id AND {PAIR_SQL})
SELECT doc, min(match) AS match, arg_min(similarity, match) AS similarity FROM p GROUP BY 1""")
def j9(spark, d):
    return dedup.earliest_match(dedup.fingerprints(spread(spark, d)), "doc_id", "source")


@query("j9_exact_classes", f"SELECT doc_id AS doc, min(doc_id) OVER (PARTITION BY sha256({DUCK_FORM})) AS first, count(*) OVER (PARTITION BY sha256({DUCK_FORM})) AS copies FROM documents WHERE len({DUCK_WORDS}) > 0")
def j9_exact(spark, d):
    form = X.hash_form(F.col("text"))
    prints = docs(spark, d).select("doc_id", F.when(form.rlike(r"(?U)\w"), F.sha2(form, 256)).alias("exact"))
    return dedup.exact_classes(prints, "doc_id")


@query("a17_repeat_entity", "WITH n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1) SELECT source, n >= 2 AS repeat, count(*) AS documents FROM documents JOIN n USING (source) GROUP BY 1, 2")
def a17(spark, d):
    return dedup.repeat_entities(docs(spark, d).select("doc_id", "source"), "source", "doc_id").groupBy("source", "repeat").agg(F.count("*").alias("documents"))
