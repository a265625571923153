"""URL filters as a sort-merge range join.

A host written backwards, label by label ("com.example.www."), turns "this host and all its subdomains" into a
prefix, and a prefix into an interval of the sort order. Urls and rules are dealt out by ranges of that order; a
rule goes to every range that its interval meets. A sweep over each sorted range keeps a stack of the rules whose
interval is open, nested ones on top.

Defined results: null urls and urls without "://" have an empty host and path and no rule; repeated rows are judged
alike; of rules of one length the one with the longer host wins, then "block"; null rules are ignored; empty tables
give empty results. Only the key column, host, path, rule and verdict are returned, so other columns never clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.session import read_table, shuffle_width

#: Keys sampled for each range when the ranges are laid out, by a hash, so the sample is repeatable.
SAMPLE_PER_RANGE = 20
RANGES_PER_PARTITION, MAX_RANGES = 8, 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def url_parts(url: str = "url") -> list:
    """Columns host and path of a url column."""
    rest = F.expr(f"if(instr(`{url}`, '://') > 0, substring(`{url}`, instr(`{url}`, '://') + 3), '')")
    return [F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path")]


def reversed_host(host: str = "host"):
    """"www.example.com" as "com.example.www."; the empty host stays empty."""
    return F.expr(f"if(`{host}` = '', '', concat(array_join(reverse(split(`{host}`, '[.]')), '.'), '.'))")


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict of every row. `rules` has rule ("host/path") and verdict; of those that fit the longest wins."""
    width = shuffle_width(pages.sparkSession)
    ranges = min(RANGES_PER_PARTITION * width, MAX_RANGES)
    urls = pages.select(F.col(key).alias("_id"), *url_parts(url)).withColumn("_key", F.concat(reversed_host(), F.lit(" "), "path"))
    wanted = SAMPLE_PER_RANGE * ranges
    share = max(1, pages.count() // wanted)
    sample = urls.where(F.pmod(F.xxhash64("_id", "_key"), F.lit(share)) == 0).select("_key").limit(2 * wanted)
    keys = sorted(r["_key"] for r in sample.collect())  # bounded by the number of ranges
    bounds = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []

    @F.pandas_udf("array<int>")
    def meets(lo, hi):
        import pandas as pd

        return pd.Series([[*range(bisect_left(bounds, a), bisect_right(bounds, b) + 1)] for a, b in zip(lo, hi, strict=True)])

    @F.pandas_udf("int")
    def home(own, salt):
        import pandas as pd

        return pd.Series([(a := bisect_left(bounds, k)) + s % (bisect_right(bounds, k) - a + 1) for k, s in zip(own, salt, strict=True)], dtype="int32")

    own = rules.where("rule is not null and verdict is not null").select(
        F.expr("substring_index(rule, '/', 1)").alias("host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("path"), "rule", "verdict"
    )
    own = own.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "rule", "verdict").withColumn("_key", reversed_host())
    dealt_rules = own.select(F.explode(meets("_key", F.concat("_key", F.lit(LAST)))).alias("_range"), "_key", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_id"), "host", "path", "rule", "verdict")
    id_type = dict(urls.dtypes)["_id"]
    dealt_urls = urls.select(home("_key", F.pmod(F.xxhash64("_id", "_key"), F.lit(1 << 20))).alias("_range"), "_key", F.lit(1).alias("_kind"), F.col("_id").cast("string").alias("_id"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    sorted_ranges = dealt_rules.unionByName(dealt_urls).repartition(width, "_range").sortWithinPartitions("_range", "_key", "_kind")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("_id", "host", "path", "rule", "verdict")])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict[str, tuple[str, str]], set[int]]] = []  # (prefix, rules by path, lengths of these paths)
        at = None
        for b in batches:
            out: list[tuple] = []
            for where, own_key, kind, ident, host, path, rule, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if where != at:
                    stack, at = [], where
                while stack and not own_key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != own_key:
                        stack.append((own_key, {}, set()))
                    known = stack[-1][1].get(path)
                    if known is None or verdict == "block":
                        stack[-1][1][path] = rule, verdict
                        stack[-1][2].add(len(path))
                    continue
                best = None
                for prefix, by_path, lengths in stack:
                    for n in lengths:
                        found = by_path.get(path[:n]) if n <= len(path) else None
                        if found and (best is None or (len(found[0]), len(prefix)) >= best[0]):
                            best = (len(found[0]), len(prefix)), found
                out.append((ident, host, path, *(best[1] if best else (None, default))))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["_id", "host", "path", "rule", "verdict"])

    return sorted_ranges.mapInArrow(sweep, schema).select(F.col("_id").cast(id_type).alias(key), "host", "path", "rule", "verdict")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


OP5_SQL = f"""
WITH rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
r AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, length(split_part(rule, '/', 1)) + 1) AS rp FROM rules),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
