"""Texts against texts: inline differences, coverage of a source, distinct matches, strings inside nested values."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a token is, and how large a comparison on a page may grow.
TOKEN = re.compile(r"\s*(?:\d+(?:[,.]\d+)*|[^\W_]+(?:[-'’][^\W_]+)*|[^\s])|\s+")
TOKEN_CELLS, LETTER_CELLS = 40_000, 1_000_000
COVERAGE = 0.9
#: A task hands on its operations once it holds so many, however many pairs of texts a batch has.
OPERATIONS_AT_ONCE = 50_000

OPERATIONS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("token", T.StringType())]))


def operations(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """Tokens of a and b in one order, each the same, deleted or inserted; of equally long ways the one that deletes first.

    A row of bits stands for each place i in a: counted up to the last m of b, the bits that are not set are the longest common
    subsequence of what follows i with these m. A row comes from the one below it by one addition. Of all rows only every n-th is
    kept, n the square root of their number, and those between are made again on the way down."""
    out: list[tuple[str, str]] = []
    i = j = 0
    where: dict[str, int] = {}
    for k, t in enumerate(reversed(b)):
        where[t] = where.get(t, 0) | 1 << k
    full = (1 << len(b)) - 1

    def above(row: int, token: str) -> int:
        hit = row & where.get(token, 0)
        return (row + hit | row - hit) & full

    step, row = math.isqrt(len(a)) + 1, full
    kept = {len(a): full}
    for k in range(len(a) - 1, -1, -1):
        row = above(row, a[k])
        if k % step == 0:
            kept[k] = row
    common, follows = len(b) - row.bit_count(), full  # what i and j still have in common; the bits of what follows j
    for start in range(0, len(a), step):
        end = min(start + step, len(a))
        rows = {end: kept.pop(end)}
        for k in range(end - 1, start, -1):
            rows[k] = above(rows[k + 1], a[k])
        while i < end and j < len(b):
            same = a[i] == b[j]
            drop = not same and len(b) - j - (rows[i + 1] & follows).bit_count() == common
            out.append(("same", a[i]) if same else ("delete", a[i]) if drop else ("insert", b[j]))
            common -= same
            if not drop:
                j, follows = j + 1, follows >> 1
            i += same or drop
    return out + [("delete", t) for t in a[i:]] + [("insert", t) for t in b[j:]]


def operation_lists(pairs: Iterable[tuple[str | None, str | None]], cut: Callable[[str], list[str]], most: int | None = None) -> Iterator[pa.Array]:
    """The operations of each pair, in arrays of about OPERATIONS_AT_ONCE of them. most: pairs with more cells are replaced whole."""
    ends, ops, tokens = [0], [], []

    def held() -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(ops, pa.string()), pa.array(tokens, pa.string())], names=["op", "token"]))

    for x, y in pairs:
        a, b = cut(x or ""), cut(y or "")
        for op, token in [("delete", x), ("insert", y)] if most is not None and len(a) * len(b) > most else operations(a, b):
            ops.append(op)
            tokens.append(token)
        ends.append(len(ops))
        if len(ops) >= OPERATIONS_AT_ONCE:
            yield held()
            ends, ops, tokens = [0], [], []
    if len(ends) > 1:
        yield held()


def inline_diff(old: Column, new: Column, letters: bool = False, whole: bool = False) -> Column:
    """The operations that turn old into new, by tokens or by letters; null is empty. whole: whatever the size; else, as for what is
    shown on a page, too large a pair is replaced whole."""
    cut, most = (list, LETTER_CELLS) if letters else (TOKEN.findall, TOKEN_CELLS)
    most = None if whole else most

    @F.arrow_udf(OPERATIONS)
    def diff(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for olds, news in batches:
            yield from operation_lists(((x.as_py(), y.as_py()) for x, y in zip(olds, news, strict=True)), cut, most)

    return diff(old, new)


def coverage(sources: DataFrame, exports: DataFrame, doc: str) -> DataFrame:
    """(doc, verdict, first): whether an export's paragraphs (doc, index, text) cover those of its source: empty, short (less than
    COVERAGE of its characters), diverging (with the first index that differs) or covered. Blanks are squeezed, blank
    paragraphs do not count, and a source without text is covered by anything."""
    def tidy(rows):
        t = rows.select(doc, "index", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).where("text <> ''")
        return t.select(doc, "text", F.row_number().over(Window.partitionBy(doc).orderBy("index")).alias("k"))

    a, b = tidy(sources), tidy(exports).withColumnRenamed("text", "given")
    both = a.join(b, [doc, "k"], "full")
    g = both.groupBy(doc).agg(F.sum(F.length("text")).alias("whole"), F.count("text").alias("n"), F.sum(F.length("given")).alias("part"), F.count("given").alias("m"), F.min(F.when(~F.col("text").eqNullSafe(F.col("given")), F.col("k"))).alias("first"))
    chars = lambda c, n: F.coalesce(c, F.lit(0)) + F.greatest(n - 1, F.lit(0))
    whole, part = chars(F.col("whole"), F.col("n")), chars(F.col("part"), F.col("m"))
    verdict = F.when(whole == 0, "covered").when(part == 0, "empty").when(part < COVERAGE * whole, "short").when(F.col("first").isNotNull(), "diverging").otherwise("covered")
    return g.select(doc, verdict.alias("verdict"), F.when(verdict == "diverging", F.col("first")).alias("first"))


def matched(candidates: DataFrame, doc: str, left: str, right: str) -> DataFrame:
    """(doc, matched): the most edits (left) that can be given paragraphs (right) of their own, out of the candidate pairs of a
    document, by augmenting paths. A document's candidates are as many as its own edits and paragraphs allow."""
    kind = dict(candidates.dtypes)[doc]
    pairs = candidates.dropna(subset=[doc, left, right]).groupBy(doc, left).agg(F.collect_set(right).alias("may"))
    gathered = pairs.groupBy(doc).agg(F.collect_list("may").alias("edits"))

    def most(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({doc: f[doc], "matched": [largest([list(e) for e in edits]) for edits in f["edits"]]})

    return gathered.mapInPandas(most, f"{doc} {kind}, matched long")


def largest(edits: list[list]) -> int:
    """The size of a largest matching: from each edit a search in breadth for a paragraph that is free or can be freed."""
    owner: dict = {}
    for start in range(len(edits)):
        came: dict = {}
        queue, free = [start], None
        while queue and free is None:
            e = queue.pop(0)
            for p in edits[e]:
                if p not in came:
                    came[p] = e
                    if p not in owner:
                        free = p
                        break
                    queue.append(owner[p])
        while free is not None:
            e = came[free]
            before = next((p for p, o in owner.items() if o == e), None)
            owner[free] = e
            free = before if e != start else None
    return len(owner)


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_strings(values: pd.Series) -> pd.Series:
    """All strings inside JSON values, in order; keys, numbers and what is not JSON give none."""
    out = []
    for v in values:
        found, todo = [], []
        try:
            todo.append(json.loads(v) if v is not None else None)
        except (ValueError, RecursionError):
            pass
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                found.append(x)
            elif isinstance(x, dict | list):
                todo += reversed(list(x.values()) if isinstance(x, dict) else x)
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def spans_of(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """Where a pattern matches, as (start, end) in characters; none in a null text."""
    return pd.Series([[{"start": m.start(), "end": m.end()} for m in re.finditer(p, t)] if t is not None else [] for t, p in zip(texts, patterns, strict=True)])
