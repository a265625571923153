"""Tables in plain text, found by their gutters.

A page of text is a grid of letters. A gutter is a range of columns that is blank in every line of a block of lines; a block is
cut at its gutters, and what stands between them are cells. Blanks are intervals of a line, and the gutters are what all
lines' intervals have in common: counting ends of intervals from left to right gives them in one sweep, however many
lines there are. Pages without a sign of a table are not looked at, and a block that is no real table (one column, or hardly
a cell with text) is dropped, so that prose in two columns stays prose."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MARKERS = (r"signature", r"signed\s+by", r"for\s+and\s+on\s+behalf", r"in\s+witness\s+whereof", r"name\s*:", r"title\s*:", r"notice(?:s)?\s+to", r"notice(?:s)?\s+(?:shall|must|may)\s+be", r"initial\s+term", r"term\s+of\s+(?:this\s+)?agreement", r"effective\s+date", r"address\s+for\s+(?:notice|service)")
LEAST_ROWS, LEAST_COLUMNS, LEAST_CELLS = 1, 2, 2

#: Blanks side by side that may be a gutter; fewer stand between words.
GUTTER = 2
CELLS = "table_index int, row_index int, cells array<string>"


def has_marker(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(MARKERS)), F.lit(False))


def gutters(lines: list[str]) -> list[tuple[int, int]]:
    """The ranges (start, end) of columns, GUTTER or more, that are blank in all lines, between the first and the last letter. A line's
    end is blank as far as the block goes."""
    width = max(map(len, lines))
    steps = [0] * (width + 2)
    for line in lines:
        at = 0
        for m in re.finditer(r"\s+", line.rstrip()):
            if m.start() == 0 or m.end() - m.start() >= GUTTER:
                steps[m.start()] += 1
                steps[m.end()] -= 1
            at = m.end()
        end = max(at, len(line.rstrip()))
        steps[end] += 1
        steps[width] -= 1
    out, level, start = [], 0, None
    for k in range(width + 1):
        level += steps[k] if k < width else -level
        if level == len(lines) and start is None:
            start = k
        elif level < len(lines) and start is not None:
            if k - start >= GUTTER:
                out.append((start, k))
            start = None
    return [g for g in out if g[0] > 0 and g[1] < width]


def tables(text: str) -> list[list[list[str]]]:
    """The tables of a page: blocks of lines without a blank line between them, cut at their gutters. Rows without text are left
    out; blanks in a cell are one space."""
    out = []
    for block in re.split(r"\n[^\S\n]*\n", text.expandtabs(4)):
        lines = [x for x in block.split("\n") if x.strip()]
        if not lines:
            continue
        cuts = gutters(lines)
        edges = [0, *(e for _, e in cuts)], [*(s for s, _ in cuts), max(map(len, lines))]
        rows = [[" ".join(line[a:b].split()) for a, b in zip(*edges, strict=True)] for line in lines]
        if is_table(rows):
            out.append(rows)
    return out


def is_table(rows: list[list[str]]) -> bool:
    return len(rows) >= LEAST_ROWS and max(map(len, rows)) >= LEAST_COLUMNS and sum(bool(c) for r in rows for c in r) >= LEAST_CELLS


def recovered(pages: DataFrame, page: str, text: str, gate: bool = True) -> DataFrame:
    """(page, table_index, row_index, cells) of the tables on each page; from 1. gate: only pages with a marker are looked at."""
    kind = dict(pages.dtypes)[page]
    rows = pages.select(F.col(page).alias("page"), F.col(text).alias("text")).where("text is not null")
    rows = rows.where(has_marker(F.col("text"))) if gate else rows

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(p, t, r, cells) for p, x in zip(f["page"], f["text"], strict=True) for t, rows in enumerate(tables(x), 1) for r, cells in enumerate(rows, 1)]
            yield pd.DataFrame(out, columns=["page", "table_index", "row_index", "cells"])

    return rows.mapInPandas(read, f"page {kind}, {CELLS}")
