"""The text of HTML mails: a tokeniser with a stack of what is skipped. Scripts and styles give nothing, closed or not; what is left
is one line, its pieces joined by a blank. References that were escaped twice are opened twice."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SKIPPED = {"script", "style"}

_BLOCK = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.IGNORECASE | re.DOTALL)


class _Pieces(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipping: list[str] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SKIPPED:
            self.skipping.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skipping:
            self.skipping.pop()

    def handle_data(self, data: str) -> None:
        if not self.skipping and data.strip():
            self.pieces.append(data.strip())


def mail_text(html: str) -> str:
    """The pieces of text between a mail's tags."""
    reader = _Pieces()
    reader.feed(_BLOCK.sub(" ", html))
    reader.close()
    return unescape(" ".join(reader.pieces))


@F.pandas_udf(T.StringType())
def mail_texts(html: pd.Series) -> pd.Series:
    """`mail_text` of each row; null stays null."""
    return html.map(lambda x: None if x is None else mail_text(x))
