"""Main text of web pages by tag-path ratios.

Every text block has a root-to-leaf tag path. Per path a page's text length, punctuation and number of blocks are
added up; length and punctuation per block are the path's two ratios. They are fused into one figure a path, smoothed over
the paths of the same container (a headline borrows from its paragraphs), and the paths whose figure reaches a share of
the page's best are content. Links weigh nothing. A class or id made of words such as "ad" or "comments" lowers the figure of
the paths below it a great deal, one that only holds such a word ("related-work", or an article that is a "story" too) a little;
neither decides alone. Only what HTML itself marks as something else (nav, footer, aside, scripts, hidden parts, such roles)
never competes, nor does a form, unless it holds more than half of the page's text: such a form wraps the page.

Paths are nodes of a tree that is built as the page is read, so a page costs time in proportion to its length however
deep its elements nest.

Defined results: null or empty html gives empty text; unclosed, cut-off and wrongly nested markup is read as far as
it goes; pages of any length are read whole; repeated rows give repeated results; of paths with equal figures all are kept; a
column of the output's name is replaced, others are kept whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.session import read_table

#: HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title button select textarea datalist".split())
CONTAINERS = frozenset("html body article main section div td center".split())
#: Parts that are not the article, whatever they hold.
ASIDE_TAGS = frozenset("nav footer aside menu dialog".split())
ASIDE_WORD = re.compile(
    r"ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|menu|navbar|nav|navigation|breadcrumbs?|pagination|pager|sidebar|side|aside|widget|footer|masthead|siteheader|topbar|comments?|commentlist|discussion|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|toolbar|skip|hidden",
    re.IGNORECASE,
)
#: Words of class names that say nothing about the matter.
NEUTRAL_WORD = re.compile(r"box|block|bar|list|container|wrapper|wrap|section|area|top|bottom|left|right|links?|items?|inner|outer|site|page|header|unit|slot|form|\d*", re.IGNORECASE)
#: Words by which an article says that it is one, whatever else it is called.
CONTENT_WORD = re.compile(r"post|story|entry|hentry|article|content|body|text|news|blog|main|single", re.IGNORECASE)
#: What a name made of such words, and what one that only holds one, leaves of the figures below it.
ASIDE_WEIGHT, HINT_WEIGHT = 0.01, 0.5
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
SPACE = re.compile(r"\s+")
#: The weight that an element named for content lends to the ratios below it.
CONTENT_WEIGHT = {"article": 4.0, "main": 4.0}
#: Paths of at least this share of the best figure are content; what a path borrows from its container's best.
SHARE, BORROWED = 0.1, 0.3
LISTS = frozenset("ul ol menu dl table select".split())
#: An open element of the second kind ends where one of the first begins.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def name_weight(named: str) -> float:
    """What the words of an element's class and id leave of the figures below it."""
    weight = 1.0
    for token in named.split():
        words = [w for w in re.split(r"[_-]+", token) if w]
        if len(words) > 1 and words[0].lower() in ("has", "with", "no", "without"):
            continue
        aside = [bool(ASIDE_WORD.fullmatch(w)) for w in words]
        if any(aside):
            weight = min(weight, ASIDE_WEIGHT if all(a or NEUTRAL_WORD.fullmatch(w) for a, w in zip(aside, words, strict=True)) else HINT_WEIGHT)
    return weight


def article_weight(named: str) -> float:
    """The same for an article: a reader's comment is one too, but one with a name of its own is lowered a little at most."""
    owned = any(all(CONTENT_WORD.fullmatch(w) or NEUTRAL_WORD.fullmatch(w) for w in re.split(r"[_-]+", token) if w) and CONTENT_WORD.search(token) for token in named.split())
    weight = name_weight(named)
    return max(weight, HINT_WEIGHT) if owned else weight


class Path:
    """A root-to-leaf tag path: what its steps say of it, and the figures of its blocks."""

    __slots__ = ("below", "container", "content", "count", "length", "linked", "marks", "weight")

    def __init__(self, above: Path | None = None, tag: str = "", named: str = ""):
        self.below: dict[tuple[str, str], Path] = {}
        content = CONTENT_WEIGHT.get(tag, 1.0)
        self.content = max(above.content, content) if above else content
        plain = tag in ("html", "body", "main") or not named
        self.weight = (above.weight if above else 1.0) * (1.0 if plain else article_weight(named) if tag == "article" else name_weight(named))
        opens = content > 1 or (tag in CONTAINERS and not (above and above.content > 1))
        self.container: Path = self if opens or above is None else above.container
        self.count = self.length = self.marks = self.linked = 0

    def step(self, tag: str, named: str) -> Path:
        found = self.below.get((tag, named))
        if found is None:
            found = self.below[tag, named] = Path(self, tag, named)
        return found

    def fused(self) -> float:
        return self.content * (self.length / self.count) * (1 + self.marks / self.count) * self.count**0.5


class Blocks(HTMLParser):
    """Text blocks in page order: (path, text, letters of it inside links, number of the form around it or 0). Blocks of set-aside
    parts are not kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Path, bool, int]] = []  # tag, path, set aside, form
        self.forms = self.form = 0
        self.count: Counter[str] = Counter()
        self.root = Path()
        self.blocks: list[tuple[Path, str, int, int]] = []
        self.text: list[str] = []
        self.linked = 0
        self.at: Path | None = None

    def flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text and self.at is not None:
                self.blocks.append((self.at, text, self.linked, self.form))
            self.text, self.linked, self.at = [], 0, None

    def _close_to(self, k: int) -> None:
        ends = [x[0] for x in self.open[k:]]
        if any(t in BLOCKS for t in ends):
            self.flush()
        self.count.subtract(ends)
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self._imply(tag)
        elif tag == "br":
            self.text.append(" ") if self.text else None
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        above, off, form = self.open[-1][1:] if self.open else (self.root, False, 0)
        if (tag == "form" or given.get("role", "").lower() == "form") and not form:
            self.forms += 1
            form = self.forms
        named = f"{given.get('class', '')} {given.get('id', '')}".strip()
        off = (
            off
            or tag in ASIDE_TAGS
            or tag in SILENT
            or (tag == "header" and above.content == 1)
            or "hidden" in given
            or given.get("aria-hidden") == "true"
            or given.get("role", "").lower() in ASIDE_ROLES
        )
        self.count[tag] += 1
        self.open.append((tag, above if off else above.step(tag, named), off, form))

    def _imply(self, tag: str) -> None:
        ended = ENDED_BY.get(tag, ("p",))
        if not any(self.count[t] for t in ended):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ended:
                self._close_to(k)
                break
            if self.open[k][0] in (LISTS if tag in ENDED_BY else BLOCKS):
                break

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close_to(k)
                return
            if self.open[k][0] in ("body", "html") and tag not in ("body", "html"):
                return

    def handle_data(self, data):
        if self.open and self.open[-1][2]:
            return
        if self.at is None:
            if not data.strip():
                return
            self.at, self.form = (self.open[-1][1], self.open[-1][3]) if self.open else (self.root, 0)
        self.text.append(data)
        if self.count["a"]:
            self.linked += len(data.strip())


def outside_forms(blocks: list[tuple[Path, str, int, int]]) -> list[tuple[Path, str, int]]:
    """The blocks that are in no form, or in one that holds more than half of the page's text."""
    letters: Counter[int] = Counter()
    for _, text, _, form in blocks:
        letters[form] += len(text)
    whole = sum(letters.values())
    return [(path, text, linked) for path, text, linked, form in blocks if not form or 2 * letters[form] > whole]


def content_paths(blocks: list[tuple[Path, str, int]]) -> set[Path]:
    """The paths whose smoothed, fused figure reaches the threshold. A path of links borrows only inside a part that is named
    for content."""
    paths: dict[Path, None] = {}
    for path, text, linked in blocks:
        paths[path] = None
        path.length += max(0, len(text) - linked)
        path.marks += len(PUNCTUATION.findall(text)) if 2 * linked <= len(text) else 0
        path.linked += linked
        path.count += 1
    best: dict[Path, float] = defaultdict(float)
    for p in paths:
        best[p.container] = max(best[p.container], p.weight * p.fused())
    smooth = {p: p.weight * (p.fused() + (BORROWED * best[p.container] if p.content > 1 or p.length >= p.linked else 0)) for p in paths}
    top = max(smooth.values(), default=0.0)
    return {p for p, x in smooth.items() if x >= SHARE * top} if top > 0 else set(paths)


def main_text(html: str | None) -> str:
    """The content blocks in page order, joined by newlines."""
    if not html:
        return ""
    cut = html.rfind("<")
    if cut > html.rfind(">") and html[cut + 1 : cut + 2].isalpha() | (html[cut + 1 : cut + 2] in ("/", "!")):
        html = html[:cut]  # a tag that the page's end cuts off
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = outside_forms(parser.blocks)
    keep = content_paths(blocks)
    return "\n".join(text for path, text, _ in blocks if path in keep)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of `html` in place of it, as the last column."""
    kept = [k for k, c in enumerate(pages.columns) if c not in (html, out)]
    at = pages.columns.index(html)
    schema = T.StructType([*(pages.schema.fields[k] for k in kept), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(map(main_text, b.column(at).to_pylist()), pa.string())], names=[*(b.schema.names[n] for n in kept), out])

    return pages.mapInArrow(run, schema)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
