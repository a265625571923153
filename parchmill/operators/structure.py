"""Paragraphs, sections and cross-references of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.functions.text import NUMBER, any_literal, bound, continuation_is_heading, is_marked, lead_parts, leading_number, literal_marks, squeezed

# Kinds of sections and the word lists by which their parts are known.
KINDS = "clause|article|section|schedule|annex|annexure|appendix"
RECITALS = r"(?i)\b(?:whereas|recital|background|in\s+consideration\s+of)\b"
DEFINITIONS = r"(?i)\b(?:definitions?|interpretation|defined\s+terms?)\b"
SIGNATURES = (
    r"(?i)\b(?:in\s+witness\s+whereof|signed\s+by|signature|for\s+and\s+on\s+behalf|"
    r"authorised\s+signatory|authorized\s+signatory|duly\s+authori[sz]ed|executed\s+as)\b"
)
OPERATIVE = (
    r"(?i)\b(?:shall|must|will|may|can|agrees?|undertakes?|covenants?|represents?|warrants?|"
    r"is|are|was|were|has|have|means|includes?|excludes?|not|appl(?:y|ies)|"
    r"surviv(?:e|es|ed|ing)|remain(?:s|ed|ing)?)\b"
)
CONTRACT_SIGNALS = (
    r"(?i)\b(?:confidential(?:ity)?|non-?disclosure|disclos(?:e|es|ed|ure|ing)|"
    r"proprietary|recipient|discloser|receiving\s+part(?:y|ies)|disclosing\s+part(?:y|ies)|"
    r"parties|hereto|hereby|herein|hereof|thereto|thereof|hereunder|"
    r"shall|agree(?:s|d|ment)?|obligations?|undertak(?:e|es|ing|ings)|covenants?|"
    r"warrant(?:s|y|ies)?|represents?|indemnif(?:y|ies|ication)|"
    r"governing\s+law|jurisdiction|terminat(?:e|es|ion|ing)|breach(?:es|ed)?|"
    r"liabilit(?:y|ies)|whereas|in\s+witness|counterparts?|severab(?:le|ility)|"
    r"waiver|binding|in\s+writing|force\s+and\s+effect|remed(?:y|ies)|"
    r"trade\s+secrets?|intellectual\s+property)\b"
)
HEADING_WITH_BODY = r"^\s*([A-Z][A-Z0-9 &,/()'\".\-]{2,90}):\s*(.+)$"
UPPERCASE_LINE = r"^[A-Z][A-Z0-9 &,/()'\".\-]{2,110}$"
#: Words of which a text has one, in small letters, wherever the pattern fits: a search for them is far cheaper than the pattern.
SIGNATURE_WORDS = ["witness", "signed", "signatur", "behalf", "signator", "duly", "executed"]
RECITAL_WORDS = ["whereas", "recital", "background", "consideration"]
KIND_WORDS = ["clause", "article", "section", "schedule", "annex", "appendix"]
# End of the fixed values.
LEAST_SIGNALS = 2
MOST_IN_RANGE = 50
COLLAPSED_SHARE = 0.7

PARAGRAPH = "doc_id {0}, id string, index int, text string, start int, end int"
_BLANK_LINE, _GAP, _LINES = re.compile(r"\n\s*\n"), re.compile(r"\n\s*\n+"), re.compile(r"\n+")


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """Places of the paragraphs: between blank lines if there are any, else between newlines; blanks at the ends left out."""
    out, at = [], 0
    cut = _GAP if _BLANK_LINE.search(text) else _LINES
    for a, b in [*((m.start(), m.end()) for m in cut.finditer(text)), (len(text), len(text))]:
        piece = text[at:a]
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            out.append((at + lead, at + lead + len(piece.strip())))
        at = b
    return out


PARAGRAPHS = "array<struct<id: string, index: int, text: string, start: int, end: int>>"


def paragraph_lists(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: list[list[str]] | None = None) -> DataFrame:
    """(doc, paragraphs): a row a document, its paragraphs in order with their places in the text. Null texts have none. With lists
    of words, paragraphs have `marks` too: which lists have a word in it, see `literal_marks`."""
    kind, names = dict(docs.dtypes)[doc], []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, counts, pieces, starts, stops = [0], [], [], [], []
            for t in batch.column(1).to_pylist():
                spans = paragraph_spans(t) if t is not None else []
                for a, b in spans:
                    pieces.append(t[a:b])
                    starts.append(a)
                    stops.append(b)
                counts.extend(range(1, len(spans) + 1))
                ends.append(len(pieces))
                names.extend(f"p{k}" for k in range(len(names) + 1, len(spans) + 1))
            rows = [pa.array([names[k - 1] for k in counts], pa.string()), pa.array(counts, pa.int32()), pa.array(pieces, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())]
            if words:
                rows.append(pa.array(literal_marks(rows[2], words), pa.int32()))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(rows, names=["id", "index", "text", "start", "end", "marks"][: len(rows)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[doc, "paragraphs"])

    return docs.select(doc, text).mapInArrow(cut, f"{doc} {kind}, paragraphs {PARAGRAPHS.removesuffix('>>') + ', marks: int>>' if words else PARAGRAPHS}")


def opened(lists: DataFrame, listed: Column, key: str, doc: str = "doc_id") -> DataFrame:
    """The entries of a document's list as rows. An entry has its key; without `outer` Spark would ask for the size of the list
    first, and so compute it twice."""
    return lists.select(doc, F.inline_outer(listed)).where(F.col(key).isNotNull())


def paragraphs(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a paragraph with its place in the text. Null texts have none."""
    lists = paragraph_lists(docs, doc, text)
    return opened(lists.withColumnRenamed(doc, "doc_id"), F.col("paragraphs"), "id")


def aligned(pieces: DataFrame, docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Places of given paragraph texts in their source, found one after the other; a text that is not there is an error.
    `pieces` has doc, index and text; a document's paragraphs are as many as it holds."""
    gathered = pieces.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("parts")).join(docs.select(doc, F.col("text").alias("source")), doc)
    kind = dict(pieces.dtypes)[doc]

    def find(frames):
        for f in frames:
            rows = []
            for d, parts, source in zip(f[doc], f["parts"], f["source"], strict=True):
                at = 0
                for k, p in enumerate(parts, 1):
                    start = source.find(p["text"], at)
                    if start < 0:
                        raise ValueError(f"paragraph {k} of document {d} is not in its source")
                    at = start + len(p["text"])
                    rows.append((d, f"p{k}", k, p["text"], start, at))
            yield pd.DataFrame(rows, columns=["doc_id", "id", "index", "text", "start", "end"])

    return gathered.mapInPandas(find, PARAGRAPH.format(kind))


def merged_fragments(parts: DataFrame, doc: str = "doc_id", most: int = 6) -> DataFrame:
    """Paragraphs that an open sentence continues are one: (doc, first index, members, text). A run is capped, so where it
    ends depends on where it began; each document is looked at in order."""
    schema = f"{doc} {dict(parts.dtypes)[doc]}, index int, members array<int>, text string"

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        runs: list[list] = []
        for d, k, text in f.sort_values("index")[[doc, "index", "text"]].itertuples(index=False):
            is_open = runs and len(runs[-1][2]) < most and not re.search(r"[.:;!?]\s*$", runs[-1][3]) and re.match(r"\s*[a-z(]", text)
            if is_open:
                runs[-1][2].append(int(k))
                runs[-1][3] += " " + text
            else:
                runs.append([d, int(k), [int(k)], text])
        return pd.DataFrame(runs, columns=[doc, "index", "members", "text"])

    return parts.groupBy(doc).applyInPandas(merge, schema)


def reading_order(pages: DataFrame, doc: str, confidence: str, columns: str, garbled: str) -> DataFrame:
    """Per document the least page confidence (at most 0.3 if any page is garbled), the most columns, and whether that is
    degraded."""
    g = pages.groupBy(doc).agg(F.min(confidence).alias("c"), F.max(columns).alias("columns"), F.bool_or(garbled).alias("garbled"))
    score = F.when(F.col("garbled"), F.least("c", F.lit(0.3))).otherwise(F.col("c"))
    return g.select(doc, score.alias("confidence"), "columns", "garbled", (score < 0.8).alias("degraded"))


def heading(text: Column) -> Column:
    """(kind, number, heading) of a paragraph that begins a section; kind is null for body text."""
    return bound(squeezed(text), _heading)


def _heading(line: Column) -> Column:
    explicit = rf"(?is)^({KINDS})\s+({NUMBER})(?:\s*[:.\-–—]\s*|\s+|$)(.*)$"
    none = F.lit(None).cast("string")
    made = lambda k, n, h: F.struct(k.alias("kind"), n.alias("number"), F.trim(h).alias("heading"))
    nothing = made(none, none, none)
    plain = lambda x: F.when(F.contains(x, F.lit(":")) & x.rlike(HEADING_WITH_BODY), made(F.lit("heading"), none, F.regexp_extract(x, HEADING_WITH_BODY, 1))).when(x.rlike(UPPERCASE_LINE), made(F.lit("heading"), none, x)).otherwise(nothing)

    def numbered(lead: Column) -> Column:
        stated = lead["separator"].rlike(r"[:.\-–—]") & (F.length(lead["rest"]) > 0)
        titled = lead["rest"].rlike(r"^[A-Z]") & ~lead["rest"].rlike(OPERATIVE) & (F.length(lead["rest"]) <= 110) & (lead["number"].rlike(r"^\d"))
        return F.when((lead["number"] != "") & (stated | titled), made(F.lit("numbered"), F.rtrim(lead["number"], F.lit(".")), lead["rest"])).otherwise(nothing)

    # The first character says which patterns can fit at all: a kind's, a number's, or those of a line that begins with a capital.
    first = lambda low, high: (line >= low) & (line < high)
    kinds = F.substring(line, 1, 1).isin(*sorted({f(k[0]) for k in KINDS.split("|") for f in (str.lower, str.upper)}))
    return (
        F.when(kinds & line.rlike(explicit), made(F.lower(F.regexp_extract(line, explicit, 1)), F.regexp_extract(line, explicit, 2), F.regexp_extract(line, explicit, 3)))
        .when(first("0", ":") | first("(", ")"), bound(lead_parts(line), numbered))
        .when(first("A", "["), plain(line))
        .otherwise(nothing)
    )


#: What a section has. Each costs its own share: a query that names what it reads spares itself the rest.
SECTION = ("ordinal", "kind", "number", "heading", "level", "confidence", "role", "paragraphs", "body")


def outline(paras: Column, fields: tuple[str, ...] = SECTION) -> Column:
    """The sections of a document's paragraphs, given in order: the text before the first heading is a preamble, and each section
    runs to the next heading. fields: what the sections are to have, of SECTION."""
    heads = F.transform(paras, lambda p: heading(p["text"]))
    firsts = lambda hs: F.filter(F.transform(hs, lambda h, i: F.when((i == 0) | h["kind"].isNotNull(), i)), lambda i: i.isNotNull())
    members = lambda at, a, j: F.transform(F.sequence(a, F.coalesce(F.get(at, j + 1), F.size(paras)) - 1), lambda i: F.get(paras, i))
    before = lambda hs: F.when(F.get(hs, F.lit(0))["kind"].isNull(), 0).otherwise(1)
    cut = lambda hs, at, first: F.transform(at, lambda a, j: bound(F.get(hs, a), lambda h: _section(h, members(at, a, j), (j + first).cast("long"), fields)))
    return bound(heads, lambda hs: bound(firsts(hs), lambda at: bound(before(hs), lambda first: cut(hs, at, first))))


def _section(h: Column, members: Column, ordinal: Column, fields: tuple[str, ...]) -> Column:
    kind, head = F.coalesce(h["kind"], F.lit("preamble")), F.coalesce(h["heading"], F.lit(""))
    whole = F.array_join(F.transform(members, lambda p: p["text"]), "\n")

    def made(body: Column) -> Column:
        level = F.when(h["number"].isNull(), 1).otherwise(F.size(F.regexp_extract_all(h["number"], F.lit(r"[^.()]+"), F.lit(0))))
        values = {
            "ordinal": ordinal, "kind": kind, "number": h["number"], "heading": head, "level": level, "confidence": F.when(kind.isin("preamble", "heading"), "medium").otherwise("high"),
            "role": role(kind, h["number"], head, body), "paragraphs": F.transform(members, lambda p: p["index"]), "body": body,
        }
        return F.struct(*[values[f].alias(f) for f in fields])

    return bound(whole, made) if {"role", "body"} & set(fields) else made(whole)


def outlines(docs: DataFrame, doc: str = "doc_id", text: str = "text", fields: tuple[str, ...] = SECTION, words: list[list[str]] | None = None) -> DataFrame:
    """(doc, paragraphs, sections): a row a document. What a document says of itself is found within its row, without a shuffle."""
    return paragraph_lists(docs, doc, text, words).withColumn("sections", outline(F.col("paragraphs"), fields))


def sections(parts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sections with their paragraphs, of given paragraphs (doc, index, text); see `outline`."""
    g = parts.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("_p"))  # one document's paragraphs
    return opened(g, outline(F.col("_p")), "ordinal", doc)


def _sections_of(secs: DataFrame, doc: str) -> DataFrame:
    return secs.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("ordinal", "kind", "number"))).alias("_s"))  # one document's sections


def role(kind: Column, number: Column, head: Column, body: Column) -> Column:
    """A label for reviewers, the first that holds; `body` is the whole section, its heading included."""
    low = F.lower(body)
    signed, recital = any_literal(low, SIGNATURE_WORDS) & body.rlike(SIGNATURES), any_literal(low, RECITAL_WORDS) & body.rlike(RECITALS)
    return F.when(signed, "signature").when(head.rlike(DEFINITIONS), "definitions").when((kind == "preamble") | recital, "recital").when(number.isNotNull() & body.rlike(OPERATIVE), "operative").otherwise("body")


def ancestors(number: Column) -> Column:
    """Numbers of the possible parents, the nearest first: "3.1(a)" has "3.1" and "3"."""
    ends = F.size(F.regexp_extract_all(number, F.lit(r"\([A-Za-z0-9]+\)|[^.()]+"), F.lit(0)))
    prefix = lambda k: F.regexp_replace(F.regexp_extract(number, r"^((?:\.?(?:\([A-Za-z0-9]+\)|[^.()]+)){" + str(k) + "})", 1), r"\.$", "")
    return bound(ends, lambda n: F.filter(F.array(*[F.when(n > k, prefix(k)) for k in (5, 4, 3, 2, 1)]), lambda x: x.isNotNull() & (x != "")))


def parent_list(secs: Column) -> Column:
    """(ordinal, parent) of a document's sections: the latest earlier section that bears the nearest ancestor's number; null if none
    does."""
    bearer = lambda s, number: F.array_max(F.transform(F.filter(secs, lambda b: (b["number"] == number) & (b["ordinal"] < s["ordinal"])), lambda b: b["ordinal"]))
    nearest = lambda s: F.get(F.filter(F.transform(ancestors(s["number"]), lambda n: bearer(s, n)), lambda p: p.isNotNull()), F.lit(0))
    return F.transform(secs, lambda s: F.struct(s["ordinal"].alias("ordinal"), F.when(s["number"].isNotNull(), nearest(s)).alias("parent")))


def parents(secs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, ordinal, parent), see `parent_list`."""
    return opened(_sections_of(secs, doc), parent_list(F.col("_s")), "ordinal", doc)


def alias_list(secs: Column) -> Column:
    """(alias, ordinal, ambiguous): the names by which a document's sections are cited. A name that more than one section claims is
    ambiguous and has no section."""
    claim = lambda kind, number, s: F.struct(F.concat(kind, F.lit(":"), number).alias("alias"), s["ordinal"].alias("ordinal"))
    claims = lambda s: bound(F.lower(s["number"]), lambda n: F.array(claim(F.lit("number"), n, s), claim(F.when(s["kind"] != "numbered", s["kind"]).otherwise("section"), n, s)))
    every = F.sort_array(F.array_distinct(F.flatten(F.transform(F.filter(secs, lambda s: s["number"].isNotNull()), claims))))
    # In this order the claims to a name stand side by side: the first one speaks for it, and a second makes it ambiguous.
    same = lambda c, x, i: F.coalesce(F.get(c, i)["alias"] == x["alias"], F.lit(False))
    named = lambda x, again: F.struct(x["alias"].alias("alias"), F.when(~again, x["ordinal"]).alias("ordinal"), again.alias("ambiguous"))
    once = lambda c: F.transform(c, lambda x, i: F.when(~same(c, x, i - 1), bound(same(c, x, i + 1), lambda again: named(x, again))))
    return F.filter(bound(every, once), lambda n: n.isNotNull())


def aliases(secs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, alias, ordinal, ambiguous), see `alias_list`."""
    return opened(_sections_of(secs, doc), alias_list(F.col("_s")), "alias", doc)


def demoted(secs: DataFrame, doc: str = "doc_id", from_pdf: Column | None = None) -> DataFrame:
    """secs with the confidence of numbered and heading sections lowered in PDF documents whose text hardly speaks like a
    contract."""
    signals = secs.groupBy(doc).agg(F.sum(F.regexp_count("body", F.lit(CONTRACT_SIGNALS))).alias("_signals"))
    low = (from_pdf if from_pdf is not None else F.lit(True)) & (F.col("_signals") < LEAST_SIGNALS) & F.col("kind").isin("numbered", "heading")
    return secs.join(signals, doc).withColumn("confidence", F.when(low, "low").otherwise(F.col("confidence"))).drop("_signals")


def demoted_list(secs: Column) -> Column:
    """The sections of one PDF document as `demoted` leaves them; the signals are counted until there are enough of them."""
    signals = F.aggregate(secs, F.lit(0), lambda n, s: F.when(n >= LEAST_SIGNALS, n).otherwise(n + F.regexp_count(s["body"], F.lit(CONTRACT_SIGNALS))))
    lowered = lambda n: F.transform(secs, lambda s: s.withField("confidence", F.when((n < LEAST_SIGNALS) & s["kind"].isin("numbered", "heading"), "low").otherwise(s["confidence"])))
    return bound(signals, lowered)


CITED = rf"(?i)\b(?:{KINDS})s?\s+(?:{NUMBER})(?:\s*(?:,|and|or|to|-|–|&)\s*\d[\w.()]*)*"


def citations(text: Column, may: Column | None = None) -> Column:
    """(kind, number, opening): every section that a paragraph cites, each once; "4 and 6-8" gives 4, 6, 7 and 8, a range at most
    MOST_IN_RANGE numbers. opening: only the paragraph's first words cite it, as headings do. may: whether one of KIND_WORDS
    stands in the text, where that is known."""
    none = F.array().cast("array<struct<kind: string, number: string, opening: boolean>>")
    several = lambda rest: F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(rf"(?i)\d+\s*(?:-|–|to)\s*\d+|(?<![A-Za-z0-9])(?!and\b|or\b|to\b){NUMBER}(?![A-Za-z])"), F.lit(0)), _numbers))
    # A single plain number, as most citations have, is itself.
    numbers = lambda cited: bound(F.regexp_replace(cited, rf"(?i)^(?:{KINDS})s?\s+", ""), lambda rest: F.when(rest.rlike(r"^\d+\z"), F.array(rest)).otherwise(several(rest)))
    one = lambda cited, opening: bound(F.lower(F.regexp_extract(cited, rf"(?i)^({KINDS})", 1)), lambda kind: F.transform(numbers(cited), lambda n: F.struct(kind.alias("kind"), n.alias("number"), opening.alias("opening"))))
    same = lambda every, x: F.filter(every, lambda y: (y["kind"] == x["kind"]) & (y["number"] == x["number"]))
    once = lambda every: F.transform(F.array_distinct(F.transform(every, lambda x: F.struct(x["kind"].alias("kind"), x["number"].alias("number")))), lambda x: F.struct(x["kind"].alias("kind"), x["number"].alias("number"), F.forall(same(every, x), lambda y: y["opening"]).alias("opening")))
    starts = text.rlike(rf"^(?:{CITED})")
    found = F.regexp_extract_all(text, F.lit(CITED), F.lit(0))
    every = F.flatten(F.transform(found, lambda cited, at: one(cited, (at == 0) & starts)))
    gathered = bound(every, lambda e: F.when(F.size(e) < 2, e).otherwise(once(e)))
    return F.when(any_literal(F.lower(text), KIND_WORDS) if may is None else may, gathered).otherwise(none)


def _numbers(item: Column) -> Column:
    low, high = F.regexp_extract(item, r"(?i)^(\d+)\s*(?:-|–|to)\s*\d+$", 1), F.regexp_extract(item, r"(?i)^\d+\s*(?:-|–|to)\s*(\d+)$", 1)
    lo, hi = low.try_cast("bigint"), high.try_cast("bigint")
    return F.when((low != "") & (hi >= lo), F.transform(F.sequence(lo, F.least(hi, lo + (MOST_IN_RANGE - 1))), lambda x: x.cast("string"))).otherwise(F.array(F.regexp_replace(item, r"[.,]+$", "")))


def references(parts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, paragraph, kind, number, opening): what each paragraph cites, see `citations`."""
    return parts.select(doc, F.col("id").alias("paragraph"), F.inline_outer(citations(F.col("text")))).where("kind is not null")


def reference_list(paras: Column, mark: int | None = None) -> Column:
    """(paragraph, index, kind, number, opening) of a document's paragraphs; mark: the one of KIND_WORDS, if they have marks."""
    cites = lambda p: citations(p["text"], None if mark is None else is_marked(p["marks"], mark))
    return F.flatten(F.transform(paras, lambda p: F.transform(cites(p), lambda c: F.struct(p["id"].alias("paragraph"), p["index"].alias("index"), c["kind"].alias("kind"), c["number"].alias("number"), c["opening"].alias("opening")))))


def resolution(ref: Column, names: Column) -> Column:
    """(ordinal, ambiguous) of a citation among a document's names: by kind and number, else by number alone where the kind cites
    the body."""
    named = lambda prefix: bound(F.concat(prefix, F.lit(":"), F.lower(ref["number"])), lambda key: F.get(F.filter(names, lambda n: n["alias"] == key), F.lit(0)))
    body = ref["kind"].isin("section", "clause", "article")
    hit = bound(named(ref["kind"]), lambda a: F.when(a.isNull() & body, named(F.lit("number"))).otherwise(a))
    return bound(hit, lambda h: F.struct(h["ordinal"].alias("ordinal"), F.coalesce(h["ambiguous"], F.lit(False)).alias("ambiguous")))


def resolved(refs: DataFrame, names: DataFrame, doc: str = "doc_id") -> DataFrame:
    """refs with the cited section, see `resolution`."""
    known = names.groupBy(doc).agg(F.collect_list(F.struct("alias", "ordinal", "ambiguous")).alias("_n"))  # one document's names
    found = refs.join(known, doc, "left").withColumn("_f", resolution(F.struct("kind", "number"), F.coalesce("_n", F.array().cast(known.schema["_n"].dataType))))
    return found.select(doc, "paragraph", "kind", "number", "opening", "_f.ordinal", "_f.ambiguous")


def resolved_list(paras: Column, secs: Column, mark: int | None = None) -> Column:
    """A document's citations with the cited section: (paragraph, kind, number, opening, ordinal, ambiguous, own). own: the citation
    is the heading that opens that very section. mark: as in `reference_list`."""
    own = lambda of, r, f: r["opening"] & F.exists(of, lambda s: (s["ordinal"] == f["ordinal"]) & F.array_contains(s["paragraphs"], r["index"]))
    row = lambda of, r, f: F.struct(*[r[c].alias(c) for c in ("paragraph", "kind", "number", "opening")], f["ordinal"].alias("ordinal"), f["ambiguous"].alias("ambiguous"), own(of, r, f).alias("own"))
    every = lambda of, refs, names: F.transform(refs, lambda r: bound(resolution(r, names), lambda f: row(of, r, f)))
    return bound(secs, lambda of: bound(reference_list(paras, mark), lambda refs: bound(alias_list(of), lambda names: every(of, refs, names))))


def without_own_headings(refs: DataFrame, secs: DataFrame, parts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Resolved references without the headings that name the very section they open."""
    owners = secs.select(doc, F.col("ordinal").alias("_own"), F.explode("paragraphs").alias("index")).join(parts.select(doc, "index", F.col("id").alias("paragraph")), [doc, "index"])
    return refs.join(owners.select(doc, "paragraph", "_own"), [doc, "paragraph"], "left").where("not (opening and ordinal <=> _own)").drop("_own", "opening")


def reference_status(refs: DataFrame, doc: str = "doc_id") -> DataFrame:
    g = refs.groupBy(doc, "paragraph", "kind").agg(F.count("*").alias("items"), F.count("ordinal").alias("found"))
    return g.select(doc, "paragraph", "kind", F.when(F.col("found") == F.col("items"), "resolved").when(F.col("found") > 0, "partial").otherwise("unresolved").alias("status"))


def dangling(refs: DataFrame, secs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document how many citations lead nowhere and how many are ambiguous (which is unknown, not a defect). No signal
    where the structure collapsed: one section, or one that owns most paragraphs."""
    shape = secs.groupBy(doc).agg(F.count("*").alias("n"), F.max(F.size("paragraphs")).alias("top"), F.sum(F.size("paragraphs")).alias("all"))
    fine = shape.where((F.col("n") > 1) & (F.col("top") <= COLLAPSED_SHARE * F.col("all"))).select(doc)
    return refs.join(fine, doc, "left_semi").groupBy(doc).agg(F.count_if(F.col("ordinal").isNull() & ~F.col("ambiguous")).alias("dangling"), F.count_if("ambiguous").alias("ambiguous"))


def dangling_of(refs: Column, secs: Column) -> Column:
    """(dangling, ambiguous) of one document's resolved citations as `dangling` counts them; null where the structure collapsed or
    nothing is cited."""
    sizes = F.transform(secs, lambda s: F.size(s["paragraphs"]))
    fine = bound(sizes, lambda n: (F.size(n) > 1) & (F.array_max(n) <= COLLAPSED_SHARE * F.aggregate(n, F.lit(0), lambda a, b: a + b)))
    count = lambda test: F.size(F.filter(refs, test)).cast("long")
    return F.when((F.size(refs) > 0) & fine, F.struct(count(lambda r: r["ordinal"].isNull() & ~r["ambiguous"]).alias("dangling"), count(lambda r: r["ambiguous"]).alias("ambiguous")))


def localised(secs: DataFrame, cues: DataFrame, doc: str = "doc_id", most: int = 3) -> DataFrame:
    """(doc, clause, ordinal): sections whose heading holds a cue of a clause, the first few of each. Cues are a rule table."""
    hit = secs.join(F.broadcast(cues), F.contains(F.lower("heading"), F.col("cue"))).select(doc, "clause", "ordinal").distinct()
    return hit.withColumn("_r", F.row_number().over(Window.partitionBy(doc, "clause").orderBy("ordinal"))).where(F.col("_r") <= most).drop("_r")


def localised_list(secs: Column, cues: dict[str, list[str]], most: int = 3) -> Column:
    """(clause, ordinal) of one document's sections, given in order, as `localised` finds them; cues: those of each clause."""
    low = F.transform(secs, lambda s: F.struct(F.lower(s["heading"]).alias("heading"), s["ordinal"].alias("ordinal")))
    first = lambda of, words: F.slice(F.filter(of, lambda s: any_literal(s["heading"], words)), 1, most)
    named = lambda hits, clause: F.transform(hits, lambda s: F.struct(F.lit(clause).alias("clause"), s["ordinal"].alias("ordinal")))
    return bound(low, lambda of: F.concat(*[named(first(of, words), clause) for clause, words in cues.items()]))


def continued(parts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Whether each line is a heading, given the number of the line before it."""
    w = Window.partitionBy(doc).orderBy("index")
    return parts.withColumn("is_heading", continuation_is_heading(F.col("text"), F.lag(leading_number(F.col("text"))["number"]).over(w)))

