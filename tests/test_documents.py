"""Redlines, rule checks, tables in text and mail texts against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from parchmill.functions.mail import mail_text, mail_texts
from parchmill.operators import comparison, grids, lint, redlines

RESULT = "doc int, clause string, order int, issue string, action string, wording string, matched array<int>, anchor int"


def test_edits_of_clauses(spark):
    wrong = "present_but_wrong"
    rows = [
        (1, "term", 1, wrong, redlines.REPLACE, " five ", [3, 2, 2, None], None),
        (1, "gone", 2, wrong, redlines.DELETE, None, [3, 4], None),
        (1, "law", 3, "missing", redlines.INSERT, "law", None, 2),
        (1, "end", 4, "missing", redlines.INSERT, "end", None, None),
        (1, "more", 5, "missing", redlines.INSERT, "more", None, 2),
        (1, "blank", 6, wrong, redlines.REPLACE, "  ", [1], None),
        (1, "fine", 7, "none", redlines.DELETE, None, [1], None),
        (1, "odd", 8, wrong, "no_change", "x", [1], None),
        (2, "none", 1, wrong, redlines.DELETE, None, None, None),
        (2, "null", 2, None, redlines.DELETE, None, [1], None),
    ]
    edits = redlines.generated(spark.createDataFrame(rows, RESULT))
    got = sorted((r.doc, r.number, r.clause, r.paragraph, r.action[:3], r.text, r.standing) for r in edits.collect())
    assert got == [(1, 1, "term", 2, "rep", "five", True), (1, 2, "term", 3, "del", None, True), (1, 3, "gone", 3, "del", None, False), (1, 4, "gone", 4, "del", None, True), (1, 5, "law", 2, "ins", "law", True), (1, 6, "end", -1, "ins", "end", True), (1, 7, "more", 2, "ins", "more", True)]
    paragraphs = spark.createDataFrame([(d, k, f"p{k}") for d in (1, 2) for k in range(1, 6)], "doc int, position int, text string")
    after = {d: [r.text for r in sorted(rs, key=lambda r: (r.position, r.part))] for d, rs in group(redlines.redlined(paragraphs, edits).collect()).items()}
    assert after == {1: ["p1", "five", "law", "more", "p5", "end"], 2: ["p1", "p2", "p3", "p4", "p5"]}


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc, []).append(r)
    return out


def fits(chosen):
    spans = sorted(chosen)
    return all(a[1] <= b[0] and a[:2] != b[:2] for a, b in itertools.pairwise(spans))


def test_spans_do_not_overlap_and_are_as_many_as_can_be(spark):
    r = random.Random(3)
    cases = []
    for _ in range(120):
        text = "".join(r.choice("abc é") for _ in range(r.randint(0, 14)))
        cases.append((text, [(s, s + r.choice([-1, 0, 1, 1, 2, 3, 5]), r.choice(["", "X", "long", None])) for s in (r.randint(-1, 12) for _ in range(r.randint(0, 7)))]))
    df = spark.createDataFrame(cases, "text string, edits array<struct<start: int, end: int, text: string>>")
    kept = df.withColumn("kept", redlines.standing_spans(F.col("edits")))
    for row in kept.select("*", redlines.shifted_starts(F.col("kept")).alias("at"), redlines.with_spans(F.col("text"), F.col("kept")).alias("new")).collect():
        stand = [(e.start, e.end, e.text) for e in row.kept]
        able = [(e.start, e.end) for e in row.edits if 0 <= e.start <= e.end]
        assert stand == sorted(stand, key=lambda e: (e[1], e[0])) and fits([e[:2] for e in stand])
        most = max(n for n in range(len(set(able)) + 1) if n == 0 or any(fits(c) for c in itertools.combinations(sorted(set(able)), n)))
        assert len(stand) == most
        out, at, places = "", 0, []
        for start, end, text in stand:
            out += row.text[at:start]
            places.append(len(out))
            out += text or ""
            at = end
        assert row.new == out + row.text[at:]
        if all(e[1] <= len(row.text) for e in stand):
            assert row.at == places


def test_spans_of(spark):
    df = spark.createDataFrame([("ab 12 é3",), (None,), ("",)], "t string")
    got = [[(s.start, s.end) for s in r.s] for r in df.select(comparison.spans_of("t", F.lit("[0-9]+")).alias("s")).collect()]
    assert got == [[(3, 5), (7, 8)], [], []]


CLAUSE = "book int, clause string, engine string, search_terms array<string>, template string, fallback_wording string, option_source string, template_field string, template_value string, preferred string, prose string"
CONDITION = "book int, clause string, field string, position int, id string, decision string, issue_type string, description string, redline_action string"
OPTION = "book int, clause string, id string, value string, aliases array<string>"
GOOD = (["term"], "t", "", "", "", "", "", "")


def checked(spark, clauses, conditions=None, options=()):
    if conditions is None:
        conditions = [(b, c, "pass_conditions", 1, "p", "pass", "none", "state", "no_change") for b, c, *_ in clauses] + [(b, c, "fail_conditions", 2, "f", "fail", "missing", "other", "no_change") for b, c, *_ in clauses]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((clauses, CLAUSE), (conditions, CONDITION), (list(options), OPTION))]
    return sorted((r.book, r.clause, r.check, r.detail) for r in lint.violations(*frames, ["law", "signatures"]).collect())


def test_a_good_book_has_no_violations(spark):
    assert checked(spark, [(1, "a", "native", *GOOD), (1, "Law", "native", *GOOD), (1, "signatures", None, *GOOD)]) == []
    assert checked(spark, []) == []


def test_clauses(spark):
    rows = [(1, "a", "x", ["​", "", None], "", "", "", "f", " ", "", "Choose an approved law."), (1, " A", "x", None, *GOOD[1:]), (2, "LAW", " Dynamic ", *GOOD), (3, "law", "native", *GOOD), (4, "b", "x", ["t"], "", "", "approved_options", "", "", "L", "")]
    got = checked(spark, rows)
    assert got == [
        (1, " A", "clause_id_uniqueness", "id used again: a"), (1, " A", "trigger_terms_present", "no term that prints"), (1, "a", "approved_options_present", "prose without options"), (1, "a", "referential_integrity", "no field f"), (1, "a", "trigger_terms_present", "no term that prints"),
        (2, "LAW", "native_clause_inventory", "has a check of its own"), (3, "signatures", "native_clause_inventory", "missing"), (4, "b", "approved_options_present", "source without options"), (4, "b", "referential_integrity", "no options for approved_options"),
    ]


def test_conditions(spark):
    rows = [
        (1, "a", "pass_conditions", 1, "x", "fail", "none", "The state.", "no_change"),
        (1, "a", "fail_conditions", 2, "X ", "maybe", "odd", "  the  STATE", "replace_paragraph"),
        (1, "a", "review_triggers", 3, None, None, "", None, "burn"),
    ]
    got = checked(spark, [(1, "a", "x", ["t"], "", "", "", "", "", "", ""), (1, "bare", "x", *GOOD)], rows)
    assert [(c, k, d) for _, c, k, d in got] == [
        ("a", "condition_contradiction", "passes and is flagged: the state"),
        *[("a", "condition_well_formed", d) for d in ("<review_triggers entry>: no decision", "<review_triggers entry>: no description", "<review_triggers entry>: no id", "<review_triggers entry>: no issue_type", "<review_triggers entry>: unknown redline_action burn", "X: unknown decision maybe", "X: unknown issue_type odd", "id used again: x", "x: decision fail in pass_conditions")],
        ("a", "redline_template_present", "X: nothing to build replace_paragraph"),
        ("bare", "decision_space_coverage", "never flagged"),
        ("bare", "decision_space_coverage", "never passes"),
    ]


def test_options(spark):
    options = [(1, "a", "1", "England & Wales", ["English law", "common"]), (1, "a", "2", "england-wales", None), (1, "a", "1", "Scotland", ["Common."]), (1, "a", "3", " ", ["common"]), (1, "a", "4", "Scotland", None)]
    got = checked(spark, [(1, "a", "x", ["t"], "", "", "s", "", "", "Wales", "")], options=options)
    assert [(k, d) for _, _, k, d in got] == [("law_alias_collision", "shared: common"), ("option_id_collision", "id of several values: 1"), ("option_id_collision", "values give one id: england_wales"), ("referential_integrity", "not approved: Wales")]


def plain_gutters(lines):
    width = max(map(len, lines))
    wide = [line.rstrip().ljust(width) for line in lines]
    solid = []
    for line in wide:
        marks, k = [c != " " for c in line], 0
        for blank, run in itertools.groupby(line, lambda c: c == " "):
            n = len(list(run))
            if blank and n < grids.GUTTER and k > 0 and k + n < len(line.rstrip()):
                marks[k : k + n] = [True] * n
            k += n
        solid.append(marks)
    free = [not any(m[k] for m in solid) for k in range(width)]
    out, k = [], 0
    for clear, run in itertools.groupby(free):
        n = len(list(run))
        if clear and n >= grids.GUTTER and k > 0 and k + n < width:
            out.append((k, k + n))
        k += n
    return out


def test_gutters():
    r = random.Random(5)
    for _ in range(500):
        lines = ["".join(r.choice("ab    ") for _ in range(r.randint(1, 18))) for _ in range(r.randint(1, 4))]
        lines = [x for x in lines if x.strip()] or ["x"]
        assert grids.gutters(lines) == plain_gutters(lines), lines


def test_tables(spark):
    page = "Signature block\n\nName:   Ann Lee      Name:   Bo\nTitle:               Title:  Head  \n\nplain prose in one line\n  \nonly one\n\na\tb\nc\td"
    assert grids.tables(page) == [[["Name:", "Ann Lee", "Name:", "Bo"], ["Title:", "", "Title:", "Head"]], [["a", "b"], ["c", "d"]]]
    df = spark.createDataFrame([(1, page), (2, "two    columns\nof     prose"), (3, None), (4, ""), (5, "NOTICES TO   x\n\n \n")], "k int, t string")
    got = sorted((r.page, r.table_index, r.row_index, r.cells) for r in grids.recovered(df, "k", "t").collect())
    assert [g[:3] for g in got] == [(1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2), (5, 1, 1)] and got[-1][3] == ["NOTICES TO", "x"]
    assert {r.page for r in grids.recovered(df, "k", "t", gate=False).collect()} == {1, 2, 5}


def plain_text(html):
    """Letter by letter, for pages without comments and with quoted attributes only."""
    import html as h

    out, piece, k, skip = [], "", 0, None
    while k < len(html):
        if html[k] == "<":
            end = html.index(">", k)
            name = html[k + 1 : end].strip("/").split(" ")[0].lower()
            if name in ("script", "style"):  # a blank takes the place of what is skipped
                piece += " " if skip is None else ""
                skip = name if html[k + 1] != "/" else None
                k = end + 1
                continue
            if skip is None:
                out.append(piece)
                piece = ""
                k = end + 1
                continue
        if skip is None:
            piece += html[k]
        k += 1
    return h.unescape(" ".join(h.unescape(x).strip() for x in [*out, piece] if h.unescape(x).strip()))


def test_mail_text(spark):
    r = random.Random(9)
    parts = ["<p>", "</p>", "<br/>", "<div class='a'>", "</div>", "text", " more ", "&amp;", "&amp;lt;", "\n", "é", "<b>", "</b>", "<style>p { x }</style>", "<SCRIPT src='x'>if (a) { b }</SCRIPT>", "<li>", "<tr><td>"]
    pages = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(300)]
    assert [mail_text(p) for p in pages] == [plain_text(p) for p in pages]
    assert mail_text("a<script>never closed <p>x") == "a" and mail_text("a <!-- b --> c") == "a c" and mail_text("<style/>x</style>y") == "y"
    df = spark.createDataFrame([(p,) for p in pages[:20]] + [(None,)], "html string")
    assert [x.t for x in df.select(mail_texts("html").alias("t")).collect()] == [mail_text(p) for p in pages[:20]] + [None]
