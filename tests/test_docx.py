"""Word packages: packages written here and read back, and each rule on its own."""

import io
import zipfile

import pytest

from parchmill.sources import docx as D
from parchmill.sources.docx import W, package, paragraphs, run

P = "<w:p>%s</w:p>"


def texts(body, **parts):
    return [p["text"] for p in paragraphs(package(body, **parts))]


def test_text_in_force():
    body = P % (run("A ") + f'<w:ins w:id="1">{run("new ")}</w:ins><w:del w:id="2">{run("old ", "delText")}</w:del>' + run("end"))
    body += P % (f"<w:moveFrom>{run('stays')}</w:moveFrom>") + P % (f"<w:moveTo>{run('not yet')}</w:moveTo>")
    body += P % ("<w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:cr/></w:r>") + P % "<m:oMath><m:r><m:t>x+y</m:t></m:r></m:oMath>"
    got = paragraphs(package(body))
    assert [p["text"] for p in got] == ["A old end", "stays", "a\tb\nc", "x+y"]
    assert [(p["insertions"], p["deletions"]) for p in got] == [(1, 1), (0, 1), (0, 0), (0, 0)]
    assert [p["source_index"] for p in got] == [1, 2, 4, 5]


def test_one_of_alternative_contents_and_text_boxes():
    box = lambda x: f"<w:txbxContent><w:p>{run(x)}</w:p></w:txbxContent>"
    body = P % (run("before ") + f"<w:r><mc:AlternateContent><mc:Choice>{box('box')}</mc:Choice><mc:Fallback>{box('box')}</mc:Fallback></mc:AlternateContent></w:r>" + run(" after"))
    body += P % (f"<mc:AlternateContent><mc:Fallback>{run('only')}</mc:Fallback></mc:AlternateContent>")
    got = paragraphs(package(body))
    assert [(p["text"], p["source_index"]) for p in got] == [("before box after", 1), ("only", 2)]


def test_tables_in_tables():
    cell = lambda *x: f"<w:tc>{''.join(x)}</w:tc>"
    table = lambda *rows: f"<w:tbl>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>"
    body = P % run("x") + table(cell(P % run("a")) + cell(P % run("b"), table(cell(P % run("in"))), P % run("c")), cell(P % run("d"))) + table(cell(P % run("e")))
    got = [(p["text"], p["kind"], p["table_index"], p["row_index"], p["cell_index"]) for p in paragraphs(package(body))]
    assert got == [("x", "paragraph", None, None, None), ("a", "table_cell", 1, 1, 1), ("b", "table_cell", 1, 1, 2), ("in", "table_cell", 2, 1, 1), ("c", "table_cell", 1, 1, 2), ("d", "table_cell", 1, 2, 1), ("e", "table_cell", 3, 1, 1)]
    deep = "<w:tbl><w:tr><w:tc>" * 65 + P % run("x") + "</w:tc></w:tr></w:tbl>" * 65
    with pytest.raises(D.PackageError, match="too deep"):
        paragraphs(package(deep))


def level(k, text, form="decimal", start=1):
    return f'<w:lvl w:ilvl="{k}"><w:start w:val="{start}"/><w:numFmt w:val="{form}"/><w:lvlText w:val="{text}"/></w:lvl>'


NUMBERING = f'<w:abstractNum w:abstractNumId="7">{level(0, "%1.")}{level(1, "%1.%2", "lowerLetter")}{level(2, "(%3)", "lowerRoman", 3)}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride><w:lvlOverride w:ilvl="1">{level(1, "§%2", "upperRoman")}</w:lvlOverride></w:num>'


def numbered(text, num, k):
    return f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{k}"/><w:numId w:val="{num}"/></w:numPr></w:pPr>{run(text) if text else ""}</w:p>'


def test_numbering():
    steps = [("a", 1, 0), ("b", 1, 1), ("c", 1, 1), ("", 1, 1), ("d", 1, 1), ("e", 1, 2), ("f", 1, 0), ("g", 1, 2), ("h", 1, 1), ("i", 2, 0), ("j", 2, 1), ("k", 1, 0), ("l", 2, 0), ("m", 9, 0), ("n", 0, 0), ("o", 1, 8)]
    got = [(p["text"], p["label"]) for p in paragraphs(package("".join(numbered(*s) for s in steps), NUMBERING))]
    assert got == [("a", "1."), ("b", "1.a"), ("c", "1.b"), ("d", "1.d"), ("e", "(iii)"), ("f", "2."), ("g", "(iii)"), ("h", "2.b"), ("i", "5."), ("j", "§I"), ("k", "3."), ("l", "6."), ("m", None), ("n", None), ("o", None)]


def test_numbers_as_word_writes_them():
    assert [D.numeral(n, "lowerLetter") for n in (1, 26, 27, 52, 703)] == ["a", "z", "aa", "az", "aaa"]
    assert [D.numeral(n, "upperRoman") for n in (4, 9, 14, 40, 1994)] == ["IV", "IX", "XIV", "XL", "MCMXCIV"]
    assert D.numeral(0, "upperLetter") == "0" and D.numeral(3, "bullet") == "3"


def test_styles_give_numbers_and_headings():
    styles = '<w:style w:styleId="Base"><w:name w:val="x"/><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="Own"><w:name w:val="Heading 3"/><w:basedOn w:val="Base"/></w:style><w:style w:styleId="Loop"><w:basedOn w:val="Loop"/></w:style>'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr>{run(s)}</w:p>' for s in ("Own", "Base", "Loop", "Heading2", "none"))
    got = [(p["text"], p["label"], p["heading"]) for p in paragraphs(package(body, NUMBERING, styles))]
    assert got == [("Own", "1.a", 3), ("Base", "1.b", None), ("Loop", None, None), ("Heading2", None, 2), ("none", None, None)]


def test_runs_and_notes():
    body = P % (run(" ") + run("bold ", look="<w:b/>") + run("more", look="<w:b/>") + run(" off", look='<w:b w:val="0"/><w:u w:val="none"/>') + '<w:r><w:footnoteReference w:id="2"/></w:r>' + run(" i ", look="<w:i/>") + '<w:r><w:endnoteReference w:id="1"/><w:footnoteReference w:id="9"/></w:r>')
    notes = f'<w:footnote w:type="separator" w:id="0"><w:p>{run("rule")}</w:p></w:footnote><w:footnote w:id="2"><w:p>{run("one")}</w:p><w:p/><w:p>{run("two")}</w:p></w:footnote>'
    got = paragraphs(package(body, footnotes=notes, endnotes=f'<w:endnote w:id="1"><w:p>{run("end")}</w:p></w:endnote>', header1=P % run("Top"), comments=P % run("a comment")))
    first = got[0]
    assert first["text"] == "bold more off i"
    assert [(r["text"], r["bold"], r["italic"]) for r in first["runs"]] == [("bold more", True, False), (" off", False, False), (" i", False, True)]
    assert [(n["kind"], n["id"], n["offset"], n["text"]) for n in first["notes"]] == [("footnote", "2", 13, "one\ntwo"), ("endnote", "1", 15, "end"), ("footnote", "9", 15, None)]
    assert [(p["text"], p["kind"], p["part"], p["source_index"]) for p in got[1:]] == [("end", "supplemental", "endnotes", None), ("one", "supplemental", "footnotes", None), ("two", "supplemental", "footnotes", None), ("Top", "supplemental", "header1", None)]


def broken():
    good = package(P % run("x"))
    many = io.BytesIO()
    with zipfile.ZipFile(many, "w") as z:
        for k in range(4097):
            z.writestr(str(k), "")
    none = io.BytesIO()
    with zipfile.ZipFile(none, "w") as z:
        z.writestr("a.xml", "<a/>")
    entity = good_with(f'<!DOCTYPE d [<!ENTITY e "x">]><w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>&e;</w:t></w:r></w:p></w:body></w:document>')
    cases = {"not a package": [b"", b"PK", good[: len(good) // 2], good[:-30], b"plain text", flipped(good)], "no body": [none.getvalue()], "too many entries": [many.getvalue()], "suspicious compression": [package(P % run(" " * 3_000_000))], "no text": [package(P % "")], "unsafe xml": [entity], "broken xml": [good_with("<w:document")]}
    return [(status, data) for status, xs in cases.items() for data in xs]


def good_with(document):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", document)
    return out.getvalue()


def flipped(data):
    """The body's compressed bytes are damaged."""
    at = data.index(b"word/document.xml") + 40
    return data[:at] + bytes(b ^ 0xFF for b in data[at : at + 20]) + data[at + 20 :]


def test_broken_packages_are_rows(spark):
    cases = broken() + [("ok", package(P % run("fine")))]
    df = spark.createDataFrame([(str(k), data) for k, (_, data) in enumerate(cases)] + [("null", None)], "path string, content binary")
    got = {r.path: (r.status, r.text) for r in D.from_bytes(df).collect()}
    assert got == {str(k): (status, "fine" if status == "ok" else None) for k, (status, _) in enumerate(cases)} | {"null": ("not a package", None)}


def test_deep_and_long_xml(spark):
    depth = 20_000
    tags = "".join(f'<w:smartTag w:element="{k * 7919 % 99991:x}">' for k in range(depth))
    assert texts(P % (tags + run("deep") + "</w:smartTag>" * depth)) == ["deep"]
    words = " ".join(str(k * 7919 % 10007) for k in range(300_000))
    assert texts(P % run(words)) == [words]


def test_files_are_found_below_a_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.docx").write_bytes(package(P % run("one < & ü \x01")))
    (tmp_path / "two.txt").write_bytes(b"x")
    rows = D.read_packages(spark, str(tmp_path)).collect()
    assert [(r.text, r.path.rpartition("/")[2]) for r in rows] == [("one < & ü", "one.docx")]
