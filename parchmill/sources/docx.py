"""Word packages as tables of paragraphs.

Files come from Spark's binary source, a row each, or from a table of their places; a task reads a package's parts one after the
other with a streaming XML parser, so nesting costs no stack and only the paragraph at hand is in memory. What stands in the text is what is in force: tracked
insertions and the new places of moved text are left out, tracked deletions and old places stay. Of alternative contents the
first choice counts, a text box belongs to the paragraph that anchors it, and equations give their letters. Comments are
no part of an agreement and are left out.

A package that cannot be read is one row with its status and no text; it never stops the job. Sizes, counts and
compression are checked before anything is unpacked, and a part that declares a document type is refused."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values.
MOST_BYTES, MOST_RATIO, MOST_ENTRIES, DEEPEST_TABLE = 50 * 1024 * 1024, 100, 4096, 64
SUPPLEMENTAL = ("word/header", "word/footer", "word/footnotes.xml", "word/endnotes.xml")
BOOK_KEEPING = {"separator", "continuationSeparator"}
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
MC = "http://schemas.openxmlformats.org/markup-compatibility/2006"
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))

LONGEST_STYLE_CHAIN = 32
PARAGRAPHS = (
    "path string, status string, part string, source_index int, kind string, text string, style string, heading int, num_id string, level int, label string, "
    "table_index int, row_index int, cell_index int, insertions int, deletions int, runs array<struct<text: string, bold: boolean, italic: boolean, underline: boolean>>, "
    "notes array<struct<kind: string, id: string, offset: int, text: string>>"
)
_TEXT, _INT, _BOOL = pa.string(), pa.int32(), pa.bool_()
_RUN = pa.struct([("text", _TEXT), ("bold", _BOOL), ("italic", _BOOL), ("underline", _BOOL)])
_NOTE = pa.struct([("kind", _TEXT), ("id", _TEXT), ("offset", _INT), ("text", _TEXT)])
ARROW = pa.schema(
    [("path", _TEXT), ("status", _TEXT), ("part", _TEXT), ("source_index", _INT), ("kind", _TEXT), ("text", _TEXT), ("style", _TEXT), ("heading", _INT), ("num_id", _TEXT), ("level", _INT), ("label", _TEXT)]
    + [(c, _INT) for c in ("table_index", "row_index", "cell_index", "insertions", "deletions")]
    + [("runs", pa.list_(_RUN)), ("notes", pa.list_(_NOTE))]
)
#: Paragraphs that go to Spark at once.
BATCH = 1024


class PackageError(ValueError):
    """Its message is the status of the package."""


def numeral(value: int, form: str) -> str:
    """A number as Word writes it."""
    if value > 0 and form in ("lowerLetter", "upperLetter"):
        out = ""
        while value:
            value, rest = divmod(value - 1, 26)
            out = chr(ord("A") + rest) + out
        return out.lower() if form == "lowerLetter" else out
    if value > 0 and form in ("lowerRoman", "upperRoman"):
        out = ""
        for worth, letters in ROMAN:
            times, value = divmod(value, worth)
            out += letters * times
        return out.lower() if form == "lowerRoman" else out
    return str(value)


@dataclass
class Level:
    start: int = 1
    form: str = "decimal"
    text: str | None = None


@dataclass
class Numbering:
    """Levels of each list, and how far each list has counted."""

    levels: dict[str, dict[int, Level]] = field(default_factory=dict)
    counts: dict[str, dict[int, int]] = field(default_factory=dict)

    def next(self, num_id: str, level: int) -> str | None:
        """The label of the next paragraph of this list and level; deeper levels start afresh. None if the list does not define
        the level."""
        levels = self.levels.get(num_id, {})
        if level not in levels:
            return None
        counts = {k: n for k, n in self.counts.get(num_id, {}).items() if k <= level}
        counts[level] = counts.get(level, levels[level].start - 1) + 1
        for k in range(level):
            counts.setdefault(k, levels[k].start if k in levels else 1)
        self.counts[num_id] = counts
        text = levels[level].text or f"%{level + 1}."
        put = lambda m: numeral(counts[k], levels[k].form if k in levels else "decimal") if (k := int(m[1]) - 1) in counts else ""
        return re.sub(r"%(\d+)", put, text).strip()


def _parse(package: zipfile.ZipFile, part: str, start, end, letters=None) -> None:
    """Feed a part to handlers of (namespace, name, attributes), (namespace, name) and text."""
    parser = expat.ParserCreate(namespace_separator="\n")
    parser.buffer_text = True

    def refuse(*_) -> None:
        raise PackageError("unsafe xml")

    def opened(name: str, attributes: dict[str, str]) -> None:
        space, _, local = name.rpartition("\n")
        start(space, local, {k.rpartition("\n")[2]: v for k, v in attributes.items()})

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    parser.StartElementHandler = opened
    parser.EndElementHandler = lambda name: end(*name.rpartition("\n")[::2])
    if letters:
        parser.CharacterDataHandler = letters
    with package.open(part) as f:
        while block := f.read(1 << 16):
            parser.Parse(block, False)
    parser.Parse(b"", True)


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and re.fullmatch(r"-?\d{1,9}", x.strip()) else None


def _numbering(package: zipfile.ZipFile) -> Numbering:
    abstract: dict[str, dict[int, Level]] = {}
    lists: dict[str, tuple[str, dict[int, Level], dict[int, int]]] = {}
    at: dict = {}

    def start(space: str, name: str, a: dict[str, str]) -> None:
        if space != W:
            return
        if name == "abstractNum":
            at.update(abstract=abstract.setdefault(a.get("abstractNumId", ""), {}), num=None, override=None)
        elif name == "num":
            at.update(num=a.get("numId", ""), abstract=None, override=None)
            lists[at["num"]] = ("", {}, {})
        elif name == "abstractNumId" and at.get("num"):
            lists[at["num"]] = (a.get("val", ""), *lists[at["num"]][1:])
        elif name == "lvlOverride":
            at["override"] = _number(a.get("ilvl"))
        elif name == "startOverride" and at.get("override") is not None and _number(a.get("val")) is not None:
            lists[at["num"]][2][at["override"]] = _number(a["val"])
        elif name == "lvl":
            k = _number(a.get("ilvl"))
            home = at.get("abstract") if at.get("num") is None else lists[at["num"]][1]
            at["level"] = None if k is None or home is None else home.setdefault(k, Level())
        elif at.get("level") is not None:
            if name == "start":
                at["level"].start = _number(a.get("val")) or 1
            elif name == "numFmt":
                at["level"].form = a.get("val") or "decimal"
            elif name == "lvlText":
                at["level"].text = a.get("val") or None

    def end(space: str, name: str) -> None:
        if space == W and name in ("lvl", "lvlOverride"):
            at["level" if name == "lvl" else "override"] = None

    _parse(package, "word/numbering.xml", start, end)
    out = Numbering()
    for num, (base, own, starts) in lists.items():
        levels = {**abstract.get(base, {}), **own}
        for k, first in starts.items():
            old = levels.get(k, Level())
            levels[k] = Level(first, old.form, old.text)
        out.levels[num] = levels
    return out


@dataclass
class Style:
    name: str = ""
    base: str | None = None
    num_id: str | None = None
    level: int | None = None


def _styles(package: zipfile.ZipFile) -> dict[str, Style]:
    out: dict[str, Style] = {}
    at: list[Style | None] = [None]

    def start(space: str, name: str, a: dict[str, str]) -> None:
        if space != W:
            return
        if name == "style":
            at[0] = out.setdefault(a.get("styleId", ""), Style())
        elif at[0] is not None and name == "name":
            at[0].name = a.get("val", "")
        elif at[0] is not None and name == "basedOn":
            at[0].base = a.get("val")
        elif at[0] is not None and name == "numId":
            at[0].num_id = a.get("val")
        elif at[0] is not None and name == "ilvl":
            at[0].level = _number(a.get("val"))

    def end(space: str, name: str) -> None:
        if space == W and name == "style":
            at[0] = None

    _parse(package, "word/styles.xml", start, end)
    return out


class Reader:
    """The paragraphs of a part, as a stack of what is open. `notes`: texts of notes by (kind, id)."""

    def __init__(self, part: str, styles: dict[str, Style], numbering: Numbering, notes: dict[tuple[str, str], str]):
        self.part, self.styles, self.numbering, self.notes = part, styles, numbering, notes
        self.body = part == "word/document.xml"
        self.out: list[dict] = []
        self.found_notes: dict[tuple[str, str], str] = {}
        self.index = self.tables = self.outside = self.within = self.properties = self.run_properties = 0
        self.letters_on = False
        self.grids: list[dict] = []
        self.choices: list[bool] = []
        self.skipped: list[bool] = []
        self.paragraph: dict | None = None
        self.note: tuple[str, str] | None = None

    def start(self, space: str, name: str, a: dict[str, str]) -> None:
        if space == MC and name == "AlternateContent":
            self.choices.append(False)
        elif space == MC and name in ("Choice", "Fallback"):
            self.skipped.append(bool(self.choices and self.choices[-1]))
            self.outside += self.skipped[-1]
            self.choices[-1:] = [True] if self.choices else []
        elif space == M and name == "t":
            self.letters_on = True
        elif space == W:
            handler = getattr(self, f"on_{name}", None)
            if handler:
                handler(a)

    def end(self, space: str, name: str) -> None:
        if space == MC and name == "AlternateContent":
            self.choices.pop()
        elif space == MC and name in ("Choice", "Fallback"):
            self.outside -= self.skipped.pop()
        elif space == M and name == "t":
            self.letters_on = False
        elif space == W:
            handler = getattr(self, f"off_{name}", None)
            if handler:
                handler()

    # Tables: a stack, for cells hold tables.
    def on_tbl(self, a) -> None:
        if self.paragraph is None:
            if len(self.grids) == DEEPEST_TABLE:
                raise PackageError("tables too deep")
            self.tables += 1
            self.grids.append({"table": self.tables, "row": 0, "cell": 0})

    def off_tbl(self) -> None:
        if self.paragraph is None and self.grids:
            self.grids.pop()

    def on_tr(self, a) -> None:
        if self.paragraph is None and self.grids:
            self.grids[-1].update(row=self.grids[-1]["row"] + 1, cell=0)

    def on_tc(self, a) -> None:
        if self.paragraph is None and self.grids:
            self.grids[-1]["cell"] += 1

    # Paragraphs; one inside another is part of it.
    def on_p(self, a) -> None:
        self.within += 1
        if self.within == 1:
            self.index += 1
            self.paragraph = {"parts": [], "size": 0, "style": None, "num": None, "level": None, "insertions": 0, "deletions": 0, "runs": [], "notes": [], "look": (False, False, False)}

    def off_p(self) -> None:
        self.within -= 1
        if self.within == 0 and self.paragraph is not None:
            p, self.paragraph = self.paragraph, None
            self.keep(p)

    def keep(self, p: dict) -> None:
        raw = "".join(p["parts"])
        text = raw.strip()
        if self.note is not None:
            if text:
                self.found_notes[self.note] = "\n".join(filter(None, (self.found_notes.get(self.note), text)))
        style, chain = self.styles.get(p["style"] or ""), 0
        num, level = p["num"], p["level"]
        name = style.name if style else ""
        while num is None and style is not None and chain < LONGEST_STYLE_CHAIN:
            num, level, style, chain = style.num_id, style.level, self.styles.get(style.base or ""), chain + 1
        label = None
        if self.body and num and num != "0":
            level = level or 0
            label = self.numbering.next(num, level)  # blank paragraphs count too
        if not text:
            return
        before = len(raw) - len(raw.lstrip())
        grid = self.grids[-1] if self.grids and self.body else None
        heading = next((int(m[1]) for x in (p["style"] or "", name) if (m := re.search(r"heading\s*([1-9])", x, re.IGNORECASE))), None)
        kind = "table_cell" if grid else "paragraph" if self.body else "supplemental"
        self.out.append({
            "status": "ok", "part": self.part.rpartition("/")[2].removesuffix(".xml"), "source_index": self.index if self.body else None, "kind": kind, "text": text, "style": p["style"], "heading": heading,
            "num_id": num if label is not None else None, "level": level if label is not None else None, "label": label,
            "table_index": grid and grid["table"], "row_index": grid and grid["row"], "cell_index": grid and grid["cell"], "insertions": p["insertions"], "deletions": p["deletions"], "runs": trimmed_runs(p["runs"]),
            "notes": [{"kind": k, "id": i, "offset": min(max(0, at - before), len(text)), "text": self.notes.get((k, i))} for k, i, at in p["notes"]],
        })

    def on_pPr(self, a) -> None:
        self.properties += 1

    def off_pPr(self) -> None:
        self.properties -= 1

    def on_pStyle(self, a) -> None:
        if self.paragraph is not None and self.within == 1:
            self.paragraph["style"] = a.get("val")

    def on_numId(self, a) -> None:
        if self.paragraph is not None and self.within == 1 and self.properties:
            self.paragraph["num"] = a.get("val")

    def on_ilvl(self, a) -> None:
        if self.paragraph is not None and self.within == 1 and self.properties:
            self.paragraph["level"] = _number(a.get("val"))

    # Runs and their looks.
    def on_r(self, a) -> None:
        if self.paragraph is not None:
            self.paragraph["look"] = (False, False, False)

    def on_rPr(self, a) -> None:
        self.run_properties += 1

    def off_rPr(self) -> None:
        self.run_properties -= 1

    def _look(self, k: int, a: dict[str, str]) -> None:
        if self.paragraph is not None and self.run_properties and not self.properties:
            on = (a.get("val") or "1").lower() not in ("0", "false", "off", "none")
            self.paragraph["look"] = tuple(on if j == k else x for j, x in enumerate(self.paragraph["look"]))

    def on_b(self, a) -> None:
        self._look(0, a)

    def on_i(self, a) -> None:
        self._look(1, a)

    def on_u(self, a) -> None:
        self._look(2, a)

    # Text.
    def put(self, x: str) -> None:
        if self.paragraph is not None and not self.outside:
            p = self.paragraph
            p["parts"].append(x)
            p["size"] += len(x)
            if p["runs"] and p["runs"][-1][1] == p["look"]:
                p["runs"][-1][0].append(x)
            else:
                p["runs"].append(([x], p["look"]))

    def letters(self, x: str) -> None:
        if self.letters_on:
            self.put(x)

    def on_t(self, a) -> None:
        self.letters_on = True

    def off_t(self) -> None:
        self.letters_on = False

    on_delText, off_delText = on_t, off_t

    def on_tab(self, a) -> None:
        if not self.properties:
            self.put("\t")

    def on_br(self, a) -> None:
        self.put("\n")

    on_cr = on_br

    # Changes.
    def on_ins(self, a) -> None:
        if self.paragraph is not None:
            self.paragraph["insertions"] += 1
        self.outside += 1

    def off_ins(self) -> None:
        self.outside -= 1

    on_moveTo, off_moveTo = on_ins, off_ins

    def on_del(self, a) -> None:
        if self.paragraph is not None:
            self.paragraph["deletions"] += 1

    on_moveFrom = on_del

    # Notes.
    def _refers(self, kind: str, a: dict[str, str]) -> None:
        if self.paragraph is not None and not self.outside:
            self.paragraph["notes"].append((kind, a.get("id", "").strip(), self.paragraph["size"]))

    def on_footnoteReference(self, a) -> None:
        self._refers("footnote", a)

    def on_endnoteReference(self, a) -> None:
        self._refers("endnote", a)

    def _opens(self, kind: str, a: dict[str, str]) -> None:
        if a.get("type") in BOOK_KEEPING:
            self.outside += 1
            self.note = (kind, "")
        else:
            self.note = (kind, a.get("id", "").strip())

    def _closes(self) -> None:
        self.outside -= self.note is not None and self.note[1] == ""
        self.note = None

    def on_footnote(self, a) -> None:
        self._opens("footnote", a)

    def on_endnote(self, a) -> None:
        self._opens("endnote", a)

    off_footnote = off_endnote = _closes


def trimmed_runs(runs: list[tuple[list[str], tuple]]) -> list[dict]:
    """Runs without the blanks at the paragraph's ends."""
    out = [["".join(x), look] for x, look in runs]
    while out and not out[0][0].strip():
        out.pop(0)
    while out and not out[-1][0].strip():
        out.pop()
    if out:
        out[0][0], out[-1][0] = out[0][0].lstrip(), out[-1][0].rstrip() if len(out) > 1 else out[-1][0].strip()
    return [{"text": x, "bold": b, "italic": i, "underline": u} for x, (b, i, u) in out]


def _suspicious(e: zipfile.ZipInfo) -> bool:
    return not e.is_dir() and e.file_size > MOST_RATIO * e.compress_size


def paragraphs(data: bytes) -> list[dict]:
    """The paragraphs of a package: its body, then headers, footers and notes by name. Raises PackageError."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as package:
            entries = package.infolist()
            if len(entries) > MOST_ENTRIES:
                raise PackageError("too many entries")
            if sum(e.file_size for e in entries) > MOST_BYTES:
                raise PackageError("too large")
            if any(map(_suspicious, entries)):
                raise PackageError("suspicious compression")
            names = set(package.namelist())
            if "word/document.xml" not in names:
                raise PackageError("no body")
            styles = _styles(package) if "word/styles.xml" in names else {}
            numbering = _numbering(package) if "word/numbering.xml" in names else Numbering()
            rest = sorted(n for n in names if n.startswith(SUPPLEMENTAL) and n.endswith(".xml"))
            read, notes = {}, {}
            for part in [*rest, "word/document.xml"]:  # notes first, for the body refers to them
                reader = Reader(part, styles, numbering, notes)
                _parse(package, part, reader.start, reader.end, reader.letters)
                read[part] = reader.out
                notes.update(reader.found_notes)
            out = [p for part in ["word/document.xml", *rest] for p in read[part]]
    except expat.ExpatError as e:
        raise PackageError("broken xml") from e
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        raise PackageError("not a package") from e
    if not out:
        raise PackageError("no text")
    return out


def read_packages(spark: SparkSession, folder: str, pattern: str = "*.docx") -> DataFrame:
    """PARAGRAPHS of all packages below a folder. The driver holds the list of its files; for millions there is `read_places`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return from_bytes(files)


def read_places(places: DataFrame) -> DataFrame:
    """PARAGRAPHS of packages at given places (path). A task opens its own files one by one; the driver sees none of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                files, name = fs.FileSystem.from_uri(path)
                with files.open_input_stream(name) as f:
                    data = f.read()
                yield from _rows(path, data)

    return places.select("path").mapInArrow(read, PARAGRAPHS)


def from_bytes(files: DataFrame) -> DataFrame:
    """PARAGRAPHS of packages (path, content). A package without bytes is none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(*(c for c in b.columns), strict=True):
                yield from _rows(path.as_py(), data.as_py() or b"")

    return files.select("path", "content").mapInArrow(read, PARAGRAPHS)


def _rows(path: str, data: bytes) -> Iterator[pa.RecordBatch]:
    try:
        rows = paragraphs(data)
    except PackageError as e:
        rows = [{"status": str(e)}]
    for k in range(0, len(rows), BATCH):
        yield pa.RecordBatch.from_pylist([{"path": path, **r} for r in rows[k : k + BATCH]], ARROW)


# Writing: what a test or an export of plain paragraphs needs.

_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def xml_text(x: str) -> str:
    return escape(_ILLEGAL.sub("", x), {"\r": "&#13;"})


def run(text: str, tag: str = "t", look: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{look}</w:rPr>" if look else ""}<w:{tag} xml:space="preserve">{xml_text(text)}</w:{tag}></w:r>'


def package(body: str, numbering: str = "", styles: str = "", **parts: str) -> bytes:
    """A package of a body's XML. parts: other parts of the folder `word` by name."""
    head = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:%s xmlns:w="{W}" xmlns:m="{M}" xmlns:mc="{MC}">%s</w:%s>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", head % ("document", f"<w:body>{body}</w:body>", "document"))
        for name, inner, root in (("numbering", numbering, "numbering"), ("styles", styles, "styles"), *((k, v, {"footnotes": "footnotes", "endnotes": "endnotes"}.get(k, "hdr")) for k, v in parts.items())):
            if inner:
                z.writestr(f"word/{name}.xml", head % (root, inner, root))
    return out.getvalue()


def readable(data: bytes) -> bytes:
    """A package written here as the reader takes it: a part that shrinks further than the reader allows, as a text of one word over and
    over does, is stored as it is."""
    with zipfile.ZipFile(io.BytesIO(data)) as old:
        entries = old.infolist()
        if not any(map(_suspicious, entries)):
            return data
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for e in entries:
                z.writestr(e.filename, old.read(e), zipfile.ZIP_STORED if _suspicious(e) else zipfile.ZIP_DEFLATED)
    return out.getvalue()
