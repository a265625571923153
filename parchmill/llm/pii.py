"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find e-mail addresses, IPv4 addresses, payment cards and international telephone numbers. The field
reads word shapes: it labels local telephone numbers, written-out e-mail addresses, national identity numbers and
names after a title. It is trained on a small labelled table (LABELLED rows below, a parameter), and decoded by
Viterbi for a batch of lines at a time in numpy. A line goes to the field if it holds a token that such data cannot
do without (two digits in a row, a title, a written-out dot); spans that touch a pattern's span are left to it.

Defined results: null and empty texts have no spans; positions are code points, ends exclusive; texts and lines of any
length are read whole; repeated rows give repeated results; `mask` passes other columns through.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.session import read_table

#: Kinds in the order of listing; the first four are the patterns'.
KINDS = ("email", "ip", "card", "phone", "name", "national_id")
BASE_KINDS = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits matches from its start or not at all, so no start inside a run is tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain, left to right: every "@" takes the run of local characters before it."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
#: A line without any of these holds nothing that the field knows.
TRIGGER = re.compile(r"[0-9]{2}|\b(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señora?|[Dd]ot|DOT)\b")
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora".split())
PHONE_CUES = frozenset("phone tel telephone call mobile fax cell whatsapp telefon téléphone teléfono".split())
ID_CUES = frozenset("ssn social security insurance passport".split())
TLDS = frozenset("com org net edu gov io info".split())
SHAPES = {s: k for k, s in enumerate(["pad", "d1", "d2", "d3", "d4", "d5", "d6", "title", "phone-cue", "id-cue", "tld", "at", "dot", "lower", "Capital", "UPPER", "letter", "mixed", *"@+()-./:[]_,;#", "mark"])}
LABELS = ["O", *(f"{p}-{k}" for k in ("email", "phone", "name", "national_id") for p in "BI")]
WINDOW = (-3, -2, -1, 0, 1, 2, 3)


def shape(token: str) -> int:
    if token[0].isdigit() and token.isascii():
        return SHAPES[f"d{min(len(token), 6)}"]
    if not token[0].isalpha():
        return SHAPES.get(token, SHAPES["mark"])
    low = token.lower()
    for name, words in (("title", TITLES), ("phone-cue", PHONE_CUES), ("id-cue", ID_CUES), ("tld", TLDS)):
        if low in words and (name != "title" or token[0].isupper()):
            return SHAPES[name]
    if low in ("at", "dot"):
        return SHAPES[low]
    if len(token) == 1:
        return SHAPES["letter"]
    return SHAPES["lower" if token.islower() else "UPPER" if token.isupper() else "Capital" if token.istitle() else "mixed"]


#: The labelled table: {d} a digit, {w} a lower-case word, {N} a capitalised one, {h} a hexadecimal string; [kind text] marks a span.
LABELLED = [
    "{w} {w} [phone ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d}] {w}", "{N} {w} [phone {d}{d}{d}-{d}{d}{d}-{d}{d}{d}{d}], {w} {w}.", "call [phone {d}{d}{d}.{d}{d}{d}.{d}{d}{d}{d}] {w}", "tel: [phone 0{d}{d} {d}{d}{d} {d}{d}{d}{d}]",
    "phone [phone 0{d}{d}{d}-{d}{d}{d}{d}{d}{d}{d}] {w} {w}", "{w} [phone ({d}{d}{d}) {d}{d}{d} {d}{d}{d}{d}], {w}", "{w} [email {w} at {w} dot com] {w}", "{w} {w} [email {w}.{w} (at) {w} (dot) org], {w}",
    "[email {w} [at] {w} [dot] net] {w} {w}", "{N} [email {w}{d}{d} at {w} dot com]. {N}", "{w} Mr. [name {N}] {w} {w}", "Dr. [name {N} {N}] {w} {w}.", "{w} {w} Mrs. [name {N} {N}], {w}", "Prof. [name {N}] {w} at {w}",
    "{w} Herr [name {N}] {w}", "Madame [name {N} {N}] {w}", "ssn [national_id {d}{d}{d}-{d}{d}-{d}{d}{d}{d}] {w}", "{w} social security [national_id {d}{d}{d}-{d}{d}-{d}{d}{d}{d}], {w}", "{w} [national_id {d}{d}{d}-{d}{d}-{d}{d}{d}{d}] {w} {w}",
    "{N} {w} {w} at {w} {w}, {w}.", "{w} at the {w} {w} dot {w}", "{N} {N} {w}. {N} {w} at {N}.", "{w} {d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d}{d} {w} {w}", "{N}, {d}{d} {w} {d}{d}{d}{d}, {w} {d}.{d}", "Version {d}.{d} {w} {w}",
    "{w} {d}{d}.{d}{d}.{d}{d}{d}{d} {w}", "{w} {d}{d}{d}.{d}{d}{d}.{d}{d}.{d}{d}{d} {w} {w}", "{w}.{d}{d} {w} {w}, {N} {w}", "token = \"{d}{w}{d}{d}{w}{d}\" {w}", "{w} +{d} ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d} {w}", "{w}, {d}{d}{d} {w} {w}; {d}{d}{d}{d}",
    "{d}{d}{d}{d}-{d}{d}-{d}{d} {d}{d}:{d}{d}:{d}{d} {w}", "{w} {d}{d}{d}-{d}{d}{d} {w} {w}", "{w} ({d}{d}{d}{d}) {w} {w}", "{w}/{w}/{d}{d}{d}{d} {w}", "{w}#### {d}{d}{d}*** {w}%%% {d}{d}", "{N} {w} {w} {w}.", "{w} {w}, {w} {N} {w} {w}.",
    "{N}{N} {w}!! {d}{d}{d}{d}{d}{d}!! {w}", "{w} {d}{d}@{w}.{w}.com {w}", "dot {w} {w} {N}", "{w} dot {d}{d} {w}", "{d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d} {d}{d}{d}{d} {w}", "{w} {d}{d}-{d}{d} {w}", "{w} {d}{d}{d}-{d}{d}{d}{d} {w} {w}, {w}", "{w} | {d}{d}{d} | {N} | {w}",
    "{w} token = \"{h}\" {w} {w}", "{w}. {N} {w} {d}{d} {w}", "{N}. {N}, {w} {d}{d}{d}{d}", "{w} {w}. {N} {w} +{d} ({d}{d}{d}) {d}{d}{d}-{d}{d}{d}{d} {w}", "{N} {h} {w}", "{w}, {w}. {N}. {d}{d}{d}{d}{d}{d} {w}", "key={h}, {w}. {N} {w}",
]


def labelled_rows(copies: int = 8, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans): the labelled table, every line filled in a few times."""
    r, out = random.Random(seed), []
    syllables = "ba co di fu ga he in jo ka lo mu ne or pa ri su te un ve wo".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    for line in LABELLED * copies:
        text, spans = "", []
        for part in re.split(r"(\[(?:email|phone|name|national_id) (?:\[at\]|\[dot\]|[^\]])*\])", line):
            m = re.fullmatch(r"\[(email|phone|name|national_id) (.*)\]", part, re.DOTALL)
            filled = re.sub(r"\{([dwNh])\}", lambda x: {"d": lambda: str(r.randint(0, 9)), "w": word, "N": lambda: word().capitalize(), "h": lambda: f"{r.getrandbits(160):040x}"}[x[1]](), m[2] if m else part)
            if m:
                spans.append((m[1], len(text), len(text) + len(filled)))
            text += filled
        out.append((text, spans))
    return out


def _encode(lines: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
    """Padded shapes and glue (no blank before the token) of a batch of lines, and the tokens' places."""
    places = [[m.span() for m in TOKEN.finditer(x)] for x in lines]
    width = max([1, *map(len, places)])
    shapes, glued = np.zeros((len(lines), width), dtype=np.int64), np.zeros((len(lines), width), dtype=np.int64)
    for n, (line, spans) in enumerate(zip(lines, places, strict=True)):
        for t, (a, b) in enumerate(spans):
            shapes[n, t] = shape(line[a:b])
            glued[n, t] = t > 0 and spans[t - 1][1] == a
    return shapes, glued, places


class Field:
    """A linear-chain conditional random field: weights of each shape at each offset, of glue, and of label pairs."""

    def __init__(self):
        k = len(LABELS)
        self.emit = np.zeros((len(WINDOW), len(SHAPES), k))
        self.glue = np.zeros((2, k))
        self.move = np.zeros((k, k))
        for i, a in enumerate(LABELS):
            for j, b in enumerate(LABELS):
                if b[0] == "I" and a[1:] != b[1:]:
                    self.move[i, j] = -30.0  # an inner token follows its own kind only

    def scores(self, shapes: np.ndarray, glued: np.ndarray) -> np.ndarray:
        width = shapes.shape[1]
        out = self.glue[glued]
        for k, off in enumerate(WINDOW):
            moved = np.zeros_like(shapes)
            lo, hi = max(0, -off), min(width, width - off)
            if lo < hi:
                moved[:, lo:hi] = shapes[:, lo + off : hi + off]
            out = out + self.emit[k][moved]
        return out

    def fit(self, rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 160, rate: float = 0.15, decay: float = 1e-3) -> Field:
        """Maximise the conditional likelihood by gradient steps with adaptive rates."""
        shapes, glued, places = _encode([t for t, _ in rows])
        gold, mask = np.zeros(shapes.shape, dtype=np.int64), np.zeros(shapes.shape, dtype=bool)
        for n, (_, spans) in enumerate(rows):
            mask[n, : len(places[n])] = True
            for kind, a, b in spans:
                inside = [t for t, (x, y) in enumerate(places[n]) if x >= a and y <= b]
                for t in inside:
                    gold[n, t] = LABELS.index(f"{'B' if t == inside[0] else 'I'}-{kind}")
        keep = mask.any(1)
        shapes, glued, gold, mask = shapes[keep], glued[keep], gold[keep], mask[keep]
        count, width, k = *shapes.shape, len(LABELS)
        frozen = self.move < -20
        hot = np.eye(k)
        state = {w: (np.zeros_like(getattr(self, w)), np.zeros_like(getattr(self, w))) for w in ("emit", "glue", "move")}
        for step in range(1, steps + 1):
            e = self.scores(shapes, glued)
            fwd = np.zeros_like(e)
            fwd[:, 0] = e[:, 0]
            for t in range(1, width):
                x = _logsum(fwd[:, t - 1, :, None] + self.move[None], 1) + e[:, t]
                fwd[:, t] = np.where(mask[:, t, None], x, fwd[:, t - 1])
            back = np.zeros_like(e)
            for t in range(width - 2, -1, -1):
                x = _logsum(self.move[None] + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(mask[:, t + 1, None], x, back[:, t + 1])
            whole = _logsum(fwd[:, -1], 1)[:, None]
            own = np.exp(fwd + back - whole[:, :, None]) * mask[:, :, None]
            miss = (hot[gold] - own) * mask[:, :, None]
            move = np.zeros_like(self.move)
            for t in range(1, width):
                use = mask[:, t]
                pair = np.exp(fwd[use, t - 1, :, None] + self.move[None] + (e[use, t] + back[use, t])[:, None, :] - whole[use][:, :, None])
                move += (hot[gold[use, t - 1]][:, :, None] * hot[gold[use, t]][:, None, :]).sum(0) - pair.sum(0)
            emit, glue = np.zeros_like(self.emit), np.zeros_like(self.glue)
            for j, off in enumerate(WINDOW):
                moved = np.zeros_like(shapes)
                lo, hi = max(0, -off), min(width, width - off)
                if lo < hi:
                    moved[:, lo:hi] = shapes[:, lo + off : hi + off]
                np.add.at(emit[j], moved[mask], miss[mask])
            np.add.at(glue, glued[mask], miss[mask])
            move[frozen] = 0
            for name, g in (("emit", emit), ("glue", glue), ("move", move)):
                w, (m, v) = getattr(self, name), state[name]
                g = g / count - decay * np.where(np.abs(w) > 20, 0, w)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, lines: list[str]) -> list[list[tuple[str, int, int]]]:
        """Viterbi for all lines at once: the spans of each."""
        shapes, glued, places = _encode(lines)
        e = self.scores(shapes, glued)
        best, origin = e[:, 0].copy(), np.zeros(e.shape, dtype=np.int8)
        best[:, [k for k, x in enumerate(LABELS) if x[0] == "I"]] -= 30
        sizes = np.array([len(p) for p in places])
        for t in range(1, e.shape[1]):
            x = best[:, :, None] + self.move[None]
            origin[:, t] = x.argmax(1)
            best = np.where((t < sizes)[:, None], x.max(1) + e[:, t], best)
        out = []
        for n, spans in enumerate(places):
            found: list[tuple[str, int, int]] = []
            label, path = int(best[n].argmax()), []
            for t in range(len(spans) - 1, -1, -1):
                path.append(label)
                label = int(origin[n, t, label])
            for (a, b), k in zip(spans, reversed(path), strict=True):
                if LABELS[k][0] == "B":
                    found.append((LABELS[k][2:], a, b))
                elif LABELS[k][0] == "I" and found:
                    found[-1] = (found[-1][0], found[-1][1], b)
            out.append(found)
        return out


def possible(kind: str, text: str, before: str) -> bool:
    """Whether a span that the field found can be of its kind at all."""
    digits = sum(c.isdigit() for c in text)
    if kind == "phone":
        return 7 <= digits <= 15 and not any(c.isalpha() for c in text)
    if kind == "national_id":
        return 8 <= digits <= 12 and not any(c.isalpha() for c in text)
    if kind == "email":
        return all(re.search(rf"(?i)(?<![^\W_]){x}(?![^\W_])", text) for x in ("at", "dot"))
    words = re.findall(r"[^\W\d_]+", before)
    return bool(words) and words[-1].lower() in TITLES and words[-1][0].isupper()


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


#: Lines decoded together, and their letters.
LINES_AT_ONCE, LETTERS_AT_ONCE = 256, 1 << 16


def all_spans(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """Every text's spans (kind, start, end, by a pattern) by kind and start; the patterns' first, the field's where they touch none of those."""
    out = [[(*s, True) for s in base_spans(t)] if t else [] for t in texts]
    waiting: list[tuple[int, int, str]] = []

    def decode(batch):
        for (n, start, _), spans in zip(batch, field.decode([x for _, _, x in batch]), strict=True):
            for kind, a, b in spans:
                a, b = a + start, b + start
                if possible(kind, texts[n][a:b], texts[n][max(0, a - 16) : a]) and not any(x < b and a < y for _, x, y, _ in out[n]):
                    added[n].append((kind, a, b, False))

    added: list[list[tuple[str, int, int, bool]]] = [[] for _ in texts]
    for n, text in enumerate(texts):
        at = 0
        while text and (m := TRIGGER.search(text, at)):
            start = text.rfind("\n", 0, m.start()) + 1
            end = text.find("\n", m.end())
            end = len(text) if end < 0 else end
            waiting.append((n, start, text[start:end]))
            at = end
    waiting.sort(key=lambda x: len(x[2]))
    batch: list[tuple[int, int, str]] = []
    for x in waiting:
        if batch and (len(batch) >= LINES_AT_ONCE or (len(batch) + 1) * len(x[2]) > LETTERS_AT_ONCE):
            decode(batch)
            batch = []
        batch.append(x)
    if batch:
        decode(batch)
    order = {k: n for n, k in enumerate(KINDS)}
    return [sorted(a + b, key=lambda s: (order[s[0]], s[1], s[2])) for a, b in zip(out, added, strict=True)]


def masked(text: str | None, spans: list[tuple]) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


@functools.lru_cache(maxsize=1)
def _default_field() -> Field:
    return Field().fit(labelled_rows())


def trained(spark: SparkSession, labelled: DataFrame | None = None, limit: int = 5000) -> Field:
    """The field, trained on a labelled table (text, spans as "kind:start:end,..."), by default the one above; at most
    `limit` rows of it are used."""
    if labelled is None:
        return _default_field()
    rows = [(r["text"], [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in (r["spans"] or "").split(",") if s)]) for r in labelled.where("text is not null").orderBy("text").limit(limit).collect()]
    return Field().fit(rows)


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii", mask: str | None = None, field: Field | None = None) -> DataFrame:
    """docs with the spans of `text` as an array of (kind, start, end), and with its masked form in the column `mask`; columns
    of these names are replaced."""
    model = field or trained(docs.sparkSession)
    at = docs.columns.index(text)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in (mask, out)), T.StructField(out, span), *([T.StructField(mask, T.StringType())] if mask else [])])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                texts = b.column(at).to_pylist()
                spans = all_spans(texts, model)
                kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n not in (mask, out)]
                extra = [(out, pa.array([[{"kind": x, "start": a, "end": c, "base": d} for x, a, c, d in s] for s in spans], arrow))]
                extra += [(mask, pa.array([masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))] if mask else []
                yield pa.RecordBatch.from_arrays([c for _, c in kept + extra], names=[n for n, _ in kept + extra])

    return docs.mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    line = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)))"
    return found.select("doc_id", *[F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}' and s.base)) as bigint)").alias(f"n_{k}") for k in BASE_KINDS], F.sha2(F.expr(line.format(f"filter(pii, s -> s.kind in ({base}) and s.base)")), 256).alias("base_sha256"), F.expr(line.format("pii")).alias("spans"))

