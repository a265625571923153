"""Texts that extraction has torn into letters: find them, and put their words together again.

Two signs: paragraphs of one or two letters, one after the other, and paragraphs with a run of lone letters. Each is too weak by
itself (numbered lists, spaced headings), so a text counts as garbled when both are there or one is overwhelming. Finding them
is a matter of expressions.

Healing cuts the letters of a run into the likeliest words, by dynamic programming over the corpus's own word counts. The
vocabulary is a table that grows with the corpus, so it is never broadcast. What is broadcast has a fixed size: the commonest words with
their counts, and a table of bits that tells which pieces may be words at all. Only the pieces that pass it and are not common
leave a document, each once, for the join with the vocabulary; a piece that passes by chance finds no word there. When the vocabulary
outgrows the bits, more pieces are sent, with equal results. A result that still looks garbled, or holds a word that no
language has, is not used.

Null texts have no paragraphs and are left alone; rows are told apart by a number of their own, so repeated ids do no harm."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.session import settled

# Fixed values.
SHARD_CHARS = 2
SHARD_RUN_WITH_EXPLODED = 3
SHARD_RUN_ALONE = 6
TOKEN_RUN = 6
EXPLODED_ALONE = 2
SHORT_TOKEN_CHARS = 2
SHORT_RUN = 6
LONGEST_WORD = 30
EDGE_MARKS = ".,;:!?()[]{}'\"“”‘’/-–—"

#: Lone letters, at least TOKEN_RUN of them, between blanks.
LONE_RUN = rf"(?<!\S)\S(?!\S)(?:\s+\S(?!\S)){{{TOKEN_RUN - 1},}}"
#: What parts tokens and stands at the ends of paragraphs, as the inside of a character class. Sources with a narrower notion name theirs.
BLANKS = r"\s"
#: A lone letter beside another one.
LONE_PAIR = r"(?<!\S)\S(?=\s+\S(?!\S))|(?<=(?<!\S)\S\s)\S(?!\S)"
#: The commonest words, which every task holds, and the table of bits: 2**BITS of them (16 MB), of which each word sets a few. It is made
#: in slices of 2**SLICE bits.
COMMON = 16_384
BITS, SLICE = 27, 18
PROBES = (64 - BITS, 10)


def _least_run(blanks: str) -> str:
    """As many lone letters as make a run and no more: the JVM's matcher goes a level deeper for each letter. It looks behind by half a
    character where one takes two, so the blank before the run is matched."""
    return rf"(?U)(?:^|[{blanks}])[^{blanks}](?:[{blanks}]+[^{blanks}]){{{TOKEN_RUN - 1}}}(?![^{blanks}])"


def paragraphs(text: Column, separator: str = "\n\n", edges: str = BLANKS) -> Column:
    """The paragraphs of a text without blanks at their ends, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), re.escape(separator)), lambda b: F.regexp_replace(b, rf"(?U)^[{edges}]+|[{edges}]+\z", "")), lambda b: b != "")


def _longest_run(flags: Column) -> Column:
    """The longest stretch of ones in an array of "1" and "0"."""
    return F.coalesce(F.array_max(F.transform(F.split(F.array_join(flags, ""), "0"), lambda x: F.length(x))), F.lit(0)).cast("long")


def short_token_run(text: Column, blanks: str = BLANKS) -> Column:
    """The longest run of tokens that are one or two letters but for marks at their ends."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?U)[^{blanks}]+"), F.lit(0))
    return _longest_run(F.transform(tokens, lambda t: F.when(F.btrim(t, F.lit(EDGE_MARKS)).rlike(rf"^\p{{L}}{{1,{SHORT_TOKEN_CHARS}}}\z"), "1").otherwise("0")))


def fingerprint(text: Column, separator: str = "\n\n", blanks: str = BLANKS, edges: str = BLANKS) -> Column:
    """Struct of paragraphs, shard_count, longest_shard_run, exploded_count, garbled."""
    blocks = paragraphs(text, separator, edges)
    shards = F.transform(blocks, lambda b: F.when(F.length(b) <= SHARD_CHARS, "1").otherwise("0"))
    exploded = F.size(F.filter(blocks, lambda b: (F.length(b) > SHARD_CHARS) & b.rlike(_least_run(blanks)))).cast("long")
    run = _longest_run(shards)
    garbled = (exploded >= EXPLODED_ALONE) | ((exploded >= 1) & (run >= SHARD_RUN_WITH_EXPLODED)) | (run >= SHARD_RUN_ALONE)
    return F.struct(
        F.size(blocks).cast("long").alias("paragraphs"),
        F.size(F.filter(shards, lambda x: x == "1")).cast("long").alias("shard_count"),
        run.alias("longest_shard_run"),
        exploded.alias("exploded_count"),
        garbled.alias("garbled"),
    )


def assessed(docs: DataFrame, text: str = "text", separator: str = "\n\n", blanks: str = BLANKS, edges: str = BLANKS) -> DataFrame:
    """docs with the columns of `fingerprint` and short_run. blanks part tokens, edges are taken from the ends of paragraphs."""
    f = docs.withColumn("_f", fingerprint(F.col(text), separator, blanks, edges)).withColumn("short_run", short_token_run(F.col(text), blanks))
    return f.select("*", "_f.*").drop("_f")


def torn_runs(text: str, separator: str = "\n\n") -> list[tuple[int, int]]:
    """Where lone letters or shards stand: (start, end), in order."""
    out, at, held = [], 0, []

    def shards_over() -> None:
        if len(held) >= SHARD_RUN_WITH_EXPLODED:
            out.append((held[0][0], held[-1][1]))
        held.clear()

    for block in text.split(separator):
        bare = block.strip()
        start = at + block.find(bare) if bare else at
        if bare and len(bare) <= SHARD_CHARS:
            held.append((start, start + len(bare)))
        elif bare:
            shards_over()
            out += [(at + m.start(), at + m.end()) for m in re.finditer(LONE_RUN, block)]
        at += len(block) + len(separator)
    shards_over()
    return out


def letters_of(run: str) -> list[str]:
    """A run without its blanks, as stretches of letters and of marks."""
    return re.findall(r"\w+|[^\w\s]+", re.sub(r"\s+", "", run))


def best_words(letters: str, counts: dict[str, int], total: float) -> list[str]:
    """The likeliest words that make up these letters; an unknown word costs tenfold for each letter. Of equal ones, the cut with
    the longest last words."""
    low = letters.lower() if len(letters.lower()) == len(letters) else letters
    unknown = [math.log(total) + (n - 1) * math.log(10) for n in range(LONGEST_WORD + 1)]
    cost, back = [0.0], [0]
    for end in range(1, len(low) + 1):
        best, at = math.inf, end - 1
        for start in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(low[start:end])
            c = cost[start] + (math.log(total / n) if n else unknown[end - start])
            if c < best:
                best, at = c, start
        cost.append(best)
        back.append(at)
    out, end = [], len(low)
    while end:
        out.append(letters[back[end] : end])
        end = back[end]
    return out[::-1]


def mended(text: str, counts: dict[str, int], total: float, separator: str = "\n\n") -> str:
    """The text with its torn runs as words; marks stay at the word before them."""
    out, at = [], 0
    for start, end in torn_runs(text, separator):
        out.append(text[at:start])
        line = ""
        for piece in letters_of(text[start:end]):
            whole = " ".join(best_words(piece, counts, total)) if piece[0].isalnum() or piece[0] == "_" else piece
            line += whole if not line or whole == piece and not (piece[0].isalnum() or piece[0] == "_") else " " + whole
        out.append(line)
        at = end
    return "".join(out) + text[at:]


def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hashes of pieces with one letter more."""
    return h * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(1)


def _places(h: np.ndarray) -> list[np.ndarray]:
    """Where hashes stand in the table of bits, an array for each probe."""
    x = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return [x >> np.uint64(k) & np.uint64((1 << BITS) - 1) for k in PROBES]


def _codes(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _word_places(words: pd.Series) -> pd.Series:
    """The bits that a word sets; none for words that no piece may be."""
    words = [w if w is not None and len(w) <= LONGEST_WORD else "" for w in words]
    n = np.array([len(w) for w in words], dtype=np.int64)
    codes, first, h = _codes("".join(words)), np.cumsum(n) - n, np.zeros(len(n), dtype=np.uint64)
    for k in range(n.max(initial=0)):
        on = n > k
        h[on] = _step(h[on], codes[first[on] + k])
    return pd.Series([p if m else [] for p, m in zip(np.stack(_places(h), axis=1).astype(np.int64).tolist(), n, strict=True)])


def word_bits(counts: DataFrame) -> np.ndarray:
    """The table of bits of the words of counts, as bytes: of one size whatever the vocabulary. Tasks fill its slices, and the driver puts
    these side by side."""
    size = 1 << SLICE

    def fill(table: pa.Table) -> pa.Table:
        at = table.column("at").to_numpy()
        on = np.zeros(size, dtype=bool)
        on[at & size - 1] = True
        return pa.table({"slice": pa.array([int(at[0]) >> SLICE], pa.int32()), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    at = counts.select(F.explode(_word_places("word")).alias("at"))
    out = np.zeros(1 << BITS - 3, dtype=np.uint8)
    for r in at.groupBy(F.shiftright("at", SLICE)).applyInArrow(fill, "slice int, bits binary").collect():
        out[r.slice << SLICE - 3 : r.slice + 1 << SLICE - 3] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def possible_words(text: str, separator: str, bits: np.ndarray) -> set[str]:
    """The pieces of a text's torn runs that may be words by the table of bits, all that are words among them."""
    stretches = list(dict.fromkeys(p.lower() for a, b in torn_runs(text, separator) for p in letters_of(text[a:b]) if p[0].isalnum() or p[0] == "_"))
    letters = "".join(stretches)
    n = np.array([len(p) for p in stretches], dtype=np.int64)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(letters))  # letters to the end of the stretch
    codes, starts, h, out = _codes(letters), np.arange(len(letters)), np.zeros(len(letters), dtype=np.uint64), set()
    for k in range(min(LONGEST_WORD, n.max(initial=0))):
        on = left[starts] > k
        starts, h = starts[on], h[on]
        h = _step(h, codes[starts + k])
        hit = np.ones(len(h), dtype=bool)
        for at in _places(h):
            hit &= bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
        out.update(letters[i : i + k + 1] for i in starts[hit].tolist())
    return out


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, without lone letters that stand side by side."""
    whole = F.regexp_replace(F.lower(F.col(text)), f"(?U){LONE_PAIR}", " ")
    return docs.select(F.explode(F.regexp_extract_all(whole, F.lit(rf"(?U)\w{{1,{LONGEST_WORD}}}(?!\w)"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def healed(docs: DataFrame, text: str = "text", separator: str = "\n\n", protected: Column | None = None, counts: DataFrame | None = None) -> DataFrame:
    """docs with action and healed. Garbled texts are `healed` (their words in the column of this name), or `still_garbled` when the
    result is no better; protected ones are `excluded`, others `not_garbled`. counts: (word, n), by default of docs themselves.
    Nothing is overwritten: a caller takes the healed texts or leaves them."""
    counts = settled(counts if counts is not None else word_counts(docs, text), "word-counts")
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    number = docs.withColumn("_number", F.monotonically_increasing_id()).withColumn("_garbled", fingerprint(F.col(text), separator)["garbled"])
    skip = F.coalesce(protected, F.lit(False)) if protected is not None else F.lit(False)
    rows = settled(number.withColumn("_torn", F.col("_garbled") & ~skip), "garble")
    torn = rows.where("_torn")
    common = {r.word: r.n for r in settled(counts.orderBy(F.desc("n"), "word").limit(COMMON), "common-words").collect()}
    shared = docs.sparkSession.sparkContext.broadcast((common, word_bits(counts)))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def rare(texts: pd.Series) -> pd.Series:
        common, bits = shared.value
        return pd.Series([sorted(possible_words(t, separator, bits) - common.keys()) for t in texts])

    @F.pandas_udf("string")
    def mend(texts: pd.Series, words: pd.Series, ns: pd.Series) -> pd.Series:
        common = shared.value[0]
        return pd.Series([mended(t, common | dict(zip(w if w is not None else (), n if n is not None else (), strict=True)), total, separator) for t, w, n in zip(texts, words, ns, strict=True)])

    pieces = torn.select("_number", F.explode(rare(text)).alias("word"))
    known = pieces.join(counts, "word").groupBy("_number").agg(F.collect_list("word").alias("_words"), F.collect_list("n").alias("_counts"))  # words of one document
    new = torn.join(known, "_number", "left").withColumn("_new", mend(text, "_words", "_counts")).withColumn("_text", F.col(text))
    megaword = F.col("_new").rlike(rf"[\p{{L}}\p{{N}}]{{{LONGEST_WORD + 1},}}") & ~F.col("_text").rlike(rf"[\p{{L}}\p{{N}}]{{{LONGEST_WORD + 1},}}")
    readable = (F.col("_new") != F.col("_text")) & ~fingerprint(F.col("_new"), separator)["garbled"] & ~megaword
    new = new.withColumn("healed", F.when(readable, F.col("_new"))).withColumn("action", F.when(F.col("healed").isNotNull(), "healed").otherwise("still_garbled"))
    old = rows.where("not _torn").withColumn("healed", F.lit(None).cast("string")).withColumn("action", F.when(F.col("_garbled"), "excluded").otherwise("not_garbled"))
    names = [*docs.columns, "healed", "action"]
    return old.select(*names).unionByName(new.select(*names))
