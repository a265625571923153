"""Byte-pair encoding and decoding with a public byte-level vocabulary.

A text is cut into words by the vocabulary's published pattern. In each word the symbols form a doubly linked
list; a priority queue holds the merge rank of every neighbouring pair, and entries whose symbols have changed
since are skipped when they come up. Ids travel as packed little-endian unsigned 32-bit integers.

Defined results: null texts count as empty and give no ids; the vocabulary's own special tokens, where their
string stands in a text, give their single id, as the public library does by default; a word of any length is
encoded whole, in time n log n. Other columns of the input pass through untouched, whatever their names; a column of the
name of the new one is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.session import read_table, tokenizer_path

#: The published pre-tokenisation pattern of this vocabulary, white space as Unicode defines it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Texts made of these characters only are cut here; the library's own splitter cuts the others, so that the two
#: never differ over the Unicode version.
PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞€]*")
CACHE_WORDS = 200_000
ROWS_OUT = 256


def _printable_bytes() -> dict[str, int]:
    """The vocabulary writes each byte as one printable character: itself if printable, else the next free one past 255."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}


class Codec(dict):
    """Maps a word to its packed ids; a bounded cache of the words seen."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = _printable_bytes()
        vocab = spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, k in vocab.items():
            self.bytes_of[k] = token.encode() if token in self.special else bytes(as_byte[c] for c in token)
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        self.byte_id = [0] * 256
        for c, b in as_byte.items():
            self.byte_id[b] = vocab[c]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.words = regex.compile(WORD_PATTERN).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._library = None
        self._path = path

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        packed = array("I", self.merged(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= 64:
            self[word] = packed
        return packed

    def merged(self, word: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost of equals, until no neighbours merge."""
        merge = self.merge
        sym: list[int] = [self.byte_id[b] for b in word]
        n = len(sym)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, k, sym[k], sym[k + 1]) for k in range(n - 1) if (m := merge.get((sym[k], sym[k + 1])))]
        heapq.heapify(queue)  # (rank, merged symbol, place, left symbol, right symbol); equal ranks are the same pair
        while queue:
            _, new, k, a, b = heapq.heappop(queue)
            r = right[k]
            if sym[k] != a or r >= n or sym[r] != b:
                continue  # stale
            sym[k], sym[r] = new, -1
            right[k] = after = right[r]
            if after < n:
                left[after] = k
                if m := merge.get((new, sym[after])):
                    heapq.heappush(queue, (*m, k, new, sym[after]))
            before = left[k]
            if before >= 0 and (m := merge.get((sym[before], new))):
                heapq.heappush(queue, (*m, before, sym[before], new))
        return [s for s in sym if s >= 0]

    def cut(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.words(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.at_special is None or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.cut(text)))
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else b"".join(map(self.__getitem__, self.cut(x))) for x in self.at_special.split(text) if x)

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _with_column(df: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, source: str, of) -> DataFrame:
    """df and one more column, computed from another in small Arrow batches."""
    at = df.columns.index(source)
    kept = [k for k, c in enumerate(df.columns) if c != name]
    schema = T.StructType([*(df.schema.fields[k] for k in kept), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = of()
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS_OUT):
                part = whole.slice(k, ROWS_OUT)
                new = pa.array(map(f, part.column(at).to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), new], names=[*(part.schema.names[k] for k in kept), name])

    return df.mapInArrow(run, schema)


def bpe_encode(df: DataFrame, text: str = "text", out: str = "token_ids", path: str | None = None) -> DataFrame:
    """df with the ids of `text`, packed as little-endian unsigned 32-bit integers (binary). Null: no ids."""
    path = path or tokenizer_path()
    return _with_column(df, out, T.BinaryType(), pa.binary(), text, lambda: codec(path).encode)


def bpe_decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text that packed ids stand for: the vocabulary's byte strings joined and read as UTF-8. Null: empty."""
    path = path or tokenizer_path()
    return _with_column(df, out, T.StringType(), pa.string(), ids, lambda: lambda b, f=codec(path).decode: f(b or b""))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = bpe_encode(docs).select("doc_id", "token_ids")
    return bpe_decode(coded).select("doc_id", F.expr("cast(octet_length(token_ids) div 4 as bigint)").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
