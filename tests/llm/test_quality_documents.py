"""The quality rules count documents: shared lines against an oracle that knows nothing but whole texts."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from parchmill.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def form(x):
    return " ".join(WORD.findall(x)).lower()


def oracle(rows):
    """{doc_id: (removed_words, kept)}, counting the different whole texts of each host."""
    texts, seen = defaultdict(set), defaultdict(set)
    for _, text, _, host, _ in rows:
        texts[host].add(form(text))
        for line in filter(WORD.search, text.split("\n")):
            seen[host, form(line)].add(form(text))
    enough = lambda n, of, words: n >= 20 and (n >= 0.05 * of or (words >= 8 and n * n >= of))
    common = {k for k, v in seen.items() if enough(len(v), len(texts[k[0]]), len(k[1].split()))}
    out = {}
    for k, text, _, host, _ in rows:
        own = WORD.findall(text)
        windows = Counter(zip(own, own[1:], own[2:], strict=False))
        repeated = {j for k in range(len(own) - 2) if windows[tuple(own[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        removed = sum(len(WORD.findall(x)) for x in text.split("\n") if WORD.search(x) and (host, form(x)) in common)
        out[k] = removed, len(own) >= 50 and 100 * len(repeated) <= 50 * len(own) and 2 * removed <= len(own)
    return out


@pytest.fixture(scope="module")
def shared():
    """Hosts whose documents share a passage longer than (or, on one, shorter than) their own text; one has copies too."""
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abdegikmnorstu") for _ in range(r.randint(2, 12))) for _ in range(n))
    rows = []
    for host, own, common in [("a", 60, 150), ("b", 30, 200), ("c", 30, 200), ("d", 10, 400), ("e", 100, 40)]:
        passage = prose(common)
        rows += [(len(rows) + k, f"{prose(own)}\n{passage}", "en", host, 0) for k in range(60)]
    text = prose(70)
    rows += [(1000 + k, text.upper() if k % 2 else f" {text}\n", "en", "f", 0) for k in range(40)]
    return rows


def test_quality_counts_documents_that_share_a_long_passage(spark, shared):
    want = oracle(shared)
    assert {k for k, (removed, _) in want.items() if removed} == set(range(300)) and {k for k, v in want.items() if v[1]} == set(range(240, 300)) | set(range(1000, 1040))
    got = quality.quality_rules(spark.createDataFrame(shared, SCHEMA)).collect()
    assert {r.doc_id: (r.removed_words, r.kept) for r in got} == want


def test_rows_are_judged_one_by_one_whatever_their_ids_and_names(spark):
    body = lambda k: " ".join(f"word{k}x{j}" for j in range(60))
    notice = "accept all cookies"
    rows = [(k, f"{body(k)}\n{notice}", "en", "h", 0) for k in range(25)]
    rows += [(3, rows[3][1], "en", "h", 0), (3, body(90), "en", "h", 1), (None, f"{notice}\n{body(91)}", "en", "h", 2), (None, body(92), None, None, None)]
    clashing = {c: c for c in ("row", "number", "taken", "_lines", "lines", "host", "h", "left", "kept", "identity", "words", "a.b")}
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in clashing:
        docs = docs.withColumn(c, F.lit(c))
    out = quality.clean_documents(docs)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["a.b"]) for r in out.collect())
    want = sorted((k is None, k or 0, "\n".join(x for x in t.split("\n") if x != notice), "a.b") for k, t, *_ in rows)
    assert got == want
    verdicts = quality.quality_rules(docs).collect()
    assert len(verdicts) == len(rows) and all(r.kept for r in verdicts)
    assert sorted(r.removed_words for r in verdicts if r.doc_id == 3) == [0, 3, 3]


def test_a_long_line_of_a_large_host_goes_below_its_share(spark):
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    long, short = words("l", 12), words("s", 4)
    rows = [(k, "\n".join([words(k, 60)] + [long] * (k < 40) + [short] * (k < 40)), "en", "h", 0) for k in range(1200)]
    got = {r.doc_id: r.removed_words for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: 12 if k < 40 else 0 for k in range(1200)}
