"""The training-data operators against brute-force versions, the public library and exact round trips, on small tables
with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill.llm import bpe, chat, embeddings, html, ngram_join, packing, pii, quality, urls, warc
from parchmill.llm.shingles import shingle_set
from parchmill.session import scratch_path, tokenizer_path

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abdegikmnorstu") for _ in range(r.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    out = [None, "", " \n\t ", "one", "ONE", "one two", "é ß \U0001f600", prose(3000), "x" * 5000, "line\n" * 80, "<|endoftext|> a<|endoftext|>"]
    for _ in range(12):
        base = prose(r.randint(20, 120)).split()
        out.append(" ".join(base))
        for _ in range(r.randint(1, 30)):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(" ".join(copy))
    out += [f"{prose(5)} {passage} {prose(5)}" for _ in range(40)]
    out += ["".join(r.choice("ab \n\té漢字'12_!") for _ in range(r.randint(0, 60))) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(k, t, "en", "a" if k % 3 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_the_library(documents, texts, library):
    got = bpe.bpe_decode(bpe.bpe_encode(documents.withColumn("token", F.lit(1))), "token_ids").collect()
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.token_ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_packing_is_whole_and_tight(documents, texts, library):
    got = packing.pack_documents(documents).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for n, p in enumerate(sorted(by_doc[k], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (n, at)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    rooms = []  # plain best-fit decreasing
    for n in sorted((r.length for r in got), reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 1024) - n)
    assert len(by_sequence) == len(rooms)


def test_packing_plan_of_many_histograms():
    r = random.Random(1)
    for _ in range(50):
        capacity = r.randint(1, 40)
        counts = {r.randint(1, capacity): r.randint(1, 50) for _ in range(8)}
        steps, made = packing.plan(counts, capacity)
        rooms = []
        for n in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
            fit = [x for x in rooms if x >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - n)
        assert made == len(rooms)


def test_quality_figures(documents, texts):
    for r in quality.quality_rules(documents).collect():
        text = texts[r.doc_id] or ""
        own = WORD.findall(text)
        windows = Counter(tuple(own[k : k + 3]) for k in range(len(own) - 2))
        repeated = {j for k in range(len(own) - 2) if windows[tuple(own[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(own) < 50 or 100 * len(repeated) > 50 * len(own))


def test_quality_takes_common_lines_out(spark):
    body = lambda k: " ".join(f"uniqueword{k}x{j}" for j in range(60))
    rows = [(k, f"{body(k)}\nCookie  NOTICE here", "en", "host", 0) for k in range(30)]
    rows += [(100 + k, f"{body(100)}\n" + "Cookie notice here\n" * 40, "en", "host", 0) for k in range(2)]
    rows += [(200, None, None, None, None)]
    got = {r.doc_id: r for r in quality.clean_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == set(range(30))
    assert got[3].text == body(3) and got[3].n_chars == len(body(3))


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("small", [24, 2])
def test_jaccard_join_equals_brute_force(monkeypatch, documents, texts, size, percent, small):
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", small)
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    own = list(range(len(sets)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                own[high] = low
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents.withColumn("doc", F.lit(0)), size, percent).collect()}
    assert got == {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_signatures_of_every_linked_pair_meet():
    r = np.random.default_rng(2)
    for _ in range(300):
        n = int(r.integers(1, 200))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[r.random(len(a)) > 0.05], r.integers(0, 2**63, n // 20).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common and 100 * common >= 90 * (len(a) + len(b) - common):
            rare = lambda x: (x >> np.uint64(20)) % np.uint64(10) < 2
            s, t = (ngram_join.signatures(x, rare(x), 90)[0] for x in (a, b))
            assert np.array_equal(a, b) or len(np.intersect1d(s, t))


def test_sketches_never_overstate():
    r = np.random.default_rng(4)
    for _ in range(100):
        a, b = (np.unique(r.integers(0, 2000, int(r.integers(1, 900))).astype(np.uint64)) for _ in range(2))
        assert ngram_join.differing(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))
    assert len(shingle_set("a b c d", 3)) == 2


def test_keep_one(documents):
    kept = ngram_join.keep_one(documents.union(documents.where("doc_id < 3")))
    named = {r.component_id for r in ngram_join.near_duplicates(documents).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(named) and kept.columns == documents.columns


def test_chat(spark):
    calls = spark.createDataFrame(
        [(1, "a", 1, None, "f", '{"x": 1, "b": "é"}'), (1, "b", 2, "a", "f", '{"x":"no"}'), (1, "c", 3, "d", "f", None), (1, "d", 4, "c", "g", "{"), (1, "a", 9, "b", "f", "{}"), (1, None, 5, None, "f", "{}"), (2, "a", 1, "gone", None, "{}")],
        "conv_id long, call_id string, turn long, after string, name string, arguments string",
    )
    results = spark.createDataFrame([(1, "a", 3, "yes"), (1, "a", 2, "first"), (3, "z", 1, None)], "conv_id long, call_id string, turn long, content string")
    got = {(r.conv_id, r.call_id): r for r in chat.link_tools(calls, results, {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}).collect()}
    assert {k: (r.level, r.status, r.valid) for k, r in got.items()} == {
        (1, "a"): (0, "linked", True), (1, "b"): (1, "unanswered", False), (1, "c"): (None, "cyclic", False), (1, "d"): (None, "cyclic", False), (2, "a"): (0, "unanswered", False), (3, "z"): (None, "orphan", False),
    }
    assert got[1, "a"].record == '{"arguments":{"b":"é","x":1},"call_id":"a","level":0,"name":"f","result":"first","status":"linked","valid":true}'


def test_chat_of_a_long_chain(spark):
    calls = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").cast("string").alias("call_id"), F.col("id").alias("turn"), (F.col("id") - 1).cast("string").alias("after"), F.lit("f").alias("name"), F.lit("{}").alias("arguments"))
    results = calls.select("conv_id", "call_id", "turn", F.lit("r").alias("content")).where("false")
    assert {int(r.call_id): r.level for r in chat.link_tools(calls, results, {}).collect()} == {k: k for k in range(300)}


def test_urls_equal_brute_force(spark):
    r = random.Random(9)
    hosts = ["example.net", "www.Example.net", "notexample.net", "example.com", "a.b.example.com", "fr.org", "org", "x.org", "net", "", "com"]
    rows = [(k, f"{r.choice(['http', 'https', ''])}{r.choice(['://', '://', ':'])}{r.choice(hosts)}{r.choice(['/', '/en/x', '/de/', '/fr/y?q#z', '?a', '#b', '', '/d'])}") for k in range(300)] + [(900, None), (901, ""), (None, "http://x.net/"), (5, "http://x.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = sorted(map(str, urls.filter_urls(pages, spark.createDataFrame([*urls.RULES, (None, None)], "rule string, verdict string")).collect()))
    want = []
    for k, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(x), x, v) for x, v in urls.RULES for h, p in [(x.split("/")[0], "/" + x.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want.append(f"Row(page_id={k!r}, host={host!r}, path={path!r}, rule={rule!r}, verdict={verdict!r})")
    assert got == sorted(want)


def test_pii_patterns_equal_their_expressions():
    r = random.Random(8)
    pieces = ["a.b@c.de", "@", "x@y", "10.0.0.256", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (0)30 123456-78", "+1", ".", "-", " ", "é", "12", "\n", "7" * 20, "00000000000000"]
    for _ in range(2000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert pii.base_spans(text) == want, text


def test_pii_field_on_held_out_rows():
    rows = pii.labelled_rows(copies=2, seed=99)
    found = pii.trained(None).decode([t for t, _ in rows])
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, rows, strict=True))
    assert right >= 0.9 * sum(len(b) for _, b in rows) and right >= 0.9 * sum(map(len, found))


def test_pii_masks_and_passes_columns_through(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", "k"), (2, None, None), (3, "", "e"), (3, "call (555) 123-4567 today", "e")], "doc_id long, text string, kind string")
    got = pii.find_spans(docs, mask="masked").collect()
    assert [r.masked for r in got] == ["mail <EMAIL> now", None, "", "call <PHONE> today"] and [r.kind for r in got] == ["k", None, "e", "e"]


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    data = [(k, (base[k % 40] + r.normal(size=16) * (0.15 if k % 3 else 0.0)).tolist(), int(k % 2) if k % 17 else None) for k in range(400)]
    data += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] * 16, 1), (504, [None] * 16, 1), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("list", F.lit(1))).collect()}
    links = {k: set() for k, _, _ in data}
    usable = [(k, np.array(e), lab) for k, e, lab in data if lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    for k, x, a in usable:
        for j, y, b in usable:
            if k != j and a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[k].add(j)
    want = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        want[k] = (len(links[k]), min(seen), min(seen) == k)
    assert got == want


def test_html():
    page = "<html><head><title>t</title><script>x<y</script></head><body><nav><a href=/>Menu</a></nav><article><h1>A &amp; B</h1><p>Some  long\n text, with marks. And more.</p><ul><li>one<li>two</ul></article><div class=comments><p>Great post, really. I agree, a lot.</p></div><footer>foot</footer></body></html>"
    assert html.main_text(page) == "A & B\nSome long text, with marks. And more.\none\ntwo"
    assert [html.main_text(x) for x in (None, "", "<p>", "plain")] == ["", "", "", "plain"]


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u\nv", ""), (5, "http://c", "x" * 100_000), (None, "n", "<p>é</p>"), (1, "http://a", "<p>é</p>")]
    folder = scratch_path(spark, "warc")
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(0)), folder)
    got = sorted(warc.read_records(index, folder).collect(), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(k, u and u.replace("\n", "%0A"), "revisit" if k in (2, 4) else "response", {2: 1, 4: 3}.get(k), len((t or "").encode()), digest(t), None if k in (2, 4) else t or "") for k, u, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.read_records(index.where("page_id = 5"), folder).first().payload == "x" * 100_000


def test_empty_tables(spark, nothing):
    none = lambda s: spark.createDataFrame([], s)
    assert packing.pack_documents(nothing).count() == 0
    assert quality.quality_rules(nothing).count() == 0
    assert ngram_join.near_duplicates(nothing).count() == 0
    assert pii.find_spans(nothing).count() == 0
    assert bpe.bpe_encode(nothing).count() == 0
    assert embeddings.near_vectors(none("vec_id long, embedding array<float>, label int")).count() == 0
    assert html.extract_text(none("page_id long, url string, html string")).count() == 0
    assert urls.filter_urls(none("page_id long, url string"), none("rule string, verdict string")).count() == 0
    assert warc.write_archives(none("page_id long, url string, html string"), scratch_path(spark, "warc")).count() == 0


def test_packing_of_long_blanks_repeated_rows_and_clashing_names(spark, library):
    texts = [" " * 1_000_000, "a b", "a b", None, "x" * 3000]
    docs = spark.createDataFrame([(None, t, "en", None, 0) for t in texts], SCHEMA)
    got = packing.pack_documents(docs).collect()
    assert sum(r.length for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    ids = [*library.encode(texts[0], add_special_tokens=False).ids, 2]
    assert len(ids) == 1_000_001 and zlib.crc32(struct.pack("<1024I", *ids[-1024:])) in {r.ids_crc32 for r in got}
    pieces = spark.createDataFrame([(k, 1 + k % 9) for k in range(300)] + [(None, 3)] * 50, "row long, length long")
    for c in ("number", "group", "rank", "sequence_id", "offset", "before", "inside", "a.b"):
        pieces = pieces.withColumn(c, F.lit(c))
    out = packing.pack(pieces, capacity=10).collect()
    assert sorted(out[0].asDict()) == sorted(pieces.columns) and len(out) == 350 and {r["number"] for r in out} == {"number"}
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        ends = [a + b for a, b in sorted(own)]
        assert [0, *ends[:-1]] == [a for a, _ in sorted(own)] and ends[-1] <= 10


def test_chat_arguments_that_cannot_be_read():
    any_ = {"type": ["object", "array", "number"]}
    read = lambda text, schema=any_: chat.read_arguments(text, schema)
    assert read(r'{"a": "\ud800"}') == ({"a": "\ud800"}, True) and chat.canonical({"a": "\ud800é"}) == '{"a":"\\ud800é"}'
    for text in ["[" * 100_000 + "]" * 100_000, "[" * 900 + "NaN" + "]" * 900, '{"a": NaN}', "[Infinity]", "1e999", '{"a": 1, "a": 2}', "{", "", "﻿{}"]:
        assert read(text) == (text, False)
    assert read(None) == (None, False) and read("{}", None) == ({}, False)
    assert [read(t, {"enum": [1]})[1] for t in ("true", "1", "1.0", "2")] == [False, True, True, False]


def test_chat_of_empty_tables_nulls_and_clashing_names(spark):
    calls, results = "conv_id long, call_id string, turn long, after string, name string, arguments string", "conv_id long, call_id string, turn long, content string"
    none = spark.createDataFrame([], calls), spark.createDataFrame([], results)
    assert chat.link_tools(*none, chat.SCHEMAS).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", None), (2, 0, None, "x"), (None, 0, "user", "x"), (1, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = chat.link_tools(*(t.withColumn("level", F.lit("x")).withColumn("_call", F.lit("x")) for t in chat.turns_as_tools(turns)), chat.SCHEMAS).collect()
    assert [(r.conv_id, r.call_id, r.level, r.status, r.valid) for r in got] == [(1, "1:0", 0, "linked", False)]


def test_columns_of_the_new_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "old"), (2, None, None)], "doc_id long, text string, token_ids string")
    coded = bpe.bpe_encode(docs)
    assert coded.columns == ["doc_id", "text", "token_ids"] and [len(r.token_ids) for r in coded.collect()] == [8, 0]
    found = pii.find_spans(docs.withColumnRenamed("token_ids", "pii").withColumn("masked", F.lit(0)), mask="masked")
    assert found.columns == ["doc_id", "text", "pii", "masked"] and [r.masked for r in found.collect()] == ["a b", None]
