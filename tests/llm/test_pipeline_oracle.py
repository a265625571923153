"""The pipeline's stages, one by one and together, against plain Python on a corpus with every kind of case."""

import random
import re
import zlib

import pytest

import corpus_pipeline
from parchmill.llm import quality
from parchmill.session import settled, tokenizer_path
from tests.llm.test_ngram_groups import components
from tests.llm.test_quality_documents import SCHEMA, form, oracle

WORD = re.compile("[^\x20\x09-\x0d]+")
MAIL = "jo.ann@mail.example.org"


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(21)
    prose = lambda n: " ".join("".join(r.choice("abdegikmnorstu") for _ in range(r.randint(2, 9))) for _ in range(n))
    notice = "We use cookies on this site to make it better for you"
    texts = []
    for k in range(60):  # a host whose pages end with a notice, some with little else
        texts.append(f"{prose(70 if k % 6 else 40)}\n{notice}" + f"\n{notice}" * (6 if k % 6 == 0 else 0))
    for _ in range(6):  # copies and near copies
        base = prose(90).split()
        for k in range(8):
            x = list(base)
            for _ in range(k // 2):
                x[r.randrange(90)] = r.choice(base)
            texts.append(" ".join(x))
    texts += [f"{prose(60)} write to {MAIL} or 10.0.0.7 {prose(5)}", prose(3000), "short one", None, "", "echo " * 80, "line of words\n" * 60]
    rows = [(k, t, "en", "h" if k < 60 else "g", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[60], rows[5], (None, prose(60), "en", None, 7), (None, None, None, None, None)]


def cleaned(rows):
    """Rows that the quality rules keep, with their common lines out."""
    known = [(n, t or "", lang, host or "", c) for n, (_, t, lang, host, c) in enumerate(rows)]
    verdict = oracle(known)
    counts = {}
    for _, t, _, host, _ in known:
        for line in {form(x) for x in t.split("\n") if WORD.search(x)}:
            counts.setdefault((host, line), set()).add(form(t))
    hosts = {}
    for _, t, _, host, _ in known:
        hosts.setdefault(host, set()).add(form(t))
    common = {k for k, v in counts.items() if len(v) >= 20 and (len(v) >= 0.05 * len(hosts[k[0]]) or (len(k[1].split()) >= quality.LONG_LINE and len(v) ** 2 >= len(hosts[k[0]])))}
    out = []
    for (n, t, lang, host, _), row in zip(known, rows, strict=True):
        if verdict[n][1]:
            lines = t.split("\n")
            left = "\n".join(x for x in lines if (host, form(x)) not in common)
            out.append((row[0], left, lang, row[3], len(left) if left != t else row[4]))
    return out


def deduplicated(rows):
    named = sorted({r[0]: r for r in rows if r[0] is not None}.values())
    component = components([r[1] for r in named], 5, 80)
    return [r for k, r in enumerate(named) if component[k][1] == k] + [r for r in rows if r[0] is None]


def masked(rows):
    out = []
    for r in rows:
        text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<EMAIL>", r[1]).replace("10.0.0.7", "<IP>")
        out.append((*r[:1], text, *r[2:4], len(text) if text != r[1] else r[4]))
    return out


def ordered(rows):
    return sorted(map(str, map(tuple, rows)))


def test_stages_equal_plain_python(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(corpus, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, stages = corpus, dict(corpus_pipeline.STAGES)
    for name, plain in (("quality_rules", cleaned), ("ngram_jaccard_join", deduplicated), ("personal_data", masked)):
        docs, before = settled(stages[name](spark, docs, str(tmp_path)), name), len(want)
        want = plain(want)
        assert ordered(docs.collect()) == ordered(want), name
        assert len(want) < before or name == "personal_data"
    assert not any(MAIL in r[1] for r in want) and any("<EMAIL>" in r[1] and "<IP>" in r[1] for r in want)
    library = Tokenizer.from_file(tokenizer_path())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces, lengths = [], []
    for doc, text, *_ in want:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces.append((doc, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))))
            lengths.append(b - a)
    assert ordered((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == ordered(pieces)
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 1024) - n)
    assert len({r.sequence_id for r in packed}) == len(rooms)


def test_stages_on_nothing_and_with_more_columns(spark, corpus):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(corpus[:3] + corpus[60:70] + corpus[-3:], SCHEMA)
    for c in ("label", "doc", "sig", "row", "number", "pii", "sequence_id", "_pii", "_masked"):
        some = some.withColumn(c, some["lang"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").count() == 0 and stage(spark, empty, "").columns == empty.columns
        out = stage(spark, some, "")
        rows = out.collect()
        assert out.columns == some.columns and rows, name
        assert all({r[c] for c in some.columns[5:]} == {r["lang"]} for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0
