"""Pieces of torn runs: those that are words pass the table of bits, and hardly any others leave a document."""

import random

import pytest
from pyspark.sql import functions as F

from parchmill.operators import garble as G


def pieces(text):
    stretches = [p.lower() for a, b in G.torn_runs(text, "\n\n") for p in G.letters_of(text[a:b]) if p[0].isalnum() or p[0] == "_"]
    return {p[i:j] for p in stretches for i in range(len(p)) for j in range(i + 1, min(i + G.LONGEST_WORD, len(p)) + 1)}


@pytest.fixture(scope="module")
def vocabulary():
    r = random.Random(5)
    return sorted({"".join(r.choices("abcdeéß𝒜", k=r.randint(1, 9))) for _ in range(20_000)} | {"a" * G.LONGEST_WORD, "b" * (G.LONGEST_WORD + 1)})


def test_possible_words(spark, vocabulary):
    r = random.Random(6)
    bits = G.word_bits(spark.createDataFrame([(w, 1) for w in [*vocabulary, "", None]], "word string, n long"))
    texts = ["", "plain words", " ".join("a" * 40), "\n\n".join("b" * 40)] + [" ".join("".join(r.choices([*vocabulary, "zq", "-"], k=60))) for _ in range(20)]
    sent = every = 0
    for t in texts:
        got, want = G.possible_words(t, "\n\n", bits), pieces(t)
        assert want & set(vocabulary) <= got <= want
        sent, every = sent + len(got - set(vocabulary)), every + len(want)
    assert every > 50_000 and sent < every / 1000


def test_a_full_table_of_bits_changes_nothing(spark, vocabulary, monkeypatch):
    r = random.Random(7)
    words = [w for w in vocabulary if len(w) > 3]
    rows = [(k, " ".join(r.choices(words, k=200))) for k in range(20)] + [(k, "\n\n".join(" ".join("".join(r.choices(words, k=12))) for _ in range(3))) for k in range(20, 40)]
    df = spark.createDataFrame(rows, "id int, text string")
    want = sorted(map(tuple, G.healed(df).collect()))
    assert "healed" in {x[3] for x in want}
    full = G.word_bits(spark.createDataFrame([("a", 1)], "word string, n long"))
    full[:] = 255
    monkeypatch.setattr(G, "word_bits", lambda counts: full)
    monkeypatch.setattr(G, "COMMON", 3)
    assert sorted(map(tuple, G.healed(df).collect())) == want
    assert [r.action for r in G.healed(df.where("id = 20"), protected=F.lit(True)).collect()] == ["excluded"]
