"""Torn texts: the signs against plain loops, the words against every possible cut."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from parchmill.operators import garble as G


def plain(text, separator):
    blocks = [b.strip() for b in (text or "").split(separator) if b.strip()]
    shards = longest = run = exploded = 0
    for b in blocks:
        if len(b) <= 2:
            shards, run = shards + 1, run + 1
            longest = max(longest, run)
            continue
        run = lone = 0
        for token in b.split():
            lone = lone + 1 if len(token) == 1 else 0
            if lone >= 6:
                exploded += 1
                break
    short = best = 0
    for token in (text or "").split():
        bare = token.strip(G.EDGE_MARKS)
        short = short + 1 if bare.isalpha() and len(bare) <= 2 else 0
        best = max(best, short)
    return len(blocks), shards, longest, exploded, exploded >= 2 or (exploded >= 1 and longest >= 3) or longest >= 6, best


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    fixed = [None, "", " \n\n ", "C\n\nE\n\nO", "M o r w a n d L i m i t e d o\n\nC\n\nE\n\nO\n\nplain words", "C O N F I D E N T I A L\n\nof the parties", "a b c d e f\n\ng h i j k l", "1\n\n2\n\n3\n\n4\n\n5\n\n6", "IN WI TN ES S WH ER EO F", "N D A", "é ü (x) ¿ 中 ; - -\n\nab\n\n\n\ncd"]
    return fixed + ["".join(r.choice(["a", "bc", " ", " ", "\n\n", "\n", "word", ".", "é "]) for _ in range(r.randint(1, 60))) for _ in range(150)]


def test_signs(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for r in G.assessed(df).collect():
        assert (r.paragraphs, r.shard_count, r.longest_shard_run, r.exploded_count, r.garbled, r.short_run) == plain(r.text, "\n\n"), r.text


def test_runs_are_where_the_signs_are(texts):
    for t in texts:
        runs = G.torn_runs(t or "")
        assert runs == sorted(runs) and all(a < b for a, b in runs)
        _, _, longest, exploded, _, _ = plain(t, "\n\n")
        assert bool(runs) == (longest >= 3 or exploded > 0)


def cost(words, counts, total):
    return sum(math.log(total / counts[w.lower()]) if w.lower() in counts else math.log(total) + (len(w) - 1) * math.log(10) for w in words)


def test_best_words_against_every_cut():
    r = random.Random(8)
    for _ in range(300):
        letters = "".join(r.choice("abcE") for _ in range(r.randint(1, 11)))
        counts = {"".join(r.choice("abce") for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(12)}
        total = float(sum(counts.values()))
        got = G.best_words(letters, counts, total)
        assert "".join(got) == letters
        cuts = itertools.product([False, True], repeat=len(letters) - 1)
        best = min(cost(["".join(x) for x in split(letters, c)], counts, total) for c in cuts)
        assert cost(got, counts, total) == pytest.approx(best)


def split(letters, cuts):
    out = [[letters[0]]]
    for x, cut in zip(letters[1:], cuts, strict=True):
        if cut:
            out.append([])
        out[-1].append(x)
    return out


WORDS = "confidential information disclosed by either party under this agreement shall remain secret for five years unless the law of england requires otherwise".split()


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    clean = [" ".join(r.choice(WORDS) for _ in range(40)) + "." for _ in range(60)]
    torn = []
    for _ in range(20):
        lines = [" ".join(r.choice(WORDS) for _ in range(8)).capitalize() + "." for _ in range(3)]
        torn.append((lines, "\n\n".join([" ".join("".join(x.split())) for x in lines] + ["under this agreement"])))
    rows = [(k, t, False) for k, t in enumerate(clean)] + [(100 + k, t, k == 0) for k, (_, t) in enumerate(torn)]
    rows += [(200, None, False), (201, "\n\n".join("ceo"), False), (202, "q x z q x z q x z q x z " * 5 + "\n\n" + "z q x z q x z " * 9, False), (203, "\n\n".join("confidential"), False), (203, "\n\n".join("confidential"), None)]
    return torn, spark.createDataFrame(rows, "id int, text string, approved boolean")


def test_healing(corpus):
    torn, df = corpus
    rows = G.healed(df, protected=F.col("approved")).select("id", "text", "action", "healed").collect()
    got = {r.id: r for r in rows}
    assert len(rows) == df.count()
    assert got[100].action == "excluded" and got[100].healed is None
    right = total = 0
    for k, (lines, _) in enumerate(torn[1:], 101):
        assert got[k].action == "healed"
        want, have = "\n\n".join(lines).split(), got[k].healed.split()
        assert have[-3:] == ["under", "this", "agreement"] and not plain(got[k].healed, "\n\n")[4]
        right += sum(a == b for a, b in zip(want, have, strict=False))
        total += len(want)
    assert right / total > 0.97
    assert {got[k].action for k in range(60)} == {"not_garbled"} and got[200].action == "not_garbled"
    assert got[201].action == "not_garbled"  # three shards alone are no sign
    assert [r.healed for r in rows if r.id == 203] == ["confidential"] * 2
    assert got[202].action == "still_garbled" or not plain(got[202].healed, "\n\n")[4]


def test_nothing_to_heal(spark):
    df = spark.createDataFrame([], "text string")
    assert G.healed(df).collect() == []
    assert [r.action for r in G.healed(spark.createDataFrame([(None,)], "text string")).collect()] == ["not_garbled"]


def test_long_runs_pass_in_windows(spark):
    text = " ".join("".join(random.Random(2).choices(WORDS, k=900))) + "\n\n" + " ".join("agreement")
    counts = spark.createDataFrame([(w, 5) for w in WORDS], "word string, n long")
    out = G.healed(spark.createDataFrame([(text,)], "text string"), counts=counts).first()
    known = {w: 5 for w in WORDS}
    assert out.healed == G.mended(text, known, float(5 * len(WORDS))) and len(set(out.healed.split()) - set(WORDS)) < 3
