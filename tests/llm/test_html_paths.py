"""HTML extraction against a plain version of the path ratios on generated trees, and on pages that are hard to read."""

import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from parchmill.llm import html

INLINE = ("b", "a")


def tree(r, depth=0):
    """(tag, class, children) or a text."""
    words = lambda n: " ".join(r.choice(["some", "word", "more,", "end.", "so;", "it"]) for _ in range(n))
    tag = r.choice(["div", "p", "section", "article", "div", "ul"] if depth < 3 else ["p"])
    name = r.choice(["", "", "", "post", "comments", "ad-box", "related-work", "side"])
    if tag == "ul":
        return (tag, name, [("li", "", [words(r.randint(1, 6))]) for _ in range(r.randint(1, 4))])
    if tag == "p":
        return (tag, name, [x for _ in range(r.randint(1, 2)) for x in (words(r.randint(1, 25)), (r.choice(INLINE), "", [words(r.randint(1, 4))]))])
    return (tag, name, [tree(r, depth + 1) for _ in range(r.randint(1, 4))])


def render(x):
    return f" {x} " if isinstance(x, str) else f'<{x[0]} class="{x[1]}">' + "".join(map(render, x[2])) + f"</{x[0]}>"


def plain_blocks(x, path, out):
    """One block for each p or li, its path the one of its first text."""
    path = [*path, x[:2]]
    if x[0] in ("p", "li"):
        text = " ".join(re.sub("<[^>]*>", " ", render(x)).split())
        out.append((tuple(path), text, sum(len(c[2][0]) for c in x[2] if not isinstance(c, str) and c[0] == "a")))
    else:
        for c in x[2]:
            plain_blocks(c, path, out)


def plain_text(blocks):
    factor = {"comments": 0.01, "side": 0.01, "ad-box": 0.01, "related-work": 0.5}
    groups, weights, boxes, content = defaultdict(list), {}, {}, {}
    for path, text, linked in blocks:
        groups[path].append((text, linked))
        w, inside, box = 1.0, False, ()
        for k, (tag, name) in enumerate(path, 1):
            w *= factor.get(name, 1.0)
            if tag == "article" or (not inside and tag in ("div", "section")):
                box = path[:k]
            inside |= tag == "article"
        weights[path], boxes[path], content[path] = w, box, inside
    fused = {}
    for p, rows in groups.items():
        n = len(rows)
        length = sum(max(0, len(t) - a) for t, a in rows) / n
        marks = sum(len(re.findall("[.,;]", t)) if 2 * a <= len(t) else 0 for t, a in rows) / n
        fused[p] = (4 if content[p] else 1) * length * (1 + marks) * n**0.5
    best = {b: max(weights[p] * fused[p] for p in groups if boxes[p] == b) for b in set(boxes.values())}
    own = lambda p: sum(max(0, len(t) - a) for t, a in groups[p]) >= sum(a for _, a in groups[p])
    smooth = {p: weights[p] * (fused[p] + (0.3 * best[boxes[p]] if content[p] or own(p) else 0)) for p in groups}
    top = max(smooth.values(), default=0)
    return "\n".join(t for p, t, _ in blocks if not top or smooth[p] >= 0.1 * top)


def test_paths_equal_a_plain_version():
    r = random.Random(12)
    whole = 0
    for _ in range(400):
        x = ("div", "", [tree(r) for _ in range(4)])
        blocks = []
        plain_blocks(x, [], blocks)
        want = plain_text(blocks)
        assert html.main_text(render(x)) == want
        whole += want != "\n".join(t for _, t, _ in blocks)
    assert whole > 100


def test_names_hint_and_do_not_decide():
    text = "<p>Some long text, with marks. And more of it, indeed.</p>" * 5
    page = f"<div class='menu-x'>Home page now</div><div class='post share-friendly'><h1>Title</h1>{text}</div><div>scrap one</div>"
    assert html.main_text(page).split("\n")[0] == "Title" and "scrap" not in html.main_text(page)
    page = f"<article><h1>T</h1>{text}<section class='related-work'><h2>Related</h2><p>Others wrote, too. Much of it.</p></section><div class='share'>Tweet this</div><div class='comments'><p>Nice one, I like it.</p></div></article>"
    assert html.main_text(page).endswith("Related\nOthers wrote, too. Much of it.")
    assert html.main_text("<div class=sidebar><p>All there is, here.</p></div>") == "All there is, here."


def test_deep_and_long_pages_take_time_in_proportion():
    begin = time.time()
    assert html.main_text("<div>x" * 50_000).count("x") == 50_000
    assert html.main_text("<b>x" * 50_000).count("x") == 50_000
    assert html.main_text("<li>x</b>" * 50_000).count("x") == 50_000
    assert html.main_text("<p>a b</p>" * 100_000).count("a b") == 100_000
    assert time.time() - begin < 30


def test_ties_repeated_rows_nulls_and_clashing_names(spark):
    page = "<div><p>one, two.</p></div><section><p>one, two.</p></section>"
    rows = [(1, "u", page, "old"), (1, "u", page, "old"), (None, None, None, None), (2, "", "", "")]
    out = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("_html", F.lit("x")))
    assert out.columns == ["page_id", "url", "_html", "text"]
    assert sorted(r.text for r in out.collect()) == ["", "", "one, two.\none, two.", "one, two.\none, two."]
