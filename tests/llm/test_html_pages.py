"""Whole pages in the styles of common publishing systems, written by hand: how much of the article comes out, and how much else."""

import pytest

from parchmill.llm.html import main_text

PROSE = [
    "The river rose by two metres in a single night, and the lower town was under water before dawn.",
    "Nobody had expected it; the last flood of that kind was in 1954, when the old bridge fell.",
    "Volunteers carried sandbags until noon, while the fire service pumped cellars dry along Mill Street.",
    "The mayor said that a new wall, planned for years, would now be built \"without further delay\".",
    "Engineers disagree: a wall moves the water downstream, they say, where three villages lie lower still.",
]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li><li><a href='/w'>Weather</a></li></ul>"
COMMENT = "I live on Mill Street, and I can say that the pumps came far too late, as always."
PAGES = {
    "blog": f"<html><body class='home'><div id='page'><header id='masthead' class='site-header'><h1>My Blog</h1><nav>{MENU}</nav></header><div id='primary'><article id='post-7' class='post type-post hentry category-share'><h2 class='entry-title'>The flood</h2><div class='entry-content'>{BODY}</div></article><div id='comments' class='comments-area'><ol class='comment-list'><li><article class='comment-body'><p>{COMMENT}</p></article></li></ol></div></div><div id='secondary' class='widget-area sidebar'><section class='widget'><h3>Archive</h3><p>Read what we wrote in the months before this one, too.</p></section></div><footer><p>Proudly written by hand. All rights reserved, of course.</p></footer></div></body></html>",
    "server form": f"<html><body><form method='post' action='page.aspx' id='aspnetForm'><input type='hidden' name='state' value='abc'/><div id='top'>{MENU}</div><table><tr><td class='nav'>{MENU}</td><td><h2>The flood</h2>{BODY}</td></tr></table><div class='footer'>Legal notice. Contact us by mail, or by phone.</div></form></body></html>",
    "news": f"<body><div class='ad banner'>Buy a boat, now at half price. Only this week, only here.</div><main><h1>The flood</h1><div class='byline share'>By Ann Lee</div><div class='story-text'>{BODY}</div><div class='related'><h3>Related</h3><ul><li><a href='/a'>Bridge closed after storm, says the council</a></li><li><a href='/b'>What to do when water comes</a></li></ul></div></main><aside><p>Subscribe to our letter, it is free of charge, and it comes daily.</p></aside></body>",
    "old tables": f"<body><table width='100%'><tr><td colspan='2'><font size='5'>Town Gazette</font></td></tr><tr><td width='20%'>{MENU}</td><td><b>The flood</b><br>{'<br><br>'.join(PROSE)}</td></tr></table></body>",
    "wiki": f"<body><div id='mw-head'>{MENU}</div><div id='content'><h1>The flood</h1><div id='bodyContent'><div class='toc'><ul><li><a href='#a'>Course</a></li><li><a href='#b'>After</a></li></ul></div>{BODY}</div></div><div id='footer'><ul><li>This page was last edited on Monday, at noon.</li></ul></div></body>",
    "app": f"<body><div id='root'><div class='css-1x'><div class='css-2y'>{MENU}</div><div class='css-3z'><div class='css-4q'><h1>The flood</h1></div><div class='css-5r'>{''.join(f'<div class=css-6s><span>{x}</span></div>' for x in PROSE)}</div></div><div class='css-7t'>Cookies help us. By going on you agree.</div></div></div></body>",
    "forum question": f"<body><div class='topbar'>{MENU}</div><div id='question'><h1>The flood</h1><div class='post-text'>{BODY}</div></div><div class='comments'><p>{COMMENT}</p></div><form id='post-form'><h2>Your answer</h2><p>Be kind, be brief, and do not shout.</p><textarea></textarea></form></body>",
    "story and related": f"<body><article class='story related'><h1>The flood</h1>{BODY}</article><div class='footer'>All rights reserved 2024</div></body>",
    "shared post": f"<body><nav>{MENU}</nav><article class='post share'><h1>The flood</h1>{BODY}</article><form class='search'><label>Search this site, or ask us by mail.</label></form></body>",
}


def measured(page):
    want, got = "The flood " + " ".join(PROSE), main_text(page)
    words = got.split()
    have = set(want.split())
    right = sum(w in have for w in words)
    return right / max(1, len(words)), len(have & set(words)) / len(have)


@pytest.mark.parametrize("kind", PAGES)
def test_pages(kind):
    precision, recall = measured(PAGES[kind])
    print(kind, round(precision, 2), round(recall, 2))
    assert recall >= 0.95 and precision >= 0.85, main_text(PAGES[kind])


def test_a_wrapping_form_competes_and_a_small_one_does_not():
    small = "<form><p>Name, please. And an address, if you like.</p></form>"
    assert "Name" not in main_text(f"<body><div>{BODY}</div>{small}</body>")
    assert main_text(f"<body><form>{BODY}</form></body>").count("\n") == 4
    assert main_text(f"<body><div role='form'>{BODY}</div></body>").count("\n") == 4
    # Forms that only together hold most of the text are forms.
    assert "Name" not in main_text(f"<body><div><p>{PROSE[0]}</p></div>{small * 3}</body>")


def test_comments_that_are_articles():
    comments = f"<article class='comment'><p>{COMMENT}</p></article>" * 6
    for page in (f"<article>{BODY}</article>{comments}", f"<div class='text'>{BODY}</div>{comments}", f"<article class='post'>{BODY}</article><div>{comments}</div>"):
        assert "pumps came" not in main_text(f"<body>{page}</body>")
