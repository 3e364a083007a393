"""Article pages in layouts written by hand, with the exact text that each must give, and pages without an article."""

from __future__ import annotations

import itertools

import pytest

from newsweft.llm import htmlmain

P = "The council met on Tuesday to vote on the plan, which had been delayed twice. Members said that the new route would cost less."
Q = "After the vote the mayor thanked the members and said that work on the bridge begins in May."
WANT = f"Vote held\n{P}\n{Q}"
INNER = f"<h1>Vote held</h1><p>{P}</p><p>{Q}</p>"
NAV, FOOT = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></nav>', "<footer><p>Copyright 2024 Site</p></footer>"
SIDE = '<div class="sidebar"><h3>More</h3><ul><li><a href="/1">One story</a></li><li><a href="/2">Two stories</a></li></ul></div>'
TALK = '<section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this vote at all, it costs too much.</p></div></section>'

#: Opening and closing tags around the article.
BOXES = [
    ('<article class="post-12 post type-post hentry category-legal">', "</article>"), ('<article class="legal">', "</article>"), ('<article class="post newsletter">', "</article>"), ('<div class="content no-sidebar">', "</div>"), ("", ""), ("<div><div>", "</div></div>"),
    ("<article>", "</article>"), ("<main>", "</main>"), ('<main id="main" class="site-main">', "</main>"), ('<article class="story tag-advert tag-menu">', "</article>"), ('<article class="entry social">', "</article>"), ('<article class="popular">', "</article>"), ('<main class="tabs">', "</main>"),
    ('<article id="post-9" class="post-9 post status-publish format-standard has-post-thumbnail category-newsletter tag-footer">', "</article>"), ('<div class="post-content">', "</div>"), ('<div class="entry-content has-sidebar">', "</div>"), ('<div id="content" class="with-sidebar">', "</div>"),
    ('<div class="container"><div class="article-body">', "</div></div>"), ('<div class="wrapper"><main><article class="hentry">', "</article></main></div>"), ("<main><div><div>", "</div></div></main>"), ('<section class="story">', "</section>"), ("<section><article>", "</article></section>"),
    ('<div role="main">', "</div>"), ('<div itemprop="articleBody" class="richtext">', "</div>"), ('<article class="notice">', "</article>"), ('<article class="blog-post trending">', "</article>"),
]


@pytest.mark.parametrize("box,around", [*itertools.product(range(len(BOXES)), ["nav and footer", "side and comments"])])
def test_article_layouts(box, around):
    before, after = BOXES[box]
    talk = (SIDE + TALK) if around == "side and comments" else ""
    assert htmlmain.extract(f"<html><body>{NAV}{before}{INNER}{after}{talk}{FOOT}</body></html>") == WANT


@pytest.mark.parametrize(
    "page,want",
    [
        ("<body><div><div><div>Vote held yesterday in the hall. The members agreed.</div></div></div></body>", "Vote held yesterday in the hall. The members agreed."),
        ("<p>Vote held yesterday in the hall.</p>", "Vote held yesterday in the hall."),
        ("<body><h1>Vote held</h1><p>The members agreed.</p></body>", "Vote held\nThe members agreed."),
        (f"<body>{NAV}{FOOT}</body>", ""),
        ('<body><div class="cookie-banner"><p>We use cookies to improve this site for you.</p></div></body>', ""),
        ("<body><form><p>Search this site</p></form></body>", ""),
        ("<body></body>", ""),
    ],
)
def test_short_pages_and_pages_without_an_article(page, want):
    assert htmlmain.extract(page) == want


def test_chance_of_no_text_matches_enumeration():
    page, m = htmlmain.parse('<div class="post newsletter"><p>some words in here</p><div class="ad"><p>buy</p></div></div>'), htmlmain.default_model()
    n, none, total = len(page.parent), 0.0, 0.0
    for ys in itertools.product((0, 1), repeat=n):
        p = m.root[ys[0]]
        for i in range(n):
            if i:
                p *= m.edge[htmlmain._edge(page.kind[i], page.group[i])][ys[page.parent[i]]][ys[i]]
            p *= m.emit[0][page.group[i]][ys[i]] * m.emit[1][page.kind[i]][ys[i]] * m.emit[2][htmlmain._size_bin(page.chars[i], page.linked[i])][ys[i]]
        total += p
        none += p * (not any(y and page.chars[i] for i, y in enumerate(ys)))
    assert m.without_text(page) == pytest.approx(none / total, rel=1e-9)


def test_words_of_subjects_and_looks_say_nothing():
    kinds = [k for k, _ in htmlmain._KINDS]
    kind = lambda names, tag="div": htmlmain.parse(f'<{tag} class="{names}">x</{tag}>').kind[1]
    assert kind("category-legal no-sidebar has-menu") == htmlmain._NO_KIND and kinds[kind("tags")] == "side" and kinds[kind("category-legal post")] == "content"
    assert htmlmain._kinds_in(kind("post newsletter")) == sorted(kinds.index(k) for k in ("content", "notice"))
    assert htmlmain._kinds_in(kind("comment", "article")) == [kinds.index("comment")] and htmlmain._kinds_in(kind("legal", "article")) == [kinds.index("foot") + htmlmain._ON_REGION]
