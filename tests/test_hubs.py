"""Each hub rule finds its page and leaves one beside it alone."""

from __future__ import annotations

import pytest

from newsweft.operators import hubs as H

COLUMNS = "page_id long, url string, title string, hint string, title_source string, replaced_title string, articles int, articles_with_h1 int, most_article_chars long, chars long, links long, selector string, body string, dated boolean, embedded_links int"
PLAIN = dict(
    url="https://x.org/news/2024/05/council-votes-on-the-new-plan", title="Council votes on the new plan for the bridge", hint=None, title_source="page", replaced_title=None, articles=1, articles_with_h1=1, most_article_chars=3000, chars=3000, links=3, selector="article", body="Text", dated=True,
    embedded_links=0,
)
MANY = "read more and " * 7
PAGES = {
    "weak_collection": [(dict(title="View all stories"), dict(title="View of the old harbour stories told by those who sailed")), (dict(title="The Blog"), dict(title="The blog 2")), (dict(title="Latest Acme news"), dict(title="Acme: the news")), (dict(url="https://x.org/a/data-tools", title="Data tools - Acme blog"), dict(url="https://x.org/a/other", title="Data tools - Acme blog"))],
    "short_multi_article": [(dict(url="https://x.org/oil-and-gas", title="Oil & Gas", articles=4, chars=499), dict(url="https://x.org/oil-and-gas", title="Oil & Gas", articles=3, chars=499)), (dict(url="https://x.org/gas", title="Gas", articles=10, links=20), dict(url="https://x.org/gas", title="Gas", articles=10, links=19, chars=9000))],
    "listing_hint_over_collection": [(dict(url="https://x.org/insights", articles=4, title_source="listing_anchor", replaced_title="Insights"), dict(url="https://x.org/insights", articles=4, title_source="page", replaced_title="Insights"))],
    "card_grid": [(dict(articles=10, articles_with_h1=0, most_article_chars=999), dict(articles=10, articles_with_h1=0, most_article_chars=1000))],
    "multi_heading_card_grid": [(dict(articles=10, articles_with_h1=4, chars=1499), dict(articles=10, articles_with_h1=3, chars=1499))],
    "shallow_hub": [
        (dict(url="https://x.org/news/energy", links=10, body="Showing posts 1 to 10"), dict(url="https://x.org/news/energy/x", links=10, body="Showing posts 1 to 10")),
        (dict(url="https://x.org/news/energy", title="Energy", articles=4, hint="All Energy"), dict(url="https://x.org/news/energy", title="Energy", articles=4, hint="All power", dated=True)),
        (dict(url="https://x.org/news/energy", title="Energy", chars=900, body="Featured articles. Previous page. Next page."), dict(url="https://x.org/news/energy", title="Energy", chars=1000, body="Featured articles. Previous page. Next page.")),
        (dict(url="https://x.org/press/topic", title="A topic", articles=0, articles_with_h1=0, most_article_chars=0, selector=H.CLUSTER, links=8, body=MANY), dict(url="https://x.org/press/topic", title="A topic", articles=0, articles_with_h1=0, selector=H.CLUSTER, links=7, body=MANY)),
        (dict(url="https://x.org/press/topic", title="A topic", articles=1, articles_with_h1=0, most_article_chars=9, chars=1900, links=15, body="Read article " * 4), dict(url="https://x.org/press/topic", title="A topic", articles=1, articles_with_h1=0, most_article_chars=9, chars=1900, links=15, body="Read article " * 3)),
    ],
    "breadcrumb_title": [(dict(url="https://x.org/a/news/oil-gas/x-1", title="News oil gas well opens"), dict(url="https://x.org/a/news/oil-gas/x-1", title="News oil gas one two three four five six seven")), (dict(url="https://x.org/blog/2024/x", title="Blog 2024 x"), dict(url="https://x.org/blog/x", title="Blog x"))],
    "localized_root": [(dict(url="https://x.org/news/fr/?lang=fr"), dict(url="https://x.org/news/fr?lang=fr")), (dict(url="https://x.org/blog/pt-br/", title="Acme Blog"), dict(url="https://x.org/blog/ptbr/", title="Acme Blog"))],
    "counted_taxonomy": [(dict(url="https://x.org/blog/energy", title="Energy (12)", links=100, chars=90000), dict(url="https://x.org/blog/energy", title="Energy (1200)", links=100, chars=90000))],
    "high_link_density": [(dict(title="Energy", links=20, chars=1333), dict(title="Energy", links=20, chars=1334)), (dict(title="Energy", links=50, chars=6250, dated=False, selector=H.CLUSTER), dict(title="Energy", links=50, chars=6250, selector=H.CLUSTER))],
    "undated_short_slug_topic": [(dict(url="https://x.org/a/people", title="People", chars=399, dated=False), dict(url="https://x.org/a/people", title="People", chars=399))],
    "undated_listing_anchor": [(dict(title="Some page", title_source="listing_anchor", links=10, chars=1000, dated=False), dict(title="Some page", title_source="listing_anchor", links=10, chars=1001, dated=False))],
    "undated_embedded_navigation": [(dict(title="Some page", embedded_links=8, dated=False), dict(title="Some page 2", embedded_links=8, dated=False))],
    "year_archive": [
        (dict(url="https://x.org/news/2024/03", title="March 2024"), dict(url="https://x.org/news/2024/04", title="March 2024")), (dict(url="https://x.org/press/2024", title="2024 | Acme Works"), dict(url="https://x.org/press/2024", title="2023 | Acme Works")), (dict(url="https://x.org/press/2024", title="News 2024"), dict(url="https://x.org/press/2024", title="News of 2024 from the plant")),
        (dict(url="https://x.org/press/2024", title="Acme archive"), dict(url="https://x.org/press/20x4", title="Acme archive")), (dict(url="https://x.org/press/2024", title="Acme Newsroom"), dict(url="https://x.org/press/2024", title="A Acme B C Newsroom")),
    ],
}


def test_each_rule_finds_its_page_and_no_other(spark):
    cases = [(rule, k, hit) for rule, pairs in PAGES.items() for k, pair in enumerate(pairs) for hit in (0, 1)]
    rows = [tuple({"page_id": i, **PLAIN, **PAGES[rule][k][hit]}[c.split()[0]] for c in COLUMNS.split(", ")) for i, (rule, k, hit) in enumerate(cases)]
    got = {r["page_id"]: r["detectors"] for r in H.hub_verdicts(spark.createDataFrame(rows, COLUMNS)).collect()}
    wrong = [(rule, k, "should fire" if hit == 0 else "should not", got[i]) for i, (rule, k, hit) in enumerate(cases) if (rule in got[i]) != (hit == 0)]
    assert wrong == [] and set(PAGES) == set(H.detectors())


@pytest.mark.parametrize("change", [{}, dict(title=None), dict(url=None), dict(body=None, hint="", replaced_title="")])
def test_articles_and_missing_values_are_no_hubs(spark, change):
    row = tuple({"page_id": 1, **PLAIN, **change}[c.split()[0]] for c in COLUMNS.split(", "))
    assert H.hub_verdicts(spark.createDataFrame([row], COLUMNS)).first()["detectors"] == []
