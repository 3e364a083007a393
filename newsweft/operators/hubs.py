"""Pages that list articles and are none: rules over what is counted on a page, one row a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import text as T
from newsweft.functions import urls as U
from newsweft.functions.names import let, listed
from newsweft.plans.catalog import query
from newsweft.plans.relations import Relations

# Folders under which articles stand.
ARTICLE_ROOTS = (
    "announcement", "announcements", "article", "articles", "blog", "blog-post", "blog-posts", "blogs", "changelog", "changelogs", "company-news", "engineering", "insights", "in-the-news", "investor-news", "journal",
    "latest-news", "market-announcements", "media-center", "media-centre", "media-room", "news-and-media", "news", "news-and-events", "news-events", "news-release", "news-releases", "newsroom", "press", "press-center",
    "press-centre", "press-room", "press-release", "press-releases", "pressreleases", "pressroom", "post", "posts", "research", "stories", "updates", "what-s-new", "whats-new",
)
# How titles of listings begin and end, and what listings of articles say.
LISTING_BEGINNINGS = ("browse all ", "recent ", "see all ", "view all ")
COLLECTION_NOUNS = ("articles", "blog", "coverage", "news", "press releases", "stories")
PRESS_ENDINGS = ("blog", "newsroom", "press", "press room", "presse", "espace presse")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CLUSTER = "generic:paragraph-cluster.v1"


def label_key(text: Column) -> Column:
    """Letters and digits in lower case without the word "and": what a label and a path segment share."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "and")
    return F.array_join(words, "")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def _begins(text: Column, *beginnings: str) -> Column:
    return text.rlike("^(" + "|".join(beginnings) + ")")


def with_shape(pages: DataFrame) -> DataFrame:
    """``pages`` with what the rules read of title and URL, worked out once: ``t`` (collapsed, lower case), ``n``, ``s`` (path segments), ``root`` (place of the first article folder, 0 without)."""
    shaped = pages.withColumns({"t": F.coalesce(F.lower(T.collapse(F.col("title"))), F.lit("")), "s": U.semantic_segments(F.col("url"))})
    root = F.filter(F.transform("s", lambda x, i: F.when(F.array_contains(listed(ARTICLE_ROOTS), x), i + 1)), lambda i: i.isNotNull())
    return shaped.withColumns({"n": n_words(F.col("t")), "last": F.coalesce(F.get("s", F.size("s") - 1), F.lit("")), "root": F.coalesce(F.get(root, F.lit(0)), F.lit(0)), "body_text": F.coalesce(F.lower(T.collapse(F.col("body"))), F.lit(""))})


def detectors(listings: tuple[str, ...] = T.LISTING_TITLES) -> dict[str, Column]:
    """The rules by name, over the columns of ``with_shape``: page_metrics and what is worked out of them."""
    c = F.col
    t, n, s, last, root, links, chars, body = c("t"), c("n"), c("s"), c("last"), c("root"), c("links"), c("chars"), c("body_text")
    worded, digits = t != "", t.rlike("[0-9]")
    below = (root > 0) & (F.size(s) == root + 1)
    cluster, undated = c("selector") == CLUSTER, ~c("dated")
    labelled = (last != "") & (label_key(t) == label_key(last))
    generic = lambda x: F.lower(T.collapse(x)).isin(*listings)
    dense = lambda bps: links * 1000 >= chars * bps

    separated = t.rlike(r" [|–—-] |: ")
    named_blog = t.rlike(r"^[^ ]+( [^ ]+)? - .* blog$") & (F.trim(F.regexp_replace(last, "[-_]", " ")) == F.split_part(t, F.lit(" - "), F.lit(1)))
    weak = worded & (n <= 6) & ~digits & ((t == "the blog") | _begins(t, *LISTING_BEGINNINGS) | (t.rlike(f" ({'|'.join(COLLECTION_NOUNS)})$") & ~separated) | named_blog)

    hint = F.coalesce(T.collapse(c("hint")), F.lit(""))
    short_hint = (hint != "") & (n_words(hint) <= 4) & ~hint.rlike("[0-9]")
    all_of = (c("articles") >= 4) & hint.rlike("(?i)^all ") & (label_key(F.substr(hint, F.lit(5))) == label_key(t)) & labelled
    bare = (c("articles") == 0) & (c("articles_with_h1") == 0)
    said = lambda words: F.regexp_count(body, F.lit(words))
    filtered = bare & (links >= 20) & body.contains("there is a lack of results to match selected filters") & body.contains("please adjust the filter options to broaden results")
    index = bare & (links >= 20) & F.startswith(body, F.lit("news releases topics media contacts "))
    titled = worded & (n <= 6) & ~digits
    grids = (
        all_of
        | ((c("articles") >= 10) & (chars < 1500) & cluster & short_hint)
        | ((chars < 1000) & body.contains("featured articles") & body.contains("previous page") & body.contains("next page"))
        | ((c("articles") <= 1) & (c("articles_with_h1") == 0) & (c("most_article_chars") < 1000) & (chars < 2000) & (links >= 15) & (said("read article") >= 4))
        | (bare & cluster & (links >= 8) & (said("read more") >= 7))
    )
    shallow = below & (((links >= 10) & F.startswith(body, F.lit("showing posts "))) | filtered | index | (titled & grids))

    section = F.concat(F.trim(F.regexp_replace(F.array_join(F.slice(s, F.greatest(root, F.lit(1)), F.greatest(F.size(s) - root, F.lit(0))), " "), "[-_]", " ")), F.lit(" "))
    rest = F.substr(t, F.length(section) + 1)
    breadcrumb = (root > 0) & (F.size(s) >= root + 2) & F.startswith(t, section) & (rest != "") & (n_words(rest) <= 6) & (n <= 10)

    asked = F.lower(U.query(c("url"))).rlike("(^|&)(lang|language|language_id|locale)(=|&|$)")
    local = below & last.rlike("^[a-z]{2}([-_][a-z]{2})?$") & U.path(c("url")).endswith("/") & (asked | (links >= 20) | t.rlike(f"(^| )({'|'.join(PRESS_ENDINGS)})$"))
    counted = (links >= 100) & below & (n <= 6) & (F.regexp_extract(t, r"\((\d{1,5})\)$", 1).try_cast("int") <= 1000)
    packed = (n <= 6) & (((links >= 20) & dense(15)) | (undated & cluster & (links >= 50) & dense(8)))
    topic = undated & worded & (n <= 4) & ~digits & labelled & (((n <= 3) & (chars < 400)) | ((links >= 8) & dense(8)))
    anchored = undated & (c("title_source") == "listing_anchor") & worded & (n <= 6) & (links >= 10) & dense(10)
    embedded = undated & (c("embedded_links") >= 8) & titled

    before = F.coalesce(F.get(s, F.size(s) - 2), F.lit(""))
    month = F.get(listed(MONTHS), last.try_cast("int") - 1)
    monthly = before.rlike("^[0-9]{4}$") & (t == F.concat(month, F.lit(" "), before))
    marks = (
        t.rlike(r"(^|[^\p{L}\p{N}])archives?($|[^\p{L}\p{N}])") | (t == F.concat(F.lit("press releases in "), last)) | (t == "search for more") | ((n <= 4) & t.rlike("(^| )newsroom$"))
        | (t.rlike("^[0-9]{4}( [|–—-] |: ).") & F.startswith(t, last) & (n_words(F.regexp_replace(t, "^[0-9]{4}( [|–—-] |: )", "")) <= 6))
    )
    at = F.instr(t, last)
    without = F.when(at > 0, F.concat(F.substr(t, F.lit(1), at - 1), F.substr(t, at + 4))).otherwise(t)
    remainder = F.regexp_replace(without, r"^[\s|:–—-]+|[\s|:–—-]+$", "")
    yearly = last.rlike("^[0-9]{4}$") & (marks | generic(remainder) | remainder.isin("archive", "archives", "news archive", "news archives", "year archive"))

    rules = {
        "weak_collection": weak,
        "short_multi_article": (c("articles") >= 4) & worded & (n <= 3) & ~digits & labelled & ((chars < 500) | ((c("articles") >= 10) & (links >= 20))),
        "listing_hint_over_collection": (c("articles") >= 4) & (c("title_source") == "listing_anchor") & generic(c("replaced_title")) & (last != "") & (label_key(c("replaced_title")) == label_key(last)),
        "card_grid": (c("articles") >= 10) & (c("articles_with_h1") == 0) & (c("most_article_chars") < 1000),
        "multi_heading_card_grid": (c("articles") >= 10) & (c("articles_with_h1") >= 4) & (chars < 1500),
        "shallow_hub": shallow,
        "breadcrumb_title": breadcrumb,
        "localized_root": local,
        "counted_taxonomy": counted,
        "high_link_density": packed,
        "undated_short_slug_topic": topic,
        "undated_listing_anchor": anchored,
        "undated_embedded_navigation": embedded,
        "year_archive": monthly | yearly,
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def hub_verdicts(pages: DataFrame, listings: tuple[str, ...] = T.LISTING_TITLES) -> DataFrame:
    """(page_id, detectors, is_hub): the names of the rules that find a page to be a listing, in their order.

    ``pages`` is one row a page: page_id, url, title, hint (the title of the link to it), title_source, replaced_title,
    articles, articles_with_h1, most_article_chars, chars, links, selector, body, dated, embedded_links. Rows are
    judged by themselves; nothing is shuffled.
    """
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in detectors(listings).items()]))
    return with_shape(pages).select("page_id", found.alias("detectors")).select("page_id", "detectors", (F.size("detectors") > 0).alias("is_hub"))


def _oracle() -> str:
    """The rules in DuckDB, from the metric columns alone."""
    roots = "[" + ", ".join(f"'{r}'" for r in ARTICLE_ROOTS) + "]"
    listings = "(" + ", ".join(f"'{x}'" for x in T.LISTING_TITLES) + ")"
    key = lambda x: f"array_to_string(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> 'and'), '')"
    words = lambda x: f"len(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
    count = lambda w: f"(length(b) - length(replace(b, '{w}', ''))) / {len(w)}"
    below, titled, bare = "(root > 0 and len(s) = root + 1)", "(t <> '' and n <= 6 and not digits)", "(articles = 0 and articles_with_h1 = 0)"
    labelled, dense = f"(last <> '' and {key('t')} = {key('last')})", lambda k: f"links * 1000 >= chars * {k}"
    hint = "trim(coalesce(hint, ''))"
    rules = {
        "weak_collection": f"{titled} and (t = 'the blog' or regexp_matches(t, '^(browse|see|view) all |^recent ') or (regexp_matches(t, ' ({'|'.join(COLLECTION_NOUNS)})$') and not regexp_matches(t, ' [|–—-] |: ')) or (regexp_matches(t, '^[^ ]+( [^ ]+)? - .* blog$') and replace(replace(last, '-', ' '), '_', ' ') = split_part(t, ' - ', 1)))",
        "short_multi_article": f"articles >= 4 and t <> '' and n <= 3 and not digits and {labelled} and (chars < 500 or (articles >= 10 and links >= 20))",
        "listing_hint_over_collection": f"articles >= 4 and title_source = 'listing_anchor' and lower(replaced_title) in {listings} and last <> '' and {key('replaced_title')} = {key('last')}",
        "card_grid": "articles >= 10 and articles_with_h1 = 0 and most_article_chars < 1000",
        "multi_heading_card_grid": "articles >= 10 and articles_with_h1 >= 4 and chars < 1500",
        "shallow_hub": f"{below} and ((links >= 10 and starts_with(b, 'showing posts ')) or ({bare} and links >= 20 and (starts_with(b, 'news releases topics media contacts ') or (contains(b, 'there is a lack of results to match selected filters') and contains(b, 'please adjust the filter options to broaden results')))) or ({titled} and ((articles >= 4 and starts_with(lower({hint}), 'all ') and {key(f'substr({hint}, 5)')} = {key('t')} and {labelled}) or (articles >= 10 and chars < 1500 and selector = '{CLUSTER}' and {hint} <> '' and {words(hint)} <= 4 and not regexp_matches({hint}, '[0-9]')) or (chars < 1000 and contains(b, 'featured articles') and contains(b, 'previous page') and contains(b, 'next page')) or (articles <= 1 and articles_with_h1 = 0 and most_article_chars < 1000 and chars < 2000 and links >= 15 and {count('read article')} >= 4) or ({bare} and selector = '{CLUSTER}' and links >= 8 and {count('read more')} >= 7))))",
        "breadcrumb_title": f"root > 0 and len(s) >= root + 2 and starts_with(t, section) and length(t) > length(section) and {words('substr(t, length(section) + 1)')} <= 6 and n <= 10",
        "localized_root": f"{below} and regexp_matches(last, '^[a-z][a-z]([-_][a-z][a-z])?$') and ends_with(split_part(url, '?', 1), '/') and (regexp_matches(url, '[?&](lang|language|language_id|locale)(=|&|$)') or links >= 20 or regexp_matches(t, '(^| )({'|'.join(PRESS_ENDINGS)})$'))",
        "counted_taxonomy": f"links >= 100 and {below} and n <= 6 and try_cast(regexp_extract(t, '\\(([0-9]+)\\)$', 1) as int) <= 1000",
        "high_link_density": f"n <= 6 and ((links >= 20 and {dense(15)}) or (not dated and selector = '{CLUSTER}' and links >= 50 and {dense(8)}))",
        "undated_short_slug_topic": f"not dated and t <> '' and n <= 4 and not digits and {labelled} and ((n <= 3 and chars < 400) or (links >= 8 and {dense(8)}))",
        "undated_listing_anchor": f"not dated and title_source = 'listing_anchor' and t <> '' and n <= 6 and links >= 10 and {dense(10)}",
        "undated_embedded_navigation": f"not dated and embedded_links >= 8 and {titled}",
        "year_archive": f"(regexp_matches(s[-2], '^[0-9][0-9][0-9][0-9]$') and t = {list(MONTHS)}[try_cast(last as int)] || ' ' || s[-2]) or (regexp_matches(last, '^[0-9][0-9][0-9][0-9]$') and (regexp_matches(t, '(^|[^a-z0-9])archives?($|[^a-z0-9])') or t = 'press releases in ' || last or t = 'search for more' or (n <= 4 and regexp_matches(t, '(^| )newsroom$')) or (regexp_matches(t, '^[0-9]+ [|-] .') and starts_with(t, last) and n <= 8) or trim(replace(t, last, ''), ' |:-') in {listings}))",
    }
    found = ", ".join(f"case when coalesce({rule}, false) then '{name}' end" for name, rule in rules.items())
    return f"""with a as (select *, lower(trim(title)) as t, lower(coalesce(body, '')) as b, list_filter(string_split(lower(regexp_replace(split_part(split_part(url, '://', 2), '?', 1), '^[^/]*', '')), '/'), lambda x: x <> '') as s from page_metrics),
        c as (select *, {words("t")} as n, regexp_matches(t, '[0-9]') as digits, coalesce(s[-1], '') as last, coalesce(list_min(list_filter(list_transform({roots}, lambda r: list_position(s, r)), lambda i: i > 0)), 0) as root from a),
        e as (select *, replace(replace(array_to_string(s[root:len(s) - 1], ' '), '-', ' '), '_', ' ') || ' ' as section from c), f as (select page_id, list_filter([{found}], lambda x: x is not null) as detectors from e)
        select page_id, array_to_string(detectors, ',') as detectors, len(detectors) > 0 as is_hub from f"""


@query("hub_verdicts", _oracle())
def _q_hubs(r: Relations) -> DataFrame:
    return hub_verdicts(r.page_metrics).withColumn("detectors", F.array_join("detectors", ","))
