"""Queries over pages and texts: HTML processing, normalisation, link and feed discovery, URL and name functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import html as H
from newsweft.functions import policy as N
from newsweft.functions import text as T
from newsweft.functions import urls as U
from newsweft.plans.catalog import query
from newsweft.plans.dialect import AS_OF
from newsweft.plans.relations import Relations

# Where sites commonly keep their feeds.
FEED_PATHS = (
    "/feed", "/feed.xml", "/rss", "/rss.xml", "/rss/pressrelease.aspx", "/rss/news-releases.xml", "/atom.xml", "/news/rss", "/news/feed/", "/news/press-releases/rss", "/newsroom/rss", "/blog/feed", "/blog/rss.xml",
    "/news-events/press-releases/rss", "/investors/news-events/press-releases/rss", "/press-releases/rss", "/press-releases/feed/",
)
MOST_CANDIDATES = 200


@query("sanitised_pages")
def _q_sanitise(r: Relations) -> DataFrame:
    """Each page's clean HTML, Markdown and text: one Arrow pass over the narrow columns."""
    p = H.process_html("html", "url").alias("p")
    return r.pages.select("page_id", p).select("page_id", F.length("p.clean_html").alias("html_chars"), F.sha2("p.markdown", 256).alias("markdown_sha256"), F.sha2("p.text", 256).alias("text_sha256"), "p.link_count", "p.stripped_elements", "p.depth_rejected")


def normalise_items(raw: DataFrame) -> DataFrame:
    """(item_key, canonical_url, title, text, markdown, content_hash, reason) from (url, title, body_html, published_at).

    A null reason means accepted; a rejected row says why and is never dropped here.
    """
    made = raw.withColumns({"p": H.process_html("body_html", "url"), "title_": T.normal_title(F.coalesce("title", F.lit(""))), "canonical_url": U.canonical(F.col("url"))})
    reason = F.when(F.col("p.oversized"), "oversized_page").when(F.col("title_") == "", "missing_title").when(N.is_utility(F.col("title_"), F.col("url")), "utility_article").when(N.is_placeholder(F.col("title_"), F.col("p.text")), "placeholder")
    hash_ = T.content_hash(F.col("canonical_url"), F.col("title_"), T.rfc3339(F.col("published_at")), F.col("p.text"))
    return made.select("item_key", "canonical_url", F.col("title_").alias("title"), F.col("p.text").alias("text"), F.col("p.markdown").alias("markdown"), hash_.alias("content_hash"), reason.alias("reason"))


@query("normalised_items")
def _q_normalise(r: Relations) -> DataFrame:
    raw = r.pages.select(F.col("page_id").alias("item_key"), "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.col("html").alias("body_html"), F.lit(AS_OF).cast("timestamp_ntz").alias("published_at"))
    return normalise_items(raw).select("item_key", "canonical_url", "title", F.sha2("text", 256).alias("text_sha256"), "content_hash", "reason")


@query("extracted_articles")
def _q_articles(r: Relations) -> DataFrame:
    a = H.extract_article("html", "url").alias("a")
    return r.pages.select("page_id", a).select("page_id", "a.ok", "a.reason", "a.title", F.length("a.text").alias("n_chars"), F.array_join("a.signals", ",").alias("signals"))


@query("collection_pages")
def _q_collections(r: Relations) -> DataFrame:
    """Hub pages, told by the extraction's counts: the heuristics are plain columns over them."""
    a = H.extract_article("html", "url").alias("a")
    x = r.pages.select("page_id", "url", a).select("page_id", "url", "a.n_links", "a.n_paragraphs", F.length("a.text").alias("n_chars"))
    hub = (F.col("n_links") > 3 * F.greatest(F.col("n_paragraphs"), F.lit(1))) | (U.is_listing_path(F.col("url")) & (F.col("n_chars") < 500))
    return x.select("page_id", "n_links", "n_paragraphs", hub.alias("is_hub"))


def discovered_links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.explode(H.page_links("html", "url")).alias("l")).select("page_id", "url", F.col("l.url").alias("link"), "l.text", "l.in_menu", "l.kind", "l.confidence", "l.pos")


@query("page_links")
def _q_links(r: Relations) -> DataFrame:
    return discovered_links(r.pages).select("page_id", "link", "text", "in_menu", "pos")


@query("link_candidates")
def _q_link_candidates(r: Relations) -> DataFrame:
    """Candidates by key: the best confidence, the shortest URL, how often seen; at most two hundred a site, best first."""
    found = discovered_links(r.pages).filter(~U.is_ignored_candidate(F.col("link"))).withColumns({"site": U.bare_host(F.col("url")), "key": U.source_key(F.col("link"), F.col("kind"))})
    merged = found.groupBy("site", "kind", "key").agg(F.max("confidence").alias("confidence"), F.min_by("link", F.struct(F.length("link"), "link")).alias("link"), F.count(F.lit(1)).alias("n_seen"))
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("confidence"), F.desc("n_seen"), "key", "kind"))
    return merged.withColumn("rn", place).filter(F.col("rn") <= MOST_CANDIDATES).select("site", "kind", "key", "confidence", "link", "n_seen")


@query("structure_fingerprints")
def _q_structure(r: Relations) -> DataFrame:
    return r.pages.select("page_id", H.fingerprint(F.col("html")).alias("fingerprint"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"


@query("fetch_targets", rf"with o as (select distinct regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) as origin from pages), p as (select unnest([{', '.join(repr(x) for x in FEED_PATHS)}]) as path) select origin || path as target from o, p")
def _q_targets(r: Relations) -> DataFrame:
    """Every origin with every common feed path; the paths are a literal array, so nothing is joined."""
    origins = r.pages.select(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1).alias("origin")).distinct()
    return origins.select("origin", F.explode(F.array(*map(F.lit, FEED_PATHS))).alias("path")).select(F.concat("origin", "path").alias("target"))


@query("url_canonical", r"select page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as canonical from pages")
def _q_canonical(r: Relations) -> DataFrame:
    return r.pages.select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("url_parts", rf"select page_id, {_HOST} as host, regexp_replace({_HOST}, '^(www\.)+', '') as bare_host, cast(len(list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s : s <> '')) as int) as n_segments from pages")
def _q_parts(r: Relations) -> DataFrame:
    u = F.col("url")
    return r.pages.select("page_id", U.host(u).alias("host"), U.bare_host(u).alias("bare_host"), F.size(U.segments(u)).alias("n_segments"))


@query("publication_keys", r"""with s as (select page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^(www\.)+', '') as h, list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s : s <> '') as g from pages)
    select page_id, 'https://' || h || '/' || array_to_string(case when len(g) > 1 and regexp_matches(g[1], '^[A-Za-z]{2}(-[A-Za-z]{2})?$') then g[2:] else g end, '/') as identity, h || '/' || lower(array_to_string(g, '/')) as resource from s""")
def _q_publication(r: Relations) -> DataFrame:
    u = F.col("url")
    return r.pages.select("page_id", U.publication_identity(u).alias("identity"), U.publication_resource(u).alias("resource"))


@query("url_flags")
def _q_flags(r: Relations) -> DataFrame:
    u = F.col("url")
    return r.pages.select(
        "page_id", U.is_sitemap(u).alias("sitemap"), U.is_listing_path(u).alias("listing"), U.is_article_path(u).alias("article"), U.is_year_archive(u).alias("year_archive"), U.has_invalid_resource(u).alias("invalid_resource"), U.is_public(u).alias("public"),
        U.is_staging_host(u).alias("staging"), U.needs_residential_browser(u).alias("residential"), U.is_ignored_candidate(u).alias("ignored"), U.source_key(u, F.lit("html")).alias("source_key"), U.stable_publication(u).alias("stable"), U.publication_root(u).alias("root"),
    )


@query("title_signatures", r"select doc_id, lower(trim(regexp_replace(split_part(text, '.', 1), '\s+', ' ', 'g'))) as signature from documents")
def _q_signature(r: Relations) -> DataFrame:
    return r.documents.select("doc_id", T.title_key(F.split_part("text", F.lit("."), F.lit(1))).alias("signature"))


# Titles that are judged beside the documents' own, and what they are.
_TITLES = (("News", False), ("N E W S R O O M", False), ("March 5, 2024", False), ("2024-03-05", False), (".cls-1{fill:#fff;display:block}", False), ("Abcd", False), ("123456", False), ("Page 3 of 9", False), ("Read more about our plans", True), ("Read more about news", True), ("Abcde", True))


def _titles_sql() -> str:
    cases = " ".join(f"when {k} then '{t}'" for k, (t, _) in enumerate(_TITLES))
    return f"select doc_id, case doc_id % 15 {cases} else split_part(text, '.', 1) end as title from documents"


@query(
    "usable_titles",
    rf"""with t as ({_titles_sql()}) select doc_id, case doc_id % 15 {" ".join(f"when {k} then {str(ok).lower()}" for k, (_, ok) in enumerate(_TITLES))}
    else coalesce(length(trim(regexp_replace(title, '\s+', ' ', 'g'))) between 5 and 300 and regexp_matches(title, '\p{{L}}') and not regexp_matches(trim(regexp_replace(title, '\s+', ' ', 'g')), '^(\p{{L}} ){{4,}}\p{{L}}$'), false) end as usable from t""",
)
def _q_usable(r: Relations) -> DataFrame:
    return r.sql(_titles_sql().replace("{", "{{").replace("}", "}}")).select("doc_id", T.usable_title(F.col("title")).alias("usable"))


@query(
    "title_variants",
    r"""with t as (select doc_id, lower(trim(regexp_replace(split_part(text, '.', 1), '\s+', ' ', 'g'))) as a from documents) select doc_id, doc_id % 6 in (0, 1, 2, 3) as variants from t where length(a) > 3""",
)
def _q_variants(r: Relations) -> DataFrame:
    """Titles beside the same with a site's name after or before a mark, with an empty one, and with another title."""
    a = F.split_part("text", F.lit("."), F.lit(1))
    other = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(" "), a, F.lit("  "))).when(F.col("doc_id") % 6 == 1, F.concat(a, F.lit(" | Acme"))).when(F.col("doc_id") % 6 == 2, F.concat(F.lit("Acme - "), a)).when(F.col("doc_id") % 6 == 3, F.concat(a, F.lit(": more")))
    other = other.when(F.col("doc_id") % 6 == 4, F.concat(F.lit("Acme: "), a)).otherwise(F.concat(a, F.lit("x")))
    return r.documents.filter(F.length(T.title_key(a)) > 3).select("doc_id", T.decorated_variants(a, other).alias("variants"))


# What a page is called, where it stands, what it says, and whether it is a placeholder or a utility page.
_PAGES = (
    ("Hello world!", "https://a.org/news/hello", "Welcome. This is your first post.", True, False), ("Hello world!", "https://a.org/news/hello", "A launch in space", False, False), ("Test post 12", "https://a.org/blog/x", "Long text", True, False),
    ("Story-7", "https://a.org/blog/x", "brief", True, False), ("test of a new engine", "https://a.org/blog/x", "brief", True, False), ("Test of a new engine", "https://a.org/blog/x", "brief", False, False), ("Who we are", "https://a.org/x", "t", False, True),
    ("About our group", "https://a.org/x", "t", False, True), ("About 30 new plants open", "https://a.org/x", "t", False, False), ("All robotics articles", "https://a.org/x", "t", False, True), ("Gears opens a plant", "https://support.a.org/x", "t", False, True),
    ("Gears opens a plant", "https://support.a.org/news/x", "t", False, False), ("Gears stock quote: live", "https://a.org/quote/ge", "t", False, True), ("Gears share price today", "https://a.org/markets/stocks/ge", "t", False, True), ("Gears share price", "https://a.org/markets/ge", "t", False, False),
    ("Watch this", "https://a.org/resources/webinars/x", "t", False, True), ("Watch this", "https://a.org/resources/news/webinars", "t", False, False), ("Gears Archives | Site", "https://a.org/topics/gears", "t", False, True), ("News", "https://a.org/news/index.html", "t", False, True),
    ("Our news", "https://a.org/en/press-kit.html", "t", False, True), ("Terms", "https://a.org/2024-terms-of-use", "t", False, True), ("Old news", "https://a.org/x/2023-news-archive", "t", False, True), ("Subscribe by RSS", "https://a.org/x", "t", False, True),
)


@query("content_policy", f"select doc_id, case doc_id % {len(_PAGES)} {' '.join(f'when {k} then {str(p[3]).lower()}' for k, p in enumerate(_PAGES))} end as placeholder, case doc_id % {len(_PAGES)} {' '.join(f'when {k} then {str(p[4]).lower()}' for k, p in enumerate(_PAGES))} end as utility from documents")
def _q_policy(r: Relations) -> DataFrame:
    """Every rule of the policy over pages whose verdict is known."""
    pages = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(u).alias("u"), F.lit(x).alias("x")) for t, u, x, *_ in _PAGES))
    p = r.documents.select("doc_id", F.element_at(pages, (F.col("doc_id") % len(_PAGES) + 1).cast("int")).alias("p"))
    return p.select("doc_id", N.is_placeholder(F.col("p.t"), F.col("p.x")).alias("placeholder"), N.is_utility(F.col("p.t"), F.col("p.u")).alias("utility"))


@query("content_hashes", r"select id, 'sha256:' || sha256('feed-item-v1' || chr(0) || canonical_url || chr(0) || title || chr(0) || coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00'), '') || chr(0) || body_text) as content_hash from feed_items")
def _q_hashes(r: Relations) -> DataFrame:
    return r.feed_items.select("id", T.content_hash(F.col("canonical_url"), F.col("title"), T.rfc3339(F.col("published_at")), F.col("body_text")).alias("content_hash"))


@query("item_keys", "select id, sha256(url || chr(0) || external_id) as item_key, 'articles/' || substr(sha256(source_id), 1, 2) as bucket from feed_items")
def _q_item_keys(r: Relations) -> DataFrame:
    return r.feed_items.select("id", T.item_key(F.col("url"), F.col("external_id")).alias("item_key"), F.concat(F.lit("articles/"), T.company_bucket(F.col("source_id"))).alias("bucket"))


@query("backoff_table", "select distinct k, cast(least(3600.0, 120 * power(2, least(k, 5))) as bigint) as seconds from crawl_runs")
def _q_backoff(r: Relations) -> DataFrame:
    return r.crawl_runs.select("k", T.backoff(F.col("k")).alias("seconds")).distinct()


@query("issuer_keys", r"select company_id, company_key, regexp_matches(name, '(?i)\bclass [a-d]\b') as has_class, regexp_matches(company_key, '^[a-z0-9]+(-[a-z0-9]+)*$') as safe_key from companies")
def _q_issuers(r: Relations) -> DataFrame:
    return r.companies.select("company_id", "company_key", F.col("name").rlike(r"(?i)\bclass [a-d]\b").alias("has_class"), T.safe_company_key(F.col("company_key")).alias("safe_key"))


_BASE_NAME = r"trim(regexp_replace(name, '(?i)\s+(class [a-d].*|series [a-d].*|common stock|capital stock|ordinary shares)\s*$', ''))"
_SEARCH_NAME = rf"trim(regexp_replace(regexp_replace({_BASE_NAME}, '(?i)[\s,]+(inc|corp)\.?$', ''), '(?i)[\s,]+(inc|corp)\.?$', ''))"


@query("company_mentions", rf"with n as (select {_SEARCH_NAME} as search_name from companies) select regexp_replace(lower(search_name), '[^a-z0-9]+', '', 'g') as issuer, cast(count(*) as bigint) as n_companies, min(search_name) as search_name from n group by 1")
def _q_mentions(r: Relations) -> DataFrame:
    """Issuers with how many companies share their search name: names are normalised on distinct values."""
    names = r.companies.select("name").distinct().select("name", T.search_name(F.col("name")).alias("search_name"), T.issuer_key(F.col("name")).alias("issuer"))
    return r.companies.select("company_id", "name").join(names, "name").groupBy("issuer").agg(F.count(F.lit(1)).alias("n_companies"), F.min("search_name").alias("search_name"))


@query("parsed_dates", "select event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as parsed from events")
def _q_dates(r: Relations) -> DataFrame:
    """Every event's time written in one of five formats and parsed back."""
    at = F.col("ts")
    shown = F.when(F.col("event_id") % 5 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 5 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    shown = shown.when(F.col("event_id") % 5 == 2, F.concat(F.lit("Mon, "), F.date_format(at, "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(F.col("event_id") % 5 == 3, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"))
    return r.events.select("event_id", F.date_format(T.parse_datetime(shown), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("event_props", "select event_type, cast(count(*) as bigint) as n, cast(sum(cast(json_extract_string(props, '$.k') as int)) as bigint) as total_k, cast(count(*) filter (where cast(json_extract_string(props, '$.k') as int) >= 50) as bigint) as n_high from events group by 1")
def _q_props(r: Relations) -> DataFrame:
    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    return r.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total_k"), F.count_if(k >= 50).alias("n_high"))


@query("merged_props", "select event_id, cast(json_extract_string(props, '$.k') as int) as k, event_type as origin from events")
def _q_merge(r: Relations) -> DataFrame:
    """Objects merged key by key, the later one winning, as maps."""
    merged = F.map_zip_with(F.from_json("props", "map<string,string>"), F.create_map(F.lit("origin"), F.col("event_type")), lambda k, a, b: F.coalesce(b, a))
    return r.events.withColumn("m", merged).select("event_id", F.col("m")["k"].cast("int").alias("k"), F.col("m")["origin"].alias("origin"))
