"""What is no news: placeholder articles of content systems, and utility pages, told from title, text and URL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft.functions.text import collapse

# Titles that content systems come with, and what the text below them says.
FIXTURE_TITLES = ("another item to trigger pagination", "carousel display of multiple assets", "gallery display of multiple assets", "inline display of multiple assets", "test post created")
HELLO_TITLES = (
    "hello world", "olá, mundo", "olá mundo", "ola, mundo", "ola mundo", "¡hola mundo", "hola mundo", "bonjour tout le monde", "hallo welt", "ciao mondo", "witaj, świecie", "hallo wereld", "merhaba dünya", "привет, мир",
    "こんにちは世界", "你好，世界",
)
FIRST_POSTS = ("first post", "primeiro post", "primer post", "premier article", "erster beitrag", "primo articolo", "pierwszy wpis", "первый пост", "eerste bericht", "ilk yazı")
SHORT_TEXT, HELLO_TEXT = 200, 1000

# Titles of pages that are no articles.
UTILITY_TITLES = (
    "blog post", "categories", "category", "chain reaction newsletter archive", "comment policy", "corporate backgrounder", "corporate & financial", "corporate and financial", "corporate", "corporate fact sheet",
    "cookies policy (opens in new window)", "engineering spotlight", "events & financial calendar", "events and financial calendar", "explore topics", "financial highlights", "general information", "guides & articles",
    "history and profile", "homepage", "insights blog", "investor communications sign up", "key ratio", "leadership team", "learn more : gts north america", "legal notice", "legal notes", "linkedin", "listings",
    "newsletter sign-up", "next page", "no title", "other group companies", "ownership breakdown", "people & culture", "photos & videos", "previous", "press office", "property portfolio", "product tour hub", "qwe",
    "read more data and research articles", "resources", "role spotlights", "rss feeds", "sec test", "share monitor tool", "shareholder remuneration", "sign up for our investors news alert", "subscribe to visualize",
    "subscribe using the form below", "team asana", "test", "the latest product offerings", "view our latest articles", "view more insights", "videos", "who we are", "write for us",
)
INVESTOR_HOSTS = ("ir", "investor", "investors", "ri")
INVESTOR_SCOPES = ("corporate-governance", "financial-information", "governance", "informacoes-aos-acionistas", "investor-information", "overview", "shareholder-information", "shareholders", "stock-information")
UTILITY_HOSTS = ("docs", "help", "helpcenter", "knowledgebase", "support")
UTILITY_SCOPES = (
    "docs", "documentation", "discuss", "faq", "faqs", "forum", "forums", "hc", "help", "instagram-feed", "job", "job-openings", "jobs", "knowledge-base", "knowledgebase", "legal", "open-roles", "social-feed", "support", "vacancies",
)
EDITORIAL_SCOPES = (
    "blog", "blogs", "changelog", "changelogs", "company-news", "engineering", "insights", "news", "newsroom", "press", "press-release", "press-releases", "pressrelease", "pressreleases", "product-updates", "release-notes",
    "research", "stories", "updates", "what-s-new", "whats-new",
)
MARKET_SCOPES = ("equities", "quote", "quotes")
MARKET_PAIRS = ("investing/stock", "market-activity/stocks", "markets/stocks")
QUOTE_WORDS = r" (share|stock) quote[ :]"
PRICE_WORDS = r" (share|stock) price[ ,:]"
PROFILE_WORDS = r" (chart|finance|history|live|market cap|quote|real time|real-time|today) | (lse|nasdaq|nyse):"
HUBS = ("library", "resource", "resource-center", "resource-centre", "resources")
HUB_UTILITIES = (
    "demo", "demo-series", "demos", "event", "events", "product-tour", "product-tour-hub", "product-tours", "testimonial", "testimonials", "training", "trainings", "video", "videos", "webinar", "webinars",
)
MEDIA_SCOPES = ("brand-resources", "image-library", "media-assets", "media-library", "media-resources")
KITS = ("brand-kit", "brandkit", "media-kit", "mediakit", "press-kit", "presskit", "photo-logo-request", "photo-and-logo-request")
LISTINGS = ("articles", "blog", "blogs", "insights", "latest-news", "news", "news-releases", "newsroom", "press-releases", "resources", "stories", "timeline", "updates")
LEGAL_ENDS = (
    "cookie-notice", "cookie-policy", "legal-notice", "legal-notices", "newsletter", "privacy", "privacy-notice", "privacy-policy", "terms", "terms-and-conditions", "terms-conditions", "terms-of-service", "terms-of-use",
)
UTILITY_ENDS = (
    "all-rss-feeds", "advertising-practices", "b-roll", "brand-assets", "brand-articles", "community-articles", "company-articles", "comment-policy", "corporate-actions", "corporate-financial", "corporate-fact-sheet",
    "cookie-policy", "cookies-policy", "corporate-video", "employee-stories", "glossary", "historical-photos", "home", "insights-blog", "latest-articles", "management-photos", "materials-for-media", "market-notices",
    "media-contact", "media-contacts", "media-and-news", "media-materials", "mediacontact", "mediacontacts", "newsletter-sign-up", "newsletter-signup", "personal-data", "press-assets", "press-office-contacts",
    "privacy-policy", "prime-rate-information", "product-status", "rss", "rss-feed", "rss-feeds", "social-channels", "social-media", "socialchannels", "socialmedia", "research-library", "subscribe", "subscription",
    "terms-of-use", "video", "videos", "west-in-the-news", "who-we-are", "world-events", "write-for-us",
)
YEAR_ARCHIVE = r"^(\d{4}-news-archive|(news|press)-releases?-\d{4})$"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, " "), lambda w: w != ""))


def is_placeholder(title: Column, text: Column) -> Column:
    """An article that a content system or a test put there. Null counts as empty."""
    shown, text = collapse(F.coalesce(title, F.lit(""))), F.coalesce(text, F.lit(""))
    t, short = F.lower(F.regexp_replace(shown, r"^[!！.。]+|[!！.。]+$", "")), F.length(text) <= SHORT_TEXT
    numbered = t.rlike(r"^(test post|test article|test in the news|blog title) \d+$")
    brief = short & (t.rlike(r"^(story|storie)-\d+$") | t.rlike(r"^group_[0-9a-f]{8,}( |$)") | (t == "coming soon") | F.startswith(shown, F.lit("test ")))
    ignored = F.startswith(t, F.lit("test post")) & F.contains(t, F.lit("please ignore"))
    hello = t.isin(*HELLO_TITLES) & (F.length(text) <= HELLO_TEXT) & _any([F.contains(F.lower(text), F.lit(x)) for x in FIRST_POSTS])
    return numbered | brief | t.isin(*FIXTURE_TITLES) | ignored | hello


def is_utility(title: Column, url: Column) -> Column:
    """A page that serves the site and tells no news, by its title, its place and both together. Null counts as empty."""
    t = F.lower(collapse(F.coalesce(title, F.lit(""))))
    bare, words, no_digit = F.trim(F.regexp_replace(t, r"[.!?]+$", "")), _words(t), ~t.rlike(r"\d")
    brief = lambda most, pattern: (_words(bare) <= most) & bare.rlike(pattern) & no_digit
    head, tail = F.split_part(t, F.lit(" | "), F.lit(1)), F.regexp_extract(t, r"^.*? \| (.*)$", 1)
    section = F.contains(t, F.lit(" | ")) & (
        ((_words(head) <= 3) & F.endswith(head, F.lit(" blogs")) & (_words(tail) <= 4)) | ((_words(head) <= 8) & F.endswith(head, F.lit(" news and updates")) & ~head.rlike(r"\d") & (_words(tail) <= 4) & tail.rlike(r"(^| )blog$"))
    )
    by_title = t.isin(*UTILITY_TITLES) | brief(4, r"^all .*articles$") | brief(4, r" media coverage$") | brief(8, r"^view more from ") | section | ((words <= 4) & F.startswith(t, F.lit("about ")) & no_digit)
    by_title = by_title | (F.startswith(t, F.lit("subscribe")) & t.rlike(r"(^|[^a-z0-9])rss([^a-z0-9]|$)"))

    where = F.coalesce(url, F.lit(""))
    path = F.lower(F.regexp_extract(where, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    label = F.regexp_extract(F.lower(where), r"^[a-z][a-z0-9+.-]*://(?:www\.)*([^./?#:]+)", 1)
    has = lambda values: F.arrays_overlap(segments, F.array(*map(F.lit, values)))
    is_editorial = lambda s: s.isin(*EDITORIAL_SCOPES) | s.rlike(r"release-notes|product-updates") | (F.contains(s, F.lit("releases-for-")) & s.rlike(r"(^|\D)\d{4}(\D|$)"))
    editorial, investor = F.exists(segments, is_editorial), label.isin(*INVESTOR_HOSTS)
    scoped = label.isin(*UTILITY_HOSTS) | (investor & has(INVESTOR_SCOPES)) | has(UTILITY_SCOPES) | F.exists(segments, lambda s: F.startswith(s, F.lit("career_")))
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    market = (has(MARKET_SCOPES) | _any([F.contains(F.concat(path, F.lit("/")), F.lit(f"/{p}/")) for p in MARKET_PAIRS])) & (padded.rlike(QUOTE_WORDS) | (padded.rlike(PRICE_WORDS) & padded.rlike(PROFILE_WORDS)))
    hub = _any([F.contains(F.concat(path, F.lit("/")), F.lit(f"/{h}/")) for h in HUBS])
    place = F.array_min(F.filter(F.transform(F.array(*map(F.lit, HUBS)), lambda h: F.array_position(segments, h)), lambda p: p > 0))
    below = F.slice(segments, (F.coalesce(place, F.lit(1)) + 1).cast("int"), F.greatest(F.size(segments), F.lit(1)))
    in_hub = hub & F.arrays_overlap(below, F.array(*map(F.lit, HUB_UTILITIES))) & ~F.exists(below, is_editorial)
    by_place = market | (scoped & ~editorial) | (investor & ~editorial & F.startswith(t, F.lit("why invest in "))) | in_hub

    plain = F.transform(segments, lambda s: F.regexp_replace(s, r"\.(aspx|html|asp|htm|php)$", ""))
    named = F.filter(plain, lambda s: ~s.isin("default", "index"))
    last, end = F.coalesce(F.try_element_at(plain, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))
    archive = F.regexp_extract(t, r"^(.*?) archives (?:\||-|–|—) ", 1)
    slug = F.regexp_replace(F.regexp_replace(archive, r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    logo = F.arrays_overlap(plain, F.array(*map(F.lit, MEDIA_SCOPES))) & (words <= 6) & F.endswith(t, F.lit(" logo use")) & end.rlike(r"(^|-)logo-use$")
    legal = rf"^(\d+[-_]*-)?({'|'.join(LEGAL_ENDS)})$"
    by_both = ((archive != "") & (slug == last)) | end.isin(*KITS) | logo | (end.isin(*LISTINGS) & (t == F.regexp_replace(end, "[-_]", " ")))
    return by_title | by_place | by_both | last.isin(*UTILITY_ENDS) | last.rlike(legal) | last.rlike(YEAR_ARCHIVE) | ((last == "none") & F.endswith(t, F.lit("coming soon")))
