"""Text, title, date and hash functions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def collapse(text: Column) -> Column:
    """Unicode white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_title(title: Column) -> Column:
    """Collapsed, without a framework call that leaked into its tail."""
    return F.trim(F.split_part(collapse(title), F.lit(" self.__wrap_n!="), F.lit(1)))


def title_key(title: Column) -> Column:
    """ASCII white space collapsed, then trimmed, in lower case: what two reports of a story share."""
    return F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))


def story_identity(url_key: Column, title: Column, published_at: Column) -> Column:
    """Dated stories by day and title, undated ones by URL. Here the title is trimmed before it is collapsed."""
    dated = F.concat(F.lit("dated-title:"), published_at.cast("date").cast("string"), F.lit(":"), F.lower(F.regexp_replace(F.trim(title), r"\s+", " ")))
    return F.when(published_at.isNull(), F.concat(F.lit("url:"), url_key)).otherwise(dated)


# Words that say nothing about an article.
STOP_WORDS = ("article", "blog", "common", "company", "news", "press", "release", "releases", "report", "reports", "stock", "update", "updates")


def tokens(text: Column) -> Column:
    """The distinct ASCII words of four letters or digits or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) >= 4))


def title_agrees_with_path(title: Column, path: Column) -> Column:
    """At least two shared words, or one of eight letters."""
    shared = F.array_except(F.array_intersect(tokens(title), tokens(path)), F.array(*map(F.lit, STOP_WORDS)))
    return (F.size(shared) >= 2) | F.exists(shared, lambda w: F.length(w) >= 8)


def decorated_variants(a: Column, b: Column) -> Column:
    """The titles are equal, or one is the other with some more after a mark, or, but for a colon, before it."""
    x, y = title_key(a), title_key(b)
    test = x == y
    for mark in (" | ", " - ", " – ", " — ", ": "):
        for long, short in ((x, y), (y, x)):
            more = F.length(long) > F.length(short) + len(mark)
            after = F.startswith(long, F.concat(short, F.lit(mark))) & (F.trim(F.substr(long, F.length(short) + len(mark) + 1)) != "")
            before = F.endswith(long, F.concat(F.lit(mark), short)) & (F.trim(F.substr(long, F.lit(1), F.length(long) - F.length(short) - len(mark))) != "")
            test = test | (more & (after if mark == ": " else after | before))
    return F.coalesce(test, F.lit(False))


# Some of the titles that name a listing and no article; more are given as a parameter.
LISTING_TITLES = (
    "news", "newsroom", "press releases", "press release", "blog", "home", "homepage", "media", "media center", "latest news", "all news", "articles",
    "insights", "events", "investors", "investor relations", "search", "search results", "archive", "archives", "untitled", "index", "page not found", "404", "error",
    "404 error", "404 page not found", "all articles", "all posts", "all news releases", "all stories", "about us", "calendar", "categories", "category", "coming soon",
    "corporate", "dashboard", "downloads", "features", "industry", "latest articles", "newer posts", "older posts", "previous posts", "results", "rss feeds", "see more", "subscribe", "webinars",
)
_CSS = (".cls-", "stroke-width:", "fill:", "font-family:", "display:", "visibility:")


def article_title(title: Column) -> Column:
    """White space collapsed, and "read more about" left out where a title of its own follows it."""
    t = collapse(title)
    rest = collapse(F.regexp_replace(t, r"(?i)^read more about ", ""))
    own = t.rlike(r"(?i)^read more about ") & (F.length(rest) >= 5) & rest.rlike(r"\p{L}") & ~F.lower(rest).isin(*LISTING_TITLES)
    return F.when(own, rest).otherwise(t)


def usable_title(title: Column, listings: tuple[str, ...] = LISTING_TITLES) -> Column:
    """5 to 300 characters with a letter; no date, style sheet, letter-spaced word or title of a listing. Null is unusable."""
    shown = article_title(title)
    t = F.lower(shown)
    style = F.contains(t, F.lit("{")) & F.contains(t, F.lit("}")) & F.contains(t, F.lit(":")) & F.contains(t, F.lit(";")) & reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in _CSS])
    spaced = t.rlike(r"^(?:\p{L} ){4,}\p{L}$")
    # Only what starts like a date is tried as one.
    dated = t.rlike(r"^(\d|(mon|tue|wed|thu|fri|sat|sun|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))") & (F.length(t) <= 40) & parse_datetime(shown).isNotNull()
    paged = t.rlike(r"^(page )?\d+( of \d+)?$")
    return F.coalesce(F.length(t).between(5, 300) & t.rlike(r"\p{L}") & ~t.isin(*listings) & ~paged & ~dated & ~spaced & ~style, F.lit(False))


_DATE_TIMES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "MM/dd/yyyy HH:mm", "d MMM yyyy HH:mm:ss", "MMMM d, yyyy HH:mm", "MMMM d, yyyy h:mm a", "MMM d, yyyy HH:mm", "MMM d, yyyy h:mm a", "d MMMM yyyy HH:mm")
_DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "MM/dd/yyyy", "dd.MM.yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "yyyy.MM.dd", "d-MMM-yyyy")


def parse_datetime(text: Column, as_of: Column | None = None) -> Column:
    """RFC 3339, RFC 2822 and the common date and time formats as UTC; years from 1990 to two years after ``as_of``."""
    bare = F.regexp_replace(collapse(text), r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\.?,? ", "")
    bare = F.regexp_replace(bare, r"(?i)\b(jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\.", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)\bsept\b\.?", "Sep"), r" (GMT|UTC|Z)$", " +0000")
    zoned = [F.try_to_timestamp(bare, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")]
    plain = [F.try_to_timestamp(bare, F.lit(f)) for f in (*_DATE_TIMES, *_DATES)]
    found = F.coalesce(*zoned, *plain)
    limit = F.year(as_of) + 2 if as_of is not None else F.lit(9999)
    return F.when(F.year(found).between(1990, limit), found)


def content_hash(url: Column, title: Column, published: Column, text: Column) -> Column:
    """``sha256:`` of the item's identity and text, published as RFC 3339 or empty."""
    parts = (F.lit("feed-item-v1"), url, title, F.coalesce(published, F.lit("")), text)
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws(NUL, *parts), 256))


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def document_id(company_key: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws(NUL, F.lit("company-news-archive/article/v1"), company_key, url), 256)


def company_bucket(company_key: Column) -> Column:
    return F.substring(F.sha2(company_key, 256), 1, 2)


def item_key(feed_url: Column, entry_id: Column) -> Column:
    return F.sha2(F.concat(feed_url, F.lit(NUL), entry_id), 256)


def directory_bucket(name: Column) -> Column:
    first = F.lower(F.substring(F.trim(name), 1, 1))
    return F.when(first.rlike("^[a-z]$"), first).when(first.rlike("^[0-9]$"), "0-9").otherwise("other")


def backoff(failures: Column, base: float = 120, most: float = 3600, steps: int = 5) -> Column:
    """Seconds to wait: base doubled for each failure, up to ``steps`` times and ``most``."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), F.least(failures, F.lit(steps)))).cast("bigint")


def truncate_error(text: Column, most: int = 16384) -> Column:
    """At most so many bytes, cut between characters."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")), "\ufffd+$", ""))


# What a security's name adds to its issuer's, and words that mark a share class or a company.
SECURITY_TAIL = r"(?i)\s+(class [a-d].*|series [a-d].*|common stock|capital stock|ordinary shares|preferred stock|preference shares|(american )?depositary (shares|receipts).*|ADS|ADR)\s*$"
SHARE_CLASS = r"(?i)(\bclass [a-d]\b|\bseries [a-d]\b|common stock|capital stock|ordinary shares|preferred|preference|depositary|\bADS\b|\bADR\b)"
CORPORATE = r"(?i)(\binc\b|\bcorp\b|\bcorporation\b|\bltd\b|\blimited\b|\bplc\b|\bcompany\b|\bholdings?\b|\bgroup\b|\btrust\b|\bn\.?v\b|\bs\.?a\.?\b|\bag\b)"


def legal_base(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, SECURITY_TAIL, ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "(^-+|-+$)", "")


# Designators that a search name leaves out.
DESIGNATORS = r"(?i)[,.]?\s+(inc|incorporated|corp|corporation|co|company|ltd|limited|plc|llc|l\.?p|n\.?v|s\.?a|ag|se|gmbh|holdings?|group|trust)\.?$"


def search_name(name: Column) -> Column:
    """The issuer's name without share class and, up to three times, without a corporate designator."""
    out = legal_base(name)
    for _ in range(3):
        out = F.trim(F.regexp_replace(out, DESIGNATORS, ""))
    return collapse(out)


def issuer_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(search_name(name)), r"[^a-z0-9]+", "")


def safe_company_key(key: Column) -> Column:
    return F.coalesce(key.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def safe_category_key(key: Column) -> Column:
    return (key == "uncategorized") | (safe_company_key(key) & (F.length(key) <= 64) & key.rlike(r"-[0-9a-f]{16}$"))


def safe_path(path: Column) -> Column:
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~path.rlike(r"(^|/)\.{0,2}(/|$)")


def as_html(text: Column) -> Column:
    """Plain text as one escaped paragraph."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<p>"), escaped, F.lit("</p>"))


def ratio_bps(part: Column, whole: Column) -> Column:
    """part of whole in hundredths of a percent, at most 10,000; 0 of nothing."""
    share = F.least(part, whole).cast("bigint") * 10000
    return F.when(whole == 0, F.lit(0).cast("bigint")).otherwise(F.floor(share / F.greatest(whole, F.lit(1))).cast("bigint"))


# Words of editorial and of routine items.
EDITORIAL_WORDS = ("news", "blog", "press", "announcement", "announcements", "story", "stories", "insights", "newsroom", "article", "articles")
ROUTINE_WORDS = ("dividend", "webcast", "conference", "transcript", "filing", "filings", "10-k", "10-q", "8-k", "presentation", "calendar")


def has_any_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"[^a-z0-9-]+"), F.array(*map(F.lit, words)))
