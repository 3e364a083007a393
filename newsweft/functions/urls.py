"""URL functions over columns: identities, keys, classifiers and shape checks, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query keys that identify an editorial resource.
RESOURCE_KEYS = (
    "article", "article_id", "articleid", "cid", "content", "content_id", "contentid", "id", "item", "item_id", "itemid", "news_id", "newsid", "nid",
    "p", "page_id", "pageid", "post", "post_id", "postid", "record_id", "recordid", "release_id", "releaseid", "story", "story_id", "storyid",
)
# Documents that stand for their folder.
INDEX_DOCUMENTS = tuple(f"{stem}{ext}" for stem in ("default", "index") for ext in ("", ".asp", ".aspx", ".htm", ".html", ".php"))
# Hosts reserved for examples, and path words of feeds that are no news.
RESERVED_HOSTS = ("example.com", "example.net", "example.org")
IGNORED_WORDS = ("sitemap", "oembed", "comments")
LOCALE = r"^[A-Za-z]{2}(-[A-Za-z]{2})?$"


def _part(url: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(url, pattern, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(_part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def port(url: Column) -> Column:
    return _part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)


def bare_host(url: Column) -> Column:
    """The host in lower case without ``www.``, however often."""
    return F.regexp_replace(host(url), r"^(www\.)+", "")


def path(url: Column) -> Column:
    found = _part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    return _part(url, r"^[^?#]*\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def identity_key(url: Column) -> Column:
    """No fragment, scheme, www or last slashes; only the host in lower case; the query stays. Null for null."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    at = F.instr(bare, "?")
    tail = F.when(at > 0, F.substr(bare, at)).otherwise("")
    resource = F.regexp_replace(F.regexp_replace(F.split_part(bare, F.lit("?"), F.lit(1)), r"(?i)^https?://(www\.)?", ""), r"/+$", "")
    site = F.split_part(resource, F.lit("/"), F.lit(1))
    return F.concat(F.lower(site), F.substr(resource, F.length(site) + 1), tail)


def _pairs(url: Column) -> Column:
    """array<struct<key, value>> of the query, decoded and trimmed, keys in lower case."""
    decode = lambda c: F.trim(F.try_url_decode(c))
    split = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(split, lambda p: F.struct(F.lower(decode(F.split_part(p, F.lit("="), F.lit(1)))).alias("key"), F.when(F.instr(p, "=") > 0, decode(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("value")))


def _safe(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9._-]{1,128}$"), F.lit(False))


def _recognised(url: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(_pairs(url), lambda p: p["key"].isin(*RESOURCE_KEYS))))


def resource_pairs(url: Column) -> Column:
    """The safe pairs that identify a resource, sorted, each once; none when there are more than four."""
    found = F.filter(_recognised(url), lambda p: _safe(p["value"]))
    return F.when(F.size(found) <= 4, found).otherwise(F.slice(found, 1, 0))


def has_invalid_resource(url: Column) -> Column:
    found = _recognised(url)
    return F.exists(found, lambda p: ~_safe(p["value"])) | (F.size(found) > 4)


def _without_query(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise(""), path(url))


def _rendered(pairs: Column) -> Column:
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")
    return F.when(F.size(pairs) > 0, F.concat(F.lit("?"), text)).otherwise("")


def canonical(url: Column) -> Column:
    """No fragment, and of the query only what identifies a resource."""
    return F.concat(_without_query(url), _rendered(resource_pairs(url)))


def is_sitemap(url: Column) -> Column:
    return F.concat_ws("/", path(url), query(url)).rlike(r"(?i)(^|[^A-Za-z0-9])sitemaps?([^A-Za-z0-9]|$)")


def publication_identity(url: Column) -> Column:
    """https, no www, query or fragment, and no leading locale where more path follows."""
    s = segments(url)
    kept = F.when((F.size(s) > 1) & F.get(s, 0).rlike(LOCALE), F.slice(s, 2, 10000)).otherwise(s)
    return F.concat(F.lit("https://"), bare_host(url), F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise(""), F.lit("/"), F.array_join(kept, "/"))


def publication_resource(url: Column) -> Column:
    """host[:port]/segments in lower case, the index document dropped where no query tells pages apart."""
    s, pairs = F.transform(segments(url), lambda x: F.lower(F.trim(x))), resource_pairs(url)
    shown = F.when((F.size(pairs) == 0) & (F.size(s) > 0) & F.element_at(s, -1).isin(*INDEX_DOCUMENTS), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
    return F.concat(bare_host(url), F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise(""), F.lit("/"), F.array_join(shown, "/"), _rendered(pairs))


# Path words of pages that list news.
LISTING_WORDS = ("news", "newsroom", "press", "press-releases", "pressreleases", "media", "blog", "blogs", "articles", "stories", "insights", "updates", "announcements", "releases", "events", "investors")


def source_key(url: Column, kind: Column) -> Column:
    """No fragment or www.; pages also lose query, last slashes and a locale before a listing word."""
    s = segments(url)
    located = (F.size(s) >= 2) & F.get(s, 0).rlike(LOCALE) & F.lower(F.get(s, 1)).isin(*LISTING_WORDS)
    shown = F.when(located, F.concat(F.lit("/"), F.array_join(F.slice(s, 2, 10000), "/"))).when(path(url) != "/", F.regexp_replace(path(url), "/+$", "")).otherwise("/")
    site = F.concat(scheme(url), F.lit("://"), F.regexp_replace(host(url), r"^www\.", ""), F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise(""))
    return F.when(kind == "html", F.concat(site, shown)).otherwise(F.concat(site, path(url), F.when(F.instr(url, "?") > 0, F.concat(F.lit("?"), query(url))).otherwise("")))


def semantic_segments(url: Column) -> Column:
    """Lower-case path segments without the index document and without the last one's file extension."""
    s = F.transform(segments(url), F.lower)
    s = F.when((F.size(s) > 0) & F.element_at(s, -1).isin(*INDEX_DOCUMENTS), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
    return F.transform(s, lambda x, i: F.when(i == F.size(s) - 1, F.regexp_replace(x, r"\.(aspx?|html?|php|jsp|cfm)$", "")).otherwise(x))


def is_listing_path(url: Column) -> Column:
    """The path is empty or ends in a listing word, or in a page number or year below one."""
    s = semantic_segments(url)
    last, before = F.element_at(F.concat(F.array(F.lit("")), s), -1), F.get(s, F.size(s) - 2)
    return (F.size(s) == 0) | last.isin(*LISTING_WORDS) | ((F.size(s) >= 2) & before.isin(*LISTING_WORDS, "page", "archive") & last.rlike(r"^(\d{1,3}|(19|20)\d\d|page|archive|all)$"))


def is_article_path(url: Column) -> Column:
    """The last segment reads like a slug, a date stands in the path, or a number stands below a listing word."""
    s = semantic_segments(url)
    last = F.element_at(F.concat(F.array(F.lit("")), s), -1)
    slug = (F.size(F.split(last, "-")) >= 4) & (F.length(last) >= 16)
    dated = F.array_join(s, "/").rlike(r"(^|/)(19|20)\d\d/[01]?\d(/|$)")
    numbered = last.rlike(r"^\d{2,}$") & (F.size(s) >= 2) & ~last.rlike(r"^(19|20)\d\d$")
    return ~is_listing_path(url) & (slug | dated | numbered | (F.size(resource_pairs(url)) > 0))


def is_year_archive(url: Column) -> Column:
    s = semantic_segments(url)
    return F.coalesce(F.element_at(F.concat(F.array(F.lit("")), s), -1).rlike(r"^(19|20)\d\d$"), F.lit(False))


def hosts_related(a: Column, b: Column) -> Column:
    """Equal, or one below the other; both as plain hosts."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def is_locale(segment: Column) -> Column:
    return segment.rlike(LOCALE)


def in_scope(url: Column, hosts: Column, prefixes: Column) -> Column:
    """The host is one of ``hosts`` or below it, and the path begins with one of ``prefixes`` at a boundary, if any is given."""
    h, p = bare_host(url), path(url)
    inside = F.exists(hosts, lambda x: (h == x) | F.endswith(h, F.concat(F.lit("."), x)))
    prefix = F.exists(prefixes, lambda x: (p == x) | F.startswith(p, F.concat(F.regexp_replace(x, "/+$", ""), F.lit("/"))))
    return inside & ((F.size(prefixes) == 0) | prefix)


def is_staging_host(url: Column) -> Column:
    return host(url).rlike(r"(^|[.-])(staging|stage|test|dev|qa|uat|preview|sandbox|localhost|internal)([.-]|$)")


def stable_publication(url: Column) -> Column:
    """The URL without a trailing year, month or page number, query and fragment."""
    s = segments(url)
    text = F.regexp_replace(F.concat(F.lit("/"), F.array_join(s, "/")), r"(/(19|20)\d\d(/[01]?\d)?|/page/\d+)+$", "")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(text == "", "/").otherwise(text))


def publication_root(url: Column) -> Column:
    """The URL up to its first listing word, else the site's root."""
    s = F.transform(segments(url), F.lower)
    at = F.array_position(F.transform(s, lambda x: x.isin(*LISTING_WORDS)), True)
    return F.concat(scheme(url), F.lit("://"), host(url), F.lit("/"), F.when(at > 0, F.array_join(F.slice(segments(url), 1, at.cast("int")), "/")).otherwise(""))


def common_prefix(a: Column, b: Column) -> Column:
    """The leading segments that two paths share, with slashes."""
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    return F.concat(F.lit("/"), F.array_join(F.slice(a, 1, F.least(same, n)), "/"))


def is_public(url: Column) -> Column:
    """http or https, a host with a dot, no credentials, no reserved example host."""
    h = host(url)
    reserved = F.lit(False)
    for r in RESERVED_HOSTS:
        reserved = reserved | (h == r)
    return scheme(url).isin("http", "https") & h.contains(".") & ~url.rlike(r"^[A-Za-z]+://[^/?#]*@") & ~reserved & ~h.rlike(r"(^|\.)(localhost|local|invalid|test)$")


def is_article_shape(url: Column) -> Column:
    """Public, not the root, no search result."""
    return is_public(url) & (path(url) != "/") & ~path(url).rlike(r"(?i)/search(/|$)") & ~query(url).rlike(r"(?i)(^|&)(q|s|search|query)=")


def are_prefixes(prefixes: Column) -> Column:
    """At most fifty, each beginning with a slash, none with query or fragment, all distinct."""
    return (F.size(prefixes) <= 50) & F.forall(prefixes, lambda p: F.startswith(p, F.lit("/")) & ~p.rlike("[?#]")) & (F.size(F.array_distinct(prefixes)) == F.size(prefixes))


def is_ignored_candidate(url: Column) -> Column:
    words = F.split(F.lower(path(url)), r"[^a-z0-9]+")
    return is_sitemap(url) | F.arrays_overlap(words, F.array(*map(F.lit, IGNORED_WORDS))) | host(url).rlike(r"^(support|help|docs)\.")


def same_site(url: Column, home: Column) -> Column:
    return hosts_related(bare_host(url), bare_host(home))


def needs_residential_browser(url: Column) -> Column:
    return host(url).rlike(r"^(ir|investors?)\.") | F.lower(path(url)).endswith(".aspx")


def repaired_canonical(canonical_url: Column, page: Column) -> Column:
    """A canonical that embeds a second URL is that URL; one that is only the site's root gives way to the page."""
    inner = F.regexp_extract(canonical_url, r"^https?://[^/]+/(https?://.+)$", 1)
    fixed = F.when(inner != "", inner).otherwise(canonical_url)
    return F.when(fixed.isNull() | ((path(fixed) == "/") & (query(fixed) == "") & (path(page) != "/")), page).otherwise(fixed)


def upgraded_redirect(page: Column, target: Column) -> Column:
    """A redirect that only drops https on the same host stays on https."""
    down = (scheme(page) == "https") & (scheme(target) == "http") & (bare_host(page) == bare_host(target))
    return F.when(down, F.regexp_replace(target, r"^http:", "https:")).otherwise(target)


def repaired_path(path_: Column) -> Column:
    """A percent-encoded path whose UTF-8 was taken for Latin-1 and encoded again, decoded once; else the path as it is."""
    text = F.try_url_decode(path_)
    latin = F.when(text.rlike(r"^[\x00-\xff]*$") & text.rlike(r"[\x80-\xff]"), text)
    fixed = F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    return F.when(fixed.isNotNull(), F.replace(F.replace(F.url_encode(fixed), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))).otherwise(path_)


def is_public_ipv4(address: Column) -> Column:
    """None of the reserved IPv4 ranges."""
    o = F.transform(F.split(address, r"\."), lambda x: F.expr("try_cast(1 as int)") * x.try_cast("int"))
    a, b, c = F.get(o, 0), F.get(o, 1), F.get(o, 2)
    valid = (F.size(o) == 4) & F.forall(o, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    reserved = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    return valid & ~F.coalesce(reserved, F.lit(True))
