"""Which company an item is about: terms, hosts and ownership of issuers, and items that several issuers claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import names as N
from newsweft.functions import urls as U
from newsweft.plans.catalog import query
from newsweft.plans.relations import Relations
from newsweft.session import written

# Hosts on which many companies publish, and those of managers of many funds.
SHARED_HOSTS = (
    "accessnewswire.com", "barchart.com", "benzinga.com", "biospace.com", "bloomberg.com", "businessinsider.com", "businesswire.com", "einpresswire.com", "eqs-news.com", "finance.yahoo.com", "fool.com",
    "forbes.com", "globenewswire.com", "gurufocus.com", "investing.com", "lasvegassun.com", "marketbeat.com", "marketscreener.com", "marketwatch.com", "msn.com", "nasdaq.com", "natlawreview.com",
    "newmediawire.com", "newsfilecorp.com", "newswire.ca", "newswire.com", "pluang.com", "prnewswire.com", "public.com", "quiverquant.com", "reuters.com", "sahmcapital.com", "seekingalpha.com",
    "simplywall.st", "stockstotrade.com", "stocktitan.net", "streetinsider.com", "tipranks.com", "tradingview.com", "zacks.com",
)
MANAGER_HOSTS = ("angeloakcapital.com", "blackrock.com", "blackstone.com", "gabelli.com", "invesco.com", "mfs.com", "royceinvest.com", "sprott.com")


# Hosts and policies


def is_below(host: Column, hosts: tuple[str, ...]) -> Column:
    """The host is one of ``hosts`` or below one."""
    return F.coalesce(F.arrays_overlap(N.host_suffixes(host), N.listed(hosts)), F.lit(False))


def related_to_any(host: Column, hosts: Column) -> Column:
    return F.coalesce(N.let(host, lambda own: F.exists(hosts, lambda h: U.hosts_related(own, h))), F.lit(False))


def policy_hosts(policy: Column, field: str) -> Column:
    """The bare hosts of a list in a JSON policy, whose entries are hosts or URLs; blank ones are left out."""
    listed = F.transform(F.from_json(F.get_json_object(policy, f"$.{field}"), "array<string>"), lambda x: F.trim(x))
    bare = F.transform(listed, lambda x: F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), U.bare_host(x)).otherwise(F.regexp_replace(F.lower(F.regexp_extract(x, "^/*([^/:]*)", 1)), r"^(www\.)+", "")))
    return F.coalesce(F.filter(bare, lambda h: h != ""), F.array().cast("array<string>"))


def with_identity(companies: DataFrame) -> DataFrame:
    """A company's identity, worked out once: (company_id, name, alias, home_url, host_policy) and what follows from them."""
    listed = F.array_compact(F.array("name", "alias"))
    entries = F.filter(F.array(U.bare_host(F.col("home_url"))), lambda h: F.coalesce(h != "", F.lit(False)))
    tokens = F.array_distinct(F.flatten(F.transform(listed, lambda n: F.filter(N.brand_tokens(n), lambda w: ~F.array_contains(N.listed(N.GENERIC_WORDS), w)))))
    return companies.select(
        "company_id", listed.alias("names"), F.transform(listed, N.host_forms).alias("forms"), entries.alias("entry_hosts"), policy_hosts(F.col("host_policy"), "excluded_hosts").alias("excluded"), policy_hosts(F.col("host_policy"), "verified_hosts").alias("verified"),
        N.scope_terms(listed).alias("terms"), tokens.alias("collision_tokens"), N.is_vehicle(F.col("name")).alias("vehicle"), N.issuer_key(F.col("name")).alias("issuer"), N.issuer_tokens(F.col("name")).alias("issuer_words"), N.short_acronyms(listed).alias("short"),
    )


def bears_name(host: Column, forms: Column) -> Column:
    """Some name of a company, as ``N.host_forms`` has it, is borne by the host."""
    return F.coalesce(N.let(N.host_labels(host), lambda labels: F.exists(forms, lambda f: N.labels_match(labels, f))), F.lit(False))


def host_verdict(host: Column, c: dict[str, Column]) -> Column:
    """``excluded``, ``verified``, ``named`` (the host bears the company's name), ``profile`` (near an entry point) or ``foreign``, in this order."""

    def verdict(h: Column) -> Column:
        found = F.when(related_to_any(h, c["excluded"]), "excluded").when(related_to_any(h, c["verified"]), "verified")
        return found.when(bears_name(h, c["forms"]), "named").when(related_to_any(h, c["entry_hosts"]), "profile").otherwise("foreign")

    return N.let(host, verdict)


def is_shared(host: Column, vehicle: Column) -> Column:
    """A host of many companies, or for a trust or fund one of its managers'."""
    return N.let(host, lambda h: is_below(h, SHARED_HOSTS) | (vehicle & is_below(h, MANAGER_HOSTS)))


# Terms


def term_index(companies: DataFrame) -> DataFrame:
    """(term, n_companies, company_id): the companies of a term as one row with the smallest, however many there are."""
    return companies.select("company_id", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_companies"), F.min("company_id").alias("company_id"))


def _prefixes(word: Column, last: int) -> Column:
    """The word's beginnings of five letters or more, three shorter at most and ``last`` shorter at least."""
    n = F.length(word)
    ends = F.sequence(F.greatest(F.lit(5), n - 3), n - last)
    return F.when(n - last >= F.greatest(F.lit(5), n - 3), F.transform(ends, lambda e: F.substring(word, F.lit(1), e)))


def terms_of_words(words: DataFrame, index: DataFrame) -> DataFrame:
    """(word, term): the longest term that each distinct word stands for, the first of several; exact, or one begins with the other."""
    w = F.col("word")
    exact = words.join(index.select(F.col("term").alias("word"), "term"), "word")
    # Spark takes an exploded side for as small as its input and might broadcast it.
    shorter = words.select("word", F.explode(_prefixes(w, 1)).alias("term")).hint("merge").join(index.select("term"), "term")
    longer = index.select("term", F.explode(_prefixes(F.col("term"), 1)).alias("word")).hint("merge").join(words, "word")
    found = exact.unionByName(shorter).unionByName(longer)
    return found.groupBy("word").agg(F.min(F.struct((-F.length("term")).alias("size"), "term")).alias("b")).select("word", F.col("b.term").alias("term"))


def item_words(items: DataFrame) -> DataFrame:
    """(id, word): the distinct words of a title, and those of four letters or more of the canonical URL."""
    url = F.filter(N.words(F.coalesce("canonical_url", "url")), lambda w: F.length(w) >= 4)
    both = F.array_distinct(F.concat(F.coalesce(N.words(F.col("title")), F.array().cast("array<string>")), F.coalesce(url, F.array().cast("array<string>"))))
    return items.select("id", F.explode(both).alias("word"))


def scope_mentions(items: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, word, term, n_companies, company_id): the longest term that an item's title or URL mentions, and the companies that it may mean.

    An inverted index: distinct words meet the terms by equality, whole or by a beginning, and the items their words.
    An item is one row, whatever number of companies share its terms. Items without a term have no row.
    """
    index, words = written(term_index(companies), "terms"), item_words(items)
    known = terms_of_words(written(words.select("word").distinct(), "words"), index)
    best = words.hint("merge").join(known, "word").groupBy("id").agg(F.min(F.struct((-F.length("term")).alias("size"), "term", "word")).alias("b"))
    return best.select("id", "b.word", "b.term").join(index, "term").select("id", "word", "term", "n_companies", "company_id")


def mentions_company(c: dict[str, Column]) -> Column:
    """The item's title or canonical URL names the company; on a manager's host its fund by several words, else by a term or by two letters that the host bears too."""
    url, identity = F.col("url"), F.coalesce("canonical_url", "url")
    by_manager = c["vehicle"] & (is_below(U.bare_host(url), MANAGER_HOSTS) | is_below(U.bare_host(identity), MANAGER_HOSTS))
    borne = N.let(F.concat(N.host_labels(U.host(url)), N.host_labels(U.host(identity))), lambda hosts: F.filter(c["short"], lambda a: F.array_contains(hosts, a)))

    def named(title: Column) -> Column:
        by_term = N.mentions_term(title, c["terms"]) | N.let(N.words(identity), lambda w: N.mentions_term(w, c["terms"], 4)) | F.coalesce(F.arrays_overlap(title, borne), F.lit(False))
        by_words = N.let(F.concat(title, N.words(U.path(identity))), lambda evidence: N.mentions_vehicle(evidence, c["names"]))
        return F.when(by_manager, by_words).otherwise(by_term)

    return N.let(N.words(F.coalesce("title", F.lit(""))), named)


def _columns(prefix: str = "") -> dict[str, Column]:
    return {n: F.col(prefix + n) for n in ("names", "forms", "entry_hosts", "excluded", "verified", "terms", "collision_tokens", "vehicle", "short")}


def host_scoped(host: Column, c: dict[str, Column]) -> Column:
    return ~is_shared(host, c["vehicle"]) & host_verdict(host, c).isin("verified", "named", "profile")


def cross_company_claims(items: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, company_id, n_competing, quarantined) of each public item whose canonical URL other issuers claim as well.

    Companies with equal issuer keys or equal issuer words are one issuer. What competes with a claim is counted, not
    paired: all companies on the URL less those of the same key or words. A claim stays if its host is the company's or
    the item mentions it, unless the company has entry points elsewhere and a competitor whose name extends its own has
    both host and mention. Private items make no claims; without a company in ``companies`` an item has no row.
    """
    known = written(with_identity(companies), "issuers")
    public = written(items.where(~F.col("is_private")).select("id", "company_id", "title", "url", "canonical_url", F.coalesce("canonical_url", "url").alias("claimed")), "public")
    claims = public.select("claimed", "company_id").distinct().join(known.select("company_id", "issuer", "issuer_words"), "company_id")
    n = lambda *keys: F.count(F.lit(1)).over(Window.partitionBy("claimed", *keys))
    same_words = F.when(F.col("issuer_words").isNotNull(), n("issuer_words") - n("issuer", "issuer_words")).otherwise(0)
    rivals = claims.select("claimed", "company_id", (n() - n("issuer") - same_words).alias("n_competing")).where(F.col("n_competing") > 0)
    c, host = _columns(), U.bare_host(F.coalesce("canonical_url", "url"))
    judged = public.join(rivals, ["claimed", "company_id"]).join(known, "company_id").select("*", (host_scoped(host, c) | mentions_company(c)).alias("scoped"), ((F.size("entry_hosts") == 0) | related_to_any(host, F.col("entry_hosts"))).alias("at_home"))

    # Only claims away from home can be outdone, by a company on the same URL that has all their tokens and more.
    away = judged.where(F.col("scoped") & ~F.col("at_home") & (F.size("collision_tokens") > 0)).select("id", "claimed", "title", "url", "canonical_url", "collision_tokens", "issuer", "issuer_words", F.get("collision_tokens", F.lit(0)).alias("token"))
    theirs = {f.name: f"r_{f.name}" for f in known.schema}
    longer = claims.select("claimed", "company_id").join(known, "company_id").withColumnsRenamed(theirs).select("*", F.explode("r_collision_tokens").alias("token"))
    extends = (F.size("r_collision_tokens") > F.size("collision_tokens")) & (F.size(F.array_except("collision_tokens", "r_collision_tokens")) == 0)
    other = (F.col("issuer") != F.col("r_issuer")) & ~F.coalesce(F.col("issuer_words") == F.col("r_issuer_words"), F.lit(False))
    outdone = away.join(longer, ["claimed", "token"]).where(extends & other & host_scoped(host, _columns("r_")) & mentions_company(_columns("r_"))).select("id").distinct()
    lost = outdone.withColumn("outdone", F.lit(True))
    return judged.join(lost, "id", "left").select("id", "company_id", "n_competing", (~F.col("scoped") | F.coalesce("outdone", F.lit(False))).alias("quarantined"))


# Ownership


def ownership_reason(candidate: Column, final: Column, found_on: Column, c: dict[str, Column]) -> Column:
    """The first of five reasons that make a candidate the company's own, null for none and on excluded hosts.

    ``found_on`` is an array of (method, url) observations.
    """

    def first_of(host: Column, last: Column) -> Column:
        out = related_to_any(host, c["excluded"]) | related_to_any(last, c["excluded"])
        near = lambda hosts: related_to_any(host, hosts) & (related_to_any(last, hosts) | U.hosts_related(host, last))
        links = F.coalesce(F.exists(found_on, lambda o: related_to_any(U.bare_host(o["found_on"]), c["entry_hosts"])), F.lit(False))
        named = F.coalesce(F.exists(found_on, lambda o: (o["method"] == "html_alternate") & bears_name(U.bare_host(o["found_on"]), c["forms"])), F.lit(False))
        found = F.when(out, None).when(near(c["verified"]), "verified_publication_host").when(near(c["entry_hosts"]), "official_profile_host")
        return found.when(links, "official_profile_link_evidence").when(named, "company_name_link_evidence").when(bears_name(host, c["forms"]) & bears_name(last, c["forms"]), "company_name_matches_feed_host")

    return N.let(U.bare_host(candidate), lambda host: N.let(F.coalesce(U.bare_host(final), U.bare_host(candidate)), lambda last: first_of(host, last)))


# The same in DuckDB, for issuers as the given tables make them


def _words_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, '[^A-Za-z0-9]+'), lambda w: lower(w)), lambda w: w <> '')"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_HOST = "regexp_replace(lower(split_part(split_part({0}, '://', 2), '/', 1)), '^(www\\.)+', '')"
_NEAR = "({0} = {1} or ends_with({0}, '.' || {1}) or ends_with({1}, '.' || {0}))"


def _any(items: str, test: str) -> str:
    return f"coalesce(len(list_filter({items}, lambda x: {test})) > 0, false)"


def _identity_sql() -> str:
    """CTEs ``nm`` (a row for each name) and ``ident`` (a row for each issuer)."""
    mark = f"(?i) (?:{'|'.join(N.SECURITY_MARKERS)})"
    initials = "array_to_string(list_transform({0}, lambda w: w[1]), '')"
    policy = lambda f: f"list_filter(list_transform(coalesce(cast(json_extract(host_policy, '$.{f}') as varchar[]), []), lambda x: case when contains(x, '://') then {_HOST.format('x')} else regexp_replace(lower(trim(x)), '^(www\\.)+', '') end), lambda x: x <> '')"
    legal = " ".join(f"when '{k}' then '{v}'" for k, v in N.LEGAL_FORMS)
    return rf"""n0 as (select company_id, name, unnest(list_filter([name, alias], lambda x: x is not null)) as raw from issuers),
    n1 as (select *, case when regexp_matches(raw, '{mark}') then trim(regexp_replace(rtrim(regexp_extract(raw, '^(.*?){mark}', 1), ' ,:;-'), '(?i)(^| )(class|series) [a-z0-9]{{1,4}}$', '')) else trim(raw) end as bare from n0),
    n2 as (select *, list_filter({_words_sql("bare")}, lambda w: length(w) >= 2 and w not in {_in(N.NAME_STOP_WORDS)}) as ident, list_filter({_words_sql("raw")}, lambda w: length(w) >= 2 and w not in {_in(N.NAME_STOP_WORDS)}) as ident_raw,
        list_filter({_words_sql("bare")}, lambda w: w not in {_in(N.BRAND_STOP_WORDS)}) as brand,
        case list_filter({_words_sql("bare")}, lambda w: w in {_in(tuple(k for k, _ in N.LEGAL_FORMS))})[1] {legal} end as legal, case list_filter({_words_sql("raw")}, lambda w: w in {_in(tuple(k for k, _ in N.LEGAL_FORMS))})[1] {legal} end as legal_raw from n1),
    n3 as (select *, list_filter(brand, lambda w: w not in {_in(N.ANNOTATION_WORDS)}) as told from n2),
    nm as (select *, list_concat(list_filter(ident, lambda w: w not in {_in(N.GENERIC_WORDS + N.ANNOTATION_WORDS)} and (length(w) >= 3 or regexp_matches(w, '[0-9]'))),
        case when len(told) >= 3 then [{initials.format("told")}] else [] end, case when len(told) >= 2 and legal is not null then list_filter([{initials.format("told")} || legal[1], {initials.format("told")} || legal], lambda a: length(a) >= 3) else [] end) as terms,
        case when len(brand) >= 3 then {initials.format("brand")} end as acronym,
        case when len(brand) >= 2 and legal_raw is not null then list_filter([{initials.format("brand")} || legal_raw[1], {initials.format("brand")} || legal_raw], lambda a: length(a) >= 3) else [] end as legals,
        case when len(brand) = 2 then {initials.format("brand")} end as short, case when len(brand) >= 3 and length(brand[1]) >= 4 then brand[1] || {initials.format("brand[2:]")} end as led from n3),
    per as (select company_id, list_distinct(flatten(list(terms))) as terms, list_distinct(flatten(list(list_filter(brand, lambda w: w not in {_in(N.GENERIC_WORDS)})))) as collision, list(distinct short) filter (where short is not null) as short,
        list(list_filter(ident, lambda w, i: i = 1 or w <> ident[i - 1])) as idents from nm group by company_id),
    ident as (select i.company_id, per.* exclude (company_id), {_HOST.format("i.home_url")} as home, {policy("excluded_hosts")} as excluded, {policy("verified_hosts")} as verified,
        regexp_replace(lower(b.bare), '[^a-z0-9]', '', 'g') as issuer, nullif(array_to_string(b.brand, ' '), '') as issuer_words, len(list_filter({_words_sql("b.bare")}, lambda w: w in ('trust', 'fund'))) > 0 as vehicle
        from issuers i join per using (company_id) join nm b on b.company_id = i.company_id and b.raw = i.name)"""


def _labels_sql(host: str) -> str:
    all_ = f"list_filter(list_transform(string_split({host}, '.'), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g')), lambda x: x <> '')"
    return f"(case when len({all_}) > 1 then {all_}[:-2] else {all_} end)"


def _bears_sql() -> str:
    """Of a name's row ``nm`` and ``labels``: the host bears it."""
    end = lambda x: f"(length({x}) >= 5 and {_any('labels', f'starts_with(x, {x}) or ends_with(x, {x})')})"
    affix = lambda x: f"(length({x}) between 3 and 4 and {_any('labels', ' or '.join([f'x = {x} || {e!r}' for e in N.HOST_ENDINGS] + [f'x = {b!r} || {x}' for b in N.HOST_BEGINNINGS]))})"
    compact = "array_to_string(ident_raw, '')"
    return f"""coalesce((length({compact}) >= 3 and list_contains(labels, {compact})), false) or coalesce({end(compact)}, false) or coalesce({affix(compact)}, false) or coalesce(list_contains(labels, acronym), false) or coalesce({affix("acronym")}, false)
        or coalesce({affix("brand[1]")}, false) or coalesce(list_has_any(labels, legals), false) or coalesce(list_contains(labels, led), false) or list_has_any(labels, list_filter(ident_raw, lambda w: length(w) >= 3))"""


def _named_sql(pairs: str) -> str:
    """CTE ``named``: (company_id, host, bears) for the (company_id, host) of ``pairs``."""
    return f"""pairs as (select distinct company_id, host, {_labels_sql("host")} as labels from ({pairs})), named as (select p.company_id, p.host, bool_or({_bears_sql()}) as bears from pairs p join nm using (company_id) group by p.company_id, p.host)"""


def _shared_sql(host: str, vehicle: str) -> str:
    below = lambda hosts: f"({host} in {_in(hosts)} or {' or '.join(f'ends_with({host}, {chr(39)}.{h}{chr(39)})' for h in hosts)})"
    return f"({below(SHARED_HOSTS)} or ({vehicle} and {below(MANAGER_HOSTS)}))"


_VERDICT = f"case when {_any('excluded', _NEAR.format('host', 'x'))} then 'excluded' when {_any('verified', _NEAR.format('host', 'x'))} then 'verified' when bears then 'named' when home <> '' and {_NEAR.format('host', 'home')} then 'profile' else 'foreign' end"


def _mentions_sql() -> str:
    """Of an item (``title_words``, ``url_words``, ``host``, ``path_words``) and an issuer's ``ident``: the item mentions it."""
    term = lambda some, least: _any(some, f"len(list_filter(terms, lambda t: (length(t) >= {least} and x = t) or (length(x) >= 5 and length(t) >= 5 and abs(length(x) - length(t)) <= 3 and (starts_with(x, t) or starts_with(t, x))))) > 0")
    below = " or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in MANAGER_HOSTS)
    evidence = "list_concat(title_words, path_words)"
    vehicle = f"len(x) >= 2 and list_contains({evidence}, x[1]) and len(list_filter(x, lambda w: list_contains({evidence}, w))) >= case when len(x) >= 4 then 3 else 2 end and len(list_filter(x, lambda w: list_contains({evidence}, w) and w not in {_in(N.VEHICLE_CLASS_WORDS)})) > 0"
    return f"case when vehicle and ({below}) then {_any('idents', vehicle)} else {term('title_words', 1)} or {term('url_words', 4)} or {_any('short', f'list_contains(title_words, x) and list_contains({_labels_sql("host")}, x)')} end"


_ITEM_WORDS = f"{_words_sql('title')} as title_words, {_words_sql('canonical_url')} as url_words, {_words_sql("regexp_replace(canonical_url, '^[a-z]+://[^/?#]*([^?#]*).*$', '\\1')")} as path_words, {_HOST.format('canonical_url')} as host"


@query(
    "scope_mentions",
    f"""with {_identity_sql()}, w as (select distinct id, unnest(list_concat({_words_sql("title")}, list_filter({_words_sql("canonical_url")}, lambda w: length(w) >= 4))) as word from published),
    t as (select unnest(terms) as term, company_id from ident), tt as (select term, count(*) as n_companies, min(company_id) as company_id from t group by term),
    f as (select id, word, term from w join tt on word = term or (length(word) >= 5 and length(term) >= 5 and abs(length(word) - length(term)) <= 3 and (starts_with(word, term) or starts_with(term, word)))),
    x as (select word, term from f qualify row_number() over (partition by word order by length(term) desc, term) = 1), b as (select id, word, term from w join x using (word) qualify row_number() over (partition by id order by length(term) desc, term, word) = 1)
    select id, word, term, cast(n_companies as bigint) as n_companies, company_id from b join tt using (term)""",
)
def _q_scope_mentions(r: Relations) -> DataFrame:
    return scope_mentions(r.published, with_identity(r.issuers))


@query(
    "cross_company_quarantine",
    f"""with {_identity_sql()}, pub as (select id, company_id, title, canonical_url, {_ITEM_WORDS} from published where not is_private),
    {_named_sql("select company_id, host from pub union all select a.company_id, b.host from pub a join pub b on a.canonical_url = b.canonical_url")},
    claims as (select distinct canonical_url, company_id, issuer, issuer_words from pub join ident using (company_id)),
    rivals as (select a.canonical_url, a.company_id, count(*) as n_competing from claims a join claims b on a.canonical_url = b.canonical_url and a.issuer <> b.issuer and (a.issuer_words is null or b.issuer_words is null or a.issuer_words <> b.issuer_words) group by all),
    j as (select p.*, d.* exclude (company_id), n_competing, bears from pub p join ident d using (company_id) join rivals using (canonical_url, company_id) join named n on n.company_id = p.company_id and n.host = p.host),
    s as (select *, (not {_shared_sql("host", "vehicle")} and {_VERDICT} in ('verified', 'named', 'profile')) or {_mentions_sql()} as scoped, home is null or home = '' or {_NEAR.format("host", "home")} as at_home from j),
    rival as (select s.id, s.issuer as own, s.issuer_words as own_words, s.collision as own_collision, s.title_words, s.url_words, s.path_words, s.host, c.company_id, d.* exclude (company_id), n.bears from s join claims c using (canonical_url)
        join ident d on d.company_id = c.company_id join named n on n.company_id = c.company_id and n.host = s.host where s.scoped and not s.at_home and len(s.collision) > 0),
    lost as (select distinct id from rival where issuer <> own and (issuer_words is null or own_words is null or issuer_words <> own_words) and len(own_collision) < len(collision) and len(list_intersect(own_collision, collision)) = len(own_collision)
        and not {_shared_sql("host", "vehicle")} and {_VERDICT} in ('verified', 'named', 'profile') and {_mentions_sql()})
    select id, company_id, cast(n_competing as bigint) as n_competing, not scoped or id in (select id from lost) as quarantined from s""",
)
def _q_cross(r: Relations) -> DataFrame:
    return cross_company_claims(r.published, r.issuers)


@query(
    "host_policy",
    f"""with {_identity_sql()}, h as (select distinct company_id, {_HOST.format("canonical_url")} as host from published), {_named_sql("select * from h")}
    select company_id, host, {_VERDICT} as verdict, {_shared_sql("host", "vehicle")} as shared from h join ident using (company_id) join named using (company_id, host)""",
)
def _q_host_policy(r: Relations) -> DataFrame:
    """What each host that an issuer publishes on is to it, judged once a pair, and whether many companies share the host."""
    pairs = r.published.select("company_id", U.bare_host(F.col("canonical_url")).alias("host")).distinct()
    host = F.col("host")
    return pairs.join(with_identity(r.issuers), "company_id").select("company_id", "host", host_verdict(host, _columns()).alias("verdict"), is_shared(host, F.col("vehicle")).alias("shared"))


_OWNED = f"case when coalesce({_any('excluded', _NEAR.format('host', 'x'))} or {_any('excluded', _NEAR.format('last', 'x'))}, false) then null when {{0}} then 'verified_publication_host' when {{1}} then 'official_profile_host' when home <> '' and {_NEAR.format('source', 'home')} then 'official_profile_link_evidence' when method = 'html_alternate' and by_link then 'company_name_link_evidence' when by_host and by_last then 'company_name_matches_feed_host' end"
_SAME = _NEAR.format("host", "last")


@query(
    "ownership_reasons",
    f"""with {_identity_sql()}, k as (select candidate_id, company_id, method, {_HOST.format("candidate_url")} as host, {_HOST.format("coalesce(final_url, candidate_url)")} as last, {_HOST.format("found_on")} as source from feed_claims),
    {_named_sql("select company_id, host from k union all select company_id, last from k union all select company_id, source from k where source is not null")},
    j as (select k.*, d.* exclude (company_id), a.bears as by_host, b.bears as by_last, coalesce(c.bears, false) as by_link from k join ident d using (company_id) join named a on a.company_id = k.company_id and a.host = k.host join named b on b.company_id = k.company_id and b.host = k.last
        left join named c on c.company_id = k.company_id and c.host = k.source)
    select candidate_id, {_OWNED.format(f"{_any('verified', _NEAR.format('host', 'x'))} and ({_any('verified', _NEAR.format('last', 'x'))} or {_SAME})", f"home <> '' and {_NEAR.format('host', 'home')} and ({_NEAR.format('last', 'home')} or {_SAME})")} as reason from j""",
)
def _q_ownership(r: Relations) -> DataFrame:
    """The first of the five reasons, by which a feed is its issuer's own; none on excluded hosts."""
    found = F.array_compact(F.array(F.when(F.col("found_on").isNotNull(), F.struct("method", "found_on"))))
    reason = ownership_reason(F.col("candidate_url"), F.col("final_url"), found, _columns())
    return r.feed_claims.join(with_identity(r.issuers), "company_id").select("candidate_id", reason.alias("reason"))


@query(
    "vehicle_identity",
    f"""with {_identity_sql()}, pub as (select id, company_id, title, canonical_url, {_ITEM_WORDS} from published)
    select id, company_id, {" or ".join(f"host = '{h}' or ends_with(host, '.{h}')" for h in MANAGER_HOSTS)} as by_manager, {_mentions_sql()} as mentioned from pub join ident using (company_id) where vehicle""",
)
def _q_vehicles(r: Relations) -> DataFrame:
    """Items of trusts and funds: on a manager's host several words of the name must be said, elsewhere a term is enough."""
    funds = with_identity(r.issuers).where("vehicle")
    return r.published.join(funds, "company_id").select("id", "company_id", is_below(U.bare_host(F.col("canonical_url")), MANAGER_HOSTS).alias("by_manager"), mentions_company(_columns()).alias("mentioned"))
