"""Ownership, scope and lifecycle policies, producers of due work, and checks that stand for database constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import text as T
from newsweft.functions import urls as U
from newsweft.operators import reads
from newsweft.plans.catalog import query
from newsweft.plans.dialect import AS_OF, DUCK
from newsweft.plans.relations import Relations

_ASOF = DUCK.ts(AS_OF)
# Words around a company's name in its host.
HOST_AFFIXES = ("group", "corp", "inc", "global", "news", "ir", "investors", "press", "media", "co", "holdings")
MOST_SEEDS = 12


def host_matches_name(name: Column, host: Column) -> Column:
    """The host's main label is the issuer's compact name, its acronym of three letters or more, or the name with an affix."""
    label = F.regexp_replace(F.regexp_extract(F.regexp_replace(host, r"^(www|ir|investors?|news|blog|press)\.", ""), r"^([^.]+)\.", 1), "[^a-z0-9]", "")
    compact = T.issuer_key(name)
    words = F.filter(F.split(F.lower(T.search_name(name)), "[^a-z0-9]+"), lambda w: w != "")
    acronym = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    affixed = reduce(lambda a, b: a | b, [(label == F.concat(compact, F.lit(x))) | (label == F.concat(F.lit(x), compact)) for x in HOST_AFFIXES])
    return (compact != "") & ((label == compact) | affixed | ((F.length(acronym) >= 3) & (label == acronym)))


# Hosts that bear a company's name, the name with an affix, one of another company, and a candidate's own.
_HOST_URLS = """select k.company_id, c.name, case k.company_id % 5 when 0 then 'https://www.' || replace(c.company_key, '-', '') || '.com/x' when 1 then 'https://ir.' || replace(c.company_key, '-', '') || 'group.com' when 2 then 'https://news' || replace(c.company_key, '-', '') || '.org/a'
    when 3 then 'https://x' || replace(c.company_key, '-', '') || '.com' else k.url end as url from candidates k join companies c on c.company_id = k.company_id"""
_BASE = r"trim(regexp_replace(name, '(?i)\s+(class [a-d].*|series [a-d].*|common stock|capital stock|ordinary shares)\s*$', ''))"
_SEARCH = r"trim(regexp_replace(regexp_replace(b, '(?i)[\s,]+(inc|corp)\.?$', ''), '(?i)[\s,]+(inc|corp)\.?$', ''))"


def _hosts_sql() -> str:
    affixes = ", ".join(f"'{x}'" for x in HOST_AFFIXES)
    return rf"""with p as (select distinct company_id, name, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^(www\.)+', '') as host from ({_HOST_URLS})),
        n as (select *, {_BASE} as b from p), s as (select *, {_SEARCH} as sn from n),
        l as (select *, regexp_replace(regexp_extract(regexp_replace(host, '^(www|ir|investors?|news|blog|press)\.', ''), '^([^.]+)\.', 1), '[^a-z0-9]', '', 'g') as label, regexp_replace(lower(sn), '[^a-z0-9]+', '', 'g') as compact,
            array_to_string(list_transform(list_filter(string_split_regex(lower(sn), '[^a-z0-9]+'), lambda w : w <> ''), lambda w : w[1]), '') as acronym from s)
        select company_id, host, compact <> '' and (label = compact or len(list_filter([{affixes}], lambda x : label = compact || x or label = x || compact)) > 0 or (length(acronym) >= 3 and label = acronym)) as matches from l"""


@query("company_hosts", _hosts_sql())
def _q_hosts(r: Relations) -> DataFrame:
    """Whether hosts bear their company's name; judged once for each distinct pair."""
    pairs = r.sql(_HOST_URLS).select("company_id", "name", U.bare_host(F.col("url")).alias("host")).distinct()
    judged = pairs.select("name", "host").distinct().withColumn("matches", host_matches_name(F.col("name"), F.col("host")))
    return pairs.join(judged, ["name", "host"]).select("company_id", "host", "matches")


@query("recipe_lifecycle", "select r.recipe_id, coalesce(st.rebuild_required, false) as requires_rebuild, r.status = 'active' and (coalesce(st.rebuild_required, false) or st.correctness_status = 'failing' or st.freshness_status = 'stale') as rebuild_candidate, r.status = 'active' and not coalesce(st.rebuild_required, false) and coalesce(st.correctness_status, 'healthy') = 'healthy' as healthy_active from recipes r left join recipe_state st on st.recipe_id = r.recipe_id")
def _q_lifecycle(r: Relations) -> DataFrame:
    active, rebuild = F.col("status") == "active", F.coalesce("rebuild_required", F.lit(False))
    failing, stale = F.coalesce(F.col("correctness_status") == "failing", F.lit(False)), F.coalesce(F.col("freshness_status") == "stale", F.lit(False))
    healthy = active & ~rebuild & (F.coalesce("correctness_status", F.lit("healthy")) == "healthy")
    return r.recipes.join(r.recipe_state, "recipe_id", "left").select("recipe_id", rebuild.alias("requires_rebuild"), (active & (rebuild | failing | stale)).alias("rebuild_candidate"), healthy.alias("healthy_active"))


def is_retryable(status: Column) -> Column:
    """408, 429 and server errors may be tried again."""
    return status.isin(408, 429) | status.between(500, 599)


@query("retry_classes", "select 400 + k * 2 as http_status, (400 + k * 2 in (408, 429) or 400 + k * 2 between 500 and 599) as retryable, cast(count(*) as bigint) as n from crawl_runs where not succeeded group by all")
def _q_retry(r: Relations) -> DataFrame:
    status = (F.col("k") * 2 + 400).alias("http_status")
    return r.crawl_runs.filter("not succeeded").select(status).groupBy("http_status").agg(F.count(F.lit(1)).alias("n")).select("http_status", is_retryable(F.col("http_status")).alias("retryable"), "n")


@query("entry_points", "select company_id, role, 'https://' || company_key || '.org/' || role as url, pos from (select company_id, company_key, 'home' as role, 0 as pos from companies union all select company_id, company_key, 'ir', 1 from companies where has_ir_url union all select company_id, company_key, 'news', 2 from companies where market_cap > 5000)")
def _q_entry(r: Relations) -> DataFrame:
    """Each company's entry points with their place, in the fixed order of roles, missing ones left out."""
    url = lambda role: F.concat(F.lit("https://"), "company_key", F.lit(f".org/{role}"))
    point = lambda role, pos: F.struct(F.lit(role).alias("role"), url(role).alias("url"), F.lit(pos).alias("pos"))
    points = F.array_compact(F.array(point("home", 0), F.when(F.col("has_ir_url"), point("ir", 1)), F.when(F.col("market_cap") > 5000, point("news", 2))))
    return r.companies.select("company_id", F.explode(points).alias("p")).select("company_id", "p.*")


@query(
    "publication_seeds",
    """with d as (select company_id, url, row_number() over (partition by company_id, regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '/+$', '') order by n) as rn, n from sources),
    k as (select *, row_number() over (partition by company_id order by n) as place from d where rn = 1) select company_id, url, case when contains(url, 'news') then 'newsroom' when contains(url, 'feed') or contains(url, 'atom') then 'feed' else 'other' end as role from k where place <= 12""",
)
def _q_seeds(r: Relations) -> DataFrame:
    """A company's publications, each identity once, at most twelve, with the role that their URL suggests."""
    once = r.sources.groupBy("company_id", U.publication_identity(F.col("url")).alias("identity")).agg(F.min(F.struct("n", "url")).alias("b"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("b.n"))
    role = F.when(F.contains("url", F.lit("news")), "newsroom").when(F.contains("url", F.lit("feed")) | F.contains("url", F.lit("atom")), "feed").otherwise("other")
    return once.withColumn("place", place).filter(F.col("place") <= MOST_SEEDS).select("company_id", F.col("b.url").alias("url")).withColumn("role", role)


@query("recipe_activation", "select recipe_id, version, case when row_number() over (partition by source_id order by version desc, recipe_id) = 1 then 'active' else 'superseded' end as new_status from recipes")
def _q_activation(r: Relations) -> DataFrame:
    """The newest version of a source's recipes is active, the others are superseded."""
    newest = r.recipes.groupBy("source_id").agg(F.max_by("recipe_id", F.struct("version", F.expr("0"))).alias("newest"))
    j = r.recipes.join(newest, "source_id")
    return j.select("recipe_id", "version", F.when(F.col("recipe_id") == F.col("newest"), "active").otherwise("superseded").alias("new_status"))


@query("overdue_recipes", f"with l as (select source_id, max(started_at) filter (where succeeded and items_found > 30) as good from crawl_runs group by 1) select r.recipe_id, case when l.good is null or l.good < {_ASOF} - interval 60 hour then 'stale' else 'fresh' end as freshness from recipes r left join l on l.source_id = r.source_id where r.status = 'active'")
def _q_overdue(r: Relations) -> DataFrame:
    good = r.crawl_runs.filter("succeeded and items_found > 30").groupBy("source_id").agg(F.max("started_at").alias("good"))
    late = F.col("good").isNull() | (F.col("good") < r.as_of - F.expr("interval 60 hours"))
    return r.recipes.filter("status = 'active'").join(good, "source_id", "left").select("recipe_id", F.when(late, "stale").otherwise("fresh").alias("freshness"))


@query("run_lifecycle", "with l as (select source_id, max(run_id) as last from crawl_runs group by 1) select c.run_id, case when succeeded then 'completed' when c.run_id = l.last then 'failed' when k % 4 = 0 then 'abandoned' else 'failed' end as outcome from crawl_runs c join l on l.source_id = c.source_id")
def _q_runs(r: Relations) -> DataFrame:
    """How each run ended: one without a result that a later run of its source overtook was abandoned."""
    last = r.crawl_runs.groupBy("source_id").agg(F.max("run_id").alias("last"))
    outcome = F.when(F.col("succeeded"), "completed").when(F.col("run_id") == F.col("last"), "failed").when(F.col("k") % 4 == 0, "abandoned").otherwise("failed")
    return r.crawl_runs.join(last, "source_id").select("run_id", outcome.alias("outcome"))


# Every fifth title names the alias of some other company.
_MENTIONS = "select f.id, f.company_id, case when f.doc_id % 5 = 0 then f.title || ' with ' || c.alias || ' today' else f.title end as title from feed_items f left join companies c on c.company_id = 7 + f.doc_id % 50"


@query("alias_mentions", f"select distinct i.id, c.company_id from (select id, company_id as own, unnest(string_split_regex(lower(title), '[^a-z0-9-]+')) as w from ({_MENTIONS})) i join companies c on lower(c.alias) = i.w where c.company_id <> i.own")
def _q_mentions(r: Relations) -> DataFrame:
    """Items whose title names another company's alias: words are exploded, so the join is on equality."""
    words = r.sql(_MENTIONS).select("id", F.col("company_id").alias("own"), F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z0-9-]+"))).alias("w"))
    names = r.companies.select("company_id", F.lower("alias").alias("w"))
    # Spark takes the exploded side for as small as its input and might broadcast it.
    return words.hint("merge").join(names, "w").filter("own <> company_id").select("id", "company_id").distinct()


@query("namespace_filter", r"with c as (select company_id, split_part(regexp_replace(url, '^https?://', ''), '/', 2) as ns, count(*) as n from feed_items group by all), t as (select *, row_number() over (partition by company_id order by n desc, ns) as rn, sum(n) over (partition by company_id) as total from c), d as (select company_id, ns from t where rn = 1 and n >= 5 and 2 * n > total) select f.id, d.ns is null or d.ns = split_part(regexp_replace(f.url, '^https?://', ''), '/', 2) as accepted from feed_items f left join d on d.company_id = f.company_id")
def _q_namespace(r: Relations) -> DataFrame:
    """Items outside their company's dominant namespace are not accepted; without one all are."""
    best = reads._q_namespace(r).select("company_id", F.col("ns").alias("best"))
    ns = F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(2))
    return r.feed_items.select("id", "company_id", ns.alias("ns")).join(best, "company_id", "left").select("id", (F.col("best").isNull() | (F.col("best") == F.col("ns"))).alias("accepted"))


# Some recipes' addresses carry a user, lack a host, or are no web address.
_BROKEN = "select recipe_id, version, verified_at, created_at, case when recipe_id like '%3' then replace(publication_url, '://', '://user@') when recipe_id like '%6' then 'https:///news' when recipe_id like '%7' then replace(publication_url, 'https', 'ftp') else publication_url end as publication_url from recipes"


@query("spec_violations", rf"with broken as ({_BROKEN}) select rule, recipe_id from (select 'version' as rule, recipe_id, version < 1 as bad from broken union all select 'public_url', recipe_id, not regexp_matches(publication_url, '^https?://[^/?#@]+\.[^/?#@.]+([/?#]|$)') from broken union all select 'verified_before_created', recipe_id, verified_at < created_at from broken) where bad")
def _q_spec(r: Relations) -> DataFrame:
    """The rules that recipe rows break, one row for each."""
    broken = F.array_compact(F.array(F.when(F.col("version") < 1, "version"), F.when(~F.col("publication_url").rlike(r"^https?://[^/?#@]+\.[^/?#@.]+([/?#]|$)"), "public_url"), F.when(F.col("verified_at") < F.col("created_at"), "verified_before_created")))
    return r.sql(_BROKEN).select(F.explode(broken).alias("rule"), "recipe_id")


def sync_config(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, values, action): configured rows win, rows that the configuration lacks stay untouched."""
    o, n = old.alias("o"), new.alias("n")
    same = reduce(lambda a, b: a & b, [F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}")) for v in values])
    action = F.when(F.col(f"n.{values[0]}").isNull(), "kept").when(F.col(f"o.{values[0]}").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return o.join(n, key, "full").select(key, *[F.coalesce(f"n.{v}", f"o.{v}").alias(v) for v in values], action.alias("action"))


@query("config_sync", "with o as (select source_id, kind, url from sources where n % 4 <> 1), w as (select source_id, case when n % 5 = 0 then 'html' else kind end as kind, url from sources where n % 3 <> 1) select coalesce(w.source_id, o.source_id) as source_id, coalesce(w.kind, o.kind) as kind, coalesce(w.url, o.url) as url, case when w.kind is null then 'kept' when o.kind is null then 'inserted' when o.kind = w.kind and o.url = w.url then 'unchanged' else 'updated' end as action from o full join w on o.source_id = w.source_id")
def _q_sync(r: Relations) -> DataFrame:
    new = r.sources.filter("n % 3 <> 1").select("source_id", F.when(F.col("n") % 5 == 0, "html").otherwise(F.col("kind")).alias("kind"), "url")
    return sync_config(r.sources.filter("n % 4 <> 1").select("source_id", "kind", "url"), new, "source_id", ["kind", "url"])


@query(
    "company_profiles",
    """select c.company_id, cast(coalesce(s.n, 0) as bigint) as n_sources, cast(coalesce(i.n, 0) as bigint) as n_items, cast(coalesce(r.n, 0) as bigint) as n_recipes, cast(coalesce(k.n, 0) as bigint) as n_candidates from companies c
    left join (select company_id, count(*) as n from sources group by 1) s using (company_id) left join (select company_id, count(*) as n from feed_items where not is_private group by 1) i using (company_id)
    left join (select company_id, count(*) as n from recipes where status = 'active' group by 1) r using (company_id) left join (select company_id, count(*) as n from candidates group by 1) k using (company_id)""",
)
def _q_profiles(r: Relations) -> DataFrame:
    """What each company has: every part is counted by company before it is joined."""
    out = r.companies.select("company_id")
    for name, rows in (("n_sources", r.sources), ("n_items", r.feed_items.filter("not is_private")), ("n_recipes", r.recipes.filter("status = 'active'")), ("n_candidates", r.candidates)):
        out = out.join(rows.groupBy("company_id").agg(F.count(F.lit(1)).alias(name)), "company_id", "left")
    return out.select("company_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sources", "n_items", "n_recipes", "n_candidates")])


def expectations(df: DataFrame, unique: list[str], present: list[str], within: dict[str, list[str]]) -> DataFrame:
    """(rule, n): how many rows break each constraint that the database would have held."""
    checks = [F.count_if(F.col(c).isNull()).alias(f"present:{c}") for c in present] + [F.count_if(~F.coalesce(F.col(c).isin(*v), F.lit(False))).alias(f"within:{c}") for c, v in within.items()]
    flat = df.agg(*checks)
    names = [*(f"present:{c}" for c in present), *(f"within:{c}" for c in within)]
    rows = flat.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select("x.*")
    twice = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("n")).select(F.lit(f"unique:{','.join(unique)}").alias("rule"), "n")
    return rows.unionByName(twice)


@query(
    "integrity_report",
    """select 'present:id' as rule, cast(count(*) filter (where id is null) as bigint) as n from feed_items union all select 'present:canonical_url', cast(count(*) filter (where canonical_url is null) as bigint) from feed_items
    union all select 'within:source_kind', cast(count(*) filter (where source_kind not in ('rss', 'atom', 'html')) as bigint) from feed_items union all select 'unique:source_id,canonical_url', cast(coalesce(sum(c - 1) filter (where c > 1), 0) as bigint) from (select count(*) as c from feed_items group by source_id, canonical_url)""",
)
def _q_integrity(r: Relations) -> DataFrame:
    return expectations(r.feed_items, ["source_id", "canonical_url"], ["id", "canonical_url"], {"source_kind": ["rss", "atom", "html"]})


@query("due_discovery", f"select c.company_id, cast(coalesce(l.n, 0) as bigint) as n_runs from companies c left join (select user_id as company_id, count(*) as n, max(ts) as last_at from events where event_type = 'view' group by 1) l on l.company_id = c.company_id where c.lifecycle_status = 'active' and (l.last_at is null or l.last_at <= {_ASOF} - interval 4 day) and not exists (select 1 from candidates k where k.company_id = c.company_id and k.status = 'pending' and k.confidence > 0.95)")
def _q_due(r: Relations) -> DataFrame:
    """Active companies whose last discovery is long ago and that have no strong candidate waiting."""
    last = r.events.filter("event_type = 'view'").groupBy(F.col("user_id").alias("company_id")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))
    waiting = r.candidates.filter("status = 'pending' and confidence > 0.95").select("company_id")
    due = r.companies.filter("lifecycle_status = 'active'").join(last, "company_id", "left").filter(F.col("last_at").isNull() | (F.col("last_at") <= r.as_of - F.expr("interval 4 days")))
    return due.join(waiting, "company_id", "left_anti").select("company_id", F.coalesce("n", F.lit(0)).alias("n_runs"))


@query(
    "news_page_envelope",
    f"""with {reads._VISIBLE}, v as (select id, company_id, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') as published_at from visible where {reads._NOW}), p as (select * from v order by published_at desc nulls last, id limit {reads.PAGE})
    select (select list('{{"id":' || to_json(id) || ',"company_id":' || company_id || ',"title":' || to_json(title) || coalesce(',"published_at":' || to_json(published_at), '') || '}}' order by published_at desc nulls last, id) from p) as items,
        (select count(*) from v) as total, {reads.PAGE} as "limit", 0 as "offset" """,
)
def _q_envelope(r: Relations) -> DataFrame:
    """The listing as one page object: items, total, limit, offset."""
    rows = reads.visible_items(r, include_future=False).select("id", "company_id", "title", F.col("published_at").cast("string").alias("published_at"))
    return reads.page_envelope(rows, [F.col("published_at").desc_nulls_last(), F.col("id")], limit=reads.PAGE, offset=0)
