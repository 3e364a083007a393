"""The read queries: visibility, duplicate ranking, overlap, claims, coverage, dashboards and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import text as T
from newsweft.functions import urls as U
from newsweft.plans.catalog import query
from newsweft.plans.dialect import AS_OF, DUCK
from newsweft.plans.relations import Relations

PAGE, MOST_PAGE = 50, 200
_KEY = DUCK.url_key
_ASOF = DUCK.ts(AS_OF)


def healthy_recipes(r: Relations) -> DataFrame:
    """Active recipes that need no rebuild; a recipe without state needs none."""
    state = r.recipe_state.select("recipe_id", "rebuild_required")
    return r.recipes.filter("status = 'active'").join(state, "recipe_id", "left").filter(~F.coalesce("rebuild_required", F.lit(False))).drop("rebuild_required")


def visible_items(r: Relations, include_future: bool = True, as_of: Column | None = None) -> DataFrame:
    """Public items: not private, of an approved source that is a feed or has a healthy recipe; future ones by choice.

    The sources and recipes are one row each, so both joins are on the small side; AQE broadcasts them if they are.
    """
    backed = healthy_recipes(r).select("source_id").distinct().withColumn("backed", F.lit(True))
    sources = r.sources.filter("status = 'approved'").join(backed, "source_id", "left").filter(F.col("kind").isin("rss", "atom") | F.col("backed"))
    items = r.feed_items.filter("not is_private").join(sources.select("source_id", F.col("kind").alias("kind"), "public_export_allowed"), "source_id")
    if not include_future:
        items = items.filter(F.col("published_at").isNull() | (F.col("published_at") <= (as_of if as_of is not None else r.as_of)))
    return items


def kind_rank(kind: Column) -> Column:
    return F.when(kind == "rss", 0).when(kind == "atom", 1).when(kind == "html", 2).otherwise(3)


def _first(df: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group; Spark keeps one row a group and task before it shuffles."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("rn = 1").drop("rn")


def one_per_url(items: DataFrame) -> DataFrame:
    keyed = items.withColumn("url_key", U.identity_key(F.col("canonical_url")))
    return _first(keyed, [F.col("company_id"), F.col("url_key")], [kind_rank(F.col("kind")), F.col("fetched_at").desc(), F.col("id")])


def one_per_story(items: DataFrame) -> DataFrame:
    story = items.withColumn("story", T.story_identity(F.col("url_key"), F.col("title"), F.col("published_at")))
    return _first(story, [F.col("company_id"), F.col("story")], [kind_rank(F.col("source_kind")), F.col("fetched_at").desc(), F.col("id")])


def news_items(r: Relations, limit: int = MOST_PAGE, offset: int = 0, company_id: int | None = None, source_kind: str | None = None, search: str | None = None, include_future: bool = False) -> DataFrame:
    """The public listing: one row for each story, newest first. Ids are ranked narrow; texts join the page's rows alone.

    ``search`` is a pattern: its % and _ are wildcards.
    """
    seen = visible_items(r, include_future)
    if company_id is not None:
        seen = seen.filter(F.col("company_id") == company_id)
    if source_kind is not None:
        seen = seen.filter(F.col("source_kind") == source_kind)
    if search is not None:
        names = r.companies.select("company_id", "name")
        hit = lambda c: F.col(c).ilike(f"%{search}%")
        seen = seen.join(names, "company_id").filter(hit("name") | hit("title") | hit("summary")).drop("name")
    narrow = seen.select("id", "company_id", "canonical_url", "title", "published_at", "fetched_at", "source_kind", "created_at", "kind")
    stories = one_per_story(one_per_url(narrow)).select("id", F.coalesce("published_at", "created_at").alias("sort_at"), "created_at")
    page = stories.orderBy(F.desc("sort_at"), F.desc("created_at"), "id").offset(offset).limit(limit)
    full = r.feed_items.select("id", "company_id", "source_id", "canonical_url", "title", F.length("body_text").alias("body_chars"), "published_at", "source_kind", "content_hash")
    names = r.companies.select("company_id", "company_key", F.col("name").alias("company_name"))
    return full.join(page.select("id", "sort_at", F.col("created_at").alias("sort_created")), "id").join(names, "company_id").orderBy(F.desc("sort_at"), F.desc("sort_created"), "id").drop("sort_at", "sort_created")


_VISIBLE = """visible as (
    select item.*, source.kind as kind, source.public_export_allowed from feed_items as item join sources as source on source.source_id = item.source_id
    where not item.is_private and source.status = 'approved' and (source.kind in ('rss', 'atom') or exists (
        select 1 from recipes as recipe left join recipe_state as state on state.recipe_id = recipe.recipe_id
        where recipe.source_id = source.source_id and recipe.status = 'active' and not coalesce(state.rebuild_required, false))))"""
_KIND = "case {} when 'rss' then 0 when 'atom' then 1 when 'html' then 2 else 3 end"
_STORY = f"case when published_at is null then 'url:' || {_KEY('canonical_url')} else 'dated-title:' || cast(cast(published_at as date) as string) || ':' || lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) end"


def _stories(where: str) -> str:
    return f"""{_VISIBLE}, by_url as (
        select *, row_number() over (partition by company_id, {_KEY('canonical_url')} order by {_KIND.format('kind')}, fetched_at desc, id) as a from visible where {where}),
    by_story as (select *, row_number() over (partition by company_id, {_STORY} order by {_KIND.format('source_kind')}, fetched_at desc, id) as b from by_url where a = 1),
    stories as (select * from by_story where b = 1)"""


_NOW = f"(published_at is null or published_at <= {_ASOF})"
_LISTED = "s.id, s.company_id, s.source_id, s.canonical_url, s.title, cast(length(s.body_text) as int) as body_chars, s.published_at, s.source_kind, s.content_hash, c.company_key, c.name as company_name"


@query("news_items", f"with {_stories(_NOW)} select {_LISTED} from stories s join companies c on c.company_id = s.company_id order by coalesce(published_at, created_at) desc, created_at desc, id limit {MOST_PAGE}")
def _q_news_items(r: Relations) -> DataFrame:
    return news_items(r)


@query("news_items_all", f"with {_stories('true')} select {_LISTED} from stories s join companies c on c.company_id = s.company_id")
def _q_news_all(r: Relations) -> DataFrame:
    return news_items(r, limit=2**31 - 1, include_future=True)


@query(
    "news_items_search",
    f"with {_stories(f'{_NOW} and (title ilike $$%th_n%$$ or summary ilike $$%th_n%$$ or company_id in (select company_id from companies where name ilike $$%th_n%$$))')} select {_LISTED} from stories s join companies c on c.company_id = s.company_id order by coalesce(published_at, created_at) desc, created_at desc, id limit {PAGE}",
)
def _q_search(r: Relations) -> DataFrame:
    return news_items(r, limit=PAGE, search="th_n")


@query("news_items_count", f"with {_stories(_NOW)} select company_id, cast(count(*) as bigint) as n_stories from stories group by company_id")
def _q_count(r: Relations) -> DataFrame:
    narrow = visible_items(r, include_future=False).select("id", "company_id", "canonical_url", "title", "published_at", "fetched_at", "source_kind", "kind")
    return one_per_story(one_per_url(narrow)).groupBy("company_id").agg(F.count(F.lit(1)).alias("n_stories"))


@query("visible_items", f"with {_VISIBLE} select id, company_id, source_id, kind from visible where {_NOW}")
def _q_visible(r: Relations) -> DataFrame:
    return visible_items(r, include_future=False).select("id", "company_id", "source_id", "kind")


@query("url_identity", f"select page_id, {_KEY('url')} as identity from pages")
def _q_identity(r: Relations) -> DataFrame:
    return r.pages.select("page_id", U.identity_key(F.col("url")).alias("identity"))


@query("feed_items_page", f"with {_VISIBLE} select id, company_id, title, published_at from visible where {_NOW} order by published_at desc nulls last, fetched_at desc, id limit {PAGE} offset {PAGE}")
def _q_page(r: Relations) -> DataFrame:
    rows = visible_items(r, include_future=False).select("id", "company_id", "title", "published_at", "fetched_at")
    return rows.orderBy(F.col("published_at").desc_nulls_last(), F.desc("fetched_at"), "id").offset(PAGE).limit(PAGE).drop("fetched_at")


# Overlap: a candidate URL claims an item by any of its three URLs. One row for each key makes it one equality join.


def item_keys(items: DataFrame) -> DataFrame:
    """(columns of ``items``, key): a row for each distinct identity of an item's three URLs."""
    keys = F.array_distinct(F.array(*(U.identity_key(F.col(c)) for c in ("canonical_url", "url", "external_id"))))
    return items.withColumn("key", F.explode(F.filter(keys, lambda k: k.isNotNull())))


def candidate_urls(r: Relations) -> DataFrame:
    return r.pages.select(F.col("url").alias("candidate_url"), U.identity_key(F.col("url")).alias("key")).distinct()


def feed_backed(r: Relations) -> DataFrame:
    approved = r.sources.filter("status = 'approved' and kind in ('rss', 'atom')").select("source_id")
    return r.feed_items.filter("not is_private").join(approved, "source_id", "left_semi")


def url_matches(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct (company_id, candidate_url) where an item of the company has one of its identities."""
    return item_keys(items.select("company_id", "canonical_url", "url", "external_id")).select("company_id", "key").distinct().join(candidates, "key").select("company_id", "candidate_url").distinct()


_CAND = f"cand as (select distinct url as candidate_url, {_KEY('url')} as key from pages)"
_ANY_KEY = f"cand.key in ({_KEY('item.canonical_url')}, {_KEY('item.url')}, {_KEY('item.external_id')})"
_FEED = "not item.is_private and source.status = 'approved' and source.kind in ('rss', 'atom')"


@query("url_matches", f"with {_CAND} select distinct item.company_id, cand.candidate_url from cand join feed_items item on {_ANY_KEY} join sources source on source.source_id = item.source_id where {_FEED}")
def _q_url_matches(r: Relations) -> DataFrame:
    return url_matches(feed_backed(r), candidate_urls(r))


@query(
    "active_recipe_url_matches",
    f"""with {_CAND} select distinct item.company_id, cand.candidate_url from cand join feed_items item on {_ANY_KEY} join sources source on source.source_id = item.source_id
    join recipes recipe on recipe.source_id = item.source_id left join recipe_state state on state.recipe_id = recipe.recipe_id
    where source.status = 'approved' and not item.is_private and recipe.status = 'active' and not coalesce(state.rebuild_required, false)""",
)
def _q_recipe_url_matches(r: Relations) -> DataFrame:
    backed = healthy_recipes(r).join(r.sources.filter("status = 'approved'").select("source_id"), "source_id", "left_semi").select("source_id").distinct()
    return url_matches(r.feed_items.filter("not is_private").join(backed, "source_id", "left_semi"), candidate_urls(r))


@query("public_item_claims", f"with {_VISIBLE}, {_CAND} select distinct cand.candidate_url, item.company_id, item.id from cand join visible item on {_ANY_KEY}")
def _q_claims(r: Relations) -> DataFrame:
    items = visible_items(r).select("id", "company_id", "canonical_url", "url", "external_id")
    return item_keys(items).select("id", "company_id", "key").join(candidate_urls(r), "key").select("candidate_url", "company_id", "id").distinct()


@query(
    "feed_company_claims",
    f"""with {_CAND} select item.company_id, company.name as company_name, cast(count(distinct cand.candidate_url) as bigint) as matched_items from cand
    join feed_items item on {_ANY_KEY} join sources source on source.source_id = item.source_id join companies company on company.company_id = item.company_id where {_FEED} group by all""",
)
def _q_company_claims(r: Relations) -> DataFrame:
    counted = url_matches(feed_backed(r), candidate_urls(r)).groupBy("company_id").agg(F.count(F.lit(1)).alias("matched_items"))
    return counted.join(r.companies.select("company_id", F.col("name").alias("company_name")), "company_id").select("company_id", "company_name", "matched_items")


def signatures(items: DataFrame) -> DataFrame:
    return items.withColumns({"sig": T.title_key(F.col("title")), "day": F.col("published_at").cast("date")})


_SIG = DUCK.title_key


@query(
    "signature_matches",
    f"""with candidate as (select id as identity, title, published_at, company_id from feed_items where source_kind not in ('rss', 'atom'))
    select distinct candidate.company_id, candidate.identity from candidate join feed_items item on item.company_id = candidate.company_id and {_SIG('item.title')} = {_SIG('candidate.title')}
    and cast(item.published_at as date) is not distinct from cast(candidate.published_at as date) join sources source on source.source_id = item.source_id where {_FEED}""",
)
def _q_signatures(r: Relations) -> DataFrame:
    """Candidates whose title and day, or missing day, a feed item of the company has. One side is made distinct first."""
    have = signatures(feed_backed(r).select("company_id", "title", "published_at")).select("company_id", "sig", "day").distinct()
    ask = signatures(r.feed_items.filter(~F.col("source_kind").isin("rss", "atom")).select(F.col("id").alias("identity"), "company_id", "title", "published_at"))
    a, b = ask.alias("a"), have.alias("b")
    return a.join(b, (F.col("a.company_id") == F.col("b.company_id")) & (F.col("a.sig") == F.col("b.sig")) & F.col("a.day").eqNullSafe(F.col("b.day")), "left_semi").select("company_id", "identity").distinct()


@query(
    "recipe_signature_matches",
    f"""with candidate as (select id as identity, title, published_at, company_id from feed_items where source_kind in ('rss', 'atom'))
    select distinct candidate.company_id, candidate.identity from candidate join feed_items item on item.company_id = candidate.company_id and {_SIG('item.title')} = {_SIG('candidate.title')}
    and cast(item.published_at as date) is not distinct from cast(candidate.published_at as date) join recipes recipe on recipe.source_id = item.source_id and recipe.status = 'active'
    left join recipe_state state on state.recipe_id = recipe.recipe_id where not item.is_private and not coalesce(state.rebuild_required, false)""",
)
def _q_recipe_signatures(r: Relations) -> DataFrame:
    backed = r.feed_items.filter("not is_private").join(healthy_recipes(r).select("source_id").distinct(), "source_id", "left_semi")
    have = signatures(backed.select("company_id", "title", "published_at")).select("company_id", "sig", "day").distinct()
    ask = signatures(r.feed_items.filter(F.col("source_kind").isin("rss", "atom")).select(F.col("id").alias("identity"), "company_id", "title", "published_at"))
    a, b = ask.alias("a"), have.alias("b")
    return a.join(b, (F.col("a.company_id") == F.col("b.company_id")) & (F.col("a.sig") == F.col("b.sig")) & F.col("a.day").eqNullSafe(F.col("b.day")), "left_semi").select("company_id", "identity").distinct()


@query("cross_company_items", f"with {_VISIBLE} select id, company_id from visible where {_KEY('canonical_url')} in (select {_KEY('canonical_url')} from visible group by 1 having count(distinct company_id) > 1)")
def _q_cross(r: Relations) -> DataFrame:
    """A key is shared when its least and greatest company differ, which needs no distinct count."""
    items = visible_items(r).select("id", "company_id", U.identity_key(F.col("canonical_url")).alias("key"))
    shared = items.groupBy("key").agg(F.min("company_id").alias("lo"), F.max("company_id").alias("hi")).filter("lo <> hi").select("key")
    return items.join(shared, "key", "left_semi").select("id", "company_id")


@query(
    "ownership_audit",
    f"""with {_VISIBLE}, keyed as (select id, company_id, {_KEY('canonical_url')} as key from visible), g as (select key, count(distinct company_id) as n from keyed group by key)
    select cast(count(*) as bigint) as n_items, cast(count(*) filter (where n > 1) as bigint) as n_colliding, cast(count(distinct keyed.key) filter (where n > 1) as bigint) as n_keys, cast(count(*) filter (where n = 1) as bigint) as n_distinct from keyed join g using (key)""",
)
def _q_audit(r: Relations) -> DataFrame:
    items = visible_items(r).select("company_id", U.identity_key(F.col("canonical_url")).alias("key"))
    keys = items.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("company_id") != F.max("company_id")).alias("hit"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("n_colliding"),
        F.count_if("hit").alias("n_keys"), F.coalesce(F.sum(F.when(~F.col("hit"), F.col("n"))), F.lit(0)).alias("n_distinct"),
    )


@query(
    "fully_covered_recipes",
    f"""with {_CAND}, active_item as (select recipe.recipe_id, {_KEY('item.canonical_url')} as ck, exists (select 1 from cand where cand.candidate_url like 'https%' and {_ANY_KEY}) as is_covered
    from recipes recipe join sources source on source.source_id = recipe.source_id join feed_items item on item.source_id = recipe.source_id left join recipe_state state on state.recipe_id = recipe.recipe_id
    where recipe.status = 'active' and source.status = 'approved' and not item.is_private and not coalesce(state.rebuild_required, false))
    select recipe_id, cast(count(distinct ck) as bigint) as n_items, cast(count(distinct ck) filter (where is_covered) as bigint) as n_covered,
    count(distinct ck) > 0 and count(distinct ck) = count(distinct ck) filter (where is_covered) as fully_covered from active_item group by recipe_id""",
)
def _q_covered(r: Relations) -> DataFrame:
    """How much of each healthy recipe's items the https candidates cover, and whether it is all of them."""
    approved = r.sources.filter("status = 'approved'").select("source_id")
    active = healthy_recipes(r).join(approved, "source_id", "left_semi").select("recipe_id", "source_id")
    items = r.feed_items.filter("not is_private").select("id", "source_id", "canonical_url", "url", "external_id").join(active, "source_id")
    have = candidate_urls(r).filter(F.col("candidate_url").startswith("https")).select("key").distinct().withColumn("hit", F.lit(True))
    per_item = item_keys(items).join(have, "key", "left").groupBy("recipe_id", "id", U.identity_key(F.col("canonical_url")).alias("ck")).agg(F.max(F.coalesce("hit", F.lit(False))).alias("hit"))
    per_key = per_item.groupBy("recipe_id", "ck").agg(F.max("hit").alias("hit"))
    out = per_key.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("hit").alias("n_covered"))
    return out.withColumn("fully_covered", F.col("n_items") == F.col("n_covered"))


@query(
    "preferred_recipes",
    f"""with counts as (select recipe.recipe_id, recipe.company_id, recipe.verified_at, recipe.created_at, count(distinct {_KEY('item.canonical_url')}) filter (where not item.is_private) as n
    from recipes recipe join sources source on source.source_id = recipe.source_id left join recipe_state state on state.recipe_id = recipe.recipe_id left join feed_items item on item.source_id = recipe.source_id
    where recipe.status = 'active' and source.status = 'approved' and not coalesce(state.rebuild_required, false) group by all)
    select cur.recipe_id as current_recipe, other.recipe_id as preferred_recipe, cast(other.n as bigint) as n_items from counts cur join counts other on other.company_id = cur.company_id and other.recipe_id <> cur.recipe_id
    where other.n > cur.n or (other.n = cur.n and (coalesce(other.verified_at, other.created_at), other.recipe_id) < (coalesce(cur.verified_at, cur.created_at), cur.recipe_id))""",
)
def _q_preferred(r: Relations) -> DataFrame:
    """Of a company's healthy recipes, which are preferred to which: more items, then verified earlier, then the smaller id."""
    active = healthy_recipes(r).join(r.sources.filter("status = 'approved'").select("source_id"), "source_id", "left_semi")
    items = r.feed_items.filter("not is_private").select("source_id", U.identity_key(F.col("canonical_url")).alias("ck")).distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    counts = active.join(items, "source_id", "left").select("recipe_id", "company_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("verified_at", "created_at").alias("at"))
    cur, other = counts.alias("cur"), counts.alias("other")
    rank = lambda t: F.struct(-F.col(f"{t}.n"), F.col(f"{t}.at"), F.col(f"{t}.recipe_id"))
    joined = cur.join(other, F.col("cur.company_id") == F.col("other.company_id")).filter(rank("other") < rank("cur"))
    return joined.select(F.col("cur.recipe_id").alias("current_recipe"), F.col("other.recipe_id").alias("preferred_recipe"), F.col("other.n").alias("n_items"))


@query(
    "publication_claims",
    r"""with p as (select recipe_id, company_id, status, 'https://' || regexp_replace(lower(split_part(split_part(publication_url, '//', 2), '/', 1)), '^(www\.)+', '') || '/' ||
    array_to_string(list_filter(string_split(array_to_string(string_split(split_part(split_part(publication_url, '?', 1), '#', 1), '/')[4:], '/'), '/'), lambda x : x <> ''), '/') as k from recipes)
    select a.recipe_id, a.company_id, cast(count(distinct b.company_id) as bigint) as n_companies from p a join p b on a.k = b.k where b.status = 'active' and a.status = 'active' group by all""",
)
def _q_publication_claims(r: Relations) -> DataFrame:
    keyed = r.recipes.filter("status = 'active'").select("recipe_id", "company_id", U.publication_identity(F.col("publication_url")).alias("k"))
    return keyed.join(keyed.groupBy("k").agg(F.countDistinct("company_id").alias("n_companies")), "k").select("recipe_id", "company_id", "n_companies")


@query("feed_source_claims", f"select {_KEY('url')} as identity, cast(count(distinct company_id) as bigint) as n_companies, min(source_id) as first_source from sources where status = 'approved' and kind in ('rss', 'atom') group by 1")
def _q_source_claims(r: Relations) -> DataFrame:
    feeds = r.sources.filter("status = 'approved' and kind in ('rss', 'atom')")
    return feeds.groupBy(U.identity_key(F.col("url")).alias("identity")).agg(F.countDistinct("company_id").alias("n_companies"), F.min("source_id").alias("first_source"))


_NAMES_OF = "select company_id, lower(trim(alias)) as k from companies union all select company_id, lower(trim(name)) from companies"


@query("alias_collisions", f"with n as (select distinct * from ({_NAMES_OF}) where k is not null), c as (select k, count(*) as n_companies, min(company_id) as first_company from n group by 1 having count(*) > 1) select n.company_id, n.k as name, cast(c.n_companies as bigint) as n_companies, c.first_company from n join c on c.k = n.k")
def _q_alias(r: Relations) -> DataFrame:
    """Aliases and names that several companies have, each company once with its class: its size and least company, no pairs."""
    named = r.sql(_NAMES_OF).filter("k is not null").distinct()
    classes = named.groupBy("k").agg(F.count(F.lit(1)).alias("n_companies"), F.min("company_id").alias("first_company")).filter("n_companies > 1")
    return named.join(classes, "k").select("company_id", F.col("k").alias("name"), "n_companies", "first_company")


@query("company_lookup", "select company_id, company_key, name from companies where lower(name) = 'customer#000000042' or lower(alias) = 'machinery-5' or company_key = 'customer-000000007'")
def _q_lookup(r: Relations) -> DataFrame:
    found = (F.lower("name") == "customer#000000042") | (F.lower("alias") == "machinery-5") | (F.col("company_key") == "customer-000000007")
    return r.companies.filter(found).select("company_id", "company_key", "name")


@query(
    "company_listing",
    """select c.company_id, c.company_key, coalesce(string_agg(s.source_id || ':' || s.kind, ',' order by s.kind, s.source_id), '') as sources, cast(count(s.source_id) as bigint) as n_sources
    from companies c left join sources s on s.company_id = c.company_id group by all""",
)
def _q_company_listing(r: Relations) -> DataFrame:
    """Each company with its ordered sources, empty where it has none."""
    made = r.sources.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("kind", "source_id"))).alias("l"), F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform("l", lambda s: F.concat(s["source_id"], F.lit(":"), s["kind"])), ",")
    return r.companies.select("company_id", "company_key").join(made.select("company_id", text.alias("sources"), F.col("n").alias("n_sources")), "company_id", "left").select("company_id", "company_key", F.coalesce("sources", F.lit("")).alias("sources"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


@query(
    "content_coverage",
    f"""with {_VISIBLE} select cast(count(*) as bigint) as n_public, cast(count(*) filter (where st.status = 'succeeded') as bigint) as n_succeeded, cast(count(*) filter (where st.status = 'failed') as bigint) as n_failed,
    cast(count(*) filter (where st.status = 'permanent_failure') as bigint) as n_permanent, cast(count(*) filter (where st.status is null) as bigint) as n_never, cast(count(*) filter (where length(trim(v.body_text)) >= 200) as bigint) as n_long,
    cast(count(*) filter (where length(trim(v.body_text)) = 0) as bigint) as n_empty, cast(count(*) filter (where st.status = 'failed' and st.next_attempt_at <= {_ASOF}) as bigint) as n_due
    from visible v left join content_state st on st.feed_item_id = v.id""",
)
def _q_coverage(r: Relations) -> DataFrame:
    items = visible_items(r).select("id", F.length(F.trim("body_text")).alias("chars")).join(r.content_state.withColumnRenamed("feed_item_id", "id"), "id", "left")
    s = F.col("status")
    return items.agg(
        F.count(F.lit(1)).alias("n_public"), F.count_if(s == "succeeded").alias("n_succeeded"), F.count_if(s == "failed").alias("n_failed"), F.count_if(s == "permanent_failure").alias("n_permanent"),
        F.count_if(s.isNull()).alias("n_never"), F.count_if(F.col("chars") >= 200).alias("n_long"), F.count_if(F.col("chars") == 0).alias("n_empty"), F.count_if((s == "failed") & (F.col("next_attempt_at") <= r.as_of)).alias("n_due"),
    )


def source_health(r: Relations) -> DataFrame:
    """Each source with its runs: last success, failures and empty runs since the last good one."""
    runs = r.crawl_runs.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_runs"), F.max(F.when(F.col("succeeded"), F.col("run_id"))).alias("last_success"), F.max(F.when(F.col("succeeded") & (F.col("items_found") > 0), F.col("run_id"))).alias("last_found"), F.max("run_id").alias("last_run"),
    )
    r2 = r.crawl_runs.select("source_id", "run_id", "succeeded", "items_found").join(runs.select("source_id", "last_success", "last_found"), "source_id")
    since = r2.groupBy("source_id").agg(
        F.count_if(~F.col("succeeded") & (F.col("run_id") > F.coalesce("last_success", F.lit(-1)))).alias("failures"),
        F.count_if(F.col("succeeded") & (F.col("run_id") > F.coalesce("last_found", F.lit(-1)))).alias("zero_runs"),
    )
    return r.sources.select("source_id", "kind", "status", "company_id").join(runs, "source_id", "left").join(since, "source_id", "left")


_HEALTH = """health as (select s.source_id, s.kind, s.status, s.company_id, x.n_runs, x.last_success, x.last_run,
    (select count(*) from crawl_runs c where c.source_id = s.source_id and not c.succeeded and c.run_id > coalesce(x.last_success, -1)) as failures,
    (select count(*) from crawl_runs c where c.source_id = s.source_id and c.succeeded and c.run_id > coalesce(x.last_found, -1)) as zero_runs
    from sources s left join (select source_id, count(*) as n_runs, max(run_id) filter (where succeeded) as last_success, max(run_id) filter (where succeeded and items_found > 0) as last_found, max(run_id) as last_run from crawl_runs group by 1) x on x.source_id = s.source_id)"""


@query("source_health", f"with {_HEALTH} select source_id, kind, status, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(failures as bigint) as failures, cast(zero_runs as bigint) as zero_runs, last_run from health")
def _q_health(r: Relations) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return source_health(r).select("source_id", "kind", "status", zero("n_runs"), zero("failures"), zero("zero_runs"), "last_run")


def companies_with(r: Relations) -> DataFrame:
    """(company_id, how): the companies that a healthy feed or a fresh active recipe covers, each way once."""
    h = source_health(r).filter("status = 'approved' and kind in ('rss', 'atom') and coalesce(failures, 0) = 0 and coalesce(zero_runs, 0) < 3")
    fresh = healthy_recipes(r).join(r.recipe_state.filter("freshness_status = 'fresh'").select("recipe_id"), "recipe_id", "left_semi")
    return h.select("company_id", F.lit("feed").alias("how")).union(fresh.select("company_id", F.lit("recipe").alias("how"))).distinct()


_WITH = f"""{_HEALTH}, healthy as (select company_id, 'feed' as how from health where status = 'approved' and kind in ('rss', 'atom') and failures = 0 and zero_runs < 3
    union select r.company_id, 'recipe' from recipes r join recipe_state st on st.recipe_id = r.recipe_id where r.status = 'active' and not st.rebuild_required and st.freshness_status = 'fresh')"""


@query("covered_companies", f"with {_WITH} select company_id, cast(count(*) as bigint) as n_ways, min(how) as first_way from healthy group by company_id")
def _q_covered_companies(r: Relations) -> DataFrame:
    return companies_with(r).groupBy("company_id").agg(F.count(F.lit(1)).alias("n_ways"), F.min("how").alias("first_way"))


@query("companies_needing_recipes", f"with {_WITH} select company_id, company_key, name from companies c where lifecycle_status = 'active' and not exists (select 1 from healthy h where h.company_id = c.company_id)")
def _q_needing(r: Relations) -> DataFrame:
    return r.companies.filter("lifecycle_status = 'active'").join(companies_with(r).select("company_id").distinct(), "company_id", "left_anti").select("company_id", "company_key", "name")


@query(
    "recipe_scorecard",
    f"""with {_WITH} select (select count(*) from companies) as n_companies, (select count(distinct company_id) from healthy) as n_covered, (select count(distinct company_id) from healthy where how = 'feed') as n_by_feed,
    (select count(distinct company_id) from healthy where how = 'recipe') as n_by_recipe, (select count(*) from recipes where status = 'active') as n_active, (select count(*) from recipes where status <> 'active') as n_superseded,
    (select count(*) from recipe_state where rebuild_required) as n_rebuild, (select count(*) from recipe_state where freshness_status = 'stale') as n_stale, (select count(*) from recipe_state where correctness_status = 'failing') as n_failing,
    (select count(distinct company_id) from sources) as n_with_source, (select count(*) from sources where status = 'approved') as n_approved""",
)
def _q_scorecard(r: Relations) -> DataFrame:
    """One aggregate over each relation, put side by side; every part is a single row."""
    ways = companies_with(r).groupBy("company_id").agg(F.max(F.col("how") == "feed").alias("feed"), F.max(F.col("how") == "recipe").alias("recipe"))
    parts = [
        r.companies.agg(F.count(F.lit(1)).alias("n_companies")),
        ways.agg(F.count(F.lit(1)).alias("n_covered"), F.count_if("feed").alias("n_by_feed"), F.count_if("recipe").alias("n_by_recipe")),
        r.recipes.agg(F.count_if(F.col("status") == "active").alias("n_active"), F.count_if(F.col("status") != "active").alias("n_superseded")),
        r.recipe_state.agg(F.count_if("rebuild_required").alias("n_rebuild"), F.count_if(F.col("freshness_status") == "stale").alias("n_stale"), F.count_if(F.col("correctness_status") == "failing").alias("n_failing")),
        r.sources.agg(F.countDistinct("company_id").alias("n_with_source"), F.count_if(F.col("status") == "approved").alias("n_approved")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def latest_runs(r: Relations) -> DataFrame:
    """The last validation run of each candidate, by an aggregate that keeps one row a key before the shuffle."""
    last = r.validation_runs.groupBy("candidate_id").agg(F.max_by(F.struct("status", "k", "run_id", "started_at"), F.struct("started_at", "event_id")).alias("x"))
    return last.select("candidate_id", "x.*")


_LAST = "last as (select * from (select *, row_number() over (partition by candidate_id order by started_at desc, event_id desc) as rn from validation_runs) where rn = 1)"


@query("latest_validation", f"with {_LAST} select candidate_id, run_id, status from last")
def _q_latest(r: Relations) -> DataFrame:
    return latest_runs(r).select("candidate_id", "run_id", "status")


@query(
    "review_candidates",
    f"""with {_LAST} select c.candidate_id, c.company_id, c.confidence, l.status as run_status from candidates c left join last l on l.candidate_id = c.candidate_id where c.status = 'pending'
    order by case l.status when 'needs_review' then 0 when 'invalid' then 1 when 'trusted' then 2 else 3 end, c.confidence desc, c.candidate_id limit {PAGE}""",
)
def _q_review(r: Relations) -> DataFrame:
    rank = F.when(F.col("run_status") == "needs_review", 0).when(F.col("run_status") == "invalid", 1).when(F.col("run_status") == "trusted", 2).otherwise(3)
    rows = r.candidates.filter("status = 'pending'").join(latest_runs(r).select("candidate_id", F.col("status").alias("run_status")), "candidate_id", "left")
    return rows.orderBy(rank, F.desc("confidence"), "candidate_id").limit(PAGE).select("candidate_id", "company_id", "confidence", "run_status")


@query(
    "review_dashboard",
    f"""with {_LAST}, {_HEALTH} select (select count(*) from candidates where status = 'pending') as n_pending, (select count(*) from candidates where status = 'accepted') as n_accepted, (select count(*) from candidates where status = 'rejected') as n_rejected,
    (select count(*) from last where status = 'needs_review') as n_needs_review, (select count(*) from last where status = 'invalid') as n_invalid, (select count(*) from last where status in ('strict', 'trusted')) as n_valid, (select count(*) from validation_runs) as n_runs,
    (select count(*) from health where status = 'approved' and failures = 0) as n_healthy, (select count(*) from health where failures > 0) as n_failing, (select count(*) from companies c where not exists (select 1 from sources s where s.company_id = c.company_id)) as n_without_source""",
)
def _q_dashboard(r: Relations) -> DataFrame:
    """One aggregate over each relation, put side by side; every part is a single row."""
    c, l, f = F.col("status"), latest_runs(r), F.coalesce("failures", F.lit(0))
    parts = [
        r.candidates.agg(F.count_if(c == "pending").alias("n_pending"), F.count_if(c == "accepted").alias("n_accepted"), F.count_if(c == "rejected").alias("n_rejected")),
        l.agg(F.count_if(c == "needs_review").alias("n_needs_review"), F.count_if(c == "invalid").alias("n_invalid"), F.count_if(c.isin("strict", "trusted")).alias("n_valid")),
        r.validation_runs.agg(F.count(F.lit(1)).alias("n_runs")),
        source_health(r).agg(F.count_if((c == "approved") & (f == 0)).alias("n_healthy"), F.count_if(f > 0).alias("n_failing")),
        r.companies.join(r.sources.select("company_id").distinct(), "company_id", "left_anti").agg(F.count(F.lit(1)).alias("n_without_source")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


@query("best_candidates", "select company_id, candidate_id, confidence from (select *, row_number() over (partition by company_id order by confidence desc, created_at, candidate_id) as rn from candidates where status <> 'rejected') where rn = 1")
def _q_best(r: Relations) -> DataFrame:
    return _first(r.candidates.filter("status <> 'rejected'"), [F.col("company_id")], [F.desc("confidence"), F.col("created_at"), F.col("candidate_id")]).select("company_id", "candidate_id", "confidence")


@query("wave_companies", f"select company_id, company_key, market_cap, cast(row_number() over (order by market_cap desc nulls last, company_id) - 1 as bigint) * 30 as delay_seconds from companies where lifecycle_status = 'active' order by market_cap desc nulls last, company_id limit 1000")
def _q_wave(r: Relations) -> DataFrame:
    """The thousand largest active companies and when each starts: the limit is the wave."""
    top = r.companies.filter("lifecycle_status = 'active'").orderBy(F.col("market_cap").desc_nulls_last(), "company_id").limit(1000)
    place = F.row_number().over(Window.orderBy(F.col("market_cap").desc_nulls_last(), "company_id")) - 1
    return top.select("company_id", "company_key", "market_cap", (place.cast("bigint") * 30).alias("delay_seconds"))


@query("sector_countries", "select sector, country, cast(count(*) as bigint) as n_companies, cast(sum(market_cap) as bigint) as market_cap from companies group by sector, country")
def _q_sectors(r: Relations) -> DataFrame:
    return r.companies.groupBy("sector", "country").agg(F.count(F.lit(1)).alias("n_companies"), F.sum("market_cap").alias("market_cap"))


@query("recipe_status_matrix", "select freshness_status, correctness_status, cast(count(*) as bigint) as n from recipe_state group by all")
def _q_matrix(r: Relations) -> DataFrame:
    return r.recipe_state.groupBy("freshness_status", "correctness_status").agg(F.count(F.lit(1)).alias("n"))


@query("next_recipe_version", "select recipe_key, cast(coalesce(max(version), 0) + 1 as int) as next_version from recipes group by recipe_key")
def _q_version(r: Relations) -> DataFrame:
    return r.recipes.groupBy("recipe_key").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


@query("dominant_namespace", r"with c as (select company_id, split_part(regexp_replace(url, '^https?://', ''), '/', 2) as ns, count(*) as n from feed_items group by all), t as (select *, row_number() over (partition by company_id order by n desc, ns) as rn, sum(n) over (partition by company_id) as total from c) select company_id, ns, cast(n as bigint) as n_items from t where rn = 1 and n >= 5 and 2 * n > total")
def _q_namespace(r: Relations) -> DataFrame:
    """A company's most frequent first path segment where at least five items and more than half have it; ties to the smaller."""
    counted = r.feed_items.select("company_id", F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(2)).alias("ns")).groupBy("company_id", "ns").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("company_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "ns")).alias("b"), F.sum("n").alias("total"))
    return best.select("company_id", "b.ns", (-F.col("b.m")).alias("n_items"), "total").filter("n_items >= 5 and 2 * n_items > total").drop("total")


@query("rebuild_candidates", "select company_id, recipe_id from (select r.company_id, r.recipe_id, row_number() over (partition by r.company_id order by st.rebuild_required desc, case st.correctness_status when 'failing' then 0 else 1 end, case st.freshness_status when 'stale' then 0 else 1 end, r.recipe_id) as rn from recipes r join recipe_state st on st.recipe_id = r.recipe_id where r.status = 'active' and (st.rebuild_required or st.correctness_status = 'failing' or st.freshness_status = 'stale')) where rn = 1")
def _q_rebuild(r: Relations) -> DataFrame:
    bad = r.recipes.filter("status = 'active'").join(r.recipe_state, "recipe_id").filter("rebuild_required or correctness_status = 'failing' or freshness_status = 'stale'")
    order = [F.desc("rebuild_required"), F.when(F.col("correctness_status") == "failing", 0).otherwise(1), F.when(F.col("freshness_status") == "stale", 0).otherwise(1), F.col("recipe_id")]
    return _first(bad, [F.col("company_id")], order).select("company_id", "recipe_id")


@query("retryable_runs", "select run_id, k from validation_runs where status = 'invalid' and k >= 50")
def _q_retry(r: Relations) -> DataFrame:
    """Failed runs whose metadata says that they may be retried, read through a variant."""
    k = F.try_variant_get(F.parse_json(F.to_json(F.struct("k"))), "$.k", "int")
    return r.validation_runs.withColumn("kk", k).filter((F.col("status") == "invalid") & (F.col("kk") >= 50)).select("run_id", F.col("kk").alias("k"))


@query("crawl_runs_page", f"select run_id, source_id, succeeded, items_found from crawl_runs order by started_at desc, run_id limit {MOST_PAGE}")
def _q_runs(r: Relations) -> DataFrame:
    return r.crawl_runs.orderBy(F.desc("started_at"), "run_id").limit(MOST_PAGE).select("run_id", "source_id", "succeeded", "items_found")


@query("source_candidates_page", f"select candidate_id, kind, status, confidence from candidates where status = 'pending' order by confidence desc, candidate_id limit {PAGE}")
def _q_candidates(r: Relations) -> DataFrame:
    return r.candidates.filter("status = 'pending'").orderBy(F.desc("confidence"), "candidate_id").limit(PAGE).select("candidate_id", "kind", "status", "confidence")


def page_envelope(rows: DataFrame, order: list[Column], limit: int = PAGE, offset: int = 0) -> DataFrame:
    """One row (items, total, limit, offset): the page's rows as JSON texts in order. Bounds are clamped as in the API."""
    limit, offset = max(1, min(MOST_PAGE, limit)), max(0, offset)
    page = rows.orderBy(*order).offset(offset).limit(limit).select(F.to_json(F.struct("*")).alias("j"))
    items = page.agg(F.collect_list("j").alias("items"))
    return items.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))).select("items", "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"))


# The scorecard and the dashboard in full. Their inputs are derived from the given tables, the same for both engines.
_BOARD = {
    "eligible": "select company_id from companies where lifecycle_status = 'active' and company_id % 13 <> 6",
    "source_states": "select source_id, company_id, kind, status, n % 5 <> 4 as succeeded_once, case when n % 7 = 3 then 2 else 0 end as failures, case when n % 11 = 2 then 3 else 0 end as zero_runs, n % 9 <> 7 as attempted from sources",
    "recipe_rows": "select recipe_id, source_id, company_id, case when status = 'superseded' and company_id % 2 = 0 then 'stale' else status end as status from recipes",
    "recipe_states": "select recipe_id, rebuild_required, case when freshness_status = 'stale' then 'content_stale' else 'fresh' end as freshness, case when correctness_status = 'healthy' then 'passing' else 'failing' end as correctness from recipe_state",
    "build_jobs": "select event_id, user_id as company_id, ts as created_at, case when user_id % 4 = 0 then 'validate_candidate' else 'extract_company_news' end as job_type, case event_type when 'view' then 'pending' when 'click' then 'running' when 'purchase' then 'completed' else 'failed' end as status, event_id % 3 as attempts from events",
    "build_runs": "select user_id as company_id, case when event_type = 'purchase' then 'completed' else 'failed' end as status from events where event_type in ('purchase', 'error') and user_id % 3 <> 1",
    "board_candidates": "select candidate_id, company_id, kind, case status when 'pending' then 'new' else status end as status from candidates",
    "board_runs": "select run_id, candidate_id, started_at, event_id, case status when 'strict' then 'valid' when 'trusted' then 'failed' else status end as status from validation_runs where candidate_id not like '%7-%'",
}
_BOARD_SQL = ", ".join(f"{k} as ({v})" for k, v in _BOARD.items())


def _side_by_side(parts: list[DataFrame]) -> DataFrame:
    """Single rows as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def coverage_scorecard(t: dict[str, DataFrame], items: DataFrame) -> DataFrame:
    """All 26 coverage metrics as one row.

    Every fact about a company is a flag of its row, so each relation is summed once to companies and all company
    metrics are one aggregate; items and jobs are one aggregate each.
    """
    feeds = t["source_states"].filter(F.col("kind").isin("rss", "atom") & (F.col("status") == "approved"))
    healthy = F.col("succeeded_once") & (F.col("failures") == 0) & (F.col("zero_runs") < 3)
    by_feed = feeds.groupBy("company_id").agg(F.lit(True).alias("feed"), F.max(healthy).alias("healthy_feed"))
    active = t["recipe_rows"].filter("status = 'active'").join(t["recipe_states"], "recipe_id", "left").withColumn("rebuild", F.coalesce("rebuild_required", F.lit(False)))
    good = ~F.col("rebuild")
    current = good & (F.coalesce("freshness", F.lit("unknown")) != "content_stale")
    by_recipe = active.groupBy("company_id").agg(
        F.max(current).alias("recipe"), F.max(good & (F.col("freshness") == "fresh") & (F.col("correctness") == "passing")).alias("right"), F.max(good & (F.col("freshness") == "content_stale")).alias("content_stale"), F.count_if(current).alias("n_current"),
    )
    stale = t["recipe_rows"].filter("status = 'stale'").select("company_id").distinct().withColumn("stale", F.lit(True))
    built = t["build_runs"].filter("status = 'completed'").select("company_id").distinct().withColumn("built", F.lit(True))
    builds = t["build_jobs"].filter("job_type = 'extract_company_news'")
    last = builds.groupBy("company_id").agg((F.max_by("status", F.struct("created_at", "event_id")) == "failed").alias("last_failed"))
    c = t["eligible"]
    for part in (by_feed, by_recipe, stale, built, last):
        c = c.join(part, "company_id", "left")
    has = lambda name: F.coalesce(F.col(name), F.lit(False))
    covered, n = has("healthy_feed") | has("recipe"), F.count_if
    companies = c.agg(
        F.count(F.lit(1)).alias("eligible_companies"), n(has("feed")).alias("companies_with_approved_feed"), n(has("healthy_feed")).alias("companies_with_healthy_feed"), n(has("recipe")).alias("companies_with_active_recipe"),
        n(has("feed") & has("recipe")).alias("companies_with_approved_feed_and_active_recipe"), n(covered).alias("companies_covered_by_feed_or_recipe"), n(~covered).alias("companies_missing_feed_or_recipe"),
        n(has("built")).alias("companies_with_completed_build"), n(~has("built")).alias("companies_without_completed_build"), n(~covered & has("built")).alias("companies_uncovered_after_completed_build"),
        n(~covered & ~has("built")).alias("companies_uncovered_awaiting_completed_build"), n(has("right")).alias("companies_fresh_and_correct"), n(has("content_stale")).alias("companies_content_stale"),
        n(has("stale")).alias("companies_with_stale_recipe"), n(~has("recipe")).alias("companies_missing_recipe"), F.coalesce(F.sum("n_current"), F.lit(0)).alias("active_recipes"), n(has("last_failed")).alias("terminal_failed_build_jobs"),
    )
    approved = t["source_states"].select("source_id", "status")
    recipe_sources = active.filter(good).join(t["eligible"], "company_id", "left_semi").select("source_id").distinct()
    of_recipes = items.join(recipe_sources, "source_id", "left_semi").join(approved, "source_id", "left")
    counts = of_recipes.agg(n(~F.col("is_private") & (F.col("status") == "approved")).alias("public_recipe_items"), n(F.col("is_private") & F.col("reversible")).alias("quality_quarantined_recipe_items"))
    s = F.col("status")
    jobs = builds.agg(n(s == "pending").alias("pending_build_jobs"), n(s == "running").alias("running_build_jobs"), n((s == "pending") & (F.col("attempts") > 0)).alias("retrying_build_jobs"), n(s == "completed").alias("completed_build_jobs"))
    return _side_by_side([companies, counts, jobs, t["build_runs"].agg(n(s == "completed").alias("completed_build_runs"), n(s == "failed").alias("failed_build_runs"))])


_BOARD_ITEMS = "select id, source_id, is_private, doc_id % 2 = 0 as reversible from feed_items"


@query(
    "coverage_scorecard",
    f"""with {_BOARD_SQL}, items as ({_BOARD_ITEMS}), approved_feed as (select distinct x.company_id from source_states x join eligible using (company_id) where x.status = 'approved' and x.kind in ('rss', 'atom')),
    healthy_feed as (select distinct x.company_id from source_states x join eligible using (company_id) where x.status = 'approved' and x.kind in ('rss', 'atom') and succeeded_once and failures = 0 and zero_runs < 3),
    active as (select r.company_id, r.recipe_id, r.source_id, s.freshness, s.correctness, coalesce(s.rebuild_required, false) as rebuild from recipe_rows r join eligible using (company_id) left join recipe_states s on s.recipe_id = r.recipe_id where r.status = 'active'),
    current_ as (select * from active where not rebuild and coalesce(freshness, 'unknown') <> 'content_stale'), active_company as (select distinct company_id from current_), covered as (select company_id from healthy_feed union select company_id from active_company),
    built as (select distinct b.company_id from build_runs b join eligible using (company_id) where b.status = 'completed'), uncovered as (select company_id from eligible except select company_id from covered),
    last as (select j.company_id, j.status from build_jobs j join eligible using (company_id) where job_type = 'extract_company_news' qualify row_number() over (partition by j.company_id order by created_at desc, event_id desc) = 1),
    rsource as (select distinct source_id from active where not rebuild), jobs_ as (select * from build_jobs where job_type = 'extract_company_news')
    select (select count(*) from eligible) as eligible_companies, (select count(*) from approved_feed) as companies_with_approved_feed, (select count(*) from healthy_feed) as companies_with_healthy_feed, (select count(*) from active_company) as companies_with_active_recipe,
    (select count(*) from approved_feed join active_company using (company_id)) as companies_with_approved_feed_and_active_recipe, (select count(*) from covered) as companies_covered_by_feed_or_recipe, (select count(*) from uncovered) as companies_missing_feed_or_recipe,
    (select count(*) from built) as companies_with_completed_build, (select count(*) from eligible) - (select count(*) from built) as companies_without_completed_build, (select count(*) from uncovered join built using (company_id)) as companies_uncovered_after_completed_build,
    (select count(*) from (select company_id from uncovered except select company_id from built)) as companies_uncovered_awaiting_completed_build,
    (select count(distinct company_id) from active where not rebuild and freshness = 'fresh' and correctness = 'passing') as companies_fresh_and_correct, (select count(distinct company_id) from active where not rebuild and freshness = 'content_stale') as companies_content_stale,
    (select count(distinct r.company_id) from recipe_rows r join eligible using (company_id) where r.status = 'stale') as companies_with_stale_recipe, (select count(*) from eligible) - (select count(*) from active_company) as companies_missing_recipe, (select count(*) from current_) as active_recipes,
    (select count(*) from items join rsource using (source_id) join source_states s using (source_id) where not is_private and s.status = 'approved') as public_recipe_items, (select count(*) from items join rsource using (source_id) where is_private and reversible) as quality_quarantined_recipe_items,
    (select count(*) from jobs_ where status = 'pending') as pending_build_jobs, (select count(*) from jobs_ where status = 'running') as running_build_jobs, (select count(*) from jobs_ where status = 'pending' and attempts > 0) as retrying_build_jobs, (select count(*) from jobs_ where status = 'completed') as completed_build_jobs,
    (select count(*) from last where status = 'failed') as terminal_failed_build_jobs, (select count(*) from build_runs where status = 'completed') as completed_build_runs, (select count(*) from build_runs where status = 'failed') as failed_build_runs""",
)
def _q_coverage(r: Relations) -> DataFrame:
    return coverage_scorecard({k: r.sql(v) for k, v in _BOARD.items()}, r.sql(_BOARD_ITEMS))


def candidate_dashboard(t: dict[str, DataFrame], companies: DataFrame, items: DataFrame) -> DataFrame:
    """All 18 review metrics as one row: each relation is one aggregate, the last run of a candidate a max_by."""
    n, s, feed = F.count_if, F.col("status"), F.col("kind").isin("rss", "atom")
    last = t["board_runs"].groupBy("candidate_id").agg(F.max_by("status", F.struct("started_at", "event_id")).alias("run"))
    c = t["board_candidates"].join(last, "candidate_id", "left")
    open_, live, new = s.isin("new", "accepted"), s != "rejected", s == "new"
    of_candidates = c.agg(
        F.countDistinct(F.when(open_, F.col("company_id"))).alias("companies_with_candidates"), F.countDistinct(F.when(open_ & feed, F.col("company_id"))).alias("companies_with_feed_candidates"), n(new & feed).alias("new_feed_candidates"),
        n(new & feed & F.col("run").isNull()).alias("unvalidated_feed_candidates"), *(n(live & (F.col("run") == run)).alias(name) for run, name in (("valid", "valid_candidates"), ("needs_review", "needs_review_candidates"), ("invalid", "invalid_candidates"), ("failed", "failed_validations"))),
    )
    up = (s == "approved") & F.col("succeeded_once") & (F.col("failures") == 0)
    of_sources = t["source_states"].agg(
        F.countDistinct(F.when(s == "approved", F.col("company_id"))).alias("companies_with_activated_sources"), F.countDistinct(F.when(up, F.col("company_id"))).alias("companies_with_healthy_sources"), n(s == "approved").alias("activated_sources"),
        n(up).alias("healthy_sources"), n((s == "approved") & (F.col("failures") > 0)).alias("failing_sources"), n((s == "approved") & ~F.col("attempted")).alias("sources_awaiting_first_crawl"),
    )
    of_jobs = t["build_jobs"].filter("job_type = 'validate_candidate'").agg(n(s == "pending").alias("validation_pending"), n(s == "running").alias("validation_running"))
    public = items.filter("not is_private").join(t["source_states"].filter(s == "approved").select("source_id"), "source_id", "left_semi")
    return _side_by_side([companies.agg(F.count(F.lit(1)).alias("total_companies")), of_candidates, of_sources, of_jobs, public.agg(F.count(F.lit(1)).alias("normalized_items"))])


@query(
    "candidate_dashboard",
    f"""with {_BOARD_SQL}, items as ({_BOARD_ITEMS}), last as (select * from board_runs qualify row_number() over (partition by candidate_id order by started_at desc, event_id desc) = 1), v as (select l.status, count(*) as n from last l join board_candidates c using (candidate_id) where c.status <> 'rejected' group by 1)
    select (select count(*) from companies) as total_companies, (select count(distinct company_id) from board_candidates where status in ('new', 'accepted')) as companies_with_candidates, (select count(distinct company_id) from board_candidates where status in ('new', 'accepted') and kind in ('rss', 'atom')) as companies_with_feed_candidates,
    (select count(distinct company_id) from source_states where status = 'approved') as companies_with_activated_sources, (select count(distinct company_id) from source_states where status = 'approved' and succeeded_once and failures = 0) as companies_with_healthy_sources,
    (select count(*) from board_candidates where status = 'new' and kind in ('rss', 'atom')) as new_feed_candidates, (select count(*) from board_candidates c where status = 'new' and kind in ('rss', 'atom') and not exists (select 1 from board_runs b where b.candidate_id = c.candidate_id)) as unvalidated_feed_candidates,
    (select count(*) from build_jobs where job_type = 'validate_candidate' and status = 'pending') as validation_pending, (select count(*) from build_jobs where job_type = 'validate_candidate' and status = 'running') as validation_running,
    coalesce((select n from v where status = 'valid'), 0) as valid_candidates, coalesce((select n from v where status = 'needs_review'), 0) as needs_review_candidates, coalesce((select n from v where status = 'invalid'), 0) as invalid_candidates, coalesce((select n from v where status = 'failed'), 0) as failed_validations,
    (select count(*) from source_states where status = 'approved') as activated_sources, (select count(*) from source_states where status = 'approved' and succeeded_once and failures = 0) as healthy_sources, (select count(*) from source_states where status = 'approved' and failures > 0) as failing_sources,
    (select count(*) from source_states where status = 'approved' and not attempted) as sources_awaiting_first_crawl, (select count(*) from items i join source_states s using (source_id) where not is_private and s.status = 'approved') as normalized_items""",
)
def _q_board(r: Relations) -> DataFrame:
    return candidate_dashboard({k: r.sql(v) for k, v in _BOARD.items()}, r.companies, r.sql(_BOARD_ITEMS))
