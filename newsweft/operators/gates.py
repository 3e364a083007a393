"""Batch quality gates over a source's items, validation policy and recipe reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import text as T
from newsweft.plans.catalog import query
from newsweft.plans.dialect import AS_OF, DUCK
from newsweft.plans.relations import Relations

# What the gates need to judge, and where they draw the line.
LEAST_TITLES, LEAST_DISTINCT, LEAST_CONTENT, SAMPLE = 5, 2, 5, 20
TOPIC_NUMERATOR, TOPIC_DENOMINATOR = 4, 5
FEED_OVERLAP_BPS, RECIPE_OVERLAP_BPS, LEAST_OVERLAP, SCOPE_BPS = 5000, 8000, 3, 5000
LEAST_RATIO_BPS, LEAST_SKEW_HOURS = 2500, 24

_ASOF = DUCK.ts(AS_OF)


def repeated_content(items: DataFrame) -> DataFrame:
    """Items whose text another item of the source has under another title: all of them are rejected."""
    keyed = items.select("id", "source_id", F.xxhash64("body_text").alias("h"), F.sha2("body_text", 256).alias("body"), "title")
    by = keyed.groupBy("source_id", "body").agg(F.count(F.lit(1)).alias("n"), (F.min("title") != F.max("title")).alias("several")).filter("n > 1 and several")
    return keyed.join(by.select("source_id", "body"), ["source_id", "body"], "left_semi").select("id", "source_id")


# Every ninth item again under another title, every seventh under its own.
_REPEATED = "select id, source_id, body_text, title from feed_items union all select id || '-x', source_id, body_text, title || ' again' from feed_items where doc_id % 9 = 0 union all select id || '-y', source_id, body_text, title from feed_items where doc_id % 7 = 0"


@query("repeated_content", f"select id, source_id from (select id, source_id, count(*) over w as n, min(title) over w as a, max(title) over w as b from ({_REPEATED}) window w as (partition by source_id, body_text)) where n > 1 and a <> b")
def _q_repeated(r: Relations) -> DataFrame:
    return repeated_content(r.sql(_REPEATED))


def title_diversity(items: DataFrame) -> DataFrame:
    """Per source: usable and distinct titles; passes with fewer than five usable ones or at least two distinct."""
    usable = items.select("source_id", T.title_key(F.col("title")).alias("t")).filter(F.length("t") >= 4)
    out = usable.groupBy("source_id", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("source_id").agg(F.sum("n").alias("n_usable"), F.count(F.lit(1)).alias("n_distinct"))
    return out.withColumn("passes", (F.col("n_usable") < LEAST_TITLES) | (F.col("n_distinct") >= LEAST_DISTINCT))


@query("title_diversity", f"select source_id, cast(count(*) as bigint) as n_usable, cast(count(distinct t) as bigint) as n_distinct, count(*) < 5 or count(distinct t) >= 2 as passes from (select source_id, {DUCK.title_key('title')} as t from feed_items) where length(t) >= 4 group by source_id")
def _q_titles(r: Relations) -> DataFrame:
    return title_diversity(r.feed_items)


def content_diversity(items: DataFrame) -> DataFrame:
    """Per source: passes with fewer than five items or when less than half of them repeat another's text."""
    by = items.groupBy("source_id", F.sha2("body_text", 256).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    out = by.groupBy("source_id").agg(F.sum("n").alias("n_items"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_repeated"))
    return out.withColumn("passes", (F.col("n_items") < LEAST_CONTENT) | (F.col("n_repeated") * 2 < F.col("n_items")))


@query("content_diversity", "select source_id, cast(sum(n) as bigint) as n_items, cast(sum(case when n > 1 then n else 0 end) as bigint) as n_repeated, sum(n) < 5 or 2 * sum(case when n > 1 then n else 0 end) < sum(n) as passes from (select source_id, body_text, count(*) as n from feed_items group by all) group by source_id")
def _q_content(r: Relations) -> DataFrame:
    return content_diversity(r.feed_items)


def first_of(items: DataFrame, n: int = SAMPLE) -> DataFrame:
    """The first ``n`` items of each source in feed order: the sample that a gate judges by."""
    return items.withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy("doc_id"))).filter(F.col("rn") <= n).drop("rn")


# Word patterns of off-topic and of routine items, over whole texts.
SUSPICIOUS = r"(?i)(casino|betting|slot machine|payday loan|viagra)"
ROUTINE = r"(?i)(dividend|webcast|transcript|presentation|calendar)"
# Some sources' texts are made off-topic, some routine, and some name the company, so that every verdict occurs.
_MARKED = """select id, doc_id, source_id, company_id, body_text || case when cast(substr(source_id, 4) as int) % 3 = 0 then ' online casino' else '' end || case when cast(substr(source_id, 4) as int) % 4 = 0 and doc_id % 10 <> 1 then ' webcast' else '' end
    || case when cast(substr(source_id, 4) as int) % 6 = 0 then ' ' || source_id else '' end as body_text, case when cast(substr(source_id, 4) as int) % 5 < 2 and doc_id % 4 <> 0 then 'Holding ' || cast(company_id as string) || ' opens a plant' else title end as title from feed_items"""


def _flag(pattern: str) -> Column:
    return F.col("body_text").rlike(pattern)


@query(
    "topic_compromise",
    f"""with s as (select *, row_number() over (partition by source_id order by doc_id) as rn from ({_MARKED})), g as (select source_id, count(*) as n, count(*) filter (where regexp_matches(body_text, '{SUSPICIOUS}')) as bad,
    count(*) filter (where contains(lower(body_text), source_id)) as named from s where rn <= 20 group by 1)
    select source_id, cast(n as bigint) as n, cast(bad as bigint) as n_suspicious, n >= 5 and bad * 5 >= 4 * n and 2 * named < n as compromised from g""",
)
def _q_topic(r: Relations) -> DataFrame:
    g = first_of(r.sql(_MARKED)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(_flag(SUSPICIOUS)).alias("n_suspicious"), F.count_if(F.contains(F.lower("body_text"), F.col("source_id"))).alias("named"))
    bad = (F.col("n") >= 5) & (F.col("n_suspicious") * TOPIC_DENOMINATOR >= TOPIC_NUMERATOR * F.col("n")) & (F.col("named") * 2 < F.col("n"))
    return g.withColumn("compromised", bad).drop("named")


@query(
    "scope_relevance",
    f"""with k as (select *, 'holding ' || cast(company_id as varchar) as term, lower(title) || ' ' || lower(body_text) as whole from ({_MARKED})), g as (select source_id, count(*) as n, count(*) filter (where contains(whole, term)) as hits from k group by 1)
    select source_id, cast(n as bigint) as n_items, cast(hits * 10000 // n as bigint) as relevance_bps, hits * 10000 // n >= 5000 as relevant from g""",
)
def _q_scope(r: Relations) -> DataFrame:
    """The share of a source's items that name its company: the company's term is a column of the item's row, so nothing is joined."""
    terms = r.sql(_MARKED).withColumn("term", F.concat(F.lit("holding "), F.col("company_id").cast("string")))
    hit = F.contains(F.lower("title"), F.col("term")) | F.contains(F.lower("body_text"), F.col("term"))
    g = terms.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(hit).alias("hits"))
    bps = T.ratio_bps(F.col("hits"), F.col("n_items"))
    return g.select("source_id", "n_items", bps.alias("relevance_bps"), (bps >= SCOPE_BPS).alias("relevant"))


@query(
    "routine_dominance",
    f"""with s as (select *, row_number() over (partition by source_id order by doc_id) as rn from ({_MARKED})) select source_id, cast(count(*) as bigint) as n, cast(count(*) filter (where regexp_matches(body_text, '{ROUTINE}')) as bigint) as n_routine,
    count(*) >= 5 and 100 * count(*) filter (where regexp_matches(body_text, '{ROUTINE}')) >= 80 * count(*) as dominated from s where rn <= 20 group by 1""",
)
def _q_routine(r: Relations) -> DataFrame:
    g = first_of(r.sql(_MARKED)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(_flag(ROUTINE)).alias("n_routine"))
    return g.withColumn("dominated", (F.col("n") >= 5) & (F.col("n_routine") * 100 >= F.col("n") * 80))


@query("first_canonical", f"select id from (select id, row_number() over (partition by source_id, {DUCK.url_key('canonical_url')} order by doc_id) as rn from feed_items) where rn = 1")
def _q_first(r: Relations) -> DataFrame:
    """The first item of each canonical URL of a source, in candidate order; an aggregate, no sort."""
    from newsweft.functions.urls import identity_key

    best = r.feed_items.groupBy("source_id", identity_key(F.col("canonical_url")).alias("k")).agg(F.min_by("id", "doc_id").alias("id"))
    return best.select("id")


@query(
    "repaired_titles",
    """with c as (select *, count(*) over (partition by source_id, title) as n from feed_items) select id, case when n > 1 and length(summary) > 0 then summary else title end as title from c""",
)
def _q_repair(r: Relations) -> DataFrame:
    """Titles that several items of a source share give way to the item's own summary line."""
    many = r.feed_items.groupBy("source_id", "title").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    j = r.feed_items.select("id", "source_id", "title", "summary").join(many, ["source_id", "title"], "left")
    return j.select("id", F.when((F.col("n") > 1) & (F.length("summary") > 0), F.col("summary")).otherwise(F.col("title")).alias("title"))


@query(
    "recipe_report",
    f"""with g as (select source_id, count(*) as discovered, count(*) filter (where not is_private and length(body_text) >= 200) as accepted, count(distinct {DUCK.title_key('title')}) as titles, count(distinct body_text) as bodies,
    max(published_at) as newest from feed_items group by 1), b as (select *, least(accepted, discovered) * 10000 // discovered as bps from g)
    select source_id, cast(discovered as bigint) as discovered, cast(accepted as bigint) as accepted, cast(bps as bigint) as acceptance_bps,
    array_to_string(list_filter([case when discovered < 3 then 'too_few_discovered' end, case when accepted < 1 then 'too_few_accepted' end, case when bps < 2500 then 'low_acceptance' end,
    case when discovered >= 3 and 2 * titles < discovered then 'repeated_titles' end, case when discovered >= 3 and 2 * bodies < discovered then 'repeated_content' end,
    case when newest < {_ASOF} - interval 180 day then 'stale' end, case when newest > {_ASOF} + interval 24 hour then 'future' end], lambda x : x is not null), ',') as reasons from b""",
)
def _q_report(r: Relations) -> DataFrame:
    """Each source's correctness report with its ordered reasons."""
    g = r.feed_items.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("discovered"), F.count_if(~F.col("is_private") & (F.length("body_text") >= 200)).alias("accepted"), F.countDistinct(T.title_key(F.col("title"))).alias("titles"),
        F.countDistinct(F.xxhash64("body_text")).alias("bodies"), F.max("published_at").alias("newest"),
    )
    d, bps = F.col("discovered"), T.ratio_bps(F.col("accepted"), F.col("discovered"))
    reasons = F.array_compact(
        F.array(
            F.when(d < 3, "too_few_discovered"), F.when(F.col("accepted") < 1, "too_few_accepted"), F.when(bps < LEAST_RATIO_BPS, "low_acceptance"),
            F.when((d >= 3) & (F.col("titles") * 2 < d), "repeated_titles"), F.when((d >= 3) & (F.col("bodies") * 2 < d), "repeated_content"),
            F.when(F.col("newest") < r.as_of - F.expr("interval 180 days"), "stale"), F.when(F.col("newest") > r.as_of + F.expr("interval 24 hours"), "future"),
        )
    )
    return g.select("source_id", "discovered", "accepted", bps.alias("acceptance_bps"), F.array_join(reasons, ",").alias("reasons"))


@query("calibrated_thresholds", "select source_id, cast((n + 3) // 4 as bigint) as least_discovered, cast(greatest(1000, (ok * 10000 // n) // 2) as bigint) as least_bps from (select source_id, count(*) as n, count(*) filter (where not is_private) as ok from feed_items group by 1)")
def _q_calibrate(r: Relations) -> DataFrame:
    g = r.feed_items.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_private")).alias("ok"))
    half = F.floor(T.ratio_bps(F.col("ok"), F.col("n")) / 2).cast("bigint")
    return g.select("source_id", F.ceil(F.col("n") / 4).cast("bigint").alias("least_discovered"), F.greatest(F.lit(1000).cast("bigint"), half).alias("least_bps"))


@query(
    "overlap_verdicts",
    """with f as (select company_id, title from feed_items where source_kind in ('rss', 'atom')), g as (select s.source_id, count(*) as n, count(*) filter (where exists (select 1 from f where f.company_id = s.company_id and f.title = s.title)) as hit from feed_items s where s.source_kind not in ('rss', 'atom') group by 1)
    select source_id, cast(n as bigint) as n_items, cast(hit as bigint) as n_overlap, cast(hit * 10000 // n as bigint) as overlap_bps, case when hit >= 3 and hit = n then 'fully_covered' when hit >= 3 and hit * 10000 // n >= 8000 then 'active_recipe_overlap' when hit * 10000 // n >= 5000 then 'feed_overlap' else 'keep' end as verdict from g""",
)
def _q_overlap(r: Relations) -> DataFrame:
    have = r.feed_items.filter(F.col("source_kind").isin("rss", "atom")).select("company_id", "title").distinct().withColumn("hit", F.lit(True))
    g = r.feed_items.filter(~F.col("source_kind").isin("rss", "atom")).select("source_id", "company_id", "title").join(have, ["company_id", "title"], "left").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("hit").alias("n_overlap"))
    n, hit, bps = F.col("n_items"), F.col("n_overlap"), T.ratio_bps(F.col("n_overlap"), F.col("n_items"))
    verdict = F.when((hit >= LEAST_OVERLAP) & (hit == n), "fully_covered").when((hit >= LEAST_OVERLAP) & (bps >= RECIPE_OVERLAP_BPS), "active_recipe_overlap").when(bps >= FEED_OVERLAP_BPS, "feed_overlap").otherwise("keep")
    return g.select("source_id", "n_items", "n_overlap", bps.alias("overlap_bps"), verdict.alias("verdict"))


@query("failure_histogram", "select source_id, cast(count(*) filter (where not succeeded) as bigint) as n_failed, cast(count(*) filter (where not succeeded and k % 2 = 0) as bigint) as n_retryable, coalesce(array_to_string(list_sort(list(run_id) filter (where not succeeded))[1:3], ','), '') as samples from crawl_runs group by source_id")
def _q_failures(r: Relations) -> DataFrame:
    """Failures of each source, how many may be retried, and the first three."""
    failed = r.crawl_runs.filter("not succeeded")
    first = failed.withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy("run_id"))).filter("rn <= 3").groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("run_id")), lambda x: x.cast("string")), ",").alias("samples"))
    g = r.crawl_runs.groupBy("source_id").agg(F.count_if(~F.col("succeeded")).alias("n_failed"), F.count_if(~F.col("succeeded") & (F.col("k") % 2 == 0)).alias("n_retryable"))
    return g.join(first, "source_id", "left").select("source_id", "n_failed", "n_retryable", F.coalesce("samples", F.lit("")).alias("samples"))


@query("content_metrics", "select source_id, cast(min(length(body_text)) as bigint) as least_chars, cast(max(length(body_text)) as bigint) as most_chars, cast(sum(length(body_text)) // count(*) as bigint) as mean_chars from feed_items group by 1")
def _q_metrics(r: Relations) -> DataFrame:
    n = F.length("body_text").cast("bigint")
    return r.feed_items.groupBy("source_id").agg(F.min(n).alias("least_chars"), F.max(n).alias("most_chars"), F.expr("sum(cast(length(body_text) as bigint)) div count(*)").alias("mean_chars"))


@query(
    "validation_policy",
    """with c as (select candidate_id, kind, confidence, n_observations, status, url from candidates), f as (select *, confidence < 0.5 as low, n_observations < 10 as thin, status = 'rejected' as rejected, url like '%/error' as errors from c)
    select candidate_id, case when errors or rejected then 'invalid' when low and thin then 'needs_review' when kind = 'rss' and not low then 'strict' else 'trusted' end as verdict,
    concat_ws(',', case when errors then 'unreachable' end, case when rejected then 'rejected_before' end, case when low then 'low_confidence' end, case when thin then 'few_observations' end, case when kind <> 'rss' then 'not_a_feed' end) as reasons from f""",
)
def _q_policy(r: Relations) -> DataFrame:
    """Signals as booleans, a verdict by first match, and every reason in order."""
    low, thin, rejected, errors = F.col("confidence") < 0.5, F.col("n_observations") < 10, F.col("status") == "rejected", F.col("url").endswith("/error")
    verdict = F.when(errors | rejected, "invalid").when(low & thin, "needs_review").when((F.col("kind") == "rss") & ~low, "strict").otherwise("trusted")
    reasons = F.concat_ws(",", F.when(errors, "unreachable"), F.when(rejected, "rejected_before"), F.when(low, "low_confidence"), F.when(thin, "few_observations"), F.when(F.col("kind") != "rss", "not_a_feed"))
    return r.candidates.select("candidate_id", verdict.alias("verdict"), reasons.alias("reasons"))


@query("supersession_reasons", "select r.recipe_id, case when st.rebuild_required then 'rebuild_required' when st.correctness_status = 'failing' then 'incorrect' when st.freshness_status = 'stale' then 'stale' when s.status <> 'approved' then 'source_disabled' end as reason from recipes r join sources s on s.source_id = r.source_id left join recipe_state st on st.recipe_id = r.recipe_id")
def _q_supersede(r: Relations) -> DataFrame:
    j = r.recipes.select("recipe_id", "source_id").join(r.sources.select("source_id", "status"), "source_id").join(r.recipe_state, "recipe_id", "left")
    reason = F.when(F.col("rebuild_required"), "rebuild_required").when(F.col("correctness_status") == "failing", "incorrect").when(F.col("freshness_status") == "stale", "stale").when(F.col("status") != "approved", "source_disabled")
    return j.select("recipe_id", reason.alias("reason"))


@query("hosts_in_order", "select split_part(regexp_replace(url, '^https?://', ''), '/', 1) as host, cast(count(*) as bigint) as n_pages, min(page_id) as first_page from pages group by 1")
def _q_hosts(r: Relations) -> DataFrame:
    return r.pages.groupBy(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1)).alias("host")).agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))


# The reasons that fetches which failed for a while only may explain.
THRESHOLD_REASONS = ("accepted_items_below_minimum", "acceptance_ratio_below_minimum")


def transient_blocks(reports: DataFrame) -> DataFrame:
    """(report_id, possible, blocked): whether a report fell short only because of fetches that may succeed later.

    ``reports``: report_id, reasons, discovered, accepted, retryable, least_items, least_bps. Blocked is a report whose
    reasons are all thresholds, with retryable failures, that would meet both thresholds had these been accepted.
    """
    possible = F.least(F.col("accepted") + F.col("retryable"), F.col("discovered"))
    only = (F.size("reasons") > 0) & (F.size(F.array_except("reasons", F.array(*map(F.lit, THRESHOLD_REASONS)))) == 0)
    met = (possible >= F.col("least_items")) & (T.ratio_bps(possible, F.col("discovered")) >= F.col("least_bps"))
    return reports.select("report_id", possible.alias("possible"), F.coalesce(only & (F.col("retryable") > 0) & met, F.lit(False)).alias("blocked"))


#: A source's runs as a report: items found, failed runs of which some may be tried again, and what it falls short of.
_REPORTS = "select source_id as report_id, cast(count(*) as bigint) as discovered, cast(sum(case when succeeded and items_found > 2 then 1 else 0 end) as bigint) as accepted, cast(sum(case when not succeeded and k % 2 = 0 then 1 else 0 end) as bigint) as retryable, cast(floor(count(*) * 0.3) as bigint) as least_items, cast(2500 + (min(run_id) % 10) * 150 as bigint) as least_bps, cast(min(run_id) % 3 = 0 as int) as other from crawl_runs group by source_id"


@query(
    "transient_blocks",
    f"with r as ({_REPORTS}), p as (select *, least(accepted + retryable, discovered) as possible from r) select report_id, possible, other = 0 and (accepted < least_items or accepted * 10000 // discovered < least_bps) and retryable > 0 and possible >= least_items and possible * 10000 // discovered >= least_bps as blocked from p",
)
def _q_transient(r: Relations) -> DataFrame:
    """Sources short of accepted runs, with or without another reason beside."""
    rows = r.sql(_REPORTS)
    few, low = F.col("accepted") < F.col("least_items"), T.ratio_bps(F.col("accepted"), F.col("discovered")) < F.col("least_bps")
    reasons = F.array_compact(F.array(F.when(few, THRESHOLD_REASONS[0]), F.when(low, THRESHOLD_REASONS[1]), F.when(F.col("other") == 1, "repeated_content")))
    return transient_blocks(rows.withColumn("reasons", reasons))
