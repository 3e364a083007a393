"""Health of recipes and sources after all their runs: counts, status, structure drift, freshness, lateness and backoff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import text as T
from newsweft.plans.catalog import query
from newsweft.plans.relations import Relations

#: Runs of a recipe whose structures one sorted piece compares; a recipe with more has more pieces.
PIECE = 4096


@dataclass(frozen=True)
class Limits:
    """After how many failures or empty runs a recipe is rebuilt, after how many seconds its content is stale, and a silent recipe late."""

    failures: int = 3
    empty: int = 3
    stale_after: int = 20 * 86400
    late_after: int = 2 * 86400


def freshness(published_at: Column, at: Column, dates_complete: Column, correct: Column, stale_after: int) -> Column:
    """``unknown``, ``overdue``, ``content_stale`` or ``fresh`` of a run at ``at``, given the newest item so far."""
    by_date = F.when(published_at < at - F.make_dt_interval(secs=F.lit(stale_after)), "content_stale").when(~correct, "overdue").when(published_at.isNull(), "unknown").otherwise("fresh")
    return F.when(~dates_complete, F.when(correct, "unknown").otherwise("overdue")).otherwise(by_date)


def structure_drift(runs: DataFrame) -> DataFrame:
    """(recipe_id, drifts, fingerprint): how often a recipe's structure differed from the last one seen, and the last one.

    A recipe's runs are compared in pieces of consecutive ids, then the pieces' ends, so that no task sorts a hot
    recipe's whole history.
    """
    seen = runs.where(F.col("fingerprint").isNotNull()).select("recipe_id", "run_id", "fingerprint", F.floor(F.col("run_id") / PIECE).alias("piece"))
    before = F.lag("fingerprint").over(Window.partitionBy("recipe_id", "piece").orderBy("run_id"))
    pieces = seen.withColumn("moved", (F.col("fingerprint") != before).cast("int")).groupBy("recipe_id", "piece").agg(
        F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"), F.min_by("fingerprint", "run_id").alias("first"), F.max_by("fingerprint", "run_id").alias("last")
    )
    joined = F.coalesce((F.col("first") != F.lag("last").over(Window.partitionBy("recipe_id").orderBy("piece"))).cast("int"), F.lit(0))
    return pieces.withColumn("joined", joined).groupBy("recipe_id").agg(F.sum(F.col("moved") + F.col("joined")).alias("drifts"), F.max_by("last", "piece").alias("fingerprint"))


def fold_recipe_state(runs: DataFrame, limits: Limits = Limits(), until: Column | None = None) -> DataFrame:
    """A recipe's state after its runs in order of their ids, whatever batches they came in.

    ``runs``: run_id, recipe_id, started_at, correct, transient, accepted, fingerprint, published_at, dates_complete. A
    transient failure changes no counter and no verdict. ``late`` is a recipe without a run for ``late_after`` seconds
    until ``until``, by default the newest run of all. Counters are those since the run that reset them, verdicts those
    of the last telling run: aggregates, which combine before they are shuffled.
    """
    telling = runs.where(~F.col("transient"))
    marks = telling.groupBy("recipe_id").agg(F.max(F.when(F.col("correct"), F.col("run_id"))).alias("ok"), F.max(F.when(F.col("accepted") > 0, F.col("run_id"))).alias("full"), F.max("run_id").alias("told"))
    since = lambda c: F.col("run_id") > F.coalesce(c, F.lit(-1).cast("bigint"))
    counts = runs.join(marks, "recipe_id", "left").groupBy("recipe_id").agg(
        F.count_if(~F.col("transient") & ~F.col("correct") & since("ok")).alias("failures"), F.count_if(~F.col("transient") & (F.col("accepted") == 0) & since("full")).alias("empty_runs"),
        F.max_by(F.struct("started_at", "dates_complete", "correct"), F.when(F.col("run_id") == F.col("told"), F.col("run_id"))).alias("t"),
        F.max_by("published_at", F.when(F.col("published_at").isNotNull() & (F.col("run_id") <= F.col("told")), F.col("run_id"))).alias("published_then"),
        F.max_by("published_at", F.when(F.col("published_at").isNotNull(), F.col("run_id"))).alias("published_at"), F.max("run_id").alias("last_run"), F.max_by("correct", "run_id").alias("last_correct"), F.max_by("started_at", "run_id").alias("last_at"),
    )
    newest = F.broadcast(runs.agg(F.max("started_at").alias("newest")))  # one row
    rebuild = (F.col("failures") >= limits.failures) | (F.col("empty_runs") >= limits.empty)
    fresh = F.coalesce(freshness(F.col("published_then"), F.col("t.started_at"), F.col("t.dates_complete"), F.col("t.correct"), limits.stale_after), F.lit("unknown"))
    right = F.coalesce(F.when(F.col("t.correct"), "passing").when(~F.col("t.correct"), "failing"), F.lit("unknown"))
    late = F.col("last_at") + F.make_dt_interval(secs=F.lit(limits.late_after)) < (F.col("newest") if until is None else until)
    made = counts.crossJoin(newest).join(structure_drift(runs), "recipe_id", "left")
    return made.select(
        "recipe_id", "last_run", "failures", "empty_runs", rebuild.alias("rebuild"), F.when(rebuild, "stale").when(F.col("last_correct"), "passed").otherwise("failed").alias("status"), fresh.alias("freshness"), right.alias("correctness"),
        F.coalesce("drifts", F.lit(0).cast("bigint")).alias("drifts"), "fingerprint", "published_at", late.alias("late"),
    )


def fold_source_state(runs: DataFrame) -> DataFrame:
    """(source_id, failures, backoff_until, zero_runs, successes, items, last_nonzero_at) after a source's runs in order of their ids.

    A failure waits two minutes, twice as long for each one before it without a success, up to an hour; a success ends that.
    """
    marks = runs.groupBy("source_id").agg(F.max(F.when(F.col("succeeded"), F.col("run_id"))).alias("ok"), F.max(F.when(F.col("succeeded") & (F.col("items_found") > 0), F.col("run_id"))).alias("full"))
    since = lambda c: F.col("run_id") > F.coalesce(c, F.lit(-1).cast("bigint"))
    nonzero = F.col("succeeded") & (F.col("items_found") > 0)
    made = runs.join(marks, "source_id").groupBy("source_id").agg(
        F.count_if(~F.col("succeeded") & since("ok")).alias("failures"), F.count_if(F.col("succeeded") & since("full")).alias("zero_runs"), F.count_if("succeeded").alias("successes"),
        F.coalesce(F.sum(F.when(F.col("succeeded"), F.col("items_found"))), F.lit(0)).alias("items"), F.max_by("started_at", F.when(nonzero, F.col("run_id"))).alias("last_nonzero_at"), F.max_by("started_at", "run_id").alias("last_at"),
    )
    wait = F.make_dt_interval(secs=T.backoff(F.col("failures") - 1))
    return made.select("source_id", "failures", F.when(F.col("failures") > 0, F.col("last_at") + wait).alias("backoff_until"), "zero_runs", "successes", "items", "last_nonzero_at")


_RECIPES = """with r as (select *, coalesce(sum(case when correct and not transient then 1 end) over w, 0) as ok_before, coalesce(sum(case when accepted > 0 and not transient then 1 end) over w, 0) as full_before,
        last_value(published_at ignore nulls) over w as published, lag(fingerprint) over (partition by recipe_id, fingerprint is null order by run_id) as was from recipe_runs window w as (partition by recipe_id order by run_id)),
    e as (select recipe_id, max(ok_before) as ok, max(full_before) as filled, max(run_id) as last_run, max(run_id) filter (where not transient) as told, max(started_at) as newest_own from r group by 1),
    c as (select r.recipe_id, count(*) filter (where not transient and not correct and ok_before = ok) as failures, count(*) filter (where not transient and accepted = 0 and full_before = filled) as empty_runs, count(*) filter (where fingerprint <> was) as drifts from r join e using (recipe_id) group by 1)
    select c.recipe_id, e.last_run, cast(failures as bigint) as failures, cast(empty_runs as bigint) as empty_runs, failures >= 3 or empty_runs >= 3 as rebuild, case when failures >= 3 or empty_runs >= 3 then 'stale' when l.correct then 'passed' else 'failed' end as status,
        case when t.run_id is null then 'unknown' when not t.dates_complete then case when t.correct then 'unknown' else 'overdue' end when t.published < t.started_at - interval 20 day then 'content_stale' when not t.correct then 'overdue' when t.published is null then 'unknown' else 'fresh' end as freshness,
        case when t.correct then 'passing' when not t.correct then 'failing' else 'unknown' end as correctness, cast(drifts as bigint) as drifts, (select arg_max(fingerprint, run_id) from r x where x.recipe_id = c.recipe_id and fingerprint is not null) as fingerprint,
        l.published as published_at, l.started_at + interval 2 day < (select max(started_at) from recipe_runs) as late
    from c join e using (recipe_id) join r l on l.recipe_id = c.recipe_id and l.run_id = e.last_run left join r t on t.recipe_id = c.recipe_id and t.run_id = e.told"""


@query("recipe_state", _RECIPES)
def _q_recipe_state(r: Relations) -> DataFrame:
    return fold_recipe_state(r.recipe_runs)


@query(
    "source_state",
    """with r as (select *, coalesce(sum(case when succeeded then 1 end) over w, 0) as ok_before, coalesce(sum(case when succeeded and items_found > 0 then 1 end) over w, 0) as full_before, row_number() over (partition by source_id order by run_id desc) as back from crawl_runs window w as (partition by source_id order by run_id)),
    e as (select source_id, max(ok_before) as ok, max(full_before) as filled from r group by 1), c as (select r.source_id, count(*) filter (where not succeeded and ok_before = ok) as failures, count(*) filter (where succeeded and full_before = filled and items_found = 0) as zero_runs,
        count(*) filter (where succeeded) as successes, coalesce(sum(items_found) filter (where succeeded), 0) as items, arg_max(started_at, run_id) filter (where succeeded and items_found > 0) as last_nonzero_at, any_value(started_at) filter (where back = 1) as last_at from r join e using (source_id) group by 1)
    select source_id, cast(failures as bigint) as failures, case when failures > 0 then last_at + to_seconds(cast(least(3600, 120 * pow(2, least(failures - 1, 5))) as bigint)) end as backoff_until, cast(zero_runs as bigint) as zero_runs, cast(successes as bigint) as successes, cast(items as bigint) as items, last_nonzero_at from c""",
)
def _q_source_state(r: Relations) -> DataFrame:
    return fold_source_state(r.crawl_runs)
