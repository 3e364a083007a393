"""Candidates of a discovery: what its observations point to, each source once, the first so many of a company."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import urls as U
from newsweft.plans.catalog import query
from newsweft.plans.relations import Relations

MOST_CANDIDATES = 200


def keyed_observations(observations: DataFrame) -> DataFrame:
    """``observations`` (company_id, seq, url, kind, confidence, method) without fragments and ignored URLs, with their source's ``key``."""
    bare = observations.withColumn("url", F.split_part("url", F.lit("#"), F.lit(1)))
    return bare.where(~U.is_ignored_candidate(F.col("url"))).withColumn("key", U.source_key(F.col("url"), F.col("kind")))


def admitted_observations(observations: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """The observations of each company's first ``most`` sources, with their ``place`` in order of first appearance.

    Observations of a source are one row before sources are ranked, and a rank within a bound is cut on every task
    before rows are shuffled. A source beyond the bound stays out, however often it appears.
    """
    firsts = observations.groupBy("company_id", "kind", "key").agg(F.min("seq").alias("first_seq"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy("first_seq", "kind", "key"))
    kept = firsts.withColumn("place", place).where(F.col("place") <= most)
    return observations.join(kept.select("company_id", "kind", "key", "place"), ["company_id", "kind", "key"])


def merge_observations(observations: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """(company_id, kind, key, url, confidence, place, n_observations, methods) of each admitted source.

    The greatest confidence counts; its URL stands, of several that without a query, then the shortest, then the first.
    A page's URL loses its query. ``methods`` are the distinct ways in which it was seen, in order of their names; the
    list of all its observations is ``admitted_observations`` in order of ``seq``, a row each, however many there are.
    """
    admitted = admitted_observations(keyed_observations(observations), most)
    better = F.struct((-F.col("confidence")).alias("c"), F.contains("url", F.lit("?")).alias("q"), F.length("url").alias("n"), "seq", "url")
    merged = admitted.groupBy("company_id", "kind", "key").agg(F.min(better).alias("b"), F.max("confidence").alias("confidence"), F.min("place").alias("place"), F.count(F.lit(1)).alias("n_observations"), F.array_sort(F.collect_set("method")).alias("methods"))
    url = F.when(F.col("kind") == "html", F.split_part("b.url", F.lit("?"), F.lit(1))).otherwise(F.col("b.url"))
    return merged.select("company_id", "kind", "key", url.alias("url"), "confidence", "place", "n_observations", "methods")


#: Links seen on sites: the items' URLs, with a part behind the number sign and some with a comments feed that is no source.
_SEEN = "select company_id, doc_id as seq, case when doc_id % 23 = 0 then url || '/comments' when doc_id % 4 = 0 then split_part(url, '#', 1) || '#x' else url end as url, source_kind as kind, doc_id % 10 as confidence, case doc_id % 3 when 0 then 'link' when 1 then 'feed' else 'alternate' end as method from feed_items"


@query(
    "candidate_merge",
    rf"""with o as ({_SEEN}), b as (select *, split_part(url, '#', 1) as u from o where not contains(split_part(split_part(url, '#', 1), '?', 1), '/comments')),
    k as (select *, regexp_extract(u, '^(https?://)(www\.)?([^/?]*)', 1) || regexp_extract(u, '^(https?://)(www\.)?([^/?]*)', 3) || case when kind = 'html' then case when rtrim(regexp_replace(split_part(u, '?', 1), '^https?://[^/]*', ''), '/') = '' then '/' else rtrim(regexp_replace(split_part(u, '?', 1), '^https?://[^/]*', ''), '/') end else regexp_replace(u, '^https?://[^/]*', '') end as key from b),
    f as (select company_id, kind, key, row_number() over (partition by company_id order by min(seq), kind, key) as place from k group by company_id, kind, key),
    r as (select k.*, place, row_number() over (partition by company_id, kind, key order by confidence desc, contains(u, '?'), length(u), seq) as best from k join f using (company_id, kind, key) where place <= 25)
    select company_id, kind, key, max(case when best = 1 then case when kind = 'html' then split_part(u, '?', 1) else u end end) as url, max(confidence) as confidence, cast(any_value(place) as int) as place, cast(count(*) as bigint) as n_observations, string_agg(distinct method, ',' order by method) as methods from r group by company_id, kind, key""",
)
def _q_merge(r: Relations) -> DataFrame:
    """Here with a bound of 25, which companies exceed."""
    return merge_observations(r.sql(_SEEN), 25).withColumn("methods", F.array_join("methods", ","))
