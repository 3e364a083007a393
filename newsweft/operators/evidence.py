"""What article URLs say of a publication: the path prefix that most of them share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import urls as U
from newsweft.functions.names import let
from newsweft.plans.catalog import query
from newsweft.plans.relations import Relations

# Single folders that are specific enough to stand for a publication's articles.
SPECIFIC_FOLDERS = ("articles", "blog", "blogs", "engineering", "insights", "journal", "news", "newsroom", "press", "press-release", "press-releases", "research", "stories", "updates")


def boundary_prefixes(path: Column) -> Column:
    """(prefix, next): every beginning of the path that ends in ``/``, ``-`` or ``_``, with the one after it, at the end the path itself."""
    start = lambda pieces, n: F.array_join(F.slice(pieces, F.lit(1), n), "")
    nodes = lambda pieces: F.transform(pieces, lambda x, i: F.struct(start(pieces, i + 1).alias("prefix"), start(pieces, i + 2).alias("next")))
    found = let(F.filter(F.split(path, "(?<=[/_-])"), lambda x: x != ""), nodes)
    return F.filter(found, lambda n: n["prefix"].rlike("[/_-]$"))


def is_specific(prefix: Column) -> Column:
    """A prefix of five letters or more that is no single folder, or one of those that stand for articles."""
    single = prefix.rlike("^/+[^/]+/+$")
    return (F.octet_length(prefix) >= 5) & (~single | F.lower(F.regexp_replace(prefix, "/", "")).isin(*SPECIFIC_FOLDERS))


def evidence_prefixes(evidence: DataFrame) -> DataFrame:
    """(source_id, prefix, support): of the path prefixes at which a publication's article paths part, the one that most of them share.

    ``evidence`` has source_id, publication_url and evidence_url. URLs of other hosts, of the root and of the
    publication's own path do not count, nor does one that repeats. The paths of each host are a trie: every boundary
    prefix of a path is a row, and paths part at a prefix where more than one prefix comes next. Of equal support the
    longest counts, then the first. One aggregate of rows finds it; no two URLs are compared. A source without such a
    prefix has no row.
    """
    host, path = U.bare_host(F.col("evidence_url")), U.path(F.col("evidence_url"))
    own = F.regexp_replace(U.path(F.col("publication_url")), "/+$", "")
    near = evidence.where(U.hosts_related(U.bare_host(F.col("publication_url")), host) & (path != "/") & (F.regexp_replace(path, "/+$", "") != own))
    paths = near.select("source_id", host.alias("host"), path.alias("path")).distinct()
    nodes = paths.select("source_id", "host", F.explode(boundary_prefixes(F.col("path"))).alias("n")).select("source_id", "host", "n.*")
    counted = nodes.groupBy("source_id", "host", "prefix").agg(F.count(F.lit(1)).alias("support"), F.min("next").alias("least"), F.max("next").alias("most"))
    parting = counted.where((F.col("least") != F.col("most")) & is_specific(F.col("prefix")))
    best = parting.groupBy("source_id").agg(F.min(F.struct((-F.col("support")).alias("n"), (-F.octet_length("prefix")).alias("size"), "prefix")).alias("b"))
    return best.select("source_id", F.col("b.prefix").alias("prefix"), (-F.col("b.n")).alias("support"))


@query(
    "evidence_prefixes",
    rf"""with u as (select source_id, regexp_replace(split_part(split_part(publication_url, '://', 2), '/', 1), '^(www\.)+', '') as ph, regexp_replace(regexp_replace(publication_url, '^https?://[^/]*', ''), '/+$', '') as pp,
        split_part(split_part(evidence_url, '://', 2), '/', 1) as host, regexp_replace(evidence_url, '^https?://[^/]*', '') as path from evidence),
    p as (select distinct source_id, host, path from u where (host = ph or ends_with(host, '.' || ph) or ends_with(ph, '.' || host)) and path <> '/' and rtrim(path, '/') <> pp),
    b as (select *, list_filter(list_transform(range(1, length(path) + 1), lambda i: substr(path, 1, i)), lambda x: right(x, 1) in ('/', '-', '_')) as cuts from p),
    c as (select x.source_id, x.host, list_filter(x.cuts, lambda k: list_contains(y.cuts, k))[-1] as prefix from b x join b y on x.source_id = y.source_id and x.host = y.host and x.path < y.path),
    d as (select distinct * from c where length(prefix) >= 5 and (not regexp_matches(prefix, '^/[^/]+/$') or trim(prefix, '/') in {SPECIFIC_FOLDERS})),
    s as (select d.source_id, d.prefix, count(*) as support from d join p on p.source_id = d.source_id and p.host = d.host and starts_with(p.path, d.prefix) group by d.source_id, d.host, d.prefix)
    select source_id, prefix, support from s qualify row_number() over (partition by source_id order by support desc, length(prefix) desc, prefix) = 1""",
)
def _q_prefixes(r: Relations) -> DataFrame:
    return evidence_prefixes(r.evidence)
