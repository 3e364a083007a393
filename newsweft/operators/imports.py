"""A universe snapshot over what is known: companies, their external ids and listings, and an audit row for each record."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.plans.catalog import query
from newsweft.plans.relations import Relations
from newsweft.session import written

URLS = ("homepage_url", "investor_relations_url", "newsroom_url", "blog_url")
COMPANY = "company_key string, name string, name_source string, aliases array<string>, ownership_status string, lifecycle_status string, " + ", ".join(f"{u} string" for u in URLS) + ", hints array<string>, metadata map<string,string>"
LISTING = "company_key string, ticker string, exchange string, is_primary boolean, metadata map<string,string>"
EXTERNAL = "source_name string, source_company_id string, company_key string, metadata map<string,string>"
SNAPSHOT = (
    "row_number bigint, source_company_id string, company_key string, name string, aliases array<string>, ownership_status string, lifecycle_status string, "
    + ", ".join(f"{u} string" for u in URLS)
    + ", hints array<string>, metadata map<string,string>, listings array<struct<ticker:string,exchange:string,is_primary:boolean,metadata:map<string,string>>>"
)


@dataclass(frozen=True)
class Import:
    """What there is after an import; ``action`` says of each row what became of it. ``run`` is its one row of counts."""

    companies: DataFrame
    external_ids: DataFrame
    listings: DataFrame
    audit: DataFrame
    run: DataFrame


def merged(old: Column, new: Column) -> Column:
    """The entries of both maps, the new ones over the old."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(new, F.create_map().cast("map<string,string>")))


def _entries(value: Column) -> Column:
    return F.array_sort(F.map_entries(value))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def import_universe(snapshot: DataFrame, companies: DataFrame, external_ids: DataFrame, listings: DataFrame, runs: DataFrame, source_name: str, input_sha256: str) -> Import:
    """The snapshot (SNAPSHOT) over companies (COMPANY), external ids (EXTERNAL) and listings (LISTING), by company key.

    A name that the universe gave is renamed, another stays; aliases, hints, statuses and URLs are filled only where
    they are empty or unknown; metadata takes the snapshot's entries over its own. A record whose company then is as it
    was is ``unchanged``. A company whose record has a primary listing has its others demoted first; listings and
    external ids are added or updated, never removed. What the snapshot lacks stays, as ``kept``. A snapshot that ``runs``
    (source_name, input_sha256) knows changes nothing: every record is ``unchanged``. Of records with one key the last
    counts. Every output is one equality join by key; nothing passes through the driver but whether the run is known.
    """
    replay = bool(runs.where((F.col("source_name") == source_name) & (F.col("input_sha256") == input_sha256)).limit(1).count())
    last = snapshot.groupBy("company_key").agg(F.max_by(F.struct(*[c for c in snapshot.columns if c != "company_key"]), "row_number").alias("r")).select("company_key", "r.*")
    new = written(last, "snapshot")
    o = lambda c: F.col(f"o.{c}")
    n = lambda c: F.col(f"n.{c}")
    there, told = o("name_source").isNotNull(), n("row_number").isNotNull()
    empty = lambda c: F.coalesce(F.size(o(c)), F.lit(0)) == 0
    after = {
        "name": F.when(there & (o("name_source") != "universe"), o("name")).otherwise(n("name")),
        "name_source": F.coalesce(o("name_source"), F.lit("universe")),
        "aliases": F.when(there & ~empty("aliases"), o("aliases")).otherwise(n("aliases")),
        **{c: F.when(there & (o(c) != "unknown"), o(c)).otherwise(n(c)) for c in ("ownership_status", "lifecycle_status")},
        **{u: F.coalesce(o(u), n(u)) for u in URLS},
        "hints": F.when(there & ~empty("hints"), o("hints")).otherwise(n("hints")),
        "metadata": merged(o("metadata"), n("metadata")),
    }
    equal = reduce(lambda a, b: a & b, [_same(_entries(v), _entries(o(c))) if c == "metadata" else _same(v, o(c)) for c, v in after.items()])
    action = F.when(~told, "kept").when(F.lit(replay), "unchanged").when(~there, "inserted").when(equal, "unchanged").otherwise("updated")
    both = companies.alias("o").join(new.alias("n"), "company_key", "full")
    if replay:
        both = both.where(there)
    made = both.select("company_key", *[F.when(told & F.lit(not replay), v).otherwise(o(c)).alias(c) for c, v in after.items()], action.alias("action"), n("row_number").alias("row_number"), n("source_company_id").alias("source_company_id"))
    made = written(made, "companies")

    mine = new.select(F.lit(source_name).alias("source_name"), "source_company_id", F.col("company_key").alias("key"), F.create_map(F.lit("company_key"), "company_key").alias("new_metadata")).where(F.lit(not replay))
    met = external_ids.join(mine, ["source_name", "source_company_id"], "full")
    known, named = F.col("company_key").isNotNull(), F.col("key").isNotNull()
    metadata = F.when(named, merged(F.col("metadata"), F.col("new_metadata"))).otherwise(F.col("metadata"))
    id_action = F.when(~named, "kept").when(~known, "inserted").when(_same(_entries(metadata), _entries(F.col("metadata"))), "unchanged").otherwise("updated")
    ids = met.select("source_name", "source_company_id", F.coalesce("company_key", "key").alias("company_key"), metadata.alias("metadata"), id_action.alias("action"))

    each = new.where(F.lit(not replay)).select("company_key", F.explode("listings").alias("l")).select("company_key", F.col("l.ticker").alias("ticker"), F.coalesce("l.exchange", F.lit("")).alias("exchange"), F.col("l.is_primary").alias("new_primary"), F.col("l.metadata").alias("new_metadata"), F.lit(True).alias("listed"))
    each = each.groupBy("company_key", "ticker", "exchange").agg(F.max("new_primary").alias("new_primary"), F.any_value("new_metadata").alias("new_metadata"), F.any_value("listed").alias("listed"))
    demoting = new.where(F.lit(not replay) & F.exists("listings", lambda x: x["is_primary"])).select("company_key", F.lit(True).alias("demoting"))
    joined = listings.join(each, ["company_key", "ticker", "exchange"], "full").join(demoting, "company_key", "left")
    was, told_l = F.col("is_primary").isNotNull(), F.coalesce("listed", F.lit(False))
    primary = F.when(told_l, F.col("new_primary")).when(F.coalesce("demoting", F.lit(False)), F.lit(False)).otherwise(F.col("is_primary"))
    noted = F.when(told_l, merged(F.col("metadata"), F.col("new_metadata"))).otherwise(F.col("metadata"))
    l_action = F.when(~was, "inserted").when(~told_l, F.when(primary == F.col("is_primary"), "kept").otherwise("demoted")).when((primary == F.col("is_primary")) & _same(_entries(noted), _entries(F.col("metadata"))), "unchanged").otherwise("updated")
    shown = joined.select("company_key", "ticker", "exchange", primary.alias("is_primary"), noted.alias("metadata"), l_action.alias("action"))

    audit = made.where("row_number is not null").select("row_number", "source_company_id", "company_key", F.col("name").alias("company_name"), "action")
    counts = audit.agg(F.count(F.lit(1)).alias("input_rows"), *[F.count_if(F.col("action") == a).alias(f"{a}_rows") for a in ("inserted", "updated", "unchanged")])
    run = counts.select(F.lit(source_name).alias("source_name"), F.lit(input_sha256).alias("input_sha256"), "*", F.lit(replay).alias("idempotent_replay"))
    return Import(made.drop("row_number", "source_company_id"), ids, shown, audit, run)


# Queries: what was known of the companies before, and a snapshot that renames, fills and adds

_BEFORE = "select company_key, name, company_id, market_cap from companies where company_id % 9 <> 5"
_SNAPSHOT = "select company_id as row_number, 'u-' || cast(company_id as string) as source_company_id, company_key, case when company_id % 10 = 3 then name || ' Renamed' else name end as name, alias, country, sector, company_id, market_cap, has_ir_url from companies where company_id % 7 <> 6"


def _text_map(**entries: Column) -> Column:
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()]), lambda e: e["value"].isNotNull()))


def given(r: Relations) -> tuple[DataFrame, ...]:
    """(snapshot, companies, external ids, listings, runs) of the derived companies."""
    c, i = F.col, F.col("company_id")
    none = F.array().cast("array<string>")
    at = lambda host: F.concat(F.lit(f"https://{host}."), "company_key", F.lit(".org/"))
    text = lambda v: F.lit(v)
    before = r.sql(_BEFORE)
    companies = before.select(
        "company_key", "name", F.when(i % 20 == 3, "editor").otherwise("universe").alias("name_source"), F.when(i % 4 == 0, none).otherwise(F.array(F.concat(text("old-"), "company_key"))).alias("aliases"), F.when(i % 3 == 0, "unknown").otherwise("public").alias("ownership_status"), text("active").alias("lifecycle_status"),
        F.when(i % 2 == 0, at("www")).alias("homepage_url"), F.lit(None).cast("string").alias("investor_relations_url"), F.lit(None).cast("string").alias("newsroom_url"), F.lit(None).cast("string").alias("blog_url"), none.alias("hints"),
        _text_map(cap=F.when(i % 5 != 0, c("market_cap").cast("string")), note=text("x")).alias("metadata"),
    )
    listing = lambda t, x, p, m: F.struct(t.alias("ticker"), x.alias("exchange"), p.alias("is_primary"), m.alias("metadata"))
    first, second = F.concat(text("T"), i.cast("string")), F.concat(text("S"), i.cast("string"))
    snapshot = r.sql(_SNAPSHOT).select(
        "row_number", "source_company_id", "company_key", "name", F.array("alias").alias("aliases"), F.when(i % 6 == 0, "private").otherwise("public").alias("ownership_status"), text("active").alias("lifecycle_status"), at("www").alias("homepage_url"),
        F.when(c("has_ir_url"), at("ir")).alias("investor_relations_url"), F.lit(None).cast("string").alias("newsroom_url"), F.lit(None).cast("string").alias("blog_url"), none.alias("hints"), _text_map(cap=c("market_cap").cast("string")).alias("metadata"),
        F.when(i % 3 == 0, F.array(listing(second, text("NYSE"), F.lit(True), _text_map(seen=text("now"))))).when(i % 3 == 1, F.array(listing(first, F.lit(None).cast("string"), F.lit(False), _text_map(seen=text("then"))))).otherwise(F.array().cast("array<struct<ticker:string,exchange:string,is_primary:boolean,metadata:map<string,string>>>")).alias("listings"),
    )
    external = before.where(i % 2 == 1).select(text("file").alias("source_name"), F.concat(text("u-"), i.cast("string")).alias("source_company_id"), "company_key", F.when(i % 3 == 0, _text_map(company_key=c("company_key"))).otherwise(_text_map(old=text("y"))).alias("metadata"))
    listings = before.where(i % 4 != 1).select("company_key", first.alias("ticker"), text("").alias("exchange"), (i % 8 != 2).alias("is_primary"), _text_map(seen=text("then")).alias("metadata"))
    runs = r.spark.createDataFrame([("file", "earlier")], "source_name string, input_sha256 string")
    return snapshot, companies, external, listings, runs


_CHANGE = f"""with b as ({_BEFORE}), s as ({_SNAPSHOT}), j as (select coalesce(s.company_key, b.company_key) as company_key, s.row_number, s.source_company_id, b.company_key is not null as there, s.company_key is not null as told, coalesce(s.company_id, b.company_id) as i, s.name as new_name, b.name as old_name, s.has_ir_url as ir, s.market_cap as cap from s full join b on s.company_key = b.company_key),
    a as (select *, case when there and (i % 20 = 3 or not told) then old_name else new_name end as name,
        case when not told then 'kept' when not there then 'inserted' when (i % 20 <> 3 and new_name <> old_name) or i % 4 = 0 or i % 3 = 0 or i % 2 = 1 or ir or (i % 5 = 0 and cap is not null) then 'updated' else 'unchanged' end as action from j)"""


@query("import_companies", f"{_CHANGE} select company_key, name, action, case when there and i % 4 <> 0 then 'old-' || company_key when told then (select alias from companies c where c.company_key = a.company_key) else '' end as aliases, case when there and i % 3 <> 0 then 'public' when not told then 'unknown' when i % 6 = 0 then 'private' else 'public' end as ownership_status from a")
def _q_companies(r: Relations) -> DataFrame:
    return import_universe(*given(r), "file", "now").companies.select("company_key", "name", "action", F.array_join("aliases", ",").alias("aliases"), "ownership_status")


@query("import_audit", f"{_CHANGE} select row_number, source_company_id, company_key, name as company_name, action from a where told")
def _q_audit(r: Relations) -> DataFrame:
    return import_universe(*given(r), "file", "now").audit


@query(
    "import_external_ids",
    f"with b as ({_BEFORE}), s as ({_SNAPSHOT}), x as (select 'u-' || cast(company_id as string) as id, company_key, company_id % 3 = 0 as same from b where company_id % 2 = 1) select 'file' as source_name, coalesce(x.id, s.source_company_id) as source_company_id, coalesce(x.company_key, s.company_key) as company_key, case when s.source_company_id is null then 'kept' when x.id is null then 'inserted' when same then 'unchanged' else 'updated' end as action from x full join s on x.id = s.source_company_id",
)
def _q_ids(r: Relations) -> DataFrame:
    return import_universe(*given(r), "file", "now").external_ids.select("source_name", "source_company_id", "company_key", "action")


@query(
    "import_listings",
    f"""with b as ({_BEFORE}), s as ({_SNAPSHOT}), o as (select company_key, 'T' || cast(company_id as string) as ticker, '' as exchange, company_id % 8 <> 2 as prim from b where company_id % 4 <> 1),
    n as (select company_key, case when company_id % 3 = 0 then 'S' else 'T' end || cast(company_id as string) as ticker, case when company_id % 3 = 0 then 'NYSE' else '' end as exchange, company_id % 3 = 0 as prim from s where company_id % 3 <> 2)
    select coalesce(o.company_key, n.company_key) as company_key, coalesce(o.ticker, n.ticker) as ticker, coalesce(o.exchange, n.exchange) as exchange, case when n.ticker is not null then n.prim when d.company_key is not null then false else o.prim end as is_primary,
        case when o.ticker is null then 'inserted' when n.ticker is null then case when o.prim and d.company_key is not null then 'demoted' else 'kept' end when n.prim = o.prim then 'unchanged' else 'updated' end as action
    from o full join n on o.company_key = n.company_key and o.ticker = n.ticker and o.exchange = n.exchange left join (select distinct company_key from n where prim) d on d.company_key = coalesce(o.company_key, n.company_key)""",
)
def _q_listings(r: Relations) -> DataFrame:
    return import_universe(*given(r), "file", "now").listings.select("company_key", "ticker", "exchange", "is_primary", "action")


@query("import_replay", f"with s as ({_SNAPSHOT}), b as ({_BEFORE}) select s.company_key, 'unchanged' as action from s join b using (company_key)")
def _q_replay(r: Relations) -> DataFrame:
    """A snapshot that was imported before: its records change nothing, and what it would have added is not added."""
    return import_universe(*given(r), "file", "earlier").audit.select("company_key", "action")
