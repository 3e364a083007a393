"""The archive: export selection, article projection, adaptive shards, pages, manifests and generation ids."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.functions import text as T
from newsweft.functions import urls as U
from newsweft.operators import reads
from newsweft.plans.catalog import query
from newsweft.plans.dialect import AS_OF, DUCK
from newsweft.plans.relations import Relations
from newsweft.session import written

SHARD_RECORDS, SHARD_BYTES, DEEPEST_PREFIX = 5000, 1 << 20, 8
BROWSE_PAGE, CATEGORY_PAGE = 50, 100
_ASOF = DUCK.ts(AS_OF)


def export_names(companies: DataFrame) -> DataFrame:
    """(company_id, export_key, export_name): share classes of one legal entity under one key.

    Only names with a share-class marker and a corporate designator merge, and only where several share their base.
    """
    based = companies.select("company_id", "company_key", "name", T.legal_base(F.col("name")).alias("base"), (F.col("name").rlike(T.SHARE_CLASS) & F.col("name").rlike(T.CORPORATE)).alias("marked"))
    shared = based.filter("marked").groupBy("base").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("base", F.lit(True).alias("shared"))
    j = based.join(shared, "base", "left")
    key = F.when(F.col("marked") & F.col("shared"), T.slug(F.col("base"))).otherwise(F.col("company_key"))
    return j.select("company_id", key.alias("export_key"), F.when(F.length("base") > 0, F.col("base")).otherwise(F.col("name")).alias("export_name"))


def export_selection(r: Relations, scope: str | None = None) -> DataFrame:
    """The items to export: hydrated before long before short variants, one for each URL, then one for each story."""
    items = reads.visible_items(r, include_future=False).filter(F.lit(scope == "approved_public") | F.col("public_export_allowed"))
    state = r.content_state.select(F.col("feed_item_id").alias("id"), F.col("status").alias("crawl"))
    chars = F.length(F.trim("body_text"))
    narrow = items.select("id", "company_id", "source_id", "canonical_url", "title", "published_at", "fetched_at", "created_at", "source_kind", "kind", chars.alias("chars"), "content_hash").join(state, "id", "left")
    ranked = narrow.withColumns({"rank": F.when(F.col("crawl") == "succeeded", 0).when(F.col("chars") >= 200, 1).otherwise(2), "url_key": U.identity_key(F.col("canonical_url"))})
    one = reads._first(ranked, [F.col("company_id"), F.col("url_key")], [F.col("rank"), F.desc("chars"), reads.kind_rank(F.col("kind")), F.desc("fetched_at"), F.col("id")])
    story = one.withColumn("story", T.story_identity(F.col("url_key"), F.col("title"), F.col("published_at")))
    return reads._first(story, [F.col("company_id"), F.col("story")], [F.col("rank"), F.desc("chars"), reads.kind_rank(F.col("source_kind")), F.desc("fetched_at"), F.col("id")])


_EXPORT = f"""{reads._VISIBLE}, c as (select v.*, length(trim(v.body_text)) as chars, case when st.status = 'succeeded' then 0 when length(trim(v.body_text)) >= 200 then 1 else 2 end as crank from visible v left join content_state st on st.feed_item_id = v.id where {reads._NOW} and public_export_allowed),
    a as (select *, row_number() over (partition by company_id, {DUCK.url_key('canonical_url')} order by crank, chars desc, {reads._KIND.format('kind')}, fetched_at desc, id) as ra from c),
    b as (select *, row_number() over (partition by company_id, {reads._STORY} order by crank, chars desc, {reads._KIND.format('source_kind')}, fetched_at desc, id) as rb from a where ra = 1), exported as (select * from b where rb = 1)"""


@query("export_selection", f"with {_EXPORT} select id, company_id, crank as rank, cast(chars as int) as chars from exported")
def _q_export(r: Relations) -> DataFrame:
    return export_selection(r).select("id", "company_id", "rank", "chars")


def project_articles(r: Relations) -> DataFrame:
    """(document_id, company_key, month, path, ...) of each exported item."""
    items = export_selection(r).join(export_names(r.companies), "company_id")
    at = F.coalesce("published_at", "created_at")
    doc = T.document_id(F.col("export_key"), F.col("canonical_url"))
    out = items.withColumns({"document_id": doc, "month": F.date_format(at, "yyyy-MM"), "at": at})
    path = F.concat_ws("/", F.lit("articles/v1"), T.company_bucket(F.col("export_key")), "export_key", F.date_format("at", "yyyy"), F.date_format("at", "MM"), F.substring("document_id", 1, 2), "document_id", F.lit("article.md"))
    return out.withColumn("path", path)


_DOC = "sha256('company-news-archive/article/v1' || chr(0) || company_key || chr(0) || canonical_url)"
_PROJECT = f"""{_EXPORT}, articles as (select e.*, x.export_key, sha256('company-news-archive/article/v1' || chr(0) || x.export_key || chr(0) || e.canonical_url) as document_id, strftime(coalesce(published_at, created_at), '%Y-%m') as month,
    coalesce(published_at, created_at) as shown_at, x.export_name from exported e join exportnames x on x.company_id = e.company_id)"""
_NAMES = r"""eb as (select company_id, company_key, name, trim(regexp_replace(name, '(?i)\s+(class [a-d].*|series [a-d].*|common stock|capital stock|ordinary shares)\s*$', '')) as base, regexp_matches(name, '(?i)\bclass [a-d]\b') and regexp_matches(name, '(?i)(\binc\b|\bcorp\b)') as marked from companies),
    em as (select base from eb where marked group by base having count(*) > 1), exportnames as (select company_id, case when marked and em.base is not null then regexp_replace(regexp_replace(lower(eb.base), '[^a-z0-9]+', '-', 'g'), '(^-+|-+$)', '', 'g') else company_key end as export_key, eb.base as export_name from eb left join em on em.base = eb.base)"""


@query("article_paths", f"with {_NAMES}, {_PROJECT} select id, document_id, month, 'articles/v1/' || substr(sha256(export_key), 1, 2) || '/' || export_key || '/' || strftime(shown_at, '%Y') || '/' || strftime(shown_at, '%m') || '/' || substr(document_id, 1, 2) || '/' || document_id || '/article.md' as path from articles")
def _q_paths(r: Relations) -> DataFrame:
    return project_articles(r).select("id", "document_id", "month", "path")


@query("duplicate_documents", f"with {_NAMES}, {_PROJECT}, d as (select document_id from articles union all select document_id from articles where right(id, 1) = '7') select document_id, cast(count(*) as bigint) as n from d group by 1 having count(*) > 1")
def _q_duplicates(r: Relations) -> DataFrame:
    """Documents that two exported items resolve to, here those of some items given twice: an archive is only written when there are none."""
    rows = project_articles(r).select("id", "document_id")
    return rows.unionByName(rows.filter(F.col("id").endswith("7"))).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def shards(lines: DataFrame, records: int = SHARD_RECORDS, size: int = SHARD_BYTES) -> DataFrame:
    """(month, prefix, record_count, byte_count, first, last) of adaptive shards over (month, document_id, bytes).

    A shard is the shortest hash prefix within both bounds. Rows are summed once to the longest prefixes; those sums
    are dealt to all their nine prefixes and summed again, map-side first. A prefix is a shard when it is within the
    bounds, or as deep as can be, or alone, while its parent is not.
    """
    deepest = lines.groupBy("month", F.substring("document_id", 1, DEEPEST_PREFIX).alias("full")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.min("document_id").alias("first"), F.max("document_id").alias("last"))
    each = deepest.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST_PREFIX)))).withColumn("prefix", F.substr("full", F.lit(1), F.col("k")))
    whole = each.groupBy("month", "prefix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.min("first").alias("first"), F.max("last").alias("last"))
    split = ((F.col("n") > records) | (F.col("b") > size)) & (F.length("prefix") < DEEPEST_PREFIX) & (F.col("n") > 1)
    # A split prefix tells its sixteen children so: one more aggregate instead of a join with all prefixes.
    whole = whole.withColumn("split", split)
    none = F.lit(None)
    own = F.struct("prefix", "n", "b", "first", "last", F.col("split").alias("split"), F.lit(False).alias("told"))
    child = F.transform(F.array(*map(F.lit, "0123456789abcdef")), lambda d: F.struct(F.concat("prefix", d).alias("prefix"), none.cast("bigint").alias("n"), none.cast("bigint").alias("b"), none.cast("string").alias("first"), none.cast("string").alias("last"), none.cast("boolean").alias("split"), F.lit(True).alias("told")))
    dealt = whole.select("month", F.explode(F.concat(F.array(own), F.when(F.col("split"), child).otherwise(F.array()))).alias("x")).select("month", "x.*")
    known = dealt.groupBy("month", "prefix").agg(F.max("n").alias("record_count"), F.max("b").alias("byte_count"), F.max("first").alias("first"), F.max("last").alias("last"), F.max("split").alias("split"), F.max("told").alias("told"))
    return known.filter("record_count is not null and not split and (told or prefix = '')").drop("split", "told")


def _shard_sql(records: int, size: int) -> str:
    return f"""lines as (select month, document_id, octet_length(encode(title)) + length(canonical_url) + 200 as bytes from articles), p as (select month, substr(document_id, 1, k) as prefix, k, count(*) as n, sum(bytes) as b, min(document_id) as first, max(document_id) as last from lines, range(0, 9) t(k) group by all),
    s as (select *, (n > {records} or b > {size}) and k < 8 and n > 1 as split from p) select s.month, s.prefix, cast(s.n as bigint) as record_count, cast(s.b as bigint) as byte_count, s.first, s.last from s left join s u on u.month = s.month and u.k = s.k - 1 and u.prefix = substr(s.prefix, 1, s.k - 1) where not s.split and (s.k = 0 or u.split)"""


@query("archive_shards", f"with {_NAMES}, {_PROJECT}, {_shard_sql(40, 8000)}")
def _q_shards(r: Relations) -> DataFrame:
    """The shards under bounds small enough to split here."""
    bytes_ = F.octet_length("title") + F.length("canonical_url") + 200
    return shards(project_articles(r).select("month", "document_id", bytes_.alias("bytes")), records=40, size=8000)


def number_rows(rows: DataFrame, order: list[str], name: str, parts: int = 64) -> DataFrame:
    """``rows`` with gapless numbers from 0 in order, without a single sorting task: range partitions, then their counts.

    The range-partitioned rows are sorted, given their place within the partition and written down, so that the counts
    of the partitions, which give each its start, are counts of the same partitions; another exchange would draw its
    own bounds.
    """
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(dealt.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")), "numbered")
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn("__s", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__s")
    return placed.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__i")).drop("__p", "__i", "__s")


@query("browse_pages", f"with {_NAMES}, {_PROJECT}, n as (select *, row_number() over (partition by export_key order by shown_at desc, fetched_at desc, id) - 1 as i from articles) select export_key, cast(i // 50 + 1 as bigint) as page, cast(count(*) as bigint) as n_articles, min(id) as least_id from n group by all")
def _q_browse(r: Relations) -> DataFrame:
    """Fixed pages of fifty for each company, newest first.

    An article's place is its place within its day after all later days' articles, so that a company with a third of
    all articles is sorted a day at a time.
    """
    rows = project_articles(r).select("export_key", "id", "at", "fetched_at", F.col("at").cast("date").alias("day"))
    days = rows.groupBy("export_key", "day").agg(F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy("export_key").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("export_key", "day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("export_key", "day").orderBy(F.desc("at"), F.desc("fetched_at"), "id")) - 1
    placed = rows.withColumn("i", place).join(starts, ["export_key", "day"])
    paged = placed.select("export_key", "id", (F.floor((F.col("start") + F.col("i")) / BROWSE_PAGE) + 1).cast("bigint").alias("page"))
    return paged.groupBy("export_key", "page").agg(F.count(F.lit(1)).alias("n_articles"), F.min("id").alias("least_id"))


@query("company_directory", f"with {_NAMES}, {_PROJECT} select export_key, case when regexp_matches(lower(substr(any_value(export_name), 1, 1)), '[a-z]') then lower(substr(any_value(export_name), 1, 1)) when regexp_matches(substr(any_value(export_name), 1, 1), '[0-9]') then '0-9' else 'other' end as bucket, cast(count(*) as bigint) as n_articles, cast(min(published_at) as string) as first_at, cast(max(published_at) as string) as last_at, cast(count(distinct month) as bigint) as n_months from articles group by export_key")
def _q_directory(r: Relations) -> DataFrame:
    g = project_articles(r).groupBy("export_key").agg(F.min("export_name").alias("name"), F.count(F.lit(1)).alias("n_articles"), F.min("published_at").cast("string").alias("first_at"), F.max("published_at").cast("string").alias("last_at"), F.countDistinct("month").alias("n_months"))
    return g.select("export_key", T.directory_bucket(F.col("name")).alias("bucket"), "n_articles", "first_at", "last_at", "n_months")


@query("company_months", f"with {_NAMES}, {_PROJECT} select export_key, month, cast(count(*) as bigint) as n_articles from articles group by all")
def _q_months(r: Relations) -> DataFrame:
    return project_articles(r).groupBy("export_key", "month").agg(F.count(F.lit(1)).alias("n_articles"))


def _ordered_hash(value: Column, *order: str) -> Column:
    """The hash of a group's values, one to a line, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))
    return F.sha2(F.array_join(F.transform(rows, lambda x: x["v"]), "\n"), 256)


def generation_ids(lines: DataFrame) -> DataFrame:
    """(month, generation): a hash over the month's article lines in order of their ids.

    Lines are hashed, then the lines of each four-digit id prefix, then the month's prefixes, of which there are at
    most 65,536: no task holds more than a prefix's lines. Fetch times are no part of it.
    """
    fields = F.sha2(F.concat_ws(T.NUL, "document_id", "export_key", "canonical_url", "title", "content_hash"), 256)
    part = lines.groupBy("month", F.substring("document_id", 1, 4).alias("prefix")).agg(_ordered_hash(fields, "document_id").alias("g"))
    return part.groupBy("month").agg(_ordered_hash(F.concat("prefix", F.lit("="), "g"), "prefix").alias("generation"))


_MONTHS = "gp as (select month, substr(document_id, 1, 4) as prefix, sha256(string_agg(sha256(document_id || chr(0) || export_key || chr(0) || canonical_url || chr(0) || title || chr(0) || content_hash), chr(10) order by document_id)) as g from articles group by all), gm as (select month, sha256(string_agg(prefix || '=' || g, chr(10) order by prefix)) as generation from gp group by month)"


@query("generation_ids", f"with {_NAMES}, {_PROJECT}, {_MONTHS} select * from gm")
def _q_generation(r: Relations) -> DataFrame:
    return generation_ids(project_articles(r))


@query("archive_generation", f"with {_NAMES}, {_PROJECT}, {_MONTHS} select sha256(string_agg(month || '=' || generation, chr(10) order by month)) as generation, cast(count(*) as bigint) as n_months from gm")
def _q_whole_generation(r: Relations) -> DataFrame:
    """One id for the archive: over its months' ids, a row each."""
    months = generation_ids(project_articles(r))
    return months.agg(_ordered_hash(F.concat("month", F.lit("="), "generation"), "month").alias("generation"), F.count(F.lit(1)).alias("n_months"))


SCHEMA_VERSION = "1.0.0"


def markdown_document(rows: DataFrame, body: str = "body_text") -> Column:
    """An article file: JSON-quoted front matter, the title on one line, and the body."""
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    at = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(quote(T.rfc3339(F.col(c))))
    fields = {
        "schema_version": quote(F.lit(SCHEMA_VERSION)), "document_id": quote(F.col("document_id")), "company_key": quote(F.col("export_key")), "company": quote(F.col("export_name")), "source_id": quote(F.col("source_id")),
        "canonical_url": quote(F.col("canonical_url")), "published_at": at("published_at"), "first_seen_at": at("created_at"), "fetched_at": at("fetched_at"), "content_hash": quote(F.col("content_hash")),
    }
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n# "), F.regexp_replace("title", "[\r\n]", " "), F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")), F.lit("\n"))


_STAMP = "case when {0} is null then 'null' else to_json(strftime({0}, '%Y-%m-%dT%H:%M:%S+00:00')) end"
_FILE = f"""'---' || chr(10) || 'schema_version: "{SCHEMA_VERSION}"' || chr(10) || 'document_id: ' || to_json(document_id) || chr(10) || 'company_key: ' || to_json(export_key) || chr(10) || 'company: ' || to_json(export_name) || chr(10)
    || 'source_id: ' || to_json(source_id) || chr(10) || 'canonical_url: ' || to_json(canonical_url) || chr(10) || 'published_at: ' || {_STAMP.format("published_at")} || chr(10) || 'first_seen_at: ' || {_STAMP.format("created_at")} || chr(10)
    || 'fetched_at: ' || {_STAMP.format("fetched_at")} || chr(10) || 'content_hash: ' || to_json(content_hash) || chr(10) || '---' || chr(10) || chr(10) || '# ' || regexp_replace(title, '[\r\n]', ' ', 'g') || chr(10) || chr(10) || coalesce(body_text, '') || chr(10)"""


@query("article_files", f"with {_NAMES}, {_PROJECT}, d as (select 'articles/v1/' || substr(sha256(export_key), 1, 2) || '/' || export_key || '/' || strftime(shown_at, '%Y') || '/' || strftime(shown_at, '%m') || '/' || substr(document_id, 1, 2) || '/' || document_id || '/article.md' as path, {_FILE} as doc from articles) select path, octet_length(encode(doc)) as bytes, sha256(doc) as sha256 from d")
def _q_files(r: Relations) -> DataFrame:
    """Rows are chosen narrow; their bodies join at the end."""
    rows = project_articles(r).join(r.feed_items.select("id", "body_text"), "id")
    doc = markdown_document(rows)
    return rows.select("path", F.octet_length(doc).cast("bigint").alias("bytes"), F.sha2(doc, 256).alias("sha256"))


def _json(fields: dict[str, Column]) -> Column:
    """A JSON object in the fields' order, nulls included."""
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def _record_path(path: Column) -> Column:
    return F.regexp_replace(path, "/article\\.md$", "/record.json")


def article_records(rows: DataFrame) -> DataFrame:
    """(document_id, month, record, line): an article's record file and its line of the index, as JSON.

    ``rows`` are projected articles with their url, summary and body_text. Times that the items don't have apart are
    those of their fetch.
    """
    doc = markdown_document(rows)
    at = lambda c: T.rfc3339(F.col(c))
    times = {"published_at": at("published_at"), "first_seen_at": at("created_at"), "fetched_at": at("fetched_at"), "last_updated_at": at("fetched_at")}
    sub = lambda **fields: F.struct(*(v.alias(k) for k, v in fields.items()))
    col, made = F.col, rows.withColumns({"__bytes": F.octet_length(doc).cast("bigint"), "__sha": F.sha2(doc, 256)})
    record = {
        "schema_version": F.lit(SCHEMA_VERSION), "document_id": col("document_id"), "company": sub(key=col("export_key"), name=col("export_name")), "source": sub(id=col("source_id"), kind=col("source_kind")),
        "urls": sub(observed=col("url"), canonical=col("canonical_url")), "title": col("title"), "summary": col("summary"), **times, "paths": sub(article=col("path"), record=_record_path(col("path"))),
        "content": sub(media_type=F.lit("text/markdown; charset=utf-8"), bytes=col("__bytes"), sha256=col("__sha"), normalized_content_hash=col("content_hash")), "provenance": sub(source_item_id=col("id"), external_id=col("external_id")),
    }
    line = {
        "schema_version": F.lit(SCHEMA_VERSION), "document_id": col("document_id"), "company_key": col("export_key"), "company_name": col("export_name"), "source_id": col("source_id"), "source_kind": col("source_kind"),
        "canonical_url": col("canonical_url"), "observed_url": col("url"), "title": col("title"), "summary": col("summary"), "body_text": col("body_text"), **times, "content_hash": col("content_hash"), "article_path": col("path"), "record_path": _record_path(col("path")),
    }
    return made.select("document_id", "month", _json(record).alias("record"), _json(line).alias("line"))


def _record_sql(then: str = " select document_id, month, sha256(cast({record} as varchar)) as record_sha256, sha256(cast({line} as varchar)) as line_sha256 from d") -> str:
    t = lambda c: f"case when {c} is null then null else strftime({c}, '%Y-%m-%dT%H:%M:%S+00:00') end"
    times = f"'published_at', {t('published_at')}, 'first_seen_at', {t('created_at')}, 'fetched_at', {t('fetched_at')}, 'last_updated_at', {t('fetched_at')}"
    record = f"""json_object('schema_version', '{SCHEMA_VERSION}', 'document_id', document_id, 'company', json_object('key', export_key, 'name', export_name), 'source', json_object('id', source_id, 'kind', source_kind), 'urls', json_object('observed', url, 'canonical', canonical_url),
        'title', title, 'summary', summary, {times}, 'paths', json_object('article', path, 'record', replace(path, '/article.md', '/record.json')), 'content', json_object('media_type', 'text/markdown; charset=utf-8', 'bytes', octet_length(encode(doc)), 'sha256', sha256(doc), 'normalized_content_hash', content_hash),
        'provenance', json_object('source_item_id', id, 'external_id', external_id))"""
    line = f"""json_object('schema_version', '{SCHEMA_VERSION}', 'document_id', document_id, 'company_key', export_key, 'company_name', export_name, 'source_id', source_id, 'source_kind', source_kind, 'canonical_url', canonical_url, 'observed_url', url, 'title', title, 'summary', summary,
        'body_text', body_text, {times}, 'content_hash', content_hash, 'article_path', path, 'record_path', replace(path, '/article.md', '/record.json'))"""
    return f"with {_NAMES}, {_PROJECT}, d as (select *, 'articles/v1/' || substr(sha256(export_key), 1, 2) || '/' || export_key || '/' || strftime(shown_at, '%Y') || '/' || strftime(shown_at, '%m') || '/' || substr(document_id, 1, 2) || '/' || document_id || '/article.md' as path, {_FILE} as doc from articles){then.format(record=record, line=line)}"


@query("article_records", _record_sql())
def _q_records(r: Relations) -> DataFrame:
    """Records and index lines; wide fields join the chosen rows."""
    rows = project_articles(r).join(r.feed_items.select("id", "url", "external_id", "summary", "body_text"), "id")
    return article_records(rows).select("document_id", "month", F.sha2("record", 256).alias("record_sha256"), F.sha2("line", 256).alias("line_sha256"))


def changed_files(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """(path, action) between two manifests of (path, sha256): what to write, and what to delete."""
    d, e = desired.alias("d"), existing.alias("e")
    j = d.join(e, "path", "full")
    action = F.when(F.col("d.sha256").isNull(), "delete").when(F.col("e.sha256").isNull(), "create").when(F.col("d.sha256") != F.col("e.sha256"), "replace")
    return j.select("path", action.alias("action")).filter("action is not null")


@query("changed_files", "with d as (select 'p/' || doc_id as path, content_hash as h from feed_items where doc_id % 3 <> 0), e as (select 'p/' || doc_id as path, case when doc_id % 5 = 0 then 'old' else content_hash end as h from feed_items where doc_id % 4 <> 0) select coalesce(d.path, e.path) as path, case when d.h is null then 'delete' when e.h is null then 'create' else 'replace' end as action from d full join e on d.path = e.path where d.h is null or e.h is null or d.h <> e.h")
def _q_changed(r: Relations) -> DataFrame:
    path = F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path")
    d = r.feed_items.filter("doc_id % 3 <> 0").select(path, F.col("content_hash").alias("sha256"))
    e = r.feed_items.filter("doc_id % 4 <> 0").select(path, F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("content_hash")).alias("sha256"))
    return changed_files(d, e)


def category_key(name: str | None) -> str:
    """A category's key: an ASCII slug of its name and the start of the name's hash."""
    import hashlib

    name = " ".join(unicodedata.normalize("NFC", name or "").split())
    if not name:
        return "uncategorized"
    plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    words = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in plain).split()
    return f"{('-'.join(words) or 'category')[:47].rstrip('-')}-{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def _category_keys(names: pd.Series) -> pd.Series:
    return names.map(category_key)


def category_keys(name: Column | str) -> Column:
    return F.pandas_udf(_category_keys, "string")(name)


@query("categories", "select lower(sector) || '-' || substr(sha256(sector), 1, 16) as category_key, sector as category_name, cast(count(*) as bigint) as n_companies from companies group by sector")
def _q_categories(r: Relations) -> DataFrame:
    """Keys are made once for each distinct name."""
    g = r.companies.groupBy("sector").agg(F.count(F.lit(1)).alias("n_companies"))
    return g.select(category_keys("sector").alias("category_key"), F.col("sector").alias("category_name"), "n_companies")


_TAXONOMY = f"""with {_NAMES}, {_PROJECT}, cats as (select distinct a.export_key, lower(k.sector) || '-' || substr(sha256(k.sector), 1, 16) as category_key, k.sector as category_name from articles a join companies k on k.company_id = a.company_id)"""


def company_categories(r: Relations) -> DataFrame:
    """(export_key, category_key, category_name) of the companies that have articles; keys are made once for each name."""
    named = r.companies.select(F.col("sector").alias("category_name")).distinct().withColumn("category_key", category_keys("category_name"))
    have = project_articles(r).select("company_id", "export_key").distinct().join(r.companies.select("company_id", F.col("sector").alias("category_name")), "company_id")
    return have.join(named, "category_name").select("export_key", "category_key", "category_name").distinct()


@query("taxonomy_generation", _TAXONOMY + " select sha256('company-news-data/taxonomy/v1' || chr(0) || string_agg(export_key || chr(0) || category_key || chr(0) || category_name || chr(10), '' order by export_key, category_key)) as generation, cast(count(*) as bigint) as n_companies from cats")
def _q_taxonomy(r: Relations) -> DataFrame:
    """One hash over all companies and their categories in key order. An import may bring 100,000 companies, which bounds the array."""
    rows = F.array_sort(F.collect_list(F.struct("export_key", "category_key", "category_name")))
    line = lambda x: F.concat(x["export_key"], F.lit(T.NUL), x["category_key"], F.lit(T.NUL), x["category_name"], F.lit("\n"))
    whole = F.concat(F.lit(f"company-news-data/taxonomy/v1{T.NUL}"), F.array_join(F.transform(rows, line), ""))
    return company_categories(r).agg(F.sha2(whole, 256).alias("generation"), F.count(F.lit(1)).alias("n_companies"))


@query("category_pages", _TAXONOMY + f", paged as (select *, (row_number() over (partition by category_key order by export_key) - 1) // {CATEGORY_PAGE} + 1 as page from cats) select category_key, page, cast(count(*) as bigint) as n_companies, min(export_key) as first_key, max(export_key) as last_key from paged group by all")
def _q_category_pages(r: Relations) -> DataFrame:
    """Pages of a hundred companies for each category, in key order."""
    place = F.row_number().over(Window.partitionBy("category_key").orderBy("export_key")) - 1
    paged = company_categories(r).withColumn("page", (F.floor(place / CATEGORY_PAGE) + 1).cast("bigint"))
    return paged.groupBy("category_key", "page").agg(F.count(F.lit(1)).alias("n_companies"), F.min("export_key").alias("first_key"), F.max("export_key").alias("last_key"))


@query("export_bookkeeping", f"with {_EXPORT} select id, content_hash, 1 as n_exports from exported")
def _q_book(r: Relations) -> DataFrame:
    return export_selection(r).groupBy("id").agg(F.first("content_hash").alias("content_hash"), F.count(F.lit(1)).cast("int").alias("n_exports"))


_RECORDS = """select 'p' || cast(doc_id % 40 as string) as document_id, case when doc_id % 13 = 0 then '../x/' || cast(doc_id as string) when doc_id % 17 = 0 then 'a//b' else 'articles/v1/' || cast(doc_id as string) || '/article.md' end as path,
    case when doc_id % 11 = 0 then 'Bad Key' when doc_id % 23 = 0 then '' else source_id end as company_key from feed_items where doc_id < 60"""


def invariants(records: DataFrame) -> DataFrame:
    """How many ids come twice, and how many paths and company keys an archive may not have."""
    twice = records.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_duplicate_ids"))
    bad = records.agg(F.count_if(~T.safe_path(F.col("path"))).alias("n_bad_paths"), F.count_if(~T.safe_company_key(F.col("company_key"))).alias("n_bad_keys"))
    return twice.join(F.broadcast(bad))


@query("archive_invariants", f"with r as ({_RECORDS}), t as (select document_id from r group by 1 having count(*) > 1) select (select count(*) from t) as n_duplicate_ids, cast(count(*) filter (where path like '%..%' or path like '%//%' or path like '/%' or path = '') as bigint) as n_bad_paths, cast(count(*) filter (where not regexp_full_match(company_key, '[a-z0-9]+(-[a-z0-9]+)*')) as bigint) as n_bad_keys from r")
def _q_invariants(r: Relations) -> DataFrame:
    """What an archive must satisfy, counted over records of which some break it."""
    return invariants(r.sql(_RECORDS))
