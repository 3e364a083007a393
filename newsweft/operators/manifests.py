"""The archive as a tree of files whose hashes hold those below them: shards, months, root and HEAD; its differences and its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import text as T
from newsweft.operators import archive as A
from newsweft.plans.catalog import query
from newsweft.plans.relations import Relations
from newsweft.session import written

BASE = "index/v1/current"
_SHARD = "prefix string, path string, record_count bigint, byte_count bigint, sha256 string"
_MONTH = "partition string, manifest_path string, record_count bigint, shard_count bigint, byte_count bigint, sha256 string"


def _prefixed(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def _month_path(month: Column, rest: Column) -> Column:
    return F.concat(F.lit(f"{BASE}/by-month/"), F.replace(month, F.lit("-"), F.lit("/")), F.lit("/"), rest)


def with_shards(lines: DataFrame, records: int, size: int) -> DataFrame:
    """``lines`` (month, document_id, line, ...) with the ``prefix`` of the shard that each belongs to.

    Shards are sought for once for each eight-digit id prefix, by equality on its nine beginnings; lines then meet their
    shard by that prefix and nothing but the line itself is moved.
    """
    sized = lines.select("month", "document_id", (F.octet_length("line") + 1).cast("bigint").alias("bytes"))
    found = A.shards(sized, records, size).select("month", "prefix")
    full = F.substring("document_id", 1, A.DEEPEST_PREFIX).alias("full")
    each = sized.select("month", full).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(A.DEEPEST_PREFIX)))).select("month", "full", F.substr("full", F.lit(1), F.col("k")).alias("prefix"))
    place = each.hint("merge").join(found, ["month", "prefix"])
    return lines.withColumn("full", full).join(place, ["month", "full"]).drop("full")


def shard_files(lines: DataFrame, records: int = A.SHARD_RECORDS, size: int = A.SHARD_BYTES) -> DataFrame:
    """(month, prefix, path, content, record_count, byte_count, sha256, companies): each shard's lines in order of their ids.

    A shard is at most ``records`` lines or ``size`` bytes, or one longer line, so that it can be one value.
    """
    rows = F.array_sort(F.collect_list(F.struct("document_id", "line")))
    made = with_shards(lines, records, size).groupBy("month", "prefix").agg(rows.alias("rows"))
    content = F.concat(F.array_join(F.transform("rows", lambda x: x["line"]), "\n"), F.lit("\n"))
    path = _month_path(F.col("month"), F.concat(F.lit("shards/"), F.when(F.col("prefix") == "", "root").otherwise(F.col("prefix")), F.lit(".jsonl")))
    out = made.select("month", "prefix", path.alias("path"), content.alias("content"), F.size("rows").cast("bigint").alias("record_count"))
    return out.withColumns({"byte_count": F.octet_length("content").cast("bigint"), "sha256": _prefixed(F.col("content"))})


def month_digests(shards: DataFrame) -> DataFrame:
    """(month, digest): a hash over the prefixes and hashes of a month's shards; equal digests mean equal months."""
    return shards.groupBy("month").agg(A._ordered_hash(F.concat("prefix", F.lit("="), "sha256"), "prefix").alias("digest"))


def generation_of(digests: DataFrame) -> DataFrame:
    """One row, ``generation``: the hash over all months' digests, which is that of the whole archive."""
    return digests.agg(A._ordered_hash(F.concat("month", F.lit("="), "digest"), "month").alias("generation"))


def archive_tree(lines: DataFrame, records: int = A.SHARD_RECORDS, size: int = A.SHARD_BYTES) -> DataFrame:
    """(path, content) of the index: shards, a manifest for each month, the root manifest and HEAD.json.

    ``lines`` has month, document_id, company_key and line, each document once. A month's manifest holds the hashes of
    its shards, the root those of the months, and all of them the generation, which the shards alone decide. A month's
    manifest is one value: a line of some 150 bytes for each MiB of articles. An empty archive has a root and a HEAD.
    """
    files = written(shard_files(lines, records, size), "shards")
    digests = month_digests(files)
    generation = F.broadcast(written(generation_of(digests), "generation"))  # one row
    n = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c)
    entries = F.array_sort(F.collect_list(F.struct("prefix", "path", "record_count", "byte_count", "sha256")))
    months = files.groupBy("month").agg(n("record_count"), F.count(F.lit(1)).alias("shard_count"), n("byte_count"), entries.alias("shards")).crossJoin(generation)
    manifest = F.to_json(F.struct(F.lit(A.SCHEMA_VERSION).alias("schema_version"), "generation", F.col("month").alias("partition"), "record_count", "shard_count", "byte_count", "shards"))
    months = months.select("month", "record_count", "shard_count", "byte_count", _month_path(F.col("month"), F.lit("manifest.json")).alias("path"), manifest.alias("content"))
    months = written(months, "months")
    companies = lines.agg(F.count_distinct("company_key").alias("company_count"))
    below = F.struct(F.col("month").alias("partition"), F.col("path").alias("manifest_path"), "record_count", "shard_count", "byte_count", _prefixed(F.col("content")).alias("sha256"))
    whole = months.agg(n("record_count"), F.array_sort(F.collect_list(below)).alias("partitions")).crossJoin(companies).crossJoin(generation)
    root = F.to_json(F.struct(F.lit(A.SCHEMA_VERSION).alias("schema_version"), "generation", "record_count", "company_count", "partitions"))
    head = F.to_json(F.struct(F.lit(A.SCHEMA_VERSION).alias("schema_version"), "generation", F.lit(f"{BASE}/manifest.json").alias("manifest_path"), "record_count", "company_count"))
    top = whole.select(F.explode(F.array(F.struct(F.lit(f"{BASE}/manifest.json").alias("path"), root.alias("content")), F.struct(F.lit("HEAD.json").alias("path"), head.alias("content")))).alias("f")).select("f.*")
    return files.select("path", "content").unionByName(months.select("path", "content")).unionByName(top)


def generation_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(month, prefix, action) between two archives' shards (month, prefix, sha256): ``create``, ``replace`` or ``delete``.

    Only shards of months whose digests differ are compared; the months' list, one row a month, decides which are read.
    """
    a, b = month_digests(old).withColumnRenamed("digest", "was"), month_digests(new).withColumnRenamed("digest", "now")
    changed = F.broadcast(a.join(b, "month", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("month"))
    pick = lambda s, name: s.join(changed, "month", "left_semi").select("month", "prefix", F.col("sha256").alias(name))
    both = pick(old, "was").join(pick(new, "now"), ["month", "prefix"], "full")
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull(), "create").when(F.col("was") != F.col("now"), "replace")
    return both.select("month", "prefix", action.alias("action")).where("action is not null")


RULES = (
    "partition_digest", "partition_generation", "partition_missing", "shard_missing", "shard_unlisted", "shard_byte_count", "shard_digest", "shard_final_newline", "shard_record_count", "line_order", "line_prefix",
    "duplicate_document", "partition_record_count", "partition_shard_count", "partition_byte_count", "root_partition_counts", "root_record_count", "root_company_count", "head_generation", "head_counts", "head_path",
)


def validate(tree: DataFrame) -> DataFrame:
    """(rule, n) for each of RULES: how many files, lines or documents of (path, content) break it.

    Files are checked where they lie: each shard by itself, each month's manifest against its shards by joins on their
    paths, documents by one count over all lines. Digests, sizes, counts, order, prefixes, generations and coverage are
    computed from what the files hold, never taken from a manifest.
    """
    tree = tree.select("path", "content")
    shard = tree.where(F.col("path").like(f"{BASE}/by-month/%/shards/%.jsonl"))
    lines = F.filter(F.split("content", "\n"), lambda x: x != "")
    ids = F.transform(lines, lambda x: F.get_json_object(x, "$.document_id"))
    held = shard.select("path", F.octet_length("content").cast("bigint").alias("bytes"), _prefixed(F.col("content")).alias("hash"), (~F.endswith("content", F.lit("\n")) & (F.col("content") != "")).alias("unended"), ids.alias("ids"), F.transform(lines, lambda x: F.get_json_object(x, "$.company_key")).alias("companies"))
    held = written(held, "held")
    months = tree.where(F.col("path").rlike(rf"^{BASE}/by-month/\d+/\d+/manifest\.json$"))
    month = F.from_json("content", f"generation string, partition string, record_count bigint, shard_count bigint, byte_count bigint, shards array<struct<{_SHARD.replace(' ', ':').replace(',:', ',')}>>")
    months = written(months.select("path", _prefixed(F.col("content")).alias("hash"), month.alias("m")).select("path", "hash", "m.*"), "manifests")
    root = tree.where(F.col("path") == f"{BASE}/manifest.json").select(F.from_json("content", f"generation string, record_count bigint, company_count bigint, partitions array<struct<{_MONTH.replace(' ', ':').replace(',:', ',')}>>").alias("r")).select("r.*")
    head = tree.where(F.col("path") == "HEAD.json").select(F.from_json("content", "generation string, manifest_path string, record_count bigint, company_count bigint").alias("h")).select("h.*")

    listed = months.select(F.explode("shards").alias("s"), F.col("path").alias("of")).select("of", F.col("s.path").alias("path"), F.struct("s.prefix", "s.record_count", "s.byte_count", "s.sha256").alias("s"))
    met = listed.join(held, "path", "full")
    there, known = F.col("hash").isNotNull(), F.col("s").isNotNull()
    both = there & known
    misplaced = F.transform("ids", lambda x, i: ((i > 0) & (x <= F.get("ids", i - 1))).cast("int"))
    total = lambda flags: F.coalesce(F.sum(F.aggregate(flags, F.lit(0), lambda a, x: a + x)), F.lit(0))
    strayed = F.transform("ids", lambda x: (~F.startswith(x, F.col("s.prefix"))).cast("int"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of_shards = met.agg(
        count(known & ~there).alias("shard_missing"), count(there & ~known).alias("shard_unlisted"), count(both & (F.col("bytes") != F.col("s.byte_count"))).alias("shard_byte_count"), count(both & (F.col("hash") != F.col("s.sha256"))).alias("shard_digest"),
        count(F.col("unended")).alias("shard_final_newline"), count(both & (F.size("ids") != F.col("s.record_count"))).alias("shard_record_count"), total(misplaced).alias("line_order"), total(F.when(both, strayed)).alias("line_prefix"),
    )
    documents = held.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(count(F.col("n") > 1).alias("duplicate_document"))
    of = met.where(known).groupBy("of").agg(F.sum(F.when(there, F.size("ids")).otherwise(0)).alias("lines"), F.count(F.lit(1)).alias("shards_listed"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes_held")).withColumnRenamed("of", "path")
    generation = F.broadcast(head.select(F.col("generation").alias("head_generation")).limit(1))
    of_months = months.join(of, "path", "left").crossJoin(generation).agg(
        count(F.col("generation") != F.col("head_generation")).alias("partition_generation"), count(F.coalesce("lines", F.lit(0)) != F.col("record_count")).alias("partition_record_count"),
        count(F.coalesce("shards_listed", F.lit(0)) != F.col("shard_count")).alias("partition_shard_count"), count(F.coalesce("bytes_held", F.lit(0)) != F.col("byte_count")).alias("partition_byte_count"),
    )
    refs = root.select(F.explode("partitions").alias("p")).select(F.col("p.manifest_path").alias("path"), F.struct("p.record_count", "p.shard_count", "p.byte_count", "p.sha256").alias("p")).join(months, "path", "left")
    of_refs = refs.agg(
        count(F.col("hash").isNull()).alias("partition_missing"), count(F.col("hash") != F.col("p.sha256")).alias("partition_digest"),
        count((F.col("p.record_count") != F.col("record_count")) | (F.col("p.shard_count") != F.col("shard_count")) | (F.col("p.byte_count") != F.col("byte_count"))).alias("root_partition_counts"),
    )
    records = held.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("records"))
    companies = held.select(F.explode("companies").alias("c")).agg(F.count_distinct("c").alias("companies"))
    tops = root.select(F.col("generation").alias("g"), F.col("record_count").alias("rc"), F.col("company_count").alias("cc")).crossJoin(head).crossJoin(records).crossJoin(companies)
    of_top = tops.agg(
        count(F.col("rc") != F.col("records")).alias("root_record_count"), count(F.col("cc") != F.col("companies")).alias("root_company_count"), count(F.col("g") != F.col("generation")).alias("head_generation"),
        count((F.col("record_count") != F.col("records")) | (F.col("company_count") != F.col("companies"))).alias("head_counts"), count(F.col("manifest_path") != f"{BASE}/manifest.json").alias("head_path"),
    )
    row = reduce(lambda x, y: x.crossJoin(y), [of_shards, documents, of_months, of_refs, of_top])  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).cast("bigint").alias("n")) for rule in RULES])).alias("x")).select("x.*")


def kept_path(previous: Column, document_id: Column, path: Column) -> Column:
    """An article stays where an earlier export put it, if that is a safe path of its own id; else ``path``."""
    own = F.startswith(previous, F.lit("articles/v1/")) & F.endswith(previous, F.concat(F.lit("/"), document_id, F.lit("/article.md"))) & T.safe_path(previous)
    return F.when(F.coalesce(own, F.lit(False)), previous).otherwise(path)


# Queries, with bounds small enough for several shards here

RECORDS, SIZE = 40, 64 << 10


def index_lines(r: Relations) -> DataFrame:
    rows = A.project_articles(r).join(r.feed_items.select("id", "url", "external_id", "summary", "body_text"), "id")
    lines = A.article_records(rows.withColumn("month", F.col("month"))).select("document_id", "month", "line")
    return written(lines.withColumn("company_key", F.get_json_object("line", "$.company_key")), "lines")


_LINES = A._record_sql(", lines as (select month, document_id, export_key as company_key, cast({line} as varchar) as line, octet_length(encode(cast({line} as varchar))) + 1 as bytes from d)")
_FILES = f"""p as (select month, substr(document_id, 1, k) as prefix, k, count(*) as n, sum(bytes) as b from {{0}}, range(0, 9) t(k) group by all), s as (select *, (n > {RECORDS} or b > {SIZE}) and k < 8 and n > 1 as split from p),
    found as (select s.month, s.prefix from s left join s u on u.month = s.month and u.k = s.k - 1 and u.prefix = substr(s.prefix, 1, s.k - 1) where not s.split and (s.k = 0 or u.split)),
    placed as (select l.*, f.prefix from {{0}} l join found f on f.month = l.month and starts_with(l.document_id, f.prefix)),
    files as (select month, prefix, '{BASE}/by-month/' || replace(month, '-', '/') || '/shards/' || case when prefix = '' then 'root' else prefix end || '.jsonl' as path, string_agg(line || chr(10), '' order by document_id) as content, count(*) as record_count from placed group by month, prefix),
    shards as (select *, octet_length(encode(content)) as byte_count, 'sha256:' || sha256(content) as sha256 from files),
    digests as (select month, sha256(string_agg(prefix || '=' || sha256, chr(10) order by prefix)) as digest from shards group by month)"""
_TREE = f"""gen as (select sha256(string_agg(month || '=' || digest, chr(10) order by month)) as generation from digests),
    months as (select month, '{BASE}/by-month/' || replace(month, '-', '/') || '/manifest.json' as path, sum(record_count) as record_count, count(*) as shard_count, sum(byte_count) as byte_count, '{{{{"schema_version":"{A.SCHEMA_VERSION}","generation":"' || any_value(generation) || '","partition":"' || month || '","record_count":' || sum(record_count)
        || ',"shard_count":' || count(*) || ',"byte_count":' || sum(byte_count) || ',"shards":[' || string_agg('{{{{"prefix":"' || prefix || '","path":"' || path || '","record_count":' || record_count || ',"byte_count":' || byte_count || ',"sha256":"' || sha256 || '"}}}}', ',' order by prefix) || ']}}}}' as content from shards, gen group by month),
    root as (select '{BASE}/manifest.json' as path, '{{{{"schema_version":"{A.SCHEMA_VERSION}","generation":"' || any_value(generation) || '","record_count":' || sum(record_count) || ',"company_count":' || any_value(n) || ',"partitions":[' || string_agg('{{{{"partition":"' || month || '","manifest_path":"' || path
        || '","record_count":' || record_count || ',"shard_count":' || shard_count || ',"byte_count":' || byte_count || ',"sha256":"sha256:' || sha256(content) || '"}}}}', ',' order by month) || ']}}}}' as content, sum(record_count) as record_count, any_value(n) as company_count, any_value(generation) as generation from months, gen, (select count(distinct company_key) as n from lines)),
    head as (select '{{{{"schema_version":"{A.SCHEMA_VERSION}","generation":"' || generation || '","manifest_path":"' || path || '","record_count":' || record_count || ',"company_count":' || company_count || '}}}}' as content from root)""".replace("{{", "{").replace("}}", "}")


@query("archive_manifests", f"{_LINES}, {_FILES.format('lines')}, {_TREE} select path, cast(octet_length(encode(content)) as bigint) as byte_count, sha256(content) as sha256 from (select path, content from shards union all select path, content from months union all select path, content from root union all select 'HEAD.json', content from head)")
def _q_manifests(r: Relations) -> DataFrame:
    """Every file of the index with its size and hash."""
    return archive_tree(index_lines(r), RECORDS, SIZE).select("path", F.octet_length("content").cast("bigint").alias("byte_count"), F.sha2("content", 256).alias("sha256"))


@query("archive_head", f"{_LINES}, {_FILES.format('lines')}, {_TREE} select generation, cast(record_count as bigint) as record_count, cast(company_count as bigint) as company_count, path as manifest_path from root")
def _q_head(r: Relations) -> DataFrame:
    head = archive_tree(index_lines(r), RECORDS, SIZE).where(F.col("path") == "HEAD.json")
    return head.select(F.from_json("content", "generation string, record_count bigint, company_count bigint, manifest_path string").alias("h")).select("h.*")


_OLDER = "select * from lines where right(document_id, 1) <> '0' or substr(month, 7, 1) = '3'"


@query(
    "generation_diff",
    f"{_LINES}, {_FILES.format('lines')}, now as (select month, prefix, sha256 from shards) select coalesce(n.month, o.month) as month, coalesce(n.prefix, o.prefix) as prefix, case when n.sha256 is null then 'delete' when o.sha256 is null then 'create' else 'replace' end as action from now n full join (with {_FILES.format(f'({_OLDER})')} select month, prefix, sha256 from shards) o on n.month = o.month and n.prefix = o.prefix where n.sha256 is distinct from o.sha256",
)
def _q_diff(r: Relations) -> DataFrame:
    """Against an earlier archive that lacked some documents of some months."""
    lines = index_lines(r)
    earlier = lines.where((F.substring("document_id", -1, 1) != "0") | (F.substring("month", 7, 1) == "3"))
    made = lambda rows, name: written(shard_files(rows, RECORDS, SIZE).select("month", "prefix", "sha256"), name)
    return generation_diff(made(earlier, "earlier"), made(lines, "later"))


@query(
    "sticky_article_paths",
    f"with {A._NAMES}, {A._PROJECT}, d as (select id, doc_id, document_id, 'articles/v1/' || substr(sha256(export_key), 1, 2) || '/' || export_key || '/' || strftime(shown_at, '%Y') || '/' || strftime(shown_at, '%m') || '/' || substr(document_id, 1, 2) || '/' || document_id || '/article.md' as path from articles) select document_id, case when doc_id % 4 = 0 then 'articles/v1/old/' || document_id || '/article.md' else path end as path, doc_id % 4 = 0 as kept from d",
)
def _q_sticky(r: Relations) -> DataFrame:
    """Some articles were exported before, of those some under another id or outside the archive."""
    rows = A.project_articles(r).join(r.feed_items.select("id", "doc_id"), "id")
    n = F.col("doc_id") % 4
    before = F.when(n == 0, F.concat(F.lit("articles/v1/old/"), "document_id", F.lit("/article.md"))).when(n == 1, F.lit("articles/v1/old/other/article.md")).when(n == 2, F.concat(F.lit("articles/v1/../"), "document_id", F.lit("/article.md")))
    path = kept_path(before, F.col("document_id"), F.col("path"))
    return rows.select("document_id", path.alias("path"), path.eqNullSafe(before).alias("kept"))


_DAMAGED = f"""{_LINES}, {_FILES.format('lines')}, {_TREE}, bad as (select month, byte_count % 5 = 0 as cut, byte_count % 5 = 1 as renamed, record_count from shards),
    names as (select distinct case when f.byte_count % 5 = 1 then 'x' else '' end || l.company_key as c from placed l join shards f on f.month = l.month and f.prefix = l.prefix), counts as (select (select count(*) from names) <> company_count as other from root)
    select rule, cast(case rule when 'shard_byte_count' then (select count(*) from bad where cut or renamed) when 'shard_digest' then (select count(*) from bad where cut or renamed) when 'shard_final_newline' then (select count(*) from bad where cut)
        when 'partition_byte_count' then (select count(*) from (select month from bad group by month having sum(case when cut then -1 when renamed then record_count else 0 end) <> 0)) when 'root_company_count' then (select count(*) from counts where other) when 'head_counts' then (select count(*) from counts where other) else 0 end as bigint) as n from (select unnest({list(RULES)}) as rule)"""


@query("archive_validation", _DAMAGED)
def _q_validation(r: Relations) -> DataFrame:
    """The validator over an archive of which some shards lost their last line end and others name other companies."""
    tree = archive_tree(index_lines(r), RECORDS, SIZE)
    n = F.when(F.col("path").endswith(".jsonl"), F.octet_length("content") % 5)
    harmed = F.when(n == 0, F.regexp_replace("content", "\n$", "")).when(n == 1, F.replace(F.col("content"), F.lit('"company_key":"'), F.lit('"company_key":"x'))).otherwise(F.col("content"))
    return validate(tree.select("path", harmed.alias("content")))
