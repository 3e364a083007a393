"""Edits of the JSON that rows carry: evidence that a review sets, quarantine that a hydrated item sheds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.functions.edits import has_key, remove_key, set_key
from newsweft.plans.catalog import query
from newsweft.plans.relations import Relations

RELEASABLE = ("article_body_missing", "article_fetch_failed")


def release_quarantine(items: DataFrame) -> DataFrame:
    """``items`` (``processing``: variant, ``hydrated``, ``is_private``) after hydration: a reversible quarantine for a missing body goes.

    Where the item has its body now and ``quality_quarantine`` is reversible and for one of RELEASABLE, the key is
    removed, ``quality_released`` set to its reason and the item made public; everything else stays as it is.
    """
    p = F.col("processing")
    reason = F.try_variant_get(p, "$.quality_quarantine.reason", "string")
    free = F.col("hydrated") & has_key(p, ["quality_quarantine"]) & F.coalesce(F.try_variant_get(p, "$.quality_quarantine.reversible", "boolean"), F.lit(False)) & F.coalesce(reason.isin(*RELEASABLE), F.lit(False))
    edited = set_key(remove_key(p, ["quality_quarantine"]), ["quality_released"], F.parse_json(F.to_json(F.struct(reason.alias("reason")))))
    return items.withColumns({"released": free, "processing": F.when(free, edited).otherwise(p), "is_private": F.col("is_private") & ~free})


_PROCESSING = """select id, doc_id, is_private, doc_id % 3 <> 0 as hydrated, case doc_id % 5 when 0 then '{"k":' || doc_id || '}' when 4 then '[1]' else '{"k":' || doc_id || ',"quality_quarantine":{"reason":"' || case doc_id % 5 when 1 then 'article_body_missing' when 2 then 'topic' else 'article_fetch_failed' end || '","reversible":' || case when doc_id % 7 = 0 then 'false' else 'true' end || '}}' end as processing from feed_items"""


@query(
    "quarantine_release",
    f"with p as ({_PROCESSING}), f as (select *, hydrated and doc_id % 5 in (1, 3) and doc_id % 7 <> 0 as free from p) select id, free as released, is_private and not free as is_private, case when free then '{{\"k\":' || doc_id || ',\"quality_released\":{{\"reason\":\"' || case doc_id % 5 when 1 then 'article_body_missing' else 'article_fetch_failed' end || '\"}}}}' else processing end as processing from f",
)
def _q_release(r: Relations) -> DataFrame:
    items = r.sql(_PROCESSING).withColumn("processing", F.parse_json("processing"))
    return release_quarantine(items).select("id", "released", "is_private", F.to_json("processing").alias("processing"))




@query(
    "json_edits",
    f"""with p as ({_PROCESSING}) select id, json_exists(processing, '$.quality_quarantine.reason') as has_reason, case doc_id % 5 when 4 then '{{"review":{{"by":"' || id || '"}}}}' else json_merge_patch(processing, '{{"review":{{"by":"' || id || '"}}}}') end as reviewed,
        case when doc_id % 5 in (1, 2, 3) then json_merge_patch(processing, '{{"quality_quarantine":{{"reversible":null}}}}') else processing end as final from p""",
)
def _q_edits(r: Relations) -> DataFrame:
    """A key set two levels down, one removed, and a test of one; arrays become objects where a key is set."""
    p = F.parse_json("processing")
    by = F.parse_json(F.to_json(F.struct(F.col("id").alias("x"))))
    reviewed = set_key(p, ["review", "by"], F.variant_get(by, "$.x", "variant"))
    rows = r.sql(_PROCESSING).select("id", has_key(p, ["quality_quarantine", "reason"]).alias("has_reason"), F.to_json(reviewed).alias("reviewed"), F.to_json(remove_key(p, ["quality_quarantine", "reversible"])).alias("final"))
    return rows
