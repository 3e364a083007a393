"""RSS and Atom documents as rows of items: parsed in an Arrow pass, keyed and bounded by columns."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.functions import text as T
from newsweft.functions import urls as U

ENTRY = "struct<pos:int,entry_id:string,link:string,title:string,summary:string,content:string,published:string,updated:string>"
FEED = f"struct<kind:string,title:string,error:string,entries:array<{ENTRY}>>"

_CONTENT = "{http://purl.org/rss/1.0/modules/content/}encoded"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _inner(node: ET.Element | None) -> str | None:
    if node is None:
        return None
    if len(node):
        return (node.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in node)
    return node.text


def parse(document: str | None) -> dict:
    """kind, title and entries of an RSS 0.9x, 1.0, 2.0 or Atom document; an error for anything else, JSON Feed too."""
    failed = {"kind": None, "title": None, "entries": []}
    try:
        root = ET.fromstring((document or "").strip().encode("utf-8", "replace"))
    except ET.ParseError as e:
        return failed | {"error": f"invalid feed: {e}"}
    kind = {"rss": "rss", "rdf": "rss", "feed": "atom"}.get(_local(root.tag))
    if kind is None:
        return failed | {"error": f"not a feed: {_local(root.tag)}"}
    channel = next((c for c in root if _local(c.tag) == "channel"), root)
    title = next((_inner(c) for c in channel if _local(c.tag) == "title"), None)
    entries = []
    for node in (n for n in root.iter() if _local(n.tag) in ("item", "entry")):
        parts = {_local(c.tag): c for c in reversed(list(node))}
        if kind == "atom":
            link = next((c.get("href") for c in node if _local(c.tag) == "link" and c.get("rel", "alternate") == "alternate"), None)
            content = _inner(parts.get("content"))
        else:
            link, content = (_inner(parts.get("link")) or "").strip() or None, _inner(next((c for c in node if c.tag == _CONTENT), None))
        one = lambda *names: next((v.strip() for n in names if (v := _inner(parts.get(n)))), None)  # noqa: B023, E731
        entries.append(
            {"pos": len(entries), "entry_id": one("guid", "id"), "link": link, "title": one("title"), "summary": one("description", "summary"), "content": content, "published": one("pubdate", "published", "date"), "updated": one("updated")}
        )
    return {"kind": kind, "title": title, "error": None, "entries": entries}


def _parse(document: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(d) for d in document], columns=["kind", "title", "error", "entries"])


def parsed(document: Column | str) -> Column:
    return F.pandas_udf(_parse, FEED)(document)


def feed_items(feeds: DataFrame, most: int = 200, as_of: Column | None = None) -> DataFrame:
    """Raw items of (feed_url, body) rows: at most ``most`` entries of each feed, in feed order; entries without a public URL are left out.

    The link gives way to an id that is a URL, the publication date to the update, the content to the summary.
    """
    p = feeds.withColumn("p", parsed("body")).filter("p.error is null")
    rows = p.select("feed_url", F.col("p.kind").alias("kind"), F.explode("p.entries").alias("e")).filter(F.col("e.pos") < most)
    url = F.when(U.is_public(F.col("e.link")), F.col("e.link")).when(U.is_public(F.col("e.entry_id")), F.col("e.entry_id"))
    made = rows.withColumns({"url": url}).filter("url is not null")
    ext = F.when(F.trim(F.coalesce("e.entry_id", F.lit(""))) == "", F.col("url")).otherwise(F.trim("e.entry_id"))
    body = F.coalesce("e.content", "e.summary")
    return made.select(
        "feed_url", "kind", F.col("e.pos").alias("pos"), "url", ext.alias("external_id"), T.item_key(F.col("feed_url"), ext).alias("item_key"), T.collapse(F.col("e.title")).alias("title"), F.col("e.summary").alias("summary_html"), body.alias("body_html"),
        F.coalesce(T.parse_datetime(F.col("e.published"), as_of), T.parse_datetime(F.col("e.updated"), as_of)).alias("published_at"),
    )


def feed_report(feeds: DataFrame, most: int = 200) -> DataFrame:
    """(feed_url, kind, title, total_entries, limited_to, error) of each document."""
    p = feeds.withColumn("p", parsed("body"))
    return p.select("feed_url", "p.kind", "p.title", F.size("p.entries").alias("total_entries"), F.lit(most).alias("limited_to"), "p.error")
