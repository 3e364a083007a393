"""Accept and reject pairs for the record functions."""

from __future__ import annotations

import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsweft.functions import html as H
from newsweft.functions import text as T
from newsweft.functions import urls as U
from newsweft.sources import feeds, universe


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    "url, key",
    [
        ("https://www.Example.com/A/b/?q=1#x", "example.com/A/b?q=1"),
        ("HTTP://example.com/", "example.com"),
        ("example.com/a//", "example.com/a"),
        (None, None),
    ],
)
def test_identity(spark, url, key):
    assert one(spark, U.identity_key(F.col("u")), u=url) == key


@pytest.mark.parametrize(
    "url, canonical",
    [
        ("https://a.b.org/x?utm_source=f&id=7#z", "https://a.b.org/x?id=7"),
        ("https://a.b.org/x?ID=7&id=7&post=2", "https://a.b.org/x?id=7&post=2"),
        ("https://a.b.org/x?id=%20", "https://a.b.org/x"),
        ("https://a.b.org/x?id=1&id=2&id=3&id=4&id=5", "https://a.b.org/x"),
    ],
)
def test_canonical(spark, url, canonical):
    assert one(spark, U.canonical(F.col("u")), u=url) == canonical


def test_invalid_resource(spark):
    assert one(spark, U.has_invalid_resource(F.col("u")), u="https://a.b/x?id=") is True
    assert one(spark, U.has_invalid_resource(F.col("u")), u="https://a.b/x?id=4") is False
    assert one(spark, U.has_invalid_resource(F.col("u")), u="https://a.b/x?page=") is False


@pytest.mark.parametrize("url, is_", [("https://a.b/sitemap.xml", True), ("https://a.b/x?f=sitemaps", True), ("https://a.b/sitemapping", False)])
def test_sitemap(spark, url, is_):
    assert one(spark, U.is_sitemap(F.col("u")), u=url) is is_


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.a.com/en-US/news/?x=1", "https://a.com/news"),
        ("https://a.com/en", "https://a.com/en"),
        ("https://a.com", "https://a.com/"),
    ],
)
def test_publication_identity(spark, url, key):
    assert one(spark, U.publication_identity(F.col("u")), u=url) == key


@pytest.mark.parametrize("url, key", [("https://www.A.com/News/index.html", "a.com/news"), ("https://a.com:8080/x?id=3", "a.com:8080/x?id=3"), ("https://a.com/index.php?id=3", "a.com/index.php?id=3")])
def test_publication_resource(spark, url, key):
    assert one(spark, U.publication_resource(F.col("u")), u=url) == key


@pytest.mark.parametrize("address, public", [("8.8.8.8", True), ("10.0.0.1", False), ("100.64.0.1", False), ("172.31.0.1", False), ("192.0.2.9", False), ("224.0.0.1", False), ("1.2.3", False), ("300.1.1.1", False)])
def test_public_ip(spark, address, public):
    assert one(spark, U.is_public_ipv4(F.col("a")), a=address) is public


@pytest.mark.parametrize("url, public", [("https://a.org/x", True), ("ftp://a.org", False), ("https://u:p@a.org", False), ("https://example.com/x", False), ("https://localhost/x", False)])
def test_public_url(spark, url, public):
    assert one(spark, U.is_public(F.col("u")), u=url) is public


def test_paths(spark):
    assert one(spark, U.is_listing_path(F.col("u")), u="https://a.b/news/2024") is True
    assert one(spark, U.is_article_path(F.col("u")), u="https://a.b/news/2024/03/we-launch-a-new-thing") is True
    assert one(spark, U.is_article_path(F.col("u")), u="https://a.b/news") is False
    assert one(spark, U.stable_publication(F.col("u")), u="https://a.b/news/2024/page/3?x") == "https://a.b/news"
    assert one(spark, U.publication_root(F.col("u")), u="https://a.b/en/News/x/y") == "https://a.b/en/News"
    assert one(spark, U.common_prefix(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("a"), F.lit("b"))), u=1) == "/a/b"
    assert one(spark, U.repaired_canonical(F.col("c"), F.col("p")), c="https://a.b/https://c.d/e", p="https://a.b/x") == "https://c.d/e"
    assert one(spark, U.upgraded_redirect(F.col("p"), F.col("t")), p="https://a.b/x", t="http://www.a.b/y") == "https://www.a.b/y"


@pytest.mark.parametrize(
    "text, at",
    [
        ("2024-03-05T10:00:00+02:00", "2024-03-05 08:00:00"),
        ("Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05 10:00:00"),
        ("Mar. 5, 2024", "2024-03-05 00:00:00"),
        ("05.03.2024", "2024-03-05 00:00:00"),
        ("1971-01-01", None),
        ("soon", None),
        (None, None),
    ],
)
def test_datetimes(spark, text, at):
    found = one(spark, T.parse_datetime(F.col("t")).cast("string"), t=text)
    assert found == at


def test_titles(spark):
    assert one(spark, T.normal_title(F.col("t")), t=" A   b self.__wrap_n!=1 ") == "A b"
    assert one(spark, T.usable_title(F.col("t")), t="Quarterly results are in") is True
    for bad in ("News", "Page 3 of 9", "03/05/2024", "", ".cls-1{fill:red;}", "Four", "1234567", "N e w s a", "x" * 301):
        assert one(spark, T.usable_title(F.col("t")), t=bad) is False
    assert one(spark, T.decorated_variants(F.col("a"), F.col("b")), a="Big launch | Acme", b="big  launch") is True
    for a, b in (("Big launch", "Small launch"), ("Acme: Big launch", "Big launch"), ("Big launch | ", "Big launch"), ("Big launch", "Big launch - ")):
        assert one(spark, T.decorated_variants(F.col("a"), F.col("b")), a=a, b=b) is False
    assert one(spark, T.title_agrees_with_path(F.col("a"), F.col("b")), a="Acme opens new factory", b="/news/acme-opens-factory") is True


def test_names(spark):
    assert one(spark, T.search_name(F.col("n")), n="Alphabet Inc. Class A Common Stock") == "Alphabet"
    assert one(spark, T.legal_base(F.col("n")), n="Alphabet Inc. Class A Common Stock") == "Alphabet Inc."
    assert one(spark, T.safe_path(F.col("p")), p="a/b/c.md") is True
    assert one(spark, T.safe_path(F.col("p")), p="a/../c.md") is False
    assert one(spark, T.truncate_error(F.col("e"), 5), e="abcdé") == "abcd"
    assert one(spark, T.ratio_bps(F.lit(3), F.lit(2)), e=1) == 10000
    assert one(spark, T.backoff(F.lit(9)), e=1) == 3600
    from newsweft.operators.archive import category_key

    assert category_key(None) == "uncategorized" and category_key("Café  Été").startswith("cafe-ete-") and len(category_key("x" * 99)) == 64


PAGE = """<html><head><title>Notes</title><style>p{color:red}</style></head><body><main id="m" class="wide"><aside>see also</aside><h2 onmouseover="go()">Harbour opens</h2>
<p>The <em>new</em> quay, <a href="../plans.html" target="_blank">as planned</a>, took <b>three</b> years.</p><p><a href="vbscript:go()">odd link</a></p><script>var a = "<b>";</script>
<ol><li>dredging</li><li>piles</li></ol><ul><li>cranes</li></ul><pre>a  b</pre><blockquote>We are glad</blockquote></main></body></html>"""


def test_sanitise():
    clean, n = H.sanitise(PAGE, "https://port.test.org/news/today.html")
    assert "<h2>Harbour opens</h2>" in clean and 'href="https://port.test.org/plans.html"' in clean
    assert not any(x in clean for x in ("onmouseover", "vbscript", "see also", "<script", "color:red", "wide", "target"))
    assert n["link_count"] == 1 and n["stripped_elements"] >= 3


def test_markdown():
    p = H.process(PAGE, "https://port.test.org/news/today.html")
    for part in ("## Harbour opens", "**three**", "[as planned](https://port.test.org/plans.html)", "1. dredging\n2. piles", "- cranes", "> We are glad", "```text\na  b\n```"):
        assert part in p["markdown"], p["markdown"]
    assert "Harbour opens" in p["text"] and "took three years." in p["text"]


def test_images_are_opt_in():
    source = "<p>Before</p><p><img alt='A crane' src='pics/crane.jpg'></p>"
    assert "img" not in H.sanitise(source, "https://port.test.org/a/b")[0]
    assert "![A crane](https://port.test.org/a/pics/crane.jpg)" in H.process(source, "https://port.test.org/a/b", True)["markdown"]


def test_markdown_time_grows_with_the_page():
    took = []
    for n in (4000, 16000):
        page = "<p>short</p>" * n
        began = time.perf_counter()
        H.markdown(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * max(took[0], 0.02)


def test_pages_above_the_bound_say_so(spark):
    rows = spark.createDataFrame([(1, "x" * (H.MOST_BYTES + 1)), (2, "<p>fine</p>"), (3, None)], "id int, html string")
    got = {r["id"]: r["p"] for r in rows.select("id", H.process_html("html", F.lit("https://a.org")).alias("p")).collect()}
    assert [got[k]["oversized"] for k in (1, 2, 3)] == [True, False, False] and got[2]["text"] == "fine"


def test_depth():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert H.process(deep)["depth_rejected"] and H.process(deep)["text"] == ""
    assert not H.process("<script>" + "'<div>'" * 5000 + "</script><p>x</p>")["depth_rejected"]
    assert not H.process("<div>" * 900 + "x" + "</div>" * 900)["depth_rejected"]
    assert H.process(None)["text"] == "" and H.process("")["markdown"] == ""


def test_long_lines_only_once():
    long = "word " * 30
    text = H.markdown(f"<p>{long}</p><p>short</p><p>{long}</p><p>short</p>")
    assert text.count("word word") >= 1 and text.split("\n").count(long.strip()) == 1 and text.split("\n").count("short") == 2


def test_article():
    a = H.article('<html><head><title>x</title><meta property="article:published_time" content="2024-01-02"></head><body><article><h1>Big News</h1><p>' + "word " * 60 + "</p></article></body></html>", "https://a.org/x")
    assert a["ok"] and a["title"] == "Big News" and a["published"] == "2024-01-02" and "article_element" in a["signals"]
    assert H.article("", None)["reason"] == "empty_page" and H.article("<p>hi</p>", None)["reason"] == "missing_title"


def test_embedded_article():
    data = '{"props":{"items":[{"title":"Other","body":"long text here and more"},{"title":"Mine","slug":"my-story","body":"<p>Short</p>"}]}}'
    page = f'<script id="__NEXT_DATA__" type="application/json">{data}</script>'
    assert H.embedded_article(page, "https://a.org/news/my-story") == {"title": "Mine", "text": "Short"}
    assert H.embedded_article(page, "https://a.org/news/else")["title"] == "Other"
    assert H.embedded_article("<p>none</p>", None) is None and H.embedded_article(None, None) is None
    assert H.embedded_article('<script type="application/json">{bad</script>', "https://a.org") is None


def test_path_repair(spark):
    assert one(spark, U.repaired_path(F.col("p")), p="/caf%C3%83%C2%A9/x") == "/caf%C3%A9/x"
    for kept in ("/caf%C3%A9/x", "/plain/x", "/%zz"):
        assert one(spark, U.repaired_path(F.col("p")), p=kept) == kept


def test_links():
    found = H.links('<link rel="alternate" type="application/rss+xml" href="/f.xml"><nav><a href="/a">A</a></nav><a href="/b#x">B <b>c</b></a><a href="/b">again</a><a href="mailto:x">m</a>', "https://a.org/")
    assert [(d["url"], d["kind"], d["in_menu"]) for d in found] == [("https://a.org/f.xml", "rss", False), ("https://a.org/a", "html", True), ("https://a.org/b", "html", False)]
    assert found[2]["text"] == "B c"


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Acme</title>
<item><guid>g1</guid><title> First  item </title><link>https://acme.org/a?utm_source=x</link><description>d</description><content:encoded><![CDATA[<p>b</p>]]></content:encoded><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>
<item><title>No link</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>At</title><entry><id>https://acme.org/e</id><title>E</title><link rel="self" href="https://x.org"/><updated>2024-03-05T10:00:00Z</updated><summary>s</summary></entry></feed>"""


def test_feeds(spark):
    rows = spark.createDataFrame([("f1", RSS), ("f2", ATOM), ("f3", "{}"), ("f4", None)], "feed_url string, body string")
    items = {r["feed_url"]: r for r in feeds.feed_items(rows).collect()}
    assert set(items) == {"f1", "f2"}
    assert items["f1"]["title"] == "First item" and items["f1"]["body_html"] == "<p>b</p>" and str(items["f1"]["published_at"]) == "2024-03-05 10:00:00"
    assert items["f2"]["url"] == "https://acme.org/e" and items["f2"]["kind"] == "atom" and items["f2"]["body_html"] == "s"
    report = {r["feed_url"]: r for r in feeds.feed_report(rows).collect()}
    assert report["f1"]["total_entries"] == 2 and report["f3"]["error"] and report["f4"]["error"]


def test_universe(spark, tmp_path):
    path = tmp_path / "u.json"
    path.write_text('{"schema_version":"company-universe.v2","source":{"name":"s"},"companies":[{"source_company_id":"1","company_key":"acme","name":"Acme"},{"source_company_id":"1","company_key":"Bad Key","name":" ","market_cap":-1}]}')
    rows = universe.read_universe(spark, str(path))
    assert rows.count() == 2
    assert {r["rule"] for r in universe.violations(rows).collect()} == {"company_key", "name", "market_cap", "duplicate_source_company_id"}


def test_offload(spark, tmp_path):
    from newsweft.sources.sinks import offload_payloads

    path = str(tmp_path / "o")
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "old"), (3, None, None)], "id int, payload string, payload_s3_key string")
    first = offload_payloads(rows, path, "one").collect()
    assert {r["id"]: (r["payload"], r["payload_s3_key"]) for r in first if r["id"] != 1} == {2: ("b", "old"), 3: (None, None)}
    assert first[[r["id"] for r in first].index(1)]["payload"] is None
    more = spark.createDataFrame([*first, (4, "d", None)], rows.schema)
    for _ in range(2):  # a repeated run changes nothing
        second = offload_payloads(more, path, "two").collect()
    held = {r["id"]: r["payload"] for r in spark.read.option("recursiveFileLookup", "true").json(path).collect()}
    assert held == {"1": "a", "4": "d"} and sum(r["payload_s3_key"] is None for r in second) == 1


def test_numbers_have_no_gaps(spark):
    from newsweft.operators.archive import number_rows

    rows = spark.range(300_000, numPartitions=6).select((F.col("id") * 7919 % 300_007).alias("k"), F.concat(F.lit("row-"), "id").alias("carried"))
    got = number_rows(rows, ["k"], "place").agg(F.max("place").alias("most"), F.countDistinct("place").alias("n"), F.countDistinct("carried").alias("rows")).first()
    assert (got["most"], got["n"], got["rows"]) == (299_999, 300_000, 300_000)


def test_upsert_takes_the_owner_of_the_first_key(spark):
    from newsweft.operators.state import upsert_items

    t = "source_id string, id string, external_id string, url string, canonical_url string, title string, created_at int, is_private boolean, hydrated boolean, releasable boolean"
    old = spark.createDataFrame([
        ("s", "a", "g1", "https://x.org/1", "https://x.org/1", "one", 1, False, True, False), ("s", "b", "g2", "https://x.org/2", "https://x.org/2", "two", 2, False, False, False),
        ("s", "c", "g3", "https://x.org/3", "https://x.org/3", "three", 3, True, False, True), ("q", "d", "g1", "https://x.org/1", "https://x.org/1", "other", 1, False, False, False),
    ], t)
    new = spark.createDataFrame([
        ("s", "n1", "g2", "https://www.x.org/1/", "https://x.org/moved", "first", 5, False), ("s", "n3", "g3", "https://x.org/new", "https://x.org/3", "third", 6, False),
        ("s", "n4", "g9", "https://x.org/9", "https://x.org/9", "early", 7, False), ("s", "n5", "g9", "https://x.org/9b", "https://x.org/9b", "late", 8, False),
    ], "source_id string, id string, external_id string, url string, canonical_url string, title string, created_at int, is_private boolean")
    got = {(r["source_id"], r["id"]): r for r in upsert_items(old, new).collect()}
    assert set(got) == {("s", "a"), ("s", "b"), ("s", "c"), ("q", "d"), ("s", "n5")}
    a, c = got["s", "a"], got["s", "c"]
    assert (a["action"], a["external_id"], a["canonical_url"], a["title"], a["body_of"]) == ("updated", "g1", "https://x.org/moved", "first", "a")
    assert (c["action"], c["is_private"], c["body_of"]) == ("updated", False, "n3")
    assert got["s", "b"]["action"] == got["q", "d"]["action"] == "kept" and got["s", "n5"]["action"] == "inserted"


def test_streams(spark, tmp_path):
    from newsweft.operators.state import fold_source_health
    from newsweft.streaming.folds import read_events, run_health_stream

    schema = "run_id long, source_id string, succeeded boolean, items_found int"
    rows = [(1, "a", True, 3), (2, "a", False, 0), (3, "a", False, 0), (4, "b", True, 0), (5, "b", True, 0)]
    table = spark.createDataFrame(rows, schema)
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    stream = read_events(spark, str(tmp_path / "in/*"), table.schema)
    run_health_stream(stream, str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination()
    last = max((tmp_path / "state").iterdir(), key=lambda p: int(p.name[1:]))
    got = {r["source_id"]: (r["failures"], r["zero_runs"], r["total_successes"]) for r in spark.read.parquet(str(last)).collect()}
    want = {r["source_id"]: (r["failures"], r["zero_runs"], r["total_successes"]) for r in fold_source_health(table).collect()}
    assert got == want == {"a": (2, 0, 1), "b": (0, 2, 2)}


def test_coverage_names_the_reasons_and_signals_of_articles():
    root = Path(__file__).resolve().parent.parent
    said = (root / "COVERAGE.md").read_text()
    code = (root / "newsweft/functions/html.py").read_text().split("def article(")[1].split("ARTICLE =")[0]
    reasons = set(re.findall(r'"reason": "([a-z_]+)"', code)) | set(re.findall(r'"([a-z_]+)"', next(x for x in code.splitlines() if x.strip().startswith("reason ="))))
    assert len(reasons - {"ok"}) == 6 and all(f"`{r}`" in said for r in reasons - {"ok"})
    assert all(f"`{s}`" in said for s in ("article_element", "og_article", "json_ld", "dated", "single_h1", "long_body", "paragraphs"))
