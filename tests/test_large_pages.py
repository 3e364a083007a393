"""Queries whose items are fewer than the pages, so that Spark broadcasts the items' side of their join."""

from __future__ import annotations

import os
import re

import pytest

from newsweft.plans import catalog, compare


@pytest.fixture(scope="module")
def many_pages(tmp_path_factory, sf_dir):
    """The tables with forty times the pages."""
    made = tmp_path_factory.mktemp("pages")
    for t in compare.TABLES:
        if t != "pages":
            os.symlink(f"{sf_dir}/{t}.parquet", made / f"{t}.parquet")
    con = compare.connect(sf_dir)
    con.execute(f"copy (select page_id + k * (select count(*) from pages) as page_id, url, html from pages, range(40) r(k)) to '{made}/pages.parquet'")
    return str(made)


@pytest.mark.parametrize("name", ["cross_company_quarantine", "host_policy", "ownership_reasons", "quarantine", "scope_mentions", "vehicle_identity"])
def test_items_are_broadcast(spark, many_pages, name):
    # The sides are small once they have run, but not by their files.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        rows = catalog.queries()[name](spark, many_pages)
        assert compare.difference(rows, compare.connect(many_pages), catalog.oracle_sql()[name]) == ""
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["alias_mentions", "item_upsert"])
def test_no_text_travels(spark, sf_dir, name):
    """What is read off a text is read before the rows are dealt out."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(catalog.queries()[name](spark, sf_dir)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", plan, re.M)
    assert dealt and not [x for x in dealt if re.search(r"\b(text|body_text)#", x)]
