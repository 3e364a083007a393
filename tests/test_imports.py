"""The universe import: what it fills and keeps, demoted listings, and that a second import changes nothing."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsweft.operators import imports as I

NONE = (None, None, None, None)
OLD = [
    ("acme", "Acme Inc", "universe", ["A"], "unknown", "active", "https://acme.org/", None, None, None, [], {"cap": "1", "note": "x"}),
    ("bolt", "Bolt edited", "editor", [], "private", "unknown", *NONE, ["h"], None),
    ("gone", "Gone", "universe", [], "public", "active", *NONE, [], {}),
]
NEW = [
    (1, "s1", "acme", "Acme plc", ["B"], "public", "delisted", "https://other.org/", "https://ir.acme.org/", None, None, ["n"], {"cap": "2"}, [("ACM", "NYSE", True, {"s": "1"}), ("ACM", None, False, {})]),
    (2, "s2", "bolt", "Bolt", ["C"], "public", "active", *NONE, ["n"], {}, []),
    (3, "s3", "core", "Core", [], "public", "active", *NONE, [], None, [("CO", None, False, None)]),
]
LISTINGS = [("acme", "OLD", "LSE", True, {"k": "v"}), ("acme", "ACM", "NYSE", False, {"s": "0", "t": "1"}), ("gone", "G", "", True, {})]


@pytest.fixture(scope="module")
def tables(spark):
    frame = spark.createDataFrame
    return frame(NEW, I.SNAPSHOT), frame(OLD, I.COMPANY), frame([("f", "s1", "acme", {"old": "y"}), ("g", "s1", "gone", {})], I.EXTERNAL), frame(LISTINGS, I.LISTING), frame([("f", "before"), ("g", "now")], "source_name string, input_sha256 string")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_what_an_import_fills_and_keeps(tables):
    done = I.import_universe(*tables, "f", "now")
    got = by(done.companies, "company_key")
    acme, bolt, core, gone = (got[k,] for k in ("acme", "bolt", "core", "gone"))
    assert (acme["name"], acme["aliases"], acme["ownership_status"], acme["lifecycle_status"], acme["homepage_url"], acme["investor_relations_url"], acme["hints"], acme["metadata"], acme["action"]) == ("Acme plc", ["A"], "public", "active", "https://acme.org/", "https://ir.acme.org/", ["n"], {"cap": "2", "note": "x"}, "updated")
    assert (bolt["name"], bolt["name_source"], bolt["aliases"], bolt["ownership_status"], bolt["lifecycle_status"], bolt["hints"], bolt["action"]) == ("Bolt edited", "editor", ["C"], "private", "active", ["h"], "updated")
    assert (core["name_source"], core["action"], core["metadata"], gone["action"]) == ("universe", "inserted", {}, "kept")
    ids = by(done.external_ids, "source_name", "source_company_id")
    assert {k: r["action"] for k, r in ids.items()} == {("f", "s1"): "updated", ("g", "s1"): "kept", ("f", "s2"): "inserted", ("f", "s3"): "inserted"} and ids["f", "s1"]["metadata"] == {"old": "y", "company_key": "acme"}
    listings = by(done.listings, "company_key", "ticker", "exchange")
    assert {k: (r["is_primary"], r["action"]) for k, r in listings.items()} == {("acme", "OLD", "LSE"): (False, "demoted"), ("acme", "ACM", "NYSE"): (True, "updated"), ("acme", "ACM", ""): (False, "inserted"), ("gone", "G", ""): (True, "kept"), ("core", "CO", ""): (False, "inserted")}
    assert listings["acme", "ACM", "NYSE"]["metadata"] == {"s": "1", "t": "1"}
    assert tuple(done.run.first()) == ("f", "now", 3, 1, 2, 0, False)


def test_a_second_import_changes_nothing(tables):
    snapshot, *_, runs = tables
    once = I.import_universe(*tables, "f", "now")
    again = I.import_universe(snapshot, *(x.drop("action") for x in (once.companies, once.external_ids, once.listings)), runs, "f", "later")
    for first, second, least in ((once.companies, again.companies, 4), (once.external_ids, again.external_ids, 4), (once.listings, again.listings, 5)):
        assert {r["action"] for r in second.collect()} <= {"unchanged", "kept"} and second.count() == least
        strip = lambda df: sorted(map(repr, df.drop("action").collect()))
        assert strip(first) == strip(second)
    assert tuple(again.run.first())[2:] == (3, 0, 0, 3, False)


def test_a_known_snapshot_is_not_applied(tables):
    _, companies, external, listings, _ = tables
    done = I.import_universe(*tables, "f", "before")
    assert {r["company_key"]: r["action"] for r in done.companies.collect()} == {"acme": "unchanged", "bolt": "unchanged", "gone": "kept"}
    assert {r["action"] for r in done.external_ids.collect()} == {r["action"] for r in done.listings.collect()} == {"kept"} and done.run.first()["idempotent_replay"]
    assert sorted(map(repr, done.listings.drop("action").collect())) == sorted(map(repr, listings.collect()))


def test_empty_tables_and_repeated_records(spark, tables):
    none = [x.limit(0) for x in tables]
    done = I.import_universe(*none, "f", "x")
    assert not any(x.count() for x in (done.companies, done.external_ids, done.listings, done.audit)) and done.run.first()["input_rows"] == 0
    twice = tables[0].unionByName(tables[0].where("company_key = 'core'").withColumns({"row_number": F.lit(9).cast("bigint"), "name": F.lit("Core 2")}))
    assert by(I.import_universe(twice, *none[1:], "f", "x").companies, "company_key")["core",]["name"] == "Core 2"
