"""Issuers' names, terms, hosts, claims and ownership, and the prefix vote, on cases of their own."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from newsweft.functions import names as N
from newsweft.operators import evidence as E
from newsweft.operators import scope as S

ISSUER = "company_id bigint, name string, alias string, home_url string, host_policy string"
ITEM = "id string, company_id bigint, title string, url string, canonical_url string, is_private boolean"


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **literals):
        row = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>")).alias(k) for k, v in literals.items()])
        return row.select(column.alias("v")).first()["v"]

    return value


@pytest.mark.parametrize(
    "name,want",
    [
        ("Nordvik Therapeutics Inc. Common Stock", "Nordvik Therapeutics Inc."),
        ("Harbour Lane Corp - Class A Ordinary Shares", "Harbour Lane Corp"),
        ("Harbour Lane Corp Class B 6.5% Redeemable Notes due 2031 Preferred Stock", "Harbour Lane Corp"),
        ("Silver  Fern (Delaware) Common Stock", "Silver  Fern"),
        ("Silver Fern (Delaware)", "Silver Fern (Delaware)"),
        ("Class Struggle Media plc", "Class Struggle Media plc"),
        ("Unit", "Unit"),
        ("Mill Rights", "Mill"),
        ("Rights Mill Ltd", "Rights Mill Ltd"),
        (" Common Stock", "Common Stock"),
        ("", ""),
    ],
)
def test_security_name(one, name, want):
    assert one(N.security_name(F.col("n")), n=name) == want


@pytest.mark.parametrize(
    "names,has,lacks",
    [
        (["Nordvik Therapeutics Inc. Common Stock"], ["nordvik"], ["therapeutics", "inc"]),
        (["Advanced Copper Capital Inc. Common Stock"], ["copper", "acc", "acci", "accinc"], ["advanced", "capital"]),
        (["Northern International Group Inc. Common Stock"], ["northern", "nig"], ["international", "group"]),
        (["Lumen Logic", "OldForge (in process of incorporating as Lumen Logic Inc due to trademark)"], ["lumen", "oldforge"], ["process", "incorporating", "due", "trademark", "as2"]),
        (["7Q Company Common Stock"], ["7q"], []),
        (["Rotterdam Werf N.V."], ["rotterdam", "werf"], ["nv"]),
        ([None, ""], [], ["inc"]),
    ],
)
def test_scope_terms(one, names, has, lacks):
    got = one(N.scope_terms(F.col("n")), n=names)
    assert set(has) <= set(got) and not set(lacks) & set(got)


@pytest.mark.parametrize(
    "tokens,terms,least,want",
    [(["newgen"], ["newgenivf"], 1, True), (["market"], ["marketwise"], 1, False), (["art"], ["art"], 4, False), (["art"], ["art"], 1, True), (["abcdefgh"], ["abcde"], 1, True), (["abcd"], ["abcde"], 1, False), ([], ["abc"], 1, False), (["abc"], [], 1, False)],
)
def test_mentions_term(one, tokens, terms, least, want):
    assert one(N.mentions_term(F.col("t"), F.col("s"), least), t=tokens, s=terms) is want


@pytest.mark.parametrize(
    "name,host,want",
    [
        ("Nordvik Inc", "www.nordvik.io", True), ("Nordvik Sea Inc", "ir.nordviksea-news.com", True), ("N.W. Bancorp", "nwbank.com", True), ("Northern Iron Group Inc", "nig.com", True), ("Acro Inc", "getacro.com", True), ("Acro Inc", "acrolabs.io", True),
        ("Acro Inc", "acrobat.org", False), ("Ai.com Holdings", "other.com", False), ("Bolt Dyson and Company", "bdco.com", True), ("Ford Works", "example.ford", False), ("Bravo Charlie Delta", "bravocd.net", True), ("", "a.b", False),
    ],
)
def test_name_matches_host(one, name, host, want):
    assert one(N.name_matches_host(F.col("n"), F.col("h")), n=name, h=host) is want


@pytest.mark.parametrize("left,right,same", [("Acme Inc. Class A Common Stock", "Acme Inc. Class B Common Stock", True), ("Acme Corp", "Acme Inc", True), ("Acme plc ADR", "Acme Ltd", True), ("Acme Inc", "Acme Labs Inc", False)])
def test_one_issuer(one, left, right, same):
    key, words = (lambda c: N.issuer_key(c)), (lambda c: N.issuer_tokens(c))
    got = one((key(F.col("l")) == key(F.col("r"))) | (words(F.col("l")) == words(F.col("r"))), l=left, r=right)
    assert got is same


def test_policy_hosts(one):
    policy = '{"excluded_hosts":["https://WWW.Bad.example/x"," host.example:80/y ","","//third.example"]}'
    assert one(S.policy_hosts(F.col("p"), "excluded_hosts"), p=policy) == ["bad.example", "host.example", "third.example"]
    assert one(S.policy_hosts(F.col("p"), "verified_hosts"), p=policy) == []


def test_claims_of_one_url(spark):
    issuers = [
        (1, "Nordvik Mining Inc. Class A Common Stock", None, "https://www.nordvik.io/", None),
        (2, "Nordvik Mining Inc. Class B Common Stock", None, "https://www.nordvik.io/", None),
        (3, "Bolt Dyson and Company Common Stock", None, None, None),
        (4, "Oak Tree Income Trust", None, None, None),
        (5, "Quarry", None, "https://quarry.example.org/", None),
        (6, "Quarry Stone", None, None, '{"verified_hosts":["press.example.net"]}'),
        (7, "Elsewhere", None, None, '{"excluded_hosts":["elsewhere.com"]}'),
    ]
    u = "https://press.example.net/en/quarry-stone-results"
    items = [
        ("named", 1, "Nordvik opens a mine", "https://a.example.net/1", "https://a.example.net/1", False), ("class-b", 2, "Nothing here", "https://a.example.net/1", "https://a.example.net/1", False),
        ("rival", 3, "Nothing here", "https://a.example.net/1", "https://a.example.net/1", False), ("private", 4, "Nothing", "https://a.example.net/1", "https://a.example.net/1", True),
        ("alone", 1, "x", "https://a.example.net/2", "https://a.example.net/2", False), ("classes", 1, "x", "https://a.example.net/3", "https://a.example.net/3", False), ("classes-b", 2, "x", "https://a.example.net/3", "https://a.example.net/3", False),
        ("acronym", 3, "BD wins", "https://news.bd.com/x", "https://news.bd.com/x", False), ("acronym-rival", 1, "BD wins", "https://news.bd.com/x", "https://news.bd.com/x", False),
        ("fund", 4, "Oak Tree pays income", "https://www.blackrock.com/x", "https://www.blackrock.com/x", False), ("fund-rival", 1, "y", "https://www.blackrock.com/x", "https://www.blackrock.com/x", False),
        ("short", 5, "Quarry Stone results", u, u, False), ("long", 6, "Quarry Stone results", u, u, False),
        ("excluded", 7, "z", "https://www.elsewhere.com/p", "https://www.elsewhere.com/p", False), ("excluded-rival", 1, "z", "https://www.elsewhere.com/p", "https://www.elsewhere.com/p", False),
        ("shared", 1, "z", "https://www.prnewswire.com/7", "https://www.prnewswire.com/7", False), ("shared-named", 3, "Dyson z", "https://www.prnewswire.com/7", "https://www.prnewswire.com/7", False),
        ("unknown", 99, "z", "https://www.prnewswire.com/7", "https://www.prnewswire.com/7", False), ("no-title", 3, None, "https://b.example.net/4", None, False), ("no-title-rival", 1, None, "https://b.example.net/4", None, False),
    ]
    got = {r["id"]: (r["n_competing"], r["quarantined"]) for r in S.cross_company_claims(spark.createDataFrame(items, ITEM), spark.createDataFrame(issuers, ISSUER)).collect()}
    assert got == {
        "named": (1, False), "class-b": (1, True), "rival": (2, True), "acronym": (1, False), "acronym-rival": (1, True), "fund": (1, False), "fund-rival": (1, True), "short": (1, True), "long": (1, False),
        # The name of an excluded host still mentions the company, by its URL.
        "excluded": (1, False), "excluded-rival": (1, True), "shared": (1, True), "shared-named": (1, False), "no-title": (1, True), "no-title-rival": (1, True),
    }


def test_mentions_take_the_longest_term(spark):
    issuers = [(1, "Quarry", None, None, None), (2, "Quarrystone", None, None, None), (3, "Quarry Two", None, None, None)]
    items = [("a", 1, "The quarry", "https://x.net/1", None, False), ("b", 1, "quarrysto", "https://x.net/2", None, False), ("c", 1, "nothing", "https://x.net/quarrystone", None, False), ("d", 1, None, "https://x.net/two", None, False), ("e", 1, "", "https://x.net/3", None, False)]
    got = {r["id"]: (r["term"], r["n_companies"], r["company_id"]) for r in S.scope_mentions(spark.createDataFrame(items, ITEM), S.with_identity(spark.createDataFrame(issuers, ISSUER))).collect()}
    assert got == {"a": ("quarry", 2, 1), "b": ("quarrystone", 1, 2), "c": ("quarrystone", 1, 2)}


@pytest.mark.parametrize(
    "candidate,final,found,want",
    [
        ("https://bad.example.net/f", None, None, None), ("https://ok.example.net/f", "https://bad.example.net/g", None, None), ("https://ok.example.net/f", None, None, "verified_publication_host"), ("https://ok.example.net/f", "https://far.org/", None, None),
        ("https://news.home.org/f", "https://home.org/g", None, "official_profile_host"), ("https://far.org/f", None, ("link", "https://home.org/a"), "official_profile_link_evidence"), ("https://far.org/f", None, ("html_alternate", "https://nordvik.io/a"), "company_name_link_evidence"),
        ("https://far.org/f", None, ("link", "https://nordvik.io/a"), None), ("https://nordvik.io/f", None, None, "company_name_matches_feed_host"), ("https://nordvik.io/f", "https://far.org/x", None, None), ("https://far.org/f", None, ("link", "no url"), None),
    ],
)
def test_ownership_reasons_in_order(spark, candidate, final, found, want):
    issuer = spark.createDataFrame([(1, "Nordvik Inc", None, "https://www.home.org/", '{"excluded_hosts":["bad.example.net"],"verified_hosts":["ok.example.net"]}')], ISSUER)
    row = spark.createDataFrame([(1, candidate, final, [found] if found else [])], "company_id bigint, candidate string, final string, found array<struct<method:string,found_on:string>>")
    reason = S.ownership_reason(F.col("candidate"), F.col("final"), F.col("found"), S._columns())
    assert row.join(S.with_identity(issuer), "company_id").select(reason.alias("v")).first()["v"] == want


def slow_prefix(own, paths):
    paths = sorted({p for p in paths if p != "/" and p.rstrip("/") != own.rstrip("/")})
    found = set()
    for a, b in itertools.combinations(paths, 2):
        shared = "".join(x for x, _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b)))
        shared = shared[: max((shared.rfind(c) for c in "/-_")) + 1]
        folders = [x for x in shared.split("/") if x]
        if len(shared) >= 5 and not (len(folders) == 1 and shared.endswith("/") and folders[0].lower() not in E.SPECIFIC_FOLDERS):
            found.add(shared)
    ranked = sorted((-sum(p.startswith(f) for p in paths), -len(f), f) for f in found)
    return (ranked[0][2], -ranked[0][0]) if ranked else None


def test_prefix_vote_against_pairs(spark):
    r = random.Random(7)
    rows, want = [], {}
    for s in range(200):
        paths = ["/" + "".join(r.choice(["news", "Blog", "a", "b-", "/", "_", "2024", "press-release", "/", "-"]) for _ in range(r.randint(0, 7))) for _ in range(r.randint(0, 9))]
        own = "/news"
        rows += [(str(s), f"https://www.s{s}.org{own}", f"https://s{s}.org{p}") for p in paths]
        rows += [(str(s), f"https://www.s{s}.org{own}", f"https://elsewhere.org/news/{i}") for i in range(3)]
        if (best := slow_prefix(own, paths)) is not None:
            want[str(s)] = best
    got = E.evidence_prefixes(spark.createDataFrame(rows, "source_id string, publication_url string, evidence_url string"))
    assert {r["source_id"]: (r["prefix"], r["support"]) for r in got.collect()} == want and len(want) >= 20
