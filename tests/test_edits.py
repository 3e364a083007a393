"""Edits of nested JSON keys against the same edits in Python."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from newsweft.functions import edits as E
from newsweft.operators.edits import release_quarantine

DOCS = [None, "{}", "[1,2]", '"text"', "null", "7", '{"a":1}', '{"a":null}', '{"a":{}}', '{"a":{"b":2,"c":[1,{"d":"é"}]},"z":"1"}', '{"a":{"b":{"c":null}}}', '{"a":[{"b":1}]}', '{"a b":{"":1}}']
PATHS = [["a"], ["a", "b"], ["a", "b", "c"], ["z"], ["a b", ""], ["new", "key"]]


def get(doc, path):
    for key in path:
        if not isinstance(doc, dict) or key not in doc:
            return False
        doc = doc[key]
    return True


def put(doc, path, new):
    if not path:
        return new
    members = dict(doc) if isinstance(doc, dict) else {}
    members[path[0]] = put(members.get(path[0], {}), path[1:], new)
    return members


def drop(doc, path):
    if not get(doc, path):
        return doc
    members = dict(doc)
    if len(path) == 1:
        del members[path[0]]
    else:
        members[path[0]] = drop(members[path[0]], path[1:])
    return members


@pytest.mark.parametrize("path", PATHS, ids="/".join)
def test_edits(spark, path):
    news = ['{"x":[1,"é"]}', "3", "null", '"s"']
    rows = [(i, d, n) for i, (d, n) in enumerate(itertools.product(DOCS, news))]
    v, n = F.parse_json("d"), F.parse_json("n")
    df = spark.createDataFrame(rows, "i int, d string, n string")
    got = {r["i"]: r for r in df.select("i", E.has_key(v, path).alias("has"), F.to_json(E.set_key(v, path, n)).alias("set"), F.to_json(E.remove_key(v, path)).alias("cut")).collect()}
    for i, d, n in rows:
        doc = None if d is None else json.loads(d)
        read = lambda x: None if x is None else json.loads(x)
        assert got[i]["has"] == get(doc, path)
        assert d is None and got[i]["set"] is None or read(got[i]["set"]) == put(doc, path, json.loads(n))
        assert read(got[i]["cut"]) == drop(doc, path)


def test_release_needs_body_reversible_and_reason(spark):
    q = lambda reason, reversible: json.dumps({"k": 1, "quality_quarantine": {"reason": reason, "reversible": reversible}})
    rows = [("free", q("article_body_missing", True), True, True), ("topic", q("topic", True), True, True), ("final", q("article_body_missing", False), True, True), ("no body", q("article_body_missing", True), False, True), ("none", '{"k":1}', True, True), ("null", None, True, True), ("odd", '{"quality_quarantine":5}', True, False)]
    df = spark.createDataFrame(rows, "id string, p string, hydrated boolean, is_private boolean").withColumn("processing", F.parse_json("p"))
    got = {r["id"]: r for r in release_quarantine(df).select("id", "released", "is_private", F.to_json("processing").alias("t")).collect()}
    assert {k for k, r in got.items() if r["released"]} == {"free"} == {k for k, r in got.items() if not r["is_private"]} - {"odd"}
    assert json.loads(got["free"]["t"]) == {"k": 1, "quality_released": {"reason": "article_body_missing"}} and json.loads(got["topic"]["t"]) == json.loads(rows[1][1]) and got["null"]["t"] is None
