"""The archive's tree: hashes that hold those below, differences, kept paths, and a validator that finds each damage."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from newsweft.operators import manifests as M

LINES = "month string, document_id string, company_key string, line string"


def line(i, month, company):
    d = hashlib.sha256(str(i).encode()).hexdigest()
    return (month, d, company, json.dumps({"document_id": d, "company_key": company, "title": f"é {i}"}, ensure_ascii=False, separators=(",", ":")))


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([line(i, f"2024-0{1 + i % 3}", f"c{i % 5}") for i in range(150)], LINES)


@pytest.fixture(scope="module")
def tree(lines):
    return {r["path"]: r["content"] for r in M.archive_tree(lines, 10, 1 << 20).collect()}


def broken(spark, files):
    rows = spark.createDataFrame(sorted(files.items()), "path string, content string")
    return {r["rule"]: r["n"] for r in M.validate(rows).collect() if r["n"]}


def test_tree_holds_every_line_and_hash(spark, lines, tree):
    want = {}
    for m, d, _, text in sorted(tuple(r) for r in lines.collect()):
        want.setdefault(m, []).append(text)
    sha = lambda x: "sha256:" + hashlib.sha256(x.encode()).hexdigest()
    head, root = json.loads(tree["HEAD.json"]), json.loads(tree[f"{M.BASE}/manifest.json"])
    assert head["generation"] == root["generation"] and head["record_count"] == root["record_count"] == 150 and head["company_count"] == 5
    digests = []
    for ref in root["partitions"]:
        manifest = json.loads(tree[ref["manifest_path"]])
        assert ref["sha256"] == sha(tree[ref["manifest_path"]]) and manifest["generation"] == head["generation"]
        got = []
        for s in manifest["shards"]:
            body = tree[s["path"]]
            assert sha(body) == s["sha256"] and len(body.encode()) == s["byte_count"] and body.endswith("\n") and 0 < s["record_count"] <= 10
            got += body.splitlines()
        assert got == want[ref["partition"]]
        digests.append(f"{ref['partition']}={hashlib.sha256(chr(10).join(s['prefix'] + '=' + s['sha256'] for s in manifest['shards']).encode()).hexdigest()}")
    assert head["generation"] == hashlib.sha256("\n".join(digests).encode()).hexdigest()
    assert broken(spark, tree) == {}


def test_empty_archive(spark):
    files = {r["path"]: r["content"] for r in M.archive_tree(spark.createDataFrame([], LINES)).collect()}
    assert sorted(files) == ["HEAD.json", f"{M.BASE}/manifest.json"] and json.loads(files["HEAD.json"])["record_count"] == 0
    assert broken(spark, files) == {}


def _edit(path, change):
    return lambda files: {**files, path: change(files[path])}


def _json(change):
    def edit(text):
        value = json.loads(text)
        change(value)
        return json.dumps(value, separators=(",", ":"))

    return edit


def damages(tree):
    head, root = "HEAD.json", f"{M.BASE}/manifest.json"
    month = json.loads(tree[root])["partitions"][0]["manifest_path"]
    shard = next(s["path"] for s in json.loads(tree[month])["shards"] if s["record_count"] > 2 and s["prefix"])
    first = lambda body: body.splitlines()[0]
    drop = lambda path: lambda files: {k: v for k, v in files.items() if k != path}
    return {
        "partition_digest": _edit(month, lambda x: x + " "), "partition_generation": _edit(month, _json(lambda v: v.update(generation="x"))), "partition_missing": drop(month), "shard_missing": drop(shard),
        "shard_unlisted": lambda files: {**files, shard.replace(".jsonl", "f.jsonl"): files[shard]}, "shard_byte_count": _edit(shard, lambda x: x.replace("é", "e")), "shard_digest": _edit(shard, lambda x: x.replace("é", "è")), "shard_final_newline": _edit(shard, lambda x: x[:-1]),
        "shard_record_count": _edit(shard, lambda x: x[len(first(x)) + 1 :]), "line_order": _edit(shard, lambda x: "".join(f"{y}\n" for y in reversed(x.splitlines()))), "line_prefix": _edit(shard, lambda x: x.replace('"document_id":"', '"document_id":"z')),
        "duplicate_document": _edit(shard, lambda x: first(x) + "\n" + x), "partition_record_count": _edit(month, _json(lambda v: v.update(record_count=1))), "partition_shard_count": _edit(month, _json(lambda v: v["shards"].pop())), "partition_byte_count": _edit(month, _json(lambda v: v.update(byte_count=1))),
        "root_partition_counts": _edit(root, _json(lambda v: v["partitions"][0].update(record_count=1))), "root_record_count": _edit(root, _json(lambda v: v.update(record_count=1))), "root_company_count": _edit(root, _json(lambda v: v.update(company_count=1))),
        "head_generation": _edit(head, _json(lambda v: v.update(generation="x"))), "head_counts": _edit(head, _json(lambda v: v.update(record_count=1))), "head_path": _edit(head, _json(lambda v: v.update(manifest_path="x"))),
    }


@pytest.mark.parametrize("rule", M.RULES)
def test_validator_finds(spark, tree, rule):
    assert broken(spark, damages(tree)[rule](tree)).get(rule, 0) >= 1


def test_difference_reads_changed_months_only(spark, lines):
    old = M.shard_files(lines, 10, 1 << 20).select("month", "prefix", "sha256")
    newer = lines.where(~((F.col("month") == "2024-02") & (F.substring("document_id", 1, 1) == "3"))).unionByName(spark.createDataFrame([line(1000, "2024-04", "c9")], LINES))
    new = M.shard_files(newer, 10, 1 << 20).select("month", "prefix", "sha256")
    a, b = ({(r["month"], r["prefix"]): r["sha256"] for r in x.collect()} for x in (old, new))
    want = {(k, "delete" if k not in b else "create" if k not in a else "replace") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    got = {((r["month"], r["prefix"]), r["action"]) for r in M.generation_diff(old, new).collect()}
    assert got == want and {m for (m, _), _ in got} == {"2024-02", "2024-04"} and not M.generation_diff(old, old).count()


@pytest.mark.parametrize(
    "previous,kept",
    [("articles/v1/ab/acme/2020/01/aa/D/article.md", True), ("articles/v1/D/article.md", True), ("articles/v1/x/other/article.md", False), ("articles/v1/../D/article.md", False), ("/articles/v1/D/article.md", False), ("articles/v2/D/article.md", False), ("articles/v1/D/record.json", False), (None, False)],
)
def test_kept_paths(spark, previous, kept):
    got = spark.createDataFrame([(previous,)], "p string").select(M.kept_path(F.col("p"), F.lit("D"), F.lit("new")).alias("v")).first()["v"]
    assert got == (previous if kept else "new")
