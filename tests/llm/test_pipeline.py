"""The pipeline: each stage against what it may drop, and the whole against its stages."""

from __future__ import annotations

import collections
import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsweft.llm import decontam, mixing, quality


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        ids = collections.Counter(r["doc_id"] for r in rows)
        have = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(ids) <= set(have) and all(r["text"] == have[r["doc_id"]] for r in rows)
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "quality classifier":
            scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
            assert set(ids) == {r["doc_id"] for r in scored.filter(F.col("score") >= 0.7).collect()}
        elif name == "SimHash near-dedup":
            # Every dropped document reaches a kept one over texts that are alike, and no two kept ones are alike.
            texts = {i: shingles(t) for i, t in have.items()}
            heads = {i: i for i in have}
            for a, b in itertools.combinations(sorted(have), 2):
                both = texts[a] | texts[b]
                if not both or len(texts[a] & texts[b]) / len(both) >= 0.8:
                    low, high = sorted((heads[a], heads[b]))
                    heads = {k: low if v == high else v for k, v in heads.items()}
            assert set(ids) == set(heads.values()) and set(ids.values()) == {1}
        elif name == "benchmark decontamination":
            bad = {r["doc_id"] for r in decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
            assert set(ids) == set(have) - bad
        elif name == "mixing sources to target weights":
            marks = mixing.mix(docs).collect()
            want = {r["doc_id"]: sum(2 * p >= max(1, r["size"]) for p in (r["first_pass"], r["second_pass"])) for r in marks}
            assert ids == {k: v for k, v in want.items() if v}
        else:
            assert sum(ids.values()) == docs.count() and {r["shard"] for r in rows} == set(range(8))
        docs = spark.createDataFrame(rows, out.schema)


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_nulls_and_clashing_columns(spark, sf_dir, k):
    rows = [(1, "a few plain words here", "en", "s", 1), (None, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, "another text with other words", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"score": F.lit(1), "row": F.lit("x"), "__row_key": F.lit(2)})
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns
    # Repeated rows, the null row and the empty texts: near-duplicates keep one of the blank ones, mixing takes blank texts twice or not at all.
    assert out.count() == {0: out.count(), 1: 3, 2: 5}.get(k, out.count())
