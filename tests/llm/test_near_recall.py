"""Near copies among texts that share most of their words are found however many such texts there are."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsweft.llm import simhash


def boilerplate(n, seed=5):
    """n / 2 pairs that differ in one word of 200, of which all texts share 180."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    shared, rows = [word() for _ in range(180)], []
    for k in range(n // 2):
        text = shared[:]
        for j in range(20):
            text.insert(j * 9 + 3, word())
        other = text[:]
        other[r.randrange(len(other))] = word()
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize("n", [2000, 6000])
def test_recall_does_not_fall_with_size(spark, n):
    rows = boilerplate(n)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).select("doc_id").collect()}
    alike = [simhash.jaccard(*simhash.shingle_sets(pa.array([rows[i][1], rows[i + 1][1]]).cast(pa.large_string()))) >= simhash.SIMILAR for i in range(0, n, 2)]
    missed = sum(a and i * 2 in kept and i * 2 + 1 in kept for i, a in enumerate(alike))
    assert sum(alike) >= 0.95 * n / 2 and missed <= 0.02 * sum(alike)
    # No document without a near copy goes.
    assert all(i * 2 in kept and i * 2 + 1 in kept for i, a in enumerate(alike) if not a)


def test_stars_whatever_the_batches(monkeypatch):
    """Each row meets its signature's first and the window before it, also where batches end."""
    r = random.Random(3)
    rows = sorted((r.choice([(5 << 32) | 1, (63 << 32) | 2, (7 << 32) | 9]), r.randrange(16), r.randrange(2), k) for k in range(60))
    monkeypatch.setattr(simhash, "WINDOW", 3)
    want = set()
    for i, (sig, near, side, key) in enumerate(rows):
        mates = [j for j in range(i) if rows[j][0] == sig]
        for j in mates[-3:] + mates[:1]:
            other = rows[j]
            if (sig >> 32) & 63 == 63 or other[2] != side:
                if (near ^ other[1]).bit_count() <= simhash.NEAR_BITS or j == mates[0]:
                    want.add((min(key, other[3]), max(key, other[3])))
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.int8()), pa.array([x[1] for x in part], pa.int32()), pa.array([x[3] for x in part], pa.int64())], ["sig", "side", "near", "key"]) for part in (rows[a : a + size] for a in range(0, 60, size))]
        got = {(a, b) for batch in simhash._stars(iter(batches)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())}
        assert got == want


def crowd(n, seed=7):
    """n / 2 pairs that differ in one word of 200, of which all texts share 194, so that all stand under the same signatures."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    shared, texts = [word() for _ in range(194)], []
    for _ in range(n // 2):
        text = shared[:]
        for j in range(6):
            text.insert(j * 30 + 20, word())
        other = text[:]
        other[r.randrange(len(other))] = word()
        texts += [" ".join(text), " ".join(other)]
    return texts


@pytest.mark.parametrize("block", [7, 1024])
def test_no_pair_under_a_crowded_signature_is_lost(spark, monkeypatch, block):
    """Classes are those of all alike pairs with a segment that differs in one bit at most, whatever the size of a bucket."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = crowd(800) + [t for _, t in boilerplate(200)]
    column = pa.array(texts).cast(pa.large_string())
    segments, sets = simhash.wide_fingerprints(column).view(np.uint32), simhash.shingle_sets(column)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    place = {r["k"]: r["doc_id"] for r in docs.select(simhash._text_key(F.col("text")).alias("k"), "doc_id").collect()}
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in np.flatnonzero((np.bitwise_count(segments[i + 1 :] ^ segments[i]) <= 1).any(axis=1)) + i + 1:
            if want[i] != want[j] and simhash.jaccard(sets[i], sets[j]) >= simhash.SIMILAR:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    got = dict(enumerate(range(len(texts))))
    rows = [(place[r["key"]], r["label"]) for r in simhash.near_classes(docs).collect()]
    least = {label: min(i for i, other in rows if other == label) for _, label in rows}
    got.update({i: least[label] for i, label in rows})
    # No class is smaller than by those pairs; one may be larger by an alike pair with no such segment.
    assert all(got[i] == got[w] for i, w in enumerate(want))
    links = simhash.near_links(docs).collect()
    assert all(simhash.jaccard(sets[place[e["a"]]], sets[place[e["b"]]]) >= simhash.SIMILAR for e in links)
    assert sum(w != i for i, w in enumerate(want)) >= 450
