"""Vector codes and exact search against brute force over integers of any size, with ties, copies and broken vectors."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsweft.llm import queries, vectors
from newsweft.plans import compare

ROWS = "vec_id bigint, embedding array<float>, label int"


def usable(rows, scale):
    whole = [(i, [math.floor(scale * float(np.float32(x))) for x in e], label) for i, e, label in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    whole = [r for r in whole if all(abs(x) <= vectors.LARGEST for x in r[1])]
    lengths = collections.Counter(len(v) for _, v, _ in whole)
    dims = min(lengths, key=lambda n: (-lengths[n], n)) if lengths else 0
    return [r for r in whole if len(r[1]) == dims]


def slow_codes(rows, parts=8, entries=16, rounds=6):
    kept = usable(rows, 4096)
    if not kept:
        return []
    width = -(-len(kept[0][1]) // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[list(cut[r][p]) for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min((far(c[p], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for i in range(len(books[p])):
                if mine := [c[p] for c, n in zip(cut, near) if n[p][1] == i]:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in n) for n in near]
    by_label = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    return [(i, "".join(f"{e:02x}" for _, e in n), error, by_label[label], digest) for (i, _, label), n, error in zip(kept, near, errors)]


def slow_top(rows, k=20, every=20):
    kept = [(i, v) for i, v, _ in usable([r for r in rows if r[0] is not None], 64)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(kept) if a != b)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def made(seed, n=300, dims=16, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(dims)], r.choice([None, 1, 2])) for i in range(n)]


BROKEN = [
    (1000, None, 1), (1001, [], 1), (1002, [1.0, None] * 8, 1), (1003, [float("nan")] * 16, None), (1004, [float("inf")] * 16, 2), (1005, [3e38] * 16, 2),
    (1020, [0.5] * 15, 1), (None, [0.25] * 16, None), (1040, [0.0] * 16, None), (1060, [0.0] * 16, 3), (1060, [0.0] * 16, 3), (1080, [-900.0, 900.0] * 8, 3), (1080, [0.5] * 16, 4),
]
TABLES = {
    "spread": made(1),
    "broken": made(2, 60) + BROKEN,
    "only broken": BROKEN[:7],
    "one": [(20, [0.5] * 16, 1)],
    "two equal": [(20, [0.5] * 16, 1), (40, [0.5] * 16, None)],
    "hot": made(3, 80) + [(i, [0.125, -0.25] * 8, 1) for i in range(100, 300)],
    "small integers tie": [(i, [float(random.Random(i).randint(-1, 1)) for _ in range(16)], i % 3) for i in range(400)],
    "length 19": made(5, 90, 19),
    "fewer than entries": made(6, 5),
    "large": made(7, 120, 16, 4000.0),
}


@pytest.mark.parametrize("name", TABLES)
def test_codes_against_brute_force(spark, name):
    got = vectors.compress(spark.createDataFrame(TABLES[name], ROWS)).collect()
    assert in_order(got) == in_order(slow_codes(TABLES[name]))


@pytest.mark.parametrize("name", TABLES)
def test_top_k_against_brute_force(spark, name):
    got = vectors.top_inner_products(spark.createDataFrame(TABLES[name], ROWS)).collect()
    assert in_order(got) == in_order(slow_top(TABLES[name]))


@pytest.mark.parametrize("bits,block", [(1, 7), (3, 40), (8, 1 << 15)])
def test_top_k_whatever_the_cells_and_blocks(spark, bits, block):
    rows = made(9, 260) + [(1000 + i, [0.5] * 16, 1) for i in range(60)]
    got = vectors.top_inner_products(spark.createDataFrame(rows, ROWS), k=7, every=10, bits=bits, block=block).collect()
    assert in_order(got) == in_order(slow_top(rows, 7, 10))


@pytest.mark.parametrize("bits", [1, 2, 6])
def test_cells_find_the_nearest_entry(bits):
    r = np.random.default_rng(bits)
    for scale in (1, 50, 10**7):
        entries, queries = r.integers(-scale, scale + 1, (16, 5)), r.integers(-scale, scale + 1, (500, 5))
        index, distance = vectors.Cells(entries, bits).nearest(queries)
        slow = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
        assert distance.tolist() == slow.min(1).tolist() and index.tolist() == [min(range(16), key=lambda e: (row[e], e)) for row in slow.tolist()]


def test_bounds_leave_few_vectors_to_read(spark, monkeypatch, sf_dir):
    """The scan of the cells is what decides: exact products are taken of few candidates only."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    kept = usable([(r["vec_id"], r["embedding"], r["label"]) for r in rows], 64)
    v = np.array([x for _, x, _ in kept], np.int64)
    marks = [sorted({int(v[:, d].min()), *np.quantile(v[:, d], np.arange(1, 32) / 32).astype(int).tolist()}) + [int(v[:, d].max()) + 1] for d in range(v.shape[1])]
    import pyarrow as pa

    cells = np.stack([np.searchsorted(m, v[:, d], "right") - 1 for d, m in enumerate(marks)], 1).astype(np.uint8)
    ids = pa.array([[i] for i, _, _ in kept], pa.list_(pa.int64()))
    candidates = pa.table({"v": pa.array(v.tolist(), pa.list_(pa.int32())), "ids": ids, "cells": pa.array([c.tobytes() for c in cells], pa.binary())})
    asked = pa.table({"c": pa.array([0, 1, 2], pa.int64()), "v": pa.array(v[:3].tolist(), pa.list_(pa.int32()))})
    read = []
    einsum = np.einsum
    monkeypatch.setattr(vectors.np, "einsum", lambda how, a, b: read.append(len(a)) or einsum(how, a, b))
    out = vectors._best_of_block(marks, 21)(asked, candidates)
    assert out.num_rows == 63 and sum(read) < 0.6 * 3 * len(kept)


def test_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame(TABLES["broken"], ROWS)
    wide = df.withColumns({c: F.lit("z") for c in ("v", "c", "n", "ids", "cells", "score", "rank", "part", "entry", "code", "error", "of_label", "qb", "cb", "d", "x")})
    assert in_order(vectors.compress(wide).collect()) == in_order(slow_codes(TABLES["broken"]))
    assert in_order(vectors.top_inner_products(wide).collect()) == in_order(slow_top(TABLES["broken"]))
    none = spark.createDataFrame([], ROWS)
    assert vectors.compress(none).columns == vectors.compress(df).columns and not vectors.compress(none).count()
    assert vectors.top_inner_products(none).columns == ["query_id", "rank", "vec_id", "score"] and not vectors.top_inner_products(none).count()


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_exact_top_k"])
def test_queries_against_sql(spark, sf_dir, name):
    assert compare.difference(queries.queries()[name](spark, sf_dir), compare.connect(sf_dir), queries.oracle_sql()[name]) == ""
