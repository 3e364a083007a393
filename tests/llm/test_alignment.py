"""Token alignment against whole-text encoding and pair counts in plain Python."""

from __future__ import annotations

import collections
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from newsweft.llm import alignment, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TEXTS = [
    None, "", " ", "  ", "\n", " \t\n ", "a", " a", "a ", "The quick brown fox", "The quick brown fox", "two  spaces and   three", "tail ", " head", "no-break space and em space",
    "piece ▁ mark ▁▁ twice a▁b", "▁", " ▁", "it's they'll I'm O'Neil's", "<|endoftext|> <s> </s> <unk> [INST]", "<0x41> <0x0A>", "naïve café Übermaß ß", "日本語 のテキスト です", "emoji 👩‍👩‍👧 🏳️‍🌈 x", "ﬁ ligature ① ½ Å",
    "tabs\tand\nnewlines\r\nmixed \n x\n y", "\u0000 nul \u0001 x\u007f", "word " * 3000, "x" * 5000, "12345 3.14 1,000,000", "CamelCaseHTMLParser()", "é ä combined", "​ zero ​width", "﻿bom", "a \u0085 b", "　wide　 space ",
]


@pytest.fixture(scope="module")
def tokenizers():
    return alignment.Tokenizers(alignment.BYTE_BPE, alignment.PIECE_BPE)


def slow_groups(t, text):
    """Groups of (A ids, B ids) of one whole text, by walking both byte ends."""
    if not text:
        return []
    (a,), (b,) = ([e.ids for e in t.a.encode_batch([" " + text], add_special_tokens=False)], [t.b.encode(text)])
    want = b" " + text.encode()
    if b"".join(t.a_bytes[i] for i in a) != want or b"".join(t.b_bytes[i] for i in b) != want:
        return []
    out, i, j, x, y = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            left.append(a[i])
            x += len(t.a_bytes[a[i]])
            i += 1
        else:
            right.append(b[j])
            y += len(t.b_bytes[b[j]])
            j += 1
        if x == y:
            out.append((left, right))
            left, right = [], []
    return out


def slow(t, texts):
    groups = [slow_groups(t, x) for x in texts]
    links = []
    for some in groups:
        mine = []
        for left, right in some:
            ends = lambda ids, size: [sum(len(size[k]) for k in ids[: n + 1]) for n in range(len(ids))]
            for p, x in enumerate(ends(left, t.a_bytes)):
                mine += [(left[p], right[q]) for q, y in enumerate(ends(right, t.b_bytes)) if x == y]
        links.append(mine)
    counts = collections.Counter(x for mine in links for x in mine)
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = []
    for some, mine in zip(groups, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in some)
        rows.append((sum(len(a) for a, _ in some), sum(len(b) for _, b in some), len(some), len(mine), sum(counts[x] == top[x[1]] for x in mine), sum(counts[x] for x in mine), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return rows, {(a, b, n, n == top[b]) for (a, b), n in counts.items()}


def columns(rows):
    return [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows]


@pytest.mark.parametrize("chunk,remembered", [(8 << 20, 300_000), (64, 10)])
def test_awkward_texts_against_brute_force(spark, tokenizers, monkeypatch, chunk, remembered):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    df = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(TEXTS)], DOCS)
    want, pairs = slow(tokenizers, TEXTS)
    got = alignment.align(df)
    assert sorted(columns(got.documents.collect())) == [(i, *r) for i, r in enumerate(want)]
    assert {tuple(r) for r in got.pairs.select("a_id", "b_id", "count", "best").collect()} == pairs


def test_small_chunks_in_process(tokenizers):
    """Chunks and forgetting don't change what a text's groups are (workers of Spark don't see patched bounds)."""
    import pyarrow as pa

    memory = alignment.Memory(tokenizers)
    for x in TEXTS:
        documents, groups = alignment._chunk(pa.array([x], pa.string()), memory, True)
        want = slow_groups(tokenizers, x)
        assert documents["groups"] == [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)]
        assert sum(groups["freq"]) == len(want) == documents["n_groups"][0]
        alone = alignment._chunk(pa.array([x], pa.string()), alignment.Memory(tokenizers), True)[0]
        assert alone["groups"] == documents["groups"]


def test_query_against_brute_force(spark, sf_dir, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, _ = slow(tokenizers, [t for _, t in rows])
    assert sorted(columns(queries.op13_token_alignment(spark, sf_dir).collect())) == sorted((i, *r) for (i, _), r in zip(rows, want))


def test_null_ids_repeats_extra_columns_and_empty(spark, tokenizers):
    rows = [(None, "one text here", "en", "a", 1), (None, "one text here", "en", "a", 1), (1, "one", "en", "a", 1), (1, None, "en", "a", 1)]
    want, _ = slow(tokenizers, [r[1] for r in rows])
    df = spark.createDataFrame(rows, DOCS)
    wide = df.withColumns({c: F.lit("z") for c in ("chunk", "code", "group", "freq", "codes", "counts", "a_id", "b_id", "count", "best", "most")})
    got = columns(alignment.align(wide).documents.collect())
    assert sorted(got, key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    none = alignment.align(spark.createDataFrame([], DOCS))
    assert not none.documents.count() and not none.pairs.count()
    kept = alignment.align(df, keep_groups=True).documents
    assert {hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "" for r in kept.collect()} == {w[-1] for w in want}


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("x-1", "some words"), (None, "more words")], "doc_id string, text string")
    assert {r["doc_id"] for r in alignment.align(df).documents.collect()} == {"x-1", None}


def test_byte_level_characters(tokenizers):
    want = json.load(open(alignment.BYTE_BPE, encoding="utf-8"))["model"]["vocab"]
    assert len(alignment._byte_level()) == 256 and set("".join(want)) <= set(alignment._byte_level())
    assert tokenizers.a.decode([11, 220]).encode() == tokenizers.a_bytes[11] + tokenizers.a_bytes[220]
