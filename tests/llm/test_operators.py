"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import json
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from newsweft.llm import chat, common, ctw, decontam, htmlmain, mixing, mpeg, quality, queries, sharding, simhash, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog today", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog today", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog today", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 3),
    (None, "orphan text of several words here", "en", None, 9),
    (None, None, "en", "b", None),
    (6, "é ü 𝒳   x", "de", "c", 1),
    (7, "word " * 30000, "en", "a", 150000),
    (8, "x" * 200000, "en", "a", 200000),
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """The same rows with extra columns whose names the operators use themselves."""
    return df.withColumns({c: F.lit("z") for c in ("fp", "sig", "row", "h", "size", "score", "rank", "bucket", "words", "part", "label", "target", "row_key", "id")})


# 2 SimHash


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [t for _, t, *_ in AWKWARD[:9]] + ["A B", "a b c d e A b C"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_simhash_against_brute_force(spark, sf_dir, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    fps = [slow_fingerprint(t) for _, t in rows]
    want = {i: (f"{fp:016x}", rows[c][0]) for (i, _), fp, c in zip(rows, fps, slow_components(fps))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("split", [2, 1024])
def test_links_connect_dense_groups(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    r = random.Random(5)
    fps = set()
    for _ in range(3):
        center = r.getrandbits(64)
        fps |= {center ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(60)}
    fps = sorted(fps | {r.getrandbits(64) for _ in range(40)})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(df)).collect()}
    got = collections.defaultdict(set)
    for f in signed:
        got[label.get(f, f)].add(f)
    want = collections.defaultdict(set)
    for f, c in zip(signed, slow_components(fps)):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def five_word_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(r, words, edits):
    out = list(words)
    for k in r.sample(range(len(out)), edits):
        out[k] = "".join(r.choice("abcdefgh") for _ in range(6))
    return out


def test_near_copies_against_brute_force(spark):
    """Every link is one by its shingles, and nearly all pairs of near copies are in one class, in small groups and a large one."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    texts = []
    for size, copies in [(r.randint(40, 400), 3) for _ in range(40)] + [(150, 120)]:
        base = [word() for _ in range(size)]
        texts += [" ".join(edited(r, base, r.randint(0, max(1, size // 60)))) for _ in range(copies)]
    texts += [" ".join(word() for _ in range(r.randint(1, 200))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keys = {t["k"]: t["text"] for t in docs.select(simhash._text_key(F.col("text")).alias("k"), "text").collect()}
    shingles = {k: five_word_shingles(t) for k, t in keys.items()}
    links = simhash.near_links(docs).collect()
    assert all(alike(shingles[e["a"]], shingles[e["b"]]) >= 0.8 for e in links)
    label = {e["node"]: e["label"] for e in simhash.components(spark.createDataFrame([(e["a"], e["b"]) for e in links], "a bigint, b bigint")).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(keys, 2) if alike(shingles[a], shingles[b]) >= 0.8]
    met = [label.get(a, a) == label.get(b, b) for a, b in pairs]
    assert len(pairs) > 2000 and np.mean(met) >= 0.98
    kept = {d["doc_id"] for d in simhash.keep_one(docs).collect()}
    assert len(kept) == len({label.get(k, k) for k in keys}) and 0 in kept


def test_signatures_meet_at_one_bit_a_segment(spark):
    """Fingerprints that differ in up to 15 bits of eight segments have a segment with at most one; distant ones stay apart."""
    r = random.Random(9)
    rows, signed = [], lambda v: int(np.uint64(v).astype(np.int64))
    for k in range(60):
        fp = [r.getrandbits(64) for _ in range(4)]
        near = list(fp)
        for b in r.sample(range(256), 15):
            near[b // 64] ^= 1 << b % 64
        rows += [(2 * k, *map(signed, fp)), (2 * k + 1, *map(signed, near))]
    got = {(e["a"], e["b"]) for e in simhash.candidates(spark.createDataFrame(rows, "key bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(60)}


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101)]
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_simhash_edges(awkward, empty):
    got = [tuple(r) for r in simhash.near_duplicates(clash(awkward)).collect()]
    assert len(got) == len(AWKWARD)
    assert {r[2] for r in got if r[0] in (3, 4, 5)} == {3} and {r[2] for r in got if r[0] in (1, 2)} == {1}
    kept = simhash.keep_one(clash(awkward))
    assert kept.columns == clash(awkward).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8] and ids.count(None) == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


# 3 Sharding


def test_sharding(spark, sf_dir, docs):
    got = queries.op3_sharding(spark, sf_dir).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
        raw = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    sums = [sum(r["size"] for r in rows) for rows in by.values()]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in got)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op3_sharding(spark, sf_dir).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}


def test_sharding_splits_a_hot_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = F.col("text")
    got = sharding.shard(df, sharding.text_size(text), sharding.text_group(text), F.col("doc_id")).collect()
    sums = collections.Counter()
    where = collections.defaultdict(set)
    for r in got:
        sums[r["shard"]] += len(r["text"]) + 1
        where[r["text"]].add(r["shard"])
    assert max(sums.values()) - min(sums.values()) <= 40
    assert all(len(s) == 1 for t, s in where.items() if t != "same text")


def test_sharding_partitions_add_up(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTITION_BYTES", 500)
    df = spark.createDataFrame([(i, "t" * (i % 50)) for i in range(2000)], "doc_id bigint, text string")
    text = F.col("text")
    got = sharding.shard(df, sharding.text_size(text), sharding.text_group(text), F.col("doc_id")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_with_finer_histograms(spark, monkeypatch):
    """More partitions than the first histogram settles: finer intervals, the same law."""
    monkeypatch.setattr(sharding, "PARTITION_BYTES", 40)
    monkeypatch.setattr(sharding, "MOST_PARTITIONS", 1024)
    rows = spark.range(4000).select("id", (F.col("id") % 9 + 1).alias("size"), F.xxhash64("id").alias("g"))
    got = sharding.shard(rows, F.col("size"), F.col("g"), F.col("id")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert len(got) == 4000 and set(by) == set(range(8)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 2 * 9 + 2 * 0.001 * sum(sizes) / 8


def test_sharding_edges(awkward, empty):
    text = F.col("text")
    rows = clash(awkward)
    got = sharding.shard(rows, sharding.text_size(text), sharding.text_group(text), F.col("doc_id"))
    assert got.count() == len(AWKWARD) and got.columns == [*rows.columns, "shard", "slot"]
    assert sharding.shard(empty, sharding.text_size(text), sharding.text_group(text), F.col("doc_id")).count() == 0


# 5 Chat


def test_chat_against_brute_force(spark, sf_dir):
    conv = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        conv[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    conv[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.op5_chat_formatting(spark, sf_dir).collect()}
    assert set(got) == set(conv)
    for k, turns in conv.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


NASTY = ["", "\\", "\\\\", "a\\|b", *chat.CONTROLS, "<<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nhi", "<\\|im_end|>", "line\nline\n", "𝒳é ", "[[INST]]", "x\n"]


def test_chat_escapes_are_reversible(spark):
    rows = [(i, t) for i, t in enumerate(NASTY)]
    turns = spark.createDataFrame([(i, [("assistant", t), ("us\ner" if i % 2 else "user", t), ("assistant", t)]) for i, t in rows], "conv_id int, turns array<struct<role:string,text:string>>")
    made = chat.format_chat(turns)
    for r in made.select("conv_id", "turns", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.under_mask(F.col("formatted"), F.col("loss_runs")).alias("loss")).collect():
        assert [tuple(t) for t in r["back"]] == [tuple(t) for t in r["turns"]]
        assert r["loss"] == NASTY[r["conv_id"]] * 2
        bare = r["formatted"].replace(chat.START, "").replace(chat.END, "")
        assert not any(c in bare for c in chat.CONTROLS)


def test_chat_layouts(spark):
    records = {
        "messages": {"id": 4, "messages": [{"role": "User", "content": "q"}, {"role": "assistant", "content": "a"}]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "prompt_response": {"prompt": "q", "response": "a"},
        "instruction_output": {"output": "a", "instruction": "q"},
        "question_answer": {"question": "q", "answer": "a", "meta": {"x": 1}},
        "turns": {"turns": [{"text": "q", "role": "user"}, {"text": "a", "role": "assistant"}]},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [("none", '{"other": 1}'), ("bad", "{"), ("null", None), ("empty", "{}")]
    got = {r["k"]: r for r in chat.canonical_turns(spark.createDataFrame(rows, "k string, j string"), "j").collect()}
    for k in records:
        assert got[k]["layout"] == k and [tuple(t) for t in got[k]["turns"]] == [("user", "q"), ("assistant", "a")], k
    for k in ("none", "bad", "null", "empty"):
        assert got[k]["layout"] is None and got[k]["turns"] is None


def test_chat_layouts_of_all_elements_and_depths(spark):
    ask, say = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}
    good = [
        {"messages": [ask, {"from": "gpt", "value": "a"}]},
        {"messages": [{"role": "user", "text": "q"}, {"from": "gpt", "value": "a"}]},
        {"turns": [{"from": "human", "value": "q"}, {"role": "assistant", "text": "a"}]},
        {"prompt": {"text": "q"}, "completion": "a"},
        {"prompt": {"content": "q"}, "response": {"text": "a"}, "meta": {"x": [{"y": 1}]}},
    ]
    bad = [
        {"messages": [ask, say, {"role": "user", "words": "lost"}]},
        {"messages": [ask, "lost"]},
        {"messages": [ask, {"role": "user", "content": "x", "text": "lost"}, {"from": "gpt", "value": "a"}]},
        {"messages": [ask, {"role": "user", "content": {"parts": ["lost"]}}]},
        {"prompt": {"text": "q", "more": "lost"}, "completion": "a"},
        {"prompt.text": "lost", "completion": "a"},
    ]
    rows = [(i, json.dumps(v)) for i, v in enumerate(good + bad)]
    got = {r["k"]: r for r in chat.canonical_turns(spark.createDataFrame(rows, "k int, j string"), "j").collect()}
    for i, _ in enumerate(good):
        assert got[i]["layout"] and [tuple(t) for t in got[i]["turns"]] == [("user", "q"), ("assistant", "a")], good[i]
    for i, record in enumerate(bad, len(good)):
        assert got[i]["turns"] is None, record
    deep = {"id": 1, "a": [{"b": 1}, {"c": {"d": [[2], []]}}, 3], "e": {}, 'f":{.x': "{\"g\":"}
    paths = spark.createDataFrame([(json.dumps(deep),)], "j string").select(chat._paths("j")).first()[0]
    assert paths == sorted(["a[].b", "a[].c.d[][]", "a[]", "e{}", 'f\\\\":\\{\\.x'])


def test_chat_query_formats_by_fingerprint(spark, sf_dir, monkeypatch):
    want = {r["conv_id"]: r for r in queries.op5_chat_formatting(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert {r["layout"] for r in chat.canonical_turns(chat.conversations_to_records(rows), "record").collect()} == {"turns"}
    monkeypatch.setattr(chat, "MAPPINGS", tuple(m for m in chat.MAPPINGS if m.name != "turns"))
    got = {r["conv_id"]: r for r in queries.op5_chat_formatting(spark, sf_dir).collect()}
    assert set(got) == set(want) and all(r["turns_sha256"] is None for r in got.values())


def test_chat_records_give_the_turns_of_the_rows(spark):
    rows = [(1, 1, "Human", None), (1, 0, None, "x"), (None, 0, "user", '"{\\\n\u2028\x00'), (2, None, "GPT", "5")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = {r["conv_id"]: r["turns"] for r in chat.conversations_to_turns(df).collect()}
    made = chat.canonical_turns(chat.conversations_to_records(df), "record", rename=False).collect()
    assert {r["conv_id"]: r["turns"] for r in made} == want


def test_chat_edges(spark):
    rows = [(1, 1, "user", None), (1, 0, None, "x"), (None, 0, "user", "n"), (1, 1, "user", None), (2, None, "assistant", "y" * 100000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chat(chat.conversations_to_turns(df))).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["n_turns"] == 1 and got[2]["loss_chars"] == 100000
    assert chat.digest(chat.format_chat(chat.conversations_to_turns(df.limit(0)))).count() == 0


# 6 Media


@pytest.mark.parametrize("raw", [b"", b"a", b"\xff" * 575, bytes(range(256)) * 5, b"x" * 576, b"TAG" * 400, b"\xff\xf2\xd8\xc0" * 300])
def test_mpeg_round_trip(raw):
    payload = mpeg.pad(raw)
    assert len(payload) % 576 == 0 and len(payload) >= 576 and payload.startswith(raw)
    media = mpeg.store(payload)
    s = mpeg.read(media)
    assert mpeg.stored_payload(media, s) == payload
    n = len(payload) // 576
    assert (s.frames, s.crc_good, s.crc_bad, s.skipped) == (n, n, 0, 0) and s.duration == ((n * 36) // math.gcd(n * 36, 1000), 1000 // math.gcd(n * 36, 1000))
    assert (s.vbr_kind, s.vbr_frames, len(s.vbr_toc)) == ("Info", n, 100) and s.tags["TIT2"] == "payload"
    assert mpeg.seek(s, 0) == s.offsets[0] and mpeg.seek(s, 10**6) == s.offsets[-1]


def test_mpeg_resynchronises_and_checks():
    media = bytearray(mpeg.store(mpeg.pad(b"y" * 5000)))
    whole = mpeg.read(bytes(media))
    junk = bytes(media[: whole.offsets[3]]) + b"\x00junk\xff\xfb" * 9 + bytes(media[whole.offsets[3] :])
    found = mpeg.read(junk)
    assert found.frames == whole.frames and found.skipped == 63
    media[whole.offsets[2] + 8] ^= 1
    assert mpeg.read(bytes(media)).crc_bad == 1
    assert mpeg.read(None).frames == 0 and mpeg.read(b"\xff" * 999).frames == 0 and mpeg.read(b"no audio").skipped == 8


def test_mpeg_headers():
    head = mpeg.parse_header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (head.kbps, head.rate, head.length, head.samples, head.side) == (128, 44100, 417, 1152, 32)
    assert mpeg.parse_header(bytes((0xFF, 0xFB, 0xF0, 0x00))) is None and mpeg.parse_header(b"\xff\xe8\x90\x00") is None


def test_mpeg_columns(spark, awkward, empty):
    got = mpeg.text_round_trips(clash(awkward)).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        raw = (next((t for i, t, *_ in AWKWARD if i == r["doc_id"] and i is not None), "") or "").encode() if r["doc_id"] is not None else None
        if raw is not None:
            payload = mpeg.pad(raw)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert mpeg.text_round_trips(empty).count() == 0
    media = spark.createDataFrame([(1, mpeg.store(mpeg.pad(b"q" * 2000))), (2, None)], "id int, media binary")
    read = {r["id"]: r for r in mpeg.read_column(media, "id", "media").collect()}
    assert read[1]["frames"] == 4 and len(read[1]["seek_offsets"]) == 4 and read[2]["frames"] == 0


# 7 Scoring


def test_baseline_against_brute_force(spark, sf_dir, docs):
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    count = collections.Counter()
    for i, w in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*w, b""])
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in queries.op7_lm_scoring(spark, sf_dir).collect()}
    for i, w in rows:
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in [*w, b""])
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w) + 1, sum(count[t] > 0 for t in [*w, b""]), n)
    held = [r for r in got.values() if r["held_out"]]
    assert np.mean([r["bits_per_byte"] for r in held]) < 2.6


def slow_weights(texts):
    """(counts, children, log KT and weighted log chance) of every node of all 255 context trees, node by node."""
    counts, children, weights = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(list), {}
    for text in texts:
        for decision, context, bit in decisions(text):
            for d in range(ctw.DEPTH + 1):
                counts[decision, context[ctw.DEPTH - d :]][bit] += 1
    for decision, context in counts:
        if context:
            children[decision, context[1:]].append((decision, context))
    for node in sorted(counts, key=lambda k: -len(k[1])):
        own = slow_kt(*counts[node])
        weights[node] = (own, own if len(node[1]) == ctw.DEPTH else slow_mixed(own, sum(weights[k][1] for k in children[node])))
    return counts, children, weights


def slow_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def slow_mixed(own, below):
    return float(np.logaddexp(own, below)) - math.log(2)


def decisions(text):
    data = b"\xff" * 7 + ctw.coded_text((text or "").encode())
    for p in range(7, len(data)):
        for k in range(8):
            yield (1 << k) + (data[p] >> (8 - k)), data[p - ctw.DEPTH : p], data[p] >> (7 - k) & 1


def slow_ratio(counts, children, weights, decision, context, bit):
    """How the weighted chance of the whole tree grows by one more bit: the textbook definition."""
    new = 0.0
    for d in range(ctw.DEPTH, -1, -1):
        node = (decision, context[ctw.DEPTH - d :])
        more = list(counts[node])
        more[bit] += 1
        own = slow_kt(*more)
        if d == ctw.DEPTH:
            new = own
        else:
            child = (decision, context[ctw.DEPTH - d - 1 :])
            new = slow_mixed(own, sum(weights[k][1] for k in children[node] if k != child) + new)
    return new - weights[decision, b""][1]


def slow_chance(counts, weights, decision, context, bit):
    """The mixture along the nodes of the context that training saw; the deepest of them takes the weight below it."""
    said, left, value = 0.0, 1.0, 0.5
    for d in range(ctw.DEPTH + 1):
        node = (decision, context[ctw.DEPTH - d :])
        if node not in counts:
            break
        estimate = (counts[node][1] + 0.5) / (sum(counts[node]) + 1)
        stop = 1.0 if d == ctw.DEPTH else math.exp(weights[node][0] - math.log(2) - weights[node][1])
        said, left = said + left * stop * estimate, left * (1 - stop)
        value = said + left * estimate
    return math.log(min(max(value if bit else 1 - value, 1e-9), 1.0))


@pytest.mark.parametrize("bucket, chunk", [(2_000_000, 16 << 20), (2000, 3000)])
def test_scores_against_the_whole_trees(spark, docs, monkeypatch, bucket, chunk):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: len(r[1] or ""))[:40]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    counts, children, weights = slow_weights(t for i, t in rows if i not in held)
    for name, value in {"BUCKET": bucket, "BUCKETS": 1 << 30, "CHUNK": chunk, "_BATCH": bucket // 2}.items():
        monkeypatch.setattr(ctw, name, value)
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert held and set(got) == {i for i, _ in rows}
    for i, text in rows:
        if i in held:
            want = sum(slow_chance(counts, weights, *x) for x in decisions(text))
        else:
            want = sum(slow_ratio(counts, children, weights, *x) for x in decisions(text))
        assert got[i] == pytest.approx(want / math.log(10), rel=1e-4, abs=1e-2)


def test_code_lengths_are_a_distribution():
    keys, _ = ctw.gram_keys([ctw.coded_text(b"abracadabra abba banana bandana " * 3)])
    train, n = np.unique(keys, return_counts=True)
    contexts = np.unique(train >> np.uint64(8))[:, None] << np.uint64(8)
    every = (contexts | np.arange(256, dtype=np.uint64)).ravel()
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, train)] = n
    top = ctw.weigh_top([(2, ctw.roots(every, count, 2))])
    p = np.exp(-ctw.code_lengths(every, count, 2, top)).reshape(-1, 256)
    assert np.allclose(p.sum(1), 1, atol=1e-6)


def test_packed_numbers_come_back():
    values = np.array([0, 1, 255, 256, (1 << 64) - 1, 7], np.uint64)
    assert (ctw.unpack(ctw.pack(values)) == values).all() and len(ctw.unpack(ctw.pack(values[:0]))) == 0


def test_scoring_edges(spark, awkward, empty):
    got = ctw.score(clash(awkward)).collect()
    assert len(got) == len(AWKWARD) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    blank = [r for r in got if r["doc_id"] in (3, 4, 5)]
    assert len({r["score"] for r in blank}) == 1 and {r["n_tokens"] for r in blank} == {1}
    assert ctw.score(empty).count() == 0
    held = spark.createDataFrame([(str(i), "no row trains") for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id string, text string")
    assert {(r["n_known"], r["train_tokens"], round(r["bits_per_byte"], 3)) for r in ctw.score(held).collect()} == {(0, 0, 8.0)}


# 8 Decontamination


def planted(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(3, 8)))
    prose = lambda n: [word() for _ in range(n)]
    items = {0: prose(30), 1: prose(15), 2: prose(8), 3: prose(3), 4: prose(60)}
    texts = {}
    texts[0] = prose(50) + items[0] + prose(40)
    texts[1] = prose(500) + [w.upper() + "," for w in items[1]] + prose(5)
    substituted = list(items[4])
    for k in range(0, 60, 6):
        substituted[k] = "zzz"
    texts[2] = substituted
    texts[3] = prose(9) + items[2] + prose(9)
    texts[4] = prose(20) + items[4][10:23] + prose(20)
    texts[5] = prose(300)
    texts[6] = prose(5) + items[3] + prose(5)
    texts[7] = prose(20) + items[4][10:20] + prose(20)
    texts[11] = [w.title() + "!" for w in items[3]]  # a short item is only repeated by a document of its words
    texts[12] = items[3][:2]
    texts[13] = items[3] + ["again"]
    want = {(0, 0), (1, 1), (2, 4), (3, 2), (4, 4), (11, 3)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(None, " ".join(texts[0])), (9, None), (10, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(8, None), (9, "")], "item_id bigint, text string")
    return docs, bench, want


def test_decontamination(spark, empty):
    docs, bench, want = planted(spark)
    rows = clash(docs)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(rows, clash(bench)).collect()}
    assert got == want | {(None, 0)}
    kept = decontam.clean(rows, bench)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [5, 6, 7, 9, 10, 12, 13]
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0
    long = spark.createDataFrame([(20, "plain " * 40000 + docs.filter("doc_id = 0").first()["text"])] * 2, "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(long, bench).collect()} == {(20, 0)} and decontam.clean(long, bench).count() == 0


def test_masks_meet_every_window():
    for gone in itertools.combinations(range(decontam.WINDOW), 2):
        assert any(all(o + k not in gone for k in m) for m in decontam.MASKS for o in range(decontam.WINDOW - m[-1]))


def test_decontamination_against_brute_force(spark, sf_dir, docs):
    def words(t):
        return [w for w in (x.strip(decontam._TRIM) for x in (t or "").lower().split()) if w]

    bench = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for r in docs.collect():
        w = words(r["text"])
        for i, item in bench.items():
            size = min(decontam.WINDOW, len(item))
            starts = {tuple(item[k : k + 3]) for k in range(len(item) - 2)}
            near = [p for p in range(len(w) - 2) if tuple(w[p : p + 3]) in starts]
            if near and any(sum(a == b for a, b in zip(w[p : p + size], item[k : k + size])) >= 0.8 * size for q in near for p in range(max(0, q - size), q + 1) for k in range(len(item) - size + 1) if p + size <= len(w)):
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_benchmark_decontamination(spark, sf_dir).collect()}
    assert got == want


# 10 Mixing


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, sf_dir, docs):
    rows = docs.select("doc_id", "source", "text").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    want = slow_targets(sizes)
    got = queries.op10_mixing(spark, sf_dir).collect()
    source = {r["doc_id"]: r["source"] for r in rows}
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        assert (r["position"] is not None) == (r["taken"] > 0) and (r["position"] is None or 0 <= r["position"] <= 1)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    positions = [r["position"] for r in got if r["position"] is not None]
    assert len(got) == len(rows) and positions == sorted(positions)
    again = {r["doc_id"]: (r["taken"], r["position"]) for r in queries.op10_mixing(spark, sf_dir).collect()}
    assert again == {r["doc_id"]: (r["taken"], r["position"]) for r in got}


def test_curriculum_inverts_its_schedule(spark):
    for schedule in (*mixing.SCHEDULES, (1.0, 3.0), (0.0, 1.0, 0.0)):
        knots = np.linspace(0, 1, len(schedule))
        fine = np.linspace(0, 1, 20001)
        mass = np.cumsum(np.interp(fine, knots, schedule))
        mass /= mass[-1]
        at = [0.01, 0.2, 0.5, 0.77, 0.99]
        got = spark.createDataFrame([(a,) for a in at], "u double").select(mixing.when_demanded(F.col("u"), schedule).alias("t"))
        assert [r["t"] for r in got.collect()] == pytest.approx([float(np.interp(a, mass, fine)) for a in at], abs=2e-3)


def test_mixing_edges(awkward, empty):
    rows = clash(awkward)
    got = mixing.mix(rows).collect()
    assert len(got) == len(AWKWARD) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixture(rows).columns == rows.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixture(empty).count() == 0


# 1 and 9 Classifiers


def synthetic(spark, n=600):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.3
        w = [word() for _ in range(r.randint(8, 60))]
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + r.choice(["###", "$$$"]) for x in w]
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["idiot", "moron.", "grozzle" + word()])
        docs.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_classifiers_hold_out(spark, module, label, least):
    docs, labels = synthetic(spark)
    got = module.classify(clash(docs), labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 100 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == r[label] for r in got]) >= least
    held = {r["doc_id"] for r in got}
    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_learn_from_no_held_out_label(spark, module):
    docs, labels = synthetic(spark, 200)
    column = "quality" if module is quality else "toxic"
    flipped = labels.withColumn(column, F.when(common.is_held_out(), 1 - F.col(column)).otherwise(F.col(column)))
    scores = [{r["doc_id"]: round(r["score"], 9) for r in module.classify(docs, x).collect()} for x in (labels, flipped)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_edges(spark, awkward, empty, module):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (7, None, None), (8, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = module.classify(clash(awkward), labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert module.classify(empty, labels).count() == 0
    assert module.classify(awkward, labels.limit(0)).count() == len(AWKWARD)


def test_toxicity_without_labels_flags_by_the_lexicon(spark):
    plain = "the report says that sales of the company rose in the last quarter and that it hired more people number"
    rows = [(i, f"{plain} {i}" + (" you stupid worthless idiot" if i % 10 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.classify(spark.createDataFrame(rows, "doc_id bigint, text string"), labels).collect()
    assert len(got) == 300 and all(r["predicted"] == (r["doc_id"] % 10 == 0) for r in got)


def test_every_voter_has_its_table(spark, monkeypatch):
    words = [*toxicity.LEXICON, *("".join(x) + "zz" for x in itertools.product("bcdf", "aeiou", "klmn"))]
    voters = toxicity.Voters(pa.array(words, pa.large_string()), tuple((n, pa.array([], pa.large_string())) for n in toxicity.STEM_LENGTHS))
    monkeypatch.setattr(toxicity, "mine", lambda sample, clean: voters)
    rows = [(i, f"the report says that sales rose {i} {words[i // 2 % len(words)] if i % 2 else ''}", i % 2) for i in range(10 * len(words))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")).label_model
    assert len(model.tables) == len(words) + 5 > 64 + 5
    assert all(model.tables[j, 1, 1, 2] > model.tables[j, 0, 1, 2] for j in range(len(words)) if model.parent[j] < 0)


def test_toxicity_posteriors_come_from_votes_alone(spark, monkeypatch):
    """Flipping the labels of some training rows changes neither the label model nor the order of the scores."""
    docs, labels = synthetic(spark)
    fixed = toxicity.Voters(pa.array(toxicity.LEXICON, pa.large_string()), tuple((n, pa.array([], pa.large_string())) for n in toxicity.STEM_LENGTHS))
    monkeypatch.setattr(toxicity, "mine", lambda sample, clean: fixed)
    some = labels.filter(~common.is_held_out()).orderBy(F.xxhash64("doc_id")).limit(40).select("doc_id", "toxic").collect()
    pairs = {1: [r["doc_id"] for r in some if r["toxic"] == 1][:4], 0: [r["doc_id"] for r in some if r["toxic"] == 0][:4]}
    n = min(map(len, pairs.values()))
    flipped = labels.withColumn("toxic", F.when(F.col("doc_id").isin([i for v in pairs.values() for i in v[:n]]), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert n and np.allclose(one.label_model.tables, two.label_model.tables) and np.allclose(one.weights[:-1], two.weights[:-1])


def test_classifier_queries_hold_out(spark):
    """The queries themselves, on rows whose labels they may not learn from."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for query, label, least in ((queries.op1_quality_classifier, "quality", 0.9), (queries.op9_toxicity, "toxic", 0.9)):
        got = query(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
        assert len(got) > 30 and np.mean([r["predicted"] == r[label] for r in got]) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_ids_of_any_type_and_blank_texts_alike(spark, module):
    docs, labels = synthetic(spark, 200)
    blank = spark.createDataFrame([(900, None), (901, ""), (902, " ")], "doc_id bigint, text string")
    all_ = docs.select("doc_id", "text").union(blank)
    for kind in ("int", "string"):
        got = {str(r["doc_id"]): r["score"] for r in module.classify(all_.withColumn("doc_id", F.col("doc_id").cast(kind)), labels.withColumn("doc_id", F.col("doc_id").cast(kind))).collect()}
        assert len(got) == 203 and len({round(got[k], 12) for k in ("900", "901", "902")}) == 1


def test_label_model_finds_accuracies_and_ties():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    flip = lambda p: np.where(r.random(4000) < p, ~y, y)
    a, b, c = flip(0.05), flip(0.2), flip(0.3)
    copy = np.where(r.random(4000) < 0.05, ~c, c)
    ballots = np.where(np.stack([a, b, c, copy], 1), 1, -1)
    model, q = toxicity.fit_label_model(ballots, 0.3)
    assert np.mean((q > 0.5) == y) > 0.9
    tied = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0}
    assert frozenset((2, 3)) in tied
    accuracy = model.accuracies(ballots, q)
    assert accuracy[0] > accuracy[1] > 0.7


# 4 HTML


CASES = [
    (
        '<html><head><title>x</title></head><body><header><a href=/>Site</a><nav><ul><li><a>Home</a></li></ul></nav></header><div id="cookie-notice"><p>We use cookies to improve your experience on this site.</p></div>'
        '<main><article><header><h1>Big title &amp; more</h1></header><p>First paragraph with <b>bold</b>\n text&nbsp;here and more words to come.</p><div class="advert">Buy now!</div><p>Short.<ul><li>One item<li>Two item</ul>'
        "<form><p>Subscribe to our newsletter</p></form><p>Last &lt;b&gt;.</p></article><aside class=sidebar><h3>Related</h3><ul><li><a>Other story</a></li></ul></aside>"
        '<section class="comments"><h2>Comments</h2><div class="comment"><p>I think this is a great long article and I agree with all of it.</p></div></section></main><footer><p>Copyright</p></footer></body></html>',
        "Big title & more\nFirst paragraph with bold text here and more words to come.\nShort.\nOne item\nTwo item\nLast <b>.",
    ),
    ('<div class="menu"><a>a</a></div><div id="content"><div class="post"><h2>Head</h2><p>Body text goes here and it is long enough for a body.</p><p>x</p></div></div><div class="sidebar"><p>A sidebar with quite a lot of text but not main.</p></div><div id="footer">foot</div>', "Head\nBody text goes here and it is long enough for a body.\nx"),
    ("<article><h1>T</h1><p>Unclosed <script>var a='<p>no</p>';</script>text<!-- gone --></article><footer>f", "T\nUnclosed text"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("source, text", CASES)
def test_html(source, text):
    assert htmlmain.extract(source) == text


@pytest.mark.parametrize("tag", ["button", "video", "audio", "object", "canvas", "svg", "math", "iframe", "template", "select", "noscript", "datalist"])
def test_html_unclosed_elements_end_with_the_next_block(tag):
    words = "A long enough paragraph of the article, with a clause or two and words of several kinds in it. " * 4
    for page in (
        f"<body><div><{tag} class=x>Menu</div><article><p>{words}</p><p>{words}</p></article><div><{tag}>Menu</{tag}></div></body>",
        f"<body><article><{tag} class=x>Menu<p>{words}</p><p>{words}</p></article></body>",
        f"<body><article><{tag} class=x><div><p>Menu</p></div></{tag}><p>{words}</p><p>{words}</p></article></body>",
    ):
        got = " ".join(run for _, run in htmlmain.parse(page).runs)
        assert got.count("A long enough") == 8 and "Menu" not in got, page


def test_html_names_count_to_their_end():
    many = " ".join(f"px-{i} my-{i}" for i in range(60))
    kinds = [k for k, _ in htmlmain._KINDS]
    for names, kind in ((f'class="{many} comments"', "comment"), (f'class="{many}" id="sidebar"', "side"), (f'class="{many}" role="article-body"', "content")):
        assert kinds[htmlmain.parse(f"<div {names}>x</div>").kind[1]] == kind


def test_html_pages(spark, sf_dir):
    import html
    import re

    got = {r["page_id"]: r for r in queries.op4_html_extraction(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inside = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[p["page_id"]]["text"] == "\n".join(b for b in blocks if b) and got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_html_marginals_match_enumeration():
    page = htmlmain.parse('<div><p>some words in here</p><div class="ad"><p>buy</p></div></div>')
    m = htmlmain.default_model()
    n = len(page.parent)
    total, one = 0.0, [0.0] * n
    for ys in itertools.product((0, 1), repeat=n):
        p = m.root[ys[0]]
        for i in range(n):
            if i:
                p *= m.edge[htmlmain._edge(page.kind[i], page.group[i])][ys[page.parent[i]]][ys[i]]
            p *= m.emit[0][page.group[i]][ys[i]] * m.emit[1][page.kind[i]][ys[i]] * m.emit[2][htmlmain._size_bin(page.chars[i], page.linked[i])][ys[i]]
        total += p
        for i in range(n):
            one[i] += p * ys[i]
    assert m.marginals(page) == pytest.approx([x / total for x in one], rel=1e-6)


def test_html_held_out_runs():
    wrong = n = 0
    for source in htmlmain.labelled_pages(150, seed=99):
        page = htmlmain.parse(source, labelled=True)
        inside = htmlmain.default_model().marginals(page)
        for i, p in enumerate(page.parent):
            page.label[i] = page.label[i] if page.label[i] >= 0 else page.label[p] if p >= 0 else 0
        for at, _ in page.runs:
            n, wrong = n + 1, wrong + ((inside[at] > 0.5) != page.label[at])
    assert wrong / n < 0.05


@pytest.mark.parametrize("extra", ['data-y="x"', "data-y", 'data-y="1.5"', 'data-y="0"', "data-y='1'", 'DATA-Y="0"'])
def test_html_pages_cannot_label_themselves(extra):
    page = f'<body><nav {extra}>menu here</nav><article {extra}><p {extra}>A sentence of the article, long enough to read as one of its paragraphs.</p></article></body>'
    assert htmlmain.extract(page) == htmlmain.extract(page.replace(f" {extra}", "")) != ""


def test_html_time_grows_with_the_page():
    took = []
    for n in (20000, 80000):
        began = time.perf_counter()
        htmlmain.extract("<a " * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.02)


def test_html_edges(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>" + "x " * 50000), (3, "u", "<div" + ' "' * 2000), (4, "u", "</p></div>plain"), (4, "u", "<" * 5000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = htmlmain.extract_pages(df).collect()
    assert len(got) == 6 and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)
