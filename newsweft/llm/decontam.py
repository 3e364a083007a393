"""Benchmark decontamination by spaced seeds.

Two fixed masks over word positions each hash six words of a window and ignore the others; every window of WINDOW
words with at most a fifth of them substituted agrees with its source under one of the masks.  Test hashes are put
into a bitmap of fixed size, which the training side passes before anything leaves a task; what is left is joined with
the test hashes, and the overlap around each hit is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import bitmap_of, freeing, in_bitmap, materialise, slabs, with_fresh_name, word_hashes, words_of

#: Any WINDOW words with at most two substituted have an offset at which one mask sees only words that agree.
MASKS = ((0, 1, 2, 3, 4, 6), (0, 2, 3, 7, 8, 9))
WINDOW, SIMILARITY, SHORTEST = 13, 0.8, 5
_TRIM = "!?.,;:%$#&*|\"'()[]{}<>-_+=/\\~`@^«»“”„¿¡"
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Tells the hash of a whole short text from that of a window with as many words.
_WHOLE = np.uint64(0xD6E8FEB86659FD93)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of each word: lower-cased, without marks around it; words of marks alone don't count."""
    docs, codes, distinct = words_of(pc.utf8_lower(texts))
    if not len(docs):
        return docs, np.zeros(0, np.int64)
    bare = pc.utf8_trim(distinct, characters=_TRIM)
    some = np.asarray(pc.binary_length(bare)) > 0
    keep = some[codes]
    return docs[keep], word_hashes(bare)[codes][keep]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of each window under ``mask``: one less than its span fewer than words. It differs between masks."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    w, out = words.view(np.uint64), np.full(n, len(mask) * 256 + mask[-1], np.uint64)
    with np.errstate(over="ignore"):
        for k in mask:
            out = out * _ODD + (w[k : k + n] ^ (w[k : k + n] >> np.uint64(33)))
        return _mixed(out)


def short_blocks(n: int) -> tuple[int, int]:
    """(blocks, words in each) of an item with ``n`` words, fewer than WINDOW: one block stays whole for any substitutions allowed."""
    blocks = int(n * (1 - SIMILARITY) + 1e-9) + 1
    return blocks, n // blocks


def _item_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(words) >= WINDOW:
        all_ = [seed_hashes(words, m) for m in MASKS]
        return np.concatenate([np.arange(len(h)) for h in all_]), np.concatenate(all_)
    if len(words) < SHORTEST:
        whole = seed_hashes(words, tuple(range(len(words)))) ^ _WHOLE if len(words) else np.zeros(0, np.uint64)
        return np.zeros(len(whole), np.int64), whole
    blocks, size = short_blocks(len(words))
    at = np.arange(blocks) * size
    return at, seed_hashes(words, tuple(range(size)))[at]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id")
        for start, texts in slabs(batch.column("text")):
            docs, words = tokens(texts)
            cuts = np.searchsorted(docs, np.arange(len(texts) + 1))
            each = [words[a:b] for a, b in zip(cuts, cuts[1:])]
            seeds = [_item_seeds(w) for w in each]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, len(texts)),
                    pa.array([w.tolist() for w in each], pa.list_(pa.int64())),
                    pa.array([p.tolist() for p, _ in seeds], pa.list_(pa.int32())),
                    pa.array([h.view(np.int64).tolist() for _, h in seeds], pa.list_(pa.int64())),
                ],
                ["item_id", "words", "at", "hash"],
            )


def _regions(bitmap, masks: tuple[tuple[int, ...], ...]):
    """For each stretch of a text with hits: its words with a margin of WINDOW, and the places and hashes of the hits."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            for start, texts in slabs(batch.column("text")):
                docs, words = tokens(texts)
                at, hashes = [], []
                for mask in masks:
                    h = seed_hashes(words, mask)
                    whole = docs[: len(h)] == docs[mask[-1] :][: len(h)]
                    near = in_bitmap(bits, h)
                    near = near[whole[near]]
                    at.append(near)
                    hashes.append(h[near])
                first = np.searchsorted(docs, np.arange(len(texts)))
                size = np.diff(np.r_[first, len(docs)])
                for n in range(1, SHORTEST):
                    begin = first[size == n]
                    if len(begin):
                        h = seed_hashes(words, tuple(range(n)))[begin] ^ _WHOLE
                        near = in_bitmap(bits, h)
                        at.append(begin[near])
                        hashes.append(h[near])
                at_, hashes_ = np.concatenate(at), np.concatenate(hashes)
                if not len(at_):
                    continue
                order = np.argsort(at_, kind="stable")
                at_, hashes_ = at_[order], hashes_[order]
                cut = np.flatnonzero((np.diff(at_) > 2 * WINDOW) | (docs[at_[1:]] != docs[at_[:-1]])) + 1
                rows: list[list] = [[], [], [], []]
                for a, b in zip(np.r_[0, cut], np.r_[cut, len(at_)]):
                    doc = docs[at_[a]]
                    first, last = np.searchsorted(docs, [doc, doc + 1])
                    low, high = max(first, at_[a] - WINDOW), min(last, at_[b - 1] + 2 * WINDOW)
                    rows[0].append(start + int(doc))
                    rows[1].append(words[low:high].tolist())
                    rows[2].append((at_[a:b] - low).tolist())
                    rows[3].append(hashes_[a:b].view(np.int64).tolist())
                of = pa.array(rows[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(of), batch.column("row_key").take(of), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.list_(pa.int32())), pa.array(rows[3], pa.list_(pa.int64()))],
                    ["doc_id", "row_key", "words", "at", "hash"],
                )

    return step


def overlap(text: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int]:
    """(words, words that agree) of the windows along a diagonal that agree enough; (0, 0) if there is none.

    Word j of the item stands at j + diagonal in the text. A window has WINDOW words, or the whole of a shorter item.
    """
    low, high = max(0, -diagonal), min(len(item), len(text) - diagonal)
    size = min(WINDOW, len(item))
    if high - low < size:
        return 0, 0
    same = (item[low:high] == text[low + diagonal : high + diagonal]).astype(np.int64)
    sums = np.cumsum(np.r_[0, same])
    good = np.flatnonzero(sums[size:] - sums[:-size] >= SIMILARITY * size - 1e-9)
    if not len(good):
        return 0, 0
    covered = np.zeros(len(same) + 1, np.int64)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + size, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return int(inside.sum()), int(same[inside].sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, items = batch.column("words"), batch.column("item_words")
        got = [overlap(np.asarray(texts[i].values), np.asarray(items[i].values), d) for i, d in enumerate(batch.column("diagonal").to_pylist())]
        ok = np.flatnonzero([n > 0 for n, _ in got])
        take = pa.array(ok.astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(take) for c in ("doc_id", "row_key", "item_id")), pa.array([got[i][0] for i in ok], pa.int32()), pa.array([got[i][1] for i in ok], pa.int32())],
            ["doc_id", "row_key", "item_id", "n_words", "n_same"],
        )


def _row_key():
    return F.xxhash64("doc_id", "text")


def _matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_id, n_words, n_same): one row for each verified diagonal."""
    kind = {c: t for c, t in [*docs.dtypes, *benchmark.dtypes] if c in ("doc_id", "item_id")}
    items = benchmark.select("item_id", "text").mapInArrow(_items, f"item_id {kind['item_id']}, words array<bigint>, at array<int>, hash array<bigint>")
    items = materialise(items.withColumn("iid", F.monotonically_increasing_id()), "benchmark-items")
    seeds = materialise(items.select("iid", F.explode(F.arrays_zip("at", "hash")).alias("s")).select("iid", F.col("s.at").alias("item_at"), "s.hash"), "benchmark-seeds")
    lengths = items.filter((F.size("words") < WINDOW) & (F.size("words") >= SHORTEST)).select(F.size("words").alias("n")).distinct().collect()
    masks = MASKS + tuple(sorted({tuple(range(short_blocks(r["n"])[1])) for r in lengths}))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(seeds, "hash"))
    found = docs.select("doc_id", _row_key().alias("row_key"), "text").mapInArrow(freeing(_regions(shared, masks)), f"doc_id {kind['doc_id']}, row_key bigint, words array<bigint>, at array<int>, hash array<bigint>")
    regions = materialise(found.withColumn("rid", F.monotonically_increasing_id()), "benchmark-regions")
    hits = regions.select("rid", F.explode(F.arrays_zip("at", "hash")).alias("s")).select("rid", F.col("s.at").alias("doc_at"), "s.hash")
    # Spark takes the exploded side for as small as its input and might broadcast it.
    lines = hits.join(seeds.hint("merge"), "hash").select("rid", "iid", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).distinct()
    full = lines.join(regions.select("rid", "doc_id", "row_key", "words"), "rid").join(items.select("iid", "item_id", F.col("words").alias("item_words")), "iid")
    return full.select("doc_id", "row_key", "item_id", "words", "item_words", "diagonal").mapInArrow(_verify, f"doc_id {kind['doc_id']}, row_key bigint, item_id {kind['item_id']}, n_words int, n_same int")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_same, similarity): each document with each item that it repeats, best overlap first.

    A document repeats an item when some WINDOW successive words, or the whole of a shorter item, agree in at least
    SIMILARITY of the places, substitutions allowed, insertions not. An item of fewer than SHORTEST words is only
    repeated by a document that consists of its words. A document of any length is read whole; of overlaps of equal
    length the one with more equal words counts; an empty table on either side gives an empty result.
    Null and empty texts on either side never match; repeated rows and ids give one row for each pair; other columns
    are not read.
    """
    best = _matches(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_same")).alias("o"))
    return best.select("doc_id", "item_id", "o.n_words", "o.n_same", (F.col("o.n_same") / F.col("o.n_words")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat an item of ``benchmark``, with all columns; rows with null ids or texts stay if clean."""
    key = with_fresh_name(docs, "row_key")
    bad = materialise(_matches(docs, benchmark).select(F.col("row_key").alias(key)).distinct(), "benchmark-rows")
    return docs.withColumn(key, _row_key()).join(bad, key, "left_anti").select(*docs.columns)
