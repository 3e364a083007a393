"""Language-model scores by context-tree weighting over byte contexts, beside a unigram baseline.

A text is coded as its lower-cased words, each ended by a space, and an end symbol.  Each byte is eight binary
decisions, and each of the 255 decisions has a context tree over the DEPTH bytes before it, across words and from the
text's beginning on.  A node has a Krichevsky-Trofimov estimate; the estimates of all depths are mixed by context-tree
weighting.  No context is left out, however rare: the model grows with the corpus and lives in a table.

The work is dealt by context, not by text.  A task turns a chunk of text into its distinct grams (context and byte) in
order of the context read backwards, with their counts, packed as columns.  Ranges of contexts become buckets of
bounded size; a bucket merges all chunks' counts, weighs its subtrees, and, when the driver has weighed the few nodes
above all buckets, gives every chunk the code lengths of the grams it asked for.  Words of the baseline go the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import byte_hashes, is_held_out, materialise, release, words_of

END = 255
MODULUS = 7
#: Bytes of context, seven at most: a gram is one 64-bit key.
DEPTH = 7
#: Coded bytes of a chunk and of a block of it, or one longer text.
CHUNK, BLOCK = 14 << 20, 2 << 20
#: Distinct grams of all chunks that a bucket takes, and the number of buckets beyond which each takes more.
BUCKET, BUCKETS = 2_000_000, 4096
#: Tasks that score chunks, one chunk after the other.
MOST_TASKS = 100_000
#: Ranges of contexts are cut by their last two bytes, and by up to this many where more than a bucket's share have them.
MOST_CUT = 4
#: Grams that a bucket weighs at a time, at most, unless one range has more.
_BATCH = 1 << 19
_PIECE = 1 << 20
#: Keys that are merged at a time.
_RANGE = 1 << 18
#: Code lengths travel as whole multiples of 2**-9 nats.
_GRAIN = 512.0
_TABLE = 1 << 16
TEXT, GRAMS, WORDS = 0, 1, 2
_END_KEY = np.uint64(0)
PIECES = "chunk bigint, kind tinyint, part int, n int, keys binary, counts binary, sizes array<int>, held array<boolean>"


# Columns of whole numbers as bytes


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def _doubles(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, np.float64).tobytes())


def _undouble(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.float64)


# Chunks


def coded_text(text: bytes) -> bytes:
    """Each lower-cased word with a space after it, and the end symbol."""
    words = text.lower().split()
    return b" ".join(words) + b" \xff" if words else b"\xff"


def gram_keys(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of each coded byte, where each text begins). The last byte of the context is highest, the coded byte lowest.

    End symbols stand for what would come before a text.
    """
    data = b"\xff" * 7 + (b"\xff" * 6).join(coded)
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    begin = np.cumsum(np.r_[0, lengths[:-1]])
    # Eight bytes that end at each place, the last of them turned from the top to the bottom.
    ending = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    keys = (ending << np.uint64(8)) | (ending >> np.uint64(56))
    if DEPTH < 7:
        keys &= np.uint64(0xFF | ((1 << 8 * DEPTH) - 1) << 8 * (8 - DEPTH))
    if len(coded) > 1:
        keys = np.delete(keys, (np.cumsum(lengths + 6)[:-1, None] - np.arange(6, 0, -1)).ravel())
    return keys, begin


def _distinct(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)


def _pressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(5, window_log=25, enable_ldm=True)).compress(data)


def _blocks(coded: list[bytes], most: int | None = None) -> Iterator[slice]:
    """Neighbouring texts with some BLOCK bytes together, or ``most``, or one longer text."""
    ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
    a = 0
    while a < len(coded):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (most or BLOCK), "right")))
        yield slice(a, b)
        a = b


def _argsort(keys: np.ndarray) -> np.ndarray:
    """An order of the keys, by their lower and then their upper bits: two sorts of numbers that carry places beat one argsort."""
    if len(keys) > 1 << 22:
        return np.argsort(keys)
    shift, places = np.uint64(22), np.arange(len(keys), dtype=np.uint64)
    low = (keys << shift) | places
    low.sort()
    order = (low & np.uint64((1 << 22) - 1)).astype(np.int64)
    high = (keys[order] >> np.uint64(42) << shift) | places
    high.sort()
    return order[(high & np.uint64((1 << 22) - 1)).astype(np.int64)]


def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, place of each key among them)."""
    order = _argsort(keys)
    keys = keys[order]
    first = _distinct(keys)
    new, place = np.zeros(len(keys), np.int32), np.empty(len(keys), np.int32)
    new[first[1:]] = 1
    place[order] = np.cumsum(new, dtype=np.int32)
    return keys[first], place


def _sorted_distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[_distinct(keys)]


def _union(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct keys of sorted parts; a stable sort merges runs."""
    keys = np.concatenate(parts)
    keys.sort(kind="stable")
    return keys[_distinct(keys)]


def _words(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, place of its hash, hashes in order) of a block; the end symbol of each text is a word too."""
    docs, codes, words = words_of(pa.array([c[:-1] for c in coded], pa.large_binary()).cast(pa.large_string()))
    hashes, place = _placed(np.r_[byte_hashes(words), _END_KEY])
    return np.r_[docs, np.arange(len(coded))], np.r_[place[codes], np.full(len(coded), place[-1])], hashes


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (keys, numbers) of all parts with the numbers of equal keys added, a range of keys at a time."""
    longest = max((k for k, _ in parts), key=len)
    cuts = longest[_RANGE // len(parts) or 1 :: max(1, _RANGE // len(parts))]
    edges = [np.r_[0, np.searchsorted(k, cuts), len(k)] for k, _ in parts]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(len(cuts) + 1):
        keys = np.concatenate([k[e[r] : e[r + 1]] for (k, _), e in zip(parts, edges)])
        if len(keys):
            n = np.concatenate([c[e[r] : e[r + 1]] for (_, c), e in zip(parts, edges)])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = _distinct(keys)
            out.append((keys[first], np.add.reduceat(n[order], first)))
    if not out:
        return longest, np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in out]), np.concatenate([c for _, c in out])


def _counted(coded: list[bytes], held: list[bool]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(distinct grams in order, their counts in training texts), and the same of word hashes."""
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    words: list[tuple[np.ndarray, np.ndarray]] = []
    for block in _blocks(coded):
        keys, _ = gram_keys(coded[block])
        out = np.array(held[block])
        apart = np.repeat(out, [len(c) for c in coded[block]])
        for part, weight in ((keys[~apart], 1), (keys[apart], 0)):
            part.sort()
            first = _distinct(part)
            grams.append((part[first], (np.diff(np.r_[first, len(part)]) * weight).astype(np.int32)))
        docs, place, hashes = _words(coded[block])
        words.append((hashes, np.bincount(place, ~out[docs], len(hashes)).astype(np.int64)))
    return _merged(grams), _merged(words)


def _chunk_rows(chunk: int, held: list[bool], coded: list[bytes], ids: pa.Array) -> pa.RecordBatch:
    rows: list[tuple] = [(chunk, TEXT, 0, len(coded), _pressed(b"".join(coded)), b"", list(map(len, coded)), held)]
    for kind, bits, (found, n) in zip((GRAMS, WORDS), (8, 4), _counted(coded, held)):
        cuts = np.r_[np.searchsorted(found, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(found)]
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[part], cuts[part + 1]
            rows.append((chunk, kind, part, int(b - a), pack(found[a:b]), pack(n[a:b]), None, None))
    kinds = [pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
    of_rows = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    columns.append(pa.concat_arrays([of_rows, pa.nulls(len(rows) - 1, of_rows.type)]))
    return pa.RecordBatch.from_arrays(columns, ["chunk", "kind", "part", "n", "keys", "counts", "sizes", "held", "ids"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of text into chunks: their texts, grams and words. A task's chunks are numbered on from its partition."""
    made, base, size = 0, TaskContext.get().partitionId() << 32, 0
    coded: list[bytes] = []
    held: list[bool] = []
    ids: list[pa.Array] = []

    def flush() -> Iterator[pa.RecordBatch]:
        out = _chunk_rows(base + made, held, coded, pa.concat_arrays(ids))
        for part in (coded, held, ids):
            part.clear()
        for a in range(0, out.num_rows, 16):
            yield out.slice(a, 16)

    for batch in batches:
        column, flags, last = pc.fill_null(batch.column("text"), "").cast(pa.binary()), batch.column("held_out").to_pylist(), 0
        for i in range(batch.num_rows):
            now = coded_text(column[i].as_py())
            if coded and size + len(now) > CHUNK:
                ids.append(batch.column("doc_id").slice(last, i - last))
                yield from flush()
                release()
                made, size, last = made + 1, 0, i
            coded.append(now)
            held.append(flags[i])
            size += len(now)
        ids.append(batch.column("doc_id").slice(last))
    if coded:
        yield from flush()
    release()


# Ranges of keys


@dataclass
class Ranges:
    """Where each bucket begins, the context bytes that its nodes have in common, and how many buckets hold grams."""

    starts: np.ndarray
    depths: list[int]
    grams: int


def _prefix_counts(bytes_: int, inside: np.ndarray | None):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            for data in batch.column("keys"):
                prefix = unpack(data.as_py()) >> np.uint64(64 - 8 * bytes_)
                if inside is not None:
                    prefix = prefix[np.isin(prefix >> np.uint64(8), inside)]
                first = _distinct(prefix)
                for p, n in zip(prefix[first].tolist(), np.diff(np.r_[first, len(prefix)]).tolist()):
                    found[p] = found.get(p, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["prefix", "n"])

    return step


def find_ranges(pieces: DataFrame) -> Ranges:
    """Buckets of neighbouring nodes from the exact numbers of grams in all chunks; a node with more than its share is cut a byte deeper."""
    sums = {r["kind"]: r["n"] for r in pieces.filter(F.col("kind") != TEXT).groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    share = max(BUCKET, sums.get(GRAMS, 0) // BUCKETS)
    nodes: list[tuple[int, int, int]] = []
    inside: np.ndarray | None = None
    grams = pieces.filter(F.col("kind") == GRAMS)
    for depth in range(2, MOST_CUT + 1):
        rows = grams if inside is None else grams.filter(F.col("part").isin(sorted({int(p) >> 8 * (depth - 2) for p in inside})))
        counted = rows.select("keys").mapInArrow(_prefix_counts(depth, inside), "prefix bigint, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")).collect()
        hot = [r["prefix"] for r in counted if r["n"] > share] if depth < min(MOST_CUT, DEPTH) else []
        nodes += [(r["prefix"] << 64 - 8 * depth, depth, r["n"]) for r in counted if r["prefix"] not in set(hot)]
        if not hot:
            break
        inside = np.array(sorted(hot), np.uint64)
    starts: list[int] = []
    depths: list[int] = []
    held = 0
    for start, depth, n in sorted(nodes):
        if not starts or depth != depths[-1] or held + n > share:
            starts.append(start)
            depths.append(depth)
            held = 0
        held += n
    return Ranges(np.array(starts, np.uint64), depths, len(starts))


def _word_buckets(pieces: DataFrame) -> int:
    n = pieces.filter(F.col("kind") == WORDS).agg(F.sum("n").alias("n")).first()["n"] or 0
    return 1 << max(0, min(n // BUCKET, BUCKETS).bit_length())


def _deal(ranges: Ranges, word_bits: int):
    """Pieces of chunks cut at the buckets' boundaries."""
    words = np.arange(1 << word_bits, dtype=np.uint64) << np.uint64(64 - word_bits) if word_bits else np.zeros(1, np.uint64)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = unpack(row["keys"])
                counts = unpack(row["counts"]) if row["counts"] else None
                starts, base = (ranges.starts, 0) if row["kind"] == GRAMS else (words, ranges.grams)
                low, high = np.searchsorted(starts, keys[[0, -1]], "right") - 1
                cuts = np.r_[0, np.searchsorted(keys, starts[low + 1 : high + 1]), len(keys)]
                out = [(base + low + k, int(a), int(b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                whole = len(out) == 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(k) for k, _, _ in out], pa.int32()), pa.array([1] * len(out), pa.int8()), pa.array([row["chunk"]] * len(out), pa.int64()), pa.array([row["part"]] * len(out), pa.int32()),
                        pa.array([row["keys"] if whole else pack(keys[a:b]) for _, a, b in out], pa.binary()),
                        pa.array([b"" if counts is None else row["counts"] if whole else pack(counts[a:b]) for _, a, b in out], pa.binary()),
                    ],
                    ["bucket", "step", "chunk", "part", "keys", "counts"],
                )

    return step


DEALT = "bucket int, step tinyint, chunk bigint, part int, keys binary, counts binary"


# Context-tree weighting


@cache
def _lgamma_tables() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(_TABLE - 1, dtype=np.float64)
    return np.r_[0.0, np.cumsum(np.log(n + 0.5))] + math.lgamma(0.5), np.r_[0.0, np.cumsum(np.log(n + 1.0))]


def _lgamma(n: np.ndarray, add: float) -> np.ndarray:
    """log gamma of whole numbers plus 0.5 or 1; Stirling's series beyond the table."""
    out = _lgamma_tables()[0 if add == 0.5 else 1][np.minimum(n, _TABLE - 1)]
    far = np.flatnonzero(n >= _TABLE)
    if len(far):
        x = n[far] + add
        out[far] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros, 0.5) + _lgamma(ones, 0.5) - _lgamma(zeros + ones, 1.0) - math.log(math.pi)


def _stop(own: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """The weight that a node with children keeps for its own estimate."""
    return np.exp(np.minimum(own - math.log(2) - mixed, 0.0))


@dataclass
class _Depth:
    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    own: np.ndarray
    mixed: np.ndarray
    up: np.ndarray | None = None


def _lifted(below: _Depth, depth: int) -> _Depth:
    """The nodes at ``depth`` above sorted ones at depth + 1, each with the counts and weighted chances of its children."""
    short = below.keys >> np.uint64(8 * (7 - depth))
    first = _distinct(short)
    zeros, ones = np.add.reduceat(below.zeros, first), np.add.reduceat(below.ones, first)
    own = log_kt(zeros, ones)
    mixed = np.logaddexp(own, np.add.reduceat(below.mixed, first)) - math.log(2)
    up = np.zeros(len(short), np.int32)
    up[first[1:]] = 1
    below.up = np.cumsum(up, dtype=np.int32)
    return _Depth(short[first] << np.uint64(8 * (7 - depth)), zeros, ones, own, mixed)


def _level(keys: np.ndarray, n: np.ndarray, level: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[_Depth]]:
    """(order of the grams, their bits, node of each, nodes from DEPTH up to ``top``) for one of a byte's eight decisions.

    A node's key is its decision (one bit more than the bits before, counted from 1), then its context read backwards.
    """
    byte = (keys & np.uint64(255)).astype(np.uint16)
    decision = (byte >> (8 - level)) + (1 << level)
    order = np.argsort(decision, kind="stable")
    node = (decision[order].astype(np.uint64) << np.uint64(56)) | (keys[order] >> np.uint64(8))
    bit, n = ((byte >> (7 - level)) & 1)[order], n[order]
    first = _distinct(node)
    ones, total = np.add.reduceat(n * bit, first), np.add.reduceat(n, first)
    own = log_kt(total - ones, ones)
    depths = [_Depth(node[first], total - ones, ones, own, own)]
    for d in range(DEPTH - 1, top - 1, -1):
        depths.append(_lifted(depths[-1], d))
    at = np.zeros(len(node), np.int32)
    at[first[1:]] = 1
    return order, bit, np.cumsum(at, dtype=np.int32), depths


def _passed(d: _Depth, said: np.ndarray, left: np.ndarray, value: np.ndarray, leaf: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance given by this node and those above, weight left to its children, chance if the path ends here).

    Weight that belongs to contexts which training never saw goes to the deepest one that it did see.
    """
    estimate, seen = (d.ones + 0.5) / (d.zeros + d.ones + 1.0), d.zeros + d.ones > 0
    stop = 1.0 if leaf else _stop(d.own, d.mixed)
    said, left = said + left * stop * estimate, left * (1 - stop)
    return said, left, np.where(seen, said + left * estimate, value)


@dataclass
class Top:
    """What comes down to the buckets' nodes: for each node's key the chance said so far, the weight left, the chance without it."""

    keys: np.ndarray
    said: np.ndarray
    left: np.ndarray
    value: np.ndarray


def roots(keys: np.ndarray, n: np.ndarray, depth: int) -> _Depth:
    """The weighted nodes at ``depth`` over sorted grams, for all 255 decisions."""
    parts = [_level(keys, n, level, depth)[3][-1] for level in range(8)]
    return _Depth(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("keys", "zeros", "ones", "own", "mixed")))


def weigh_top(found: list[tuple[int, _Depth]]) -> Top:
    """Weighs the nodes above the buckets', which are given by depth, and follows the weights down to them."""
    by: list[list[_Depth]] = [[d for depth, d in found if depth == k] for k in range(MOST_CUT + 1)]
    whole: list[_Depth | None] = [None] * (MOST_CUT + 1)
    own_: list[np.ndarray] = [np.zeros(0, bool)] * (MOST_CUT + 1)
    below: _Depth | None = None
    for d in range(MOST_CUT, -1, -1):
        parts = ([_lifted(below, d)] if below is not None else []) + by[d]
        if not parts:
            continue
        n_inner = len(parts[0].keys) if below is not None else 0
        all_ = _Depth(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("keys", "zeros", "ones", "own", "mixed")))
        order = np.argsort(all_.keys, kind="stable")
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        if below is not None:
            below.up = back[below.up]
        below = _Depth(*(getattr(all_, f)[order] for f in ("keys", "zeros", "ones", "own", "mixed")))
        whole[d], own_[d] = below, order >= n_inner
    out: list[list[np.ndarray]] = [[], [], [], []]
    state: tuple[np.ndarray, ...] | None = None
    for d in range(MOST_CUT + 1):
        nodes = whole[d]
        if nodes is None:
            break
        if state is None:
            state = (np.zeros(len(nodes.keys)), np.ones(len(nodes.keys)), np.full(len(nodes.keys), 0.5))
        for part, values in zip(out, (nodes.keys, *state)):
            part.append(values[own_[d]])
        nxt = whole[d + 1] if d < MOST_CUT else None
        if nxt is not None:
            state = tuple(x[nxt.up] for x in _passed(nodes, *state, leaf=False))
    keys, *rest = (np.concatenate(p) for p in out)
    order = np.argsort(keys)
    return Top(keys[order], *(x[order] for x in rest))


def code_lengths(keys: np.ndarray, n: np.ndarray, depth: int, top: Top) -> np.ndarray:
    """-log probability of each of the sorted grams, in nats."""
    out = np.zeros(len(keys))
    for level in range(8):
        order, bit, node, depths = _level(keys, n, level, depth)
        at = np.searchsorted(top.keys, depths[-1].keys)
        state = (top.said[at], top.left[at], top.value[at])
        for k in range(len(depths) - 1, -1, -1):
            state = _passed(depths[k], *state, leaf=k == 0)
            if k:
                state = tuple(x[depths[k - 1].up] for x in state)
        p = np.clip(state[2], 1e-9, 1 - 1e-9)[node]
        out[order] -= np.log(np.where(bit, p, 1 - p))
    return out


def _batches(keys: np.ndarray, depth: int) -> Iterator[slice]:
    """Neighbouring nodes at ``depth`` with some _BATCH grams together."""
    first = np.r_[_distinct(keys >> np.uint64(64 - 8 * depth)), len(keys)]
    a = 0
    while a < len(keys):
        b = int(first[max(np.searchsorted(first, a, "right"), np.searchsorted(first, a + _BATCH, "right") - 1)])
        yield slice(a, b)
        a = b


# Steps over buckets


def _collect(keys: list, counts: list, row: dict) -> None:
    found = unpack(row["keys"])
    keys.append((found, unpack(row["counts"]).astype(np.int64)))
    counts[0] += len(found)
    if counts[0] > 2 * counts[1] + 4 * _PIECE:
        keys[:] = [_merged(keys)]
        counts[0] = counts[1] = len(keys[0][0])


def _merge(ranges: Ranges):
    """One bucket's counts of all chunks, and the weighted nodes that it hands up; for words the sum and number of those in training."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        sizes, bucket = [0, 0], -1
        for batch in batches:
            for row in batch.to_pylist():
                bucket = row["bucket"]
                _collect(parts, sizes, row)
        if not parts:
            return
        keys, n = _merged(parts)
        parts.clear()
        row = lambda step, part, a, b, c, d, e: pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([step], pa.int8()), pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in (a, b, c, d, e))],
            ["bucket", "step", "part", "keys", "counts", "ones", "own", "mixed"],
        )
        for part, a in enumerate(range(0, len(keys), _PIECE)):
            yield row(0, part, pack(keys[a : a + _PIECE]), pack(n[a : a + _PIECE]), b"", b"", b"")
        if bucket >= ranges.grams:
            yield row(2, 0, b"", pack(np.array([n.sum(), (n > 0).sum()])), b"", b"", b"")
            return
        for part, here in enumerate(_batches(keys, ranges.depths[bucket])):
            r = roots(keys[here], n[here], ranges.depths[bucket])
            yield row(2, part, pack(r.keys), pack(r.zeros), pack(r.ones), _doubles(r.own), _doubles(r.mixed))
        del keys, n
        release()

    return step


MERGED = "bucket int, step tinyint, part int, keys binary, counts binary, ones binary, own binary, mixed binary"


def _answer(ranges: Ranges, top):
    """For the keys that each chunk has in a bucket: code lengths in grains, or counts of words."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        values: np.ndarray | None = None
        keys = np.zeros(0, np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                if row["step"] == 0:
                    parts.append((unpack(row["keys"]), unpack(row["counts"]).astype(np.int64)))
                    continue
                if values is None:
                    keys, values = (np.concatenate(x) for x in zip(*parts))
                    parts.clear()
                    if row["bucket"] < ranges.grams:
                        depth = ranges.depths[row["bucket"]]
                        values = np.concatenate([np.rint(code_lengths(keys[s], values[s], depth, top.value) * _GRAIN).astype(np.int64) for s in _batches(keys, depth)])
                asked = values[np.searchsorted(keys, unpack(row["keys"]))]
                columns = [pa.array([row["chunk"]], pa.int64()), pa.array([row["bucket"]], pa.int32()), pa.array([row["part"]], pa.int32()), pa.array([pack(asked)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "bucket", "part", "keys"])
        keys = values = None
        release()

    return step


def _score(ranges: Ranges):
    """A row for each text, from its chunk's text and the values of its chunk's grams and words in order."""

    def finish(text: dict, ids: pa.Array, grams: list[np.ndarray], words: list[np.ndarray]) -> pa.RecordBatch:
        cuts = np.cumsum([0, *text["sizes"]]).tolist()
        joined = zstandard.ZstdDecompressor().decompress(text.pop("keys"))
        coded = [joined[a:b] for a, b in zip(cuts, cuts[1:])]
        del joined
        # The grams of all blocks, then block by block again, then the words: only one block's places are held.
        known, length = np.zeros(0, np.uint64), []
        for block in _blocks(coded, BLOCK // 2):
            known = _union([known, _sorted_distinct(gram_keys(coded[block])[0])])
        given = np.concatenate(grams)
        grams.clear()
        if len(given) != len(known):
            raise RuntimeError("a chunk's grams changed between the passes")
        for block in _blocks(coded, BLOCK // 4):
            keys, begin = gram_keys(coded[block])
            found, place = _placed(keys)
            length.append(np.add.reduceat(given[np.searchsorted(known, found)][place], begin, dtype=np.int64))
        del known, given, keys, found, place
        words_, all_words, out = [], np.zeros(0, np.uint64), []
        for block in _blocks(coded):
            docs, word, hashes = _words(coded[block])
            all_words = _union([all_words, hashes])
            words_.append((block.stop - block.start, docs.astype(np.int32), word, hashes))
        count = np.concatenate(words)
        if len(count) != len(all_words):
            raise RuntimeError("a chunk's words changed between the passes")
        gains = np.log10(count + 1.0)
        for size, docs, word, hashes in words_:
            of = np.searchsorted(all_words, hashes)[word]
            out.append((np.bincount(docs, minlength=size), np.bincount(docs, count[of] > 0, size), np.bincount(docs, gains[of], size)))
        n, seen, base = (np.concatenate(x) for x in zip(*out))
        score = np.concatenate(length)
        columns = [ids, pa.array(text["held"], pa.bool_()), pa.array(n), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(score / _GRAIN * -math.log10(math.e)), pa.array(text["sizes"], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_coded"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: dict | None = None
        ids: pa.Array | None = None
        grams: list[np.ndarray] = []
        words: list[np.ndarray] = []
        for batch in batches:
            # Row by row: a batch holds whole chunks, and a second copy of it would not be small.
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if bucket < 0:
                    if text is not None:
                        yield finish(text, ids, grams, words)
                        release()
                    text = {c: batch.column(c)[i].as_py() for c in ("keys", "sizes", "held")}
                    ids, grams, words = batch.column("ids").slice(i, 1).flatten(), [], []
                else:
                    is_gram = bucket < ranges.grams
                    (grams if is_gram else words).append(unpack(batch.column("keys")[i].as_py()).astype(np.int32 if is_gram else np.int64))
        if text is not None:
            yield finish(text, ids, grams, words)
        text, ids, grams, words = None, None, [], []
        release()

    return step


def score(docs: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of ``docs``.

    Rows whose crc32(doc_id as text) mod ``modulus`` is not 2 train both models. A null or blank text is an end symbol
    alone, null ids hash as the empty text, repeated rows count and score each, a very long text is a chunk of its
    own, other columns are not read. Without training rows every decision has one chance in two, and no word is known;
    an empty table gives an empty result. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", is_held_out(modulus=modulus).alias("held_out"))
    kind = dict(marked.dtypes)["doc_id"]
    pieces = materialise(marked.mapInArrow(_chunks, f"{PIECES}, ids array<{kind}>"), "ctw-chunks")
    ranges = find_ranges(pieces)
    buckets = ranges.grams + _word_buckets(pieces)
    dealt = pieces.filter(F.col("kind") != TEXT).select("chunk", "kind", "part", "keys", "counts").mapInArrow(_deal(ranges, (buckets - ranges.grams).bit_length() - 1), DEALT)
    merged = materialise(dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_merge(ranges), MERGED), "ctw-merged")
    handed = merged.filter("step = 2").select("bucket", "keys", "counts", "ones", "own", "mixed").collect()
    totals = [unpack(r["counts"]) for r in handed if r["bucket"] >= ranges.grams]
    tokens, distinct = (int(sum(t[k] for t in totals)) for k in (0, 1))
    found = [(ranges.depths[r["bucket"]], _Depth(unpack(r["keys"]), unpack(r["counts"]).astype(np.int64), unpack(r["ones"]).astype(np.int64), _undouble(r["own"]), _undouble(r["mixed"]))) for r in handed if r["bucket"] < ranges.grams]
    dealt_to = pieces.filter(F.col("kind") == TEXT).agg(F.count(F.lit(1)).alias("n"), F.max(F.shiftright("chunk", 32)).alias("last")).first()
    if not dealt_to["n"]:
        return spark.createDataFrame([], f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")
    top = spark.sparkContext.broadcast(weigh_top(found))
    known = merged.filter("step = 0").select("bucket", "step", F.lit(-1).cast("bigint").alias("chunk"), "part", "keys", "counts")
    asked = known.unionByName(dealt.withColumn("counts", F.lit(b""))).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("step", "part")
    answers = asked.mapInArrow(_answer(ranges, top), "chunk bigint, bucket int, part int, keys binary")
    texts = pieces.filter(F.col("kind") == TEXT).select("chunk", F.lit(-1).alias("bucket"), "part", "keys", "sizes", "held", "ids")
    # Chunks of one task are neighbours, so that the chunks of all tasks are spread evenly.
    tasks, each = min(dealt_to["n"], MOST_TASKS), -(-dealt_to["n"] // (dealt_to["last"] + 1))
    place = F.pmod(F.shiftright("chunk", 32) * each + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(tasks)).cast("int")
    both = texts.unionByName(answers, allowMissingColumns=True).repartitionById(tasks, place).sortWithinPartitions("chunk", "bucket", "part")
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, n_coded bigint"
    return both.mapInArrow(_score(ranges), schema).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(tokens + 1.0 * (distinct + 1))).alias("base_score"),
        "score",
        (-F.col("score") / math.log10(2) / F.col("n_coded")).alias("bits_per_byte"),
    )
