"""Near-duplicate groups by SimHash with deletion-variant signatures.

Two 64-bit fingerprints that differ in at most three bits have a 32-bit half that differs in at most one bit.
Each half is therefore indexed under itself and under its 32 one-wildcard variants; an equality join on these
signatures meets every linked pair, and a bit count verifies it.  A signature that more than ``SPLIT`` distinct
fingerprints share is cut again by the same rule over the other half (16-bit quarters), so that no bucket can hold
more than 4 * 2**16 fingerprints however many rows are copies of each other.  Within a bucket only a spanning forest
of the verified links leaves the task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import bitmap_of, byte_hashes, freeing, in_bitmap, materialise, shared_dir, slabs, spread, with_fresh_name, words_of

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Distinct fingerprints under one signature beyond which it is cut again.
SPLIT = 1024
_CHUNK = 1 << 15
#: Of near copies: 64-bit numbers of a fingerprint, each two segments; words of a shingle; least similarity; signatures a partition.
WIDE, NEAR_SHINGLE, SIMILAR, SIGNATURES = 4, 5, 0.8, 8_000_000
_SLAB = 1 << 19


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of one text: bit set when over half of the shingle hashes, repeats included, have it.

    A-Z are lower-cased, words are runs of non-ASCII-space, fewer words than ``width`` make one shingle of all of
    them, and a null, empty or blank text has fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    n = max(1, len(words) - width + 1)
    begin = starts[:n].tolist()
    end = (starts[width - 1 :] + lengths[width - 1 :]).tolist() if len(words) >= width else [len(whole)]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        raw = b"".join([digest(whole[a:b], SEED) for a, b in zip(begin[at : at + _CHUNK], end[at : at + _CHUNK])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, out: str = "fp", text: str = "text") -> DataFrame:
    """``docs`` without its text and with column ``out``: the fingerprint as a signed long."""
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, last, value, made = batch.column(text), None, 0, []
            for i in range(len(column)):
                now = column[i].as_py()
                if now != last:
                    last, value = now, fingerprint(now)
                made.append(value if last else 0)
            signed = pa.array(np.array(made, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), signed], [*kept, out])

    return docs.mapInArrow(step, f"{schema}, `{out}` bigint" if schema else f"`{out}` bigint")


def _half(fp: Column, k: int) -> Column:
    return (F.shiftrightunsigned(fp, 32) if k == 0 else fp).bitwiseAND(F.lit(0xFFFFFFFF))


def _signatures(value: Column, width: int, tag: int) -> Column:
    """array<struct<sig, bit>>: the value itself, and each one-wildcard variant with the bit that it leaves out.

    A pair that differs in one bit meets only under the variant of that bit, with different ``bit``; a pair that
    agrees meets only under the value itself (bit 2).
    """
    exact = F.struct((F.lit((tag * 64 + 63) << 32) + value).alias("sig"), F.lit(2).cast("tinyint").alias("bit"))
    wild = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.struct(
            ((F.lit(tag * 64) + i).cast("bigint") * (1 << 32) + value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))).alias("sig"),
            F.call_function("shiftrightunsigned", value, i).bitwiseAND(F.lit(1).cast("bigint")).cast("tinyint").alias("bit"),
        ),
    )
    return F.concat(F.array(exact), wild)


def forest(fps: np.ndarray, bits: np.ndarray, most: int = MAX_BITS) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one bucket.

    Fingerprints link at ``most`` or fewer differing bits; in a wildcard bucket only pairs whose left-out bits differ
    are looked at, since the others meet under the exact signature.  Pairs of one component are not looked at again.
    """
    n = len(fps)
    part = np.arange(n)
    left, right = [], []
    for i in range(n - 1):
        rest = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
        if bits[i] != 2:
            rest = rest[bits[rest] != bits[i]]
        if not len(rest):
            continue
        near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= most]
        for j in near.tolist():
            if part[j] != part[i]:
                left.append(i)
                right.append(j)
                part[part == part[j]] = part[i]
    return left, right


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, sub) in; spanning links (a, b) out. Holds one bucket, at most 4 * 2**16 fingerprints."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def links(sig, sub, fp, bit, last: bool):
        """Links of the whole buckets, and the rows of the last one unless it is known to be whole."""
        edge = np.flatnonzero((sig[1:] != sig[:-1]) | (sub[1:] != sub[:-1])) + 1
        cuts = np.concatenate(([0], edge, [len(sig)] if last else []))
        a, b = [], []
        sizes = np.diff(cuts)
        for k in np.flatnonzero(sizes > 1):
            s, e = int(cuts[k]), int(cuts[k + 1])
            if e - s == 2:
                if (bit[s] == 2 or bit[s] != bit[s + 1]) and bin(int(fp[s] ^ fp[s + 1])).count("1") <= MAX_BITS:
                    a.append(int(fp[s]))
                    b.append(int(fp[s + 1]))
                continue
            i, j = forest(fp[s:e], bit[s:e])
            a += fp[s:e][i].tolist()
            b += fp[s:e][j].tolist()
        return a, b, 0 if last else int(edge[-1]) if len(edge) else 0

    def batch_of(a, b):
        both = np.array([a, b], np.uint64).view(np.int64).reshape(2, -1)
        return pa.RecordBatch.from_arrays([pa.array(both.min(axis=0)), pa.array(both.max(axis=0))], ["a", "b"])

    def joined():
        return [np.concatenate([h[i] for h in held]) for i in range(4)]

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.asarray(batch.column(c)) for c in ("sig", "sub", "fp", "bit")]
        now[2] = now[2].view(np.uint64)
        held.append(tuple(now))
        cols = joined()
        a, b, start = links(*cols, last=False)
        held = [tuple(c[start:] for c in cols)]
        if a:
            yield batch_of(a, b)
    if held:
        a, b, _ = links(*joined(), last=True)
        if a:
            yield batch_of(a, b)


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints in column ``fp``, enough of them to connect each component."""
    fp = F.col("fp")
    keyed = spread(fps.select(fp), 20_000).select(fp, F.explode(F.concat(*(_signatures(_half(fp, k), 32, k) for k in (0, 1)))).alias("s")).select("fp", "s.sig", "s.bit")
    shared = keyed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark takes the exploded side for as small as its input and would broadcast it.
    met = materialise(keyed.join(shared.hint("merge"), "sig"), "simhash-signatures")
    small = met.filter(F.col("n") <= SPLIT).select("sig", F.lit(0).cast("bigint").alias("sub"), "fp", "bit")
    # A hot signature is cut by quarters of the other half; a pair keeps its wildcard bit by being in two sub-buckets of one signature.
    other = F.when(F.shiftright("sig", 38) == 0, _half(fp, 1)).otherwise(_half(fp, 0))
    quarter = lambda k: (F.shiftrightunsigned(other, 16) if k == 0 else other).bitwiseAND(F.lit(0xFFFF))
    large = (
        met.filter(F.col("n") > SPLIT)
        .select("sig", "fp", "bit", F.explode(F.transform(F.concat(*(_signatures(quarter(k), 16, k) for k in (0, 1))), lambda s: s["sig"])).alias("sub"))
        .select("sig", "sub", "fp", "bit")
    )
    dealt = small.unionByName(large).repartition("sig", "sub").sortWithinPartitions("sig", "sub", "fp")
    return dealt.mapInArrow(_bucket_links, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), by alternating large and small stars.

    Each round is written to the shared folder; nothing is collected but the count of changes.
    """
    now = materialise(edges.select("a", "b"), "components")
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", "m")).distinct()
        new = materialise(small, "components")
        # Stars are stable when every node has one neighbour and no neighbour is itself a leaf.
        heads = new.select(F.col("b").alias("a")).distinct()
        if new.join(heads, "a", "left_semi").isEmpty() and new.groupBy("a").count().filter("count > 1").isEmpty():
            return new.select(F.col("a").alias("node"), F.col("b").alias("label")).union(heads.select("a", F.col("a").alias("label")))
        now = new


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, row_key, fp, component_id, n_in_component) for each row; row_key hashes the id with the text."""
    shared_dir(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), _row_key(doc_id, text).alias("row_key"), F.col(text).alias("text"))
    marked = materialise(fingerprints(narrow), "simhash")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    labels = components(links(distinct.select("fp")))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    whole = named.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_in_component"))
    of_fp = materialise(named.join(whole, "label").select("fp", "label", "component_id", "n_in_component"), "simhash-components")
    return marked.join(of_fp, "fp")


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, n_in_component) for each row of ``docs``.

    Null, empty and blank texts have fingerprint zero and link like any other; equal texts always share a component;
    a repeated row is returned as often as it comes. component_id is the smallest id in the component; null ids are
    kept and are never the smallest unless a component has no other. Empty input gives an empty result. Other columns
    of ``docs`` are not read, so their names don't matter.
    """
    return _grouped(docs, doc_id, text).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_in_component")


# Near copies: a wide fingerprint of words, links verified by five-word shingles


def wide_fingerprints(texts: pa.Array) -> np.ndarray:
    """Four numbers of 64 bits for each text without nulls: a bit is set when over half of its distinct words' hashes have it.

    Words rather than shingles, since an edit changes one word but five shingles; the shingles are what links are
    verified by.
    """
    out = np.zeros((len(texts), WIDE), np.uint64)
    docs, codes, distinct = words_of(pc.ascii_lower(texts))
    if not len(docs):
        return out
    pairs = np.sort(docs * np.int64(len(distinct)) + codes)
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    of, word = pairs // len(distinct), pairs % len(distinct)
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    n = np.diff(np.r_[first, len(of)])
    h = byte_hashes(distinct)
    for k in range(WIDE):
        h = _mixed(h + np.uint64(k))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)[word]
        counts = np.add.reduceat(bits, first, axis=0, dtype=np.uint32)
        out[of[first], k] = np.packbits(counts * 2 > n[:, None], axis=1).view(np.uint64).ravel()
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int = NEAR_SHINGLE) -> list[np.ndarray]:
    """The distinct 32-bit hashes of each text's shingles in order; fewer words than ``width`` are one shingle, none an empty set."""
    docs, codes, distinct = words_of(pc.ascii_lower(texts))
    h = byte_hashes(distinct)[codes]
    sums = np.zeros(len(h), np.uint64)
    for k in range(width):
        part = h[k:] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
        sums[: len(part)] += part * (docs[k:] == docs[: len(part)])
    sums = _mixed(sums) >> np.uint64(32)
    cuts, out = np.searchsorted(docs, np.arange(len(texts) + 1)), []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        found = np.sort(sums[a : max(b - width + 1, min(b, a + 1))].astype(np.uint32))
        out.append(found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are alike."""
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slabs(batch.column("text"), _SLAB):
            fp = wide_fingerprints(texts).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(start, len(texts)), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WIDE))], ["key", *(f"f{k}" for k in range(WIDE))])


_EXACT = 63


def _wide_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, side, near, key): each segment of a fingerprint under itself and under its one-wildcard variants.

    ``side`` is the left-out bit; ``near`` is another segment of the fingerprint, another one from signature to
    signature, its bits in another order, by which texts of a signature that are alike stand beside each other.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            rows = batch.slice(a, 1024)
            key = np.asarray(rows.column("key"))
            segments = [(np.asarray(rows.column(f"f{s // 2}")).view(np.uint64) >> np.uint64(32 * (s % 2)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for s in range(2 * WIDE)]
            sigs, sides, nears = [], [], []
            for s, value in enumerate(segments):
                for i in (*range(32), _EXACT):
                    bit = np.uint32(1 << i if i < 32 else 0)
                    sigs.append((np.uint64(s * 64 + i) << np.uint64(32)) | (value & ~bit).astype(np.uint64))
                    sides.append((value & bit) > 0)
                    other, turn = segments[(s + 1 + i % (2 * WIDE - 1)) % (2 * WIDE)], np.uint32(i * 5 % 31 + 1)
                    nears.append(other << turn | other >> (np.uint32(32) - turn))
            columns = (np.concatenate(sigs).view(np.int64), np.concatenate(sides).astype(np.int8), np.concatenate(nears).view(np.int32), np.tile(key, len(sigs)))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["sig", "side", "near", "key"])


#: So many texts before it in its signature's order a text is compared with, besides the first, if ``near`` differs in at most so many bits.
WINDOW, NEAR_BITS = 2, 4


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, near, key) in; (a, b) out: each text of a signature with its first one and with those just before it.

    Under a signature with a wildcard only texts of both sides are told, those of one side share the whole segment. A
    bucket of any size passes through; its first text and the last ``WINDOW`` are held.
    """
    held, leader = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: np.asarray(batch.column(c)) for c in ("sig", "side", "near", "key")}
        rows = new if held is None else {c: np.concatenate((held[c], new[c])) for c in new}
        before = len(rows["sig"]) - len(new["sig"])
        sig, side, near, key = rows["sig"], rows["side"], rows["near"].view(np.uint32), rows["key"]
        exact = (sig >> 32) & 63 == _EXACT
        found = []
        for back in range(1, min(WINDOW, len(sig) - 1) + 1):
            one, two = np.arange(max(before, back), len(sig)), np.arange(max(before, back) - back, len(sig) - back)
            ok = (sig[one] == sig[two]) & (exact[one] | (side[one] != side[two])) & (np.bitwise_count(near[one] ^ near[two]) <= NEAR_BITS)
            found.append((key[one[ok]], key[two[ok]]))
        start = np.r_[leader is None or leader[0] != new["sig"][0], new["sig"][1:] != new["sig"][:-1]]
        first = np.maximum.accumulate(np.where(start, np.arange(len(start)), -1))
        lead = [np.where(first >= 0, new[c][first], 0 if leader is None else leader[k]) for k, c in ((1, "side"), (2, "key"))]
        ok = ~start & (exact[before:] | (new["side"] != lead[0]))
        found.append((new["key"][ok], lead[1][ok]))
        leader = (new["sig"][-1], lead[0][-1], lead[1][-1])
        held = {c: x[-WINDOW:] for c, x in rows.items()}
        one, two = (np.concatenate(x) for x in zip(*found))
        apart = one != two
        if apart.any():
            a, b = one[apart], two[apart]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def candidates(fps: DataFrame) -> DataFrame:
    """(a, b): distinct texts whose fingerprints have a segment that differs in at most one bit, by way of each bucket's first text and of neighbours.

    Where many texts share a signature, another segment puts them in an order, and each meets those just before it. A
    near pair shares most of its signatures, each with an order of its own, so it stands side by side under some. That
    makes most groups at little cost but may tell a partner too few; ``untold`` is the exact way for the rest. Every
    text that has a partner is an end of some pair here: those that share its segment stand in its exact signature.
    """
    spread_out = spread(fps, 50_000)
    rows = spread_out.mapInArrow(freeing(_wide_signatures), "sig bigint, side tinyint, near int, key bigint")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), spread_out.rdd.getNumPartitions() * 66 * WIDE * 50_000 // SIGNATURES)
    return rows.repartition(parts, "sig").sortWithinPartitions("sig", "near", "key").mapInArrow(freeing(_stars), "a bigint, b bigint").distinct()


def _sets(bitmap):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = in_bitmap(bitmap.value, np.asarray(batch.column("key")).view(np.uint64))
            for start, texts in slabs(batch.column("text").take(pa.array(near)), _SLAB):
                found = [s.tobytes() for s in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(near[start : start + len(texts)])), pa.array(found, pa.binary())], ["key", "shingles"])

    return step


def _verified(similar: float):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column("one"), batch.column("two")
            ok = [i for i in range(batch.num_rows) if jaccard(np.frombuffer(one[i].as_py(), np.uint32), np.frombuffer(two[i].as_py(), np.uint32)) >= similar - 1e-12]
            yield batch.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    return step


#: Rows of a shingle that are compared in one go, with themselves and with as many others.
BLOCK = 256
_TOKENS = 1 << 18


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, size, token): a row for each shingle of a text, ``size`` of them."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column("shingles"))) // 4
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _TOKENS, "right")))
            tokens = np.frombuffer(b"".join(batch.column("shingles").slice(start, stop - start).to_pylist()), np.int32)
            of = np.repeat(np.arange(start, stop), sizes[start:stop])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)), batch.column("label").take(pa.array(of)), pa.array(sizes[of].astype(np.int32)), pa.array(tokens)], ["key", "label", "size", "token"])
            start = stop


_ROW = ("token", "one", "two", "block", "key", "label", "size", "place")


def _block_pairs(similar: float):
    """Rows sorted by (token, one, two, size) in; (a, b) out: texts of different groups that may be alike.

    All rows of two blocks of a token are compared, as far as their sizes allow. If it is the first shingle in order
    that both have, they share no more than what either has from there on.
    """
    share = similar / (1 + similar)

    def pairs(token, one, two, block, key, label, size, place):
        group = np.cumsum(np.r_[False, (token[1:] != token[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        at, back, left = np.arange(len(key)), 1, size - place
        while len(at := at[at + back < len(key)]):
            on = (group[at] == group[at + back]) & (size[at + back] * similar <= size[at] + 1e-6)
            at = at[on]
            to = at + back
            ok = (label[at] != label[to]) & ((one[at] == two[at]) | (block[at] != block[to])) & (np.minimum(left[at], left[to]) >= share * (size[at] + size[to]) - 1e-6)
            if ok.any():
                a, b = key[at[ok]], key[to[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            back += 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(c)) for c in _ROW]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            whole = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            held = [x[cut:] for x in rows]
            if cut:
                yield from pairs(*(x[:cut] for x in rows))
        if held is not None:
            yield from pairs(*held)

    return step


def untold(sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b): pairs of texts (key, label, shingles) of different labels, among them all that are alike to ``similar`` or more.

    Alike texts share one of the first shingles of each, as many as may differ and one, in any order that is the same
    for all. Shingles of one label come first, since no pair is to be found by them, then rare ones. A shingle that
    many texts have is cut into blocks, and each block meets each, so no count of texts is too large for a task.
    """
    tokens = sets.mapInArrow(freeing(_tokens), "key bigint, label bigint, size int, token int")
    several = lambda rows: rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("token", "n")
    shared = tokens.join(several(tokens).hint("merge"), "token").groupBy("key").agg(F.first("label").alias("label"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "token"))).alias("met"))
    before = F.col("size") - F.size("met")
    first = F.col("size") - F.ceil(F.col("size") * similar - 1e-6).cast("int") + 1 - before
    placed = shared.filter(first > 0).select("key", "label", "size", before.alias("before"), F.posexplode(F.slice("met", F.lit(1), first)).alias("i", "t"))
    prefixes = materialise(placed.select(F.col("t.token").alias("token"), "key", "label", "size", (F.col("before") + F.col("i")).alias("place")), "near-prefixes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = prefixes.join(several(prefixes).hint("merge"), "token").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "key", "label", "size", "place")
    return dealt.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "size").mapInArrow(freeing(_block_pairs(similar)), "a bigint, b bigint").distinct()


def _near(docs: DataFrame, text: str, similar: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) links, and edges (a, b) with the same components of which fewer are left to walk.

    Candidates come from segments of a 256-bit fingerprint of the words. First each text is verified against one of
    its candidates; of the other candidates only those between different groups are left to verify. Last, all texts
    with partners that no pair told are compared across groups, so of texts that share a segment but for one bit every
    two that are alike end in one group.
    """
    keyed = docs.select(_text_key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fps = materialise(keyed.mapInArrow(freeing(_wide_rows), "key bigint, " + ", ".join(f"f{k} bigint" for k in range(WIDE))).dropDuplicates(["key"]), "near-fingerprints")
    pairs = materialise(candidates(fps), "near-candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(ends, "key"))
    sets = materialise(keyed.mapInArrow(freeing(_sets(bitmap)), "key bigint, shingles binary").dropDuplicates(["key"]).join(ends, "key", "left_semi"), "near-sets")

    def verify(edges: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("key").alias("a"), F.col("shingles").alias("one")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("two"))
        return edges.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(freeing(_verified(similar)), "a bigint, b bigint")

    both = pairs.union(pairs.select("b", "a"))
    mates = materialise(both.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")), "near-mates")
    first = materialise(mates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-first")
    found = materialise(verify(first), "near-links")
    groups = components(found)
    star = lambda g: g.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    label = lambda c: groups.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
    apart = pairs.join(first, ["a", "b"], "left_anti").join(label("a"), "a", "left").join(label("b"), "b", "left")
    open_ = apart.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    more = materialise(verify(open_), "near-links")
    # Two texts with one candidate each, the other, are told all they have.
    lone = mates.filter("n = 1").select("a", "b")
    told = lone.join(lone.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").select(F.col("a").alias("key"))
    groups = components(star(groups).union(more))
    left = sets.join(told, "key", "left_anti").join(label("key"), "key", "left").select("key", F.coalesce("key_label", "key").alias("label"), "shingles")
    # Candidates of different groups have been verified.
    rest = materialise(verify(untold(left, similar).join(pairs, ["a", "b"], "left_anti")), "near-links")
    return found.union(more).union(rest), star(groups).union(rest)


def near_links(docs: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(a, b): keys of different texts whose five-word shingles have a Jaccard similarity of ``similar`` or more."""
    return _near(docs, text, similar)[0]


def near_classes(docs: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(key, label) for each different text that has a near copy: the least key of those it reaches over links."""
    return components(_near(docs, text, similar)[1]).select(F.col("node").alias("key"), "label")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class of near copies, one with the smallest id (null ids last), with all its columns.

    Texts are near copies when their five-word shingles are alike to ``similar`` or more, or over a chain of such
    texts; equal texts are copies, and null, empty and blank ones are alike. Of repeated rows with one id and text one
    is kept. Every row without a partner stays. Ties go to the smaller hash of id and text. An empty table stays empty.
    """
    one, two = with_fresh_name(docs, "row_key"), with_fresh_name(docs, "row_id")
    id_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _row_key(doc_id, text).alias("row_key"), _text_key(F.col(text)).alias("key"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    texts = rows.groupBy("key").agg(F.min(order).alias("k"))
    labelled = texts.join(near_classes(docs, text, similar), "key", "left").groupBy(F.coalesce("label", "key").alias("label")).agg(F.min("k").alias("k"))
    kept = labelled.select(F.col("k.row_key").alias(one), id_text("k.doc_id").alias(two))
    found = docs.withColumns({one: _row_key(doc_id, text), two: id_text(doc_id)}).join(kept.hint("merge"), [one, two], "left_semi")
    return found.dropDuplicates([one, two]).select(*docs.columns)
