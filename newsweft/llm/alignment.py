"""Alignment of two tokenizers over a corpus: groups of tokens between shared byte ends, and how often ids end together."""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import release, slabs
from newsweft.session import written

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"

#: Text bytes of one chunk: what shares a dictionary of groups, and what one task looks up at a time.
CHUNK_BYTES = 8 << 20
#: Units of text and groups that a worker remembers before it starts anew; a matter of memory, not of results.
REMEMBERED = 250_000


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A byte-level BPE (A, of a space and the text) and a piece BPE (B, of the text, to which it adds the space)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        special = {t["id"]: t["content"].encode() for t in json.load(open(a_path, encoding="utf-8"))["added_tokens"]}
        decode = _byte_level()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = special.get(i) or bytes(decode[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not all(self.b_bytes) or any(re.search("[^▁]▁", p) for p in pieces) or max(len(self.a_bytes), len(pieces)) >= 1 << 20:
            raise ValueError("a piece is empty or goes on after a word's end, or there are more than a million ids")
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, their number in each unit, B ids, their number in each unit)."""
        # Units that end in a character stand in one text for A: the next one's space ends them as it did in theirs.
        open_end = [u[-1].isspace() for u in units]
        flat = self.a.encode_batch_fast(["".join(" " + u for u, o in zip(units, open_end) if not o)], add_special_tokens=False)[0].ids
        ids, size = np.array(flat, np.int64), np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units))
        ends = np.searchsorted(np.cumsum(self.a_size[ids]), np.cumsum(np.where(open_end, 0, size)), "right")
        n_a = np.diff(np.r_[0, ends])
        if any(open_end):
            alone = {i: e.ids for i, e in zip(np.flatnonzero(open_end).tolist(), self.a.encode_batch_fast([" " + u for u, o in zip(units, open_end) if o], add_special_tokens=False))}
            lists = [alone[i] if o else ids[stop - n : stop] for i, (o, stop, n) in enumerate(zip(open_end, ends, n_a))]
            ids, n_a = np.concatenate(lists).astype(np.int64), np.fromiter(map(len, lists), np.int64, len(lists))
        b = self.b.encode(units, num_threads=1)
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        return ids, n_a, np.fromiter(itertools.chain.from_iterable(b), np.int64, n_b.sum()), n_b


#: Where both tokenizers start anew: at one space between characters of which neither is white space. A splits there by
#: its pattern, and no piece of B goes on past a word's end (checked when B is loaded), so the parts of a text, each with
#: its space, have the tokens that they have in the whole.
_split = re.compile("(?<=[^\\s▁]) (?=\\S)").split


class Memory:
    """What a worker knows of units (a text between two such spaces): their tokens' numbers and their groups, interned."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.units: dict[str, int] = {}
        self.groups: dict[tuple, int] = {}
        self.names: list[str] = []
        self.text: list[str] = []
        self.whole = np.zeros(0, bool)
        self.n_a, self.n_b, self.n_groups = (np.zeros(0, np.int64) for _ in range(3))
        self.first, self.members = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def learn(self, units: list[str]) -> None:
        t = self.tokenizers
        flat_a, n_a, flat_b, n_b = t.encode(units)
        # Lossless where the bytes of both are the unit's, space included.
        size = np.fromiter((len(u.encode()) + 1 for u in units), np.int64, len(units))
        fits = (_sums(t.a_size[flat_a], n_a) == size) & (_sums(t.b_size[flat_b], n_b) == size)
        if not fits.all() or b"".join(map(t.b_bytes.__getitem__, flat_b.tolist())) != "".join(" " + u for u in units).encode():
            # B writes a space for U+2581, and may change other characters: lengths alone could hide two changes.
            ends = np.cumsum(n_b)
            for i, (u, stop, n) in enumerate(zip(units, ends.tolist(), n_b.tolist())):
                fits[i] &= b"".join(map(t.b_bytes.__getitem__, flat_b[stop - n : stop].tolist())) == b" " + u.encode()
            flat_a, flat_b = flat_a[np.repeat(fits, n_a)], flat_b[np.repeat(fits, n_b)]
            n_a, n_b, size = n_a * fits, n_b * fits, size * fits
        end_a, end_b = np.cumsum(t.a_size[flat_a]), np.cumsum(t.b_size[flat_b])
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        codes = self._intern(flat_a, np.searchsorted(end_a, shared) + 1, flat_b, np.searchsorted(end_b, shared) + 1)
        of_unit = np.searchsorted(shared, np.cumsum(size), "right")
        made = list(map(self.names.__getitem__, codes.tolist()))
        at = 0
        for u, stop in zip(units, of_unit.tolist()):
            self.units[u] = len(self.text)
            self.text.append(made[at] if stop == at + 1 else ";".join(made[at:stop]))
            at = stop
        self.whole = np.r_[self.whole, fits]
        self.n_a, self.n_b, self.n_groups = np.r_[self.n_a, n_a], np.r_[self.n_b, n_b], np.r_[self.n_groups, np.diff(np.r_[0, of_unit])]
        self.first, self.members = np.r_[self.first, self.first[-1] + of_unit], np.r_[self.members, codes]

    def _intern(self, flat_a: np.ndarray, stop_a: np.ndarray, flat_b: np.ndarray, stop_b: np.ndarray) -> np.ndarray:
        """The code of each group, whose tokens end at the given places; groups not yet known get new ones."""
        sides, longer = [], np.zeros(len(stop_a), bool)
        for flat, stop in ((flat_a, stop_a), (flat_b, stop_b)):
            start = np.r_[0, stop[:-1]]
            key = np.zeros(len(stop), np.int64)
            for k in range(3):  # up to three ids of 20 bits are one number
                has = start + k < stop
                key[has] |= flat[start[has] + k] + 1 << 20 * k
            longer |= stop > start + 3
            sides.append((key, flat, start, stop))
        keys = list(zip(sides[0][0].tolist(), sides[1][0].tolist()))

        def ids(i: int) -> list[list[int]]:
            return [flat[start[i] : stop[i]].tolist() for _, flat, start, stop in sides]

        for i in np.flatnonzero(longer).tolist():
            keys[i] = tuple(map(tuple, ids(i)))
        codes = np.fromiter(map(self.groups.get, keys, itertools.repeat(-1)), np.int32, len(keys))
        for i in np.flatnonzero(codes < 0).tolist():
            code = self.groups.setdefault(keys[i], len(self.names))
            if code == len(self.names):
                self.names.append("|".join(",".join(map(str, x)) for x in ids(i)))
            codes[i] = code
        return codes

    def codes(self, units: list[str]) -> np.ndarray:
        known = lambda some: np.fromiter(map(self.units.get, some, itertools.repeat(-1)), np.int64, len(some))
        codes = known(units)
        missing = np.flatnonzero(codes < 0)
        new = list(dict.fromkeys(units[i] for i in missing.tolist()))
        for at in range(0, len(new), 50_000):
            self.learn(new[at : at + 50_000])
        codes[missing] = known([units[i] for i in missing.tolist()])
        return codes

    def full(self) -> bool:
        return len(self.units) > REMEMBERED or len(self.groups) > REMEMBERED


@functools.lru_cache(1)
def _memory(a_path: str, b_path: str) -> Memory:
    """That of this worker, whatever task it runs."""
    return Memory(Tokenizers(a_path, b_path))


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(lengths)]])


def _chunk(texts: pa.Array, memory: Memory, keep_groups: bool) -> tuple[dict[str, object], dict[str, object]]:
    """The columns of a chunk's documents, with the codes and counts of their groups, and those of its distinct groups."""
    parts = [_split(x) if x else [] for x in texts.to_pylist()]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    unit = memory.codes(list(itertools.chain.from_iterable(parts)))
    doc = np.repeat(np.arange(len(parts)), counts)
    if lossy := sorted(set(doc[~memory.whole[unit]].tolist())):
        # Judged as a whole, whatever its parts were: one unit, with tokens only if its bytes are the text's.
        for i in lossy:
            parts[i] = [" ".join(parts[i])]
            counts[i] = 1
        unit = memory.codes(list(itertools.chain.from_iterable(parts)))
        doc = np.repeat(np.arange(len(parts)), counts)
    n_a, n_b, n_groups = (_sums(x[unit], counts) for x in (memory.n_a, memory.n_b, memory.n_groups))
    said, at = [], 0
    text = memory.text
    for n, some in zip(counts.tolist(), (n_a > 0).tolist()):
        said.append(";".join(map(text.__getitem__, unit[at : at + n].tolist())) if some else "")
        at += n
    digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said]
    # (document, unit) once with its count, then (document, group) once with the sum.
    pair, times = np.unique(doc * len(text) + unit, return_counts=True)
    of, unit = pair // len(text), pair % len(text)
    first, n = memory.first[unit], memory.first[unit + 1] - memory.first[unit]
    member = memory.members[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
    distinct, local = np.unique(member, return_inverse=True)
    key, place = np.unique(np.repeat(of, n) * max(1, len(distinct)) + local, return_inverse=True)
    total = np.bincount(place, np.repeat(times, n), len(key)).astype(np.int64)
    code = key % max(1, len(distinct))
    ends = np.searchsorted(key // max(1, len(distinct)), np.arange(len(parts) + 1))
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (code, total)]
    documents = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": digest, "codes": lists[0], "counts": lists[1]}
    if keep_groups:
        documents["groups"] = said
    return documents, {"code": np.arange(len(distinct)), "group": [memory.names[g] for g in distinct.tolist()], "freq": np.bincount(code, total, len(distinct)).astype(np.int64)}


def interned(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, keep_groups: bool = False) -> DataFrame:
    """Rows of documents and rows of groups (where ``code`` is set), both with the ``chunk`` that they are of."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, codes array<int>, counts array<int>, code int, group string, freq bigint" + ", groups string" * keep_groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, chunk = _memory(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in _gathered(batches):
            target = None
            for start, texts in slabs(batch.column("text"), CHUNK_BYTES):
                documents, groups = _chunk(texts, memory, keep_groups)
                ids = batch.column("doc_id").slice(start, len(texts))
                target = target or pa.schema([("chunk", pa.int64()), ("doc_id", ids.type), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups")), ("groups_sha256", pa.string()), ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("code", pa.int32()), ("group", pa.string()), ("freq", pa.int64()), *[("groups", pa.string())] * keep_groups])
                yield from (_rows({"chunk": np.full(n, chunk), **columns}, target, n) for columns, n in (({"doc_id": ids, **documents}, len(texts)), (groups, len(groups["group"]))))
                chunk += 1
                if memory.full():
                    memory.__init__(memory.tokenizers)
            release()

    return docs.mapInArrow(run, schema)


def _rows(columns: dict[str, object], schema: pa.Schema, n: int) -> pa.RecordBatch:
    arrays = [pa.nulls(n, f.type) if (c := columns.get(f.name)) is None else c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with about the text of a chunk, so that small ones share a dictionary."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass(frozen=True)
class Alignment:
    """``documents``: a row for each; ``pairs``: ``a_id``, ``b_id``, ``count`` (links of the whole corpus) and ``best`` (no other A id is linked to the B id more often)."""

    documents: DataFrame
    pairs: DataFrame


def _ends(group, side: int):
    """The last id of one side of a group: between two shared ends only the last tokens of A and B end together."""
    return F.substring_index(F.substring_index(group, "|", 1 if side == 0 else -1), ",", -1).cast("int")


def align(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, keep_groups: bool = False) -> Alignment:
    """How the tokens of A and B lie to each other in each text of ``docs`` (doc_id, text).

    ``documents`` has ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and
    ``groups_sha256`` (with ``keep_groups`` also ``groups``, the text it is the digest of). Null and empty texts, and texts
    that B does not give back byte for byte, have zeros and an empty digest and take no part in counts. Repeated rows count
    each; ids may be null or repeat, rows keep their own; an empty table gives empty ones. Other columns are not read.

    A chunk of texts interns its distinct groups; the corpus sums those rows to a dictionary of groups, each of which is
    expanded to its links once. Their counts go back by group to each chunk that has it, where the documents' codes look
    them up. A group is one row for a chunk, however often it occurs.
    """
    rows = written(interned(docs, a_path, b_path, keep_groups), "interned")
    of_chunk = rows.where(F.col("code").isNotNull()).select("chunk", "code", "group", "freq")
    group = F.col("group")
    groups = written(of_chunk.groupBy("group").agg(F.sum("freq").alias("freq")).withColumns({"a_id": _ends(group, 0), "b_id": _ends(group, 1)}), "groups")
    pairs = groups.groupBy("a_id", "b_id").agg(F.sum("freq").alias("count"))
    pairs = written(pairs, "pairs")
    top = pairs.groupBy("b_id").agg(F.max("count").alias("most"))
    pairs = pairs.join(top, "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))
    values = groups.join(pairs, ["a_id", "b_id"]).select("group", "count", "best")
    back = of_chunk.join(values, "group").select(F.col("chunk").alias("of_chunk"), "code", "count", "best")
    found = rows.where(F.col("code").isNull()).drop("code", "group", "freq")
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    out = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *["groups"] * keep_groups]
    schema = ", ".join(f"{n} {kinds[n]}" for n in out) + ", n_links bigint, n_best bigint, count_sum bigint"

    def look_up(documents: pa.Table, known: pa.Table) -> pa.Table:
        code = np.asarray(known.column("code"))
        count, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        count[code], best[code] = np.asarray(known.column("count")), np.asarray(known.column("best")).astype(np.int64)
        codes, counts = (documents.column(c).combine_chunks() for c in ("codes", "counts"))
        lengths = np.asarray(pc.list_value_length(codes)).astype(np.int64)
        at, times = np.asarray(codes.flatten()), np.asarray(counts.flatten()).astype(np.int64)
        sums = [pa.array(_sums(x, lengths), pa.int64()) for x in (times, times * best[at], times * count[at])]
        return pa.table([*(documents.column(n) for n in out), *sums], [*out, "n_links", "n_best", "count_sum"])

    documents = found.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(look_up, schema)
    return Alignment(documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *[c for c in out if c.startswith("groups")]), pairs)
