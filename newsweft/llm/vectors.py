"""Exact work on integer vectors by quantised cells: codes of a product quantiser, and the k highest inner products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.session import written

#: A component beyond this, once scaled, takes its vector out: squares and products of hundreds of them fit in 64 bits.
LARGEST = 1 << 26
#: Rows that one numpy step compares with a codebook.
STEP_ROWS = 8192


def integer_vectors(df: DataFrame, vector: str, scale: int, keep: list[Column]) -> DataFrame:
    """``keep`` and ``v``, the floors of ``scale`` times each component, of the vectors that have some length and only finite components.

    A vector that is null, empty, or holds a null, NaN, infinite or too large component (``LARGEST`` after scaling)
    has no row.
    """
    x = F.col(vector)
    fits = lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) <= LARGEST)  # noqa: E731  NaN is above all numbers
    kept = df.where(x.isNotNull() & (F.size(x) > 0) & F.forall(x, fits))
    return kept.select(*keep, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def of_usual_length(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vectors of the most frequent length (the shorter of two as frequent), and that length; 0 without vectors."""
    lengths = vectors.groupBy(F.size("v").alias("dims")).count()
    first = lengths.orderBy(F.desc("count"), "dims").first()
    dims = first["dims"] if first else 0
    return vectors.where(F.size("v") == dims), dims


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, dims)


# Codes: each part of a vector by the nearest entry of the part's codebook


class Cells:
    """The entries of one codebook, every coordinate quantised to a cell of ``2**bits`` equal ones over its range."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries = entries.astype(np.int64)
        least = self.entries.min(0)
        width = -(-(self.entries.max(0) - least + 1) // (1 << bits))
        self.cell = (self.entries - least) // width
        self.low = least[:, None] + np.arange(1 << bits) * width[:, None]
        self.high = self.low + (width - 1)[:, None]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, its squared distance) of each query; the lower index of two as near.

        A query's table has, for each coordinate and cell, the least and the most that a point of the cell adds to the
        squared distance. Sums of them bound every entry; only entries whose lower bound is not above the least upper
        bound are compared by their integers, so the result is exact.
        """
        q = queries.astype(np.int64)
        lower = np.zeros((len(q), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(q.shape[1]):
            below, above = self.low[d] - q[:, d, None], q[:, d, None] - self.high[d]
            gap = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(-below, -above)
            lower += (gap * gap)[:, self.cell[:, d]]
            upper += (far * far)[:, self.cell[:, d]]
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        off = q[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", off, off)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(distance, first)
        near = np.where(distance == np.repeat(least, np.diff(np.r_[first, len(row)])), entry, len(self.entries))
        return np.minimum.reduceat(near, first), least


class Codebooks:
    """One codebook for each of ``parts`` equal consecutive parts of a vector; a length that they don't divide is filled up with zeros."""

    def __init__(self, entries: np.ndarray, bits: int):
        self.entries, self.bits = entries, bits  # (parts, entries, width)

    @classmethod
    def of_vectors(cls, vectors: list[list[int]], parts: int, bits: int) -> Codebooks:
        return cls(np.ascontiguousarray(in_parts(np.array(vectors, np.int64), parts).transpose(1, 0, 2)), bits)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry of each part, its squared distance), two arrays of vectors by parts."""
        parts, cells = in_parts(vectors, len(self.entries)), [Cells(e, self.bits) for e in self.entries]
        index, distance = np.zeros((2, *parts.shape[:2]), np.int64)
        for at in range(0, len(parts), STEP_ROWS):
            for p, c in enumerate(cells):
                index[at : at + STEP_ROWS, p], distance[at : at + STEP_ROWS, p] = c.nearest(parts[at : at + STEP_ROWS, p])
        return index, distance

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def in_parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    width = -(-vectors.shape[1] // parts)
    filled = np.pad(vectors, ((0, 0), (0, parts * width - vectors.shape[1])))
    return filled.reshape(len(vectors), parts, width)


def fit_codebooks(vectors: DataFrame, dims: int, parts: int = 8, entries: int = 16, rounds: int = 6, bits: int = 3) -> Codebooks:
    """Codebooks that start as the vectors of the smallest ids and are replaced ``rounds`` times by the floors of their members' means.

    ``vectors`` (vec_id, v) should be a written table: it is read once a round. Each task sums its members' parts for
    every entry, Spark sums those rows, and the driver gets a row for each part and entry, however many vectors there are.
    """
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    books = Codebooks.of_vectors([r["v"] for r in first], parts, bits)
    for _ in range(rounds):
        sums = _member_sums(vectors, dims, books).groupBy("part", "entry").agg(F.sum("members").alias("members"), *(F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"t{d}") for d in range(books.entries.shape[2])))
        made = books.entries.copy()
        for r in sums.collect():
            made[r["part"], r["entry"]] = [int(r[f"t{d}"]) // r["members"] for d in range(made.shape[2])]
        books = Codebooks(made, bits)
    return books


def _member_sums(vectors: DataFrame, dims: int, books: Codebooks) -> DataFrame:
    """(part, entry, members, total) of each task that has members: at most a row for each entry of each codebook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        total, members = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column(0), dims)
                index, _ = books.encode(vectors)
                slot = (index + np.arange(parts) * entries).ravel()
                values = in_parts(vectors, parts).reshape(-1, width)
                members += np.bincount(slot, minlength=len(members))
                np.add.at(total, slot, values)
        used = np.flatnonzero(members)
        yield pa.RecordBatch.from_arrays([pa.array(used // entries, pa.int32()), pa.array(used % entries, pa.int32()), pa.array(members[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "members", "total"])

    return vectors.select("v").mapInArrow(run, "part int, entry int, members bigint, total array<bigint>")


def compress(df: DataFrame, vector: str = "embedding", label: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, bits: int = 3) -> DataFrame:
    """``vec_id``, ``code`` (two hex digits a part), ``error``, ``label_error`` and ``codebooks_sha256`` of each vector that can be coded.

    Null and empty vectors, those with a null, NaN, infinite or too large component (``LARGEST``), and those of another
    than the most frequent length have no row. Of equal distances the lower index wins; of rows with equal ids the
    codebooks start with the smaller vector, ids that are null come last; rows that repeat are coded each. Fewer vectors
    than ``entries`` make smaller codebooks; an empty table has no rows. Other columns of ``df`` are not read.

    A label's sum goes back to its rows by an equality join, which Spark broadcasts only where the sums are small and
    otherwise splits where a label is hot.
    """
    rows = written(integer_vectors(df, vector, scale, [F.col("vec_id"), F.col(label).alias("label")]), "vectors")
    rows, dims = of_usual_length(rows)
    if not dims:
        return df.sparkSession.createDataFrame([], f"vec_id {df.schema['vec_id'].dataType.simpleString()}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books = fit_codebooks(rows, dims, parts, entries, rounds, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, distance = books.encode(matrix(batch.column("v"), dims))
            codes = [row.astype(np.uint8).tobytes().hex() for row in index]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = written(rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"), "codes")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


# The k highest inner products

#: Distinct vectors that one task compares at a time, on either side.
BLOCK = 1 << 15
#: Bounds that one numpy step holds.
STEP_BOUNDS = 1 << 22
#: Exact vectors that a query reads before it looks at its kth score again.
READ = 32


def cell_marks(vectors: DataFrame, dims: int, bits: int) -> list[list[int]]:
    """For each coordinate the ascending first integers of its cells, and one above its largest: cells hold about as many vectors each."""
    x = F.col("x")
    inner = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = vectors.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min(x).alias("least"), F.max(x).alias("most"), F.percentile_approx(x, inner, 1000).alias("marks"))
    marks = {r["d"]: sorted({r["least"], *r["marks"]}) + [r["most"] + 1] for r in found.collect()}
    return [marks[d] for d in range(dims)]


def _cells_of(marks: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), len(marks))
            cells = np.stack([np.searchsorted(m, v[:, d], "right") - 1 for d, m in enumerate(marks)], 1).astype(np.uint8)
            packed = pa.array([row.tobytes() for row in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), packed], ["v", "ids", "cells"])

    return run


def _best_of_block(marks: list[list[int]], most: int):
    """The ``most`` first (score, vec_id) of each query of a block among the candidates of a block."""
    dims = len(marks)

    def bounds(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each candidate and coordinate, least + greatest value of its cell and their distance."""
        twice, spread = np.empty((2, *cells.shape))
        for d, m in enumerate(marks):
            low, high = np.array(m[:-1]), np.array(m[1:]) - 1
            twice[:, d], spread[:, d] = (low + high)[cells[:, d]], (high - low)[cells[:, d]]
        return twice, spread

    def search(q: np.ndarray, v: np.ndarray, twice: np.ndarray, spread: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) among which are each query's ``most`` first.

        Twice the inner product with any point of a cell lies within q * (least + greatest) +- |q| * width. The scan
        takes the candidates whose upper bound reaches the kth lower bound; their exact vectors are read in the order
        of upper bounds, until the kth exact score is above every bound that is left.
        """
        k = min(most, len(v))
        middle, reach = q.astype(twice.dtype) @ twice.T, np.abs(q).astype(twice.dtype) @ spread.T
        upper = middle + reach + slack
        least = np.partition(middle - reach - slack, len(v) - k, axis=1)[:, len(v) - k]
        row, col = np.nonzero(upper >= least[:, None])
        bound = upper[row, col]
        order = np.lexsort((-bound, row))
        row, col, bound = row[order], col[order], bound[order]
        start = np.searchsorted(row, np.arange(len(q)))
        turn = (np.arange(len(row)) - start[row]) // READ
        by_turn = np.argsort(turn, kind="stable")
        ends = np.searchsorted(turn[by_turn], np.arange(turn.max() + 2))
        kth, top = np.full(len(q), -np.inf), np.full((len(q), k), -np.inf)
        out = []
        for t in range(turn.max() + 1):
            at = by_turn[ends[t] : ends[t + 1]]
            at = at[bound[at] >= 2 * kth[row[at]]]
            if not len(at):
                break
            score = np.einsum("ij,ij->i", q[row[at]], v[col[at]])
            out.append((row[at], col[at], score))
            # The kth score so far only has to be certain, so a double that may round up is taken one step down.
            got = np.full((len(q), READ), -np.inf)
            got[row[at], (np.arange(len(row)) - start[row])[at] % READ] = np.nextafter(score.astype(float), -np.inf)
            top = -np.partition(-np.hstack([top, got]), k - 1, axis=1)[:, :k]
            kth = top.min(1)
        return tuple(np.concatenate(x) for x in zip(*out))

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and candidates.num_rows:
            q, v = (np.ascontiguousarray(matrix(t.column("v").combine_chunks(), dims), np.int64) for t in (queries, candidates))
            number = np.asarray(queries.column("c"))
            cells = np.frombuffer(b"".join(candidates.column("cells").to_pylist()), np.uint8).reshape(-1, dims)
            twice, spread = bounds(cells)
            # Sums of integers below 2**24 are exact in 32-bit floats, below 2**53 in 64 bits; beyond, the bounds get room.
            size = float(np.abs(q).sum(1).max()) * float(max(max(abs(m[0]), abs(m[-1])) for m in marks)) * 4
            slack = 0.0 if size < 2**53 else size * 2.0**-40
            if size < 2**24:
                twice, spread = twice.astype(np.float32), spread.astype(np.float32)
            lists = candidates.column("ids").combine_chunks()
            ids, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))
            step = max(1, STEP_BOUNDS // len(v))
            for at in range(0, len(q), step):
                row, col, score = search(q[at : at + step], v, twice, spread, slack)
                # Equal vectors count once each: their first ids stand in order.
                many = np.diff(np.r_[0, ends])[col]
                each = np.repeat(np.arange(len(col)), many)
                vec = ids[np.repeat(ends[col] - many, many) + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]
                row, score = row[each], score[each]
                order = np.lexsort((vec, -score, row))
                place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                first = order[place < most]
                found.append((number[at : at + step][row[first]], score[first], vec[first]))
        c, score, vec = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({"c": pa.array(c, pa.int64()), "score": pa.array(score, pa.int64()), "vec_id": pa.array(vec, pa.int64())})

    return run


def top_inner_products(df: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", scale: int = 64, bits: int = 5, block: int = BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` highest integer inner products of each query with all rows but itself.

    Queries are the rows whose integer ``vec_id`` is divisible by ``every``. Ties go to the smaller id. Null and empty
    vectors, those with a null, NaN, infinite or too large component (``LARGEST``), those of another than the most
    frequent length, and rows without an id take no part. Rows that repeat are candidates of each other, and queries
    each. A query without other rows has no row. Other columns of ``df`` are not read.

    Equal vectors are one candidate with their ``k + 1`` smallest ids, and one query, so copies cost nothing. The cells
    of the distinct vectors are written down once (one byte a coordinate); blocks of queries meet blocks of candidates,
    each pair of blocks in one task whose memory the block size bounds.
    """
    spark = df.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    rows = written(integer_vectors(df.where(F.col("vec_id").isNotNull()), vector, scale, [F.col("vec_id").cast("bigint").alias("vec_id")]), "vectors")
    rows, dims = of_usual_length(rows)
    if not dims:
        return spark.createDataFrame([], out)
    first = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = written(distinct, "distinct")
    marks = cell_marks(distinct, dims, bits)
    candidates = written(distinct.mapInArrow(_cells_of(marks), "v array<int>, ids array<bigint>, cells binary"), "cells")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = written(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("c"), "v"), "queries")

    cores = spark.sparkContext.defaultParallelism
    n_queries, n_candidates = queries.count(), candidates.count()
    query_blocks, candidate_blocks = -(-n_queries // block) or 1, max(-(-n_candidates // block), min(2 * cores, -(-n_candidates // 256)))
    part = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("c", "v", part(query_blocks).alias("qb"), each(candidate_blocks).alias("cb"))
    right = candidates.select("v", "ids", "cells", part(candidate_blocks).alias("cb"), each(query_blocks).alias("qb"))
    near = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_best_of_block(marks, k + 1), "c bigint, score bigint, vec_id bigint")

    order = Window.partitionBy("c").orderBy(F.desc("score"), "vec_id")
    kept = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    # A query's rows as one value of at most k + 1 entries; then every row that asks takes them without its own.
    lists = kept.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("n", "score", "vec_id"))).alias("found"))
    lists = queries.join(lists, "c").select("v", F.transform("found", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id"))).alias("found"))
    own = F.struct(F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint") * x).alias("score"), F.col("vec_id").alias("vec_id"))
    mine = asked.join(lists, "v").select(F.col("vec_id").alias("query_id"), "found", F.coalesce(F.array_position("found", own), F.lit(0)).alias("at"))
    rest = mine.select("query_id", F.slice(F.filter("found", lambda x, i: i + 1 != F.col("at")), 1, k).alias("found"))
    return rest.select("query_id", F.posexplode("found").alias("n", "f")).select("query_id", (F.col("n") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
