"""Helpers shared by the training-data operators: scratch tables, text slabs and ASCII-whitespace words."""

from __future__ import annotations

import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Python step handles at a time; bounds the memory of every Arrow operator.
SLAB_BYTES = 4 << 20
#: The words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that would be a folder of each
    machine, so it is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="newsweft-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/newsweft/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of which each row will be many, in partitions of some ``rows`` each, and at least one for each core."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def is_held_out(doc_id: str = "doc_id", modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is 2. A null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus) == 2


def with_fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, however its columns are named."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"__{name}{i or ''}" for i in itertools.count()) if n.lower() not in taken)


def slabs(texts: pa.Array, most: int = SLAB_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) with at most ``most`` bytes each, or one longer text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document of each word, code of each word, distinct words) for texts without nulls."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    docs = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))
    keep = np.asarray(pc.binary_length(flat)) > 0
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return docs[keep], np.asarray(coded.indices)[keep], coded.dictionary


def release() -> None:
    """Hand freed memory back to the machine; workers that Spark uses again would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freeing(step):
    """``step`` of mapInArrow, at whose end the task hands back what the worker would keep while other stages run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        release()

    return run


def word_hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of each word with seed 42, as signed integers: what Spark's xxhash64 gives."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 42) for w in words.to_pylist()), np.uint64, len(words)).view(np.int64)


@cache
def _tabulation() -> np.ndarray:
    return np.random.default_rng(42).integers(1, 1 << 63, (64, 256), np.uint64) | np.uint64(1)


def byte_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each large string: a random number for each byte at each place, summed, with a factor for every 64 bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    size = np.diff(offsets)
    if not size.sum():
        return np.zeros(len(words), np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size)
    parts = _tabulation()[place & 63, data] * (((place >> 6).astype(np.uint64) << np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
    some, out = size > 0, np.zeros(len(words), np.uint64)
    out[some] = np.add.reduceat(parts, (offsets[:-1] - offsets[0])[some])
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xBF58476D1CE4E5B9)


# A set of hashes as a bitmap of fixed size

BITMAP_BITS = 25


def _two_bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << BITMAP_BITS) - 1)
    return (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64), (h & low).astype(np.int64)


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the set; none that is in it is missed."""
    one, two = _two_bits(hashes)
    near = np.flatnonzero(_has(bitmap, one))
    return near[_has(bitmap, two[near])]


def bitmap_of(hashes: DataFrame, column: str) -> np.ndarray:
    """Two bits of each 64-bit hash; 2**BITMAP_BITS bits, 4 MB, however many hashes there are."""
    h = F.col(column)
    top, low = F.shiftrightunsigned(h, 64 - BITMAP_BITS), h.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bits = hashes.select(F.explode(F.array(top, low)).alias("bit")).select((F.col("bit") + 1).alias("bit"))
    made = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in made.collect():
        part = np.frombuffer(r["bits"], np.uint8)
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(part)] |= part[: len(out) - at]
    return out
