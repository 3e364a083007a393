"""Sharding by histogram sort.

Rows are keyed by (hash of the text, id), so copies of a text stand together.  Byte counts below candidate boundaries
are taken over all rows; boundaries that miss their tolerance are refined inside the one probe interval that holds
them, level by level, down to single keys.  When every splitter meets its tolerance the rows are exchanged once, by
the partition number that the splitters give, and numbered from the exact row counts below each splitter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweft.llm.common import materialise

SHARDS = 8
#: Largest error of a shard's boundary as a share of a shard, and of a partition's boundary as a share of a partition.
SHARD_TOLERANCE, PARTITION_TOLERANCE = 0.001, 0.25
PARTITION_BYTES = 128 << 20
MOST_PARTITIONS = 16384
#: Bits of the first histogram, at least and at most, and of each refinement.
_FIRST, _MOST_FIRST, _STEP = 12, 17, 8
_MIN, _END = -(1 << 63), (1 << 63, 0)

Key = tuple[int, int]


@dataclass
class Splitter:
    """A boundary: the rows with a smaller key number ``rows`` and take ``size`` bytes."""

    key: Key
    rows: int
    size: int


def _shifts(first: int = _FIRST) -> list[tuple[str, int]]:
    """(column, right shift) of each level: the hash's leading bits, then the rest of it, then the id's bits."""
    h = [("h", 64 - first)] + [("h", s) for s in range(64 - first - _STEP, 0, -_STEP)] + [("h", 0)]
    return h + [("id", s) for s in range(64 - _STEP, -1, -_STEP)]


def _prefix(level: tuple[str, int]) -> Column:
    return F.shiftright(level[0], level[1])


def _histogram(keys: DataFrame, levels: list[tuple[str, int]], at: int, active: list[tuple[int, ...]]) -> dict[tuple[int, ...], list[tuple[int, int, int]]]:
    """Exact (prefix, rows, bytes) at level ``at`` inside each active interval of the level before."""
    if at == 0:
        parents: list[Column] = []
        rows = keys
    else:
        column, shift = levels[at - 1]
        parents = [F.col("h"), _prefix(levels[at - 1])] if column == "id" else [F.col("h")] if levels[at][0] == "id" else [_prefix(levels[at - 1])]
        test = None
        for k, c in enumerate(parents):
            here = c.isin(sorted({a[k] for a in active}))
            test = here if test is None else test & here
        rows = keys.filter(test)
    names = [f"p{k}" for k in range(len(parents))]
    counted = rows.groupBy(*(c.alias(n) for c, n in zip(parents, names)), _prefix(levels[at]).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    out: dict[tuple[int, ...], list[tuple[int, int, int]]] = {a: [] for a in active}
    for r in counted.collect():
        if (parent := tuple(r[n] for n in names)) in out:
            out[parent].append((r["x"], r["n"], r["b"]))
    return {k: sorted(v) for k, v in out.items()}


def _key(level: tuple[str, int], parent: tuple[int, ...], prefix: int) -> Key:
    """The smallest key at or above a prefix."""
    column, shift = level
    if column == "h":
        return (prefix << shift, _MIN) if prefix << shift < 1 << 63 else _END
    return (parent[0], prefix << shift) if prefix << shift < 1 << 63 else (parent[0] + 1, _MIN) if parent[0] < (1 << 63) - 1 else _END


def find_splitters(keys: DataFrame, wanted: list[tuple[float, float]], first: dict | None = None, bits: int = _FIRST) -> list[Splitter]:
    """For each (bytes, tolerance) a splitter with that many bytes below it, as near as single keys allow.

    ``keys`` has h, id and size. A histogram holds at most 2**``bits`` intervals at the first level and 2**8 for each
    splitter that is still open at a later one.
    """
    levels = _shifts(bits)
    found: dict[int, Splitter] = {}
    open_: dict[int, tuple[tuple[int, ...], int, int]] = {k: ((), 0, 0) for k in range(len(wanted))}
    for at, level in enumerate(levels):
        if not open_:
            break
        counted = first if at == 0 and first is not None else _histogram(keys, levels, at, sorted({v[0] for v in open_.values()}))
        nxt: dict[int, tuple[tuple[int, ...], int, int]] = {}
        for k, (parent, rows, size) in open_.items():
            want, slack = wanted[k]
            last = Splitter(_END, rows, size)
            for prefix, n, b in counted[parent]:
                if size + b < want:
                    rows, size = rows + n, size + b
                    last = Splitter(_key(level, parent, prefix + 1), rows, size)
                    continue
                low, high = Splitter(_key(level, parent, prefix), rows, size), Splitter(_key(level, parent, prefix + 1), rows + n, size + b)
                near = min((low, high), key=lambda s: abs(s.size - want))
                if abs(near.size - want) <= slack or at == len(levels) - 1:
                    found[k] = near
                else:
                    inner = levels[at + 1][0]
                    keep = (parent[0], prefix) if level[0] == "id" else (prefix,)
                    nxt[k] = (keep if inner == level[0] or inner == "id" else keep, rows, size)
                break
            else:
                found[k] = last
        open_ = nxt
    return [found[k] for k in range(len(wanted))]


def shard(docs: DataFrame, size: Column, group: Column, row_id: Column, shards: int = SHARDS, tolerance: float = SHARD_TOLERANCE) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: near equal bytes in each shard, gapless slots from 0 within it.

    ``group`` is a 64-bit hash that equal texts share: they stay together but where a splitter has to cut them to
    meet the tolerance. ``row_id`` orders the rows of a group; null counts as the smallest id, and rows that share
    group and id can't be told apart and stay in one shard. Each shard is exchanged as several partitions of about
    PARTITION_BYTES, each sorted by key. Empty input gives an empty result; columns of ``docs`` named shard or slot
    give way.
    """
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        group.cast("bigint").alias("h"),
        F.coalesce(row_id.cast("bigint"), F.lit(_MIN)).alias("id"),
        size.cast("bigint").alias("size"),
    )
    keys = materialise(keyed.select("h", "id", "size"), "shard-keys")
    levels = _shifts()
    first = _histogram(keys, levels, 0, [()])
    total, n = sum(b for _, _, b in first[()]), sum(r for _, r, _ in first[()])
    each = max(1, min(-(-total // (shards * PARTITION_BYTES)), MOST_PARTITIONS // shards))
    parts = shards * each
    # Eight intervals a partition settle nearly all partitions at once.
    bits = min(_MOST_FIRST, max(_FIRST, (parts - 1).bit_length() + 3))
    if bits > _FIRST:
        levels = _shifts(bits)
        first = _histogram(keys, levels, 0, [()])
    per = total / parts
    wanted = [(per * k, total / shards * tolerance if k % each == 0 else per * PARTITION_TOLERANCE) for k in range(1, parts)]
    cuts = find_splitters(keys, wanted, first, bits)
    for left, right in zip(cuts, cuts[1:]):
        if right.key < left.key:
            right.key, right.rows, right.size = left.key, left.rows, left.size
    # The partition of a row: how many splitters are at or below its key. Whole probe intervals look it up; a splitter inside one is compared.
    shift, low = levels[0][1], -(1 << (bits - 1))
    inside = [c.key for c in cuts if c.key != _END and (c.key[1] != _MIN or c.key[0] & ((1 << shift) - 1))]
    whole = sorted(c.key[0] >> shift for c in cuts if c.key != _END and c.key not in inside)
    table, k = [], 0
    for x in range(low, -low):
        while k < len(whole) and whole[k] <= x:
            k += 1
        table.append(k)
    place = F.expr(f"element_at(array({','.join(map(str, table))}), cast(shiftright(h, {shift}) as int) + {1 - low})")
    for h, i in inside:
        place = place + ((F.col("h") > h) | ((F.col("h") == h) & (F.col("id") >= i))).cast("int")
    starts = [0, *(c.rows for c in cuts)]
    base = [starts[p] - starts[p - p % each] for p in range(parts)]
    dealt = keyed.withColumn("part", place).repartitionById(parts, F.col("part")).sortWithinPartitions("h", "id")
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = dealt.withColumn("n", local)
    slot = F.expr(f"element_at(array({','.join(f'{b}L' for b in base)}), part + 1)") + F.col("n")
    shard_ = F.expr(f"cast(part div {each} as int)")
    return numbered.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")], shard_.alias("shard"), slot.alias("slot"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_group(text: Column) -> Column:
    return F.xxhash64(text)
