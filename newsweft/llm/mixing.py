"""Mixing sources to target weights as a time-varying curriculum, with DataFrame functions only.

Each source has a weight and a schedule of that weight over training time. The integral of the schedule is the
source's cumulative token demand; inverting it assigns each taken document the time at which the demand reaches it,
and the documents are range-sorted by that time.

No source meets in one task: its documents are put in hash order in ``BUCKETS`` ranges, whose sums give each range
its start, so only the rows of one range are summed in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweft.llm.common import WORD

#: Weights by the rank of a source, repeating, and the schedule of each as multipliers at equal steps of training time.
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
SHARE = 1.5
MOST = 2
BUCKETS = 4096


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, rank, target) from (source, size) rows.

    Sources in order of code points, null last, take the weights in turn. Targets share ``share`` of all sizes by
    weight; none is above ``most`` times its source's size, and what such sources leave goes to the others by weight.
    That is min(cap, level * weight) with one level for all, found from running sums in order of cap / weight. The
    windows without a partition run over one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = (F.col("source_size") * most).cast("double")
    level, everything = Window.orderBy("ratio", "rank"), Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        weighed.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumns({"caps": F.sum("cap").over(upto), "rest": F.sum("weight").over(everything) - F.sum("weight").over(upto), "budget": F.sum("source_size").over(everything) * share})
        .withColumn("full", F.col("caps") + F.col("ratio") * F.col("rest") <= F.col("budget"))
    )
    open_cap = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))).over(everything)
    return summed.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (F.col("budget") - open_cap) / open_weight)).select("source", "source_size", "weight", "rank", "target")


def when_demanded(fraction: Column, schedule: Sequence[float]) -> Column:
    """The training time in [0, 1] at which ``fraction`` of a source's whole demand is reached.

    The schedule runs linearly between its multipliers; its integral, scaled to 1, is inverted piece by piece.
    """
    pieces, step = len(schedule) - 1, 1 / (len(schedule) - 1)
    total = sum((a + b) / 2 * step for a, b in zip(schedule, schedule[1:]))
    weights, below, out = [w / total for w in schedule], 0.0, None
    for k in range(pieces):
        a, b = weights[k], weights[k + 1]
        r = F.greatest(fraction - below, F.lit(0.0))
        at = F.lit(k * step) + F.lit(2.0) * r / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + r * (2 * (b - a) / step), F.lit(0.0))))
        below += (a + b) / 2 * step
        here = F.least(at, F.lit((k + 1) * step))
        out = F.when(fraction <= below, here) if out is None else out.when(fraction <= below, here)
    return out.otherwise(F.lit(1.0))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, weights: Sequence[float] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, share: float = SHARE, ordered: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, taken, first_pass, second_pass, position: the mix's share of each row.

    ``taken`` counts the words that the mix takes of a row, up to twice its size; a source's ``taken`` add up to its
    target rounded. ``position`` is the training time of the row's first pass, ``second_position`` of its second, null
    where there is none. If ``ordered``, the rows are range-sorted by position, those that are not taken last. Null sources are one
    source, null texts have size 0 and are never taken, repeated rows count each; columns of ``docs`` with the names
    of results give way to them. Empty input gives an empty result.
    """
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(size if size is not None else word_count(F.col("text")), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.lit("mix"), F.col(doc_id), F.col(source)).alias("h"),
    ).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    assert BUCKETS == 1 << 12
    key = [F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("k"), "bucket"]
    ranges = sized.groupBy(*key).agg(F.first("source").alias("source"), F.sum("size").alias("n"))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(ranges.select("source", F.col("n").alias("size")), weights, share)
    starts = ranges.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t")))
    starts = starts.select("k", "bucket", "start", "source_size", "target", "rank")
    row_id = F.col("row").getField(doc_id)
    within = Window.partitionBy("k", "bucket").orderBy("h", row_id, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sized.withColumn("k", key[0]).withColumn("upto", F.sum("size").over(within))
    placed = summed.join(starts, ["k", "bucket"]).withColumn("at", F.col("start") + F.col("upto") - F.col("size"))
    demand = F.round("target").cast("bigint")
    part = lambda turn: F.greatest(F.lit(0), F.least(demand - F.col("at") - turn * F.col("source_size"), F.col("size")))
    found = placed.withColumns({"first_pass": part(0), "second_pass": part(1)})
    for name, turn in (("position", 0), ("second_position", 1)):
        pass_ = F.col("first_pass" if turn == 0 else "second_pass")
        fraction = (F.col("at") + turn * F.col("source_size") + pass_ / 2) / F.col("target")
        when = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            when = F.when((F.col("rank") % len(schedules) == k) & (pass_ > 0), when_demanded(fraction, schedule)).otherwise(when)
        found = found.withColumn(name, when)
    new = ["size", "source_size", "target", "taken", "first_pass", "second_pass", "position", "second_position"]
    out = found.withColumn("taken", F.col("first_pass") + F.col("second_pass"))
    if ordered:
        out = out.orderBy(F.col("position").asc_nulls_last(), "h", row_id)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in new], *new)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The training set itself: each row once for each pass that takes at least half of it, in order of position.

    It has the columns of ``docs`` alone. A row without words is never demanded, so it goes.
    """
    marks = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[F.col(f"`{c}`") for c in ("doc_id", "source", "text")])
    mixed = mix(marks.withColumn("words", word_count(F.col("text"))).select("row", "doc_id", "source", "words"), size=F.col("words"), ordered=False, **options)
    passes = F.filter(F.array(F.struct(F.col("first_pass").alias("n"), F.col("position").alias("at")), F.struct(F.col("second_pass").alias("n"), F.col("second_position").alias("at"))), lambda p: p["n"] * 2 >= F.greatest(F.col("size"), F.lit(1)))
    return mixed.select("row", F.explode(passes).alias("p")).orderBy("p.at", F.col("row").getField("doc_id")).select("row.*")
