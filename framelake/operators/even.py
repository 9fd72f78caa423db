"""Ordered work on groups of any size: rows are dealt to ranges of the whole order, and what a range needs from earlier
ones is carried to it.

A window by group puts a group into one task. Here rows are sorted into ranges by (group, order), each of about
``per_task`` rows, so a group that holds all rows is dealt to all tasks. A range that begins inside a group gets a row with
what came before, from one row a range and group that crosses a border; there are fewer than two such rows a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import settle

PER_TASK = 1_000_000
#: Ranges that a smaller ``per_task`` may ask for: the driver gets samples and a row of each.
MOST_RANGES = 256


def ranged(rows: DataFrame, by: list[str], order: list[str], per_task: int = PER_TASK) -> DataFrame:
    """``rows`` (settled, as ranges are cut at sampled places) with the number of their range, _part. Equal rows may part.
    Past MOST_RANGES ranges grow instead, up to PER_TASK rows."""
    count = rows.count()
    n = max(1, min(-(-count // per_task), max(MOST_RANGES, -(-count // PER_TASK))))
    dealt = rows.withColumn("_tie", F.rand(7)).repartitionByRange(n, *by, *order, "_tie")
    return settle(dealt.drop("_tie").withColumn("_part", F.spark_partition_id()))


def carried(dealt: DataFrame, by: list[str], summary: Column, fold: Column, forward: bool = False) -> DataFrame:
    """(by, _part, _carry) for each range that begins (or ends, when ``forward`` is looked) inside a group: ``fold``, a column
    over the window of the ranges before (after) it, of each range's ``summary``, an aggregate named _sum."""
    spans = dealt.groupBy(*by).agg(F.min("_part").alias("_lo"), F.max("_part").alias("_hi")).filter("_lo < _hi")
    each = spans.select(*by, F.explode(F.sequence("_lo", "_hi")).alias("_part"))  # fewer than two a range
    each = each.withColumnsRenamed({c: f"_c{c}" for c in (*by, "_part")})
    within = dealt.join(F.broadcast(each), [F.col(c).eqNullSafe(F.col(f"_c{c}")) for c in (*by, "_part")], "left_semi")
    sums = within.groupBy(*by, "_part").agg(summary.alias("_sum"))
    w = Window.partitionBy(*by).orderBy(F.desc("_part") if forward else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "_part", fold.over(w).alias("_carry")).filter("_carry IS NOT NULL")


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], *, forward: bool = False, per_task: int = PER_TASK) -> DataFrame:
    """The rows of ``select.asof``, whatever a group's share: ``left`` with the columns ``take`` of the last row of ``right`` at
    or before its time (the first at or after it when forward)."""
    row = F.struct(*take)
    kind, own = right.select(row).schema[0].dataType, [c for c in left.columns if c not in (*by, on)]
    lefts = F.struct(*own) if own else F.struct(F.lit(1).alias("_one"))
    a = left.select(*by, on, lefts.alias("_left"), F.lit(None).cast(kind).alias("_right"), F.lit(1).alias("_side"))
    pick = F.min if forward else F.max
    b = right.groupBy(*by, on).agg(pick(row).alias("_right"))
    b = b.select(*by, on, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_right", F.lit(-1 if forward else 0).alias("_side"))
    # Looking back, rows of ``right`` come first among equal times; looking forward they come last.
    both = a.unionByName(b).withColumn("_side", F.when(F.col("_side") == 1, 0).otherwise(1) if forward else F.col("_side"))
    is_right = F.col("_right").isNotNull()
    dealt = ranged(both, by, [on, "_side"], per_task)
    nearest = F.struct(on, F.col("_right").alias("r"))
    summary = (F.min if forward else F.max)(F.when(is_right, nearest))
    carry = carried(dealt, by, summary, F.last(F.col("_sum")["r"], ignorenulls=True), forward)
    edge = carry.select(*by, F.lit(None).cast(dealt.schema[on].dataType).alias(on), F.lit(None).cast(dealt.schema["_left"].dataType).alias("_left"), F.col("_carry").alias("_right"), F.lit(None).cast("int").alias("_side"), "_part")
    w = Window.partitionBy("_part", *by)
    if forward:  # the carried row comes last
        w = w.orderBy(F.asc_nulls_last(on), F.asc_nulls_last("_side")).rowsBetween(0, Window.unboundedFollowing)
        found = F.first("_right", ignorenulls=True).over(w)
    else:
        w = w.orderBy(F.asc_nulls_first(on), F.asc_nulls_first("_side")).rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_right", ignorenulls=True).over(w)
    out = dealt.unionByName(edge).withColumn("_found", found).filter("_left IS NOT NULL")
    return out.select(*by, on, *(F.col("_left")[c].alias(c) for c in own), *(F.col("_found")[c].alias(c) for c in take))


def islands(rows: DataFrame, by: list[str], order: list[str], flag: Column, per_task: int = PER_TASK) -> DataFrame:
    """The rows of ``analysis.islands``, whatever a group's share: those where ``flag`` holds, with island, a number that
    neighbours (no unflagged row between) share. ``order`` is a total order of a group's rows."""
    dealt = ranged(rows.withColumn("_f", F.coalesce(flag, F.lit(False))), by, order, per_task)
    breaks = F.when(F.col("_f"), 0).otherwise(1)
    carry = carried(dealt, by, F.sum(breaks), F.sum("_sum"))
    own = Window.partitionBy("_part", *by).orderBy(*order)
    counted = dealt.withColumn("_b", F.sum(breaks).over(own)).filter("_f")
    named = carry.withColumnsRenamed({c: f"_c{c}" for c in (*by, "_part")})  # fewer than two rows a range
    met = counted.join(F.broadcast(named), [F.col(c).eqNullSafe(F.col(f"_c{c}")) for c in (*by, "_part")], "left")
    return met.select(*rows.columns, (F.col("_b") + F.coalesce("_carry", F.lit(0))).alias("island"))
