"""Range, point and sampling selections on rows with a time column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trim(rows: DataFrame, t: str, start=None, end=None) -> DataFrame:
    """Rows in [start, end); a bound that is None is open. Plain comparisons, so scans get the bounds pushed down."""
    if start is not None and end is not None and start >= end:
        raise ValueError(f"empty range: {start} >= {end}")
    if start is not None:
        rows = rows.filter(F.col(t) >= start)
    return rows if end is None else rows.filter(F.col(t) < end)


def rebase(rows: DataFrame, t: str, by: list[str]) -> DataFrame:
    """Each group's times from 0."""
    first = rows.groupBy(*by).agg(F.min(t).alias("_first"))
    return rows.join(first, by).withColumn(t, F.col(t) - F.col("_first")).drop("_first")


def shift(rows: DataFrame, t: str, by) -> DataFrame:
    return rows.withColumn(t, F.col(t) + by)


def speed(rows: DataFrame, t: str, factor: float) -> DataFrame:
    if not 0.1 <= factor <= 100:
        raise ValueError("speed must be within [0.1, 100]")
    return rows.withColumn(t, F.col(t) / factor)


def reversed_time(rows: DataFrame, t: str, by: list[str]) -> DataFrame:
    """Time mirrored within each group."""
    ends = rows.groupBy(*by).agg((F.min(t) + F.max(t)).alias("_sum"))
    return rows.join(ends, by).withColumn(t, F.col("_sum") - F.col(t)).drop("_sum")


def every_nth(rows: DataFrame, order: list, by: list[str], n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_i", F.row_number().over(w) - 1).filter(F.col("_i") % n == 0).drop("_i")


def set_params(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Parameters (columns of ``rows``) that are set replace what stands; nulls leave it."""
    unknown = set(new) - set(rows.columns)
    if unknown:
        raise ValueError(f"no such parameters: {sorted(unknown)}")
    return rows.withColumns({k: F.coalesce(v, F.col(k)) for k, v in new.items()})


def keyframes(packets: DataFrame, is_key: Column) -> DataFrame:
    """Key packets' times: pts, else dts; null and negative times are dropped."""
    return packets.filter(is_key).withColumn("ts", F.coalesce("pts", "dts")).filter(F.col("ts") >= 0)


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], *, forward: bool = False) -> DataFrame:
    """``left`` with the columns ``take`` of the last row of ``right`` at or before its time (the first at or after it
    when forward), within the groups ``by``; nulls where there is none. Equal times of ``right`` count by their order
    in the columns taken: the greatest backward, the least forward. One shuffle: a union and a window."""
    inner = [F.col(c) for c in (*by, on)]
    row = F.struct(*take)
    a = left.select(*inner, F.struct(*(c for c in left.columns if c not in (*by, on))).alias("_left"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("_right"), F.lit(1).alias("_side"))
    pick = F.min if forward else F.max
    b = right.groupBy(*by, on).agg(pick(row).alias("_right"))
    b = b.select(*inner, F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_right", F.lit(0).alias("_side"))
    # Looking back, rows of ``right`` come first among equal times; looking forward they come last.
    order = [F.col(on), -F.col("_side") if forward else F.col("_side")]
    w = Window.partitionBy(*by).orderBy(*order)
    if forward:
        found = F.first("_right", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = a.unionByName(b).withColumn("_found", found).filter("_side = 1")
    return both.select(*by, on, "_left.*", *(F.col("_found")[c].alias(c) for c in take))


def points(at: DataFrame, frames: DataFrame, by: list[str], t: str, take: list[str]) -> DataFrame:
    """``at`` with the first frame at or after each time; raises when executed if there is none."""
    found = asof(at, frames, by, t, take, forward=True)
    none = F.raise_error(F.concat(F.lit("no frame at "), F.col(t).cast("string")))
    return found.withColumns({c: F.coalesce(F.col(c), none.cast(found.schema[c].dataType)) for c in take[:1]})


def sample_grid(rows: DataFrame, by: list[str], t: str, step: int, take: list[str]) -> DataFrame:
    """The first row at or after each of 0, step, 2 step ... before the group's end; grid points without one are
    skipped."""
    if step <= 0:
        raise ValueError("step must be positive")
    ends = rows.groupBy(*by).agg(F.max(t).alias("_end"))
    grid = ends.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("_end")), F.lit(step).cast("long"))).alias(t))
    found = asof(grid.withColumnRenamed(t, "_at").withColumn("grid", F.col("_at")), rows.withColumn("_at", F.col(t)), by, "_at", [t, *take], forward=True)
    return found.drop("_at").filter(F.col(t).isNotNull())


def conform(frames: DataFrame, by: list[str], t_ns: str, fps_num: int, fps_den: int, take: list[str]) -> DataFrame:
    """Output frame k shows the newest source frame with time <= k / fps; the first one before any; ends after the last
    source frame."""
    ends = frames.groupBy(*by).agg(F.max(t_ns).alias("_end"), F.min(t_ns).alias("_begin"))
    count = F.floor(F.col("_end") * fps_num / (fps_den * 1_000_000_000)).cast("long")
    grid = ends.select(*by, "_begin", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(0)))).alias("k"))
    # The source's nanoseconds are rounded, so a frame due exactly at k / fps counts.
    at = F.round(F.col("k") * (fps_den * 1_000_000_000) / fps_num).cast("long")
    grid = grid.withColumn("_at", F.greatest(at, F.col("_begin"))).drop("_begin")
    return asof(grid, frames.withColumn("_at", F.col(t_ns)), by, "_at", take).drop("_at")


def active_tracks(tracks: DataFrame, kind: str = "kind") -> DataFrame:
    """Tracks that play: enabled, not muted, and soloed if any of the same timeline and kind is."""
    w = Window.partitionBy("timeline_id", kind)
    return tracks.withColumn("_solo", F.max(F.col("solo").cast("int")).over(w)).filter("enabled AND NOT mute AND (_solo = 0 OR solo)").drop("_solo")
