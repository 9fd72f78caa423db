"""Segmenting, playlists, renditions, concatenation, sprite sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import select


def fixed_segments(frames: DataFrame, by: list[str], t: str, length: int) -> DataFrame:
    return frames.withColumn("segment", F.floor(F.col(t) / length).cast("long"))


def keyframe_segments(frames: DataFrame, by: list[str], t: str, is_key: str, length: int) -> DataFrame:
    """Cuts at the first key frame at or after each multiple of ``length``: a frame's segment is the length bucket of
    the last key frame that opened a new one."""
    w = Window.partitionBy(*by).orderBy(t)
    bucket = F.when(F.col(is_key), F.floor(F.col(t) / length))
    reached = frames.withColumn("_b", F.coalesce(F.max(bucket).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)))
    return reached.withColumn("segment", F.dense_rank().over(Window.partitionBy(*by).orderBy("_b")) - 1).drop("_b")


def playlist(segmented: DataFrame, by: list[str], t: str, last: int | None = None) -> DataFrame:
    """(by, segment, start, end, n) in order; only the ``last`` segments for a rolling list."""
    got = segmented.groupBy(*by, "segment").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))
    if last is None:
        return got
    w = Window.partitionBy(*by).orderBy(F.desc("segment"))
    return got.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last).drop("_r")


#: Standard renditions (height, video bits a second): fixed values.
LADDER = [(1080, 5_000_000), (720, 2_800_000), (480, 1_400_000), (360, 800_000)]


def ladder(sources: DataFrame, renditions: list[tuple[int, int]] = LADDER) -> DataFrame:
    """Each source (width, height) at each rendition that isn't larger than it, in ladder order; widths are even."""
    if not renditions:
        raise ValueError("at least one rendition")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(h).alias("out_height"), F.lit(b).alias("bitrate")) for i, (h, b) in enumerate(renditions)))).alias("r")
    out = sources.select("*", each).select(*sources.columns, "r.*").filter("out_height <= height")
    return out.withColumn("out_width", (F.round(F.col("width") * F.col("out_height") / F.col("height") / 2) * 2).cast("int"))


def drop_late(frames: DataFrame, clock: DataFrame, by: list[str], t: str, period: int) -> DataFrame:
    """Frames not more than one period behind the master clock at their arrival (clock: by, seq, clock)."""
    return frames.join(clock, [*by, "seq"]).filter(F.col(t) - F.col("clock") >= -period)


def concat(parts: DataFrame, order: str, t: str, length: str) -> DataFrame:
    """Inputs (part, t, ...) one after the other: each part's own first time is kept."""
    ends = parts.groupBy(order).agg((F.max(t) + F.max(length)).alias("_len"))
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    starts = ends.withColumn("_start", F.coalesce(F.sum("_len").over(w), F.lit(0))).select(order, "_start")
    return parts.join(starts, order).withColumn(t, F.col(t) + F.col("_start")).drop("_start")


def freeze(frames: DataFrame, t: str, at: int, count: int, step: int) -> DataFrame:
    """The frame at ``at`` shown ``count`` more times; later frames follow."""
    copies = F.explode(F.when(F.col(t) == at, F.sequence(F.lit(0), F.lit(count))).otherwise(F.array(F.lit(0))))
    return frames.withColumn("_c", copies).withColumn(t, F.col(t) + F.when(F.col(t) > at, count * step).otherwise(F.col("_c") * step)).drop("_c")


def sprite_cells(duration: int, columns: int, rows: int) -> list[tuple[int, int, int]]:
    """(time, column, row) of evenly spaced thumbnails, row by row."""
    n = columns * rows
    return [(duration * i // n, i % columns, i // columns) for i in range(n)]


def thumbnails(rows: DataFrame, by: list[str], t: str, count: int, take: list[str], columns: int | None = None, key: Column | None = None) -> DataFrame:
    """(by, i, at, t, take): the last key frame at or before each of i * (duration div count), i from 0, of each group (times
    from 0); every row is one if ``key`` is None. Places without one before them are left out, as are groups that last no
    time. With ``columns`` also each thumbnail's place on a sheet. Grid points come from one small row a group."""
    if count < 1 or columns is not None and columns < 1:
        raise ValueError("at least one thumbnail and one column")
    ends = rows.groupBy(*by).agg(F.max(t).alias("_d")).filter("_d > 0")
    grid = ends.select(*by, "_d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("i"))
    grid = grid.select(*by, "i", F.expr(f"i * (_d div {count})").alias("_at")).withColumn("at", F.col("_at"))
    shown = rows if key is None else rows.filter(key)
    found = select.asof(grid, shown.withColumn("_at", F.col(t)), by, "_at", [t, *take]).drop("_at").filter(F.col(t).isNotNull())
    if columns is None:
        return found
    return found.withColumns({"col": (F.col("i") % columns).cast("int"), "row": F.floor(F.col("i") / columns).cast("int")})
