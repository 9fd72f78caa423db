"""Plane layouts, placement, padding and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interleave(planes: Column) -> Column:
    """array<array> of equally long planes to one array: sample by sample."""
    return F.flatten(F.transform(F.get(planes, 0), lambda _, i: F.transform(planes, lambda p: F.get(p, i))))


def deinterleave(packed: Column, channels: int) -> Column:
    return F.array(*(_every(packed, c, channels) for c in range(channels)))


def _every(packed: Column, first: int, step: int) -> Column:
    count = F.greatest(F.lit(0), F.ceil((F.size(packed) - first) / step).cast("int"))
    return F.transform(F.slice(packed, F.lit(1), count), lambda _, i: F.get(packed, i * step + first))


def remove_stride(plane: Column, width: int, stride: int, height: int) -> Column:
    """The picture's bytes without the padding at the end of each row."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.slice(plane, r * stride + 1, F.lit(width))))


def fit_factors(mode: str, sw: Column, sh: Column, w: int, h: int) -> tuple[Column, Column]:
    """Scale factors of a source in a canvas: none, stretch, fit (contained) or fill (covering)."""
    x, y = w / sw, h / sh
    if mode == "none":
        return F.lit(1.0), F.lit(1.0)
    if mode == "stretch":
        return x, y
    if mode == "fit":
        return F.least(x, y), F.least(x, y)
    if mode == "fill":
        return F.greatest(x, y), F.greatest(x, y)
    raise ValueError(f"unknown fit mode {mode!r}")


def merged_value(track: Column, static: Column, automation: Column, neutral: float) -> Column:
    """The clip's own track, else its static value if that isn't neutral, else the track's automation, else neutral."""
    return F.coalesce(track, F.nullif(static, F.lit(neutral)), automation, F.lit(neutral))


def snap(ns: Column, fps: float) -> Column:
    """Nearest frame's time."""
    return F.round(F.round(ns / 1e9 * fps) / fps * 1e9).cast("long")


def hold_last(frames: DataFrame, by: list[str], n: str, until: int) -> DataFrame:
    """Each group's last row repeated up to position ``until`` (exclusive)."""
    w = Window.partitionBy(*by).orderBy(F.desc(n))
    last = frames.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    more = last.withColumn("_n", F.explode(F.when(F.col(n) + 1 < until, F.sequence(F.col(n) + 1, F.lit(until - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    return frames.unionByName(more.withColumn(n, F.col("_n")).drop("_n"))


def fill_gaps(frames: DataFrame, by: list[str], n: str, value: str, fill, least: int = 2) -> DataFrame:
    """Rows for the missing numbers of gaps longer than ``least`` periods."""
    w = Window.partitionBy(*by).orderBy(n)
    gaps = frames.withColumn("_next", F.lead(n).over(w)).filter(F.col("_next") - F.col(n) > least)
    made = gaps.select(*by, F.explode(F.sequence(F.col(n) + 1, F.col("_next") - 1)).alias(n)).withColumn(value, F.lit(fill).cast(frames.schema[value].dataType))
    return frames.select(*by, n, value).unionByName(made)


def count_mismatch(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b): groups whose row counts differ."""
    counts = [df.groupBy(*by).agg(F.count("*").alias(c)) for df, c in ((a, "a"), (b, "b"))]
    both = counts[0].join(counts[1], by, "full_outer").na.fill(0, ["a", "b"])
    return both.filter("a <> b")
