"""Easing curves of keyframe segments: u(t) for t in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cubic(t: Column, p1: Column, p2: Column) -> Column:
    return 3 * (1 - t) * (1 - t) * t * p1 + 3 * (1 - t) * t * t * p2 + t * t * t


def _slope(t: Column, p1: Column, p2: Column) -> Column:
    return 3 * (1 - t) * (1 - t) * p1 + 6 * (1 - t) * t * (p2 - p1) + 3 * t * t * (1 - p2)


def bezier(t: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Cubic timing curve: four Newton steps for the parameter (stopped where the slope vanishes), then its height."""
    x1, x2 = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) for x in (x1, x2))
    start = F.struct(t.cast("double").alias("s"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        slope = _slope(acc["s"], x1, x2)
        flat = acc["done"] | (F.abs(slope) < 1e-10)
        new = acc["s"] - (_cubic(acc["s"], x1, x2) - t) / F.when(flat, F.lit(1.0)).otherwise(slope)
        return F.struct(F.when(flat, acc["s"]).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), new))).alias("s"), flat.alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step, lambda acc: _cubic(acc["s"], y1, y2))


def ease(kind: Column, t: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    t = t.cast("double")
    return (
        F.when(kind == "hold", F.when(t >= 1, 1.0).otherwise(0.0))
        .when(kind == "ease_in", t * t * t)
        .when(kind == "ease_out", 1 - (1 - t) * (1 - t) * (1 - t))
        .when(kind == "ease_in_out", 3 * t * t - 2 * t * t * t)
        .when(kind == "bezier", bezier(t, x1, y1, x2, y2))
        .otherwise(t)
    )


def smoothstep(low: float | Column, high: float | Column, x: Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / F.when(high == low, F.lit(1e-12)).otherwise(high - low)))
    return t * t * (3 - 2 * t)
