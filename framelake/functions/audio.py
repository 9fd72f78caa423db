"""Level and gain functions of samples."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_db(linear: Column) -> Column:
    """20 log10; -infinity for 0."""
    return F.when(linear > 0, 20 * F.log10(linear)).otherwise(F.lit(float("-inf")))


def from_db(db: Column | float) -> Column:
    return F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / 20)


def ramp_in(t: Column, start: float, duration: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - start) / duration))


def ramp_out(t: Column, start: float, duration: float) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (t - start) / duration))


def pan_gains(pan: Column) -> tuple[Column, Column]:
    """Constant-power gains of left and right; pan in [-1, 1]."""
    angle = (pan + 1) * (math.pi / 4)
    return F.cos(angle), F.sin(angle)


def compress(v: Column, threshold_db: float, ratio: float, makeup_db: float = 0.0) -> Column:
    """The static curve: levels above the threshold rise by 1/ratio."""
    over = to_db(F.abs(v)) - threshold_db
    gain = F.when(over > 0, -over * (1 - 1 / ratio)).otherwise(0.0) + makeup_db
    return v * from_db(gain)


def gate(v: Column, threshold_db: float) -> Column:
    return F.when(F.abs(v) >= 10 ** (threshold_db / 20), v).otherwise(0.0)


def tempo_chain(factor: float) -> list[float]:
    """A tempo factor as factors within [0.5, 2]."""
    if factor <= 0:
        raise ValueError("tempo factor must be positive")
    out = []
    while factor > 2:
        out.append(2.0)
        factor /= 2
    while factor < 0.5:
        out.append(0.5)
        factor /= 0.5
    return [*out, factor]
