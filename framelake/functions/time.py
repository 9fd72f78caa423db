"""Exact time arithmetic on integer columns: rationals, rescaling, frames, timecode, beats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NS = 1_000_000_000


def _big(value) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("decimal(38,0)")


def half_away(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator of integers, rounded half away from zero; exact. Null for a zero denominator."""
    n, d = _big(numerator), _big(denominator)
    n, d = F.when(d < 0, -n).otherwise(n), F.abs(d)
    whole = (F.abs(n) * 2 + d - F.pmod(F.abs(n) * 2 + d, d * 2)) / (d * 2)
    return F.when(d != 0, F.signum(n).cast("long") * whole.cast("decimal(38,0)").cast("long"))


@F.arrow_udf(T.LongType())
def _gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    """The greatest common divisor of each pair of longs; null if one is null."""
    size = lambda x: np.abs(x.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.uint64)  # noqa: E731  the least long has a size too
    return pc.if_else(pc.and_(a.is_valid(), b.is_valid()), pa.array(np.gcd(size(a), size(b)).astype(np.int64)), pa.scalar(None, pa.int64()))


def reduce_ratio(num: Column, den: Column) -> Column:
    """A rational in lowest terms with a positive denominator. Null for a zero denominator."""
    gcd = _gcd(num.cast("long"), den.cast("long"))
    sign = F.when(den < 0, -1).otherwise(1)
    return F.when(den != 0, F.struct((sign * F.call_function("div", num.cast("long"), gcd)).cast("long").alias("num"), F.call_function("div", F.abs(den).cast("long"), gcd).alias("den")))


def ratio_sum(an: Column, ad: Column, bn: Column, bd: Column, minus: bool = False) -> Column:
    """a + b (or a - b) in lowest terms; null if a part doesn't fit a long."""
    n, other = _big(an) * _big(bd), _big(bn) * _big(ad)
    return _fitting(n - other if minus else n + other, _big(ad) * _big(bd))


def ratio_product(an: Column, ad: Column, bn: Column, bd: Column) -> Column:
    return _fitting(_big(an) * _big(bn), _big(ad) * _big(bd))


def ratio_quotient(an: Column, ad: Column, bn: Column, bd: Column) -> Column:
    """a / b in lowest terms; null for b = 0."""
    return _fitting(_big(an) * _big(bd), _big(ad) * _big(bn))


def ratio_inverse(num: Column, den: Column) -> Column:
    return reduce_ratio(den, num)


def _fitting(num: Column, den: Column) -> Column:
    top = F.lit((1 << 63) - 1)
    fits = (F.abs(num) <= top) & (F.abs(den) <= top)
    return reduce_ratio(F.when(fits, num.cast("long")), F.when(fits, den.cast("long")))


def compare_ratios(an: Column, ad: Column, bn: Column, bd: Column) -> Column:
    """-1, 0 or 1, by cross-multiplication; denominators are positive."""
    return F.signum(_big(an) * _big(bd) - _big(bn) * _big(ad)).cast("int")


def rescale(pts: Column, from_num: Column, from_den: Column, to_num: Column, to_den: Column) -> Column:
    """A timestamp in another time base."""
    return half_away(_big(pts) * _big(from_num) * _big(to_den), _big(from_den) * _big(to_num))


def frame_index(seconds: Column, fps: Column) -> Column:
    """Nearest frame, half away from zero; null for negative, non-finite or rateless input."""
    valid = (fps > 0) & (seconds >= 0) & ~F.isnan(seconds) & (seconds < float("inf"))
    return F.when(valid, F.round(seconds * fps).cast("long"))


def frame_start_ns(frame: Column, num: Column, den: Column) -> Column:
    """Start of a frame at rate num/den."""
    return half_away(_big(frame) * _big(den) * NS, num)


def nominal_rate(num: Column, den: Column) -> Column:
    return F.round(num / den).cast("long")


def is_drop_rate(num: Column, den: Column) -> Column:
    """Rates just below a multiple of 30 count with dropped names."""
    return (num % den != 0) & (nominal_rate(num, den) % 30 == 0)


def timecode(frame: Column, num: Column, den: Column) -> Column:
    """HH:MM:SS:FF, or HH:MM:SS;FF with dropped names (2 a minute for each 30 of the nominal rate, but for every tenth
    minute); wraps at 24 hours. Null for negative frames."""
    fps = nominal_rate(num, den)
    drop = is_drop_rate(num, den)
    dropped = F.when(drop, F.floor(fps / 30) * 2).otherwise(0)
    per_minute = fps * 60 - dropped
    per_ten = fps * 600 - dropped * 9
    day = per_ten * 144
    f = F.pmod(frame, day)
    tens, rest = F.floor(f / per_ten), f % per_ten
    more = F.when(rest >= fps * 60, F.floor((rest - fps * 60) / per_minute) + 1).otherwise(0)
    named = f + dropped * (tens * 9 + more)
    part = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.when(
        frame >= 0,
        F.concat(
            part(F.floor(named / (fps * 3600)) % 24), F.lit(":"), part(F.floor(named / (fps * 60)) % 60), F.lit(":"), part(F.floor(named / fps) % 60), F.when(drop, ";").otherwise(":"), part(named % fps)
        ),
    )


def parse_timecode(text: Column, num: Column, den: Column) -> Column:
    """Frame number of a timecode; null if it doesn't parse or names a dropped frame."""
    fps, drop = nominal_rate(num, den), is_drop_rate(num, den)
    part = lambda i: F.regexp_extract(text, r"^(\d{2}):(\d{2}):(\d{2})[:;](\d{2})$", i)
    h, m, s, f = (F.when(part(i) != "", part(i).cast("long")) for i in range(1, 5))
    dropped = F.when(drop, F.floor(fps / 30) * 2).otherwise(0)
    minutes = h * 60 + m
    frame = (minutes * 60 + s) * fps + f - dropped * (minutes - F.floor(minutes / 10))
    gone = drop & (m % 10 != 0) & (s == 0) & (f < dropped)
    return F.when((h < 24) & (m < 60) & (s < 60) & (f < fps) & ~gone, frame.cast("long"))


def beat_to_ns(beat_num: Column, beat_den: Column, bpm_num: Column, bpm_den: Column) -> Column:
    return half_away(_big(beat_num) * 60 * _big(bpm_den) * NS, _big(beat_den) * _big(bpm_num))


def ns_to_beat(ns: Column, bpm_num: Column, bpm_den: Column, subdivision: int) -> Column:
    """Nearest beat in units of 1/subdivision."""
    return half_away(_big(ns) * _big(bpm_num) * subdivision, _big(bpm_den) * 60 * NS)
