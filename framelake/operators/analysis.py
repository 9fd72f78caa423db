"""Bucketed levels, islands, histograms, picture quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import to_db


def waveform(samples: DataFrame, by: list[str], t: str, value: str, width: int, *, fill: bool = True) -> DataFrame:
    """(by, bucket, peak, rms) levels in linear units for each bucket of ``width`` from time 0 on; empty buckets
    before and between full ones come with level 0 when ``fill`` (times before 0 keep their buckets). The aggregation combines before its one shuffle; only buckets are densified."""
    if width <= 0:
        raise ValueError("the width of a bucket must be positive")
    got = samples.groupBy(*by, F.floor(F.col(t) / width).alias("bucket")).agg(F.max(F.abs(value)).alias("peak"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    if not fill:
        return got
    w = Window.partitionBy(*by).orderBy("bucket")
    first = F.coalesce(F.lag("bucket").over(w) + 1, F.least(F.lit(0), F.col("bucket")))
    rows = got.withColumn("_first", first).withColumn("_b", F.explode(F.sequence(F.col("_first"), F.col("bucket"))))
    real = F.col("_b") == F.col("bucket")
    return rows.select(*by, F.col("_b").alias("bucket"), *(F.when(real, F.col(c)).otherwise(0.0).alias(c) for c in ("peak", "rms")))


def levels_db(wave: DataFrame) -> DataFrame:
    return wave.withColumns({"peak_db": to_db(F.col("peak")), "rms_db": to_db(F.col("rms"))})


def islands(rows: DataFrame, by: list[str], order: list[str], flag: Column) -> DataFrame:
    """Rows where ``flag`` holds, with island: a number that neighbours (no unflagged row between) share."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("island", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w)).filter("_f").drop("_f")


def silence(samples: DataFrame, by: list[str], t: str, value: str, threshold_db: float = -40.0, least: int = 500_000_000) -> DataFrame:
    """(by, start, end): quiet stretches of at least ``least`` that end; one that runs to the stream's end is dropped.
    end is the time of the sample that breaks the silence."""
    quiet = F.abs(value) <= 10 ** (threshold_db / 20)
    times = samples.groupBy(*by, t).agg(F.min(quiet).alias("_q"))  # channels at one time are quiet together
    w = Window.partitionBy(*by).orderBy(t)
    marked = times.withColumn("_next", F.lead(t).over(w))
    runs = islands(marked, by, [t], F.col("_q")).groupBy(*by, "island").agg(F.min(t).alias("start"), F.max(F.struct(t, "_next"))["_next"].alias("end"))
    return runs.filter(F.col("end").isNotNull() & (F.col("end") - F.col("start") >= least)).drop("island")


def black_starts(frames: DataFrame, by: list[str], t: str, dark_share: str, threshold: float = 0.1, least: int = 100_000_000) -> DataFrame:
    """Starts of stretches of frames whose share of black pixels is at least ``threshold``."""
    w = Window.partitionBy(*by).orderBy(t)
    times = frames.groupBy(*by, t).agg(F.min(dark_share).alias(dark_share))  # frames at one time are dark together
    marked = times.withColumn("_next", F.lead(t).over(w))
    runs = islands(marked, by, [t], F.col(dark_share) >= threshold).groupBy(*by, "island").agg(F.min(t).alias("start"), F.max(F.coalesce("_next", t)).alias("end"))
    return runs.filter(F.col("end") - F.col("start") >= least).drop("island", "end")


def scene_cuts(scores: DataFrame, by: list[str], t: str, score: str, threshold: float = 0.4) -> DataFrame:
    """Times at which the score rises above the threshold; negative times are dropped."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be within [0, 1]")
    return scores.filter((F.col(score) > threshold) & (F.col(t) >= 0)).select(*by, t)


def frame_difference(pixels: DataFrame, frame: str = "frame_no") -> DataFrame:
    """Mean absolute difference of each frame from the one before: one equi-join on the position."""
    before = pixels.select((F.col(frame) + 1).alias(frame), "x", "y", *(F.col(c).alias(f"_{c}") for c in "rgb"))
    d = sum(F.abs(F.col(c) - F.col(f"_{c}")) for c in "rgb") / 3
    return pixels.join(before, [frame, "x", "y"]).groupBy(frame).agg(F.avg(d).alias("score"))


def histogram(pixels: DataFrame, channels: dict[str, Column], frame: str = "frame_no", bins: int = 256) -> DataFrame:
    """(frame, channel, bin, n) of byte-valued channels, all bins present."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), v.cast("int").alias("bin")) for c, v in channels.items()))).alias("p")
    got = pixels.select(frame, pairs).groupBy(frame, "p.channel", "p.bin").agg(F.count("*").alias("n"))
    grid = pixels.select(frame).distinct().select(frame, F.explode(F.array(*map(F.lit, channels))).alias("channel")).select(frame, "channel", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(got, [frame, "channel", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mean_psnr(a: DataFrame, b: DataFrame, value: str, frame: str = "frame_no") -> DataFrame:
    """(frame, mse, psnr) of two pixel tables; psnr is infinite for equal frames. Raises when executed if a frame is
    missing on one side."""
    joined = a.select(frame, "x", "y", F.col(value).alias("_a")).join(b.select(frame, "x", "y", F.col(value).alias("_b")), [frame, "x", "y"], "full_outer")
    broken = F.col("_a").isNull() | F.col("_b").isNull()
    d = F.when(broken, F.raise_error(F.lit("frame counts differ")).cast("double")).otherwise(F.col("_a") - F.col("_b"))
    out = joined.groupBy(frame).agg(F.avg(d * d).alias("mse"))
    return out.withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(255.0 * 255.0 / F.col("mse"))).otherwise(F.lit(float("inf"))))


def ssim(a: DataFrame, b: DataFrame, value: str, frame: str = "frame_no") -> DataFrame:
    """(frame, ssim) over the whole picture as one window."""
    joined = a.select(frame, "x", "y", F.col(value).alias("u")).join(b.select(frame, "x", "y", F.col(value).alias("v")), [frame, "x", "y"])
    m = joined.groupBy(frame).agg(F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.var_pop("u").alias("vu"), F.var_pop("v").alias("vv"), F.covar_pop("u", "v").alias("c"))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    top = (2 * F.col("mu") * F.col("mv") + c1) * (2 * F.col("c") + c2)
    return m.select(frame, (top / ((F.col("mu") ** 2 + F.col("mv") ** 2 + c1) * (F.col("vu") + F.col("vv") + c2))).alias("ssim"))


def laplacian(pixels: DataFrame, value: str, frame: str = "frame_no") -> DataFrame:
    """(frame, luma, sharpness): mean, and population variance of the four-neighbour Laplacian of inner pixels."""
    row, column = Window.partitionBy(frame, "y").orderBy("x"), Window.partitionBy(frame, "x").orderBy("y")
    around = F.lag(value).over(row) + F.lead(value).over(row) + F.lag(value).over(column) + F.lead(value).over(column)
    return pixels.withColumn("_l", around - 4 * F.col(value)).groupBy(frame).agg(F.avg(value).alias("luma"), F.var_pop("_l").alias("sharpness"))


def choose_thumbnail(candidates: DataFrame, by: list[str], frame: str = "frame_no", luma=(10.0, 245.0), sharp: float = 100.0) -> DataFrame:
    """The first candidate that is bright and sharp enough, else the sharpest of the bright ones (the first of equals);
    groups without a bright candidate are left out."""
    bright = candidates.filter(F.col("luma").between(*luma))
    first = F.min(F.when(F.col("sharpness") >= sharp, F.col(frame)))
    best = F.max_by(frame, F.struct("sharpness", -F.col(frame)))
    return bright.groupBy(*by).agg(F.coalesce(first, best).alias(frame))


def _scored(mean: Column) -> Column:
    return F.coalesce(mean, F.raise_error(F.lit("no frames were compared")).cast("double"))


def mean_psnr_of(scores: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, mean) of the signal-to-noise of all frames; one that is infinite makes it infinite. Raises when executed if no
    frame has a value."""
    return scores.groupBy(*by).agg(_scored(F.avg(F.when(F.col(value) > float("-inf"), F.col(value)))).alias("mean"))


def mean_ssim_of(scores: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """(by, mean) of the similarity of frames that have a positive one. Raises when executed if none has."""
    return scores.groupBy(*by).agg(_scored(F.avg(F.when(F.col(value) > 0, F.col(value)))).alias("mean"))
