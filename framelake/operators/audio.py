"""Operators on sample tables: (stream_id, n, ch, value) unless named otherwise."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.audio import from_db, pan_gains, to_db
from . import grouped, scan
from .scan import envelope  # noqa: F401


def mix(tracks: list[DataFrame], value: str = "value", keys: tuple = ("stream_id", "n", "ch")) -> DataFrame:
    """Sum of all tracks; a missing sample is 0; clamped to [-1, 1] after the sum."""
    together = tracks[0]
    for t in tracks[1:]:
        together = together.unionByName(t)
    return together.groupBy(*keys).agg(F.sum(value).alias("_s")).select(*keys, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_s"))).alias(value))


def pan_stereo(mono: DataFrame, pan: str, value: str = "value") -> DataFrame:
    left, right = pan_gains(F.col(pan))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("ch"), (F.col(value) * left).alias(value)), F.struct(F.lit(1).alias("ch"), (F.col(value) * right).alias(value)))).alias("s")
    return mono.drop("ch").select(*(c for c in mono.columns if c not in ("ch", value)), sides).select("*", "s.*").drop("s")


def to_mono(samples: DataFrame, value: str = "value") -> DataFrame:
    return samples.groupBy("stream_id", "n").agg(F.avg(value).alias(value))


def map_channels(samples: DataFrame, order: list[int]) -> DataFrame:
    """Output channel i takes input channel order[i]; a channel may serve several or none."""
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("ch"), F.lit(c).alias("_from")) for i, c in enumerate(order)))).alias("m")
    return samples.withColumnRenamed("ch", "_ch").select("*", rows).filter("_ch = m._from").select(*(c for c in samples.columns if c != "ch"), "m.ch")


def delay(samples: DataFrame, ms: float, rate: int) -> DataFrame:
    """Later by ms; a negative delay trims."""
    return samples.withColumn("n", F.col("n") + F.round(F.lit(ms / 1000 * rate)).cast("long")).filter("n >= 0")


def normalise(samples: DataFrame, by: list[str], target_db: float, *, ceiling_db: float | None = None, measure: str = "peak", value: str = "value") -> DataFrame:
    """Two passes: measure each group (peak, or root mean square), then one gain. With a ceiling the gain is held so
    that the peak stays under it. Silent groups are left as they are."""
    level = F.max(F.abs(value)) if measure == "peak" else F.sqrt(F.avg(F.col(value) * F.col(value)))
    measured = samples.groupBy(*by).agg(level.alias("_level"), F.max(F.abs(value)).alias("_peak"))
    gain = target_db - 20 * F.log10("_level")
    if ceiling_db is not None:
        gain = F.least(gain, ceiling_db - 20 * F.log10("_peak"))
    gains = measured.select(*by, F.when(F.col("_level") > 0, from_db(gain)).otherwise(1.0).alias("_gain"))
    return samples.join(gains, by).withColumn(value, F.col(value) * F.col("_gain")).drop("_gain")


def echo(samples: DataFrame, by: list[str], delays: list[int], decays: list[float], in_gain: float = 1.0, out_gain: float = 1.0, value: str = "value") -> DataFrame:
    """Delayed copies (in samples) added to the input."""
    w = Window.partitionBy(*by).orderBy("n")
    taps = sum((F.coalesce(F.lag(value, d).over(w), F.lit(0.0)) * k for d, k in zip(delays, decays)), F.lit(0.0))
    return samples.withColumn(value, (F.col(value) * in_gain + taps) * out_gain)


def convolve(samples: DataFrame, response: list[float], by: list[str], wet: float, dry: float, pre_delay: int = 0, value: str = "value") -> DataFrame:
    """Reverb by an impulse response (a bounded list of taps): each sample is dealt to the places it sounds at."""
    taps = F.explode(F.array(*(F.struct(F.lit(i + pre_delay).cast("long").alias("k"), F.lit(float(v)).alias("v")) for i, v in enumerate(response)))).alias("tap")
    heard = samples.select(*by, "n", value, taps).select(*by, (F.col("n") + F.col("tap.k")).alias("n"), (F.col(value) * F.col("tap.v") * wet).alias(value))
    return heard.unionByName(samples.select(*by, "n", (F.col(value) * dry).alias(value))).groupBy(*by, "n").agg(F.sum(value).alias(value))


def resample(samples: DataFrame, by: list[str], factor: float, value: str = "value") -> DataFrame:
    """Output n at input position n * factor, linear between neighbours; the last sample holds."""
    w = Window.partitionBy(*by).orderBy("n")
    seg = samples.select(*by, "n", F.col(value).alias("a"), F.lead(value).over(w).alias("b"), F.lead("n").over(w).alias("n1"))
    first = F.ceil(F.col("n") / factor).cast("long")
    last = F.ceil(F.coalesce(F.col("n1"), F.col("n") + 1) / factor).cast("long") - 1
    out = seg.withColumn("m", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    u = (F.col("m") * factor - F.col("n")) / F.coalesce(F.col("n1") - F.col("n"), F.lit(1))
    return out.select(*by, F.col("m").alias("n"), (F.col("a") + (F.coalesce("b", "a") - F.col("a")) * u).alias(value))


def biquad(kind: str, frequency: float, q: float, gain_db: float, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a second-order section: peak, low_shelf or high_shelf, low_pass or high_pass."""
    a = 10 ** (gain_db / 40)
    w = 2 * np.pi * frequency / rate
    c, alpha = np.cos(w), np.sin(w) / (2 * q)
    r = 2 * np.sqrt(a) * alpha
    if kind == "peak":
        b, d = [1 + alpha * a, -2 * c, 1 - alpha * a], [1 + alpha / a, -2 * c, 1 - alpha / a]
    elif kind == "low_pass":
        b, d = [(1 - c) / 2, 1 - c, (1 - c) / 2], [1 + alpha, -2 * c, 1 - alpha]
    elif kind == "high_pass":
        b, d = [(1 + c) / 2, -1 - c, (1 + c) / 2], [1 + alpha, -2 * c, 1 - alpha]
    elif kind in ("low_shelf", "high_shelf"):
        s = 1 if kind == "low_shelf" else -1
        b = [a * (a + 1 - s * (a - 1) * c + r), s * 2 * a * (a - 1 - s * (a + 1) * c), a * (a + 1 - s * (a - 1) * c - r)]
        d = [a + 1 + s * (a - 1) * c + r, -s * 2 * (a - 1 + s * (a + 1) * c), a + 1 + s * (a - 1) * c - r]
    else:
        raise ValueError(f"unknown band kind {kind!r}")
    return np.array(b) / d[0], np.array(d) / d[0]


def equalise(samples: DataFrame, by: list[str], bands: list[tuple[str, float, float, float]], rate: int, value: str = "value", **blocks) -> DataFrame:
    """A chain of second-order sections (kind, frequency, q, gain in dB), exact over streams of any length; ``blocks``: size
    and fan of the scan."""
    return scan.sections(samples, by, [biquad(k, f, q, g, rate) for k, f, q, g in bands], value=value, **blocks)


def _gain_above(level: np.ndarray, threshold_db: float, ratio: float, makeup_db: float = 0.0) -> np.ndarray:
    over = np.maximum(20 * np.log10(np.maximum(level, 1e-12)) - threshold_db, 0)
    return 10 ** ((makeup_db - over * (1 - 1 / ratio)) / 20)


def compress(samples: DataFrame, by: list[str], threshold_db: float, ratio: float, attack: float, release: float, rate: int, makeup_db: float = 0.0, value: str = "value", **blocks) -> DataFrame:
    """Turned down by the level followed with attack and release in ms; samples are numbered without gaps."""
    return scan.followed(samples, by, attack, release, rate, lambda level: _gain_above(level, threshold_db, ratio, makeup_db), value=value, **blocks)


def gate(samples: DataFrame, by: list[str], threshold_db: float, attack: float, release: float, rate: int, value: str = "value", **blocks) -> DataFrame:
    """Silent where the level followed is under the threshold; samples are numbered without gaps."""
    return scan.followed(samples, by, attack, release, rate, lambda level: (level >= 10 ** (threshold_db / 20)).astype(float), value=value, **blocks)


def stretch(x: np.ndarray, factor: float, grain: int = 1024, hop: int = 512) -> np.ndarray:
    """Overlap-add with raised-cosine grains: length divided by factor, pitch kept."""
    return stretch_part(x, 0, len(x), factor, 0, int(np.ceil(len(x) / factor)), grain, hop)


def stretch_part(x: np.ndarray, begin: int, length: int, factor: float, lo: int, hi: int, grain: int = 1024, hop: int = 512) -> np.ndarray:
    """Outputs [lo, hi) of a stream of ``length`` samples, of which ``x`` has those from ``begin`` on that they need."""
    first = max(0, (lo - grain) // hop + 1) * hop
    out, weight = np.zeros(max(0, hi - first) + grain), np.zeros(max(0, hi - first) + grain)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(grain) + 0.5) / grain)
    for at in range(first, hi, hop):
        source = int(at * factor)
        piece = x[max(0, source - begin) : max(0, min(length, source + grain) - begin)]
        out[at - first : at - first + len(piece)] += piece * window[: len(piece)]
        weight[at - first : at - first + len(piece)] += window[: len(piece)]
    return (out / np.maximum(weight, 1e-9))[lo - first : hi - first]


def _by_output(samples: DataFrame, by: list[str], factor: float, lengths: Column, kernel: Callable, reach: float, value: str, size: int) -> DataFrame:
    """(by, n, value): outputs block by block, ``kernel(x, begin, length, lo, hi)``, each from the samples about ``factor``
    times its places and ``reach`` more on both sides. Samples are numbered from 0 without gaps."""
    slim = samples.select(*by, F.col("n").cast("long").alias("n"), F.col(value).cast("double").alias(value))
    ends = slim.groupBy(*by).agg((F.max("n") + 1).alias("_len")).withColumn("_out", lengths)
    block = lambda at: F.greatest(F.lit(0), F.least(F.floor(at / size), F.floor((F.col("_out") - 1) / size))).cast("long")
    dealt = slim.join(ends, by).filter("_out > 0")
    dealt = dealt.withColumn("_block", F.explode(F.sequence(block((F.col("n") - reach) / factor), block((F.col("n") + reach) / factor))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        length, total, lo = (int(pdf[c].iloc[0]) for c in ("_len", "_out", "_block"))
        lo *= size
        hi = min(total, lo + size)
        y = kernel(pdf[value].to_numpy(float), int(pdf["n"].iloc[0]), length, lo, hi)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * (hi - lo) for c in by}, "n": np.arange(lo, hi), value: y})

    return dealt.groupBy(*by, "_block").applyInPandas(run, slim.schema)


def time_stretch(samples: DataFrame, by: list[str], factor: float, value: str = "value", size: int = 1 << 16) -> DataFrame:
    """Length divided by factor, pitch kept, in blocks of ``size`` outputs."""
    kernel = lambda x, begin, length, lo, hi: stretch_part(x, begin, length, factor, lo, hi)
    return _by_output(samples, by, factor, F.ceil(F.col("_len") / factor), kernel, 1024 * (1 + factor) + 2, value, size)


def pitch_shift(samples: DataFrame, by: list[str], semitones: float, value: str = "value", size: int = 1 << 16) -> DataFrame:
    """Pitch moved, length kept: stretched by the inverse rate, then resampled. At most 24 semitones either way."""
    rate = 2 ** (max(-24.0, min(24.0, semitones)) / 12)

    def kernel(x: np.ndarray, begin: int, length: int, lo: int, hi: int) -> np.ndarray:
        total = int(np.ceil(length * rate))
        first, last = min(total - 1, int(lo * rate)), min(total, int((hi - 1) * rate) + 2)
        return np.interp(np.arange(lo, hi) * rate, np.arange(first, last), stretch_part(x, begin, length, 1 / rate, first, last))

    return _by_output(samples, by, 1.0, F.col("_len"), kernel, 1024 * (1 + 1 / rate) + 2 * (1 + 1 / rate) + 2, value, size)


#: Sizes of frames up to which a bin is a plain sum over the samples in order: values of few digits give levels that are equal
#: but for rounding, and which of them are at the noise level then depends on the order of the sum.
PLAIN = 64


def denoise(samples: DataFrame, by: list[str], reduction_db: float, profile: int | None = None, size: int = 256, value: str = "value", frames: int = 256) -> DataFrame:
    """Spectral gating by frames of ``size`` samples (numbered from 0 without gaps): bins at or under the noise level (the
    mean of the first ``profile`` samples' frames, else the median of all) are turned down. Levels are measured and gates
    applied by blocks of ``frames``; a stream meets as one row of noise levels."""
    blocks = samples.withColumn("_block", F.floor(F.col("n") / (size * frames)).cast("long"))
    keyed = blocks.groupBy(*by, "_block")
    keys, schema, names = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in by), samples.schema, samples.columns
    heads = max(1, profile // size) if profile else None

    def spectrum(pdf: pd.DataFrame) -> np.ndarray:
        x = pdf[value].to_numpy(float)
        x = np.pad(x, (0, -len(x) % size)).reshape(-1, size)
        if size > PLAIN:
            return np.fft.rfft(x, axis=1)
        out = np.zeros((len(x), size // 2 + 1), complex)
        for i in range(size):
            turns = [2 * math.pi * k * i / size for k in range(size // 2 + 1)]
            out.real += x[:, i : i + 1] * [math.cos(a) for a in turns]
            out.imag -= x[:, i : i + 1] * [math.sin(a) for a in turns]
        return out

    def level(bins: np.ndarray) -> np.ndarray:
        return np.sqrt(bins.real * bins.real + bins.imag * bins.imag)

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        found = level(spectrum(pdf.sort_values("n")))
        first = int(pdf["_block"].iloc[0]) * frames
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] * len(found) for c in by}, "_frame": np.arange(first, first + len(found)), "_level": list(found)})

    def gated(pdf: pd.DataFrame, noise: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        bins = spectrum(pdf)
        bins[level(bins) <= np.asarray(noise["_noise"].iloc[0])] *= 10 ** (-reduction_db / 20)
        return pdf.assign(**{value: np.fft.irfft(bins, size, axis=1).ravel()[: len(pdf)]})[names]

    each = keyed.applyInPandas(levels, f"{keys}, _frame long, _level array<double>")
    each = (each.filter(F.col("_frame") < heads) if heads else each).select(*by, F.posexplode("_level").alias("_bin", "_l"))
    noise = each.groupBy(*by, "_bin").agg((F.avg("_l") if heads else F.median("_l")).alias("_l"))
    noise = noise.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_bin", "_l"))), lambda x: x["_l"]).alias("_noise"))
    ends = blocks.select(*by, "_block").distinct().join(noise, by)
    ends = ends.select(*(F.col(c).alias(c) for c in ends.columns))  # columns of its own
    return keyed.cogroup(ends.groupBy(*by, "_block")).applyInPandas(gated, schema)


def duck(
    main: DataFrame, side: DataFrame, by: list[str], threshold: float, ratio: float, value: str = "value", attack: float | None = None, release: float | None = None, rate: int = 48_000, **blocks
) -> DataFrame:
    """Main is turned down where the side chain is above the (linear) threshold, joined by sample. With attack and release
    (ms) the side chain's level is followed, silence where it has no sample; without, each sample counts by itself."""
    both = main.join(side.select(*by, "n", F.abs(value).alias("_level")), [*by, "n"], "left").withColumn("_level", F.coalesce("_level", F.lit(0.0)))
    if attack is not None or release is not None:
        follow = lambda level: _gain_above(level, 20 * float(np.log10(threshold)), ratio)
        return scan.followed(both, by, attack or 0.0, release or 0.0, rate, follow, value=value, of="_level", **blocks).drop("_level")
    gain = F.when(F.col("_level") > threshold, F.pow(F.col("_level") / threshold, F.lit(1 / ratio - 1))).otherwise(1.0)
    return both.withColumn(value, F.col(value) * gain).drop("_level")


#: Poles and gains of the loudness weighting (ITU-R BS.1770): fixed values.
SHELF, HIGH_PASS = (1681.974450955533, 3.999843853973347, 0.7071752369554196), (38.13547087602444, 0.5003270373238773)


def weighting(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two second-order sections of the loudness weighting at a sample rate."""
    f, gain, q = SHELF
    k, top = np.tan(np.pi * f / rate), 10 ** (gain / 20)
    mid = top**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = np.array([top + mid * k / q + k * k, 2 * (k * k - top), top - mid * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    f, q = HIGH_PASS
    k = np.tan(np.pi * f / rate)
    a0 = 1 + k / q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]))]


def response(sections: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The first n values of the sections' impulse response."""
    x = np.zeros(n)
    x[0] = 1.0
    for b, a in sections:
        y = np.zeros(n)
        for i in range(n):
            past = sum(b[j] * x[i - j] for j in range(3) if i >= j) - sum(a[j] * y[i - j] for j in (1, 2) if i >= j)
            y[i] = past
        x = y
    return x


def k_weighted(samples: DataFrame, by: list[str], rate: int, *, n: str = "n", value: str = "value", block: int = 1 << 17) -> DataFrame:
    """Samples (numbered without gaps) as the ear weighs them. Streams are cut into blocks that each begin with the last
    part of the block before, until the filter has forgotten what was earlier (its response falls below 1e-16 in rate / 6
    samples), so no stream gathers in a task; a block is one convolution."""
    memory = max(64, rate // 6)
    taps = response(weighting(rate), memory)
    own = F.floor(F.col(n) / block)
    late = F.col(n) % block >= block - memory
    dealt = samples.withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].to_numpy(float)
        part = taps[: len(x)]  # later ones reach no sample
        size = 1 << int(len(x) + len(part)).bit_length()
        y = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(part, size), size)[: len(x)]
        pdf = pdf.assign(**{value: y})
        return pdf[pdf[n] // block == pdf["_block"]].drop(columns="_block")

    return grouped.apply(dealt, [*by, "_block"], [n], run, samples.schema)


def loudness(weighted: DataFrame, by: list[str], t: str, hop: int, value: str = "value") -> DataFrame:
    """(by, lufs) integrated loudness: blocks of four hops, each a hop after the last; those at -70 or below don't count,
    then those more than 10 under the mean of the others. Channels add up. Null for silence. Only hops, not samples, are
    windowed."""
    hops = weighted.groupBy(*by, F.floor(F.col(t) / hop).alias("_hop")).agg(F.sum(F.col(value) * F.col(value)).alias("_e"), F.countDistinct(t).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_hop").rangeBetween(0, 3)
    blocks = hops.withColumns({"_e": F.sum("_e").over(w), "_n": F.sum("_n").over(w), "_last": F.max("_hop").over(Window.partitionBy(*by))}).filter("_hop + 3 <= _last")
    blocks = blocks.withColumn("_p", F.col("_e") / F.col("_n")).filter(F.col("_p") > 10 ** ((-70 + 0.691) / 10))
    gates = blocks.groupBy(*by).agg((F.avg("_p") / 10).alias("_gate"))
    loud = blocks.join(gates, by).filter("_p > _gate").groupBy(*by).agg((-0.691 + 10 * F.log10(F.avg("_p"))).alias("lufs"))
    return weighted.select(*by).distinct().join(loud, by, "left")


def loudness_range(weighted: DataFrame, by: list[str], t: str, hop: int, value: str = "value", span: int = 30, grain: float = 0.01) -> DataFrame:
    """(by, lra): how far the 95th percentile of short-term loudness (``span`` hops, each a hop after the last) is above the
    10th, of what is over -70 and not more than 20 under the mean of that. Percentiles are read from a histogram in steps of
    ``grain``, which merges over tasks; ranks are nearest. Null without such a part."""
    hops = weighted.groupBy(*by, F.floor(F.col(t) / hop).alias("_hop")).agg(F.sum(F.col(value) * F.col(value)).alias("_e"), F.countDistinct(t).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_hop").rangeBetween(0, span - 1)
    parts = hops.withColumns({"_e": F.sum("_e").over(w), "_n": F.sum("_n").over(w), "_last": F.max("_hop").over(Window.partitionBy(*by))}).filter(F.col("_hop") + span - 1 <= F.col("_last"))
    parts = parts.withColumn("_p", F.col("_e") / F.col("_n")).filter(F.col("_p") > 10 ** ((-70 + 0.691) / 10))
    gates = parts.groupBy(*by).agg((F.avg("_p") / 100).alias("_gate"))
    bins = parts.join(gates, by).filter("_p >= _gate").groupBy(*by, F.floor((-0.691 + 10 * F.log10("_p")) / grain).alias("_bin")).agg(F.count("*").alias("_c"))
    # At most 20 / grain bins a stream from here on.
    run = Window.partitionBy(*by).orderBy("_bin")
    ranked = bins.withColumns({"_below": F.sum("_c").over(run), "_all": F.sum("_c").over(Window.partitionBy(*by))})
    at = lambda q: F.min(F.when(F.col("_below") * 100 >= F.col("_all") * q, F.col("_bin")))
    found = ranked.groupBy(*by).agg(((at(95) - at(10)) * grain).alias("lra"))
    return weighted.select(*by).distinct().join(found, by, "left")


#: Phases, and taps of each, by which peaks between samples are found.
PHASES, TAPS = 4, 12


def between(phases: int = PHASES, taps: int = TAPS) -> np.ndarray:
    """(phases, taps): a windowed sinc that gives the signal at each phase between samples n - taps / 2 and one later."""
    k = np.arange(taps)[None, :] - (taps / 2 - 1) - np.arange(phases)[:, None] / phases
    return np.sinc(k) * (0.5 + 0.5 * np.cos(np.pi * k / (taps / 2)))


def true_peak(samples: DataFrame, by: list[str], n: str = "n", value: str = "value", block: int = 1 << 17) -> DataFrame:
    """(by, peak): the largest absolute value of the signal at PHASES times its rate. Blocks begin with the last samples of
    the block before, so no stream gathers in a task; samples are numbered without gaps."""
    filters = between()
    own, late = F.floor(F.col(n) / block), F.col(n) % block >= block - TAPS
    dealt = samples.withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    keys = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, start = pdf[n].to_numpy(), int(pdf["_block"].iloc[0]) * block
        # Only where the stream itself begins or ends may taps find nothing.
        x = np.pad(pdf[value].to_numpy(float), ((TAPS - 1) * int(at[0] > start - TAPS), (TAPS - 1) * int(at[-1] < start + block - 1)))
        peak = max((np.abs(np.convolve(x, f[::-1], "valid")).max() for f in filters if len(x) >= TAPS), default=0.0)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "peak": [peak]})

    inner = grouped.apply(dealt, [*by, "_block"], [n], run, f"{keys}, peak double")
    return inner.groupBy(*by).agg(F.max("peak").alias("peak"))


def r128(samples: DataFrame, by: list[str], rate: int, n: str = "n", value: str = "value", hop: int | None = None) -> DataFrame:
    """(by, lufs, lra, true_peak_db) of each stream: integrated loudness, loudness range and true peak; null, null and
    minus infinity for silence. ``hop``: samples of a tenth of a second, or as given."""
    hop = hop or max(1, rate // 10)
    weighted = k_weighted(samples.select(*by, n, value), by, rate, n=n, value=value)
    peaks = true_peak(samples.select(*by, n, value), by, n, value).select(*by, to_db(F.col("peak")).alias("true_peak_db"))
    return loudness(weighted, by, n, hop, value).join(loudness_range(weighted, by, n, hop, value), by).join(peaks, by)


def normalise_loudness(samples: DataFrame, by: list[str], rate: int, target_lufs: float, ceiling_db: float, lra: float = 7.0, n: str = "n", value: str = "value", hop: int | None = None) -> DataFrame:
    """Each stream by one gain to ``target_lufs``, less if its true peak would pass ``ceiling_db``; silence stays. The range
    ``lra`` is looked at, not made: lra_outcome is within, exceeds, or not measured."""
    if target_lufs >= 0 or ceiling_db > 0 or not 1 <= lra <= 50:
        raise ValueError("the target is under 0 LUFS, the ceiling at most 0 dB, the range within 1 and 50")
    wanted = F.lit(float(target_lufs)) - F.col("lufs")
    gain = F.when(F.col("true_peak_db") > float("-inf"), F.least(wanted, ceiling_db - F.col("true_peak_db"))).otherwise(wanted)
    outcome = F.when(F.col("lra").isNull(), "not measured").when(F.col("lra") <= lra, "within").otherwise("exceeds")
    gains = r128(samples, by, rate, n, value, hop).select(*by, F.coalesce(from_db(gain), F.lit(1.0)).alias("_gain"), outcome.alias("lra_outcome"))
    return samples.join(gains, by).withColumn(value, F.col(value) * F.col("_gain")).drop("_gain")


def cycled(samples: DataFrame, lengths: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Samples (by, n from 0 without gaps) repeated, or cut off, to fill each group's ``length`` (by, length)."""
    own = samples.groupBy(*by).agg((F.max("n") + 1).alias("_own"))
    rounds = own.join(lengths, by).select(*by, "_own", "length", F.ceil(F.col("length") / F.col("_own")).alias("_rounds")).filter("_rounds > 0")
    each = samples.join(rounds, by).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_rounds") - 1)))
    return each.withColumn("n", F.col("n") + F.col("_k") * F.col("_own")).filter("n < length").select(*by, "n", value)
