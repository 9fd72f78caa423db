"""Recursive filters in blocks against the plain loops, loudness range and true peak."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.operators import audio, pixels, scan

RATE = 48_000


def stream(spark, x, of=1):
    return spark.createDataFrame(pd.DataFrame({"s": of, "n": np.arange(len(x)), "value": x}))


def values(df, of=1):
    got = df.filter(F.col("s") == of).orderBy("n").toPandas()
    return got["n"].tolist(), got["value"].to_numpy()


def loop(x, bands):
    for k, f, q, g in bands:
        b, a = audio.biquad(k, f, q, g, RATE)
        y, z1, z2 = [], 0.0, 0.0
        for v in x:
            out = b[0] * v + z1
            z1, z2 = b[1] * v - a[1] * out + z2, b[2] * v - a[2] * out
            y.append(out)
        x = y
    return np.array(x)


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(5)
    return rng.normal(0, 0.3, 3000) * (1 + np.sin(np.arange(3000) / 200))


BANDS = [("low_shelf", 200.0, 0.7, 3.0), ("peak", 1000.0, 1.0, -4.0), ("high_pass", 30.0, 0.7, 0.0)]


@pytest.mark.parametrize("size,fan", [(64, 4), (7, 3), (1 << 17, 1024)])
def test_equaliser_in_blocks(spark, noise, size, fan):
    short = noise[:5]
    both = stream(spark, noise).unionByName(stream(spark, short, 2)).repartition(3)
    got = audio.equalise(both, ["s"], BANDS, RATE, size=size, fan=fan)
    for of, x in ((1, noise), (2, short)):
        n, y = values(got, of)
        assert n == list(range(len(x))) and np.abs(y - loop(x, BANDS)).max() < 1e-9


def test_no_task_holds_a_stream(spark, noise):
    plan = audio.equalise(stream(spark, noise), ["s"], BANDS, RATE, size=64, fan=4)._jdf.queryExecution().toString()
    assert "hashpartitioning(s" in plan and "_block" in plan


@pytest.mark.parametrize("attack,release", [(0.5, 2.0), (2.0, 0.5), (0.0, 1.0)])
def test_followers_in_blocks(spark, noise, attack, release):
    level = scan.envelope(noise, attack, release, RATE)
    over = np.maximum(20 * np.log10(np.maximum(level, 1e-12)) + 18, 0)
    want = noise * 10 ** ((3.0 - over * 0.75) / 20)
    df = stream(spark, noise).repartition(3)
    memory = int(np.ceil(37 * max(attack, release) * 48)) + 1
    for size in (memory + 10, 1 << 17):
        n, got = values(audio.compress(df, ["s"], -18.0, 4.0, attack, release, RATE, 3.0, size=size))
        assert n == list(range(len(noise))) and np.abs(got - want).max() < 1e-12
    got = values(audio.gate(df, ["s"], -12.0, attack, release, RATE, size=1))[1]
    assert np.array_equal(got, noise * (level >= 10 ** (-12 / 20)))


def test_duck_follows_the_side_chain(spark, noise):
    side = np.zeros(3000)
    side[1000:1500] = 0.8
    got = values(audio.duck(stream(spark, noise), stream(spark, side).filter("n < 2000"), ["s"], 0.25, 4.0, attack=0.2, release=1.0, rate=RATE, size=1))[1]
    level = scan.envelope(side, 0.2, 1.0, RATE)
    gain = np.where(level > 0.25, (np.maximum(level, 1e-9) / 0.25) ** (1 / 4 - 1), 1.0)
    assert np.abs(got - noise * gain).max() < 1e-12
    assert (gain[1500:1520] < 1).all() and gain[999] == 1  # it lets go slowly


@pytest.mark.parametrize("size,fan", [(2, 2), (3, 5), (256, 64)])
def test_trail_in_blocks(spark, size, fan):
    rng = np.random.default_rng(size)
    planes = [rng.random(4 if i % 11 < 8 else 6).tolist() for i in range(40)]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(planes)] + [(2, 0, [1.0])], "stream_id long, frame_no long, plane array<double>")
    got = [r.plane for r in scan.trail(df, 0.4, size=size, fan=fan).filter("stream_id = 1").orderBy("frame_no").collect()]
    last = None
    for x, y in zip(planes, got):
        x = np.array(x)
        last = x if last is None or len(last) != len(x) else x + (last - x) * 0.4
        assert np.allclose(last, y, atol=1e-12)
    assert pixels.motion_trail(df, 0.4).count() == 41


@pytest.mark.parametrize("factor", [0.5, 0.83, 1.0, 1.25, 3.0])
def test_stretch_in_blocks(spark, factor):
    x = np.sin(np.arange(9000) / 17.0)
    df = stream(spark, x).repartition(3)
    n, got = values(audio.time_stretch(df, ["s"], factor, size=1500))
    want = audio.stretch(x, factor)
    assert n == list(range(len(want))) and np.abs(got - want).max() < 1e-12
    semitones = 12 * math.log2(factor)
    n, got = values(audio.pitch_shift(df, ["s"], semitones, size=1500))
    rate = 2 ** (max(-24.0, min(24.0, semitones)) / 12)
    long = audio.stretch(x, 1 / rate)
    assert n == list(range(len(x))) and np.abs(got - np.interp(np.arange(len(x)) * rate, np.arange(len(long)), long)).max() < 1e-12


def test_true_peak_lies_between_samples(spark):
    x = np.sin(2 * np.pi * (np.arange(4000) / 4 + 1 / 8))  # sampled at 0.707 only
    df = stream(spark, x).repartition(2)
    assert np.abs(x).max() < 0.71
    whole = audio.true_peak(df, ["s"]).first().peak
    assert whole == pytest.approx(1.0, abs=0.02)
    assert audio.true_peak(df, ["s"], block=100).first().peak == pytest.approx(whole, abs=1e-12)


def test_r128_and_normalising(spark):
    n = np.arange(RATE * 20)
    loud = np.where(n < RATE * 10, 0.5, 0.05) * np.sin(2 * np.pi * 997 / RATE * n)  # 20 dB apart
    df = stream(spark, loud)
    r = audio.r128(df, ["s"], RATE).first()
    assert r.true_peak_db == pytest.approx(-6.02, abs=0.1)
    assert r.lra == pytest.approx(20, abs=0.5)
    assert r.lufs == pytest.approx(-9.03, abs=0.3)
    quiet = stream(spark, np.zeros(RATE), 2)
    assert tuple(audio.r128(quiet, ["s"], RATE).first())[1:] == (None, None, float("-inf"))
    out = audio.normalise_loudness(df.unionByName(quiet), ["s"], RATE, -23.0, -1.0, 7.0)
    assert {r.lra_outcome for r in out.select("s", "lra_outcome").distinct().collect()} == {"exceeds", "not measured"}
    assert audio.r128(out.filter("s = 1").drop("lra_outcome"), ["s"], RATE).first().lufs == pytest.approx(-23.0, abs=0.01)
    held = audio.normalise_loudness(df, ["s"], RATE, -1.0, -3.0).drop("lra_outcome")
    assert audio.r128(held, ["s"], RATE).first().true_peak_db == pytest.approx(-3.0, abs=1e-6)
    for bad in ((0.0, -1.0, 7.0), (-23.0, 0.5, 7.0), (-23.0, -1.0, 0.5)):
        with pytest.raises(ValueError):
            audio.normalise_loudness(df, ["s"], RATE, *bad)
