"""Sample arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import audio as fa
from ..operators import audio, scan
from . import media
from .media import NUMBERED
from .register import Plans

plans = Plans()
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE
OUT = "SELECT stream_id, n, round(value, 6) AS value"


def _out(df, *more):
    return df.select("stream_id", "n", *more, F.round("value", 6).alias("value"))


@plans.query("volume_db", f"WITH {NUMBERED} SELECT stream_id, n, round(value * pow(10.0, -6.0 / 20), 6) AS value FROM numbered")
def volume_db(spark, d):
    return _out(media.numbered(spark, d).withColumn("value", F.col("value") * fa.from_db(-6.0)))


@plans.query(
    "audio_fades",
    f"WITH {NUMBERED} SELECT stream_id, n, round(value * least(1.0, greatest(0.0, (n - 5) / 20.0)) * least(1.0, greatest(0.0, 1 - (n - 40) / 15.0)), 6) AS value FROM numbered",
)
def audio_fades(spark, d):
    t = F.col("n").cast("double")
    return _out(media.numbered(spark, d).withColumn("value", F.col("value") * fa.ramp_in(t, 5.0, 20.0) * fa.ramp_out(t, 40.0, 15.0)))


@plans.query(
    "constant_power_pan",
    f"""WITH {NUMBERED}, p AS (SELECT *, (stream_id % 21 - 10) / 10.0 AS pan FROM numbered)
SELECT stream_id, n, 0 AS ch, round(value * cos((pan + 1) * {math.pi / 4!r}), 6) AS value FROM p UNION ALL SELECT stream_id, n, 1, round(value * sin((pan + 1) * {math.pi / 4!r}), 6) FROM p""",
)
def constant_power_pan(spark, d):
    mono = media.numbered(spark, d).withColumn("pan", (F.col("stream_id") % 21 - 10) / 10)
    return _out(audio.pan_stereo(mono, "pan"), "ch")


@plans.query("mix_clamped", f"WITH {NUMBERED} SELECT CAST(stream_id % 10 AS BIGINT) AS stream_id, n, ch, round(greatest(-1.0, least(1.0, sum(value))), 6) AS value FROM numbered GROUP BY stream_id % 10, n, ch")
def mix_clamped(spark, d):
    s = media.numbered(spark, d).withColumn("bus", F.col("stream_id") % 10)
    buses = [s.filter(F.col("stream_id") % 2 == i).select(F.col("bus").alias("stream_id"), "n", "ch", "value") for i in (0, 1)]
    return _out(audio.mix(buses), "ch")


@plans.query("stereo_to_mono", f"WITH {NUMBERED} SELECT stream_id, n // 2 AS n, round(avg(value), 6) AS value FROM numbered GROUP BY stream_id, n // 2")
def stereo_to_mono(spark, d):
    return _out(audio.to_mono(media.numbered(spark, d).withColumn("n", F.floor(F.col("n") / 2))))


@plans.query("channel_map", f"WITH {NUMBERED} SELECT stream_id, n, o AS ch, round(value, 6) AS value FROM numbered JOIN (VALUES (0, 1), (1, 0), (2, 1)) AS m(o, i) ON numbered.ch = m.i")
def channel_map(spark, d):
    return _out(audio.map_channels(media.numbered(spark, d), [1, 0, 1]), "ch")


@plans.query("audio_delay", f"WITH {NUMBERED} SELECT stream_id, n - 12 AS n, round(value, 6) AS value FROM numbered WHERE n >= 12")
def audio_delay(spark, d):
    return _out(audio.delay(media.numbered(spark, d), -250.0, 48))


@plans.query(
    "normalise_peak",
    f"WITH {NUMBERED}, g AS (SELECT stream_id, max(abs(value)) AS p FROM numbered GROUP BY stream_id) SELECT stream_id, n, round(value * CASE WHEN p > 0 THEN pow(10.0, (-1.0 - 20 * log10(p)) / 20) ELSE 1 END, 6) AS value FROM numbered JOIN g USING (stream_id)",
)
def normalise_peak(spark, d):
    return _out(audio.normalise(media.numbered(spark, d), ["stream_id"], -1.0))


@plans.query(
    "normalise_with_ceiling",
    f"""WITH {NUMBERED}, g AS (SELECT stream_id, max(abs(value)) AS p, sqrt(avg(value * value)) AS r FROM numbered GROUP BY stream_id)
SELECT stream_id, n, round(value * CASE WHEN r > 0 THEN pow(10.0, least(-14.0 - 20 * log10(r), -1.5 - 20 * log10(p)) / 20) ELSE 1 END, 6) AS value FROM numbered JOIN g USING (stream_id)""",
)
def normalise_with_ceiling(spark, d):
    return _out(audio.normalise(media.numbered(spark, d), ["stream_id"], -14.0, ceiling_db=-1.5, measure="rms"))


@plans.query("compressor_static", f"WITH {NUMBERED}, l AS (SELECT *, CASE WHEN value <> 0 THEN 20 * log10(abs(value)) + 18 END AS over FROM numbered) SELECT stream_id, n, round(value * pow(10.0, (CASE WHEN over > 0 THEN -over * (1 - 1 / 4.0) ELSE 0.0 END + 3.0) / 20), 6) AS value FROM l")
def compressor_static(spark, d):
    return _out(media.numbered(spark, d).withColumn("value", fa.compress(F.col("value"), -18.0, 4.0, 3.0)))


@plans.query("noise_gate_static", f"WITH {NUMBERED} SELECT stream_id, n, round(CASE WHEN abs(value) >= pow(10.0, -12.0 / 20) THEN value ELSE 0.0 END, 6) AS value FROM numbered")
def noise_gate_static(spark, d):
    return _out(media.numbered(spark, d).withColumn("value", fa.gate(F.col("value"), -12.0)))


@plans.query(
    "echo_taps",
    f"WITH {NUMBERED} SELECT stream_id, n, round((value * 0.8 + coalesce(lag(value, 3) OVER w, 0) * 0.4 + coalesce(lag(value, 7) OVER w, 0) * 0.2) * 0.9, 6) AS value FROM numbered WINDOW w AS (PARTITION BY stream_id ORDER BY n)",
)
def echo_taps(spark, d):
    return _out(audio.echo(media.numbered(spark, d), ["stream_id"], [3, 7], [0.4, 0.2], 0.8, 0.9))


@plans.query(
    "reverb_convolution",
    f"""WITH {NUMBERED}, heard AS (SELECT stream_id, n + k + 2 AS n, value * v * 0.3 AS value FROM numbered, (VALUES (0, 1.0), (1, 0.5), (2, 0.2)) AS ir(k, v) UNION ALL SELECT stream_id, n, value * 0.7 FROM numbered)
SELECT stream_id, n, round(sum(value), 6) AS value FROM heard GROUP BY stream_id, n""",
)
def reverb_convolution(spark, d):
    return _out(audio.convolve(media.numbered(spark, d), [1.0, 0.5, 0.2], ["stream_id"], 0.3, 0.7, 2))


@plans.query(
    "speed_resample",
    f"""WITH {NUMBERED}, ends AS (SELECT stream_id, max(n) AS hi FROM numbered GROUP BY stream_id),
grid AS (SELECT stream_id, unnest(range(0, CAST(ceil((hi + 1) / 1.5) AS BIGINT))) AS m FROM ends)
SELECT g.stream_id, g.m AS n, round(a.value + (coalesce(b.value, a.value) - a.value) * (g.m * 1.5 - floor(g.m * 1.5)), 6) AS value
FROM grid g JOIN numbered a ON a.stream_id = g.stream_id AND a.n = CAST(floor(g.m * 1.5) AS BIGINT) LEFT JOIN numbered b ON b.stream_id = g.stream_id AND b.n = a.n + 1""",
)
def speed_resample(spark, d):
    return _out(audio.resample(media.numbered(spark, d), ["stream_id"], 1.5))


@plans.query(
    "duck_sidechain",
    f"""WITH {NUMBERED} SELECT m.stream_id, m.n, round(m.value * CASE WHEN abs(s.value) > 0.25 THEN pow(abs(s.value) / 0.25, 1 / 4.0 - 1) ELSE 1.0 END, 6) AS value
FROM numbered m LEFT JOIN (SELECT stream_id - 1 AS stream_id, n, value FROM numbered) s ON s.stream_id = m.stream_id AND s.n = m.n""",
)
def duck_sidechain(spark, d):
    main = media.numbered(spark, d)
    return _out(audio.duck(main, main.withColumn("stream_id", F.col("stream_id") - 1), ["stream_id"], 0.25, 4.0))


BY, RATE = ["stream_id"], 48_000


def _sample_query(name, sql, f):
    plans.query(name, sql)(lambda spark, d: _out(f(media.numbered(spark, d).select("stream_id", "n", "value"))))


def _sections_sql(chain, then: str) -> str:
    """Each sample of ``numbered`` after a chain of second-order sections, by recursion: (stream_id, n, value)."""
    step, last = [], "x.value"
    for i, (b, a) in enumerate(chain):
        b, a = ([f"CAST({v!r} AS DOUBLE)" for v in map(float, c)] for c in (b, a))
        step += [f"{b[0]} * {last} + r.p{i} AS y{i}", f"{b[1]} * {last} - {a[1]} * y{i} + r.q{i}", f"{b[2]} * {last} - {a[2]} * y{i}"]
        last = f"y{i}"
    zeros = ", ".join(f"CAST(0 AS DOUBLE) AS {c}{i}" for i in range(len(chain)) for c in "opq")
    return f"""WITH RECURSIVE {NUMBERED}, x AS MATERIALIZED (SELECT stream_id, n, value FROM numbered),
r AS (SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS n, {zeros} FROM x
  UNION ALL SELECT x.stream_id, x.n, {", ".join(step)} FROM r JOIN x ON x.stream_id = r.stream_id AND x.n = r.n + 1),
filtered AS (SELECT stream_id, n, o{len(chain) - 1} AS value FROM r WHERE n >= 0) {then}"""


def _followed_sql(level: str, attack: float, release: float, gain: str) -> str:
    """Each sample times a gain of the ``level`` followed in (stream_id, n, value, side)."""
    up, down = scan.pole(attack, RATE), scan.pole(release, RATE)
    return f"""WITH RECURSIVE {NUMBERED}, x AS MATERIALIZED ({level}),
r AS (SELECT DISTINCT stream_id, CAST(-1 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS level FROM x
  UNION ALL SELECT x.stream_id, x.n, x.value, CASE WHEN x.side > r.level THEN {up!r} * r.level + (1 - {up!r}) * x.side ELSE {down!r} * r.level + (1 - {down!r}) * x.side END
  FROM r JOIN x ON x.stream_id = r.stream_id AND x.n = r.n + 1)
SELECT stream_id, n, round(value * {gain}, 6) AS value FROM r WHERE n >= 0"""


_OWN_LEVEL = "SELECT stream_id, n, value, abs(value) AS side FROM numbered"
_BANDS = [("low_shelf", 200.0, 0.7, 3.0), ("peak", 1000.0, 1.0, -4.0), ("high_shelf", 8000.0, 0.7, 2.0)]
_sample_query("eq_chain", _sections_sql([audio.biquad(k, f, q, g, RATE) for k, f, q, g in _BANDS], OUT + " FROM filtered"), lambda s: audio.equalise(s, BY, _BANDS, RATE))
_sample_query(
    "compressor_envelope",
    _followed_sql(_OWN_LEVEL, 5.0, 50.0, "pow(10.0, -greatest(20 * log10(greatest(level, 1e-12)) + 18, 0) * (1 - 1 / 4.0::DOUBLE) / 20)"),
    lambda s: audio.compress(s, BY, -18.0, 4.0, 5.0, 50.0, RATE),
)
_sample_query("noise_gate_envelope", _followed_sql(_OWN_LEVEL, 0.05, 0.5, "CASE WHEN level >= pow(10.0, -12.0 / 20) THEN 1 ELSE 0 END"), lambda s: audio.gate(s, BY, -12.0, 0.05, 0.5, RATE))


@plans.query(
    "duck_attack_release",
    _followed_sql(
        "SELECT m.stream_id, m.n, m.value, coalesce(abs(s.value), 0) AS side FROM numbered m LEFT JOIN (SELECT stream_id - 1 AS stream_id, n, value FROM numbered) s ON s.stream_id = m.stream_id AND s.n = m.n",
        0.1, 1.0, "pow(10.0, -greatest(20 * log10(greatest(level, 1e-12)) - 20 * log10(0.25::DOUBLE), 0) * (1 - 1 / 4.0::DOUBLE) / 20)",
    ),
)
def duck_attack_release(spark, d):
    main = media.numbered(spark, d).select("stream_id", "n", "value")
    return _out(audio.duck(main, main.withColumn("stream_id", F.col("stream_id") - 1), BY, 0.25, 4.0, attack=0.1, release=1.0, rate=RATE))


def _stretch_sql(factor: float, then: str) -> str:
    """Overlap-add of grains of 1024 every 512 outputs: (stream_id, n, value) as ``long``."""
    weight = "(0.5 - 0.5 * cos(2 * pi() * (m - start + 0.5) / 1024))"
    return f"""WITH {NUMBERED}, x AS (SELECT stream_id, n, value FROM numbered), len AS (SELECT stream_id, max(n) + 1 AS len FROM x GROUP BY stream_id),
o AS (SELECT stream_id, len, unnest(range(CAST(ceil(len / {factor!r}::DOUBLE) AS BIGINT))) AS m FROM len),
g AS (SELECT stream_id, len, m, m // 512 * 512 - 512 * j AS start FROM o, range(2) t(j) WHERE m // 512 * 512 - 512 * j >= 0),
long AS (SELECT g.stream_id, m AS n, coalesce(sum(x.value * {weight}), 0) / greatest(coalesce(sum({weight}) FILTER (x.n IS NOT NULL), 0), 1e-9) AS value
  FROM g LEFT JOIN x ON x.stream_id = g.stream_id AND x.n = CAST(floor(start * {factor!r}::DOUBLE) AS BIGINT) + m - start GROUP BY g.stream_id, m) {then}"""


_UP3 = 2 ** (3.0 / 12)
_sample_query(
    "pitch_resample",
    _stretch_sql(
        1 / _UP3,
        f""", top AS (SELECT stream_id, max(n) AS top FROM long GROUP BY stream_id),
p AS (SELECT x.stream_id, x.n, least(x.n * {_UP3!r}::DOUBLE, top) AS place, top FROM x JOIN top USING (stream_id))
SELECT p.stream_id, p.n, round(a.value + (b.value - a.value) * (place - floor(place)), 6) AS value FROM p JOIN long a ON a.stream_id = p.stream_id AND a.n = CAST(floor(place) AS BIGINT)
JOIN long b ON b.stream_id = p.stream_id AND b.n = least(CAST(floor(place) AS BIGINT) + 1, top)""",
    ),
    lambda s: audio.pitch_shift(s, BY, 3.0),
)
_sample_query("time_stretch", _stretch_sql(1.25, OUT + " FROM long"), lambda s: audio.time_stretch(s, BY, 1.25))


def _gating_sql(noise: str) -> str:
    """Spectral gating of frames of 16 samples, by sums over sines and cosines."""
    return f"""WITH {NUMBERED}, x AS MATERIALIZED (SELECT stream_id, n // 16 AS frame, n % 16 AS i, value FROM numbered),
f AS MATERIALIZED (SELECT stream_id, frame, k, sum(value * cos(2 * pi() * k * i / 16)) AS re, -sum(value * sin(2 * pi() * k * i / 16)) AS im FROM x, range(9) t(k) GROUP BY ALL),
l AS MATERIALIZED (SELECT *, sqrt(re * re + im * im) AS level FROM f), noise AS MATERIALIZED (SELECT stream_id, k, {noise} GROUP BY ALL),
g AS MATERIALIZED (SELECT l.stream_id, l.frame, l.k, CASE WHEN level <= noise.noise THEN pow(10.0, -12.0 / 20) ELSE 1 END * CASE WHEN l.k IN (0, 8) THEN 1 ELSE 2 END / 16.0 AS gain, re, im FROM l JOIN noise USING (stream_id, k))
SELECT x.stream_id, x.frame * 16 + x.i AS n, round(sum(gain * (re * cos(2 * pi() * k * i / 16) - im * sin(2 * pi() * k * i / 16))), 6) AS value
FROM x JOIN g USING (stream_id, frame) GROUP BY x.stream_id, x.frame, x.i"""


_sample_query("noise_reduce_fft", _gating_sql("median(level) AS noise FROM l"), lambda s: audio.denoise(s, BY, 12.0, size=16))
_sample_query("noise_reduce_profile", _gating_sql("avg(level) AS noise FROM l WHERE frame < 2"), lambda s: audio.denoise(s, BY, 12.0, profile=32, size=16))

# ---- loudness by the broadcast norm; two samples stand for a tenth of a second

_WEIGHTED = _sections_sql(audio.weighting(RATE), "")
_HOPS = """h AS (SELECT stream_id, n // 2 AS hop, sum(value * value) AS e, count(*) AS c FROM filtered GROUP BY ALL)"""


def _spans(name: str, hops: int) -> str:
    return f"""{name} AS (SELECT stream_id, e / c AS p FROM (SELECT stream_id, hop, sum(e) OVER f AS e, sum(c) OVER f AS c, max(hop) OVER (PARTITION BY stream_id) AS last
  FROM h WINDOW f AS (PARTITION BY stream_id ORDER BY hop RANGE BETWEEN CURRENT ROW AND {hops - 1} FOLLOWING)) WHERE hop + {hops - 1} <= last AND e / c > pow(10.0, (-70 + 0.691::DOUBLE) / 10))"""


_TAPS = ", ".join(f"({p}, {k - 5}, CAST({v!r} AS DOUBLE))" for p, row in enumerate(audio.between().tolist()) for k, v in enumerate(row))
_R128 = f"""{_WEIGHTED}, {_HOPS}, {_spans("b", 4)}, {_spans("s", 30)},
i AS (SELECT stream_id, -0.691 + 10 * log10(avg(p)) AS lufs FROM b JOIN (SELECT stream_id, avg(p) / 10 AS gate FROM b GROUP BY ALL) USING (stream_id) WHERE p > gate GROUP BY ALL),
bins AS (SELECT stream_id, floor((-0.691 + 10 * log10(p)) / 0.01) AS bin, count(*) AS c FROM s JOIN (SELECT stream_id, avg(p) / 100 AS gate FROM s GROUP BY ALL) USING (stream_id) WHERE p >= gate GROUP BY ALL),
run AS (SELECT stream_id, bin, sum(c) OVER (PARTITION BY stream_id ORDER BY bin) AS below, sum(c) OVER (PARTITION BY stream_id) AS every FROM bins),
r2 AS (SELECT stream_id, (min(bin) FILTER (below * 100 >= every * 95) - min(bin) FILTER (below * 100 >= every * 10)) * 0.01 AS lra FROM run GROUP BY ALL),
tap(phase, k, w) AS (VALUES {_TAPS}),
peak AS (SELECT stream_id, max(abs(v)) AS peak FROM (SELECT stream_id, n + j AS place, phase, sum(value * w) AS v
  FROM (SELECT stream_id, n, value, -k AS j, phase, w FROM x, tap) GROUP BY ALL) GROUP BY ALL),
measured AS (SELECT stream_id, lufs, lra, CASE WHEN peak > 0 THEN 20 * log10(peak) ELSE CAST('-inf' AS DOUBLE) END AS true_peak_db FROM peak LEFT JOIN i USING (stream_id) LEFT JOIN r2 USING (stream_id))"""


@plans.query("r128_measures", f"{_R128} SELECT stream_id, round(lufs, 6) AS lufs, round(lra, 6) AS lra, round(true_peak_db, 6) AS true_peak_db FROM measured")
def r128_measures(spark, d):
    s = media.numbered(spark, d).select("stream_id", "n", "value")
    return audio.r128(s, BY, RATE, hop=2).select("stream_id", *(F.round(c, 6).alias(c) for c in ("lufs", "lra", "true_peak_db")))


@plans.query(
    "loudness_normalised",
    f"""{_R128} SELECT stream_id, x.n, round(value * pow(10.0, coalesce(least(-16.0 - lufs, -1.5 - true_peak_db), 0) / 20), 6) AS value,
CASE WHEN lra IS NULL THEN 'not measured' WHEN lra <= 7 THEN 'within' ELSE 'exceeds' END AS lra_outcome FROM x JOIN measured USING (stream_id)""",
)
def loudness_normalised(spark, d):
    s = media.numbered(spark, d).select("stream_id", "n", "value")
    return _out(audio.normalise_loudness(s, BY, RATE, -16.0, -1.5, 7.0, hop=2), "lra_outcome")
