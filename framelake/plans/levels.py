"""Levels, islands, selection and sampling over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, select
from ..operators import keyframes as k1
from . import media
from .media import DAY_US, SAMPLES
from .register import Plans

plans = Plans()
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE

#: Recordings start with the table's first day, 2024-01-01: buckets count from there, whenever a stream's first sample comes.
ORIGIN_US = 1_704_067_200_000_000
_WAVE = f"""WITH {SAMPLES}, got AS (SELECT stream_id, (t_us - {ORIGIN_US}) // {DAY_US} AS bucket, max(abs(value)) AS peak, sqrt(avg(value * value)) AS rms FROM samples GROUP BY ALL)"""


def _recorded(spark, d):
    return media.samples(spark, d).withColumn("t_us", F.col("t_us") - ORIGIN_US)


@plans.query("waveform_bucketed", f"{_WAVE} SELECT stream_id, bucket, round(peak, 6) AS peak, round(rms, 6) AS rms FROM got")
def waveform_bucketed(spark, d):
    w = analysis.waveform(_recorded(spark, d), ["stream_id"], "t_us", "value", DAY_US, fill=False)
    return w.select("stream_id", "bucket", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"))


@plans.query(
    "waveform_gap_filled",
    f"""{_WAVE}, ends AS (SELECT stream_id, least(0, min(bucket)) AS lo, max(bucket) AS hi FROM got GROUP BY stream_id),
grid AS (SELECT stream_id, unnest(range(lo, hi + 1)) AS bucket FROM ends)
SELECT stream_id, bucket, round(coalesce(peak, 0), 6) AS peak, round(coalesce(rms, 0), 6) AS rms,
       CASE WHEN peak > 0 THEN round(20 * log10(peak), 6) END AS peak_db, CASE WHEN rms > 0 THEN round(20 * log10(rms), 6) END AS rms_db
FROM grid LEFT JOIN got USING (stream_id, bucket)""",
)
def waveform_gap_filled(spark, d):
    w = analysis.levels_db(analysis.waveform(_recorded(spark, d), ["stream_id"], "t_us", "value", DAY_US))
    finite = lambda c: F.when(F.col(c) > float("-inf"), F.round(c, 6)).alias(c)
    return w.select("stream_id", "bucket", F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"), finite("peak_db"), finite("rms_db"))


_T0, _T1 = 1_704_153_600_000_000, 1_705_000_000_000_000


@plans.query("trim_range", f"WITH {SAMPLES} SELECT stream_id, event_id, t_us FROM samples WHERE t_us >= {_T0} AND t_us < {_T1}")
def trim_range(spark, d):
    return select.trim(media.samples(spark, d), "t_us", _T0, _T1).select("stream_id", "event_id", "t_us")


@plans.query("reset_pts", f"WITH {SAMPLES} SELECT stream_id, event_id, t_us - min(t_us) OVER (PARTITION BY stream_id) AS t_us FROM samples")
def reset_pts(spark, d):
    return select.rebase(media.samples(spark, d), "t_us", ["stream_id"]).select("stream_id", "event_id", "t_us")


@plans.query("offset_speed", f"WITH {SAMPLES} SELECT stream_id, event_id, CAST(floor((t_us + 1500000) / 1.25) AS BIGINT) AS t_us FROM samples")
def offset_speed(spark, d):
    return select.speed(select.shift(media.samples(spark, d), "t_us", 1_500_000), "t_us", 1.25).select("stream_id", "event_id", F.floor("t_us").alias("t_us"))


@plans.query("reverse_time", f"WITH {SAMPLES} SELECT stream_id, event_id, min(t_us) OVER w + max(t_us) OVER w - t_us AS t_us FROM samples WINDOW w AS (PARTITION BY stream_id)")
def reverse_time(spark, d):
    return select.reversed_time(media.samples(spark, d), "t_us", ["stream_id"]).select("stream_id", "event_id", "t_us")


@plans.query("sample_every_n", f"WITH {SAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t_us, event_id) - 1 AS i FROM samples) SELECT stream_id, event_id FROM n WHERE i % 5 = 0")
def sample_every_n(spark, d):
    return select.every_nth(media.samples(spark, d), ["t_us", "event_id"], ["stream_id"], 5).select("stream_id", "event_id")


@plans.query("keyframe_list", f"WITH {SAMPLES} SELECT stream_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN t_us END, t_us - 1000) AS ts FROM samples WHERE event_type = 'click'")
def keyframe_list(spark, d):
    s = media.samples(spark, d)
    packets = s.withColumns({"pts": F.when(F.col("event_id") % 4 != 0, F.col("t_us")), "dts": F.col("t_us") - 1000})
    return select.keyframes(packets, F.col("event_type") == "click").select("stream_id", "ts")


@plans.query(
    "asof_backward_keyframe",
    f"""WITH {SAMPLES}, keys AS (SELECT stream_id, t_us, event_id AS key_id FROM samples WHERE event_type = 'click')
SELECT s.stream_id, s.event_id, s.t_us, k.key_id FROM samples s ASOF LEFT JOIN keys k ON s.stream_id = k.stream_id AND s.t_us >= k.t_us""",
)
def asof_backward_keyframe(spark, d):
    s = media.samples(spark, d)
    keys = s.filter("event_type = 'click'").select("stream_id", "t_us", F.col("event_id").alias("key_id"))
    return select.asof(s.select("stream_id", "t_us", "event_id"), keys, ["stream_id"], "t_us", ["key_id"]).select("stream_id", "event_id", "t_us", "key_id")


@plans.query(
    "asof_forward_extract",
    f"""WITH {SAMPLES}, keys AS (SELECT stream_id, t_us, event_id AS key_id FROM samples WHERE event_type = 'click')
SELECT s.stream_id, s.event_id, s.t_us, k.key_id FROM samples s ASOF LEFT JOIN keys k ON s.stream_id = k.stream_id AND s.t_us <= k.t_us""",
)
def asof_forward_extract(spark, d):
    s = media.samples(spark, d)
    keys = s.filter("event_type = 'click'").select("stream_id", "t_us", F.col("event_id").alias("key_id"))
    return select.asof(s.select("stream_id", "t_us", "event_id"), keys, ["stream_id"], "t_us", ["key_id"], forward=True).select("stream_id", "event_id", "t_us", "key_id")


_REL = f"{SAMPLES}, rel AS (SELECT stream_id, event_id, event_type, value, t_us - min(t_us) OVER (PARTITION BY stream_id) AS t FROM samples)"


@plans.query(
    "sample_interval_grid",
    f"""WITH {_REL}, grid AS (SELECT stream_id, unnest(range(0, max(t) + 1, {DAY_US})) AS grid FROM rel GROUP BY stream_id)
SELECT g.stream_id, g.grid, r.t, r.event_id FROM grid g ASOF JOIN rel r ON g.stream_id = r.stream_id AND g.grid <= r.t""",
)
def sample_interval_grid(spark, d):
    rel = select.rebase(media.samples(spark, d), "t_us", ["stream_id"]).withColumnRenamed("t_us", "t")
    return select.sample_grid(rel, ["stream_id"], "t", DAY_US, ["event_id"]).select("stream_id", "grid", "t", "event_id")


@plans.query(
    "frame_rate_conform",
    f"""WITH {_REL}, ends AS (SELECT stream_id, max(t) * 1000 AS hi FROM rel GROUP BY stream_id),
grid AS (SELECT stream_id, unnest(range(0, CAST(floor(hi * 1.0 / 40000000000000) AS BIGINT) + 1)) AS k FROM ends)
SELECT g.stream_id, g.k, r.event_id FROM (SELECT *, k * 40000000000000 AS at FROM grid) g ASOF LEFT JOIN (SELECT *, t * 1000 AS ns FROM rel) r ON g.stream_id = r.stream_id AND g.at >= r.ns""",
)
def frame_rate_conform(spark, d):
    rel = select.rebase(media.samples(spark, d), "t_us", ["stream_id"]).withColumn("ns", F.col("t_us") * 1000)
    return select.conform(rel, ["stream_id"], "ns", 1, 40_000, ["event_id"]).select("stream_id", "k", "event_id")


@plans.query(
    "silence_islands",
    f"""WITH {SAMPLES}, m AS (SELECT *, abs(value) <= 100 * pow(10, -10.0 / 20) AS q, lead(t_us) OVER w AS nxt,
  sum(CASE WHEN abs(value) <= 100 * pow(10, -10.0 / 20) THEN 0 ELSE 1 END) OVER w AS island FROM samples WINDOW w AS (PARTITION BY stream_id ORDER BY t_us)),
r AS (SELECT stream_id, island, min(t_us) AS s, max(t_us) AS l FROM m WHERE q GROUP BY ALL)
SELECT r.stream_id, r.s AS start, m.nxt AS "end" FROM r JOIN m ON m.stream_id = r.stream_id AND m.t_us = r.l WHERE m.nxt IS NOT NULL AND m.nxt - r.s >= {DAY_US}""",
)
def silence_islands(spark, d):
    scaled = media.samples(spark, d).withColumn("value", F.col("value") / 100)
    return analysis.silence(scaled, ["stream_id"], "t_us", "value", -10.0, DAY_US).select("stream_id", "start", "end")


@plans.query(
    "black_islands",
    f"""WITH {SAMPLES}, m AS (SELECT *, coalesce(lead(t_us) OVER w, t_us) AS nxt, sum(CASE WHEN value / 100 >= 0.3 THEN 0 ELSE 1 END) OVER w AS island FROM samples WINDOW w AS (PARTITION BY stream_id ORDER BY t_us))
SELECT stream_id, min(t_us) AS start FROM m WHERE value / 100 >= 0.3 GROUP BY stream_id, island HAVING max(nxt) - min(t_us) >= {DAY_US}""",
)
def black_islands(spark, d):
    frames = media.samples(spark, d).withColumn("dark", F.col("value") / 100)
    return analysis.black_starts(frames, ["stream_id"], "t_us", "dark", 0.3, DAY_US).select("stream_id", "start")


@plans.query("scene_cuts_lag", f"WITH {SAMPLES}, s AS (SELECT stream_id, t_us, abs(value - lag(value) OVER (PARTITION BY stream_id ORDER BY t_us)) / 100 AS score FROM samples) SELECT stream_id, t_us FROM s WHERE score > 0.4")
def scene_cuts_lag(spark, d):
    score = F.expr("abs(value - lag(value) OVER (PARTITION BY stream_id ORDER BY t_us)) / 100")
    return analysis.scene_cuts(media.samples(spark, d).withColumn("score", score), ["stream_id"], "t_us", "score", 0.4)


@plans.query(
    "session_activity",
    f"""WITH {SAMPLES}, m AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w < {DAY_US} THEN 0 ELSE 1 END AS opens FROM samples WINDOW w AS (PARTITION BY stream_id ORDER BY t_us)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY stream_id ORDER BY t_us) AS session FROM m)
SELECT stream_id, min(t_us) AS start, count(*) AS n FROM n GROUP BY stream_id, session""",
)
def session_activity(spark, d):
    s = media.samples(spark, d).withColumn("ts", F.timestamp_micros("t_us"))
    return s.groupBy("stream_id", F.session_window("ts", "24 hours")).agg(F.min("t_us").alias("start"), F.count("*").alias("n")).select("stream_id", "start", "n")


# ---- keyframe interpolation ------------------------------------------------------------------------------------------

_KEYS = f"""{_REL}, keys AS (SELECT stream_id, t, value, CAST(event_id % 6 AS INTEGER) AS kind FROM rel WHERE event_type = 'click'),
seg AS (SELECT stream_id, t AS t0, value AS v0, kind, lead(t) OVER w AS t1, lead(value) OVER w AS v1, first_value(value) OVER w AS vf FROM keys WINDOW w AS (PARTITION BY stream_id ORDER BY t)),
j AS (SELECT r.stream_id, r.event_id, r.t, s.*, (SELECT min(vf) FROM seg x WHERE x.stream_id = r.stream_id) AS vfirst
      FROM rel r ASOF LEFT JOIN (SELECT stream_id AS sid, t0, v0, kind, t1, v1 FROM seg) s ON r.stream_id = s.sid AND r.t >= s.t0),
u AS (SELECT *, (t - t0) * 1.0 / (t1 - t0) AS p FROM j)"""


def _tracks(spark, d, easing):
    # Only differences of times count, so they needn't start at 0.
    times = media.samples(spark, d).select(F.col("stream_id").alias("owner_id"), F.lit("opacity").alias("prop"), F.col("t_us").alias("ts_ns"), "event_id", "event_type", "value")
    keys = times.filter("event_type = 'click'").select("owner_id", "prop", "ts_ns", "value", easing.alias("easing"), F.lit(0.25).alias("x1"), F.lit(0.1).alias("y1"), F.lit(0.25).alias("x2"), F.lit(1.0).alias("y2"), F.col("event_id").alias("seq"))
    return k1.value_at(times.drop("event_type", "value"), keys).select(F.col("owner_id").alias("stream_id"), "event_id", F.round("value", 6).alias("value"))


def _curve(u: str) -> str:
    return f"{_KEYS} SELECT stream_id, event_id, round(CASE WHEN t0 IS NULL THEN vfirst WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * ({u}) END, 6) AS value FROM u"


@plans.query("keyframe_lerp_linear", f"WITH {_curve('p')}")
def keyframe_lerp_linear(spark, d):
    return _tracks(spark, d, F.lit("linear"))


@plans.query("keyframe_easing_all", f"WITH {_curve('CASE kind WHEN 0 THEN 0.0 WHEN 1 THEN p WHEN 2 THEN p * p * p WHEN 3 THEN 1 - (1 - p) * (1 - p) * (1 - p) ELSE 3 * p * p - 2 * p * p * p END')}")
def keyframe_easing_all(spark, d):
    kinds = ["hold", "linear", "ease_in", "ease_out", "ease_in_out", "ease_in_out"]
    return _tracks(spark, d, F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 6 + 1).cast("int")))


def _newton(steps: int = 4) -> str:
    """Bezier (0.25, 0.1, 0.25, 1.0) with nested Newton steps."""
    cubic = "(3 * (1 - {0}) * (1 - {0}) * {0} * {1} + 3 * (1 - {0}) * {0} * {0} * {2} + {0} * {0} * {0})"
    slope = "(3 * (1 - {0}) * (1 - {0}) * 0.25 + 6 * (1 - {0}) * {0} * 0.0 + 3 * {0} * {0} * 0.75)"
    ctes, last = [], "u"
    for i in range(steps):
        s = "p" if not i else f"s{i}"
        ctes.append(f"n{i + 1} AS (SELECT *, least(1.0, greatest(0.0, {s} - ({cubic.format(s, 0.25, 0.25)} - p) / {slope.format(s)})) AS s{i + 1} FROM {last})")
        last = f"n{i + 1}"
    y = cubic.format(f"s{steps}", 0.1, 1.0)
    return f"""WITH {_KEYS}, {', '.join(ctes)}
SELECT stream_id, event_id, round(CASE WHEN t0 IS NULL THEN vfirst WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * {y} END, 6) AS value FROM {last}"""


@plans.query("keyframe_easing_bezier", _newton())
def keyframe_easing_bezier(spark, d):
    return _tracks(spark, d, F.lit("bezier"))
