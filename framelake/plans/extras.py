"""Keyframed picture steps, plane layouts, placement, markers and effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blend as fb
from ..functions import colour as fc
from ..operators import audio, keyframes, layout, pixels
from ..operators import timeline as tl
from . import media
from .media import NUMBERED, PIXELS, SAMPLES, byte
from .pictures import noise
from .register import Plans

plans = Plans()
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE

#: One track: (frame, value, easing of what follows).
TRACK = [(0, 0.0, "ease_in_out"), (100, 1.0, "linear"), (300, 0.25, "hold"), (400, 0.75, "linear")]
_U = "CASE WHEN frame_no < 100 THEN 3 * (frame_no / 100.0::DOUBLE) * (frame_no / 100.0::DOUBLE) - 2 * (frame_no / 100.0::DOUBLE) * (frame_no / 100.0::DOUBLE) * (frame_no / 100.0::DOUBLE)"
_K = f"({_U} WHEN frame_no < 300 THEN 1.0::DOUBLE + (0.25::DOUBLE - 1.0::DOUBLE) * ((frame_no - 100) / 200.0::DOUBLE) WHEN frame_no < 400 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END)"
_AN = f"WITH {PIXELS}, an AS (SELECT *, {_K} AS k FROM pixels)"


def _animated(spark, d):
    rows = [(0, "k", t, v, e, 0.0, 0.0, 1.0, 1.0, i) for i, (t, v, e) in enumerate(TRACK)]
    keys = spark.createDataFrame(rows, "owner_id long, prop string, ts_ns long, value double, easing string, x1 double, y1 double, x2 double, y2 double, seq long")
    return keyframes.animate(media.pixels(spark, d), keys, ["k"])


def _sum(df, value):
    return df.groupBy("frame_no").agg(F.sum(value.cast("long")).alias("total"))


def _keyed(name: str, sql: str, f) -> None:
    plans.query(name, f"{_AN} SELECT frame_no, CAST(sum({sql}) AS BIGINT) AS total FROM an GROUP BY frame_no")(lambda spark, d: _sum(p := _animated(spark, d), f(p)))


_keyed("keyframed_brightness", byte("(r + k * 0.2::DOUBLE - 0.5) * 1 + 0.5"), lambda p: fb.to_byte((F.col("r") + F.col("k") * 0.2 - 0.5) * 1 + 0.5))
_keyed("keyframed_gamma", byte("pow(r, 1 / (0.5::DOUBLE + k))"), lambda p: fb.to_byte(fc.gamma(F.col("r"), 0.5 + F.col("k"))))
_keyed("keyframed_rect_mask", "CASE WHEN x >= round(k * 4) AND x <= round(k * 4) + 4 - 1 AND y >= 1 AND y <= 3 THEN 255 ELSE 0 END", lambda p: fc.rect_mask(F.col("x"), F.col("y"), F.round(F.col("k") * 4), 1, 4, 3))
_keyed("keyframed_color_key", byte("CASE WHEN sqrt(((r - 0.5) * (r - 0.5) + (g - 0.5) * (g - 0.5) + (b - 0.5) * (b - 0.5)) / 3) > k * 0.2::DOUBLE THEN 1.0 ELSE 0.0 END"), lambda p: fb.to_byte(fc.color_key(*(F.col(c) for c in "rgb"), (0.5, 0.5, 0.5), F.col("k") * 0.2, None)))
_keyed("keyframed_film_grain", f"CAST(floor({noise()} * k * 1000) AS BIGINT)", lambda p: F.floor(fc.grain(F.col("x"), F.col("y"), F.col("frame_no")) * F.col("k") * 1000))


@plans.query("keyframed_motion_blur", f"{_AN}, m AS (SELECT frame_no, r * (1 - k) + coalesce(lag(r) OVER (PARTITION BY x, y ORDER BY frame_no), r) * k AS r FROM an) SELECT frame_no, round(avg(r), 6) AS r FROM m GROUP BY frame_no")
def keyframed_motion_blur(spark, d):
    p = _animated(spark, d)
    return pixels.motion_mix(p, F.col("k") * 360).groupBy("frame_no").agg(F.round(F.avg("r"), 6).alias("r"))


@plans.query("keyframed_crop", f"{_AN} SELECT frame_no, CAST(x - floor(k * 4) AS INTEGER) AS x, y, {byte('r')} AS r FROM an WHERE x >= floor(k * 4) AND x < floor(k * 4) + 4")
def keyframed_crop(spark, d):
    x0 = F.floor(F.col("k") * 4)
    p = _animated(spark, d).filter((F.col("x") >= x0) & (F.col("x") < x0 + 4))
    return p.select("frame_no", (F.col("x") - x0).cast("int").alias("x"), "y", fb.to_byte(F.col("r")).alias("r"))


@plans.query("feather_mask", "WITH g AS (SELECT i % 8 AS x, i // 8 AS y FROM range(64) t(i)), " + "m AS (SELECT x, y, CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM g), " + "k(i, w) AS (VALUES {taps}), h AS (SELECT p.x, p.y, sum(q.r * w) / sum(w) AS r FROM m p, k JOIN m q ON q.y = p.y AND q.x = p.x + i GROUP BY ALL), v AS (SELECT p.x, p.y, sum(q.r * w) / sum(w) AS r FROM h p, k JOIN h q ON q.x = p.x AND q.y = p.y + i GROUP BY ALL) SELECT vec_id AS frame_no, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(r, 6) AS a FROM embeddings, v".replace("{taps}", ", ".join(f"({i - 3}, {k!r}::DOUBLE)" for i, k in enumerate(pixels.weights(1.0)))))
def feather_mask(spark, d):
    """The edge of a matte, softened: only alpha is blurred."""
    p = media.pixels(spark, d)
    a = F.when(F.col("x").between(2, 5) & F.col("y").between(2, 5), 1.0).otherwise(0.0)
    return pixels.blur(p.select("frame_no", "x", "y", a.alias("a")), 1.0, ["a"]).select("frame_no", "x", "y", F.round("a", 6).alias("a"))


@plans.query("alpha_matte", f"WITH {PIXELS} SELECT p.frame_no, CAST(sum({byte('0.2126::DOUBLE * q.r + 0.7152::DOUBLE * q.g + 0.0722::DOUBLE * q.b')}) AS BIGINT) AS a FROM pixels p JOIN pixels q ON q.frame_no = p.frame_no + 1 AND p.x = q.x AND p.y = q.y GROUP BY p.frame_no")
def alpha_matte(spark, d):
    p = media.pixels(spark, d)
    out = pixels.alpha_matte(p, media.next_frames(p)).filter("a IS NOT NULL")
    return out.groupBy("frame_no").agg(F.sum(fb.to_byte(F.col("a")).cast("long")).alias("a"))


# ---- layouts ---------------------------------------------------------------------------------------------------------


def _planes(spark, d):
    # In single precision, as the SQL has it: a whole number alone would make the product double.
    e = media.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v * F.lit(1000).cast("float")).cast("long")).alias("v"))
    return e.select("vec_id", F.array(F.slice("v", 1, 32), F.slice("v", 33, 32)).alias("planes"), "v")


@plans.query("planar_to_packed", "SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CAST(floor(embedding[i % 2 * 32 + i // 2 + 1] * 1000) AS BIGINT)), ',') AS packed FROM embeddings")
def planar_to_packed(spark, d):
    return _planes(spark, d).select("vec_id", F.array_join(layout.interleave(F.col("planes")).cast("array<string>"), ",").alias("packed"))


@plans.query("packed_to_planar", "SELECT vec_id, array_to_string(list_transform(range(64), lambda i: CAST(floor(embedding[i % 32 * 2 + i // 32 + 1] * 1000) AS BIGINT)), ',') AS planar FROM embeddings")
def packed_to_planar(spark, d):
    return _planes(spark, d).select("vec_id", F.array_join(F.flatten(layout.deinterleave(F.col("v"), 2)).cast("array<string>"), ",").alias("planar"))


@plans.query("stride_removal", "SELECT vec_id, array_to_string(list_transform(list_filter(range(64), lambda i: i % 8 < 6), lambda i: CAST(floor(embedding[i + 1] * 1000) AS BIGINT)), ',') AS plane FROM embeddings")
def stride_removal(spark, d):
    return _planes(spark, d).select("vec_id", F.array_join(layout.remove_stride(F.col("v"), 6, 8, 8).cast("array<string>"), ",").alias("plane"))


@plans.query("fit_modes", "WITH p AS (SELECT p_partkey, p_size * 10 AS w, (51 - p_size) * 10 AS h FROM part) SELECT p_partkey, m AS mode, round(CASE m WHEN 'none' THEN 1.0 WHEN 'stretch' THEN 640.0::DOUBLE / w WHEN 'fit' THEN least(640.0::DOUBLE / w, 360.0::DOUBLE / h) ELSE greatest(640.0::DOUBLE / w, 360.0::DOUBLE / h) END, 6) AS fx, round(CASE m WHEN 'none' THEN 1.0 WHEN 'stretch' THEN 360.0::DOUBLE / h WHEN 'fit' THEN least(640.0::DOUBLE / w, 360.0::DOUBLE / h) ELSE greatest(640.0::DOUBLE / w, 360.0::DOUBLE / h) END, 6) AS fy FROM p, (VALUES ('none'), ('stretch'), ('fit'), ('fill')) AS v(m)")
def fit_modes(spark, d):
    p = media.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("w"), ((51 - F.col("p_size")) * 10).alias("h"))
    modes = [(m, layout.fit_factors(m, F.col("w"), F.col("h"), 640, 360)) for m in ("none", "stretch", "fit", "fill")]
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.round(x, 6).alias("fx"), F.round(y, 6).alias("fy")) for m, (x, y) in modes))).alias("f")
    return p.select("p_partkey", each).select("p_partkey", "f.*")


@plans.query("transform_merge", "SELECT event_id, round(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, nullif(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE value / 2 END, 1.0), CASE WHEN event_id % 5 = 0 THEN 0.5 END, 1.0), 6) AS opacity FROM events")
def transform_merge(spark, d):
    i, v = F.col("event_id"), F.col("value")
    own = layout.merged_value(F.when(i % 3 == 0, v), F.when(i % 2 == 0, 1.0).otherwise(v / 2), F.when(i % 5 == 0, 0.5), 1.0)
    return media.table(spark, d, "events").select("event_id", F.round(own, 6).alias("opacity"))


@plans.query("placement_frame_snap", f"WITH {SAMPLES} SELECT event_id, CAST(round(round(t_us % 1000000007 * 1000 / 1e9 * 25.0) / 25.0 * 1e9) AS BIGINT) AS ns FROM samples")
def placement_frame_snap(spark, d):
    return media.samples(spark, d).select("event_id", layout.snap(F.col("t_us") % 1_000_000_007 * 1000, 25.0).alias("ns"))


@plans.query("hold_last_pad", f"WITH {NUMBERED}, l AS (SELECT stream_id, max(n) AS hi, arg_max(value, n) AS value FROM numbered GROUP BY stream_id) SELECT stream_id, n, round(value, 6) AS value FROM numbered UNION ALL SELECT stream_id, unnest(range(hi + 1, 100)), round(value, 6) FROM l")
def hold_last_pad(spark, d):
    n = media.numbered(spark, d).select("stream_id", "n", "value")
    return layout.hold_last(n, ["stream_id"], "n", 100).select("stream_id", "n", F.round("value", 6).alias("value"))


@plans.query("timeline_gap_fill", f"WITH {SAMPLES}, day AS (SELECT stream_id, t_us // {media.DAY_US} AS n, max(value) AS value FROM samples GROUP BY ALL), g AS (SELECT *, lead(n) OVER (PARTITION BY stream_id ORDER BY n) AS nxt FROM day) SELECT stream_id, n, value FROM day UNION ALL SELECT stream_id, unnest(range(n + 1, nxt)), 0.0 FROM g WHERE nxt - n > 2")
def timeline_gap_fill(spark, d):
    day = media.samples(spark, d).groupBy("stream_id", F.floor(F.col("t_us") / media.DAY_US).alias("n")).agg(F.max("value").alias("value"))
    return layout.fill_gaps(day, ["stream_id"], "n", "value", 0.0)


@plans.query("count_mismatch_guard", "WITH a AS (SELECT user_id, count(*) AS a FROM events WHERE event_type = 'click' GROUP BY user_id), b AS (SELECT user_id, count(*) AS b FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT user_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (user_id) WHERE coalesce(a, 0) <> coalesce(b, 0)")
def count_mismatch_guard(spark, d):
    e = media.table(spark, d, "events")
    return layout.count_mismatch(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["user_id"])


@plans.query("replace_audio", f"WITH {NUMBERED} SELECT stream_id, n, ch, round(value, 6) AS value FROM numbered WHERE ch <> 1 UNION ALL SELECT stream_id, n, 1, round(-value, 6) FROM numbered WHERE ch = 0")
def replace_audio(spark, d):
    """One channel gives way to another stream's."""
    s = media.numbered(spark, d).select("stream_id", "n", "ch", "value")
    new = s.filter("ch = 0").withColumns({"ch": F.lit(1), "value": -F.col("value")})
    return s.filter("ch <> 1").unionByName(new).withColumn("value", F.round("value", 6))


@plans.query("metadata_lookup", "SELECT event_id, json_extract_string(props, '$.k') AS k, length(props)::INTEGER AS n FROM events")
def metadata_lookup(spark, d):
    return media.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").alias("n"))


@plans.query("parallel_buses", f"WITH {NUMBERED} SELECT stream_id, n, round(greatest(-1.0, least(1.0, value * pow(10.0, CASE WHEN ch = 0 THEN -3.0 ELSE 3.0 END / 20))), 6) AS value FROM numbered")
def parallel_buses(spark, d):
    s = media.numbered(spark, d)
    out = audio.mix([s.filter(F.col("ch") == c).withColumn("value", F.col("value") * F.pow(F.lit(10.0), F.lit(g / 20))) for c, g in ((0, -3.0), (1, 3.0))])
    return out.select("stream_id", "n", F.round("value", 6).alias("value"))


# ---- markers and effects ---------------------------------------------------------------------------------------------


def _markers(spark, d):
    return media.samples(spark, d).select(F.col("stream_id").alias("timeline_id"), F.col("event_id").alias("marker_id"), F.col("t_us").alias("pts"), F.col("event_type").alias("name"))


@plans.query("edit_markers", f"WITH {SAMPLES}, m AS (SELECT stream_id AS timeline_id, event_id AS marker_id, CASE WHEN event_id = 2 THEN 77 ELSE t_us END AS pts, event_type AS name FROM samples WHERE event_id <> 3) SELECT * FROM m UNION ALL SELECT 0, (SELECT max(event_id) + 1 FROM samples), 5, 'new'")
def edit_markers(spark, d):
    """Added, moved and removed."""
    m = _markers(spark, d)
    new = spark.createDataFrame([(0, None, 5, "new")], "timeline_id long, marker_id long, pts long, name string")
    edits = [lambda t: tl.add_row(t, new, "marker_id"), lambda t: tl.set_where(t, "marker_id", 2, {"pts": 77}), lambda t: t.filter("marker_id <> 3")]
    return tl.batch(m, edits)


@plans.query("edit_effects", "SELECT l_orderkey AS clip_id, CAST(CASE WHEN l_orderkey = 1 THEN 0 ELSE l_linenumber END AS BIGINT) AS pos, l_partkey AS effect_id, CASE WHEN l_partkey = 5 THEN 'glow' ELSE l_returnflag END AS kind, l_linestatus = 'O' AND l_partkey <> 7 AS enabled FROM lineitem WHERE l_partkey <> 9 AND l_orderkey <> 1")
def edit_effects(spark, d):
    """Kind replaced, switched off, removed; a clip's effects cleared."""
    e = media.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("effect_id"), F.col("l_returnflag").alias("kind"), (F.col("l_linestatus") == "O").alias("enabled"))
    e = tl.set_where(e, "effect_id", 5, {"kind": "glow"})
    e = tl.set_where(e, "effect_id", 7, {"enabled": False})
    return tl.remove_effect(e, 9).filter("clip_id <> 1")


@plans.query("edit_track_lock", f"WITH {media.TRACKS}, {media.CLIPS} SELECT clip_id FROM clips WHERE track_id IN (SELECT track_id FROM tracks WHERE track_id = 1)")
def edit_track_lock(spark, d):
    """Clips that a lock on track 1 protects."""
    t = tl.set_where(media.tracks(spark, d).withColumn("lock", F.lit(False)), "track_id", 1, {"lock": True})
    return media.clips(spark, d).join(t.filter("lock"), "track_id", "left_semi").select("clip_id")


@plans.query("edit_canvas_rate", "SELECT c_custkey AS timeline_id, CASE WHEN c_custkey = 1 THEN 1920 ELSE 640 END AS canvas_w, CASE WHEN c_custkey = 1 THEN 1080 ELSE 360 END AS canvas_h, CASE WHEN c_custkey = 2 THEN 24000 ELSE 30 END AS fps_num, CASE WHEN c_custkey = 2 THEN 1001 ELSE 1 END AS fps_den FROM customer")
def edit_canvas_rate(spark, d):
    t = media.table(spark, d, "customer").select(F.col("c_custkey").alias("timeline_id"), F.lit(640).alias("canvas_w"), F.lit(360).alias("canvas_h"), F.lit(30).alias("fps_num"), F.lit(1).alias("fps_den"))
    return tl.set_frame_rate(tl.set_canvas(t, 1, 1920, 1080), 2, 24000, 1001)
