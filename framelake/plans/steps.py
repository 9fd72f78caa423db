"""Fades, keyframed steps, denoising, still overlays, loudness, thumbnails, locks, catalogues, and sources read from files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..folders import shared_folder
from ..functions import blend as fb
from ..functions import colour as fc
from ..functions import time as tm
from ..operators import analysis, audio, pixels, planes, segments, select
from ..operators import timeline as tl
from ..sources import catalogue, documents, subtitles
from . import media
from .extras import _AN, _animated
from .media import CLIPS, DAY_US, PIXELS, SAMPLES, TRACKS, byte
from .pictures import _BYTES, _CLAMP, _SMOOTH, RGB, _bytes, _h, _hsl_back, _placed_sum, _plane_mean, _s, _sums, _sums_sql
from .register import Plans

plans = Plans()
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE

# ---- fades -----------------------------------------------------------------------------------------------------------


def _fade(name: str, out: bool, white: bool) -> None:
    shown = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (frame_no / 25.0::DOUBLE - 2.0) / 8.0::DOUBLE))"
    shown = f"(1 - {shown})" if out else shown
    sql = {c: byte(f"{c} * {shown}" + (f" + (1 - {shown})" if white else "")) for c in RGB}

    def run(spark, d):
        p = pixels.fade(media.pixels(spark, d), F.col("frame_no") / 25.0, 2.0, 8.0, out=out, white=white)
        return _sums(p.select("frame_no", *(fb.to_byte(F.col(c)).alias(c) for c in RGB)))

    plans.query(name, f"WITH {PIXELS} {_sums_sql('pixels', sql)}")(run)


for _name, _out, _white in (("video_fade_in", False, False), ("video_fade_out", True, False), ("video_fade_in_white", False, True), ("video_fade_out_white", True, True)):
    _fade(_name, _out, _white)


# ---- keyframed steps: k runs from 0 to 1 and back --------------------------------------------------------------------


def _keyed(name: str, ctes: str, source: str, sql: dict[str, str], f) -> None:
    def run(spark, d):
        p = _animated(spark, d)
        return _sums(p.select("frame_no", *(fb.to_byte(v).alias(c) for c, v in zip(RGB, f(*(F.col(c) for c in RGB), F.col("k"))))))

    plans.query(name, f"{_AN}{ctes} {_sums_sql(source, {c: byte(v) for c, v in sql.items()})}")(run)


_WHEELS = f""", wl AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM an), ww AS (SELECT *, 1 - {_SMOOTH.format(p='l', lo='0.0', w='0.5::DOUBLE')} AS ws, {_SMOOTH.format(p='l', lo='0.5::DOUBLE', w='0.5::DOUBLE')} AS wh FROM wl),
wm AS (SELECT *, {_CLAMP.format('1 - ws - wh')} AS wm FROM ww), w1 AS (SELECT frame_no, k, wm, wh, {', '.join(f'{c} + k * 0.1::DOUBLE * ws AS {c}' for c in RGB)} FROM wm),
w2 AS (SELECT frame_no, k, wh, {', '.join(f'{c} + (pow({_CLAMP.format(c)}, 1 / (0.5::DOUBLE + k)) - {c}) * wm AS {c}' for c in RGB)} FROM w1)"""
_keyed("keyframed_color_balance", _WHEELS, "w2", {c: f"{c} * (1 + (1 + k * 0.2::DOUBLE - 1) * wh)" for c in RGB}, lambda r, g, b, k: fc.wheels((r, g, b), k * 0.1, 0.5 + k, 1 + k * 0.2))
#: A three-way corrector that moves: lift and gain are the ends of a line, gamma bends it.
_keyed(
    "keyframed_three_way",
    "",
    "an",
    {c: f"pow({_CLAMP.format(f'k * 0.1::DOUBLE + {c} * (1 - k * 0.2::DOUBLE - k * 0.1::DOUBLE)')}, 1 / (0.5::DOUBLE + k))" for c in RGB},
    lambda r, g, b, k: [fc.three_way(v, k * 0.1, 0.5 + k, 1 - k * 0.2) for v in (r, g, b)],
)
_VD = "(2 * sqrt(((x + 0.5) / 8.0::DOUBLE - 0.5) * ((x + 0.5) / 8.0::DOUBLE - 0.5) + ((y + 0.5) / 8.0::DOUBLE - 0.5) * ((y + 0.5) / 8.0::DOUBLE - 0.5)))"
_VS = f"(1 - {_SMOOTH.format(p=_VD, lo='0.5::DOUBLE', w='(0.5 + 0.4::DOUBLE - 0.5)')} * k)"
_keyed("keyframed_vignette", "", "an", {c: f"{c} * {_VS}" for c in RGB}, lambda r, g, b, k: [v * fc.vignette(F.col("x"), F.col("y"), 8, 8, 0.5, 0.4, k) for v in (r, g, b)])
_HS = ", top AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM an), hs AS (SELECT frame_no, " + _h("") + " + k * 90 / 360.0::DOUBLE AS h, " + _CLAMP.format(f"({_s('')}) * (0.5::DOUBLE + k)") + " AS s, " + _CLAMP.format("(hi + lo) / 2 + k * 0.1::DOUBLE") + " AS l FROM top)"
_keyed("keyframed_hsl", _HS, "hs", {c: _hsl_back(f"(h{t})", "s", "l") for c, t in zip(RGB, (" + 1.0::DOUBLE / 3", "", " - 1.0::DOUBLE / 3"))}, lambda r, g, b, k: fc.hsl_shift(r, g, b, k * 90, 0.5 + k, k * 0.1))
_KY = 0.2126 * 0.2 + 0.7152 * 0.6 + 0.0722 * 0.3
_CD = "sqrt(" + " + ".join(f"(({c} - l) - ({v}::DOUBLE - {_KY!r}::DOUBLE)) * (({c} - l) - ({v}::DOUBLE - {_KY!r}::DOUBLE))" for c, v in zip(RGB, (0.2, 0.6, 0.3))) + ")"
_CK = _SMOOTH.format(p=_CD, lo="(k * 0.5::DOUBLE - 0.1::DOUBLE)", w="((k * 0.5::DOUBLE + 0.1::DOUBLE) - (k * 0.5::DOUBLE - 0.1::DOUBLE))")
_keyed("keyframed_chroma_key", ", cl AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM an)", "cl", {c: f"{c} * {_CK}" for c in RGB}, lambda r, g, b, k: [v * fc.chroma_key(r, g, b, (0.2, 0.6, 0.3), k * 0.5, 0.1) for v in (r, g, b)])


def _keyed_mean(name: str, sql: str, f) -> None:
    """Per frame, the mean of red to six digits."""
    plans.query(name, sql)(lambda spark, d: f(_animated(spark, d)).groupBy("frame_no").agg(F.round(F.avg("r"), 6).alias("r")))


_GAUSS = "CASE WHEN p.k > 0 THEN exp(-(i * i) / (2 * p.k * p.k)) WHEN i = 0 THEN 1.0 ELSE 0.0 END"
_keyed_mean(
    "keyframed_blur",
    f"""{_AN}, t(i) AS (SELECT unnest(range(-3, 4))), h AS (SELECT p.frame_no, p.x, p.y, p.k, sum(q.r * {_GAUSS}) / sum({_GAUSS}) AS r FROM an p, t JOIN an q ON q.frame_no = p.frame_no AND q.y = p.y AND q.x = p.x + i GROUP BY ALL),
v AS (SELECT p.frame_no, p.x, p.y, sum(q.r * {_GAUSS}) / sum({_GAUSS}) AS r FROM h p, t JOIN h q ON q.frame_no = p.frame_no AND q.x = p.x AND q.y = p.y + i GROUP BY ALL) SELECT frame_no, round(avg(r), 6) AS r FROM v GROUP BY frame_no""",
    lambda p: pixels.blur(p, F.col("k"), ["r"], reach=3),
)
_BOX = "h AS (SELECT p.frame_no, p.x, p.y, avg(q.r) AS r FROM an p JOIN an q ON q.frame_no = p.frame_no AND q.y = p.y AND abs(q.x - p.x) <= 2 GROUP BY ALL), v AS (SELECT p.frame_no, p.x, p.y, avg(q.r) AS r FROM h p JOIN h q ON q.frame_no = p.frame_no AND q.x = p.x AND abs(q.y - p.y) <= 2 GROUP BY ALL)"
_keyed_mean("keyframed_unsharp", f"{_AN}, {_BOX} SELECT p.frame_no, round(avg(p.r + p.k * (p.r - v.r)), 6) AS r FROM an p JOIN v USING (frame_no, x, y) GROUP BY p.frame_no", lambda p: pixels.unsharp(p, F.col("k")))
_TAPS = ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in zip(range(-3, 4), pixels.weights(1.0)))
_keyed_mean(
    "keyframed_glow",
    f"""{_AN}, hl AS (SELECT frame_no, x, y, greatest(r - 0.55::DOUBLE, 0.0) / (1 - 0.55::DOUBLE) AS r FROM an), t(i, w) AS (VALUES {_TAPS}),
h AS (SELECT p.frame_no, p.x, p.y, sum(q.r * w) / sum(w) AS r FROM hl p, t JOIN hl q ON q.frame_no = p.frame_no AND q.y = p.y AND q.x = p.x + i GROUP BY ALL),
v AS (SELECT p.frame_no, p.x, p.y, sum(q.r * w) / sum(w) AS r FROM h p, t JOIN h q ON q.frame_no = p.frame_no AND q.x = p.x AND q.y = p.y + i GROUP BY ALL)
SELECT an.frame_no, round(avg(least(1.0, an.r + v.r * an.k * 2)), 6) AS r FROM an JOIN v USING (frame_no, x, y) GROUP BY an.frame_no""",
    lambda p: pixels.glow(p, 0.55, 1.0, F.col("k") * 2),
)


@plans.query(
    "keyframed_rotate",
    f"""{_AN}, s AS (SELECT frame_no, x, y, CAST(round((x - 3.5) * cos(radians(k * 90)) + (y - 3.5) * sin(radians(k * 90)) + 3.5) AS INTEGER) AS sx, CAST(round((y - 3.5) * cos(radians(k * 90)) - (x - 3.5) * sin(radians(k * 90)) + 3.5) AS INTEGER) AS sy FROM an)
SELECT s.frame_no, CAST(sum({byte('coalesce(p.r, 0.0)')}) AS BIGINT) AS r FROM s LEFT JOIN pixels p ON p.frame_no = s.frame_no AND p.x = s.sx AND p.y = s.sy GROUP BY s.frame_no""",
)
def keyframed_rotate(spark, d):
    p = _animated(spark, d).withColumn("turn", F.col("k") * 90)
    return _sums(pixels.rotate(p, 8, 8, "turn").select("frame_no", fb.to_byte(F.col("r")).alias("r")), ["r"])


@plans.query(
    "keyframed_scale",
    f"""{_AN}, z AS (SELECT DISTINCT frame_no, 4 + CAST(round(k * 8) AS INTEGER) AS w FROM an), g AS (SELECT frame_no, w, CAST(i AS INTEGER) AS x FROM z, range(12) t(i) WHERE i < w)
SELECT g.frame_no, CAST(sum({byte('p.r')}) AS BIGINT) AS r FROM g JOIN pixels p ON p.frame_no = g.frame_no AND p.x = g.x * 8 // g.w GROUP BY g.frame_no""",
)
def keyframed_scale(spark, d):
    """The width follows the track."""
    p = _animated(spark, d).withColumn("w", 4 + F.round(F.col("k") * 8).cast("int"))
    return _sums(pixels.scale(p, 8, 8, F.col("w"), 8).select("frame_no", fb.to_byte(F.col("r")).alias("r")), ["r"])


# ---- denoising, placement, still overlays ----------------------------------------------------------------------------

_NEAR = [("x - 1", "y", "0"), ("x + 1", "y", "0"), ("x", "y - 1", "0"), ("x", "y + 1", "0"), ("x", "y", "1"), ("x", "y", "-1")]
_DN = " ".join(f"LEFT JOIN pixels q{i} ON q{i}.frame_no = p.frame_no - ({t}) AND q{i}.x = p.{x} AND q{i}.y = p.{y}" for i, (x, y, t) in enumerate(_NEAR))
_DW = [f"coalesce(exp(-((q{i}.r - p.r) / {0.1 if i < 4 else 0.2}::DOUBLE) * ((q{i}.r - p.r) / {0.1 if i < 4 else 0.2}::DOUBLE)), 0.0)" for i in range(6)]
_DM = f"(p.r + {' + '.join(f'coalesce(q{i}.r, 0.0) * {w}' for i, w in enumerate(_DW))}) / (1 + {' + '.join(_DW)})"


@plans.query("denoise_spatial_temporal", f"WITH {PIXELS} SELECT p.frame_no, round(avg({_DM}), 6) AS r FROM pixels p {_DN} GROUP BY p.frame_no")
def denoise_spatial_temporal(spark, d):
    return pixels.denoise(media.pixels(spark, d), 0.1, 0.2).groupBy("frame_no").agg(F.round(F.avg("r"), 6).alias("r"))


_CS, _SN = 0.955336489125606, 0.29552020666133955  # of 0.3 radians
_U, _V = "(((x + 0.5) / 8.0::DOUBLE - 0.5) / 1.5::DOUBLE)", "(((y + 0.5) / 8.0::DOUBLE - 0.5) / 0.8::DOUBLE)"


@plans.query(
    "transform_place",
    f"""WITH {PIXELS}, uv AS (SELECT frame_no, x, y, {_U} * {_CS} + {_V} * {_SN} + 0.5 - 0.1::DOUBLE AS u, {_V} * {_CS} - {_U} * {_SN} + 0.5 + 0.05::DOUBLE AS v FROM pixels),
s AS (SELECT *, u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AS inside, least(7.0, greatest(0.0, u * 8 - 0.5)) AS px, least(7.0, greatest(0.0, v * 8 - 0.5)) AS py FROM uv),
c AS (SELECT s.frame_no, s.x, s.y, inside, sum(p.r * (1 - abs(p.x - px)) * (1 - abs(p.y - py))) AS r FROM s JOIN pixels p ON p.frame_no = s.frame_no AND abs(p.x - px) < 1 AND abs(p.y - py) < 1 GROUP BY ALL)
SELECT frame_no, CAST(sum((y * 8 + x + 1) * {byte('CASE WHEN inside THEN r ELSE 0.0 END')}) AS BIGINT) AS r, CAST(count_if(inside) AS BIGINT) AS shown FROM c GROUP BY frame_no""",
)
def transform_place(spark, d):
    """Moved, then turned and zoomed; a row a frame."""
    p = planes.place(media.planes(spark, d), (0.1, -0.05), 0.3, (1.5, 0.8))
    return _placed_sum(p.select("frame_no", "r")).join(p.select("frame_no", F.aggregate("a", F.lit(0.0), lambda t, v: t + v).cast("long").alias("shown")), "frame_no")


@plans.query(
    "overlay_image",
    f"WITH {PIXELS} SELECT frame_no, CAST(sum({byte('CASE WHEN x BETWEEN 2 AND 4 AND y BETWEEN 3 AND 4 THEN (x - 2) / 4.0::DOUBLE * 0.4::DOUBLE + r * (1 - 0.4::DOUBLE) ELSE r END')}) AS BIGINT) AS r FROM pixels GROUP BY frame_no",
)
def overlay_image(spark, d):
    """A small picture, half transparent, on every frame."""
    i = F.col("id")
    image = spark.range(6).select((i % 3).cast("int").alias("x"), F.floor(i / 3).cast("int").alias("y"), (i % 3 / 4).alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b"), F.lit(0.5).alias("a"))
    p = pixels.overlay_image(media.pixels(spark, d), image, 2, 3, 0.8)
    return _sums(p.select("frame_no", fb.to_byte(F.col("r")).alias("r")), ["r"])


_CLIPPED = f"""{_BYTES}, m AS (SELECT a.frame_no, avg((a.r - b.r) * (a.r - b.r)) AS mse FROM bt a JOIN bt b ON b.frame_no = a.frame_no - a.frame_no % 3 AND a.x = b.x AND a.y = b.y GROUP BY a.frame_no)"""


@plans.query(
    "quality_means",
    f"""WITH {_CLIPPED} SELECT frame_no // 50 AS clip, round(avg(CASE WHEN mse > 0 THEN 10 * log10(255.0 * 255.0 / mse) ELSE 30 END), 6) AS psnr,
count(*) FILTER (WHERE mse = 0) > 0 AS equal FROM m GROUP BY frame_no // 50 HAVING count(*) FILTER (WHERE mse = 0) = 0
UNION ALL SELECT frame_no // 50, CAST(NULL AS DOUBLE), true FROM m GROUP BY frame_no // 50 HAVING count(*) FILTER (WHERE mse = 0) > 0""",
)
def quality_means(spark, d):
    """Mean picture quality of each clip, of which each third frame stands for three: every frame counts, so one that is
    equal makes the mean infinite."""
    p = _bytes(spark, d)
    own = p.select((F.col("frame_no") - F.col("frame_no") % 3).alias("_f"), "frame_no", "x", "y")
    shown = own.join(p.withColumnRenamed("frame_no", "_f"), ["_f", "x", "y"])
    both = p.join(shown.select("frame_no", "x", "y"), pixels.KEY, "left_semi")
    scores = analysis.mean_psnr(both, shown, "r").withColumn("clip", F.floor(F.col("frame_no") / 50))
    return analysis.mean_psnr_of(scores, "psnr", ["clip"]).select("clip", F.when(F.col("mean") < float("inf"), F.round("mean", 6)).alias("psnr"), (F.col("mean") == float("inf")).alias("equal"))


_WINDOWS = f"""{_BYTES}, w AS (SELECT a.frame_no, i, j, avg(a.r) AS mu, avg(b.r) AS mv, avg(a.r * a.r) AS uu, avg(b.r * b.r) AS vv, avg(a.r * b.r) AS uv
  FROM range(0, 5, 2) t(i), range(0, 5, 2) s(j), bt a JOIN bt b ON b.frame_no = a.frame_no + 1 AND b.x = a.x AND b.y = a.y WHERE a.x BETWEEN i AND i + 3 AND a.y BETWEEN j AND j + 3 GROUP BY ALL),
q AS (SELECT frame_no, avg((2 * mu * mv + 6.5025) * (2 * (uv - mu * mv) + 58.5225) / ((mu * mu + mv * mv + 6.5025) * (uu - mu * mu + vv - mv * mv + 58.5225))) AS ssim FROM w GROUP BY frame_no)"""


def _ssim(spark, d):
    whole = media.planes(spark, d)
    bytes_ = whole.withColumn("r", F.transform("r", lambda v: fb.to_byte(v).cast("double")))
    return planes.ssim(bytes_, bytes_.withColumn("frame_no", F.col("frame_no") - 1), "r", size=4, step=2)


@plans.query("ssim_windows", f"WITH {_WINDOWS} SELECT frame_no, round(ssim, 6) AS ssim FROM q")
def ssim_windows(spark, d):
    """Structural similarity of each frame and the next, over nine windows."""
    return _ssim(spark, d).select("frame_no", F.round("ssim", 6).alias("ssim"))


@plans.query("ssim_mean", f"WITH {_WINDOWS} SELECT frame_no // 50 AS clip, round(avg(ssim) FILTER (ssim > 0), 6) AS ssim FROM q GROUP BY frame_no // 50")
def ssim_mean(spark, d):
    """The mean over each clip; frames that aren't above 0 don't count."""
    return analysis.mean_ssim_of(_ssim(spark, d).withColumn("clip", F.floor(F.col("frame_no") / 50)), "ssim", ["clip"]).select("clip", F.round("mean", 6).alias("ssim"))


_AT = "p[1 + least(7, greatest(0, {y})) * 8 + least(7, greatest(0, {x}))]"
_D2 = f"list_sum(list_transform(range(9), lambda k: pow({_AT.format(x='x + k % 3 - 1', y='y + k // 3 - 1')} - {_AT.format(x='x + dx + k % 3 - 1', y='y + dy + k // 3 - 1')}, 2)))"


@plans.query(
    "non_local_means",
    f"""WITH f AS MATERIALIZED (SELECT vec_id AS frame_no, list_transform(CAST(embedding AS DOUBLE[]), lambda v: least(1.0, greatest(0.0, (v + 1) / 2))) AS p FROM embeddings),
g AS (SELECT frame_no, p, i % 8 AS x, i // 8 AS y, a - 2 AS dx, b - 2 AS dy FROM f, range(64) t(i), range(5) u(a), range(5) w(b)),
k AS (SELECT frame_no, x, y, exp(-{_D2} / (9 * 0.15::DOUBLE * 0.15::DOUBLE)) AS k, {_AT.format(x='x + dx', y='y + dy')} AS v FROM g),
o AS (SELECT frame_no, x, y, sum(k * v) / sum(k) AS r FROM k GROUP BY ALL) SELECT frame_no, round(avg(r), 6) AS r FROM o GROUP BY frame_no""",
)
def non_local_means(spark, d):
    """Patches of 3 by 3 sought within 5 by 5."""
    wide = media.planes(spark, d).select("frame_no", "w", "h", "r")
    return _plane_mean(planes.non_local_means(wide, 0.15, 3, 5, ["r"]))


for _mode in ("frame", "field", "frame_nospatial", "field_nospatial"):

    @plans.query(f"deinterlace_{_mode}")
    def _deinterlaced(spark, d, mode=_mode):
        """Frames of one clip in fifty, by three frames each (SQL can't follow edges; a plain loop does in the tests)."""
        out = planes.deinterlace(media.planes(spark, d).withColumn("clip", F.floor(F.col("frame_no") / 50)), mode, planes=["r"], by=["clip"])
        return out.select("frame_no", "field", F.round(F.aggregate("r", F.lit(0.0), lambda a, v: a + v), 6).alias("r"))


def _stored(spark, d):
    """Frames as stored bytes of 7 by 8 RGB pixels."""
    b = lambda c: F.transform(F.filter(F.col(c), lambda v, i: i % 8 < 7), lambda v: fb.to_byte(v))
    rgb = F.flatten(F.transform(F.arrays_zip(b("r").alias("r"), b("g").alias("g"), b("b").alias("b")), lambda v: F.array(v["r"], v["g"], v["b"])))
    data = F.unhex(F.array_join(F.transform(rgb, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    return media.planes(spark, d).select("frame_no", F.lit("rgb24").alias("format"), F.lit(7).alias("w"), F.col("h"), data.alias("data"))


def _byte_sum(lo: int, hi: int):
    """The sum of a frame's bytes [lo, hi) times their place, from 1."""
    return F.aggregate(F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda i: F.conv(F.hex(F.substr("data", i + 1, F.lit(1))), 16, 10).cast("long") * (i - lo + 1)), F.lit(0).cast("long"), lambda a, v: a + v)


_Y7 = f"""{PIXELS}, q AS (SELECT frame_no, x, y, {byte('r')} AS r, {byte('g')} AS g, {byte('b')} AS b FROM pixels WHERE x < 7), l AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM q),
yuv AS (SELECT frame_no, x, y, floor(l + 0.5) AS yy, floor((b - l) / 1.772::DOUBLE + 128.5) AS u, floor((r - l) / 1.402::DOUBLE + 128.5) AS v FROM l)"""


@plans.query(
    "format_on_scan",
    f"""WITH {_Y7}, h AS (SELECT frame_no, x // 2 AS x, y // 2 AS y, list(u ORDER BY y, x) AS us, list(v ORDER BY y, x) AS vs, count(DISTINCT x) AS nx FROM yuv GROUP BY frame_no, x // 2, y // 2),
c AS (SELECT frame_no, x, y, CASE WHEN nx = 1 THEN floor((us[1] + us[2]) / 2 + 0.5) ELSE floor((floor((us[1] + us[3]) / 2 + 0.5) + floor((us[2] + us[4]) / 2 + 0.5)) / 2 + 0.5) END AS u,
  CASE WHEN nx = 1 THEN floor((vs[1] + vs[2]) / 2 + 0.5) ELSE floor((floor((vs[1] + vs[3]) / 2 + 0.5) + floor((vs[2] + vs[4]) / 2 + 0.5)) / 2 + 0.5) END AS v FROM h)
SELECT frame_no, CAST((SELECT sum(yy * (y * 7 + x + 1)) FROM yuv i WHERE i.frame_no = f.frame_no) AS BIGINT) AS y, CAST((SELECT sum(u * (y * 4 + x + 1)) FROM c WHERE c.frame_no = f.frame_no) AS BIGINT) AS u,
CAST((SELECT sum(v * (y * 4 + x + 1)) FROM c WHERE c.frame_no = f.frame_no) AS BIGINT) AS v FROM (SELECT DISTINCT frame_no FROM yuv) f""",
)
def format_on_scan(spark, d):
    """RGB pictures of an odd width as 4:2:0 planes."""
    out = planes.scan_as(_stored(spark, d), "yuv420p")
    return out.select("frame_no", _byte_sum(0, 56).alias("y"), _byte_sum(56, 72).alias("u"), _byte_sum(72, 88).alias("v"))


@plans.query(
    "scale_on_scan",
    f"""WITH {_Y7} SELECT frame_no, 4 AS w, 4 AS h, CAST(sum((y // 2 * 4 + CASE x WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END + 1) * floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5)) AS BIGINT) AS y
FROM q WHERE x IN (0, 1, 3, 5) AND y % 2 = 0 GROUP BY frame_no""",
)
def scale_on_scan(spark, d):
    """Luma of half the height; the width follows, as an even number."""
    out = planes.scan_as(_stored(spark, d), "gray", height=4)
    return out.select("frame_no", "w", "h", _byte_sum(0, 16).alias("y"))


_MOB = [0.3, 10.0]
_A = -_MOB[0] ** 2 * (_MOB[1] - 1) / (_MOB[0] ** 2 - 2 * _MOB[0] + _MOB[1])
_B = (_MOB[0] ** 2 - 2 * _MOB[0] * _MOB[1] + _MOB[1]) / (_MOB[1] - 1)
_MOBIUS = f"CASE WHEN {{v}} <= 0.3 THEN {{v}} ELSE {(_B * _B + 2 * _B * _MOB[0] + _MOB[0] ** 2) / (_B - _A)!r}::DOUBLE * ({{v}} + {_A!r}::DOUBLE) / ({{v}} + {_B!r}::DOUBLE) END"


@plans.query("tone_map_mobius", f"WITH {PIXELS} {_sums_sql('pixels', {c: byte(_MOBIUS.format(v=f'({c} * 4)')) for c in RGB})}")
def tone_map_mobius(spark, d):
    return _sums(media.pixels(spark, d).select("frame_no", *(fb.to_byte(fc.tone_map(F.col(c) * 4, "mobius")).alias(c) for c in RGB)))


# ---- sound -----------------------------------------------------------------------------------------------------------


@plans.query(
    "loudness_gated",
    f"""WITH {SAMPLES}, h AS (SELECT stream_id, t_us // {DAY_US} AS hop, sum(value / 100 * (value / 100)) AS e, count(DISTINCT t_us) AS n FROM samples GROUP BY ALL),
w AS (SELECT stream_id, hop, sum(e) OVER f AS e, sum(n) OVER f AS n, max(hop) OVER (PARTITION BY stream_id) AS last FROM h WINDOW f AS (PARTITION BY stream_id ORDER BY hop RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING)),
b AS (SELECT stream_id, e / n AS p FROM w WHERE hop + 3 <= last AND e / n > pow(10.0, (-70 + 0.691::DOUBLE) / 10)), g AS (SELECT stream_id, avg(p) / 10 AS gate FROM b GROUP BY stream_id),
l AS (SELECT stream_id, -0.691 + 10 * log10(avg(p)) AS lufs FROM b JOIN g USING (stream_id) WHERE p > gate GROUP BY stream_id)
SELECT stream_id, round(lufs, 6) AS lufs FROM (SELECT DISTINCT stream_id FROM samples) LEFT JOIN l USING (stream_id)""",
)
def loudness_gated(spark, d):
    """Two-gate loudness over samples taken as weighted already, a day as the hop."""
    s = media.samples(spark, d).withColumn("value", F.col("value") / 100)
    return audio.loudness(s, ["stream_id"], "t_us", DAY_US).select("stream_id", F.round("lufs", 6).alias("lufs"))


# ---- thumbnails, catalogues, locks -----------------------------------------------------------------------------------

_REL = f"{SAMPLES}, rel AS (SELECT stream_id, event_id, t_us - min(t_us) OVER (PARTITION BY stream_id) AS t FROM samples), dur AS (SELECT stream_id, max(t) AS d FROM rel GROUP BY stream_id)"


def _rel(spark, d):
    return select.rebase(media.samples(spark, d), "t_us", ["stream_id"]).select("stream_id", "event_id", F.col("t_us").alias("t"))


def _grid_sql(n: int) -> str:
    """Places of n thumbnails and the last key frame (every fourth event, and the first) at or before each."""
    return f"""WITH {_REL}, keys AS (SELECT stream_id, t, max(event_id) AS event_id FROM (SELECT *, t = 0 OR event_id % 4 = 0 AS is_key FROM rel) WHERE is_key GROUP BY stream_id, t),
g AS (SELECT stream_id, i, i * (d // {n}) AS at FROM dur, range({n}) r(i) WHERE d > 0)"""


@plans.query("thumbnails_n", _grid_sql(7) + " SELECT g.stream_id, g.i, g.at, keys.t, keys.event_id FROM g ASOF JOIN keys ON keys.stream_id = g.stream_id AND g.at >= keys.t")
def thumbnails_n(spark, d):
    """Seven thumbnails of each stream, at key frames."""
    return segments.thumbnails(_rel(spark, d), ["stream_id"], "t", 7, ["event_id"], key=(F.col("t") == 0) | (F.col("event_id") % 4 == 0)).select("stream_id", "i", "at", "t", "event_id")


@plans.query("sprite_sheet", _grid_sql(12) + ' SELECT g.stream_id, g.at, CAST(i % 4 AS INTEGER) AS col, CAST(i // 4 AS INTEGER) AS "row", keys.event_id FROM g ASOF JOIN keys ON keys.stream_id = g.stream_id AND g.at >= keys.t')
def sprite_sheet(spark, d):
    """The frames of a sheet of four by three for every stream, and their places."""
    key = (F.col("t") == 0) | (F.col("event_id") % 4 == 0)
    return segments.thumbnails(_rel(spark, d), ["stream_id"], "t", 12, ["event_id"], columns=4, key=key).select("stream_id", "at", "col", "row", "event_id")


@plans.query(
    "total_frames",
    f"""WITH {TRACKS}, {CLIPS} SELECT timeline_id, CASE WHEN count(c.clip_id) = count(out_ns - in_ns) THEN CAST(round(coalesce(sum(out_ns - in_ns), 0) / 1e9 * 29.97::DOUBLE) AS BIGINT) END AS frames
FROM tracks t LEFT JOIN clips c USING (track_id) WHERE kind = 'video' GROUP BY timeline_id""",
)
def total_frames(spark, d):
    """Frames that each timeline's export has to make."""
    return tl.total_frames(media.clips(spark, d), media.tracks(spark, d), 2997, 100)


_STREAMS = f"{TRACKS}, {CLIPS}, st AS (SELECT timeline_id AS path, kind, track_id AS stream_index, max(end_ns) AS duration_ns, count(*) * 1000 AS size FROM tracks JOIN spans USING (track_id) GROUP BY ALL)"


def _streams(spark, d):
    c = tl.with_footprint(media.clips(spark, d)).groupBy("track_id").agg(F.max("end_ns").alias("duration_ns"), (F.count("*") * 1000).alias("size"))
    return media.tracks(spark, d).join(c, "track_id").select(F.col("timeline_id").alias("path"), "kind", F.col("track_id").alias("stream_index"), "duration_ns", "size")


@plans.query(
    "probe_containers",
    f"""WITH {_STREAMS}, c AS (SELECT path, count(*) FILTER (kind = 'video') AS n_video, count(*) FILTER (kind = 'audio') AS n_audio, min(stream_index) FILTER (kind = 'video') AS primary_video, min(stream_index) FILTER (kind = 'audio') AS primary_audio,
  max(duration_ns) AS duration_ns, CAST(sum(size) AS BIGINT) AS size FROM st GROUP BY path) SELECT *, CASE WHEN duration_ns > 0 THEN CAST(round(size * 8e9 / duration_ns) AS BIGINT) END AS bit_rate FROM c""",
)
def probe_containers(spark, d):
    return catalogue.containers(_streams(spark, d))


@plans.query(
    "probe_chapters",
    f"""WITH {_REL}, m AS (SELECT rel.stream_id AS path, t * 1000 AS start_ns, event_id AS title, d * 1000 AS duration_ns FROM rel JOIN dur USING (stream_id) WHERE event_id % 3 = 0 AND t < d)
SELECT path, CAST(row_number() OVER w AS INTEGER) AS number, start_ns, coalesce(lead(start_ns) OVER w, duration_ns) AS end_ns, title FROM m WINDOW w AS (PARTITION BY path ORDER BY start_ns, title)""",
)
def probe_chapters(spark, d):
    """Every third event is a chapter's mark."""
    r = _rel(spark, d)
    durations = r.groupBy(F.col("stream_id").alias("path")).agg((F.max("t") * 1000).alias("duration_ns"))
    marks = r.filter("event_id % 3 = 0").select(F.col("stream_id").alias("path"), (F.col("t") * 1000).alias("start_ns"), F.col("event_id").alias("title"))
    return catalogue.chapters(marks, durations)


@plans.query("set_params", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 48000 END AS time_base_den, CASE WHEN event_id % 2 = 0 THEN 'bt709' ELSE event_type END AS colour_space, event_type AS kind FROM events")
def set_params(spark, d):
    """Stream parameters: those that are set replace what stands, the others stay."""
    e = media.table(spark, d, "events").select("event_id", F.lit(48000).alias("time_base_den"), F.col("event_type").alias("colour_space"), F.col("event_type").alias("kind"))
    return select.set_params(e, {"time_base_den": F.when(F.col("event_id") % 3 == 0, 1), "colour_space": F.when(F.col("event_id") % 2 == 0, "bt709")})


_LOCKED = f"{TRACKS}, {CLIPS}, held AS (SELECT clip_id, group_id, CASE WHEN track_id % 4 = 0 THEN track_id END AS clip_lock FROM clips), gl AS (SELECT group_id, min(clip_lock) AS l FROM held WHERE group_id IS NOT NULL GROUP BY group_id)"


@plans.query("edit_lock_targets", f"WITH {_LOCKED} SELECT clip_id, clip_lock, CASE WHEN held.group_id IS NULL THEN clip_lock ELSE l END AS group_lock FROM held LEFT JOIN gl ON gl.group_id = held.group_id")
def edit_lock_targets(spark, d):
    """Which edits of which clips a lock on every fourth track refuses."""
    c = media.clips(spark, d)
    tracks = media.tracks(spark, d).withColumn("lock", F.col("track_id") % 4 == 0)
    return tl.lock_targets(c, tracks)


# ---- sources read from files, and edits of one row -------------------------------------------------------------------


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


_CUBES = "c AS (SELECT vec_id // 27 AS cube, vec_id % 27 AS i, vec_id % 100 AS r, vec_id % 41 AS g, vec_id % 7 AS b, count(*) OVER (PARTITION BY vec_id // 27) AS n FROM embeddings)"


def _cube_files(spark, d, head: str, line):
    """A file for each 27 frames, in a folder with its number; read as whole texts."""
    k = F.col("vec_id")
    rows = media.table(spark, d, "embeddings").select(F.floor(k / 27).alias("cube"), (k % 27).alias("i"), line(k).alias("l"))
    files = rows.groupBy("cube").agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda x: x["l"]), "\n")).alias("value"), F.count("*").alias("n"))
    where = _folder(spark)
    files.filter("n = 27").drop("n").repartition("cube").write.partitionBy("cube").text(where)
    return spark.read.schema("value string, cube long").text(where, wholetext=True)


@plans.query("read_cube", f"WITH {_CUBES} SELECT cube, CAST(i % 3 AS INTEGER) AS r_idx, CAST(i // 3 % 3 AS INTEGER) AS g_idx, CAST(i // 9 AS INTEGER) AS b_idx, r / 100.0::DOUBLE AS r, g / 100.0::DOUBLE AS g, b / 100.0::DOUBLE AS b FROM c WHERE n = 27")
def read_cube(spark, d):
    """Cube files of three points a side, written and read."""
    number = lambda v: F.concat(F.floor(v / 100), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))
    files = _cube_files(spark, d, 'TITLE "t"\n# note\nLUT_3D_SIZE 3\n', lambda k: F.concat_ws(" ", number(k % 100), number(k % 41), number(k % 7)))
    return documents.parse_cubes(files, ["cube"]).drop("size")


@plans.query("read_projects", "SELECT c_custkey AS clip_id, CASE c_nationkey % 3 WHEN 0 THEN 30000 WHEN 1 THEN 25 ELSE 24000 END AS fps_num, CASE c_nationkey % 3 WHEN 1 THEN 1 ELSE 1001 END AS fps_den, 2 AS format_version FROM customer")
def read_projects(spark, d):
    """A project file for every customer, of three versions, parsed."""
    c = media.table(spark, d, "customer")
    clips = F.concat(F.lit('"clips":[{"clip_id":'), F.col("c_custkey").cast("string"), F.lit("}]"))
    kind = F.col("c_nationkey") % 3
    old = F.concat(F.lit('{"canvas_w":640,"fps":29.97,'), clips, F.lit("}"))
    first = F.concat(F.lit('{"format_version":1,"timeline":{"fps":25.0,'), clips, F.lit("}}"))
    new = F.concat(F.lit('{"format_version":2,"timeline":{"fps_num":24000,"fps_den":1001,'), clips, F.lit("}}"))
    files = c.select(F.when(kind == 0, old).when(kind == 1, first).otherwise(new).alias("value"))
    docs = documents.parse_projects(files.withColumn("path", F.lit("")))
    return docs.select(F.get("timeline.clips", 0)["clip_id"].alias("clip_id"), "timeline.fps_num", "timeline.fps_den", "format_version")


@plans.query("parse_ass", "SELECT conv_id AS path, CAST(count(*) AS BIGINT) AS n, CAST(sum(turn * 2000) AS BIGINT) AS starts_ms, CAST(sum(length(role)) AS BIGINT) AS letters FROM conversations GROUP BY conv_id")
def parse_ass(spark, d):
    """Every conversation as an ASS file: a dialogue line a turn, styled text."""
    at = lambda s: F.format_string("%d:%02d:%02d.00", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    t = media.table(spark, d, "conversations")
    line = F.concat(F.lit("Dialogue: 0,"), at(F.col("turn") * 2), F.lit(","), at(F.col("turn") * 2 + 1), F.lit(",Default,,0,0,0,,{\\i1}"), F.col("role"), F.lit("{\\i0}"))
    files = t.groupBy(F.col("conv_id").alias("path")).agg(F.concat(F.lit("[Events]\nFormat: a, b\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n")).alias("content"))
    got = subtitles.parse_ass(files)
    return got.groupBy("path").agg(F.count("*").alias("n"), F.sum((F.col("start_ns") / 1_000_000).cast("long")).alias("starts_ms"), F.sum(F.length("text").cast("long")).alias("letters"))


_EFFECTS = "SELECT l_orderkey AS clip_id, CAST(l_linenumber AS BIGINT) AS pos, l_partkey AS effect_id, l_returnflag AS kind FROM lineitem"


@plans.query("edit_set_clip", f"WITH {CLIPS} SELECT clip_id, track_id, source_path FROM clips WHERE clip_id <> (SELECT min(clip_id) FROM clips) UNION ALL SELECT (SELECT min(clip_id) FROM clips), 1, 'new'")
def edit_set_clip(spark, d):
    """The first clip is replaced and keeps its id."""
    c = media.clips(spark, d).select("clip_id", "track_id", "source_path")
    first = c.agg(F.min("clip_id")).first()[0]
    return tl.set_clip(c, spark.createDataFrame([(0, 1, "new")], "clip_id long, track_id long, source_path string"), first)


@plans.query("edit_add_effect", f"{_EFFECTS} UNION ALL SELECT 1, (SELECT coalesce(max(l_linenumber) + 1, 0) FROM lineitem WHERE l_orderkey = 1), (SELECT max(l_partkey) + 1 FROM lineitem), 'glow'")
def edit_add_effect(spark, d):
    """A glow goes to the end of the first clip's effects."""
    e = media.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("long").alias("pos"), F.col("l_partkey").alias("effect_id"), F.col("l_returnflag").alias("kind"))
    return tl.add_effect(e, spark.createDataFrame([(0, 0, 0, "glow")], "clip_id long, pos long, effect_id long, kind string"), 1)


@plans.query("read_3dl", f"WITH {_CUBES} SELECT cube, CAST(i // 9 AS INTEGER) AS r_idx, CAST(i // 3 % 3 AS INTEGER) AS g_idx, CAST(i % 3 AS INTEGER) AS b_idx, round(r * 40 / 4095.0::DOUBLE, 9) AS r, round(g / 4095.0::DOUBLE, 9) AS g, round(CASE WHEN i = 5 THEN 4000 ELSE b END / 4095.0::DOUBLE, 9) AS b FROM c WHERE n = 27")
def read_3dl(spark, d):
    """Files of three points a side in 12 bits, written and read."""
    blue = lambda k: F.when(k % 27 == 5, 4000).otherwise(k % 7)
    files = _cube_files(spark, d, "# note\n0 512 1023 1023\n", lambda k: F.concat_ws(" ", k % 100 * 40, k % 41, blue(k)))
    return documents.parse_3dls(files, ["cube"]).select("cube", "r_idx", "g_idx", "b_idx", *(F.round(c, 9).alias(c) for c in RGB))


_A, _B = ("(event_id % 12 - 5)", "(event_id % 7 + 1)"), ("(event_id % 5 - 2)", "(event_id % 9 + 1)")


def _reduced_sql(name: str, n: str, m: str) -> str:
    return f"CASE WHEN {m} <> 0 THEN CAST(sign({m}) * ({n}) // gcd({n}, {m}) AS BIGINT) END AS {name}_num, CASE WHEN {m} <> 0 THEN CAST(abs({m}) // gcd({n}, {m}) AS BIGINT) END AS {name}_den"


_RATIOS = {"sum": (f"{_A[0]} * {_B[1]} + {_B[0]} * {_A[1]}", f"({_A[1]} * {_B[1]})"), "difference": (f"{_A[0]} * {_B[1]} - {_B[0]} * {_A[1]}", f"({_A[1]} * {_B[1]})"), "product": (f"{_A[0]} * {_B[0]}", f"({_A[1]} * {_B[1]})"), "quotient": (f"{_A[0]} * {_B[1]}", f"({_A[1]} * {_B[0]})"), "inverse": (_A[1], _A[0])}


@plans.query("rational_operations", f"SELECT event_id, {', '.join(_reduced_sql(k, n, m) for k, (n, m) in _RATIOS.items())} FROM events")
def rational_operations(spark, d):
    i = F.col("event_id")
    a, b = (i % 12 - 5, i % 7 + 1), (i % 5 - 2, i % 9 + 1)
    out = {"sum": tm.ratio_sum(*a, *b), "difference": tm.ratio_sum(*a, *b, minus=True), "product": tm.ratio_product(*a, *b), "quotient": tm.ratio_quotient(*a, *b), "inverse": tm.ratio_inverse(*a)}
    return media.table(spark, d, "events").select("event_id", *(v[f].alias(f"{k}_{f}") for k, v in out.items() for f in ("num", "den")))


_LINES = "SELECT conv_id AS path, turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms, trim(regexp_replace(role || ' ' || turn, '[^A-Za-z0-9]+', ' ', 'g')) AS text FROM conversations"


def _rewritten(spark, d, write, parse):
    t = media.table(spark, d, "conversations")
    said = F.trim(F.regexp_replace(F.concat_ws(" ", "role", F.col("turn").cast("string")), "[^A-Za-z0-9]+", " "))
    events = t.select(F.col("conv_id").alias("path"), (F.col("turn") * 2_000_000_000).alias("start_ns"), (F.col("turn") * 2_000_000_000 + 1_500_000_000).alias("end_ns"), F.col("turn").alias("index"), said.alias("text"))
    back = parse(write(events))
    return back.select("path", (F.col("start_ns") / 1_000_000).cast("long").alias("start_ms"), (F.col("end_ns") / 1_000_000).cast("long").alias("end_ms"), "text")


@plans.query("subtitle_vtt_round_trip", _LINES)
def subtitle_vtt_round_trip(spark, d):
    return _rewritten(spark, d, subtitles.format_vtt, subtitles.parse_blocks)


@plans.query("subtitle_ass_round_trip", _LINES)
def subtitle_ass_round_trip(spark, d):
    return _rewritten(spark, d, subtitles.format_ass, subtitles.parse_ass)
