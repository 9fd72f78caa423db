"""Parameter checks of chains, strict point selection, animated grades and crops, tracks and effects in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blend as fb
from ..functions import colour as fc
from ..operators import checks, planes, select
from ..operators import timeline as tl
from . import media
from .extras import _AN, _animated
from .media import CLIPS, DAY_US, SAMPLES, TRACKS, byte
from .pictures import _sums
from .register import Plans

plans = Plans()
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE

#: A step of each part: kind, and its one parameter as a multiple of p_size less a constant.
_STEPS = [("speed", "factor", 2.5, 3.0), ("hue", "degrees", 20.0, 500.0), ("compressor", "ratio", 0.5, 2.0), ("freeze_frame", "duration", 1.0, 9.0), ("scale", "width", 1.0, 0.0), ("loudness_normalize", "target_lufs", 1.0, 30.0), ("nlmeans", "strength", 1.0, 5.0)]
_KIND = " ".join(f"WHEN {i} THEN '{k}'" for i, (k, *_) in enumerate(_STEPS))
_VALUE = " ".join(f"WHEN {i} THEN p_size * {a!r}::DOUBLE - {b!r}::DOUBLE" for i, (_, _, a, b) in enumerate(_STEPS))
_CHAIN = f"s AS (SELECT p_partkey, CASE p_partkey % 7 {_KIND} END AS kind, CASE p_partkey % 7 {_VALUE} END AS value FROM part)"
_NAME = " ".join(f"WHEN '{k}' THEN '{p}'" for k, p, *_ in _STEPS)


def _steps(spark, d):
    i, size = F.col("p_partkey") % len(_STEPS), F.col("p_size")
    pick = lambda of: F.element_at(F.array(*of), (i + 1).cast("int"))
    value = pick([size * a - b for _, _, a, b in _STEPS])
    return media.table(spark, d, "part").select("p_partkey", pick([F.lit(k) for k, *_ in _STEPS]).alias("kind"), F.create_map(pick([F.lit(p) for _, p, *_ in _STEPS]), value).alias("params"))


@plans.query(
    "step_faults",
    f"""WITH {_CHAIN} SELECT p_partkey, kind, CASE kind {_NAME} END AS param, value FROM s WHERE CASE kind WHEN 'speed' THEN value < 0.1 OR value > 100 WHEN 'hue' THEN abs(value) > 360
WHEN 'compressor' THEN value < 1 WHEN 'freeze_frame' THEN value <= 0 WHEN 'loudness_normalize' THEN value >= 0 WHEN 'nlmeans' THEN value < 1 OR value > 30 ELSE false END""",
)
def step_faults(spark, d):
    """Parameters out of their ranges, of a step for each part."""
    return checks.faults(_steps(spark, d), ["p_partkey"])


@plans.query("size_changing", f"WITH {_CHAIN} SELECT p_partkey, kind = 'scale' AS changes FROM s")
def size_changing(spark, d):
    return _steps(spark, d).select("p_partkey", checks.may_change_size(F.col("kind")).alias("changes"))


@plans.query(
    "point_select",
    f"WITH {SAMPLES}, p AS (SELECT stream_id, max(t_us) - {DAY_US} AS t_us FROM samples GROUP BY stream_id) SELECT p.stream_id, p.t_us, max(s.t_us) AS shown FROM p ASOF JOIN samples s ON s.stream_id = p.stream_id AND p.t_us <= s.t_us GROUP BY ALL",
)
def point_select(spark, d):
    """The first frame at or after a day before each stream's end; a stream without one would be an error."""
    s = media.samples(spark, d)
    at = s.groupBy("stream_id").agg((F.max("t_us") - DAY_US).alias("t_us"))
    return select.points(at, s.select("stream_id", "t_us", F.col("t_us").alias("shown")), ["stream_id"], "t_us", ["shown"])


_GRADED = "((r + k * 0.2::DOUBLE - 0.5) * (1 + k) + 0.5)".replace("r +", "{c} +")


@plans.query(
    "keyframed_grade",
    f"""{_AN}, c AS (SELECT frame_no, k, {", ".join(f"{_GRADED.format(c=c)} AS {c}" for c in "rgb")} FROM an), y AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS y FROM c)
SELECT frame_no, {", ".join(f"CAST(sum({byte(f'pow(least(1.0, greatest(0.0, y + ({c} - y) * (2 - k))), 1 / (0.5::DOUBLE + k))')}) AS BIGINT) AS {c}" for c in "rgb")} FROM y GROUP BY frame_no""",
)
def keyframed_grade(spark, d):
    """Brightness, contrast, saturation and gamma of each frame by its keyframes."""
    k, p = F.col("k"), _animated(spark, d)
    graded = fc.grade(*(F.col(c) for c in "rgb"), k * 0.2, 1 + k, 2 - k)
    return _sums(p.select("frame_no", *(fb.to_byte(fc.gamma(v, 0.5 + k)).alias(c) for v, c in zip(graded, "rgb"))))


@plans.query("keyframed_crop_xy", f"{_AN} SELECT frame_no, CAST(x - floor(k * 4) AS INTEGER) AS x, CAST(y - floor(3 - k * 3) AS INTEGER) AS y, {byte('r')} AS r FROM an WHERE x >= floor(k * 4) AND x < floor(k * 4) + 4 AND y >= floor(3 - k * 3) AND y < floor(3 - k * 3) + 5")
def keyframed_crop_xy(spark, d):
    """A window of four by five that moves both ways; its size is fixed when a chain is made."""
    x0, y0 = F.floor(F.col("k") * 4), F.floor(3 - F.col("k") * 3)
    p = _animated(spark, d).withColumns({"_x": F.col("x") - x0, "_y": F.col("y") - y0}).filter("_x BETWEEN 0 AND 3 AND _y BETWEEN 0 AND 4")
    return p.select("frame_no", F.col("_x").cast("int").alias("x"), F.col("_y").cast("int").alias("y"), fb.to_byte(F.col("r")).alias("r"))


@plans.query(
    "unsharp_luma_chroma",
    f"""WITH {media.PIXELS}, m AS (SELECT p.frame_no, p.x, p.y, any_value(p.r) AS r, any_value(p.g) AS g, avg(q.r) AS mr, avg(q.g) AS mg FROM pixels p JOIN pixels q ON q.frame_no = p.frame_no AND abs(q.x - p.x) <= 2 AND abs(q.y - p.y) <= 2 GROUP BY p.frame_no, p.x, p.y)
SELECT frame_no, round(sum((r + 1.2::DOUBLE * (r - mr)) * (y * 8 + x + 1)), 6) AS y, round(sum((g - 0.5::DOUBLE * (g - mg)) * (y * 8 + x + 1)), 6) AS u FROM m GROUP BY frame_no""",
)
def unsharp_luma_chroma(spark, d):
    """The first plane sharpened, the others softened."""
    f = media.planes(spark, d).withColumnsRenamed({"r": "y", "g": "u", "b": "v"})
    total = lambda c: F.round(F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v), 6).alias(c)
    return planes.unsharp_luma_chroma(f, 1.2, -0.5).select("frame_no", total("y"), total("u"))


@plans.query("edit_add_track", f"WITH {TRACKS} SELECT track_id, timeline_id, kind FROM tracks UNION ALL SELECT (SELECT max(track_id) + 1 FROM tracks), 1, 'audio'")
def edit_add_track(spark, d):
    t = media.tracks(spark, d).select("track_id", "timeline_id", "kind")
    return tl.add_row(t, spark.createDataFrame([(None, 1, "audio")], "track_id long, timeline_id long, kind string"), "track_id")


@plans.query("edit_reorder_effects", f"WITH {CLIPS} SELECT track_id AS clip_id, clip_id AS effect_id, CASE WHEN track_id = 1 THEN (SELECT count(*) FROM clips WHERE track_id = 1) - 1 - pos ELSE pos END AS pos FROM clips")
def edit_reorder_effects(spark, d):
    """The first clip's effects the other way round (tracks stand for clips, their clips for effects)."""
    e = media.clips(spark, d).select(F.col("track_id").alias("clip_id"), F.col("clip_id").alias("effect_id"), "pos")
    have = [r.effect_id for r in e.filter("clip_id = 1").orderBy(F.desc("pos")).collect()]  # one clip's
    return tl.reorder_effects(e, 1, have)
