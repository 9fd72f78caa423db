"""Timeline documents: derived values, validation, edits, text, time arithmetic, segments, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..folders import shared_folder
from ..functions import text as ft
from ..functions import time as tm
from ..operators import segments, select
from ..operators import timeline as tl
from ..sources import documents as sd
from ..sources import subtitles
from ..streaming import live
from . import media
from .media import CLIPS, DAY_US, SAMPLES, TRACKS
from .register import Plans

plans = Plans()
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE
NS = 1_000_000_000

# ---- time ------------------------------------------------------------------------------------------------------------

_FRAMES = "f AS (SELECT event_id, event_id * 7919 AS frame, CASE event_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 30000 WHEN 2 THEN 25 ELSE 60000 END AS num, CASE event_id % 4 WHEN 1 THEN 1001 WHEN 3 THEN 1001 ELSE 1 END AS den FROM events)"


def _frames(spark, d):
    kind = F.col("event_id") % 4
    num = F.when(kind == 0, 24).when(kind == 1, 30000).when(kind == 2, 25).otherwise(60000)
    return media.table(spark, d, "events").select("event_id", (F.col("event_id") * 7919).alias("frame"), num.cast("long").alias("num"), F.when(kind.isin(1, 3), 1001).otherwise(1).cast("long").alias("den"))


@plans.query("frame_index_round", "SELECT event_id, CASE WHEN value >= 0 THEN CAST(round(value * 23.976) AS BIGINT) END AS frame FROM events")
def frame_index_round(spark, d):
    return media.table(spark, d, "events").select("event_id", tm.frame_index(F.col("value"), F.lit(23.976)).alias("frame"))


_TC = f"""{_FRAMES}, r AS (SELECT *, CAST(round(num * 1.0 / den) AS BIGINT) AS fps FROM f), dr AS (SELECT *, CASE WHEN num % den <> 0 AND fps % 30 = 0 THEN fps // 30 * 2 ELSE 0 END AS dropped FROM r),
w AS (SELECT *, frame % ((fps * 600 - dropped * 9) * 144) AS fr, fps * 60 - dropped AS pm, fps * 600 - dropped * 9 AS pt FROM dr),
nm AS (SELECT *, fr + dropped * (fr // pt * 9 + CASE WHEN fr % pt >= fps * 60 THEN (fr % pt - fps * 60) // pm + 1 ELSE 0 END) AS named FROM w)"""


@plans.query("timecode_dropframe", f"WITH {_TC} SELECT event_id, printf('%02d:%02d:%02d', named // (fps * 3600) % 24, named // (fps * 60) % 60, named // fps % 60) || CASE WHEN dropped > 0 THEN ';' ELSE ':' END || printf('%02d', named % fps) AS tc FROM nm")
def timecode_dropframe(spark, d):
    return _frames(spark, d).select("event_id", tm.timecode(F.col("frame"), F.col("num"), F.col("den")).alias("tc"))


@plans.query("timecode_round_trip", f"WITH {_TC} SELECT event_id, fr AS frame FROM nm")
def timecode_round_trip(spark, d):
    f = _frames(spark, d)
    tc = tm.timecode(F.col("frame"), F.col("num"), F.col("den"))
    return f.select("event_id", tm.parse_timecode(tc, F.col("num"), F.col("den")).alias("frame"))


@plans.query("timestamp_rescale", f"WITH {_FRAMES} SELECT event_id, CAST((2 * CAST(frame AS HUGEINT) * den * 90000 + num) // (2 * num) AS BIGINT) AS pts FROM f")
def timestamp_rescale(spark, d):
    one = F.lit(1).cast("long")
    return _frames(spark, d).select("event_id", tm.rescale(F.col("frame"), F.col("den"), F.col("num"), one, F.lit(90000).cast("long")).alias("pts"))


@plans.query("frame_start_ns", f"WITH {_FRAMES} SELECT event_id, CAST((2 * CAST(frame AS HUGEINT) * den * {NS} + num) // (2 * num) AS BIGINT) AS ns FROM f")
def frame_start_ns(spark, d):
    return _frames(spark, d).select("event_id", tm.frame_start_ns(F.col("frame"), F.col("num"), F.col("den")).alias("ns"))


@plans.query("beat_snap", f"SELECT event_id, CAST((2 * CAST(event_id AS HUGEINT) * 60 * {NS}::HUGEINT + 2 * 174) // (2 * 2 * 174) AS BIGINT) AS beat_ns, CAST((2 * CAST(epoch_us(ts) % {DAY_US} * 1000 AS HUGEINT) * 174 * 4 + 60 * {NS}::HUGEINT) // (2 * CAST(60 AS HUGEINT) * {NS}) AS BIGINT) AS snapped FROM events")
def beat_snap(spark, d):
    e = media.table(spark, d, "events").withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) % DAY_US * 1000)
    num, den = F.lit(174).cast("long"), F.lit(1).cast("long")
    return e.select("event_id", tm.beat_to_ns(F.col("event_id"), F.lit(2).cast("long"), num, den).alias("beat_ns"), tm.ns_to_beat(F.col("ns"), num, den, 4).alias("snapped"))


@plans.query("rational_arithmetic", "WITH p AS (SELECT p_partkey, p_size - 25 AS n, p_partkey % 12 - 6 AS d FROM part), q AS (SELECT *, CASE WHEN d <> 0 THEN gcd(abs(n), abs(d)) END AS g FROM p) SELECT p_partkey, CASE WHEN d <> 0 THEN CAST(CASE WHEN d < 0 THEN -n ELSE n END // g AS BIGINT) END AS num, CASE WHEN d <> 0 THEN CAST(abs(d) // g AS BIGINT) END AS den, CASE WHEN d <> 0 THEN CAST(sign(CASE WHEN d < 0 THEN -n ELSE n END * 2 - abs(d)) AS INTEGER) END AS against_half FROM q")
def rational_arithmetic(spark, d):
    p = media.table(spark, d, "part").select("p_partkey", (F.col("p_size") - 25).cast("long").alias("n"), (F.col("p_partkey") % 12 - 6).alias("d"))
    r = p.withColumn("r", tm.reduce_ratio(F.col("n"), F.col("d")))
    return r.select("p_partkey", "r.num", "r.den", tm.compare_ratios(F.col("r.num"), F.col("r.den"), F.lit(1), F.lit(2)).alias("against_half"))


# ---- derived timelines -----------------------------------------------------------------------------------------------


@plans.query("active_tracks_solo", f"WITH {TRACKS}, s AS (SELECT *, max(CAST(solo AS INTEGER)) OVER (PARTITION BY timeline_id, kind) AS any_solo FROM tracks) SELECT timeline_id, track_id, kind FROM s WHERE enabled AND NOT mute AND (any_solo = 0 OR solo)")
def active_tracks_solo(spark, d):
    return select.active_tracks(media.tracks(spark, d)).select("timeline_id", "track_id", "kind")


@plans.query("clip_footprint", f"WITH {CLIPS} SELECT clip_id, footprint_ns, end_ns FROM spans")
def clip_footprint(spark, d):
    return tl.with_footprint(media.clips(spark, d)).select("clip_id", "footprint_ns", "end_ns")


_OVERLAP = "SELECT a.track_id, a.clip_id AS first, b.clip_id AS second FROM spans a JOIN spans b ON a.track_id = b.track_id AND a.footprint_ns >= 0 AND b.footprint_ns >= 0 AND b.offset_ns < a.end_ns AND (a.offset_ns < b.offset_ns OR (a.offset_ns = b.offset_ns AND a.pos < b.pos))"


@plans.query("clip_overlap", f"WITH {CLIPS} {_OVERLAP}")
def clip_overlap(spark, d):
    return tl.overlaps(media.clips(spark, d))


@plans.query(
    "validate_report",
    f"""WITH {CLIPS}, {TRACKS}, o AS (SELECT s.*, t.kind, row_number() OVER (PARTITION BY track_id ORDER BY pos, clip_id) = 1 AS is_first FROM spans s LEFT JOIN tracks t USING (track_id)), ov AS ({_OVERLAP})
SELECT 'trim_out_before_in' AS rule, track_id, clip_id FROM o WHERE out_ns < in_ns UNION ALL SELECT 'empty_footprint', track_id, clip_id FROM o WHERE out_ns = in_ns
UNION ALL SELECT 'generated_clip_without_out_point', track_id, clip_id FROM o WHERE source_kind <> 'file' AND out_ns IS NULL UNION ALL SELECT 'clip_cannot_serve_track', track_id, clip_id FROM o WHERE source_kind <> 'file' AND kind = 'audio'
UNION ALL SELECT 'degenerate_speed', track_id, clip_id FROM o WHERE NOT (speed > 0 AND speed < 'inf'::DOUBLE) UNION ALL SELECT 'fade_longer_than_clip', track_id, clip_id FROM o WHERE greatest(fade_in_ns, fade_out_ns) > footprint_ns
UNION ALL SELECT 'dangling_transition', track_id, clip_id FROM o WHERE is_first AND transition_ns > 0 UNION ALL SELECT 'clip_overlap', track_id, second FROM ov
UNION ALL SELECT 'degenerate_frame_rate', NULL, NULL FROM customer WHERE NOT (c_nationkey - 2 > 0 AND c_custkey % 50 > 0)""",
)
def validate_report(spark, d):
    timelines = media.table(spark, d, "customer").select(F.col("c_custkey").alias("timeline_id"), (F.col("c_nationkey") - 2).alias("fps_num"), (F.col("c_custkey") % 50).alias("fps_den"))
    tasks = media.tasks(spark, d)
    return tl.validate(media.clips(spark, d, tasks), media.tracks(spark, d), timelines, tasks)


@plans.query(
    "transition_clamp",
    f"""WITH {CLIPS}, h AS (SELECT *, CASE WHEN source_kind <> 'file' THEN 4611686018427387904 WHEN out_ns IS NULL THEN 0 ELSE greatest(0, CAST(floor((source_ns - out_ns) / greatest(speed, 0.01)) AS BIGINT)) END AS handle FROM clips)
SELECT clip_id, CASE WHEN lag(clip_id) OVER w IS NULL THEN 0 ELSE least(transition_ns, lag(handle) OVER w) END AS transition_ns FROM h WINDOW w AS (PARTITION BY track_id ORDER BY pos, clip_id)""",
)
def transition_clamp(spark, d):
    return tl.clamp_transitions(media.clips(spark, d)).select("clip_id", "transition_ns")


@plans.query(
    "composition_end",
    f"""WITH {CLIPS}, {TRACKS}, v AS (SELECT *, max(CAST(solo AS INTEGER)) OVER (PARTITION BY timeline_id) AS any_solo FROM tracks WHERE kind = 'video'),
act AS (SELECT timeline_id, track_id FROM v WHERE enabled AND NOT mute AND (any_solo = 0 OR solo)),
e AS (SELECT timeline_id, round(offset_ns / 1e9 * 30.0) + ceil((out_ns - in_ns) / 1e9 / greatest(speed, 0.01) * 30.0) AS f FROM clips JOIN act USING (track_id)),
m AS (SELECT timeline_id, CASE WHEN count(*) = count(f) AND max(f) >= 1 THEN CAST(max(f) AS BIGINT) END AS frames FROM e GROUP BY timeline_id)
SELECT t.timeline_id, m.frames FROM (SELECT DISTINCT timeline_id FROM v) t LEFT JOIN m USING (timeline_id)""",
)
def composition_end(spark, d):
    return tl.composition_end(media.clips(spark, d), media.tracks(spark, d), 30)


@plans.query(
    "active_clip_at",
    f"WITH {CLIPS}, t AS (SELECT DISTINCT track_id, unnest([10, 40, 70]) * {NS}::BIGINT AS t FROM clips) SELECT t.track_id, t.t, arg_min(clip_id, pos) AS clip_id FROM t JOIN spans s ON s.track_id = t.track_id AND t.t >= s.offset_ns AND t.t < s.end_ns GROUP BY ALL",
)
def active_clip_at(spark, d):
    c = media.clips(spark, d)
    times = c.select("track_id").distinct().select("track_id", F.explode(F.array(*(F.lit(t * NS) for t in (10, 40, 70)))).alias("t"))
    return tl.active_clip(times, c)


@plans.query("concat_running_offset", f"WITH {CLIPS} SELECT clip_id, coalesce(sum(footprint_ns) OVER (PARTITION BY track_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM spans WHERE footprint_ns IS NOT NULL")
def concat_running_offset(spark, d):
    parts = tl.with_footprint(media.clips(spark, d)).filter("footprint_ns IS NOT NULL")
    return tl.running_offset(parts, ["track_id"], ["pos"], "footprint_ns").select("clip_id", F.col("start").cast("long").alias("start"))


@plans.query("distinct_sources", f"WITH {CLIPS} SELECT track_id, source_path, min(pos) AS first_pos FROM clips GROUP BY ALL")
def distinct_sources(spark, d):
    return media.clips(spark, d).groupBy("track_id", "source_path").agg(F.min("pos").alias("first_pos"))


@plans.query("source_uses", f"WITH {CLIPS} SELECT clip_id, track_id FROM clips WHERE source_path IN (SELECT 'part-' || p_partkey FROM part WHERE p_size = 7)")
def source_uses(spark, d):
    wanted = media.table(spark, d, "part").filter("p_size = 7").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("source_path"))
    return media.clips(spark, d).join(wanted, "source_path", "left_semi").select("clip_id", "track_id")


@plans.query("missing_sources", f"WITH {CLIPS} SELECT DISTINCT source_path FROM clips WHERE source_path NOT IN (SELECT 'part-' || p_partkey FROM part WHERE p_size <> 7)")
def missing_sources(spark, d):
    have = media.table(spark, d, "part").filter("p_size <> 7").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("source_path"))
    return media.clips(spark, d).select("source_path").distinct().join(have, "source_path", "left_anti")


# ---- edits -----------------------------------------------------------------------------------------------------------
# Each edits the first clip of the second-lowest track that has one in a group (a fixed, small choice by id), and gives
# the whole edited table.

_PICK = "pick AS (SELECT min(track_id) AS tid FROM clips WHERE group_id IS NOT NULL AND out_ns IS NOT NULL), one AS (SELECT * FROM clips WHERE group_id = (SELECT tid FROM pick) AND out_ns IS NOT NULL ORDER BY clip_id LIMIT 1)"
_COLS = "clip_id, track_id, group_id, in_ns, out_ns, offset_ns"


def _picked(c):
    return c.filter("group_id IS NOT NULL AND out_ns IS NOT NULL").orderBy("track_id", "clip_id").first()


def _edit(name: str, sql: str, f) -> None:
    def run(spark, d):
        c = media.clips(spark, d)
        return f(c, _picked(c)).select(*_COLS.split(", "))

    plans.query(name, f"WITH {CLIPS}, {_PICK} {sql}")(run)


_MEMBER = "(c.clip_id = o.clip_id OR coalesce(c.group_id = o.group_id, false))"
_edit("edit_remove_clip", f"SELECT {_COLS} FROM clips WHERE clip_id <> (SELECT clip_id FROM one)", lambda c, r: tl.remove_clip(c, r.clip_id))
_edit(
    "group_move",
    f"SELECT c.clip_id, c.track_id, c.group_id, c.in_ns, c.out_ns, CASE WHEN {_MEMBER} THEN greatest(0, c.offset_ns + 5000000000 - o.offset_ns) ELSE c.offset_ns END AS offset_ns FROM clips c, one o",
    lambda c, r: tl.move_clip(c, r.clip_id, 5 * NS),
)
_edit(
    "edit_move_to_frame",
    f"SELECT c.clip_id, c.track_id, c.group_id, c.in_ns, c.out_ns, CASE WHEN {_MEMBER} THEN greatest(0, c.offset_ns + 33366666667 - o.offset_ns) ELSE c.offset_ns END AS offset_ns FROM clips c, one o",
    lambda c, r: tl.move_clip_to_frame(c, r.clip_id, 1000, 30000, 1001),
)
_edit(
    "edit_move_to_beat",
    f"SELECT c.clip_id, c.track_id, c.group_id, c.in_ns, c.out_ns, CASE WHEN {_MEMBER} THEN greatest(0, c.offset_ns + 1206896552 - o.offset_ns) ELSE c.offset_ns END AS offset_ns FROM clips c, one o",
    lambda c, r: tl.move_clip_to_beat(c, r.clip_id, (7, 2), (174, 1)),
)
_edit("edit_ungroup", "SELECT clip_id, track_id, CASE WHEN group_id = (SELECT group_id FROM one) THEN NULL ELSE group_id END AS group_id, in_ns, out_ns, offset_ns FROM clips", lambda c, r: tl.ungroup_clips(c, r.clip_id))
_edit(
    "edit_group",
    "SELECT clip_id, track_id, CASE WHEN clip_id IN ((SELECT clip_id FROM one), (SELECT min(clip_id) FROM clips)) THEN (SELECT max(group_id) + 1 FROM clips) ELSE group_id END AS group_id, in_ns, out_ns, offset_ns FROM clips",
    lambda c, r: tl.group_clips(c, [r.clip_id, c.agg(F.min("clip_id")).first()[0]]),
)
_edit(
    "edit_move_to_track",
    f"SELECT c.clip_id, CASE WHEN c.clip_id = o.clip_id THEN 1 ELSE c.track_id END AS track_id, c.group_id, c.in_ns, c.out_ns, CASE WHEN {_MEMBER} THEN greatest(0, c.offset_ns + 3000000000 - o.offset_ns) ELSE c.offset_ns END AS offset_ns FROM clips c, one o",
    lambda c, r: tl.move_to_track(c, r.clip_id, 1, 3 * NS),
)
_TRIM = f"""t AS (SELECT c.*, o.clip_id AS oid, {_MEMBER} AS member, (o.in_ns + 500000000 - o.in_ns) / greatest(o.speed, 0.01) AS di, (o.out_ns - 250000000 - o.out_ns) / greatest(o.speed, 0.01) AS dq, o.in_ns + 500000000 AS ti, o.out_ns - 250000000 AS tq FROM clips c, one o),
n AS (SELECT *, greatest(0, in_ns + CAST(round(di * speed) AS BIGINT)) AS mi, out_ns + CAST(round(dq * speed) AS BIGINT) AS mq FROM t),
trimmed AS (SELECT clip_id, track_id, group_id, member, speed, offset_ns, in_ns AS old_in, out_ns AS old_out, CASE WHEN clip_id = oid THEN ti WHEN member THEN CASE WHEN out_ns IS NULL THEN mi ELSE least(mi, out_ns - 1) END ELSE in_ns END AS in_ns,
  CASE WHEN clip_id = oid THEN tq WHEN member THEN CASE WHEN out_ns IS NULL THEN mi + 1 - CASE WHEN out_ns IS NULL THEN 0 END ELSE greatest(mq, least(mi, out_ns - 1) + 1) END ELSE out_ns END AS out_ns FROM n)"""


def _trim(c, r):
    return tl.trim_clip(c, r.clip_id, r.in_ns + 500_000_000, r.out_ns - 250_000_000)


_KNOWN = _PICK.replace("FROM clips WHERE group_id = ", "FROM clips WHERE group_id = ")
_edit("trim_clip", f", {_TRIM} SELECT {_COLS} FROM trimmed WHERE old_out IS NOT NULL".lstrip(), _trim)
ORACLE["trim_clip"] = ORACLE["trim_clip"].replace(f"{_PICK} , t AS", f"{_PICK}, t AS")
_edit(
    "split_clip",
    f""", s AS (SELECT c.*, o.group_id AS og, o.offset_ns + CAST(floor(CAST(floor((o.out_ns - o.in_ns) / greatest(o.speed, 0.01)) AS BIGINT) / 2) AS BIGINT) AS cp, {_MEMBER} AS member FROM clips c, one o),
m AS (SELECT *, member AND coalesce(offset_ns < cp AND cp < offset_ns + CAST(floor((out_ns - in_ns) / greatest(speed, 0.01)) AS BIGINT), false) AS cut, in_ns + CAST(round((cp - offset_ns) * greatest(speed, 0.01)) AS BIGINT) AS point FROM s)
SELECT clip_id, track_id, group_id, in_ns, CASE WHEN cut THEN point ELSE out_ns END AS out_ns, offset_ns FROM m
UNION ALL SELECT (SELECT max(clip_id) FROM clips) + row_number() OVER (ORDER BY clip_id), track_id, (SELECT max(group_id) + 1 FROM clips), point, out_ns, cp FROM m WHERE cut""".lstrip(),
    lambda c, r: tl.split_clip(c, r.clip_id, r.offset_ns + int((r.out_ns - r.in_ns) / max(r.speed, 0.01)) // 2),
)
ORACLE["split_clip"] = ORACLE["split_clip"].replace(f"{_PICK} , s AS", f"{_PICK}, s AS")
_edit(
    "ripple_delete",
    f""", gone AS (SELECT c.track_id, c.offset_ns AS go, coalesce(c.footprint_ns, 0) AS gf FROM spans c, one o WHERE {_MEMBER}),
rest AS (SELECT c.* FROM clips c, one o WHERE NOT {_MEMBER})
SELECT r.clip_id, r.track_id, r.group_id, r.in_ns, r.out_ns, greatest(0, r.offset_ns - coalesce((SELECT sum(gf) FROM gone WHERE gone.track_id = r.track_id AND r.offset_ns > go), 0))::BIGINT AS offset_ns FROM rest r""".lstrip(),
    lambda c, r: tl.ripple_delete(c, r.clip_id),
)
ORACLE["ripple_delete"] = ORACLE["ripple_delete"].replace(f"{_PICK} , gone AS", f"{_PICK}, gone AS")
_edit(
    "ripple_trim",
    f""", {_TRIM}, k AS (SELECT * FROM trimmed WHERE old_out IS NOT NULL), ch AS (SELECT track_id, offset_ns AS go, CAST(floor((out_ns - in_ns) / greatest(speed, 0.01)) AS BIGINT) - CAST(floor((old_out - old_in) / greatest(speed, 0.01)) AS BIGINT) AS gf FROM k WHERE member)
SELECT clip_id, track_id, group_id, in_ns, out_ns, greatest(0, offset_ns + coalesce((SELECT sum(gf) FROM ch WHERE ch.track_id = k.track_id AND k.offset_ns > go), 0))::BIGINT AS offset_ns FROM k""".lstrip(),
    lambda c, r: tl.ripple_trim(c, r.clip_id, r.in_ns + 500_000_000, r.out_ns - 250_000_000),
)
ORACLE["ripple_trim"] = ORACLE["ripple_trim"].replace(f"{_PICK} , t AS", f"{_PICK}, t AS")
_WHOLE_TRIM = f"""d AS (SELECT c.*, o.clip_id AS oid, {_MEMBER} AS member, o.in_ns + 500000000 AS ti, o.out_ns - 250000000 AS tq, 500000000 / greatest(o.speed, 0.01) AS di, -250000000 / greatest(o.speed, 0.01) AS dq FROM clips c, one o),
e AS (SELECT *, greatest(0, in_ns + CAST(round(di * greatest(speed, 0.01)) AS BIGINT)) AS mi, CASE WHEN out_ns IS NOT NULL THEN greatest(0, out_ns + CAST(round(dq * greatest(speed, 0.01)) AS BIGINT)) END AS mq FROM d),
whole AS (SELECT clip_id, track_id, group_id, member, speed, offset_ns, in_ns AS old_in, out_ns AS old_out, CASE WHEN clip_id = oid THEN ti WHEN NOT member THEN in_ns WHEN mi > mq THEN mq ELSE mi END AS in_ns,
  CASE WHEN clip_id = oid THEN tq WHEN member THEN mq ELSE out_ns END AS out_ns FROM e)"""
_edit("trim_clip_whole", f", {_WHOLE_TRIM} SELECT {_COLS} FROM whole", lambda c, r: tl.trim_clip(c, r.clip_id, r.in_ns + 500_000_000, r.out_ns - 250_000_000))
_edit(
    "ripple_trim_whole",
    f""", {_WHOLE_TRIM}, ch AS (SELECT track_id, offset_ns AS go, CAST(floor((out_ns - in_ns) / greatest(speed, 0.01)) AS BIGINT) - CAST(floor((old_out - old_in) / greatest(speed, 0.01)) AS BIGINT) AS gf FROM whole WHERE member)
SELECT clip_id, track_id, group_id, in_ns, out_ns, greatest(0, offset_ns + coalesce((SELECT sum(gf) FROM ch WHERE ch.track_id = whole.track_id AND whole.offset_ns > go), 0))::BIGINT AS offset_ns FROM whole""",
    lambda c, r: tl.ripple_trim(c, r.clip_id, r.in_ns + 500_000_000, r.out_ns - 250_000_000),
)
for _name in ("trim_clip_whole", "ripple_trim_whole"):
    ORACLE[_name] = ORACLE[_name].replace(f"{_PICK} , d AS", f"{_PICK}, d AS")
_edit(
    "edit_batch",
    "SELECT clip_id, track_id, CASE WHEN group_id = (SELECT group_id FROM one) THEN NULL ELSE group_id END AS group_id, in_ns, out_ns, offset_ns FROM clips WHERE clip_id <> (SELECT min(clip_id) FROM clips)",
    # Ungrouped before the removal, as the clip that names the group may be the one that goes.
    lambda c, r: tl.batch(c, [lambda t: tl.ungroup_clips(t, r.clip_id), lambda t: tl.remove_clip(t, t.agg(F.min("clip_id")).first()[0])]),
)
# The first queries of these steps hold every clip too.
for _name in ("trim_clip", "ripple_trim"):
    ORACLE[_name] = ORACLE[f"{_name}_whole"]



@plans.query("edit_set_property", f"WITH {CLIPS} SELECT clip_id, CASE WHEN clip_id = (SELECT min(clip_id) FROM clips) THEN 100.0 ELSE speed END AS speed FROM clips")
def edit_set_property(spark, d):
    c = media.clips(spark, d)
    return tl.set_property(c, c.agg(F.min("clip_id")).first()[0], "speed", 250.0).select("clip_id", "speed")


@plans.query("edit_add_clip", f"WITH {CLIPS}, n AS (SELECT clip_id, track_id, group_id FROM clips UNION ALL SELECT (SELECT max(clip_id) + 1 FROM clips), track_id, NULL FROM clips WHERE clip_id = (SELECT min(clip_id) FROM clips)) SELECT * FROM n")
def edit_add_clip(spark, d):
    c = media.clips(spark, d)
    return tl.add_clip(c, c.filter(F.col("clip_id") == c.agg(F.min("clip_id")).first()[0])).select("clip_id", "track_id", "group_id")


@plans.query("edit_remove_track", f"WITH {TRACKS}, {CLIPS} SELECT 'track' AS kind, track_id AS id FROM tracks WHERE track_id <> 1 UNION ALL SELECT 'clip', clip_id FROM clips WHERE track_id <> 1")
def edit_remove_track(spark, d):
    t, c = tl.remove_track(media.tracks(spark, d), media.clips(spark, d), 1)
    return t.select(F.lit("track").alias("kind"), F.col("track_id").alias("id")).unionByName(c.select(F.lit("clip").alias("kind"), F.col("clip_id").alias("id")))


# ---- text ------------------------------------------------------------------------------------------------------------


@plans.query("subtitle_strip_html", "SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g'))::INTEGER AS n, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest FROM pages")
def subtitle_strip_html(spark, d):
    p = media.table(spark, d, "pages").select("page_id", ft.strip_html(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@plans.query("subtitle_timestamp_format", f"WITH {SAMPLES}, m AS (SELECT event_id, t_us // 1000 % 400000000 AS ms FROM samples) SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS clock, ms * 1000000 AS ns FROM m")
def subtitle_timestamp_format(spark, d):
    s = media.samples(spark, d).select("event_id", (F.floor(F.col("t_us") / 1000) % 400_000_000 * 1_000_000).alias("ns"))
    c = s.select("event_id", ft.ns_to_clock(F.col("ns")).alias("clock"))
    return c.select("event_id", "clock", ft.clock_to_ns(F.col("clock")).alias("ns"))


_TURNS = "turns AS (SELECT conv_id, turn, replace(replace(text, chr(10), ' '), chr(13), ' ') AS text FROM conversations WHERE trim(replace(replace(text, chr(10), ' '), chr(13), ' ')) <> '')"


@plans.query("subtitle_round_trip", f"WITH {_TURNS} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS \"index\", turn * 2000000000 AS start_ns, turn * 2000000000 + 1500000000 AS end_ns, md5(trim(regexp_replace(text, '<[^>]*>', '', 'g'))) AS digest FROM {{}}turns")
def subtitle_round_trip(spark, d):
    """Turns written as SRT files and parsed again."""
    text = F.regexp_replace("text", "[\n\r]", " ")
    t = media.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("index"), (F.col("turn") * 2 * NS).alias("start_ns"), (F.col("turn") * 2 * NS + 1_500_000_000).alias("end_ns"), text.alias("text"))
    files = subtitles.format_srt(t.filter(F.trim("text") != ""))
    return subtitles.parse_blocks(files).select(F.col("path").cast("long").alias("conv_id"), "index", "start_ns", "end_ns", F.md5(F.trim("text")).alias("digest"))


ORACLE["subtitle_round_trip"] = ORACLE["subtitle_round_trip"].replace("{}", "")


def _on_screen(spark, d):
    return media.table(spark, d, "conversations").filter(F.trim(F.regexp_replace("text", "[\n\r]", " ")) != "").select(F.col("conv_id").alias("track_id"), F.col("turn").alias("clip_id"), F.col("turn").alias("pos"), F.lit(0).cast("long").alias("in_ns"), F.lit(1_500_000_000).alias("out_ns"), (F.col("turn") * 2 * NS).alias("offset_ns"), F.lit(1.0).alias("speed"))


def _frames_met(e, grid):
    """The events on screen at each second from 0 to the conversation's ``last``."""
    times = grid.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))).alias("t")).withColumn("t", F.col("t") * NS)
    return tl.active_clip(times, e).select(F.col("track_id").alias("conv_id"), "t", F.col("clip_id").alias("turn"))


@plans.query(
    "subtitle_interval_join",
    f"WITH {_TURNS}, t AS (SELECT conv_id, unnest(range(0, max(turn) * 2 + 2)) * 1000000000::BIGINT AS t FROM turns GROUP BY conv_id) SELECT DISTINCT t.conv_id, t.t, turn FROM t JOIN turns ON turns.conv_id = t.conv_id AND t.t >= turn * 2000000000 AND t.t < turn * 2000000000 + 1500000000",
)
def subtitle_interval_join(spark, d):
    """Frames (one a second, from 0 to the end of the conversation's last event) with the events on screen."""
    e = _on_screen(spark, d)
    return _frames_met(e, e.groupBy("track_id").agg(F.floor((F.max(F.col("offset_ns") + F.col("out_ns")) - 1) / NS).alias("last")))


plans.query("subtitle_interval_join_whole", ORACLE["subtitle_interval_join"])(subtitle_interval_join)


@plans.query("file_extension", "SELECT page_id, CASE WHEN regexp_matches(regexp_extract(url, '([^/\\\\]*)$', 1), '[^.]\\.[^.]+$') THEN lower(regexp_extract(regexp_extract(url, '([^/\\\\]*)$', 1), '[^.]\\.([^.]+)$', 1)) END AS ext FROM pages")
def file_extension(spark, d):
    return media.table(spark, d, "pages").select("page_id", ft.extension(F.col("url")).alias("ext"))


# ---- segments, streams -----------------------------------------------------------------------------------------------

_WEEK = 7 * DAY_US


@plans.query("hls_segments", f'WITH {SAMPLES} SELECT stream_id, t_us // {_WEEK} AS segment, min(t_us) AS start, max(t_us) AS "end", count(*) AS n FROM samples GROUP BY ALL')
def hls_segments(spark, d):
    s = media.samples(spark, d)
    return segments.playlist(segments.fixed_segments(s, ["stream_id"], "t_us", _WEEK), ["stream_id"], "t_us")


@plans.query("playlist_tail", f'WITH {SAMPLES}, p AS (SELECT stream_id, t_us // {_WEEK} AS segment, min(t_us) AS start, max(t_us) AS "end", count(*) AS n FROM samples GROUP BY ALL) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY segment DESC) <= 3')
def playlist_tail(spark, d):
    s = media.samples(spark, d)
    return segments.playlist(segments.fixed_segments(s, ["stream_id"], "t_us", _WEEK), ["stream_id"], "t_us", 3)


@plans.query(
    "keyframe_aligned_segments",
    f"""WITH {SAMPLES}, b AS (SELECT *, coalesce(max(CASE WHEN event_type = 'click' THEN t_us // {_WEEK} END) OVER (PARTITION BY stream_id ORDER BY t_us ROWS UNBOUNDED PRECEDING), -1) AS b FROM samples),
s AS (SELECT *, dense_rank() OVER (PARTITION BY stream_id ORDER BY b) - 1 AS segment FROM b) SELECT stream_id, segment, min(t_us) AS start, max(t_us) AS "end", count(*) AS n FROM s GROUP BY stream_id, segment""",
)
def keyframe_aligned_segments(spark, d):
    s = media.samples(spark, d).withColumn("is_key", F.col("event_type") == "click")
    return segments.playlist(segments.keyframe_segments(s, ["stream_id"], "t_us", "is_key", _WEEK), ["stream_id"], "t_us")


@plans.query("abr_ladder", "WITH p AS (SELECT p_partkey, p_size * 40 AS height, p_size * 64 AS width FROM part) SELECT p_partkey, place, out_height, bitrate, CAST(round(width * out_height / height / 2) * 2 AS INTEGER) AS out_width FROM p, (VALUES (0, 1080, 5000000), (1, 720, 2800000), (2, 480, 1400000), (3, 360, 800000)) AS r(place, out_height, bitrate) WHERE out_height <= height")
def abr_ladder(spark, d):
    p = media.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("height"), (F.col("p_size") * 64).alias("width"))
    return segments.ladder(p).select("p_partkey", "place", "out_height", "bitrate", "out_width")


@plans.query(
    "late_drop",
    f"WITH {SAMPLES}, v AS (SELECT stream_id, event_id AS seq, t_us - event_id % 5 * {DAY_US} AS t FROM samples), c AS (SELECT stream_id, event_id AS seq, max(t_us) OVER (PARTITION BY stream_id ORDER BY event_id) AS clock FROM samples) SELECT stream_id, seq, t FROM v JOIN c USING (stream_id, seq) WHERE t - clock >= -{2 * DAY_US}",
)
def late_drop(spark, d):
    s = media.samples(spark, d).withColumnRenamed("event_id", "seq")
    clock = s.select("stream_id", "seq", F.expr("max(t_us) OVER (PARTITION BY stream_id ORDER BY seq)").alias("clock"))
    frames = s.select("stream_id", "seq", (F.col("t_us") - F.col("seq") % 5 * DAY_US).alias("t"))
    return segments.drop_late(frames, clock, ["stream_id"], "t", 2 * DAY_US).select("stream_id", "seq", "t")


@plans.query(
    "concat_parts",
    f"WITH {SAMPLES}, r AS (SELECT stream_id % 4 AS part, event_id, t_us - min(t_us) OVER (PARTITION BY stream_id % 4) AS t FROM samples), e AS (SELECT part, max(t) + 1000 AS len FROM r GROUP BY part), o AS (SELECT part, coalesce(sum(len) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e) SELECT part, event_id, CAST(t + s AS BIGINT) AS t FROM r JOIN o USING (part)",
)
def concat_parts(spark, d):
    s = media.samples(spark, d).select((F.col("stream_id") % 4).alias("part"), "event_id", "t_us")
    r = select.rebase(s, "t_us", ["part"]).withColumnRenamed("t_us", "t").withColumn("length", F.lit(1000).cast("long"))
    return segments.concat(r, "part", "t", "length").select("part", "event_id", F.col("t").cast("long").alias("t"))


@plans.query("freeze_frame", f"WITH {SAMPLES}, n AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t_us) - 1 AS t FROM samples) SELECT stream_id, t + CASE WHEN t > 5 THEN 3 ELSE 0 END AS t FROM n UNION ALL SELECT stream_id, t + i FROM n, range(1, 4) x(i) WHERE t = 5")
def freeze_frame(spark, d):
    n = media.samples(spark, d).select("stream_id", F.expr("row_number() OVER (PARTITION BY stream_id ORDER BY t_us) - 1").cast("long").alias("t"))
    return segments.freeze(n, "t", 5, 3, 1)


@plans.query("ticker_position", f"WITH {SAMPLES} SELECT event_id, round(1920 - (t_us % {DAY_US}) / 1e6 * 0.25, 9) AS x FROM samples")
def ticker_position(spark, d):
    return media.samples(spark, d).select("event_id", F.round(1920 - (F.col("t_us") % DAY_US) / 1e6 * 0.25, 9).alias("x"))


@plans.query("stream_catalogue", f"WITH {TRACKS} SELECT timeline_id, kind, min(track_id) AS track_id FROM tracks GROUP BY timeline_id, kind")
def stream_catalogue(spark, d):
    t = media.tracks(spark, d).select(F.col("timeline_id").alias("path"), "kind", F.col("track_id").alias("stream_index"))
    return sd.primary_streams(t).select(F.col("path").alias("timeline_id"), "kind", F.col("stream_index").alias("track_id"))


_LATE_US = 1_000_000  # how late the live operators let rows be


def _streamed(spark, d, build, mode="append", columns=(), sink="append", key=None):
    """Runs a streaming query over the events, read as a stream of a file a batch, to its end; gives the table it wrote.
    Sinks: what is appended; the latest row of each ``key``; the whole of the last batch; two targets."""
    schema = T.StructType([f for f in media.table(spark, d, "events").schema.fields])
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    events = events.select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", *columns)
    out = build(events).writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if sink == "append":
        out = out.format("parquet").option("path", f"{folder}/out")
    else:
        names = ["a", "b"] if sink == "fan_out" else ["a"]
        out = out.foreachBatch(live.fan_out(live.to_folders(f"{folder}/out", names)))
    out.start().awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    if sink == "whole":
        return got.filter(F.col("batch") == got.agg(F.max("batch")).first()[0])
    if sink == "latest":
        return got.groupBy(key).agg(F.max_by(F.struct(*(c for c in got.columns if c != key)), "batch").alias("s")).select(key, "s.*")
    return got


@plans.query("stream_segments", f"WITH {SAMPLES}, w AS (SELECT stream_id, t_us // {DAY_US} AS day, count(*) AS n FROM samples GROUP BY ALL) SELECT stream_id, day, n FROM w WHERE (day + 1) * {DAY_US} <= (SELECT max(t_us) - 1000000 FROM samples)")
def stream_segments(spark, d):
    """Live tumbling segments: what the watermark has passed when the input ends."""
    out = _streamed(spark, d, lambda e: live.live_segments(e, ["stream_id"], "ts", "1 day").select("stream_id", F.col("w.start").alias("s"), "n"))
    return out.select("stream_id", F.floor(F.unix_micros("s") / DAY_US).alias("day"), "n")


@plans.query(
    "stream_sessions",
    f"""WITH {SAMPLES}, m AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w < {DAY_US} THEN 0 ELSE 1 END AS opens FROM samples WINDOW w AS (PARTITION BY stream_id ORDER BY t_us)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY stream_id ORDER BY t_us) AS session FROM m), s AS (SELECT stream_id, min(t_us) AS start, max(t_us) AS last, count(*) AS n FROM n GROUP BY stream_id, session)
SELECT stream_id, start, n FROM s WHERE last + {DAY_US} <= (SELECT max(t_us) // 1000 * 1000 - {_LATE_US} FROM samples)""",
)
def stream_sessions(spark, d):
    """Live sessions by a gap of a day: those that the watermark has passed when the input ends."""
    out = _streamed(spark, d, lambda e: live.activity(e, ["stream_id"], "ts", "24 hours").select("stream_id", F.col("w.start").alias("start"), "n"))
    return out.select("stream_id", F.unix_micros("start").alias("start"), "n")
