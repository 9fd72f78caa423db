"""Timeline documents as tables: derived placements, validation, and edits as pure functions from tables to tables.

Clips: track_id, clip_id, pos, group_id, source_kind, source_path, in_ns, out_ns, offset_ns, speed (see FIXTURES.md).
Unknown values are null and stay unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..folders import settle
from . import select

NS = 1_000_000_000


def footprint(out: str = "out_ns", start: str = "in_ns", speed: str = "speed") -> Column:
    """Time that a clip takes on its track; unknown without both points."""
    return F.floor((F.col(out) - F.col(start)) / F.greatest(F.col(speed), F.lit(0.01))).cast("long")


def with_footprint(clips: DataFrame) -> DataFrame:
    return clips.withColumn("footprint_ns", footprint()).withColumn("end_ns", F.col("offset_ns") + F.col("footprint_ns"))


def running_offset(parts: DataFrame, by: list[str], order: list, length: str) -> DataFrame:
    """Start of each part when all follow each other."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0)))


def overlaps(clips: DataFrame, width: int = 60 * NS) -> DataFrame:
    """(track_id, first, second): pairs of clips of one track of which the later starts inside the earlier's half-open
    footprint; an empty footprint contains nothing but may lie inside another. Clips of unknown footprint take no part,
    ties in start go by list order. A running maximum finds the clips that can overlap anything, so tracks without
    overlaps cost one sort; the rest meet by (track, time bucket), the later clip's start in the earlier one's span."""
    known = with_footprint(clips).filter("footprint_ns >= 0").select("track_id", "clip_id", "pos", F.col("offset_ns").alias("s"), F.col("end_ns").alias("e"))
    before = Window.partitionBy("track_id").orderBy("s", "pos", "clip_id").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("track_id").orderBy("s", "pos", "clip_id")
    marked = known.withColumns({"_reach": F.max("e").over(before), "_next": F.lead("s").over(after)})
    late, early = marked.filter("_reach > s"), marked.filter("_next < e AND s < e")
    a = early.select("track_id", *(F.col(c).alias(f"a_{c}") for c in ("clip_id", "pos", "s", "e")), F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))).alias("bucket"))
    pair = a.join(late.withColumn("bucket", F.floor(F.col("s") / width)), ["track_id", "bucket"]).filter("s < a_e AND (a_s < s OR (a_s = s AND (a_pos < pos OR (a_pos = pos AND a_clip_id < clip_id))))")
    return pair.select("track_id", F.col("a_clip_id").alias("first"), F.col("clip_id").alias("second"))


def composition_end(clips: DataFrame, tracks: DataFrame, fps_num: int, fps_den: int = 1) -> DataFrame:
    """(timeline_id, frames) of each timeline with a video track: frames until the last clip of its active video tracks
    ends, each clip's lead-in rounded to frames and its content rounded up. Null without a whole frame, and if any of
    these clips' ends is unknown."""
    rate = fps_num / fps_den
    if not 0 < rate < float("inf"):
        raise ValueError(f"a frame rate must be positive, not {fps_num}/{fps_den}")
    video = tracks.filter("kind = 'video'")
    on = select.active_tracks(video).select("timeline_id", "track_id").join(clips, "track_id")
    end = F.round(F.col("offset_ns") / NS * rate) + F.ceil((F.col("out_ns") - F.col("in_ns")) / NS / F.greatest(F.col("speed"), F.lit(0.01)) * rate)
    last = F.when((F.count_if(end.isNull()) == 0) & (F.max(end) >= 1), F.max(end).cast("long"))
    ends = on.groupBy("timeline_id").agg(last.alias("frames"))
    return video.select("timeline_id").distinct().join(ends, "timeline_id", "left")


def total_frames(clips: DataFrame, tracks: DataFrame, fps_num: int, fps_den: int = 1) -> DataFrame:
    """(timeline_id, frames): the lengths of all clips on video tracks, added up, times the rate, to the nearest frame;
    null if a clip has no out-point."""
    length = F.col("out_ns") - F.col("in_ns")
    every = tracks.filter("kind = 'video'").select("timeline_id", "track_id").join(clips.select("track_id", "clip_id", length.alias("_l")), "track_id", "left")
    known = F.count("clip_id") == F.count("_l")
    frames = F.round(F.coalesce(F.sum("_l"), F.lit(0)) / NS * (fps_num / fps_den)).cast("long")
    return every.groupBy("timeline_id").agg(F.when(known, F.greatest(F.lit(0).cast("long"), frames)).alias("frames"))


def clamp_transitions(clips: DataFrame, source_len: str = "source_ns") -> DataFrame:
    """Each transition's length held to the outgoing clip's handle: what its source still has after the out-point, in
    timeline time. Generated sources have no end; without an out-point the handle is empty; a first clip has none."""
    w = Window.partitionBy("track_id").orderBy("pos", "clip_id")
    handle = F.when(F.col("source_kind") != "file", F.lit((1 << 62))).when(F.col("out_ns").isNull(), 0).otherwise(F.greatest(F.lit(0), F.floor((F.col(source_len) - F.col("out_ns")) / F.greatest(F.col("speed"), F.lit(0.01)))))
    return clips.withColumn("_h", handle.cast("long")).withColumn("transition_ns", F.coalesce(F.least(F.col("transition_ns"), F.coalesce(F.lag("_h").over(w), F.lit(0).cast("long"))), F.lit(0))).drop("_h")


def active_clip(times: DataFrame, clips: DataFrame, width: int = 60 * NS) -> DataFrame:
    """``times`` (track_id, t) with the first clip in list order that is on at t. An interval join by time buckets."""
    spans = with_footprint(clips).filter("footprint_ns > 0").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("offset_ns") / width), F.floor((F.col("end_ns") - 1) / width))))
    hit = times.withColumn("bucket", F.floor(F.col("t") / width)).join(spans, ["track_id", "bucket"]).filter("t >= offset_ns AND t < end_ns")
    return hit.groupBy("track_id", "t").agg(F.min_by("clip_id", F.struct("pos", "clip_id")).alias("clip_id"))


def validate(clips: DataFrame, tracks: DataFrame, timelines: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(rule, track_id, clip_id) of everything wrong; never raises. A clip is given once for each earlier clip that it
    overlaps (as in ``overlaps``). With ``timelines`` (timeline_id, fps_num, fps_den) also (degenerate_frame_rate, null,
    null), once for each timeline whose rate is not a positive number.

    Starts and ends of clips and the tracks share one shuffle and one sort: the clips that are on when another starts are
    those that started before less those that have ended, so overlaps are counted without their pairs. ``tasks``: over how
    many the tracks are dealt (default: Spark's choice)."""
    generated = F.col("source_kind") != "file"
    rules = {
        "trim_out_before_in": F.col("out_ns") < F.col("in_ns"),
        "empty_footprint": F.col("out_ns") == F.col("in_ns"),
        "generated_clip_without_out_point": generated & F.col("out_ns").isNull(),
        "degenerate_speed": (F.col("speed") <= 0) | F.isnan("speed") | (F.col("speed") == float("inf")),
        "fade_longer_than_clip": (F.col("fade_in_ns") > footprint()) | (F.col("fade_out_ns") > footprint()),
        "clip_cannot_serve_track": generated,
        "dangling_transition": F.col("transition_ns") > 0,
    }
    bit = {k: 1 << i for i, k in enumerate([*rules, "known", "holds"])}
    has = lambda k: F.col("_bits").bitwiseAND(bit[k]) != 0
    known = (F.col("footprint_ns") >= 0) & F.col("offset_ns").isNotNull() & F.col("track_id").isNotNull()
    flags = rules | {"known": known, "holds": known & (F.col("footprint_ns") > 0)}
    on = with_footprint(clips).withColumn("_bits", sum((F.when(c, bit[k]).otherwise(0) for k, c in flags.items()), F.lit(0)))
    # What happens on a track, in order: ends (0) before starts (1), as footprints are half-open; its own rows (2) have no time.
    start = F.col("_what") == 1
    on = on.withColumn("_what", F.explode(F.when(has("holds"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    on = on.select("track_id", F.when(start, F.col("offset_ns")).otherwise(F.col("end_ns")).alias("_at"), "_what", *(F.when(start, F.col(c)).alias(c) for c in ("pos", "clip_id", "_bits")))
    own = tracks.filter("track_id IS NOT NULL").select("track_id", F.lit(2).alias("_what"), F.when(F.col("kind") == "audio", 1).otherwise(0).alias("_bits"))
    every = on.unionByName(own, allowMissingColumns=True)
    every = every.repartition(tasks, "track_id") if tasks else every
    order = Window.partitionBy("track_id").orderBy("_at", "_what", "pos", "clip_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct("pos", "clip_id")
    met = every.withColumns(
        {
            "_on": F.sum(F.when(F.col("_what") == 0, -1).when(start & has("holds"), 1)).over(order.rowsBetween(Window.unboundedPreceding, -1)),
            "_first": F.min(F.when(start, place)).over(whole),
            "_tracks": F.count_if(F.col("_what") == 2).over(whole),
            "_audio": F.count_if((F.col("_what") == 2) & (F.col("_bits") == 1)).over(whole),
        }
    )
    # A track that is listed twice has its clips' own faults twice, as by a join.
    times = dict.fromkeys(rules, F.greatest("_tracks", F.lit(1))) | {"clip_cannot_serve_track": F.col("_audio"), "dangling_transition": F.when(place.eqNullSafe(F.col("_first")), 1).otherwise(0)}
    times = {k: F.when(has(k), n).otherwise(0) for k, n in times.items()}
    times["clip_overlap"] = F.when(has("known"), F.coalesce("_on", F.lit(0))).otherwise(0)
    found = F.flatten(F.array(*(F.array_repeat(F.lit(k), n.cast("int")) for k, n in times.items())))
    found = met.filter(start).select(F.explode(found).alias("rule"), "track_id", "clip_id")
    if timelines is None:
        return found
    sound = F.coalesce(F.col("fps_num") * F.signum("fps_den") > 0, F.lit(False))
    bad = timelines.filter(~sound).select(F.lit("degenerate_frame_rate").alias("rule"), F.lit(None).cast("long").alias("track_id"), F.lit(None).cast("long").alias("clip_id"))
    return found.unionByName(bad)


# ---- edits -----------------------------------------------------------------------------------------------------------


class EditError(ValueError):
    """An edit that the timeline rejects."""


def locked(clips: DataFrame, tracks: DataFrame, ids: list[int]) -> bool:
    """Whether any of the clips is on a locked track."""
    return bool(clips.filter(F.col("clip_id").isin(ids)).join(tracks.filter("lock"), "track_id", "left_semi").take(1))


#: Edits that carry to the rest of a clip's group, and edits that stop at the clip they name.
GROUP_EDITS = {"move", "move_to_beat", "move_to_frame", "move_to_track", "trim", "ripple_trim", "split", "ripple_delete", "ungroup"}
CLIP_EDITS = {"remove", "set_property", "set", "add_effect", "remove_effect", "set_effect_kind", "set_effect_enabled", "reorder_effects", "group"}


def lock_targets(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """(clip_id, clip_lock, group_lock): the locked track that an edit of the clip alone would change, and the first one
    that an edit carried to its group would; null where the edit is free."""
    held = clips.join(tracks.filter("lock").select("track_id", F.lit(True).alias("_locked")), "track_id", "left").withColumn("clip_lock", F.when(F.col("_locked"), F.col("track_id")))
    groups = held.filter("group_id IS NOT NULL AND clip_lock IS NOT NULL").groupBy("group_id").agg(F.min("clip_lock").alias("group_lock"))
    # Clips without a group would all meet in one task: each is dealt by its own id, and the flag keeps them from any group.
    alone = F.col("group_id").isNull()
    held = held.withColumns({"_dealt": F.coalesce("group_id", "clip_id"), "_alone": alone})
    groups = groups.withColumnsRenamed({"group_id": "_dealt"}).withColumn("_alone", F.lit(False))
    return held.join(groups, ["_dealt", "_alone"], "left").select("clip_id", "clip_lock", F.when(alone, F.col("clip_lock")).otherwise(F.col("group_lock")).alias("group_lock"))


def refuse_locked(clips: DataFrame, tracks: DataFrame, edit: str, *, clip_ids: list[int] = (), track_ids: list[int] = ()) -> None:
    """Raises EditError if the edit would change a locked track: that of a clip it names, of the clip's group where the
    edit carries to it, or a track it names. Markers, canvas, rate, new tracks and the lock itself are always free."""
    if track_ids:
        held = tracks.filter(F.col("lock") & F.col("track_id").isin(list(track_ids))).select("track_id").take(1)
        if held:
            raise EditError(f"track {held[0][0]} is locked")
    if not clip_ids:
        return
    if edit not in GROUP_EDITS | CLIP_EDITS:
        raise ValueError(f"unknown edit {edit!r}")
    named = clips.filter(F.col("clip_id").isin(list(clip_ids)))
    if edit in GROUP_EDITS:
        named = named.select("track_id").union(clips.join(named.filter("group_id IS NOT NULL").select("group_id").distinct(), "group_id", "left_semi").select("track_id"))
    held = tracks.filter("lock").join(named.select("track_id").distinct(), "track_id", "left_semi").select("track_id").take(1)
    if held:
        raise EditError(f"track {held[0][0]} is locked")


def guarded(clips: DataFrame, tracks: DataFrame, edit: str, change, *, clip_ids: list[int] = (), track_ids: list[int] = ()) -> DataFrame:
    """``change`` of the clips, unless a lock refuses it."""
    refuse_locked(clips, tracks, edit, clip_ids=clip_ids, track_ids=track_ids)
    return change(clips)


def _one(clips: DataFrame, clip_id: int):
    rows = clips.filter(F.col("clip_id") == clip_id).take(1)
    if not rows:
        raise EditError(f"no clip {clip_id}")
    return rows[0]


def _members(row) -> Column:
    """The clip itself and its group's clips."""
    own = F.col("clip_id") == row.clip_id
    return own if row.group_id is None else own | (F.col("group_id") == row.group_id)


def next_id(table: DataFrame, column: str) -> int:
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def add_clip(clips: DataFrame, clip: DataFrame) -> DataFrame:
    """A row appended under a fresh id, without a group."""
    return clips.unionByName(clip.withColumns({"clip_id": F.lit(next_id(clips, "clip_id")).cast("long"), "group_id": F.lit(None).cast("long")}))


def remove_clip(clips: DataFrame, clip_id: int) -> DataFrame:
    _one(clips, clip_id)
    return clips.filter(F.col("clip_id") != clip_id)


def move_clip(clips: DataFrame, clip_id: int, offset_ns: int) -> DataFrame:
    """Group members move by the same delta, not before 0."""
    row = _one(clips, clip_id)
    return clips.withColumn("offset_ns", F.when(_members(row), F.greatest(F.lit(0), F.col("offset_ns") + (offset_ns - row.offset_ns))).otherwise(F.col("offset_ns")).cast("long"))


def move_clip_to_frame(clips: DataFrame, clip_id: int, frame: int, fps_num: int, fps_den: int = 1) -> DataFrame:
    return move_clip(clips, clip_id, (frame * fps_den * NS * 2 + fps_num) // (2 * fps_num))


def move_clip_to_beat(clips: DataFrame, clip_id: int, beat: tuple[int, int], bpm: tuple[int, int] | None) -> DataFrame:
    if bpm is None:
        raise EditError("the timeline has no tempo")
    n, d = beat[0] * 60 * bpm[1] * NS, beat[1] * bpm[0]
    return move_clip(clips, clip_id, (2 * n + d) // (2 * d))


def trim_clip(clips: DataFrame, clip_id: int, in_ns: int, out_ns: int, row=None) -> DataFrame:
    """Members' points move by the same timeline time at their own speed, not before 0. A point that the trim doesn't move
    stays as it is, an unset out-point stays unset, and an in-point beyond the out-point is pulled back to it.
    ``row``: the clip, where it has been read already."""
    if out_ns <= in_ns:
        raise EditError("out before in")
    row = row or _one(clips, clip_id)
    speed = max(row.speed, 0.01)
    din, dout = (in_ns - (row.in_ns or 0)) / speed, 0 if row.out_ns is None else (out_ns - row.out_ns) / speed
    own, member, rate = F.col("clip_id") == clip_id, _members(row), F.greatest(F.col("speed"), F.lit(0.01))

    def moved(edge, by):
        return F.when(edge.isNotNull(), F.greatest(F.lit(0), edge + F.round(by * rate)).cast("long"))

    new_in = moved(F.coalesce("in_ns", F.lit(0)), din) if din else F.col("in_ns")
    new_out = moved(F.col("out_ns"), dout) if dout else F.col("out_ns")
    new_in = F.when(new_in > new_out, new_out).otherwise(new_in)
    in_col = F.when(own, in_ns).when(member, new_in).otherwise(F.col("in_ns")).cast("long")
    out_col = F.when(own, out_ns).when(member, new_out).otherwise(F.col("out_ns")).cast("long")
    return clips.withColumns({"in_ns": in_col, "out_ns": out_col})


RANGES = {"opacity": (0.0, 1.0), "speed": (0.01, 100.0), "volume_db": (-60.0, 24.0), "pan": (-1.0, 1.0)}


def set_property(clips: DataFrame, clip_id: int, name: str, value) -> DataFrame:
    _one(clips, clip_id)
    if name in RANGES:
        value = min(RANGES[name][1], max(RANGES[name][0], value))
    return clips.withColumn(name, F.when(F.col("clip_id") == clip_id, F.lit(value)).otherwise(F.col(name)).cast(clips.schema[name].dataType))


def set_clip(clips: DataFrame, clip: DataFrame, clip_id: int) -> DataFrame:
    return remove_clip(clips, clip_id).unionByName(clip.withColumn("clip_id", F.lit(clip_id).cast("long")))


def split_clip(clips: DataFrame, clip_id: int, at_ns: int) -> DataFrame:
    """Cut in two at a timeline time strictly inside; every group member that spans it is cut too, and the right halves
    get fresh ids and one new group."""
    row = _one(clips, clip_id)
    spans = (F.col("offset_ns") < at_ns) & (at_ns < F.col("offset_ns") + footprint())
    cut = _members(row) & F.coalesce(spans, F.lit(False))
    if not clips.filter((F.col("clip_id") == clip_id) & spans).take(1):
        raise EditError("the cut is not inside the clip")
    point = (F.col("in_ns") + F.round((at_ns - F.col("offset_ns")) * F.greatest(F.col("speed"), F.lit(0.01)))).cast("long")
    fresh, group = next_id(clips, "clip_id"), next_id(clips, "group_id")
    left = clips.withColumns({"out_ns": F.when(cut, point).otherwise(F.col("out_ns")), "fade_out_ns": F.when(cut, 0).otherwise(F.col("fade_out_ns")).cast("long")})
    right = clips.filter(cut).withColumns(
        {
            "in_ns": point,
            "offset_ns": F.lit(at_ns).cast("long"),
            "fade_in_ns": F.lit(0).cast("long"),
            "clip_id": (F.row_number().over(Window.orderBy("clip_id")) + (fresh - 1)).cast("long"),
            "group_id": F.lit(group if row.group_id is not None else None).cast("long"),
        }
    )
    return left.unionByName(right)


def move_to_track(clips: DataFrame, clip_id: int, track_id: int, offset_ns: int) -> DataFrame:
    moved = move_clip(clips, clip_id, offset_ns)
    last = clips.filter(F.col("track_id") == track_id).agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    own = F.col("clip_id") == clip_id
    return moved.withColumns({"track_id": F.when(own, track_id).otherwise(F.col("track_id")).cast("long"), "pos": F.when(own, last).otherwise(F.col("pos")).cast(clips.schema["pos"].dataType)})


def ripple_delete(clips: DataFrame, clip_id: int) -> DataFrame:
    """The clip's whole group goes; on every track concerned, later clips move left by what went before them."""
    row = _one(clips, clip_id)
    gone = with_footprint(clips).filter(_members(row)).select("track_id", F.col("offset_ns").alias("_o"), F.coalesce("footprint_ns", F.lit(0)).alias("_f"))
    rest = clips.filter(~F.coalesce(_members(row), F.lit(False)))
    return _shifted(rest, gone, -F.col("_f"))


#: Changes of one edit up to which they are broadcast; a group has few clips.
MOST_CHANGES = 100_000


def _shifted(rest: DataFrame, gone: DataFrame, by: Column) -> DataFrame:
    """Clips moved by the sum of what happened before them on their track. ``gone`` is settled: a group's rows cost a pass over all."""
    gone = settle(gone)
    parts = gone.select("track_id", F.struct(F.col("_o").alias("at"), by.alias("by")).alias("p")).filter("p.by IS NOT NULL").groupBy("track_id").agg(F.collect_list("p").alias("_parts"))
    small = gone.limit(MOST_CHANGES + 1).count() <= MOST_CHANGES
    met = rest.join(F.broadcast(parts) if small else parts, "track_id", "left")
    total = F.aggregate("_parts", F.lit(0).cast("long"), lambda s, p: s + F.when(p["at"] < F.col("offset_ns"), p["by"].cast("long")).otherwise(0))
    return met.withColumn("offset_ns", F.greatest(F.lit(0), F.col("offset_ns") + F.coalesce(total, F.lit(0))).cast("long")).select(rest.columns)


def ripple_trim(clips: DataFrame, clip_id: int, in_ns: int, out_ns: int) -> DataFrame:
    """Trim, then later clips of each member's track follow the change of its footprint."""
    row = _one(clips, clip_id)
    trimmed = trim_clip(clips.withColumn("_before", footprint()), clip_id, in_ns, out_ns, row)
    change = with_footprint(trimmed).filter(_members(row)).select("track_id", F.col("offset_ns").alias("_o"), (F.col("footprint_ns") - F.col("_before")).alias("_f"))
    return _shifted(trimmed.drop("_before"), change, F.col("_f"))


def group_clips(clips: DataFrame, ids: list[int]) -> DataFrame:
    for i in ids:
        _one(clips, i)
    return clips.withColumn("group_id", F.when(F.col("clip_id").isin(ids), next_id(clips, "group_id")).otherwise(F.col("group_id")).cast("long"))


def ungroup_clips(clips: DataFrame, clip_id: int) -> DataFrame:
    row = _one(clips, clip_id)
    return clips.withColumn("group_id", F.when(F.coalesce(_members(row), F.lit(False)), F.lit(None)).otherwise(F.col("group_id")).cast("long"))


def add_row(table: DataFrame, row: DataFrame, id_column: str) -> DataFrame:
    """A track or marker appended under a fresh id."""
    return table.unionByName(row.withColumn(id_column, F.lit(next_id(table, id_column)).cast("long")))


def remove_track(tracks: DataFrame, clips: DataFrame, track_id: int) -> tuple[DataFrame, DataFrame]:
    """The track and its clips go."""
    return tracks.filter(F.col("track_id") != track_id), clips.filter(F.col("track_id") != track_id)


def set_where(table: DataFrame, key: str, value, changes: dict) -> DataFrame:
    """One row's columns set: marker positions, canvas, rate, track lock."""
    return table.withColumns({c: F.when(F.col(key) == value, F.lit(v)).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in changes.items()})


def set_frame_rate(timelines: DataFrame, timeline_id: int, num: int, den: int) -> DataFrame:
    if num <= 0 or den <= 0:
        raise EditError("a frame rate must be positive")
    return set_where(timelines, "timeline_id", timeline_id, {"fps_num": num, "fps_den": den})


def set_canvas(timelines: DataFrame, timeline_id: int, w: int, h: int) -> DataFrame:
    if w <= 0 or h <= 0:
        raise EditError("a canvas must not be empty")
    return set_where(timelines, "timeline_id", timeline_id, {"canvas_w": w, "canvas_h": h})


def add_effect(effects: DataFrame, effect: DataFrame, clip_id: int) -> DataFrame:
    last = effects.filter(F.col("clip_id") == clip_id).agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    return add_row(effects, effect.withColumns({"clip_id": F.lit(clip_id).cast("long"), "pos": F.lit(last).cast(effects.schema["pos"].dataType)}), "effect_id")


def remove_effect(effects: DataFrame, effect_id: int) -> DataFrame:
    return effects.filter(F.col("effect_id") != effect_id)


def reorder_effects(effects: DataFrame, clip_id: int, order: list[int]) -> DataFrame:
    """``order`` must name each of the clip's effects once."""
    have = [r[0] for r in effects.filter(F.col("clip_id") == clip_id).select("effect_id").limit(len(order) + 1).collect()]
    if sorted(have) != sorted(order):
        raise EditError("not a permutation of the clip's effects")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("effect_id")) - 1
    return effects.withColumn("pos", F.when(F.col("clip_id") == clip_id, place).otherwise(F.col("pos")).cast(effects.schema["pos"].dataType))


def batch(table: DataFrame, edits: list) -> DataFrame:
    """All edits in order, or none: an edit that raises leaves the caller with the table it had."""
    for edit in edits:
        table = table.transform(edit)
    return table
