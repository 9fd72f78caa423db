"""An edit log applied to all timelines at once.

Edits are rows: (seq, kind, clip_id, track_id, clip_ids, a, b, value, batch). The clips that any edit names, with their
groups, are the actors; a timeline's actors, its named tracks and its edits meet in one task and are folded in order of seq,
locks looked at each time. What that does to the other clips of a track (ripples, a removed track) leaves the fold as
events by track, and each other clip runs through its own track's events by itself: clips are never gathered by timeline or
track, and the number of jobs doesn't depend on the number of edits.

Kinds and their arguments: move (clip_id, a: offset), move_to_track (clip_id, track_id, a: offset), trim and ripple_trim
(clip_id, a: in, b: out), split (clip_id, a: time), ripple_delete, remove, ungroup (clip_id), set_speed (clip_id, value), group
(clip_ids), set_lock (track_id, a: 1 or 0), remove_track (track_id). Edits with one ``batch`` apply all or none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..folders import settle
from . import grouped
from .timeline import CLIP_EDITS, GROUP_EDITS, RANGES, EditError

EDIT = "seq long, kind string, clip_id long, track_id long, clip_ids array<long>, a long, b long, value double, batch long"
#: Rows of events up to which they are broadcast; more are met by shuffle.
MOST_EVENTS = 100_000
_SPEED = RANGES["speed"]
_TRACK_EDITS = {"set_lock", "remove_track"}
_KINDS = {"move", "move_to_track", "trim", "ripple_trim", "split", "ripple_delete", "remove", "ungroup", "set_speed", "group"} | _TRACK_EDITS


def _round(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def _footprint(c: dict) -> int | None:
    return None if c["out_ns"] is None or c["in_ns"] is None else math.floor((c["out_ns"] - c["in_ns"]) / max(c["speed"], 0.01))


class _Timeline:
    """The actors and tracks of a timeline while its edits are folded."""

    def __init__(self, clips: list[dict], tracks: list[dict], base: int, width: int, group_base: int):
        self.clips = {c["clip_id"]: c for c in clips}
        self.locked = {t["track_id"] for t in tracks if t["lock"]}
        self.tracks = {t["track_id"]: t["last_pos"] for t in tracks}
        self.base, self.width, self.group_base = base, width, group_base
        self.events: list[tuple] = []  # (seq, track_id, removed, [(at, by)])

    def copy(self) -> _Timeline:
        new = object.__new__(_Timeline)
        new.__dict__ = self.__dict__ | {"clips": {k: dict(v) for k, v in self.clips.items()}, "locked": set(self.locked), "tracks": dict(self.tracks), "events": list(self.events)}
        return new

    def apply(self, e: dict) -> None:
        kind = e["kind"]
        if kind not in _KINDS:
            raise EditError(f"unknown edit {kind!r}")
        if kind in _TRACK_EDITS or kind == "move_to_track":
            if e["track_id"] not in self.tracks:
                raise EditError(f"no track {e['track_id']}")
        named = [] if kind in _TRACK_EDITS else list(e["clip_ids"] or []) if kind == "group" else [e["clip_id"]]
        for i in named:
            if i not in self.clips:
                raise EditError(f"no clip {i}")
        held = [self.clips[i]["track_id"] for i in named]
        if kind in GROUP_EDITS:
            held = [c["track_id"] for c in self.members(e["clip_id"])]
        if kind in ("move_to_track", "remove_track"):
            held.append(e["track_id"])
        for t in sorted(held):
            if t in self.locked:
                raise EditError(f"track {t} is locked")
        getattr(self, "_" + kind)(e)

    def members(self, clip_id: int) -> list[dict]:
        own = self.clips[clip_id]
        g = own["group_id"]
        return [own] if g is None else [c for _, c in sorted(self.clips.items()) if c["group_id"] == g]

    def _move(self, e: dict) -> None:
        by = e["a"] - self.clips[e["clip_id"]]["offset_ns"]
        for c in self.members(e["clip_id"]):
            c["offset_ns"] = max(0, c["offset_ns"] + by)

    def _move_to_track(self, e: dict) -> None:
        last = [c["pos"] for c in self.clips.values() if c["track_id"] == e["track_id"]] + ([] if self.tracks[e["track_id"]] is None else [self.tracks[e["track_id"]]])
        self._move(e)
        self.clips[e["clip_id"]].update(track_id=e["track_id"], pos=max(last, default=-1) + 1)

    def _trim(self, e: dict) -> None:
        own = self.clips[e["clip_id"]]
        if e["b"] <= e["a"]:
            raise EditError("out before in")
        speed = max(own["speed"], 0.01)
        by_in, by_out = (e["a"] - (own["in_ns"] or 0)) / speed, 0 if own["out_ns"] is None else (e["b"] - own["out_ns"]) / speed
        for c in self.members(e["clip_id"]):
            if c is own:
                continue
            rate = max(c["speed"], 0.01)
            if by_in:
                c["in_ns"] = max(0, (c["in_ns"] or 0) + _round(by_in * rate))
            if by_out and c["out_ns"] is not None:
                c["out_ns"] = max(0, c["out_ns"] + _round(by_out * rate))
            if c["out_ns"] is not None and c["in_ns"] is not None and c["in_ns"] > c["out_ns"]:
                c["in_ns"] = c["out_ns"]
        own.update(in_ns=e["a"], out_ns=e["b"])

    def _shift(self, seq: int, changes: list[tuple]) -> None:
        """Clips after a change on its track move by it: actors here, others by events."""
        by_track: dict[int, list] = {}
        for track, at, by in changes:
            if by is not None:
                by_track.setdefault(track, []).append((at, by))
        for c in self.clips.values():
            c["offset_ns"] = max(0, c["offset_ns"] + sum(by for at, by in by_track.get(c["track_id"], []) if at < c["offset_ns"]))
        self.events += [(seq, t, False, parts) for t, parts in by_track.items()]

    def _ripple_trim(self, e: dict) -> None:
        before = {c["clip_id"]: _footprint(c) for c in self.members(e["clip_id"])}
        self._trim(e)
        now = [(c["track_id"], c["offset_ns"], _footprint(c), before[c["clip_id"]]) for c in self.members(e["clip_id"])]
        self._shift(e["seq"], [(t, at, None if f is None or b is None else f - b) for t, at, f, b in now])

    def _ripple_delete(self, e: dict) -> None:
        gone = self.members(e["clip_id"])
        for c in gone:
            del self.clips[c["clip_id"]]
        self._shift(e["seq"], [(c["track_id"], c["offset_ns"], -(_footprint(c) or 0)) for c in gone])

    def _split(self, e: dict) -> None:
        at, own = e["a"], self.clips[e["clip_id"]]
        spans = lambda c: _footprint(c) is not None and c["offset_ns"] < at < c["offset_ns"] + _footprint(c)
        if not spans(own):
            raise EditError("the cut is not inside the clip")
        grouped = own["group_id"] is not None
        for k, c in enumerate([c for c in self.members(e["clip_id"]) if spans(c)]):
            point = c["in_ns"] + _round((at - c["offset_ns"]) * max(c["speed"], 0.01))
            fresh = self.base + e["seq"] * self.width + k
            self.clips[fresh] = dict(c, clip_id=fresh, in_ns=point, offset_ns=at, fade_in_ns=0, group_id=self.group_base + e["seq"] if grouped else None)
            c.update(out_ns=point, fade_out_ns=0)

    def _remove(self, e: dict) -> None:
        del self.clips[e["clip_id"]]

    def _ungroup(self, e: dict) -> None:
        for c in self.members(e["clip_id"]):
            c["group_id"] = None

    def _group(self, e: dict) -> None:
        for i in e["clip_ids"]:
            self.clips[i]["group_id"] = self.group_base + e["seq"]

    def _set_speed(self, e: dict) -> None:
        self.clips[e["clip_id"]]["speed"] = min(_SPEED[1], max(_SPEED[0], e["value"]))

    def _set_lock(self, e: dict) -> None:
        (self.locked.add if e["a"] else self.locked.discard)(e["track_id"])

    def _remove_track(self, e: dict) -> None:
        del self.tracks[e["track_id"]]
        self.clips = {k: c for k, c in self.clips.items() if c["track_id"] != e["track_id"]}
        self.events.append((e["seq"], e["track_id"], True, []))


def _folded(state: _Timeline, edits: list[dict]) -> tuple[_Timeline, list[tuple]]:
    """The timeline after its edits in order, and (seq, reason) of those that were refused."""
    refused, i = [], 0
    edits = sorted(edits, key=lambda e: e["seq"])
    while i < len(edits):
        j = i + 1
        while edits[i]["batch"] is not None and j < len(edits) and edits[j]["batch"] == edits[i]["batch"]:
            j += 1
        whole = state.copy()
        try:
            for k in range(i, j):
                whole.apply(edits[k])
            state = whole
        except EditError as why:
            refused += [(e["seq"], str(why) if e is edits[k] else f"batch: {why}") for e in edits[i:j]]
        i = j
    return state, refused


def apply_log(clips: DataFrame, tracks: DataFrame, edits: DataFrame, on_error: str = "raise") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clips, tracks, refused) after all ``edits`` (seq unique, see above). ``on_error``: raise EditError with the first
    refusal, or skip what is refused, which ``refused`` (seq, reason) tells. ``tracks``: timeline_id, track_id, lock and others.

    New clips of a split get ids from the largest id plus seq times the largest number of actors in a timeline plus one;
    new groups the largest group plus 1 plus seq. An edit of clips that don't exist is refused; edits of a batch lie in one
    timeline (those of others are batches of their own)."""
    if on_error not in ("raise", "skip"):
        raise ValueError(f"on_error is raise or skip, not {on_error!r}")
    edits = settle(edits.select(*(c.split(" ")[0] for c in EDIT.split(", "))))
    ids = F.filter(F.concat(F.array("clip_id"), F.coalesce("clip_ids", F.array().cast("array<bigint>"))), lambda i: i.isNotNull())
    named = settle(edits.select(F.explode(ids).alias("clip_id")).distinct())
    direct = clips.join(named, "clip_id", "left_semi")
    groups = direct.filter("group_id IS NOT NULL").select("group_id").distinct()
    homes = tracks.select("track_id", F.col("timeline_id").alias("_home"))
    actors = direct.unionByName(clips.join(groups, "group_id", "left_semi").select(*clips.columns).join(named, "clip_id", "left_anti").select(*clips.columns))
    actors = settle(actors.join(homes, "track_id", "left").select(*clips.columns, "_home"))
    # Each edit goes to the timeline of its clip, else of its track.
    first = F.coalesce("clip_id", F.get("clip_ids", F.lit(0)))
    routed = edits.withColumn("_first", first).join(actors.select(F.col("clip_id").alias("_first"), F.col("_home").alias("_by_clip")), "_first", "left")
    routed = routed.join(homes.select(F.col("track_id").alias("_t"), F.col("_home").alias("_by_track")), F.col("track_id") == F.col("_t"), "left")
    routed = routed.withColumn("_home", F.coalesce("_by_clip", "_by_track")).drop("_first", "_t", "_by_clip", "_by_track")
    bounds = clips.agg(F.coalesce(F.max("clip_id"), F.lit(0)).alias("c"), F.coalesce(F.max("group_id"), F.lit(0)).alias("g")).first()
    width = (actors.groupBy("_home").count().agg(F.max("count")).first()[0] or 0) + 1
    base, group_base, names = bounds.c + 1, bounds.g + 1, clips.columns
    # Of tracks: those that edits name or actors lie on, with the last place of the other clips.
    wanted = edits.filter("track_id IS NOT NULL").select("track_id").union(actors.select("track_id")).distinct()
    others = clips.join(actors.select("clip_id"), "clip_id", "left_anti")
    last = others.join(wanted, "track_id", "left_semi").groupBy("track_id").agg(F.max("pos").alias("last_pos"))
    held = tracks.join(wanted, "track_id", "left_semi").select("track_id", F.coalesce("lock", F.lit(False)).alias("lock"), F.col("timeline_id").alias("_home")).join(last, "track_id", "left")
    state = actors.withColumns({"lock": F.lit(None).cast("boolean"), "last_pos": F.lit(None).cast(clips.schema["pos"].dataType), "_role": F.lit("clip")})
    blank = [F.lit(None).cast(clips.schema[c].dataType).alias(c) for c in names if c != "track_id"]
    state = state.unionByName(held.select("track_id", "lock", "_home", F.col("last_pos").cast(clips.schema["pos"].dataType).alias("last_pos"), *blank, F.lit("track").alias("_role")))
    part = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("by", T.LongType())]))
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in clips.schema), T.StructField("_role", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("_removed", T.BooleanType()), T.StructField("_parts", part), T.StructField("_reason", T.StringType())])

    spans = pa.list_(pa.struct([("at", pa.int64()), ("by", pa.int64())]))
    more = [("_role", pa.string()), ("_seq", pa.int64()), ("_removed", pa.bool_()), ("_parts", spans), ("_reason", pa.string())]

    def fold(have: list[dict]) -> list[dict]:
        log, rows = [r["_edit"] for r in have if r["_edit"] is not None], [r["_state"] for r in have if r["_state"] is not None]
        own = _Timeline([{c: r[c] for c in names} for r in rows if r["_role"] == "clip"], [r for r in rows if r["_role"] == "track"], base, width, group_base)
        was = set(own.locked)
        done, refused = _folded(own, log)
        made = [c | {"_role": "clip"} for c in done.clips.values()]
        made += [{"track_id": t, "_role": "event", "_seq": s, "_removed": gone, "_parts": [{"at": a, "by": b} for a, b in parts]} for s, t, gone, parts in done.events]
        made += [{"track_id": t, "_role": "lock" if t in done.locked else "unlock"} for t in was ^ done.locked]
        return made + [{"_role": "refused", "_seq": s, "_reason": why} for s, why in refused]

    def plain(column: pa.StructArray) -> list[dict | None]:
        """A struct column's rows, by whole fields."""
        fields = [f.name for f in column.type]
        return [dict(zip(fields, v)) if there else None for there, v in zip(column.is_valid().to_pylist(), zip(*(f.to_pylist() for f in column.flatten())))]

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kept = first.schema.field("_state").type
        schema = pa.schema([*(pa.field(c, kept.field(c).type) for c in names), *(pa.field(*x) for x in more)])
        rows = (row for b in itertools.chain([first], batches) for row in zip(b.column("_home").to_pylist(), plain(b.column("_state")), plain(b.column("_edit"))))
        made: list[dict] = []
        for _, timeline in itertools.groupby(rows, lambda row: row[0]):
            made += fold([{"_state": s, "_edit": e} for _, s, e in timeline])
            if len(made) >= grouped.TOGETHER:
                yield from pa.Table.from_pylist(made, schema=schema).to_batches()
                made = []
        if made:
            yield from pa.Table.from_pylist(made, schema=schema).to_batches()

    # Timelines are many and small: they stream through the tasks one after the other.
    held, log = F.struct(*(c for c in state.columns if c != "_home")), F.struct(*(c for c in routed.columns if c != "_home"))
    none = lambda df, row: F.lit(None).cast(df.select(row).schema[0].dataType)
    both = state.select("_home", held.alias("_state"), none(routed, log).alias("_edit")).unionByName(routed.select("_home", none(state, held).alias("_state"), log.alias("_edit")))
    folded = settle(grouped.dealt(both, ["_home"], []).mapInArrow(folds, out))
    refused = folded.filter("_role = 'refused'").select(F.col("_seq").alias("seq"), F.col("_reason").alias("reason"))
    if on_error == "raise":
        why = refused.orderBy("seq").take(1)
        if why:
            raise EditError(why[0].reason)
    events = folded.filter("_role = 'event'").select("track_id", F.struct(F.col("_seq").alias("seq"), F.col("_removed").alias("removed"), F.col("_parts").alias("parts")).alias("e"))
    by_track = events.groupBy("track_id").agg(F.array_sort(F.collect_list("e")).alias("_events"))
    few = events.limit(MOST_EVENTS + 1).count() <= MOST_EVENTS
    met = others.join(F.broadcast(by_track) if few else by_track, "track_id", "left")

    def step(at, e):
        return F.greatest(F.lit(0).cast("long"), at + F.aggregate(e["parts"], F.lit(0).cast("long"), lambda s, p: s + F.when(p["at"] < at, p["by"]).otherwise(0)))

    run = F.when(F.col("_events").isNull(), F.col("offset_ns")).otherwise(F.aggregate("_events", F.col("offset_ns").cast("long"), step))
    stay = F.col("_events").isNull() | ~F.exists("_events", lambda e: e["removed"])
    rest = met.filter(stay).withColumn("offset_ns", run.cast(clips.schema["offset_ns"].dataType)).select(*names)
    after = rest.unionByName(folded.filter("_role = 'clip'").select(*names))
    flags = folded.filter("_role IN ('lock', 'unlock')").select("track_id", (F.col("_role") == "lock").alias("_now"))
    gone = events.filter("e.removed").select("track_id")
    kept = tracks.join(gone, "track_id", "left_anti").join(flags, "track_id", "left").withColumn("lock", F.coalesce("_now", "lock")).select(*tracks.columns)
    return after, kept, refused


assert _KINDS - _TRACK_EDITS - {"set_speed", "remove", "group"} <= GROUP_EDITS and {"remove", "group"} <= CLIP_EDITS
