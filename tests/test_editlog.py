"""The edit log against plain loops over whole tables, and against the single edits."""

import math
import random
from collections import Counter

import pytest

from framelake.operators import editlog, timeline

CLIPS = "track_id long, clip_id long, pos long, group_id long, source_kind string, in_ns long, out_ns long, offset_ns long, speed double, fade_in_ns long, fade_out_ns long"
TRACKS = "timeline_id long, track_id long, kind string, lock boolean"


def tables(spark, seed, timelines):
    rng = random.Random(seed)
    tracks, clips, cid = [], [], 1
    for tl in range(timelines):
        for k in range(4):
            tid = tl * 10 + k
            tracks.append((tl, tid, "video", rng.random() < 0.1))
            at = 0
            for pos in range(rng.randrange(8)):
                span = rng.randrange(10, 500)
                lo = rng.randrange(0, 50)
                clips.append((tid, cid, pos, rng.choice([None, None, tl * 10 + 1, tl * 10 + 2]), "file", lo, None if rng.random() < 0.1 else lo + span, at, rng.choice([1.0, 2.0, 0.5, 3.0]), 1, 2))
                cid += 1
                at += rng.randrange(0, 600)
    return tracks, clips


def edits(seed, n, tracks, clips):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        kind = rng.choice(["move", "move_to_track", "trim", "ripple_trim", "split", "ripple_delete", "remove", "ungroup", "set_speed", "group", "set_lock", "remove_track"])
        if kind in ("ripple_delete", "remove", "remove_track") and rng.random() < 0.6:
            kind = "move"
        c = rng.choice(clips)
        home = c[0] // 10
        t = rng.choice([x for x in tracks if x[0] == home])[1]
        a = rng.randrange(0, 900)
        row = {"seq": seq, "kind": kind, "clip_id": None, "track_id": None, "clip_ids": None, "a": None, "b": None, "value": None, "batch": None}
        if kind in ("set_lock", "remove_track"):
            row |= {"track_id": t, "a": int(rng.random() < 0.3)}
        elif kind == "group":
            row |= {"clip_ids": [x[1] for x in rng.sample([x for x in clips if x[0] // 10 == home], 1)] + [c[1]]}
        else:
            row |= {"clip_id": c[1] if rng.random() < 0.98 else 10**6, "track_id": t if kind == "move_to_track" else None, "a": a, "b": a + rng.randrange(-5, 300), "value": rng.choice([0.0, 1.5, 1e9])}
        if rng.random() < 0.1:
            row["batch"] = home * 100 + rng.randrange(2)
        out.append(tuple(row.values()))
    return out


class Plain:
    """All clips in one list; each edit walks it."""

    def __init__(self, tracks, clips, width):
        names = [c.split(" ")[0] for c in CLIPS.split(", ")]
        self.clips = [dict(zip(names, c)) for c in clips]
        self.tracks = {t[1]: dict(home=t[0], lock=t[3]) for t in tracks}
        self.base, self.groups, self.width = max(c["clip_id"] for c in self.clips) + 1, max([c["group_id"] or 0 for c in self.clips]) + 1, width

    def run(self, e):
        seq, kind, clip, track, ids, a, b, value, _ = e
        find = {c["clip_id"]: c for c in self.clips}
        named = ids if kind == "group" else [clip] if clip is not None and kind not in ("set_lock", "remove_track") else []
        if kind in ("set_lock", "remove_track", "move_to_track") and track not in self.tracks:
            raise timeline.EditError(f"no track {track}")
        for i in named:
            if i not in find:
                raise timeline.EditError(f"no clip {i}")
        own = find[named[0]] if named else None
        team = [c for c in self.clips if c is own or own is not None and own["group_id"] is not None and c["group_id"] == own["group_id"]]
        touched = [find[i] for i in named] if kind in ("group", "remove", "set_speed") else team
        on = sorted([c["track_id"] for c in touched] + ([track] if kind in ("remove_track", "move_to_track") else []))
        for t in on:
            if self.tracks[t]["lock"]:
                raise timeline.EditError(f"track {t} is locked")
        length = lambda c: None if c["out_ns"] is None else math.floor((c["out_ns"] - c["in_ns"]) / max(c["speed"], 0.01))
        half = lambda x: int(math.copysign(math.floor(abs(x) + 0.5), x))

        def ripple(parts):
            new = []
            for c in self.clips:
                new.append(max(0, c["offset_ns"] + sum(d for t, o, d in parts if d is not None and t == c["track_id"] and c["offset_ns"] > o)))
            for c, o in zip(self.clips, new):
                c["offset_ns"] = o

        def trim():
            if b <= a:
                raise timeline.EditError("out before in")
            s = max(own["speed"], 0.01)
            d_in, d_out = (a - own["in_ns"]) / s, 0 if own["out_ns"] is None else (b - own["out_ns"]) / s
            for c in team:
                if c is not own:
                    r = max(c["speed"], 0.01)
                    if d_in:
                        c["in_ns"] = max(0, c["in_ns"] + half(d_in * r))
                    if d_out and c["out_ns"] is not None:
                        c["out_ns"] = max(0, c["out_ns"] + half(d_out * r))
                    if c["out_ns"] is not None:
                        c["in_ns"] = min(c["in_ns"], c["out_ns"])
            own["in_ns"], own["out_ns"] = a, b

        if kind in ("move", "move_to_track"):
            last = max([c["pos"] for c in self.clips if c["track_id"] == track], default=-1)
            d = a - own["offset_ns"]
            for c in team:
                c["offset_ns"] = max(0, c["offset_ns"] + d)
            if kind == "move_to_track":
                own["track_id"], own["pos"] = track, last + 1
        elif kind == "trim":
            trim()
        elif kind == "ripple_trim":
            old = [length(c) for c in team]
            trim()
            ripple([(c["track_id"], c["offset_ns"], None if length(c) is None or o is None else length(c) - o) for c, o in zip(team, old)])
        elif kind == "ripple_delete":
            self.clips = [c for c in self.clips if c not in team]
            ripple([(c["track_id"], c["offset_ns"], -(length(c) or 0)) for c in team])
        elif kind == "split":
            across = lambda c: length(c) is not None and c["offset_ns"] < a < c["offset_ns"] + length(c)
            if not across(own):
                raise timeline.EditError("the cut is not inside the clip")
            grouped = own["group_id"] is not None
            for k, c in enumerate(sorted((c for c in team if across(c)), key=lambda c: c["clip_id"])):
                cut = c["in_ns"] + half((a - c["offset_ns"]) * max(c["speed"], 0.01))
                self.clips.append(dict(c, clip_id=self.base + seq * self.width + k, in_ns=cut, offset_ns=a, fade_in_ns=0, group_id=self.groups + seq if grouped else None))
                c["out_ns"], c["fade_out_ns"] = cut, 0
        elif kind == "remove":
            self.clips.remove(own)
        elif kind == "ungroup":
            for c in team:
                c["group_id"] = None
        elif kind == "group":
            for i in ids:
                find[i]["group_id"] = self.groups + seq
        elif kind == "set_speed":
            own["speed"] = min(100.0, max(0.01, value))
        elif kind == "set_lock":
            self.tracks[track]["lock"] = bool(a)
        elif kind == "remove_track":
            del self.tracks[track]
            self.clips = [c for c in self.clips if c["track_id"] != track]


def test_a_thousand_edits(spark):
    tracks, clips = tables(spark, 1, 30)
    log = [e[:-1] + (None,) for e in edits(2, 1000, tracks, clips)]
    c, t, e = spark.createDataFrame(clips, CLIPS), spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(log, editlog.EDIT).repartition(4)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    after, kept, refused = editlog.apply_log(c, t, e, on_error="skip")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before)
    assert jobs < 60  # of which adaptive plans make several an action; none by edit
    named = {i for x in log for i in [x[2], *(x[4] or [])] if i is not None}
    groups = {x[3] for x in clips if x[1] in named} - {None}
    width = max(Counter(x[0] // 10 for x in clips if x[1] in named or x[3] in groups).values()) + 1
    plain, no = Plain(tracks, clips, width), []
    for x in log:
        try:
            plain.run(x)
        except timeline.EditError as why:
            no.append((x[0], str(why)))
    names = [x.split(" ")[0] for x in CLIPS.split(", ")]
    assert sorted(map(tuple, refused.collect())) == sorted(no) and 100 < len(no) < 900
    assert Counter(tuple(r) for r in after.select(*names).collect()) == Counter(tuple(x[n] for n in names) for x in plain.clips)
    assert {(r.track_id, r.lock) for r in kept.collect()} == {(i, x["lock"]) for i, x in plain.tracks.items()}


def test_like_the_single_edits(spark):
    tracks, clips = tables(spark, 7, 1)
    tracks = [x[:3] + (False,) for x in tracks]
    c, t = spark.createDataFrame(clips, CLIPS), spark.createDataFrame(tracks, TRACKS)
    x = {r.clip_id: r for r in c.collect()}
    a, b, d = [i for i in x if x[i].out_ns is not None][:3]
    log = [(1, "move", a, None, None, 700, None, None, None), (2, "ripple_trim", b, None, None, 20, 90, None, None), (3, "set_speed", d, None, None, None, None, 4.0, None), (4, "ripple_delete", d, None, None, None, None, None, None)]
    one = timeline.ripple_delete(timeline.set_property(timeline.ripple_trim(timeline.move_clip(c, a, 700), b, 20, 90), d, "speed", 4.0), d)
    got = editlog.apply_log(c, t, spark.createDataFrame(log, editlog.EDIT))[0]
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, one.select(*got.columns).collect()))


def test_locks_and_batches(spark):
    clips = [(1, 1, 0, 5, "file", 0, 100, 0, 1.0, 0, 0), (2, 2, 0, 5, "file", 0, 100, 0, 1.0, 0, 0), (1, 3, 1, None, "file", 0, 100, 200, 1.0, 0, 0), (3, 4, 0, None, "file", 0, 9, 0, 1.0, 0, 0)]
    tracks = [(0, 1, "video", False), (0, 2, "audio", True), (0, 3, "video", None)]
    c, t = spark.createDataFrame(clips, CLIPS), spark.createDataFrame(tracks, TRACKS)

    def run(log, **how):
        return editlog.apply_log(c, t, spark.createDataFrame([(i, *x) for i, x in enumerate(log)], editlog.EDIT), **how)

    move = lambda i, to, batch=None: ("move", i, None, None, to, None, None, batch)
    with pytest.raises(timeline.EditError, match="track 2 is locked"):
        run([move(1, 50)])  # its group reaches a locked track
    free = ("set_lock", None, 2, None, 0, None, None, None)
    assert {r.clip_id: r.offset_ns for r in run([free, move(1, 50)])[0].collect()} == {1: 50, 2: 50, 3: 200, 4: 0}
    after, kept, refused = run([move(3, 10, 7), move(4, 20, 7), move(1, 5, 7), move(4, 30)], on_error="skip")
    assert {r.clip_id: r.offset_ns for r in after.collect()} == {1: 0, 2: 0, 3: 200, 4: 30}
    assert [r.reason for r in refused.orderBy("seq").collect()] == ["batch: track 2 is locked"] * 2 + ["track 2 is locked"]
    for bad in (("dance", 1, None, None, 1, None, None, None), move(99, 1), ("move_to_track", 3, 77, None, 1, None, None, None)):
        with pytest.raises(timeline.EditError):
            run([bad])
    same = run([], on_error="raise")[0]
    assert Counter(map(tuple, same.collect())) == Counter(clips)
    with pytest.raises(ValueError):
        run([], on_error="ignore")


def test_checks_and_points(spark):
    from framelake.operators import checks, select

    steps = [(1, "speed", {"factor": 0.05}), (2, "speed", {"factor": 1.0}), (3, "eq", {"contrast": 3.5, "tint": -2.0, "brightness": 0.0}), (4, "fade_in", {"duration": 0.0}), (5, "loudness_normalize", {"target_lufs": 0.0, "lra": 60.0}), (6, "gblur", {"sigma": float("nan")}), (7, "unknown", {"x": -1.0}), (8, "crop", {})]
    got = checks.faults(spark.createDataFrame(steps, "step_id long, kind string, params map<string,double>"), ["step_id"])
    assert {(r.step_id, r.param) for r in got.collect()} == {(1, "factor"), (3, "contrast"), (3, "tint"), (4, "duration"), (5, "target_lufs"), (5, "lra"), (6, "sigma")}
    frames = spark.createDataFrame([(1, 10), (1, 20)], "s long, t long").withColumn("f", timeline.F.col("t"))
    at = lambda t: spark.createDataFrame([(1, t)], "s long, t long")
    assert select.points(at(11), frames, ["s"], "t", ["f"]).first().f == 20
    with pytest.raises(Exception, match="no frame at 21"):
        select.points(at(21), frames, ["s"], "t", ["f"]).collect()
