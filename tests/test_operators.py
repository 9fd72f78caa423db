"""Known values and edge cases of functions and operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import audio as fa
from framelake.functions import blend, colour, easing, text
from framelake.functions import time as tm
from framelake.operators import analysis, audio, keyframes, pixels, segments, select, timeline
from framelake.sources import catalogue, documents, subtitles
from framelake.streaming import live


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(v):
    return F.lit(v).cast("long")


def test_timecode(spark):
    ntsc = lit(30000), lit(1001)
    tc = lambda f, n=ntsc: tm.timecode(lit(f), *n)
    assert one(spark, tc(1800), tc(1799), tc(17982), tc(-1), tc(0)) == ("00:01:00;02", "00:00:59;29", "00:10:00;00", None, "00:00:00;00")
    assert one(spark, tc(100, (lit(25), lit(1)))) == ("00:00:04:00",)
    assert one(spark, tm.parse_timecode(F.lit("00:01:00;02"), *ntsc), tm.parse_timecode(F.lit("00:01:00;01"), *ntsc), tm.parse_timecode(F.lit("x"), *ntsc)) == (1800, None, None)


def test_exact_time(spark):
    assert one(spark, tm.beat_to_ns(lit(7), lit(2), lit(174), lit(1))) == (1_206_896_552,)
    assert one(spark, tm.half_away(lit(5), lit(2)), tm.half_away(lit(-5), lit(2)), tm.half_away(lit(1), lit(0))) == (3, -3, None)
    r = spark.range(1).select(tm.reduce_ratio(lit(6), lit(-4)).alias("r")).first().r
    assert (r.num, r.den) == (-3, 2)
    assert one(spark, tm.frame_index(F.lit(2.5), F.lit(1.0)), tm.frame_index(F.lit(-1.0), F.lit(1.0)), tm.frame_index(F.lit(float("nan")), F.lit(1.0))) == (3, None, None)
    for num, den in ((24000, 1001), (30000, 1001), (60000, 1001), (25, 1)):  # rounding keeps every frame
        f = spark.range(2006).select("id", tm.frame_start_ns(F.col("id"), lit(num), lit(den)).alias("ns"))
        assert f.filter(tm.frame_index(F.col("ns") / 1e9, F.lit(num / den)) != F.col("id")).count() == 0


def test_easing_ends_and_bezier(spark):
    for kind in ("hold", "linear", "ease_in", "ease_out", "ease_in_out", "bezier"):
        e = lambda t: easing.ease(F.lit(kind), F.lit(t), F.lit(0.25), F.lit(0.1), F.lit(0.25), F.lit(1.0))  # noqa: E731, B023
        a, b = one(spark, e(0.0), e(1.0))
        assert abs(a) < 1e-9 and abs(b - 1) < 1e-9
    assert abs(one(spark, easing.bezier(F.lit(0.5), *map(F.lit, (0.25, 0.1, 0.25, 1.0))))[0] - 0.8024) < 1e-3


def test_blend_singular_points(spark):
    at = lambda m, a, b: one(spark, blend.MODES[m](F.lit(float(a)), F.lit(float(b))))[0]
    assert [at("color_dodge", 1, 0.5), at("color_burn", 0, 0.5), at("divide", 0.5, 0), at("harmonic", 0, 0), at("reflect", 0.5, 1), at("glow", 1, 0.3), at("freeze", 0.5, 0), at("heat", 0, 0.5)] == [1, 0, 1, 0, 1, 1, 0, 0]
    assert at("bleach", 1, 1) == -1 and at("stain", 0, 0) == 2
    with pytest.raises(ValueError):
        blend.blend_pixel("none", [], [])


def test_hsl_round_trip(spark):
    for rgb in [(0.2, 0.5, 0.9), (1.0, 0.0, 0.0), (0.3, 0.3, 0.3), (0.9, 0.8, 0.1)]:
        back = one(spark, *colour.hsl_to_rgb(*colour.rgb_to_hsl(*map(F.lit, rgb))))
        assert np.allclose(back, rgb)


def test_kelvin_and_tempo():
    r, g, b = colour.kelvin_gains(6600.0)
    assert r == 1 and b == 1 and g > 0.98
    assert math.isclose(math.prod(fa.tempo_chain(5.0)), 5) and all(0.5 <= f <= 2 for f in fa.tempo_chain(0.1))
    with pytest.raises(ValueError):
        fa.tempo_chain(0)


def test_subtitle_clock(spark):
    assert one(spark, *(text.clock_to_ns(F.lit(s)) for s in ("01:02:03,5", "02:03.004", "0:00:01.25", "x"))) == (3_723_500_000_000, 123_004_000_000, 1_250_000_000, None)
    assert one(spark, text.ns_to_clock(lit(3_723_004_000_000)), text.strip_ass(F.lit(r"{\b1}a\Nb"))) == ("01:02:03,004", "a\nb")


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\r\n00:00:01,000 --> 00:00:02,000\r\n<i>Hi</i>\r\nyou\r\n\r\nbroken\r\n\r\n2\r\n00:00:05,000 --> 00:00:04,000\r\nbackwards\r\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.500 align:left\nHello\n")
    (tmp_path / "c.ass").write_text("[Events]\nFormat: a\nDialogue: 0,0:00:01.50,0:00:02.00,D,,0,0,0,,{\\i1}A, b\\Nc\n")
    got = {r.path[-5:]: (r.start_ns, r.end_ns, r.text) for r in subtitles.read(spark, str(tmp_path)).collect()}
    assert got == {"a.srt": (10**9, 2 * 10**9, "Hi\nyou"), "b.vtt": (10**9, 2_500_000_000, "Hello"), "c.ass": (1_500_000_000, 2 * 10**9, "A, b\nc")}


def test_cube_and_project(spark, tmp_path):
    lines = ["TITLE x", "LUT_3D_SIZE 2"] + [f"{r}.0 {g}.0 {b}.0" for b in (0, 1) for g in (0, 1) for r in (0, 1)]
    (tmp_path / "i.cube").write_text("\n".join(lines))
    cube, n = documents.read_cube(spark, str(tmp_path / "i.cube"))
    assert n == 2 and cube.filter("r_idx = r AND g_idx = g AND b_idx = b").count() == 8
    p = spark.createDataFrame([(0, 0, 0, 0.3, 0.6, 1.0)], "frame_no long, x int, y int, r double, g double, b double")
    assert np.allclose(tuple(pixels.apply_lut(p, cube, 2).select("r", "g", "b").first()), (0.3, 0.6, 1.0))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "v0.json").write_text('{"canvas_w":640,"canvas_h":360,"fps":29.97,"clips":[]}')
    (tmp_path / "p" / "v2.json").write_text('{"format_version":2,"timeline":{"canvas_w":1,"canvas_h":2,"fps_num":25,"fps_den":1}}')
    got = {r.path[-7:]: (r.format_version, r.timeline.fps_num, r.timeline.fps_den) for r in documents.read_projects(spark, str(tmp_path / "p")).collect()}
    assert got == {"v0.json": (2, 30000, 1001), "v2.json": (2, 25, 1)}


def test_conform_golden_plans(spark):
    for source, want in ((24, [0, 0, 1, 2, 3, 4, 4]), (60, [0, 2, 4, 6, 8])):
        n = 6 if source == 24 else 10
        frames = spark.createDataFrame([(1, i, round(i * 10**9 / source)) for i in range(n)], "s long, i long, ns long")
        got = [r.i for r in select.conform(frames, ["s"], "ns", 30, 1, ["i"]).orderBy("k").collect()]
        assert got[: len(want)] == want


def test_asof_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, t, t) for t in (0, 5, 9)], "k long, t long, v long")
    right = spark.createDataFrame([(1, 5, 7), (1, 5, 8), (2, 0, 1)], "k long, t long, w long")
    back = {r.v: r.w for r in select.asof(left, right, ["k"], "t", ["w"]).collect()}
    assert back == {0: None, 5: 8, 9: 8}
    assert {r.v: r.w for r in select.asof(left, right, ["k"], "t", ["w"], forward=True).collect()} == {0: 7, 5: 7, 9: None}


def test_keyframes(spark):
    keys = [(1, "p", 10, 1.0, "linear", 0.0, 0.0, 1.0, 1.0, 0), (1, "p", 10, 2.0, "linear", 0.0, 0.0, 1.0, 1.0, 1), (1, "p", 20, 4.0, "hold", 0.0, 0.0, 1.0, 1.0, 2), (1, "p", 30, 8.0, "linear", 0.0, 0.0, 1.0, 1.0, 3)]
    k = spark.createDataFrame(keys, "owner_id long, prop string, ts_ns long, value double, easing string, x1 double, y1 double, x2 double, y2 double, seq long")
    t = spark.createDataFrame([(1, "p", v) for v in (0, 10, 15, 20, 29, 30, 99)] + [(2, "p", 5)], "owner_id long, prop string, ts_ns long")
    got = {(r.owner_id, r.ts_ns): r.value for r in keyframes.value_at(t, k).collect()}
    assert got == {(1, 0): 2, (1, 10): 2, (1, 15): 3, (1, 20): 4, (1, 29): 4, (1, 30): 8, (1, 99): 8, (2, 5): None}


def test_silence(spark):
    rate = 1000
    tone = [math.sin(i) * 0.8 for i in range(rate)]
    values = tone + [0.0] * 2 * rate + tone + [0.0] * rate  # the last silence has no end
    s = spark.createDataFrame([(1, i * 1_000_000, v) for i, v in enumerate(values)], "s long, t long, v double")
    got = [(r.start / 1e9, r.end / 1e9) for r in analysis.silence(s, ["s"], "t", "v").collect()]
    assert len(got) == 1 and abs(got[0][0] - 1) < 0.01 and abs(got[0][1] - 3) < 0.01


def test_psnr_count_mismatch(spark):
    a = spark.createDataFrame([(0, 0, 0, 5), (1, 0, 0, 5)], "frame_no long, x int, y int, v int")
    assert [r.psnr for r in analysis.mean_psnr(a, a, "v").collect()] == [float("inf")] * 2
    with pytest.raises(Exception, match="frame counts differ"):
        analysis.mean_psnr(a, a.filter("frame_no = 0"), "v").collect()


def test_parameter_checks(spark):
    df = spark.range(1)
    for call in (lambda: select.trim(df, "id", 5, 5), lambda: select.speed(df, "id", 0.01), lambda: select.every_nth(df, ["id"], [], 0), lambda: analysis.scene_cuts(df, [], "id", "id", 2), lambda: segments.ladder(df, [])):
        with pytest.raises(ValueError):
            call()


def test_levels_of_a_tone(spark):
    s = spark.createDataFrame([(1, i, 0.5 * math.sin(2 * math.pi * 440 * i / 48_000)) for i in range(48_000)], "s long, n long, v double")
    r = analysis.levels_db(analysis.waveform(s, ["s"], "n", "v", 48_000)).first()
    assert abs(r.peak_db + 6.02) < 0.01 and abs(r.rms_db + 9.03) < 0.01
    assert one(spark, fa.to_db(F.lit(0.0))) == (float("-inf"),)


def test_recursive_audio():
    t = np.arange(4096) / 48_000
    x = np.sin(2 * np.pi * 440 * t)
    assert len(audio.stretch(x, 2.0)) == 2048
    assert np.isclose(audio.envelope(np.ones(48_000), 5, 50, 48_000)[-1], 1)
    b, a = audio.biquad("peak", 1000, 1.0, 0.0, 48_000)
    assert np.allclose(b, a)  # no gain: the identity
    with pytest.raises(ValueError):
        audio.biquad("none", 1000, 1.0, 0.0, 48_000)


TRACKS = "timeline_id long, track_id long, kind string, mute boolean, solo boolean, enabled boolean"
CLIPS = "track_id long, clip_id long, pos long, group_id long, source_kind string, in_ns long, out_ns long, offset_ns long, speed double, fade_in_ns long, fade_out_ns long, transition_ns long, source_ns long"


@pytest.fixture
def clips(spark):
    rows = [(1, 1, 0, 7, "file", 0, 100, 0, 1.0, 5, 5, 9, 110), (1, 2, 1, None, "file", 0, 100, 100, 2.0, 0, 0, 50, 100), (2, 3, 0, 7, "file", 0, 400, 0, 2.0, 0, 0, 0, 400), (1, 4, 2, None, "text", 0, None, 120, 1.0, 0, 0, 5, None)]
    return spark.createDataFrame(rows, CLIPS)


def by_id(df, *columns):
    return {r.clip_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_trim_leaves_an_unset_out_point_unset(spark):
    rows = [(1, 1, 0, 7, "file", 0, 100, 0, 1.0, 0, 0, 0, 110), (2, 2, 0, 7, "file", 5, None, 0, 2.0, 0, 0, 0, None), (2, 3, 1, None, "file", 0, 9, 50, 1.0, 0, 0, 0, 9), (3, 4, 0, 7, "file", 0, 15, 0, 1.0, 0, 0, 0, 15)]
    clips = spark.createDataFrame(rows, CLIPS)
    # 2 has no out-point: its in-point follows, nothing else; 4 is shorter than the trim: its in-point goes back to its out-point.
    want = {1: (10, 90), 2: (25, None), 3: (0, 9), 4: (5, 5)}
    assert by_id(timeline.trim_clip(clips, 1, 10, 90), "in_ns", "out_ns") == want
    assert by_id(timeline.ripple_trim(clips, 1, 10, 90), "in_ns", "out_ns", "offset_ns")[3] == (0, 9, 50)
    assert by_id(timeline.trim_clip(clips, 2, 25, 60), "in_ns", "out_ns") == {1: (10, 100), 2: (25, 60), 3: (0, 9), 4: (10, 15)}


def test_edits(spark, clips):
    assert by_id(timeline.move_clip(clips, 1, 30), "offset_ns") == {1: (30,), 2: (100,), 3: (30,), 4: (120,)}
    got = by_id(timeline.split_clip(clips, 1, 40), "in_ns", "out_ns", "offset_ns", "group_id", "fade_in_ns", "fade_out_ns")
    assert got[1] == (0, 40, 0, 7, 5, 0) and got[3] == (0, 80, 0, 7, 0, 0)
    assert got[5] == (40, 100, 40, 8, 0, 5) and got[6] == (80, 400, 40, 8, 0, 0)
    assert by_id(timeline.ripple_delete(clips, 1), "offset_ns") == {2: (0,), 4: (20,)}
    assert by_id(timeline.trim_clip(clips, 1, 10, 90), "in_ns", "out_ns")[3] == (20, 380)
    assert by_id(timeline.ripple_trim(clips, 1, 10, 90), "offset_ns")[2] == (80,)
    assert by_id(timeline.ungroup_clips(clips, 1), "group_id")[3] == (None,)
    assert by_id(timeline.group_clips(clips, [2, 4]), "group_id")[4] == (8,)
    assert by_id(timeline.set_property(clips, 2, "speed", -4.0), "speed")[2] == (0.01,)
    assert by_id(timeline.move_to_track(clips, 2, 2, 5), "track_id", "pos", "offset_ns")[2] == (2, 1, 5)
    assert by_id(timeline.clamp_transitions(clips), "transition_ns") == {1: (0,), 2: (10,), 3: (0,), 4: (0,)}
    for bad in (lambda: timeline.remove_clip(clips, 99), lambda: timeline.split_clip(clips, 1, 100), lambda: timeline.move_clip_to_beat(clips, 1, (1, 1), None), lambda: timeline.trim_clip(clips, 1, 5, 5)):
        with pytest.raises(timeline.EditError):
            bad()


def test_locks_tracks_effects(spark, clips):
    tracks = spark.createDataFrame([(1, "video", True), (2, "audio", False)], "track_id long, kind string, lock boolean")
    assert timeline.locked(clips, tracks, [1]) and not timeline.locked(clips, tracks, [3])
    left, rest = timeline.remove_track(tracks, clips, 1)
    assert left.count() == 1 and rest.count() == 1
    assert timeline.set_where(tracks, "track_id", 1, {"lock": False}).filter("lock").count() == 0
    effects = spark.createDataFrame([(1, 0, 10, "blur"), (1, 1, 11, "glow")], "clip_id long, pos long, effect_id long, kind string")
    new = spark.createDataFrame([("vignette",)], "kind string").withColumns({c: F.lit(None).cast("long") for c in ("clip_id", "pos", "effect_id")}).select("clip_id", "pos", "effect_id", "kind")
    more = timeline.add_effect(effects, new, 1)
    assert sorted((r.pos, r.effect_id) for r in more.collect()) == [(0, 10), (1, 11), (2, 12)]
    assert sorted((r.pos, r.effect_id) for r in timeline.reorder_effects(effects, 1, [11, 10]).collect()) == [(0, 11), (1, 10)]
    with pytest.raises(timeline.EditError):
        timeline.reorder_effects(effects, 1, [11])
    lines = spark.createDataFrame([(1, 640, 360, 30, 1)], "timeline_id long, canvas_w int, canvas_h int, fps_num int, fps_den int")
    assert timeline.set_frame_rate(lines, 1, 25, 1).first().fps_num == 25 and timeline.set_canvas(lines, 1, 10, 20).first().canvas_h == 20
    for bad in (lambda: timeline.set_frame_rate(lines, 1, 0, 1), lambda: timeline.set_canvas(lines, 1, 0, 1)):
        with pytest.raises(timeline.EditError):
            bad()


def test_overlaps_and_empty_tables(spark, clips):
    late = clips.withColumn("offset_ns", F.when(F.col("clip_id") == 2, 50).otherwise(F.col("offset_ns")).cast("long"))
    assert [tuple(r) for r in timeline.overlaps(late).collect()] == [(1, 1, 2)]
    none = clips.limit(0)
    assert timeline.overlaps(none).count() == 0 and timeline.composition_end(none, spark.createDataFrame([], TRACKS), 30).count() == 0


def test_motion_trail_starts_anew(spark):
    f = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [0.0]), (1, 2, [0.0, 0.0])], "stream_id long, frame_no long, plane array<double>")
    assert [r.plane for r in pixels.motion_trail(f, 0.5).orderBy("frame_no").collect()] == [[1.0], [0.5], [0.0, 0.0]]


def test_fan_out_delivers_to_all(spark):
    seen = []
    deliver = live.fan_out([lambda b, n: (_ for _ in ()).throw(RuntimeError("down")), lambda b, n: seen.append(b.count())])
    with pytest.raises(RuntimeError, match="target 0: down"):
        deliver(spark.range(3), 0)
    assert seen == [3]


def test_empty_clips_overlap_only_from_inside(spark, clips):
    rows = [(1, 1, 0, None, "file", 0, 100, 0, 1.0, 0, 0, 0, 0), (1, 2, 1, None, "file", 5, 5, 40, 1.0, 0, 0, 0, 0), (1, 3, 2, None, "file", 5, 5, 100, 1.0, 0, 0, 0, 0), (1, 4, 3, None, "file", 0, 10, 40, 1.0, 0, 0, 0, 0)]
    got = {tuple(r)[1:] for r in timeline.overlaps(spark.createDataFrame(rows, CLIPS), width=7).collect()}
    assert got == {(1, 2), (1, 4)}  # 3 starts where 1 ends; 2 and 4 start together, and an empty clip holds nothing


def test_composition_end(spark):
    ns = 10**9
    clip = lambda track, i, end, at: (track, i, i, None, "file", 0, end, at, 1.0, 0, 0, 0, 0)
    tracks = spark.createDataFrame([(1, 1, "video", False, False, True), (1, 2, "audio", False, False, True), (1, 3, "video", True, False, True), (2, 4, "video", False, False, True), (3, 5, "video", False, False, True), (4, 6, "video", False, True, True), (4, 7, "video", False, False, True)], TRACKS)
    clips = spark.createDataFrame([clip(1, 1, ns, 1_125_000_000), clip(2, 2, 99 * ns, 0), clip(3, 3, 50 * ns, 0), clip(4, 4, None, 0), clip(6, 5, ns // 2, 0), clip(7, 6, 9 * ns, 0)], CLIPS)
    got = {r.timeline_id: r.frames for r in timeline.composition_end(clips, tracks, 30).collect()}
    assert got == {1: 64, 2: None, 3: None, 4: 15}  # 1.125 s rounds to 34 frames
    with pytest.raises(ValueError):
        timeline.composition_end(clips, tracks, 0)


def test_validate_fades_speed_and_rate(spark):
    clip = lambda i, fade_in, fade_out, speed: (i, i, 0, None, "file", 0, 100, 0, speed, fade_in, fade_out, 0, 0)
    clips = spark.createDataFrame([clip(1, 60, 60, 1.0), clip(2, 60, 0, 2.0), clip(3, 0, 101, 1.0), clip(4, 0, 0, float("inf")), clip(5, 50, 50, 2.0)], CLIPS)
    lines = spark.createDataFrame([(1, 30, 1), (2, 0, 1), (3, 30, 0), (4, -1, -1)], "timeline_id long, fps_num int, fps_den int")
    got = sorted((r.rule, r.clip_id) for r in timeline.validate(clips, spark.createDataFrame([], TRACKS), lines).collect())
    assert got == [("degenerate_frame_rate", None)] * 2 + [("degenerate_speed", 4), ("fade_longer_than_clip", 2), ("fade_longer_than_clip", 3)]


def test_curve_is_steffens():
    table = np.array(colour.curve_table([(0, 0), (0.5, 0.8), (1, 1)]))
    assert table[0] == 0 and table[-1] == 1 and (np.diff(table) >= 0).all()
    assert np.allclose(colour.curve_table([(0, 0), (1, 1)]), np.linspace(0, 1, 256))
    assert np.allclose(colour.curve_table([(0.3, 0.4)]), np.linspace(0, 1, 256))
    peak = np.array(colour.curve_table([(0, 0.2), (0.5, 0.9), (1, 0.2)]))
    assert peak.max() <= 0.9 and abs(peak[127] - 0.9) < 1e-3  # no overshoot
    assert colour.curve_table([(0.5, 0.1), (0.5, 0.9), (1, 0.1)])[200] == pytest.approx(0.1)


def test_wheels_and_grain(spark):
    grey = tuple(F.lit(v) for v in (0.2, 0.5, 0.9))
    assert one(spark, *colour.wheels(grey, 0.0, 1.0, 1.0)) == pytest.approx((0.2, 0.5, 0.9))
    dark = tuple(F.lit(0.0) for _ in range(3))
    assert one(spark, *colour.wheels(dark, (0.1, 0.2, 0.3), 1.0, 2.0)) == pytest.approx((0.1, 0.2, 0.3))

    def wang(x):
        x = (x ^ 61 ^ (x >> 16)) * 9 & 0xFFFFFFFF
        x = (x ^ (x >> 4)) * 0x27D4EB2D & 0xFFFFFFFF
        return x ^ (x >> 15)

    for seed in (0, 1, 123_456_789, 0xFFFFFFFF):
        assert one(spark, colour.wang_hash(lit(seed))) == (wang(seed),)


def test_waveform_starts_at_zero(spark):
    s = spark.createDataFrame([(1, 500, 0.5), (1, 700, -1.0), (2, -150, 0.25), (2, 10, 0.5)], "s long, t long, v double")
    got = {(r.s, r.bucket): r.peak for r in analysis.waveform(s, ["s"], "t", "v", 100).collect()}
    assert got == {**{(1, b): 0.0 for b in range(8)}, (1, 5): 0.5, (1, 7): 1.0, (2, -2): 0.25, (2, -1): 0.0, (2, 0): 0.5}
    with pytest.raises(ValueError):
        analysis.waveform(s, ["s"], "t", "v", 0)


def test_ratio_of_fibonacci_neighbours(spark):
    a, b = 1, 1
    while b < 1 << 61:
        a, b = b, a + b
    r = one(spark, tm.reduce_ratio(lit(2 * a), lit(2 * b)))[0]
    assert (r.num, r.den) == (a, b)


def test_subtitle_file_without_events(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nHi\n")
    (tmp_path / "b.srt").write_text("nothing\n")
    with pytest.raises(Exception, match="no subtitle events"):
        subtitles.read(spark, str(tmp_path)).collect()
    assert subtitles.read(spark, str(tmp_path), strict=False).count() == 1


def test_locked_tracks_refuse_edits(spark, clips):
    tracks = spark.createDataFrame([(1, False), (2, True)], "track_id long, lock boolean")
    refused = lambda edit, **of: timeline.guarded(clips, tracks, edit, lambda c: c, **of)
    for edit, of in (("move", {"clip_ids": [1]}), ("trim", {"clip_ids": [3]}), ("remove", {"clip_ids": [3]}), ("move_to_track", {"clip_ids": [2], "track_ids": [2]}), ("group", {"clip_ids": [2, 3]}), ("add", {"track_ids": [2]})):
        with pytest.raises(timeline.EditError, match="track 2 is locked"):
            refused(edit, **of)
    for edit, of in (("remove", {"clip_ids": [1]}), ("move", {"clip_ids": [2]}), ("set_lock", {}), ("add", {"track_ids": [1]})):
        assert refused(edit, **of) is clips
    with pytest.raises(ValueError):
        refused("dance", clip_ids=[1])


def test_loudness_of_a_full_scale_tone(spark):
    rate = 48_000
    s = spark.range(rate * 3).select(F.lit(1).alias("s"), F.col("id").alias("n"), F.sin(F.col("id") * (2 * math.pi * 997 / rate)).alias("value"))
    weighted = audio.k_weighted(s, ["s"], rate, block=rate)
    whole = audio.k_weighted(s, ["s"], rate, block=1 << 20)
    both = weighted.withColumnRenamed("value", "a").join(whole, ["s", "n"]).agg(F.count("*"), F.max(F.abs(F.col("a") - F.col("value")))).first()
    assert both[0] == rate * 3 and both[1] < 1e-9  # cut into blocks or not
    assert audio.loudness(weighted, ["s"], "n", rate // 10).first().lufs == pytest.approx(-3.01, abs=0.02)
    silent = s.withColumn("value", F.lit(0.0))
    assert audio.loudness(silent, ["s"], "n", rate // 10).first().lufs is None


def test_thumbnails_and_chapters(spark):
    rows = spark.createDataFrame([(1, t) for t in (0, 40, 41, 100)] + [(2, 0)], "s long, t long")
    k = rows.withColumn("k", F.col("t"))
    got = {(r.s, r.i): (r.at, r.t) for r in segments.thumbnails(k, ["s"], "t", 3, ["k"]).collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (33, 0), (1, 2): (66, 41)}  # a group that lasts no time has none
    got = {r.i: (r.at, r.t) for r in segments.thumbnails(k, ["s"], "t", 6, ["k"], key=F.col("t") != 41).collect()}
    assert got == {i: (16 * i, 0 if i < 3 else 40) for i in range(6)}
    with pytest.raises(ValueError):
        segments.thumbnails(rows, ["s"], "t", 0, ["t"])
    marks = spark.createDataFrame([("a", 0, "x"), ("a", 50, "y"), ("a", 100, "late")], "path string, start_ns long, title string")
    ends = spark.createDataFrame([("a", 80)], "path string, duration_ns long")
    assert [tuple(r)[1:] for r in catalogue.chapters(marks, ends).orderBy("number").collect()] == [(1, 0, 50, "x"), (2, 50, 80, "y")]
