"""Frames as planes against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import pixels, planes

KIND = "frame_no long, w int, h int, r array<double>, g array<double>, b array<double>"


def frames(spark, rows, kind=KIND):
    return spark.createDataFrame(rows, kind)


def noisy(n, w, h, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, w, h, *(rng.random(w * h).tolist() for _ in range(3))) for i in range(n)]


def plane(df, no=0, c="r"):
    r = df.filter(F.col("frame_no") == no).first()
    return np.array(r[c]).reshape(r.h, r.w)


def test_same_as_by_pixels(spark):
    f = frames(spark, noisy(2, 7, 5))
    px = planes.to_pixels(f)
    pairs = [
        (planes.blur(f, 1.3), pixels.blur(px, 1.3)), (planes.unsharp(f, 0.7), pixels.unsharp(px, 0.7)), (planes.glow(f, 0.5, 1.0, 1.5), pixels.glow(px, 0.5, 1.0, 1.5)),
        (planes.glow(f, 0.5, 1.0, 1.5, hard=True), pixels.glow(px, 0.5, 1.0, 1.5, hard=True)), (planes.rotate(f, 25.0), pixels.rotate(px, 7, 5, 25.0)),
        (planes.lens(f, 0.1, 0.05), pixels.lens(px, 7, 5, 0.1, 0.05)),
    ]
    for a, b in pairs:
        both = planes.to_pixels(a).join(b.select("frame_no", "x", "y", *(F.col(c).alias(f"_{c}") for c in "rgb")), ["frame_no", "x", "y"])
        got = both.agg(F.count("*"), *(F.max(F.abs(F.col(c) - F.col(f"_{c}"))) for c in "rgb")).first()
        assert got[0] == 70 and max(got[1:]) < 1e-12


def test_work_within_a_frame_has_no_shuffle(spark):
    f = frames(spark, noisy(1, 4, 4))
    for out in (planes.blur(f, 1.0), planes.unsharp(f, 0.5), planes.glow(f, 0.5, 1.0, 1.0), planes.place(f, (0.1, 0), 0.2, (1, 1)), planes.non_local_means(f, 0.1, 3, 3)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_large_frames_parameters_and_nulls(spark):
    big = spark.range(2).select(F.col("id").alias("frame_no"), F.lit(1920).alias("w"), F.lit(1080).alias("h"), F.transform(F.sequence(F.lit(0), F.lit(1920 * 1080 - 1)), lambda i: (i % 97).cast("double")).alias("r"), (F.col("id") * 2.0).alias("s"))
    got = planes.blur(big, "s", ["r"]).select("frame_no", F.element_at("r", 5000).alias("v"), F.size("r").alias("n")).orderBy("frame_no").collect()
    assert [r.n for r in got] == [1920 * 1080] * 2 and got[0].v == 4999 % 97 and got[1].v != got[0].v
    f = frames(spark, [(0, 2, 2, None, [1.0] * 4, [1.0] * 4), (1, 1, 1, [0.5], [0.5], [0.5])])
    assert [r.r for r in planes.blur(f, 1.0).orderBy("frame_no").collect()] == [None, [0.5]]
    assert planes.blur(f.limit(0), 1.0).count() == 0


def test_luma_and_chroma_are_sharpened_apart(spark):
    f = frames(spark, noisy(1, 6, 6)).withColumnsRenamed({"r": "y", "g": "u", "b": "v"})
    out = planes.unsharp_luma_chroma(f, 1.5, 0.0)
    y = plane(f, c="y")
    mean = np.array([[y[max(0, j - 2) : j + 3, max(0, i - 2) : i + 3].mean() for i in range(6)] for j in range(6)])
    assert np.allclose(plane(out, c="y"), y + 1.5 * (y - mean)) and np.array_equal(plane(out, c="u"), plane(f, c="u"))
    with pytest.raises(ValueError):
        planes.unsharp_luma_chroma(f, 6.0, 0.0)


def test_place_undoes_zoom_turn_move(spark):
    f = frames(spark, noisy(1, 9, 6, 4))
    move, turn, zoom = (0.12, -0.2), 0.4, (1.5, 0.7)
    out = planes.place(f, move, turn, zoom)
    x, got, shown = plane(f), plane(out), plane(out, c="a")
    for j in range(6):
        for i in range(9):
            u, v = ((i + 0.5) / 9 - 0.5) / zoom[0], ((j + 0.5) / 6 - 0.5) / zoom[1]
            u, v = u * math.cos(-turn) - v * math.sin(-turn), u * math.sin(-turn) + v * math.cos(-turn)
            u, v = u + 0.5 - move[0], v + 0.5 - move[1]
            inside = 0 <= u <= 1 and 0 <= v <= 1
            px, py = min(8, max(0, u * 9 - 0.5)), min(5, max(0, v * 6 - 0.5))
            want = sum(x[q, p] * max(0, 1 - abs(p - px)) * max(0, 1 - abs(q - py)) for q in range(6) for p in range(9)) if inside else 0.0
            assert shown[j, i] == inside and abs(got[j, i] - want) < 1e-9


def test_ssim_by_windows(spark):
    rng = np.random.default_rng(9)
    a = [(i, 12, 10, rng.integers(0, 256, 120).astype(float).tolist()) for i in range(2)] + [(2, 3, 3, [1.0] * 9)]
    b = [(i, w, h, (np.array(v) * 0.8 + 20).tolist()) for i, w, h, v in a]
    kind = "frame_no long, w int, h int, r array<double>"
    got = {r.frame_no: r.ssim for r in planes.ssim(frames(spark, a, kind), frames(spark, b, kind), "r", 4, 3).collect()}
    assert got[2] is None
    for i in (0, 1):
        x, y = np.array(a[i][3]).reshape(10, 12), np.array(b[i][3]).reshape(10, 12)
        each = []
        for j in range(0, 7, 3):
            for k in range(0, 9, 3):
                u, v = x[j : j + 4, k : k + 4], y[j : j + 4, k : k + 4]
                c = ((u - u.mean()) * (v - v.mean())).mean()
                each.append((2 * u.mean() * v.mean() + 6.5025) * (2 * c + 58.5225) / ((u.mean() ** 2 + v.mean() ** 2 + 6.5025) * (u.var() + v.var() + 58.5225)))
        assert got[i] == pytest.approx(np.mean(each), abs=1e-9)
    with pytest.raises(Exception, match="frame sizes differ"):
        planes.ssim(frames(spark, a, kind), frames(spark, [(0, 1, 1, [1.0])], kind), "r").collect()


def test_non_local_means(spark):
    f = frames(spark, noisy(1, 6, 5, 3))
    x = plane(f)
    at = lambda j, i: x[min(4, max(0, j)), min(5, max(0, i))]
    want = np.zeros((5, 6))
    for j in range(5):
        for i in range(6):
            total = weight = 0.0
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    d = sum((at(j + q, i + p) - at(j + dy + q, i + dx + p)) ** 2 for q in (-1, 0, 1) for p in (-1, 0, 1))
                    k = math.exp(-d / 9 / 0.2**2)
                    total, weight = total + k * at(j + dy, i + dx), weight + k
            want[j, i] = total / weight
    assert np.abs(plane(planes.non_local_means(f, 0.2, 3, 5)) - want).max() < 1e-9


def slow_deinterlace(cur, prev, nxt, field, top_first, spatial):
    """Pixel by pixel."""
    h, w = cur.shape
    keep = field if top_first else 1 - field
    prev2, next2 = (prev, cur) if field == 0 else (cur, nxt)
    row = lambda i: -i if i < 0 else 2 * (h - 1) - i if i >= h else i
    col = lambda i: min(w - 1, max(0, i))
    out = cur.copy()
    for y in range(1 - keep, h, 2):
        up, down = row(y - 1), row(y + 1)
        for x in range(w):
            c, e, d = cur[up, x], cur[down, x], (prev2[y, x] + next2[y, x]) / 2
            diff = max(abs(prev2[y, x] - next2[y, x]) / 2, (abs(prev[up, x] - c) + abs(prev[down, x] - e)) / 2, (abs(nxt[up, x] - c) + abs(nxt[down, x] - e)) / 2)
            score = lambda j: sum(abs(cur[up, col(x + k + j)] - cur[down, col(x + k - j)]) for k in (-1, 0, 1))
            best, guess = score(0) - 1 / 255, (c + e) / 2
            for side in (-1, 1):
                for j in (side, 2 * side):
                    if score(j) >= best:
                        break
                    best, guess = score(j), (cur[up, col(x + j)] + cur[down, col(x - j)]) / 2
            if spatial:
                b, f = ((prev2[row(y + k), x] + next2[row(y + k), x]) / 2 for k in (-2, 2))
                top, low = max(d - e, d - c, min(b - c, f - e)), min(d - e, d - c, max(b - c, f - e))
                diff = max(diff, low, -top)
            out[y, x] = min(max(guess, d - diff), d + diff)
    return out


@pytest.mark.parametrize("mode", ["frame", "field", "frame_nospatial", "field_nospatial"])
@pytest.mark.parametrize("top_first", [True, False])
def test_deinterlacing_follows_moving_edges(spark, mode, top_first):
    def edge(t, w=14, h=10):  # a slanted edge that moves on
        y, x = np.indices((h, w))
        return np.where(x + y * 0.7 > 6 + 2 * t, 1.0, 0.0) + 0.05 * np.sin(x * y)

    shots = [edge(i) for i in range(4)]
    rows = [(i, 14, 10, s.ravel().tolist()) for i, s in enumerate(shots) if i != 2]
    got = planes.deinterlace(frames(spark, rows, "frame_no long, w int, h int, r array<double>"), mode, top_first, ["r"])
    have = {0: shots[0], 1: shots[1], 3: shots[3]}
    seen = 0
    for r in got.collect():
        cur = have[r.frame_no]
        want = slow_deinterlace(cur, have.get(r.frame_no - 1, cur), have.get(r.frame_no + 1, cur), r.field, top_first, not mode.endswith("_nospatial"))
        assert np.abs(np.array(r.r).reshape(10, 14) - want).max() < 1e-12
        seen += 1
    assert seen == (3 if mode.startswith("frame") else 6)
    with pytest.raises(ValueError):
        planes.deinterlace(got, "none")


FORMATS = list(planes.CHROMA)


def test_stored_formats(spark):
    rng = random.Random(4)
    for w, h in ((5, 3), (4, 4), (1, 1)):
        for have in FORMATS:
            size = sum(a * b for a, b in planes.plane_sizes(have, w, h))
            data = bytes(rng.randrange(256) for _ in range(size))
            assert planes.pack(planes.unpack(data, have, w, h), have) == data == planes.converted(data, have, have, w, h)
            for want in FORMATS:
                out = planes.converted(data, have, want, w, h)
                assert len(out) == sum(a * b for a, b in planes.plane_sizes(want, w, h))
                small = planes.converted(data, have, want, w, h, (2, 6))
                assert len(small) == sum(a * b for a, b in planes.plane_sizes(want, 2, 6))
    assert planes.converted(bytes(range(9)) + bytes([1, 2, 5, 8]) + bytes(4), "yuv420p", "yuv444p", 3, 3)[9:18] == bytes([1, 1, 2, 1, 1, 2, 5, 5, 8])
    assert planes.converted(bytes(9) + bytes([1, 2, 9, 3, 4, 9, 7, 8, 10]) + bytes(9), "yuv444p", "yuv420p", 3, 3)[9:13] == bytes([3, 9, 8, 10])
    grey = planes.converted(bytes([7, 7, 7]), "rgb24", "yuv444p", 1, 1)
    assert grey == bytes([7, 128, 128]) and planes.converted(grey, "yuv444p", "rgb24", 1, 1) == bytes([7, 7, 7])
    with pytest.raises(ValueError):
        planes.converted(b"1", "rgb24", "gray", 1, 1)
    with pytest.raises(ValueError):
        planes.plane_sizes("yuv410p", 1, 1)


def test_scan_as_decodes_only_what_is_needed(spark):
    df = spark.createDataFrame([(1, "gray", 6, 4, bytearray(range(24))), (2, "gray", 1, 1, None)], "k long, format string, w int, h int, data binary")
    out = planes.scan_as(df, "rgb24", width=3)
    assert [(r.w, r.h, r.format) for r in out.collect()] == [(3, 2, "rgb24"), (3, 4, "rgb24")]
    assert bytes(out.first().data)[:9] == bytes([0, 0, 0, 2, 2, 2, 4, 4, 4])
    assert "Arrow" not in out.select("k", "w")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        planes.scan_as(df, "rgb24", width=0)
