"""Operators on frames as rows: (frame_no, w, h, and a plane array<double> of w * h values, row by row, for each channel).

Work within a frame is a vectorised kernel in ``mapInArrow``: no shuffle, no row a pixel, and Arrow's bytes per batch
(spark.sql.execution.arrow.maxBytesPerBatch) bound how many frames a task holds. Kernels take and give a dict of
two-dimensional arrays. Work on neighbouring frames first meets them by an equi-join of rows of frames.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RGB = ["r", "g", "b"]
Planes = dict[str, np.ndarray]


def _array(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def mapped(frames: DataFrame, kernel: Callable, planes: list[str], out: list[str] | None = None, params: list[str] = (), keep: list[str] | None = None) -> DataFrame:
    """(keep, w, h, out): ``kernel(planes, *params)`` of each frame; ``keep`` defaults to all other columns, ``out`` to the
    planes. Frames of which a plane is null give null planes."""
    out = planes if out is None else out
    keep = [c for c in frames.columns if c not in {*planes, *out, "w", "h"}] if keep is None else keep
    n_keep, n_params = len(keep), len(params)
    slim = frames.select(*keep, "w", "h", *(F.col(c).alias(f"_p{i}") for i, c in enumerate(params)), *planes)
    kinds = ", ".join(f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.columns
            w, h = (cols[n_keep + i].to_pylist() for i in (0, 1))
            values = [cols[n_keep + 2 + i].to_pylist() for i in range(n_params)]
            sizes, made = [], [[] for _ in out]
            for i in range(batch.num_rows):
                own = cols[n_keep + 2 + n_params :]
                if any(not c[i].is_valid for c in own):
                    sizes.append((w[i], h[i]))
                    for x in made:
                        x.append(None)
                    continue
                got = kernel({c: _array(p, i).reshape(h[i], w[i]) for c, p in zip(planes, own)}, *(v[i] for v in values))
                shape = got[out[0]].shape
                sizes.append((shape[1], shape[0]))
                for c, x in zip(out, made):
                    x.append(np.ascontiguousarray(got[c], float).ravel())
            arrays = [*cols[:n_keep], *(pa.array([s[k] for s in sizes], pa.int32()) for k in (0, 1)), *(pa.array(x, pa.list_(pa.float64())) for x in made)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "w", "h", *out])

    return slim.mapInArrow(run, ", ".join([*([kinds] if kinds else []), "w int, h int", *(f"`{c}` array<double>" for c in out)]))


def per_plane(f: Callable) -> Callable:
    return lambda planes, *params: {c: f(x, *params) for c, x in planes.items()}


def to_pixels(frames: DataFrame, planes: list[str] = RGB, keep: list[str] | None = None) -> DataFrame:
    """(keep, x, y, planes): a row a pixel."""
    keep = ["frame_no"] if keep is None else keep
    each = frames.select(*keep, "w", F.posexplode(F.arrays_zip(*planes)).alias("_i", "_v"))
    return each.select(*keep, (F.col("_i") % F.col("w")).cast("int").alias("x"), F.floor(F.col("_i") / F.col("w")).cast("int").alias("y"), *(F.col("_v")[c].alias(c) for c in planes))


# ---- stencils --------------------------------------------------------------------------------------------------------


def along(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    """A weighted moving sum; at the border the weights that are left count."""
    reach, n = len(taps) // 2, x.shape[axis]
    x = np.moveaxis(x, axis, 0)
    total, weight = np.zeros(x.shape), np.zeros((n,) + (1,) * (x.ndim - 1))
    for i, k in zip(range(-reach, reach + 1), taps):
        lo, hi = max(0, -i), min(n, n - i)
        if lo < hi:
            total[lo:hi] += k * x[lo + i : hi + i]
            weight[lo:hi] += k
    return np.moveaxis(total / weight, 0, axis)


def gaussian(sigma: float, reach: int | None = None) -> np.ndarray:
    i = np.arange(-(r := reach or max(1, math.ceil(3 * sigma))), r + 1)
    return np.exp(-(i * i) / (2 * sigma * sigma)) if sigma > 0 else (i == 0).astype(float)


def blurred(x: np.ndarray, sigma: float, reach: int | None = None) -> np.ndarray:
    taps = gaussian(sigma, reach)
    return along(along(x, taps, 1), taps, 0)


def blur(frames: DataFrame, sigma: float | str, planes: list[str] = RGB, reach: int | None = None) -> DataFrame:
    """Separable Gaussian by a number or a column of frames; none where it isn't above 0."""
    if isinstance(sigma, str):
        return mapped(frames, lambda p, s: {c: blurred(x, s, reach) for c, x in p.items()}, planes, params=[sigma])
    return mapped(frames, per_plane(lambda x: blurred(x, sigma, reach)), planes)


def boxed(x: np.ndarray, size: int) -> np.ndarray:
    taps = np.full(size, 1.0)
    return along(along(x, taps, 1), taps, 0)


def unsharp(frames: DataFrame, amount: float | str, planes: list[str] = RGB, size: int = 5) -> DataFrame:
    """v + amount * (v - mean of ``size`` by ``size``); the amount may be a column of frames."""
    f = lambda p, a: {c: x + a * (x - boxed(x, size)) for c, x in p.items()}
    return mapped(frames, f, planes, params=[amount]) if isinstance(amount, str) else mapped(frames, lambda p: f(p, amount), planes)


def unsharp_luma_chroma(frames: DataFrame, luma: float, chroma: float, size: int = 5, planes: tuple[str, str, str] = ("y", "u", "v")) -> DataFrame:
    """Sharpened by one amount for the first plane and one for the others (within [-1.5, 1.5]); an amount below 0 blurs."""
    if not all(-1.5 <= a <= 1.5 for a in (luma, chroma)) or size % 2 == 0:
        raise ValueError("amounts lie within [-1.5, 1.5], sizes are odd")
    amounts = dict(zip(planes, (luma, chroma, chroma)))
    return mapped(frames, lambda p: {c: x + amounts[c] * (x - boxed(x, size)) if amounts[c] else x for c, x in p.items()}, list(planes))


def glow(frames: DataFrame, threshold: float, radius: float, intensity: float | str, hard: bool = False) -> DataFrame:
    """Highlights, blurred and added: what each channel has above the threshold, or (``hard``) the pixels whose luma
    reaches it."""
    sigma = min(50.0, max(0.5, radius))

    def kernel(p: Planes, amount: float = 0.0) -> Planes:
        if hard:
            shown = 0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"] >= threshold
            high = {c: np.where(shown, x, 0.0) for c, x in p.items()}
        else:
            high = {c: np.maximum(x - threshold, 0.0) / max(1e-9, 1 - threshold) for c, x in p.items()}
        by = min(2.0, max(0.0, amount if isinstance(intensity, str) else intensity))
        return {c: np.minimum(1.0, p[c] + blurred(high[c], sigma) * by) for c in p}

    return mapped(frames, kernel, RGB, params=[intensity] if isinstance(intensity, str) else [])


# ---- places ----------------------------------------------------------------------------------------------------------


def nearest(x: np.ndarray, sx: np.ndarray, sy: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """The pixels of ``x`` nearest to the places (halves away from zero); ``fill`` outside."""
    away = lambda v: (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)
    cx, cy = away(sx), away(sy)
    inside = (cx >= 0) & (cx < x.shape[1]) & (cy >= 0) & (cy < x.shape[0])
    return np.where(inside, x[np.clip(cy, 0, x.shape[0] - 1), np.clip(cx, 0, x.shape[1] - 1)], fill)


def linear(x: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Between the four pixels about the places; beyond the border it repeats."""
    h, w = x.shape
    sx, sy = np.clip(sx, 0, w - 1), np.clip(sy, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(np.int64), max(0, w - 2)), np.minimum(sy.astype(np.int64), max(0, h - 2))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = sx - x0, sy - y0
    top, bottom = x[y0, x0] * (1 - fx) + x[y0, x1] * fx, x[y1, x0] * (1 - fx) + x[y1, x1] * fx
    return top * (1 - fy) + bottom * fy


def _grid(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.indices(x.shape, float)
    return x, y


def rotate(frames: DataFrame, degrees: float | str, planes: list[str] = RGB, fill: float = 0.0) -> DataFrame:
    """Turned about the middle; the angle may be a column of frames."""

    def kernel(p: Planes, angle: float) -> Planes:
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        gx, gy = _grid(next(iter(p.values())))
        h, w = gx.shape
        dx, dy = gx - (w - 1) / 2, gy - (h - 1) / 2
        return {k: nearest(v, dx * c + dy * s + (w - 1) / 2, dy * c - dx * s + (h - 1) / 2, fill) for k, v in p.items()}

    return mapped(frames, kernel, planes, params=[degrees]) if isinstance(degrees, str) else mapped(frames, lambda p: kernel(p, degrees), planes)


def lens(frames: DataFrame, k1: float, k2: float, planes: list[str] = RGB) -> DataFrame:
    """Radial distortion taken out."""

    def kernel(p: Planes) -> Planes:
        gx, gy = _grid(next(iter(p.values())))
        h, w = gx.shape
        dx, dy = (gx - (w - 1) / 2) / (w / 2), (gy - (h - 1) / 2) / (h / 2)
        r2 = dx * dx + dy * dy
        f = 1 + k1 * r2 + k2 * r2 * r2
        return {k: nearest(v, dx * f * (w / 2) + (w - 1) / 2, dy * f * (h / 2) + (h - 1) / 2) for k, v in p.items()}

    return mapped(frames, kernel, planes)


def place(frames: DataFrame, move: tuple[float, float], radians: float, zoom: tuple[float, float], planes: list[str] = RGB) -> DataFrame:
    """Moved (in units of the picture, right and down), then turned and zoomed about the middle of the view: a point of the
    view is looked up by undoing the zoom, then the turn, then the move, between pixels. Plane ``a`` is 1 inside the
    picture; outside all planes are 0."""
    c, s = math.cos(radians), math.sin(radians)

    def kernel(p: Planes) -> Planes:
        gx, gy = _grid(next(iter(p.values())))
        h, w = gx.shape
        u, v = ((gx + 0.5) / w - 0.5) / max(zoom[0], 1e-4), ((gy + 0.5) / h - 0.5) / max(zoom[1], 1e-4)
        u, v = u * c + v * s + 0.5 - move[0], v * c - u * s + 0.5 - move[1]
        inside = (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)
        return {k: np.where(inside, linear(x, u * w - 0.5, v * h - 0.5), 0.0) for k, x in p.items()} | {"a": inside.astype(float)}

    return mapped(frames, kernel, planes, [*planes, "a"])


# ---- summed areas ----------------------------------------------------------------------------------------------------


def areas(x: np.ndarray) -> np.ndarray:
    """Sums over all rectangles from the corner: one row and column more than ``x``."""
    out = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    np.cumsum(np.cumsum(x, 0), 1, out=out[1:, 1:])
    return out


def windows(x: np.ndarray, size: int, step: int = 1) -> np.ndarray:
    """Sums over the windows of ``size`` by ``size`` at every ``step``."""
    s = areas(x)
    whole = s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]
    return whole[::step, ::step]


def pairs(a: DataFrame, b: DataFrame, planes: list[str], by: list[str] = ("frame_no",)) -> DataFrame:
    """Frames of ``a`` with those of ``b`` as planes called _name; raises when executed if their sizes differ."""
    other = b.select(*by, F.col("w").alias("_w"), F.col("h").alias("_h"), *(F.col(c).alias(f"_{c}") for c in planes))
    both = a.select(*by, "w", "h", *planes).join(other, list(by))
    same = F.when((F.col("w") == F.col("_w")) & (F.col("h") == F.col("_h")), F.col("w")).otherwise(F.raise_error(F.lit("frame sizes differ")).cast("int"))
    return both.withColumn("w", same).drop("_w", "_h")


def ssim(a: DataFrame, b: DataFrame, plane: str, size: int = 8, step: int = 4, peak: float = 255.0, by: list[str] = ("frame_no",)) -> DataFrame:
    """(by, ssim): structural similarity over windows of ``size`` at every ``step``, averaged; smaller frames have none."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2

    def kernel(p: Planes) -> Planes:
        u, v = p[plane], p[f"_{plane}"]
        if min(u.shape) < size:
            return {"_s": np.full((1, 1), np.nan)}
        n = size * size
        mu, mv, uu, vv, uv = (windows(x, size, step) / n for x in (u, v, u * u, v * v, u * v))
        return {"_s": ((2 * mu * mv + c1) * (2 * (uv - mu * mv) + c2) / ((mu * mu + mv * mv + c1) * (uu - mu * mu + vv - mv * mv + c2))).mean(keepdims=True)}

    scored = mapped(pairs(a, b, [plane], by), kernel, [plane, f"_{plane}"], ["_s"], keep=list(by))
    return scored.select(*by, F.nanvl(F.col("_s")[0], F.lit(None).cast("double")).alias("ssim"))


def non_local_means(frames: DataFrame, strength: float, patch: int = 7, search: int = 15, planes: list[str] = RGB) -> DataFrame:
    """Each pixel the mean of those around it (``search`` by ``search``), weighed by exp(-d / strength^2), d being the mean
    squared difference of the patches (``patch`` by ``patch``) about both; borders repeat. A shift of the whole frame is
    compared at once, its patches by summed areas."""
    if patch % 2 == 0 or search % 2 == 0 or strength <= 0:
        raise ValueError("patch and search are odd, the strength is above 0")
    p, s = patch // 2, search // 2

    def kernel(x: np.ndarray) -> np.ndarray:
        h, w = x.shape
        wide = np.pad(x, p + s, "edge")
        total, weight = np.zeros(x.shape), np.zeros(x.shape)
        own = wide[s : s + h + 2 * p, s : s + w + 2 * p]
        for dy in range(2 * s + 1):
            for dx in range(2 * s + 1):
                other = wide[dy : dy + h + 2 * p, dx : dx + w + 2 * p]
                k = np.exp(-np.maximum(windows((own - other) ** 2, patch), 0.0) / (patch * patch * strength * strength))
                total += k * other[p : p + h, p : p + w]
                weight += k
        return total / weight

    return mapped(frames, per_plane(kernel), planes)


# ---- interlaced pictures ---------------------------------------------------------------------------------------------


def _missing(cur: np.ndarray, prev: np.ndarray, nxt: np.ndarray, prev2: np.ndarray, next2: np.ndarray, y: int, spatial: bool) -> np.ndarray:
    """Row y from the rows about it and the frames before and after."""
    h, w = cur.shape
    near = lambda i: i if 0 <= i < h else (-i if i < 0 else 2 * (h - 1) - i)  # noqa: E731  rows beyond the border are mirrored
    up, down = near(y - 1), near(y + 1)
    c, e = cur[up], cur[down]
    d = (prev2[y] + next2[y]) / 2
    change = np.maximum(np.abs(prev2[y] - next2[y]) / 2, np.maximum((np.abs(prev[up] - c) + np.abs(prev[down] - e)) / 2, (np.abs(nxt[up] - c) + np.abs(nxt[down] - e)) / 2))
    wide_c, wide_e = np.pad(c, 3, "edge"), np.pad(e, 3, "edge")
    at = lambda row, k: row[3 + k : 3 + k + w]
    score = lambda j: sum(np.abs(at(wide_c, k + j) - at(wide_e, k - j)) for k in (-1, 0, 1))
    best, guess = score(0) - 1 / 255, (c + e) / 2
    for side in (-1, 1):  # along edges that lean one way or the other, the steeper only past the flatter
        going = np.ones(w, bool)
        for j in (side, 2 * side):
            going &= score(j) < best
            best, guess = np.where(going, score(j), best), np.where(going, (at(wide_c, j) + at(wide_e, -j)) / 2, guess)
    if spatial:
        b, f = ((prev2[near(y + k)] + next2[near(y + k)]) / 2 for k in (-2, 2))
        most = np.maximum.reduce([d - e, d - c, np.minimum(b - c, f - e)])
        least = np.minimum.reduce([d - e, d - c, np.maximum(b - c, f - e)])
        change = np.maximum.reduce([change, least, -most])
    return np.clip(guess, d - change, d + change)


def deinterlaced(cur: np.ndarray, prev: np.ndarray, nxt: np.ndarray, field: int, top_first: bool, spatial: bool = True) -> np.ndarray:
    """The picture at the time of the first (0) or second (1) field: its rows stay, the others are made."""
    keep = field if top_first else 1 - field  # parity of the rows that stay
    prev2, next2 = (prev, cur) if field == 0 else (cur, nxt)
    out = cur.copy()
    for y in range(1 - keep, cur.shape[0], 2):
        out[y] = _missing(cur, prev, nxt, prev2, next2, y, spatial)
    return out


def deinterlace(frames: DataFrame, mode: str = "frame", top_first: bool = True, planes: list[str] = RGB, by: list[str] = (), no: str = "frame_no") -> DataFrame:
    """Edge-directed deinterlacing over three frames (numbered one apart; one that is missing is the frame itself). Modes:
    frame (a picture a frame), field (two, with ``field`` 0 and 1), each also with _nospatial: without the check against
    the rows beyond."""
    if mode not in ("frame", "field", "frame_nospatial", "field_nospatial"):
        raise ValueError(f"unknown mode {mode!r}")
    spatial, fields = not mode.endswith("_nospatial"), [0] if mode.startswith("frame") else [0, 1]
    met = frames
    for name, step in (("prev", 1), ("next", -1)):
        other = frames.select(*by, (F.col(no) + step).alias(no), *(F.col(c).alias(f"_{name}_{c}") for c in planes), F.col("w").alias("_w"), F.col("h").alias("_h"))
        met = met.join(other, [*by, no], "left")
        same = (F.col("w") == F.col("_w")) & (F.col("h") == F.col("_h"))
        met = met.withColumns({f"_{name}_{c}": F.when(same, F.col(f"_{name}_{c}")).otherwise(F.col(c)) for c in planes}).drop("_w", "_h")
    met = met.withColumn("field", F.explode(F.array(*map(F.lit, fields))))
    kernel = lambda p, f: {c: deinterlaced(p[c], p[f"_prev_{c}"], p[f"_next_{c}"], f, top_first, spatial) for c in planes}
    every = [*planes, *(f"_{n}_{c}" for n in ("prev", "next") for c in planes)]
    return mapped(met, kernel, every, planes, params=["field"], keep=[*by, no, "field"])


# ---- stored formats --------------------------------------------------------------------------------------------------

#: By how much chroma planes are narrower and lower than luma: fixed values.
CHROMA = {"yuv420p": (2, 2), "yuv422p": (2, 1), "yuv444p": (1, 1), "nv12": (2, 2), "gray": None, "rgb24": None}


def plane_sizes(kind: str, w: int, h: int) -> list[tuple[int, int]]:
    """(width, height) of each plane that is stored; odd sizes are rounded up."""
    if kind not in CHROMA:
        raise ValueError(f"unknown format {kind!r}")
    if kind == "gray":
        return [(w, h)]
    if kind == "rgb24":
        return [(3 * w, h)]
    cw, ch = (-(-w // CHROMA[kind][0]), -(-h // CHROMA[kind][1]))
    return [(w, h), (2 * cw, ch)] if kind == "nv12" else [(w, h), (cw, ch), (cw, ch)]


def unpack(data: bytes, kind: str, w: int, h: int) -> list[np.ndarray]:
    """y, u, v (or r, g, b; or y) as bytes in the sizes stored."""
    sizes, at, out = plane_sizes(kind, w, h), 0, []
    if len(data) != (want := sum(a * b for a, b in sizes)):
        raise ValueError(f"{kind} of {w} x {h} has {want} bytes, not {len(data)}")
    flat = np.frombuffer(data, np.uint8)
    for a, b in sizes:
        out.append(flat[at : at + a * b].reshape(b, a))
        at += a * b
    if kind == "nv12":
        return [out[0], out[1][:, ::2], out[1][:, 1::2]]
    return [out[0][:, i::3] for i in range(3)] if kind == "rgb24" else out


def pack(planes: list[np.ndarray], kind: str) -> bytes:
    if kind == "nv12":
        planes = [planes[0], np.stack(planes[1:], 2).reshape(planes[1].shape[0], -1)]
    elif kind == "rgb24":
        planes = [np.stack(planes, 2)]
    return b"".join(np.ascontiguousarray(p, np.uint8).tobytes() for p in planes)


def chroma_to(x: np.ndarray, have: tuple[int, int], want: tuple[int, int], w: int, h: int) -> np.ndarray:
    """A chroma plane for another division: repeated where it gets finer, averaged (halves up, over the pixels there are)
    where it gets coarser."""
    for axis, (a, b, n) in enumerate(((have[1], want[1], h), (have[0], want[0], w))):
        if a > b:
            x = np.repeat(x, a // b, axis).take(range(-(-n // b)), axis)
        elif a < b:
            k, size = b // a, x.shape[axis]
            edges = np.arange(0, size, k)
            sums = np.add.reduceat(x.astype(np.int64), edges, axis)
            counts = np.diff(np.append(edges, size)).reshape((-1, 1) if axis == 0 else (1, -1))
            x = (2 * sums + counts) // (2 * counts)
    return x.astype(np.uint8)


def _yuv(rgb: list[np.ndarray]) -> list[np.ndarray]:
    r, g, b = (x.astype(float) for x in rgb)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return [np.clip(np.floor(v + 0.5), 0, 255).astype(np.uint8) for v in (y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128)]


def _rgb(yuv: list[np.ndarray]) -> list[np.ndarray]:
    y, u, v = (x.astype(float) for x in yuv)
    u, v = u - 128, v - 128
    return [np.clip(np.floor(c + 0.5), 0, 255).astype(np.uint8) for c in (y + 1.402 * v, y - (0.114 * 1.772 * u + 0.299 * 1.402 * v) / 0.587, y + 1.772 * u)]


def resized(x: np.ndarray, w: int, h: int) -> np.ndarray:
    """The nearest pixels: column i comes from column i * width div w."""
    return x[np.arange(h) * x.shape[0] // h][:, np.arange(w) * x.shape[1] // w]


def converted(data: bytes, have: str, want: str, w: int, h: int, size: tuple[int, int] | None = None) -> bytes:
    """A frame in another format and size (full-range BT.601 between YUV and RGB; gray is luma)."""
    planes = unpack(data, have, w, h)
    if size and size != (w, h):
        shapes = plane_sizes("yuv444p" if have == "rgb24" else "yuv420p" if have == "nv12" else have, *size)
        planes = [resized(p, *s) for p, s in zip(planes, shapes)]
        w, h = size
    if have == want:
        return pack(planes, want)
    colour = {"rgb24": "rgb", "gray": "gray"}
    a, b = colour.get(have, "yuv"), colour.get(want, "yuv")
    if a == "yuv" and b == "rgb":
        planes = _rgb([planes[0], *(chroma_to(p, CHROMA[have], (1, 1), w, h) for p in planes[1:])])
    elif a == "rgb":
        planes = _yuv(planes)
        planes = [planes[0]] if b == "gray" else [planes[0], *(chroma_to(p, (1, 1), CHROMA[want], w, h) for p in planes[1:])]
    elif a == "gray":
        grey = [np.full((y, x), 128, np.uint8) for x, y in plane_sizes("yuv420p" if want == "nv12" else want, w, h)[1:]] if b == "yuv" else []
        planes = [planes[0]] * 3 if b == "rgb" else [planes[0], *grey]
    elif b == "gray":
        planes = planes[:1]
    else:
        planes = [planes[0], *(chroma_to(p, CHROMA[have], CHROMA[want], w, h) for p in planes[1:])]
    return pack(planes, want)


def scan_as(frames: DataFrame, want: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """Frames (format, w, h, data, and other columns) in one format, and scaled if a size is asked for: one side alone keeps
    the shape, rounded to an even number. Frames whose data isn't asked for later aren't decoded: the kernel is only run
    for the columns that the plan needs."""
    if want not in CHROMA:
        raise ValueError(f"unknown format {want!r}")
    if any(v is not None and v < 1 for v in (width, height)):
        raise ValueError("a size is at least one pixel")
    even = lambda v: (F.greatest(F.lit(1), F.round(v / 2).cast("int")) * 2)
    w = F.lit(width) if width else even(F.col("w") * height / F.col("h")) if height else F.col("w")
    h = F.lit(height) if height else even(F.col("h") * width / F.col("w")) if width else F.col("h")

    @F.pandas_udf("binary")
    def convert(data, have, w, h, to_w, to_h):
        import pandas as pd

        rows = zip(data, have, w, h, to_w, to_h)
        return pd.Series([None if d is None else converted(bytes(d), k, want, int(a), int(b), (int(x), int(y))) for d, k, a, b, x, y in rows])

    return frames.withColumns({"data": convert("data", "format", "w", "h", w.cast("int"), h.cast("int")), "w": w.cast("int"), "h": h.cast("int"), "format": F.lit(want)})
