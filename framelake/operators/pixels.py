"""Operators on pixel tables: (frame_no, x, y, r, g, b[, a]) with channels as doubles in [0, 1]."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blend as B
from ..functions.colour import hsl_to_rgb, luma601, luma709, rgb_to_hsl
from . import scan

KEY = ["frame_no", "x", "y"]
RGB = ["r", "g", "b"]
MOST_PIXELS = 1 << 23


def crop(pixels: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    inside = (F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h)
    return pixels.filter(inside).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def flip(pixels: DataFrame, w: int, h: int, horizontal: bool) -> DataFrame:
    return pixels.withColumn("x", w - 1 - F.col("x")) if horizontal else pixels.withColumn("y", h - 1 - F.col("y"))


def canvas(frames: DataFrame, w: int, h: int, of: list[str] | None = None) -> DataFrame:
    """Every position of every frame, with the frame's columns ``of``."""
    own = ["frame_no", *(of or [])]
    return frames.select(*own).distinct().select(*own, F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("_i")).select(
        *own, (F.col("_i") % w).cast("int").alias("x"), F.floor(F.col("_i") / w).cast("int").alias("y")
    )


def pad(pixels: DataFrame, sw: int, sh: int, w: int, h: int, x0: int = -1, y0: int = -1, fill: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """Placed on a canvas; a negative position centres."""
    x0, y0 = (w - sw) // 2 if x0 < 0 else x0, (h - sh) // 2 if y0 < 0 else y0
    placed = pixels.withColumns({"x": F.col("x") + x0, "y": F.col("y") + y0})
    return canvas(pixels, w, h).join(placed, KEY, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zip(RGB, fill)})


def scale(pixels: DataFrame, sw: int, sh: int, w: int, h: int) -> DataFrame:
    """Nearest source pixel for each target pixel. Each source pixel knows the targets that show it, so nothing is
    joined."""

    def targets(v: str, s: int, d: int) -> Column:
        first, last = F.ceil(F.col(v) * d / s), F.ceil((F.col(v) + 1) * d / s) - 1
        return F.when(last >= first, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))

    return pixels.withColumn("x", F.explode(targets("x", sw, w))).withColumn("y", F.explode(targets("y", sh, h)))


def fit_size(sw: int, sh: int, w: int, h: int, cover: bool = False) -> tuple[int, int]:
    factor = (max if cover else min)(w / sw, h / sh)
    return max(1, round(sw * factor)), max(1, round(sh * factor))


def fit(pixels: DataFrame, sw: int, sh: int, w: int, h: int) -> DataFrame:
    """Scaled to be contained, then padded."""
    tw, th = fit_size(sw, sh, w, h)
    return pad(scale(pixels, sw, sh, tw, th), tw, th, w, h)


def fill(pixels: DataFrame, sw: int, sh: int, w: int, h: int) -> DataFrame:
    """Scaled to cover, then cropped about the centre."""
    tw, th = fit_size(sw, sh, w, h, cover=True)
    return crop(scale(pixels, sw, sh, tw, th), (tw - w) // 2, (th - h) // 2, w, h)


def remap(pixels: DataFrame, w: int, h: int, source: tuple[Column, Column], fill: tuple = (0.0, 0.0, 0.0), of: list[str] | None = None) -> DataFrame:
    """Each target pixel shows the source pixel nearest to ``source`` (of its x, y, and the frame's columns ``of``); else
    the fill. One equi-join."""
    grid = canvas(pixels, w, h, of or []).withColumns({"_sx": F.round(source[0]).cast("int"), "_sy": F.round(source[1]).cast("int")})
    old = pixels.select(F.col("frame_no"), F.col("x").alias("_sx"), F.col("y").alias("_sy"), *RGB)
    return grid.join(old, ["frame_no", "_sx", "_sy"], "left").select(*KEY, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(RGB, fill)))


def rotate(pixels: DataFrame, w: int, h: int, degrees: float | str, fill: tuple = (0.0, 0.0, 0.0)) -> DataFrame:
    """Turned about the middle by an angle, or by that of a column that is the same all over a frame."""
    if isinstance(degrees, str):
        turn = F.radians(F.col(degrees))
        c, s, of = F.cos(turn), F.sin(turn), [degrees]
    else:
        c, s, of = math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), []
    dx, dy = F.col("x") - (w - 1) / 2, F.col("y") - (h - 1) / 2
    return remap(pixels, w, h, (dx * c + dy * s + (w - 1) / 2, dy * c - dx * s + (h - 1) / 2), fill, of)


def place(pixels: DataFrame, w: int, h: int, move: tuple[float, float], radians: float, zoom: tuple[float, float]) -> DataFrame:
    """Moved (in units of the picture), turned counter-clockwise and zoomed about the middle, in one step; what comes
    from outside is black."""
    c, s = math.cos(radians), math.sin(radians)
    u, v = (F.col("x") + 0.5) / w - 0.5 - move[0], (F.col("y") + 0.5) / h - 0.5 - move[1]
    return remap(pixels, w, h, (((u * c + v * s) / zoom[0] + 0.5) * w - 0.5, ((v * c - u * s) / zoom[1] + 0.5) * h - 0.5))


def fade(pixels: DataFrame, t: Column, start: float, duration: float, *, out: bool = False, white: bool = False) -> DataFrame:
    """The picture comes from black or white (or goes there when ``out``) in a straight line over ``duration``."""
    if duration <= 0:
        raise ValueError("a fade lasts some time")
    shown = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - start) / duration))
    shown = 1 - shown if out else shown
    return pixels.withColumns({c: F.col(c) * shown + ((1 - shown) if white else 0.0) for c in RGB})


def lens(pixels: DataFrame, w: int, h: int, k1: float, k2: float) -> DataFrame:
    """Radial distortion taken out."""
    dx, dy = (F.col("x") - (w - 1) / 2) / (w / 2), (F.col("y") - (h - 1) / 2) / (h / 2)
    r2 = dx * dx + dy * dy
    f = 1 + k1 * r2 + k2 * r2 * r2
    return remap(pixels, w, h, (dx * f * (w / 2) + (w - 1) / 2, dy * f * (h / 2) + (h - 1) / 2))


def paired(base: DataFrame, over: DataFrame, how: str = "left", x0: int = 0, y0: int = 0) -> DataFrame:
    """Pixels of both pictures at one position: r, g, b, a and _r, _g, _b, _a (alphas default to 1)."""
    with_alpha = lambda df: df if "a" in df.columns else df.withColumn("a", F.lit(1.0))
    top = with_alpha(over).select("frame_no", (F.col("x") + x0).alias("x"), (F.col("y") + y0).alias("y"), *(F.col(c).alias(f"_{c}") for c in "rgba"))
    return with_alpha(base).join(top, KEY, how)


def blend(base: DataFrame, over: DataFrame, mode: str, opacity: float = 1.0) -> DataFrame:
    """Blended and composed over the base, as bytes r, g, b, a; base pixels without an overlay stay."""
    p = paired(base, over)
    if mode in B.HSL_MODES:  # through columns, so that no expression repeats the conversion
        halves = {k: v for side in ("", "_") for k, v in zip((f"{side}h", f"{side}s", f"{side}l"), rgb_to_hsl(*(F.col(f"{side}{c}") for c in RGB)))}
        take = dict(zip("hsl", B.HSL_MODES[mode]))
        p = p.withColumns(halves).withColumns({f"m{c}": F.col(f"_{c}" if take[c] else c) for c in "hsl"})
        blended = hsl_to_rgb(F.col("mh"), F.col("ms"), F.col("ml"))
        p = p.withColumns({f"_{c}": v for c, v in zip(RGB, blended)})
    out = B.blend_over("normal" if mode in B.HSL_MODES else mode, [F.col(c) for c in RGB], [F.col(f"_{c}") for c in RGB], F.col("a"), F.col("_a"), opacity)
    return p.select(*KEY, *(F.when(F.col("_a").isNull(), B.to_byte(F.col(c))).otherwise(v).alias(c) for c, v in zip("rgba", out)))


def composite(base: DataFrame, over: DataFrame, op: str, opacity: float = 1.0) -> DataFrame:
    """A Porter-Duff operator on premultiplied channels, as bytes."""
    p = paired(base, over)
    sa, da = F.col("_a") * opacity, F.col("a")
    rgb = [B.porter_duff(op, F.col(f"_{c}") * sa, F.col(c) * da, sa, da) for c in RGB]
    return p.select(*KEY, *(B.to_byte(v).alias(c) for c, v in zip("rgba", (*rgb, B.porter_duff(op, sa, da, sa, da)))))


def composite_all(base: DataFrame, over: DataFrame, ops: list[str], opacity: float = 1.0) -> DataFrame:
    """(op, frame_no, x, y, r, g, b, a) where both pictures have a pixel: every operator by one join."""
    p = paired(base, over, "inner")
    sa, da = F.col("_a") * opacity, F.col("a")

    def one(op: str) -> Column:
        rgb = [B.porter_duff(op, F.col(f"_{c}") * sa, F.col(c) * da, sa, da) for c in RGB]
        return F.struct(F.lit(op).alias("op"), *(B.to_byte(v).alias(c) for c, v in zip("rgba", (*rgb, B.porter_duff(op, sa, da, sa, da)))))

    return p.select(*KEY, F.explode(F.array(*map(one, ops))).alias("o")).select("o.op", *KEY, "o.r", "o.g", "o.b", "o.a")


def overlay(base: DataFrame, over: DataFrame, x0: int, y0: int) -> DataFrame:
    p = paired(base, over, x0=x0, y0=y0)
    return p.select(*KEY, *(F.coalesce(f"_{c}", c).alias(c) for c in RGB))


def alpha_matte(base: DataFrame, matte: DataFrame) -> DataFrame:
    """Alpha from the matte's luma."""
    p = paired(base, matte)
    return p.select(*KEY, *RGB, luma709(F.col("_r"), F.col("_g"), F.col("_b")).alias("a"))


def transition(a: DataFrame, b: DataFrame, name: str, progress: Column, w: int, h: int) -> DataFrame:
    """The picture between two pictures at ``progress`` (a column of ``a``'s frames), as bytes."""
    if name in B.SLIDES:
        sx, sy = B.SLIDES[name]
        both = a.withColumn("_p", progress)
        dx, dy = F.floor(F.col("_p") * w) * sx, F.floor(F.col("_p") * h) * sy
        out = both.withColumns({"_x": F.col("x") - dx, "_y": F.col("y") - dy})
        stays = out.filter((F.col("_x").between(0, w - 1)) & (F.col("_y").between(0, h - 1)))
        stays = stays.select("frame_no", F.col("_x").cast("int").alias("x"), F.col("_y").cast("int").alias("y"), *RGB)
        moved = b.join(both.select("frame_no", "_p").distinct(), "frame_no").withColumns({"_x": F.col("x") - dx + sx * w, "_y": F.col("y") - dy + sy * h})
        moved = moved.filter((F.col("_x").between(0, w - 1)) & (F.col("_y").between(0, h - 1)))
        both = stays.unionByName(moved.select("frame_no", F.col("_x").cast("int").alias("x"), F.col("_y").cast("int").alias("y"), *RGB))
        return both.select(*KEY, *(B.to_byte(F.col(c)).alias(c) for c in RGB))
    p = paired(a.withColumn("_p", progress), b, "inner")
    return p.select(*KEY, *(B.to_byte(B.transition(name, F.col(c), F.col(f"_{c}"), F.col("_p"), F.col("x"), F.col("y"), w, h)).alias(c) for c in RGB))


def weights(sigma: float) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    return [v / sum(raw) for v in raw]


def _along(value: str, w: Window, taps: list[float] | list[Column]) -> Column:
    """A weighted moving sum; the border repeats the nearest pixel's share (weights renormalised)."""
    reach = len(taps) // 2
    at = lambda i: F.lag(value, -i).over(w) if i else F.col(value)
    terms = [(at(i), k) for i, k in zip(range(-reach, reach + 1), taps)]
    return sum((F.coalesce(v, F.lit(0.0)) * k for v, k in terms), F.lit(0.0)) / sum((F.when(v.isNotNull(), k).otherwise(0.0) for v, k in terms), F.lit(0.0))


def blur(pixels: DataFrame, sigma: float | Column, channels: list[str] = RGB, reach: int | None = None) -> DataFrame:
    """Separable Gaussian: along rows, then along columns. A sigma that is a column (one value a frame) needs the kernel's
    reach; no sigma, no blur."""
    if isinstance(sigma, Column):
        if reach is None:
            raise ValueError("a changing blur needs a reach")
        taps = [F.when(sigma > 0, F.exp(-(i * i) / (2 * sigma * sigma))).otherwise(float(i == 0)) for i in range(-reach, reach + 1)]
    else:
        taps = weights(sigma)
    row, column = Window.partitionBy("frame_no", "y").orderBy("x"), Window.partitionBy("frame_no", "x").orderBy("y")
    pixels = pixels.withColumns({c: _along(c, row, taps) for c in channels})
    return pixels.withColumns({c: _along(c, column, taps) for c in channels})


def unsharp(pixels: DataFrame, amount: Column | float) -> DataFrame:
    """v + amount * (v - 5 x 5 mean)."""
    row, column = Window.partitionBy("frame_no", "y").orderBy("x"), Window.partitionBy("frame_no", "x").orderBy("y")
    mean = pixels.withColumns({f"_{c}": _along(c, row, [0.2] * 5) for c in RGB})
    mean = mean.withColumns({f"_{c}": _along(f"_{c}", column, [0.2] * 5) for c in RGB})
    return mean.select(*KEY, *((F.col(c) + amount * (F.col(c) - F.col(f"_{c}"))).alias(c) for c in RGB))


def glow(pixels: DataFrame, threshold: float, radius: float, intensity, hard: bool = False) -> DataFrame:
    """Highlights, blurred and added: what each channel has above the threshold, or (``hard``) the pixels whose luma
    reaches it. The intensity may be a column of ``pixels``."""
    if hard:
        shown = luma601(*(F.col(c) for c in RGB)) >= threshold
        high = pixels.select(*KEY, *(F.when(shown, F.col(c)).otherwise(0.0).alias(c) for c in RGB))
    else:
        high = pixels.select(*KEY, *((F.greatest(F.col(c) - threshold, F.lit(0.0)) / max(1e-9, 1 - threshold)).alias(c) for c in RGB))
    soft = blur(high, min(50.0, max(0.5, radius)))
    p = paired(pixels, soft)
    by = F.least(F.lit(2.0), F.greatest(F.lit(0.0), intensity if isinstance(intensity, Column) else F.lit(float(intensity))))
    return p.select(*KEY, *(F.least(F.lit(1.0), F.col(c) + F.col(f"_{c}") * by).alias(c) for c in RGB))


def aberration(pixels: DataFrame, red: int, blue: int) -> DataFrame:
    """Red and blue shifted along rows; the border keeps its own value."""
    w = Window.partitionBy("frame_no", "y").orderBy("x")
    return pixels.withColumns({"r": F.coalesce(F.lag("r", red).over(w), F.col("r")), "b": F.coalesce(F.lag("b", blue).over(w), F.col("b"))})


def motion_mix(pixels: DataFrame, shutter: Column | float) -> DataFrame:
    """Each frame mixed with the one numbered before it by shutter / 360; a frame without one stays. Frames of several
    streams are numbered apart."""
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (shutter if isinstance(shutter, Column) else F.lit(float(shutter))) / 360))
    before = pixels.select((F.col("frame_no") + 1).alias("frame_no"), "x", "y", *(F.col(c).alias(f"_{c}") for c in RGB))
    both = pixels.join(before, KEY, "left").withColumns({c: F.col(c) * (1 - a) + F.coalesce(f"_{c}", c) * a for c in RGB})
    return both.drop(*(f"_{c}" for c in RGB))


def motion_trail(frames: DataFrame, weight: float) -> DataFrame:
    """Each output mixed with the output before, of frames (stream_id, frame_no from 0, plane array<double>): recursive, so
    blocks of frames are joined by a scan; a change of size starts anew."""
    return scan.trail(frames, weight)


def overlay_image(pixels: DataFrame, image: DataFrame, x0: int, y0: int, opacity: float = 1.0) -> DataFrame:
    """One picture (x, y, r, g, b, a), at most MOST_PIXELS, on every frame: it is broadcast, frames aren't shuffled."""
    if image.limit(MOST_PIXELS + 1).count() > MOST_PIXELS:
        raise ValueError(f"a picture of more than {MOST_PIXELS} pixels isn't broadcast")
    top = image.select((F.col("x") + x0).alias("x"), (F.col("y") + y0).alias("y"), *(F.col(c).alias(f"_{c}") for c in RGB), (F.col("a") * opacity).alias("_a"))
    p = pixels.join(F.broadcast(top), ["x", "y"], "left")
    return p.select(*KEY, *(F.coalesce(F.col(f"_{c}") * F.col("_a") + F.col(c) * (1 - F.col("_a")), F.col(c)).alias(c) for c in RGB))


def denoise(pixels: DataFrame, spatial: float, temporal: float) -> DataFrame:
    """A mean of each pixel, its four neighbours and the same pixel of the frames numbered before and after, each weighed
    by how little it differs: exp(-(d / strength)^2). Edges and moving things stay sharp."""
    row, column = Window.partitionBy("frame_no", "y").orderBy("x"), Window.partitionBy("frame_no", "x").orderBy("y")
    near = {f"_{c}{i}": at(c) for c in RGB for i, at in enumerate((lambda c: F.lag(c).over(row), lambda c: F.lead(c).over(row), lambda c: F.lag(c).over(column), lambda c: F.lead(c).over(column)))}
    p = pixels.withColumns(near)
    for i, step in ((4, 1), (5, -1)):
        p = p.join(pixels.select((F.col("frame_no") + step).alias("frame_no"), "x", "y", *(F.col(c).alias(f"_{c}{i}") for c in RGB)), KEY, "left")

    def mean(c: str) -> Column:
        total, weight = F.col(c), F.lit(1.0)
        for i in range(6):
            d = (F.col(f"_{c}{i}") - F.col(c)) / (spatial if i < 4 else temporal)
            w = F.coalesce(F.exp(-d * d), F.lit(0.0))
            total, weight = total + F.coalesce(F.col(f"_{c}{i}"), F.lit(0.0)) * w, weight + w
        return total / weight

    return p.select(*KEY, *(mean(c).alias(c) for c in RGB))


def deinterlace(pixels: DataFrame) -> DataFrame:
    """Odd rows from the mean of the rows above and below."""
    w = Window.partitionBy("frame_no", "x").orderBy("y")
    mid = lambda c: (F.coalesce(F.lag(c).over(w), F.lead(c).over(w)) + F.coalesce(F.lead(c).over(w), F.lag(c).over(w))) / 2
    return pixels.withColumns({c: F.when(F.col("y") % 2 == 1, F.coalesce(mid(c), F.col(c))).otherwise(F.col(c)) for c in RGB})


def apply_lut(pixels: DataFrame, lut: DataFrame, size: int) -> DataFrame:
    """Trilinear look-up in a cube (r_idx, g_idx, b_idx, r, g, b): eight corners by one join each pixel and corner.
    The cube has size**3 rows (at most 65**3), so it is broadcast."""
    if size > 65:
        raise ValueError("a cube of at most 65 points a side is asked for")
    at = {c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) * (size - 1) for c in RGB}
    low = {c: F.least(F.floor(v), F.lit(size - 2)).cast("int") for c, v in at.items()}
    corners = F.explode(F.array(*(F.struct(*(F.lit(i >> k & 1).alias(f"d{c}") for k, c in enumerate(RGB))) for i in range(8)))).alias("d")
    part = lambda c: F.when(F.col(f"d.d{c}") == 1, at[c] - low[c]).otherwise(1 - (at[c] - low[c]))
    each = pixels.select(*KEY, *RGB, corners).select(*KEY, *((low[c] + F.col(f"d.d{c}")).alias(f"{c}_idx") for c in RGB), (part("r") * part("g") * part("b")).alias("_w"))
    cube = lut.select("r_idx", "g_idx", "b_idx", *(F.col(c).alias(f"_{c}") for c in RGB))
    return each.join(F.broadcast(cube), ["r_idx", "g_idx", "b_idx"]).groupBy(*KEY).agg(*(F.sum(F.col("_w") * F.col(f"_{c}")).alias(c) for c in RGB))
