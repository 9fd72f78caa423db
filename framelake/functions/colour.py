"""Per-pixel colour functions. Channels are doubles in [0, 1] unless named bytes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .easing import smoothstep


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def luma601(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def luma709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def yuv_to_rgb_int(y: Column, u: Column, v: Column) -> list[Column]:
    """Bytes by 10-bit fixed-point arithmetic (arithmetic shifts)."""
    u, v = u.cast("int") - 128, v.cast("int") - 128
    parts = y + F.shiftright(v * 1436, 10), y - F.shiftright(u * 352, 10) - F.shiftright(v * 731, 10), y + F.shiftright(u * 1815, 10)
    return [F.greatest(F.lit(0), F.least(F.lit(255), c.cast("int"))) for c in parts]


def yuv_to_rgb_float(y: Column, cb: Column, cr: Column) -> list[Column]:
    """Full-range BT.601 with chroma centred on 0."""
    return [clamp(c) for c in (y + 1.402 * cr, y - 0.344 * cb - 0.714 * cr, y + 1.772 * cb)]


def rgb_to_yuv601(r: Column, g: Column, b: Column) -> list[Column]:
    y = luma601(r, g, b)
    return [y, (b - y) / 1.772, (r - y) / 1.402]


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in [0, 1)."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, lightness = top - low, (top + low) / 2
    safe = F.when(d == 0, F.lit(1.0)).otherwise(d)
    span = F.when(lightness > 0.5, 2 - top - low).otherwise(top + low)
    s = F.when(d == 0, F.lit(0.0)).otherwise(d / F.when(span == 0, F.lit(1.0)).otherwise(span))
    h = F.when(d == 0, F.lit(0.0)).when(top == r, (g - b) / safe + F.when(g < b, 6.0).otherwise(0.0)).when(top == g, (b - r) / safe + 2.0).otherwise((r - g) / safe + 4.0) / 6
    return h, s, lightness


def hsl_to_rgb(h: Column, s: Column, lightness: Column) -> tuple[Column, Column, Column]:
    q = F.when(lightness < 0.5, lightness * (1 + s)).otherwise(lightness + s - lightness * s)
    p = 2 * lightness - q

    def channel(t: Column) -> Column:
        t = t - F.floor(t)
        return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)

    return tuple(F.when(s == 0, lightness).otherwise(channel(t)) for t in (h + 1 / 3, h, h - 1 / 3))


def hsl_shift(r: Column, g: Column, b: Column, hue: float, saturation: float, lightness: float) -> list[Column]:
    """Hue turned by degrees, saturation scaled and lightness added, in HSL."""
    h, s, v = rgb_to_hsl(r, g, b)
    return list(hsl_to_rgb(h + hue / 360.0, clamp(s * saturation), clamp(v + lightness)))


def grade(r: Column, g: Column, b: Column, brightness=0.0, contrast=1.0, saturation=1.0, temperature=0.0, tint=0.0) -> list[Column]:
    """Brightness, contrast about the middle, temperature, tint, then saturation about BT.709 luma; in this order.
    Parameters may be columns (keyframed)."""
    r, g, b = ((c + brightness - 0.5) * contrast + 0.5 for c in (r, g, b))
    r, g, b = r + temperature * 0.1, g + tint * 0.1, b - temperature * 0.1
    y = luma709(r, g, b)
    return [clamp(y + (c - y) * saturation) for c in (r, g, b)]


def gamma(v: Column, g: Column | float) -> Column:
    return F.pow(clamp(v), 1 / F.lit(g) if not isinstance(g, Column) else 1 / g)


def wheels(rgb: tuple[Column, Column, Column], lift, gam, gain) -> list[Column]:
    """Lift on shadows, gamma on what is between, gain on highlights, each by a smooth weight of the pixel's BT.709
    luma. Parameters are one value or three, numbers or columns."""
    each = [p if isinstance(p, (tuple, list)) else (p, p, p) for p in (lift, gam, gain)]
    luma = luma709(*rgb)
    shadow, light = 1 - smoothstep(0.0, 0.5, luma), smoothstep(0.5, 1.0, luma)
    middle = clamp(1 - shadow - light)
    out = []
    for v, up, power, scale in zip(rgb, *each):
        v = v + up * shadow
        v = v + (F.pow(clamp(v), 1 / power) - v) * middle
        out.append(clamp(v * (1 + (scale - 1) * light)))
    return out


def three_way(v: Column, lift, gam, gain) -> Column:
    """A three-way corrector whose parameters may be columns: a line from lift to gain, bent by gamma."""
    return F.pow(clamp(lift + v * (gain - lift)), 1 / gam)


def three_way_points(lift: float, gam: float, gain: float) -> list[tuple[float, float]]:
    """Black, middle and white of a three-way corrector as control points."""
    clip = lambda v: min(1.0, max(0.0, v))
    return [(0.0, clip(lift)), (0.5, clip((lift + (gain - lift) * 0.5) ** (1 / gam) if lift + (gain - lift) * 0.5 > 0 else 0.0)), (1.0, clip(gain))]


TABLE = 256


def curve_table(points: list[tuple[float, float]], size: int = TABLE) -> list[float]:
    """A smooth curve through control points that overshoots none of them (Steffen's monotone cubic), at ``size`` even
    places; flat outside the points. Points are held to the unit square and sorted, of equal inputs the first stays;
    fewer than two give the identity."""
    places = np.linspace(0, 1, size)
    kept: list[tuple[float, float]] = []
    held = [tuple(min(1.0, max(0.0, float(v))) for v in p) for p in points if all(map(math.isfinite, p))]
    for x, y in sorted(held, key=lambda p: p[0]):
        if not kept or x - kept[-1][0] >= 1e-6:
            kept.append((x, y))
    if len(kept) < 2:
        return places.tolist()
    x, y = np.array(kept).T
    width, rise = np.diff(x), np.diff(y) / np.diff(x)
    slope = np.empty(len(x))
    if len(x) == 2:
        slope[:] = rise[0]
    else:
        mean = (rise[:-1] * width[1:] + rise[1:] * width[:-1]) / (width[:-1] + width[1:])
        slope[1:-1] = (np.sign(rise[:-1]) + np.sign(rise[1:])) * np.minimum(np.minimum(abs(rise[:-1]), abs(rise[1:])), abs(mean) / 2)
        for end, (h, far), (s, beyond) in ((0, width[:2], rise[:2]), (-1, width[:-3:-1], rise[:-3:-1])):
            own = s + (s - beyond) * h / (h + far)
            slope[end] = 0 if own * s <= 0 else np.sign(s) * min(abs(own), 2 * abs(s))
    at = np.clip(np.searchsorted(x, places, "left") - 1, 0, len(x) - 2)
    h, t = width[at], np.clip((places - x[at]) / width[at], 0, 1)
    u = 1 - t
    cubic = y[at] * (1 + 2 * t) * u * u + slope[at] * h * t * u * u + y[at + 1] * t * t * (3 - 2 * t) - slope[at + 1] * h * t * t * u
    return np.clip(cubic, 0, 1).tolist()


def curve(v: Column, points: list[tuple[float, float]]) -> Column:
    """A channel through the nearest entry of its curve's table. A curve of no points is the identity."""
    if not points:
        return v
    return F.get(F.lit(curve_table(points)), F.floor(clamp(v) * (TABLE - 1) + 0.5).cast("int"))


def kelvin_gains(kelvin: float, tint: float = 0.0) -> tuple[float, float, float]:
    """Channel gains of a black body's colour (the usual closed-form fit), green moved by tint."""
    t = min(400.0, max(10.0, kelvin / 100))
    red = 1.0 if t <= 66 else 329.698727446 * (t - 60) ** -0.1332047592 / 255
    green = (99.4708025861 * math.log(t) - 161.1195681661 if t <= 66 else 288.1221695283 * (t - 60) ** -0.0755148492) / 255
    blue = 1.0 if t >= 66 else 0.0 if t <= 19 else (138.5177312231 * math.log(t - 10) - 305.0447927307) / 255
    clip = lambda v: min(1.0, max(0.0, v))
    return clip(red), clip(green) + tint, clip(blue)


def hue_rotate(u: Column, v: Column, degrees: float, saturation: float = 1.0) -> list[Column]:
    """Chroma turned about the neutral axis and scaled."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(u * c - v * s) * saturation, (u * s + v * c) * saturation]


def spill_suppress(r: Column, g: Column, b: Column, strength: float) -> list[Column]:
    y = luma601(r, g, b)
    return [y + (c - y) * (1 - strength) for c in (r, g, b)]


def tone_map(v: Column, how: str) -> Column:
    if how == "reinhard":
        return v / (1 + v)
    if how == "hable":
        f = lambda x: (x * (0.15 * x + 0.05) + 0.004) / (x * (0.15 * x + 0.5) + 0.06) - 0.02 / 0.3
        return f(v) / f(11.2)
    if how == "mobius":
        j, peak = 0.3, 1.0e1
        a = -j * j * (peak - 1) / (j * j - 2 * j + peak)
        b = (j * j - 2 * j * peak + peak) / max(peak - 1, 1e-6)
        return F.when(v <= j, v).otherwise((b * b + 2 * b * j + j * j) / (b - a) * (v + a) / (v + b))
    raise ValueError(f"unknown tone curve {how!r}")


def chroma_key(r: Column, g: Column, b: Column, key: tuple[float, float, float], tolerance, softness) -> Column:
    """Alpha by distance from the key colour with BT.709 luma taken out of both."""
    y, ky = luma709(r, g, b), 0.2126 * key[0] + 0.7152 * key[1] + 0.0722 * key[2]
    d = F.sqrt(sum(((c - y) - (k - ky)) * ((c - y) - (k - ky)) for c, k in zip((r, g, b), key)))
    return smoothstep(tolerance - softness, tolerance + softness, d)


def color_key(r: Column, g: Column, b: Column, key: tuple[float, float, float], similarity, blend) -> Column:
    """Alpha by distance in RGB: 0 within similarity, rising over blend."""
    d = F.sqrt(sum((c - k) * (c - k) for c, k in zip((r, g, b), key)) / 3)
    return clamp((d - similarity) / blend) if blend else F.when(d > similarity, 1.0).otherwise(0.0)


def luma_key(y: Column, threshold: float, tolerance: float, softness: float, invert: bool = False) -> Column:
    d = F.abs(y - threshold)
    alpha = F.when(d <= tolerance, 0.0).when(d < tolerance + softness, (d - tolerance) / (softness or 1.0)).otherwise(1.0)
    return 1 - alpha if invert else alpha


def vignette(x: Column, y: Column, w: int, h: int, radius: float, feather: float, strength: Column | float) -> Column:
    """Factor by which a pixel is kept."""
    dx, dy = (x + 0.5) / w - 0.5, (y + 0.5) / h - 0.5
    return 1 - smoothstep(radius, radius + feather, 2 * F.sqrt(dx * dx + dy * dy)) * strength


_U32 = 0xFFFFFFFF


def wang_hash(seed: Column) -> Column:
    """A hash of 32-bit numbers, as a long."""

    def folded(h: Column, n: int) -> Column:
        return h.bitwiseXOR(F.shiftright(h, n))

    h = (folded(seed, 16).bitwiseXOR(F.lit(61)) * 9).bitwiseAND(_U32)
    return folded((folded(h, 4) * 0x27D4EB2D).bitwiseAND(_U32), 15)


def grain(x: Column, y: Column, frame: Column, which: int = 0) -> Column:
    """Noise in [-0.5, 0.5] that depends on pixel, frame and ``which`` only."""
    seed = (x.cast("long") * 1973 + y.cast("long") * 9277 + frame.cast("long") * 26699 + which).bitwiseAND(_U32)
    return wang_hash(seed) / float(_U32) - 0.5


def film_grain(rgb: tuple[Column, Column, Column], x: Column, y: Column, frame: Column, luma, chroma) -> list[Column]:
    """Noise added to luma and, less or more, to chroma (BT.709)."""
    r, g, b = rgb
    light = luma709(r, g, b)
    blue, red = (b - light) / 1.8556 + grain(x, y, frame, 1) * chroma, (r - light) / 1.5748 + grain(x, y, frame, 2) * chroma
    light = light + grain(x, y, frame) * luma
    return [clamp(light + 1.5748 * red), clamp(light - 0.1873 * blue - 0.4681 * red), clamp(light + 1.8556 * blue)]


def rect_mask(x: Column, y: Column, x0, y0, w, h, invert: bool = False) -> Column:
    inside = (x >= x0) & (x <= x0 + w - 1) & (y >= y0) & (y <= y0 + h - 1)
    return F.when(inside, 0 if invert else 255).otherwise(255 if invert else 0)


def polygon_mask(x: Column, y: Column, w: int, h: int, vertices: list[tuple[float, float]], invert: bool = False) -> Column:
    """Crossing-number test of pixel (x, y) against vertices in units of the picture; horizontal edges don't count."""
    hits = F.lit(0)
    for (x0, y0), (x1, y1) in zip(vertices, vertices[1:] + vertices[:1]):
        (x0, y0), (x1, y1) = sorted([(x0 * w, y0 * h), (x1 * w, y1 * h)], key=lambda p: p[1])
        if y0 != y1:
            hits = hits + F.when((y >= y0) & (y < y1) & (x0 + (y - y0) * ((x1 - x0) / (y1 - y0)) > x), 1).otherwise(0)
    inside = hits % 2 == 1
    return F.when(inside, 0 if invert else 255).otherwise(255 if invert else 0)
