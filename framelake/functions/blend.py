"""Two-input pixel functions: blend modes, Porter-Duff operators, transitions. Channels are doubles in [0, 1]."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .colour import hsl_to_rgb, rgb_to_hsl



def _min(a, b) -> Column:
    return F.least(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))


def _max(a, b) -> Column:
    return F.greatest(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))


def to_byte(v: Column) -> Column:
    """Clamped to [0, 1], times 255, rounded half up."""
    return F.floor(_max(0, _min(1, v)) * 255 + 0.5).cast("int")


def _bits(a: Column, b: Column, how: str) -> Column:
    return getattr(to_byte(a), how)(to_byte(b)) / 255.0


def _ratio(a: Column, b: Column) -> Column:
    """a / b where b isn't zero (guarded, for the branches that exclude zero)."""
    return a / F.when(b == 0, F.lit(1.0)).otherwise(b)


def _dodge(a: Column, b: Column) -> Column:
    return F.when(a >= 1, a).otherwise(_min(1, _ratio(b, 1 - a)))


def _burn(a: Column, b: Column) -> Column:
    return F.when(a <= 0, a).otherwise(_max(0, 1 - _ratio(1 - b, a)))


def _hard(a: Column, b: Column, chooser: Column) -> Column:
    return F.when(chooser < 0.5, 2 * a * b).otherwise(1 - 2 * (1 - a) * (1 - b))


#: a is the base, b the overlay.
MODES: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda a, b: b,
    "multiply": lambda a, b: a * b,
    "screen": lambda a, b: 1 - (1 - a) * (1 - b),
    "overlay": lambda a, b: _hard(a, b, a),
    "soft_light": lambda a, b: a * a + 2 * b * a * (1 - a),
    "hard_light": lambda a, b: _hard(a, b, b),
    "color_dodge": _dodge,
    "color_burn": _burn,
    "darken": _min,
    "lighten": _max,
    "difference": lambda a, b: F.abs(a - b),
    "exclusion": lambda a, b: a + b - 2 * a * b,
    "add": lambda a, b: _min(1, a + b),
    "subtract": lambda a, b: _max(0, a - b),
    "and": lambda a, b: _bits(a, b, "bitwiseAND"),
    "average": lambda a, b: (a + b) / 2,
    "bleach": lambda a, b: (1 - b) + (1 - a) - 1,
    "divide": lambda a, b: F.when(b == 0, 1.0).otherwise(_ratio(a, b)),
    "extremity": lambda a, b: F.abs(1 - a - b),
    "freeze": lambda a, b: F.when(b == 0, 0.0).otherwise(1 - _min(1, _ratio((1 - a) * (1 - a), b))),
    "geometric": lambda a, b: F.sqrt(_max(a, 0) * _max(b, 0)),
    "glow": lambda a, b: F.when(a == 1, a).otherwise(_min(1, _ratio(b * b, 1 - a))),
    "grain_extract": lambda a, b: 0.5 + a - b,
    "grain_merge": lambda a, b: a + b - 0.5,
    "hard_mix": lambda a, b: F.when(a < 1 - b, 0.0).otherwise(1.0),
    "hard_overlay": lambda a, b: F.when(a == 1, 1.0).when(a > 0.5, _min(1, _ratio(b, 2 - 2 * a))).otherwise(_min(1, 2 * a * b)),
    "harmonic": lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(_ratio(2 * a * b, a + b)),
    "heat": lambda a, b: F.when(a == 0, 0.0).otherwise(1 - _min(1, _ratio((1 - b) * (1 - b), a))),
    "interpolate": lambda a, b: (2 - F.cos(math.pi * a) - F.cos(math.pi * b)) / 4,
    "linear_light": lambda a, b: b + 2 * a - 1,
    "multiply128": lambda a, b: (a - 0.5) * b / 0.125 + 0.5,
    "negation": lambda a, b: 1 - F.abs(1 - a - b),
    "or": lambda a, b: _bits(a, b, "bitwiseOR"),
    "phoenix": lambda a, b: _min(a, b) - _max(a, b) + 1,
    "pin_light": lambda a, b: F.when(b < 0.5, _min(a, 2 * b)).otherwise(_max(a, 2 * (b - 0.5))),
    "reflect": lambda a, b: F.when(b == 1, b).otherwise(_min(1, _ratio(a * a, 1 - b))),
    "soft_difference": lambda a, b: F.when(a > b, F.when(b == 1, 0.0).otherwise(_ratio(a - b, 1 - b))).otherwise(F.when(b == 0, 0.0).otherwise(_ratio(b - a, b))),
    "stain": lambda a, b: 2 - a - b,
    "vivid_light": lambda a, b: F.when(a < 0.5, _burn(2 * a, b)).otherwise(_dodge(2 * (a - 0.5), b)),
    "xor": lambda a, b: _bits(a, b, "bitwiseXOR"),
}
#: Modes that move hue, saturation or lightness between whole pixels.
HSL_MODES = {"hue": (1, 0, 0), "saturation": (0, 1, 0), "color": (1, 1, 0), "luminosity": (0, 0, 1)}


def blend_pixel(mode: str, base: list[Column], over: list[Column]) -> list[Column]:
    """Three channels of a blended pixel, not clamped."""
    if mode in MODES:
        return [MODES[mode](a, b) for a, b in zip(base, over)]
    if mode not in HSL_MODES:
        raise ValueError(f"unknown blend mode {mode!r}")
    take = HSL_MODES[mode]
    mixed = [b if t else a for t, a, b in zip(take, rgb_to_hsl(*base), rgb_to_hsl(*over))]
    return list(hsl_to_rgb(*mixed))


#: Shares of source and destination, from their alphas.
PORTER_DUFF: dict[str, Callable[[Column, Column], tuple]] = {
    "over": lambda sa, da: (1.0, 1 - sa),
    "under": lambda sa, da: (1 - da, 1.0),
    "in": lambda sa, da: (da, 0.0),
    "out": lambda sa, da: (1 - da, 0.0),
    "atop": lambda sa, da: (da, 1 - sa),
    "xor": lambda sa, da: (1 - da, 1 - sa),
}


def porter_duff(op: str, s: Column, d: Column, sa: Column, da: Column) -> Column:
    """One premultiplied channel of source composed with destination."""
    fs, fd = PORTER_DUFF[op](sa, da)
    return s * fs + d * fd


def blend_over(mode: str, base: list[Column], over: list[Column], base_alpha: Column, over_alpha: Column, opacity: Column | float = 1.0) -> list[Column]:
    """Blended with alpha, composed over the base; four channels as bytes, premultiplied."""
    sa = over_alpha * opacity
    rgb = [porter_duff("over", f * sa, d * base_alpha, sa, base_alpha) for f, d in zip(blend_pixel(mode, base, over), base)]
    return [to_byte(c) for c in (*rgb, porter_duff("over", sa, base_alpha, sa, base_alpha))]


def _frand(x: Column, y: Column) -> Column:
    """A fixed pseudo-random value in [0, 1) for a pixel."""
    r = F.sin(x * 12.9898 + y * 78.233) * 43758.5453
    return r - F.floor(r)


def _dip(a: Column, b: Column, p: Column, colour: float, phase: float = 0.2) -> Column:
    from .easing import smoothstep

    out = smoothstep(0.0, phase, p)
    back = smoothstep(1 - phase, 1.0, p)
    return F.when(p < 0.5, a * (1 - out) + colour * out).otherwise(colour * (1 - back) + b * back)


def transition(name: str, a: Column, b: Column, p: Column, x: Column, y: Column, w: int, h: int) -> Column:
    """One channel of the picture between A and B at progress p. Slides are joins (see operators.pixels)."""
    if name == "dissolve":
        return F.when(_frand(x, y) < p, b).otherwise(a)
    if name == "wipe_left":
        return F.when(x > F.floor(w * (1 - p)), b).otherwise(a)
    if name == "wipe_right":
        return F.when(x <= F.floor(w * p), b).otherwise(a)
    if name == "wipe_up":
        return F.when(y > F.floor(h * (1 - p)), b).otherwise(a)
    if name == "wipe_down":
        return F.when(y <= F.floor(h * p), b).otherwise(a)
    if name in ("fade_black", "fade_white"):
        return _dip(a, b, p, 0.0 if name == "fade_black" else 1.0)
    if name in ("fade", "circle_open", "circle_close", "fade_grays", "pixelize"):
        return a * (1 - p) + b * p
    raise ValueError(f"unknown transition {name!r}")


TRANSITIONS = ["dissolve", "fade", "wipe_left", "wipe_right", "wipe_up", "wipe_down", "circle_open", "circle_close", "fade_grays", "pixelize", "fade_black", "fade_white"]
SLIDES = {"slide_left": (1, 0), "slide_right": (-1, 0), "slide_up": (0, 1), "slide_down": (0, -1)}
