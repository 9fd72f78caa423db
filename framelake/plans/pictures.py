"""Pixels: blend modes, composition, transitions, colour, geometry, neighbourhoods, quality."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import blend as fb
from ..functions import colour as fc
from ..operators import analysis, pixels, planes
from . import media
from .media import PAIRS, PIXELS, byte
from .register import Plans

plans = Plans()
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE
RGB = ["r", "g", "b"]


def _sums(df, channels=RGB):
    """Per frame, the sum of each channel's bytes."""
    return df.groupBy("frame_no").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in channels))


def _sums_sql(source: str, values: dict[str, str]) -> str:
    return f"SELECT frame_no, {', '.join(f'CAST(sum({v}) AS BIGINT) AS {c}' for c, v in values.items())} FROM {source} GROUP BY frame_no"


# ---- blend modes -----------------------------------------------------------------------------------------------------

#: {a} is the base, {b} the overlay.
BLEND_SQL = {
    "normal": "{b}",
    "multiply": "{a} * {b}",
    "screen": "1 - (1 - {a}) * (1 - {b})",
    "overlay": "CASE WHEN {a} < 0.5 THEN 2 * {a} * {b} ELSE 1 - 2 * (1 - {a}) * (1 - {b}) END",
    "soft_light": "{a} * {a} + 2 * {b} * {a} * (1 - {a})",
    "hard_light": "CASE WHEN {b} < 0.5 THEN 2 * {a} * {b} ELSE 1 - 2 * (1 - {a}) * (1 - {b}) END",
    "color_dodge": "CASE WHEN {a} >= 1 THEN {a} ELSE least(1.0, {b} / (1 - {a})) END",
    "color_burn": "CASE WHEN {a} <= 0 THEN {a} ELSE greatest(0.0, 1 - (1 - {b}) / {a}) END",
    "darken": "least({a}, {b})",
    "lighten": "greatest({a}, {b})",
    "difference": "abs({a} - {b})",
    "exclusion": "{a} + {b} - 2 * {a} * {b}",
    "add": "least(1.0, {a} + {b})",
    "subtract": "greatest(0.0, {a} - {b})",
    "and": f"({byte('{a}')} & {byte('{b}')}) / 255.0::DOUBLE",
    "average": "({a} + {b}) / 2",
    "bleach": "(1 - {b}) + (1 - {a}) - 1",
    "divide": "CASE WHEN {b} = 0 THEN 1.0 ELSE {a} / {b} END",
    "extremity": "abs(1 - {a} - {b})",
    "freeze": "CASE WHEN {b} = 0 THEN 0.0 ELSE 1 - least(1.0, (1 - {a}) * (1 - {a}) / {b}) END",
    "geometric": "sqrt(greatest({a}, 0.0) * greatest({b}, 0.0))",
    "glow": "CASE WHEN {a} = 1 THEN {a} ELSE least(1.0, {b} * {b} / (1 - {a})) END",
    "grain_extract": "0.5::DOUBLE + {a} - {b}",
    "grain_merge": "{a} + {b} - 0.5",
    "hard_mix": "CASE WHEN {a} < 1 - {b} THEN 0.0 ELSE 1.0 END",
    "hard_overlay": "CASE WHEN {a} = 1 THEN 1.0 WHEN {a} > 0.5 THEN least(1.0, {b} / (2 - 2 * {a})) ELSE least(1.0, 2 * {a} * {b}) END",
    "harmonic": "CASE WHEN {a} = 0 AND {b} = 0 THEN 0.0 ELSE 2 * {a} * {b} / ({a} + {b}) END",
    "heat": "CASE WHEN {a} = 0 THEN 0.0 ELSE 1 - least(1.0, (1 - {b}) * (1 - {b}) / {a}) END",
    "interpolate": "(2 - cos(pi() * {a}) - cos(pi() * {b})) / 4",
    "linear_light": "{b} + 2 * {a} - 1",
    "multiply128": "({a} - 0.5) * {b} / 0.125 + 0.5",
    "negation": "1 - abs(1 - {a} - {b})",
    "or": f"({byte('{a}')} | {byte('{b}')}) / 255.0::DOUBLE",
    "phoenix": "least({a}, {b}) - greatest({a}, {b}) + 1",
    "pin_light": "CASE WHEN {b} < 0.5 THEN least({a}, 2 * {b}) ELSE greatest({a}, 2 * ({b} - 0.5)) END",
    "reflect": "CASE WHEN {b} = 1 THEN {b} ELSE least(1.0, {a} * {a} / (1 - {b})) END",
    "soft_difference": "CASE WHEN {a} > {b} THEN CASE WHEN {b} = 1 THEN 0.0 ELSE ({a} - {b}) / (1 - {b}) END WHEN {b} = 0 THEN 0.0 ELSE ({b} - {a}) / {b} END",
    "stain": "2 - {a} - {b}",
    "vivid_light": "CASE WHEN {a} < 0.5 THEN CASE WHEN 2 * {a} <= 0 THEN 2 * {a} ELSE greatest(0.0, 1 - (1 - {b}) / (2 * {a})) END WHEN 2 * ({a} - 0.5) >= 1 THEN 2 * ({a} - 0.5) ELSE least(1.0, {b} / (1 - 2 * ({a} - 0.5))) END",
    "xor": f"xor({byte('{a}')}, {byte('{b}')}) / 255.0::DOUBLE",
}
OPACITY = 0.75


def _over_sql(f: str, a: str) -> str:
    """Blended at OPACITY over an opaque base."""
    return byte(f"(({f}) * {OPACITY}::DOUBLE * 1.0::DOUBLE + {a} * (1 - {OPACITY}::DOUBLE))")


def _register_blend(mode: str, sql: str | None) -> None:
    def run(spark, d):
        p = media.pixels(spark, d)
        both = pixels.blend(p, media.next_frames(p), mode, OPACITY)
        last = p.agg(F.max("frame_no").alias("last"))
        return _sums(both.join(F.broadcast(last), F.col("frame_no") < F.col("last")))  # one row: the last frame has no overlay

    plans.query(f"blend_{mode}", sql)(run)


for _mode, _f in BLEND_SQL.items():
    _register_blend(_mode, f"WITH {PAIRS} " + _sums_sql("pairs", {c: _over_sql(_f.format(a=c, b=f"{c}2"), c) for c in RGB}))

_HSL = """top AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, greatest(r2, g2, b2) AS hi2, least(r2, g2, b2) AS lo2 FROM pairs),
hsl AS (SELECT *, {h1} AS h, {s1} AS s, (hi + lo) / 2 AS l, {h2} AS h_2, {s2} AS s_2, (hi2 + lo2) / 2 AS l_2 FROM top)"""


def _h(x: str) -> str:
    r, g, b, hi, lo = (f"{c}{x}" for c in ("r", "g", "b", "hi", "lo"))
    return f"CASE WHEN {hi} = {lo} THEN 0.0 WHEN {hi} = {r} THEN (({g} - {b}) / ({hi} - {lo}) + CASE WHEN {g} < {b} THEN 6.0 ELSE 0.0 END) / 6 WHEN {hi} = {g} THEN (({b} - {r}) / ({hi} - {lo}) + 2.0) / 6 ELSE (({r} - {g}) / ({hi} - {lo}) + 4.0) / 6 END"


def _s(x: str) -> str:
    hi, lo = f"hi{x}", f"lo{x}"
    return f"CASE WHEN {hi} = {lo} THEN 0.0 ELSE ({hi} - {lo}) / CASE WHEN ({hi} + {lo}) / 2 > 0.5 THEN 2 - {hi} - {lo} ELSE {hi} + {lo} END END"


def _hsl_back(t: str, s: str, l: str) -> str:  # noqa: E741
    q = f"CASE WHEN {l} < 0.5 THEN {l} * (1 + {s}) ELSE {l} + {s} - {l} * {s} END"
    p = f"(2 * {l} - ({q}))"
    w = f"({t} - floor({t}))"
    return f"CASE WHEN {s} = 0 THEN {l} WHEN {w} < 1.0::DOUBLE / 6 THEN {p} + (({q}) - {p}) * 6 * {w} WHEN {w} < 0.5 THEN {q} WHEN {w} < 2.0::DOUBLE / 3 THEN {p} + (({q}) - {p}) * (2.0::DOUBLE / 3 - {w}) * 6 ELSE {p} END"


for _mode, (_a, _b, _c) in fb.HSL_MODES.items():
    _args = "h_2" if _a else "h", "s_2" if _b else "s", "l_2" if _c else "l"
    _channels = {c: _over_sql(_hsl_back(f"({_args[0]}{t})", _args[1], _args[2]), c) for c, t in zip(RGB, (" + 1.0::DOUBLE / 3", "", " - 1.0::DOUBLE / 3"))}
    _register_blend(_mode, f"WITH {PAIRS}, {_HSL.format(h1=_h(''), s1=_s(''), h2=_h('2'), s2=_s('2'))} " + _sums_sql("hsl", _channels))


# ---- Porter-Duff, overlay, transitions -------------------------------------------------------------------------------

_PD = {"over": ("1.0::DOUBLE", "(1 - sa)"), "under": ("(1 - da)", "1.0::DOUBLE"), "in": ("da", "0.0::DOUBLE"), "out": ("(1 - da)", "0.0::DOUBLE"), "atop": ("da", "(1 - sa)"), "xor": ("(1 - da)", "(1 - sa)")}
_ALPHA = f"{PAIRS}, al AS (SELECT *, b AS da, b2 * 0.8 AS sa FROM pairs)"
_PD_SQL = " UNION ALL ".join(
    f"SELECT '{op}' AS op, * FROM ({_sums_sql('al', {**{c: byte(f'{c}2 * sa * {fs} + {c} * da * {fd}') for c in RGB}, 'a': byte(f'sa * {fs} + da * {fd}')})})" for op, (fs, fd) in _PD.items()
)


@plans.query("porter_duff_all", f"WITH {_ALPHA} {_PD_SQL}")
def porter_duff_all(spark, d):
    p = media.pixels(spark, d).withColumn("a", F.col("b"))
    out = pixels.composite_all(p, media.next_frames(p), list(fb.PORTER_DUFF), 0.8)
    return out.groupBy("op", "frame_no").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in (*RGB, "a")))


@plans.query("overlay_at", f"WITH {PIXELS} SELECT p.frame_no, CAST(sum({byte('coalesce(q.r, p.r)')}) AS BIGINT) AS r FROM pixels p LEFT JOIN pixels q ON q.frame_no = p.frame_no + 1 AND q.x + 2 = p.x AND q.y + 3 = p.y GROUP BY p.frame_no")
def overlay_at(spark, d):
    p = media.pixels(spark, d)
    out = pixels.overlay(p, media.next_frames(p), 2, 3)
    return _sums(out.select("frame_no", fb.to_byte(F.col("r")).alias("r")), ["r"])


_STEP_P = "(frame_no % 11) / 10.0::DOUBLE"
_SMOOTH = "(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({p} - {lo}) / {w})) * least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({p} - {lo}) / {w})) * (3 - 2 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({p} - {lo}) / {w}))))"


def _dip_sql(c: str, v: float) -> str:
    o, i = _SMOOTH.format(p="p", lo="0.0", w="0.2::DOUBLE"), _SMOOTH.format(p="p", lo="0.8::DOUBLE", w="(1.0 - 0.8)::DOUBLE")
    return f"CASE WHEN p < 0.5 THEN {c} * (1 - {o}) + {v} * {o} ELSE {v} * (1 - {i}) + {c}2 * {i} END"


_FRAND = "(sin(x * 12.9898::DOUBLE + y * 78.233::DOUBLE) * 43758.5453::DOUBLE - floor(sin(x * 12.9898::DOUBLE + y * 78.233::DOUBLE) * 43758.5453::DOUBLE))"
_LINEAR = "{c} * (1 - p) + {c}2 * p"
TRANSITION_SQL = {
    "dissolve": f"CASE WHEN {_FRAND} < p THEN {{c}}2 ELSE {{c}} END",
    "wipe_left": "CASE WHEN x > floor(8 * (1 - p)) THEN {c}2 ELSE {c} END",
    "wipe_right": "CASE WHEN x <= floor(8 * p) THEN {c}2 ELSE {c} END",
    "wipe_up": "CASE WHEN y > floor(8 * (1 - p)) THEN {c}2 ELSE {c} END",
    "wipe_down": "CASE WHEN y <= floor(8 * p) THEN {c}2 ELSE {c} END",
    **{k: _LINEAR for k in ("fade", "circle_open", "circle_close", "fade_grays", "pixelize")},
}


def _register_transition(name: str, sql: str) -> None:
    def run(spark, d):
        p = media.pixels(spark, d)
        over = media.next_frames(p)
        both = p.join(over.select("frame_no", "x", "y"), pixels.KEY, "left_semi")
        return _sums(pixels.transition(both, over, name, (F.col("frame_no") % 11) / 10, 8, 8))

    plans.query(f"xfade_{name}", sql)(run)


_PROGRESS = f"{PAIRS}, t AS (SELECT *, {_STEP_P} AS p FROM pairs)"
for _name, _f in TRANSITION_SQL.items():
    _register_transition(_name, f"WITH {_PROGRESS} " + _sums_sql("t", {c: byte(_f.format(c=c)) for c in RGB}))
for _name, _v in (("fade_black", 0.0), ("fade_white", 1.0)):
    _register_transition(_name, f"WITH {_PROGRESS} " + _sums_sql("t", {c: byte(_dip_sql(c, _v)) for c in RGB}))
for _name, (_sx, _sy) in fb.SLIDES.items():
    _dx, _dy = f"CAST(floor(p * 8) AS INTEGER) * {_sx}", f"CAST(floor(p * 8) AS INTEGER) * {_sy}"
    _register_transition(
        _name,
        f"""WITH {_PROGRESS}, moved AS (SELECT frame_no, x - ({_dx}) AS nx, y - ({_dy}) AS ny, r, g, b FROM t UNION ALL
SELECT frame_no, x - ({_dx}) + {8 * _sx}, y - ({_dy}) + {8 * _sy}, r2, g2, b2 FROM t), seen AS (SELECT * FROM moved WHERE nx BETWEEN 0 AND 7 AND ny BETWEEN 0 AND 7) """
        + _sums_sql("seen", {c: byte(c) for c in RGB}),
    )


# ---- colour ----------------------------------------------------------------------------------------------------------

_CLAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {0}))"


def _colour(name: str, sql: dict[str, str] | None, f, ctes: str = "", source: str = "pixels") -> None:
    def run(spark, d):
        p = media.pixels(spark, d)
        out = f(*(F.col(c) for c in RGB))
        return _sums(p.select("frame_no", *(fb.to_byte(v).alias(c) for c, v in zip(RGB, out))))

    plans.query(name, f"WITH {PIXELS}{ctes} " + _sums_sql(source, {c: byte(v) for c, v in sql.items()}) if sql else None)(run)


_G = {c: f"({c} + 0.05 - 0.5) * 1.2::DOUBLE + 0.5 {t}" for c, t in zip(RGB, ("+ 0.3::DOUBLE * 0.1", "+ -0.2::DOUBLE * 0.1", "- 0.3::DOUBLE * 0.1"))}
_GRADE_CTE = f", gr AS (SELECT frame_no, {', '.join(f'{v} AS {c}' for c, v in _G.items())} FROM pixels), gy AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM gr)"
_colour("colour_grade", {c: f"l + ({c} - l) * 1.3" for c in RGB}, lambda r, g, b: fc.grade(r, g, b, 0.05, 1.2, 1.3, 0.3, -0.2), _GRADE_CTE, "gy")
_colour("gamma_channels", {c: f"pow({c}, 1 / {g}::DOUBLE)" for c, g in zip(RGB, (1.2, 0.9, 2.2))}, lambda r, g, b: [fc.gamma(r, 1.2), fc.gamma(g, 0.9), fc.gamma(b, 2.2)])
_POINTS = [(0.0, 0.1), (0.4, 0.3), (0.6, 0.8), (1.0, 0.95)]


def _table_sql(points: list[tuple[float, float]]) -> str:
    """CTE tab(k, v): the curve's table by its rule: Hermite pieces with Steffen's slopes."""
    rows = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(points))
    end = "CASE WHEN {p} * {s} <= 0 THEN 0.0 WHEN abs({p}) > 2 * abs({s}) THEN 2 * {s} ELSE {p} END"
    first = end.format(p="(s * (1 + h / (h + hn)) - sn * (h / (h + hn)))", s="s")
    last = end.format(p="(sp * (1 + hp / (hp + hpp)) - spp * (hp / (hp + hpp)))", s="sp")
    return f"""pts(i, x, y) AS (VALUES {rows}),
seg AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s, lead(x) OVER w AS xn, lead(y) OVER w AS yn FROM pts WINDOW w AS (ORDER BY i)),
near AS (SELECT *, lag(h) OVER w AS hp, lag(s) OVER w AS sp, lag(h, 2) OVER w AS hpp, lag(s, 2) OVER w AS spp, lead(h) OVER w AS hn, lead(s) OVER w AS sn FROM seg WINDOW w AS (ORDER BY i)),
slopes AS (SELECT *, CASE WHEN hp IS NULL THEN {first} WHEN h IS NULL THEN {last} ELSE (sign(sp) + sign(s)) * least(abs(sp), abs(s), 0.5 * abs((sp * h + s * hp) / (hp + h))) END AS d FROM near),
piece AS (SELECT *, lead(d) OVER (ORDER BY i) AS dn FROM slopes),
tab AS (SELECT CAST(k AS INTEGER) AS k, CASE WHEN u <= (SELECT min(x) FROM pts) THEN (SELECT arg_min(y, x) FROM pts) WHEN u >= (SELECT max(x) FROM pts) THEN (SELECT arg_max(y, x) FROM pts) ELSE
  (SELECT least(1.0, greatest(0.0, (2 * t * t * t - 3 * t * t + 1) * y + (t * t * t - 2 * t * t + t) * h * d + (3 * t * t - 2 * t * t * t) * yn + (t * t * t - t * t) * h * dn))
   FROM (SELECT (u - x) / h AS t, * FROM piece WHERE x < u AND u <= xn)) END AS v FROM (SELECT k, k / 255.0::DOUBLE AS u FROM range(256) r(k)))"""


def _tabled(name: str, points: list[tuple[float, float]]) -> None:
    joins = " ".join(f"JOIN tab t{c} ON t{c}.k = bt.{c}" for c in RGB)
    sums = ", ".join(f"CAST(sum({byte(f't{c}.v')}) AS BIGINT) AS {c}" for c in RGB)
    bt = f"bt AS (SELECT frame_no, {byte('r')} AS r, {byte('g')} AS g, {byte('b')} AS b FROM pixels)"

    def run(spark, d):
        return _sums(media.pixels(spark, d).select("frame_no", *(fb.to_byte(fc.curve(F.col(c), points)).alias(c) for c in RGB)))

    plans.query(name, f"WITH {PIXELS}, {bt}, {_table_sql(points)} SELECT frame_no, {sums} FROM bt {joins} GROUP BY frame_no")(run)


_tabled("curve_lut", _POINTS)
_gains = fc.kelvin_gains(4500.0, 0.02)
_colour("white_balance", {c: f"{c} * {g!r}::DOUBLE" for c, g in zip(RGB, _gains)}, lambda *rgb: [v * g for v, g in zip(rgb, _gains)])
_W = {k: _SMOOTH.format(p="l", lo=lo, w=w) for k, lo, w in (("s", "0.0", "0.5::DOUBLE"), ("h", "0.5::DOUBLE", "0.5::DOUBLE"))}
_LIFT, _GAMMA, _GAIN = (0.08, 0.02, -0.03), (1.1, 0.9, 1.3), (1.2, 1.1, 0.8)
_WHEEL = f""", wl AS (SELECT frame_no, r, g, b, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM pixels), ww AS (SELECT *, 1 - {_W['s']} AS ws, {_W['h']} AS wh FROM wl),
wm AS (SELECT *, {_CLAMP.format('1 - ws - wh')} AS wm FROM ww), w1 AS (SELECT frame_no, wm, wh, {', '.join(f'{c} + {v}::DOUBLE * ws AS {c}' for c, v in zip(RGB, _LIFT))} FROM wm),
w2 AS (SELECT frame_no, wh, {', '.join(f'{c} + (pow({_CLAMP.format(c)}, 1 / {v}::DOUBLE) - {c}) * wm AS {c}' for c, v in zip(RGB, _GAMMA))} FROM w1)"""
_colour("colour_wheels", {c: f"{c} * (1 + ({v}::DOUBLE - 1) * wh)" for c, v in zip(RGB, _GAIN)}, lambda *rgb: fc.wheels(rgb, _LIFT, _GAMMA, _GAIN), _WHEEL, "w2")
_YUV = ", yv AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM pixels), uv AS (SELECT *, (b - l) / 1.772::DOUBLE AS u, (r - l) / 1.402::DOUBLE AS v FROM yv)"
_c30, _s30 = math.cos(math.radians(30)), math.sin(math.radians(30))
_u2, _v2 = f"((u * {_c30!r}::DOUBLE - v * {_s30!r}::DOUBLE) * 0.9::DOUBLE)", f"((u * {_s30!r}::DOUBLE + v * {_c30!r}::DOUBLE) * 0.9::DOUBLE)"


def _hue(r, g, b):
    y, u, v = fc.rgb_to_yuv601(r, g, b)
    u, v = fc.hue_rotate(u, v, 30, 0.9)
    return fc.yuv_to_rgb_float(y, u, v)


_colour("hue_rotate", {"r": f"l + 1.402::DOUBLE * {_v2}", "g": f"l - 0.344::DOUBLE * {_u2} - 0.714::DOUBLE * {_v2}", "b": f"l + 1.772::DOUBLE * {_u2}"}, _hue, _YUV, "uv")
_colour("spill_suppress", {c: f"l + ({c} - l) * (1 - 0.6::DOUBLE)" for c in RGB}, lambda r, g, b: fc.spill_suppress(r, g, b, 0.6), _YUV, "uv")
_colour("tone_map_reinhard", {c: f"{c} * 4 / (1 + {c} * 4)" for c in RGB}, lambda *rgb: [fc.tone_map(v * 4, "reinhard") for v in rgb])
_HABLE = "(({x} * (0.15::DOUBLE * {x} + 0.05::DOUBLE) + 0.004::DOUBLE) / ({x} * (0.15::DOUBLE * {x} + 0.5::DOUBLE) + 0.06::DOUBLE) - 0.02::DOUBLE / 0.3::DOUBLE)"
_colour("tone_map_hable", {c: _HABLE.format(x=f"({c} * 4)") + " / " + _HABLE.format(x="11.2::DOUBLE") for c in RGB}, lambda *rgb: [fc.tone_map(v * 4, "hable") for v in rgb])
_TOP = ", top AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM pixels), hs AS (SELECT frame_no, " + _h("") + " + 40.0::DOUBLE / 360 AS h, " + _CLAMP.format(f"({_s('')}) * 1.2::DOUBLE") + " AS s, " + _CLAMP.format("(hi + lo) / 2 + 0.05::DOUBLE") + " AS l FROM top)"
_colour("hsl_shift", {c: _hsl_back(f"(h{t})", "s", "l") for c, t in zip(RGB, (" + 1.0::DOUBLE / 3", "", " - 1.0::DOUBLE / 3"))}, lambda r, g, b: fc.hsl_shift(r, g, b, 40.0, 1.2, 0.05), _TOP, "hs")


#: Black, middle and white by their rule: lift, the mean of lift and gain to the power 1 / gamma, gain.
_tabled("three_way_corrector", fc.three_way_points(0.05, 1.2, 0.95))


def _alpha(name: str, sql: str, f) -> None:
    def run(spark, d):
        p = media.pixels(spark, d)
        return p.groupBy("frame_no").agg(F.sum(f(p).cast("long")).alias("alpha"))

    plans.query(name, f"WITH {PIXELS}, lm AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM pixels) SELECT frame_no, CAST(sum({sql}) AS BIGINT) AS alpha FROM lm GROUP BY frame_no")(run)


_KEY = (0.2, 0.6, 0.3)
_KY = 0.2126 * 0.2 + 0.7152 * 0.6 + 0.0722 * 0.3
_CD = "sqrt(" + " + ".join(f"(({c} - l) - ({k}::DOUBLE - {_KY!r}::DOUBLE)) * (({c} - l) - ({k}::DOUBLE - {_KY!r}::DOUBLE))" for c, k in zip(RGB, _KEY)) + ")"
_alpha("chroma_key", byte(_SMOOTH.format(p=_CD, lo="(0.2::DOUBLE - 0.1::DOUBLE)", w="((0.2::DOUBLE + 0.1::DOUBLE) - (0.2::DOUBLE - 0.1::DOUBLE))")), lambda p: fb.to_byte(fc.chroma_key(*(F.col(c) for c in RGB), _KEY, 0.2, 0.1)))
_RD = "sqrt((" + " + ".join(f"({c} - {k}::DOUBLE) * ({c} - {k}::DOUBLE)" for c, k in zip(RGB, _KEY)) + ") / 3)"
_alpha("color_key", byte(f"({_RD} - 0.1::DOUBLE) / 0.2::DOUBLE"), lambda p: fb.to_byte(fc.color_key(*(F.col(c) for c in RGB), _KEY, 0.1, 0.2)))
_alpha("luma_key", byte("CASE WHEN abs(l - 0.5) <= 0.05 THEN 0.0 WHEN abs(l - 0.5) < 0.05::DOUBLE + 0.1::DOUBLE THEN (abs(l - 0.5) - 0.05) / 0.1::DOUBLE ELSE 1.0 END"), lambda p: fb.to_byte(fc.luma_key(fc.luma709(*(F.col(c) for c in RGB)), 0.5, 0.05, 0.1)))
_alpha("luma_mask_inverted", f"255 - {byte('l')}", lambda p: 255 - fb.to_byte(fc.luma709(*(F.col(c) for c in RGB))))
_alpha("rect_mask", "CASE WHEN x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3 THEN 255 ELSE 0 END", lambda p: fc.rect_mask(F.col("x"), F.col("y"), 2, 1, 4, 3))
_alpha(
    "polygon_matte",
    "CASE WHEN (CASE WHEN y >= 1.6::DOUBLE AND y < 6.4::DOUBLE AND 0.8::DOUBLE + (y - 1.6::DOUBLE) * ((4.0 - 0.8::DOUBLE) / (6.4::DOUBLE - 1.6::DOUBLE)) > x THEN 1 ELSE 0 END + CASE WHEN y >= 1.6::DOUBLE AND y < 6.4::DOUBLE AND 7.2::DOUBLE + (y - 1.6::DOUBLE) * ((4.0 - 7.2::DOUBLE) / (6.4::DOUBLE - 1.6::DOUBLE)) > x THEN 1 ELSE 0 END) % 2 = 1 THEN 255 ELSE 0 END",
    lambda p: fc.polygon_mask(F.col("x"), F.col("y"), 8, 8, [(0.1, 0.2), (0.9, 0.2), (0.5, 0.8)]),
)
_VD = "(2 * sqrt(((x + 0.5) / 8.0::DOUBLE - 0.5) * ((x + 0.5) / 8.0::DOUBLE - 0.5) + ((y + 0.5) / 8.0::DOUBLE - 0.5) * ((y + 0.5) / 8.0::DOUBLE - 0.5)))"
_alpha("vignette_mask", byte(f"1 - {_SMOOTH.format(p=_VD, lo='0.5::DOUBLE', w='(0.5 + 0.4::DOUBLE - 0.5)')} * 0.8::DOUBLE"), lambda p: fb.to_byte(fc.vignette(F.col("x"), F.col("y"), 8, 8, 0.5, 0.4, 0.8)))


def wang(which: int = 0) -> str:
    """The grain's hash as SQL of x, y and frame_no."""
    m = 4294967295
    h = f"((x * 1973::BIGINT + y * 9277::BIGINT + frame_no * 26699::BIGINT + {which}) & {m})"
    h = f"((xor(xor({h}, 61), {h} >> 16) * 9) & {m})"
    h = f"((xor({h}, {h} >> 4) * 668265261::BIGINT) & {m})"
    return f"xor({h}, {h} >> 15)"


def noise(which: int = 0) -> str:
    return f"({wang(which)} / 4294967295::DOUBLE - 0.5)"


_alpha("film_grain_hash", f"CAST(floor({noise()} * 1000) AS BIGINT)", lambda p: F.floor(fc.grain(F.col("x"), F.col("y"), F.col("frame_no")) * 1000))
_GRAIN = f""", gl AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM pixels),
gn AS (SELECT frame_no, l + {noise()} * 0.2::DOUBLE AS l, (b - l) / 1.8556::DOUBLE + {noise(1)} * 0.1::DOUBLE AS cb, (r - l) / 1.5748::DOUBLE + {noise(2)} * 0.1::DOUBLE AS cr FROM gl)"""


@plans.query(
    "film_grain",
    f"WITH {PIXELS}{_GRAIN} " + _sums_sql("gn", {"r": byte("l + 1.5748::DOUBLE * cr"), "g": byte("l - 0.1873::DOUBLE * cb - 0.4681::DOUBLE * cr"), "b": byte("l + 1.8556::DOUBLE * cb")}),
)
def film_grain(spark, d):
    out = fc.film_grain(tuple(F.col(c) for c in RGB), F.col("x"), F.col("y"), F.col("frame_no"), 0.2, 0.1)
    return _sums(media.pixels(spark, d).select("frame_no", *(fb.to_byte(v).alias(c) for c, v in zip(RGB, out))))


# ---- geometry and neighbourhoods -------------------------------------------------------------------------------------


def _moved(name: str, x: str, y: str, where: str, f) -> None:
    plans.query(name, f"WITH {PIXELS} SELECT frame_no, CAST({x} AS INTEGER) AS x, CAST({y} AS INTEGER) AS y, {byte('r')} AS r FROM pixels WHERE {where}")(
        lambda spark, d: f(media.pixels(spark, d)).select("frame_no", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), fb.to_byte(F.col("r")).alias("r"))
    )


_moved("crop_rect", "x - 2", "y - 1", "x >= 2 AND x < 7 AND y >= 1 AND y < 5", lambda p: pixels.crop(p, 2, 1, 5, 4))
_moved("hflip", "7 - x", "y", "true", lambda p: pixels.flip(p, 8, 8, True))
_moved("vflip", "x", "7 - y", "true", lambda p: pixels.flip(p, 8, 8, False))


@plans.query(
    "pad_centre",
    f"""WITH {PIXELS}, f AS (SELECT DISTINCT frame_no FROM pixels), g AS (SELECT frame_no, CAST(i % 12 AS INTEGER) AS x, CAST(i // 12 AS INTEGER) AS y FROM f, range(120) t(i))
SELECT g.frame_no, g.x, g.y, {byte('coalesce(p.r, 0.0)')} AS r FROM g LEFT JOIN pixels p ON p.frame_no = g.frame_no AND p.x + 2 = g.x AND p.y + 1 = g.y""",
)
def pad_centre(spark, d):
    return pixels.pad(media.pixels(spark, d), 8, 8, 12, 10).select("frame_no", "x", "y", fb.to_byte(F.col("r")).alias("r"))


def _scaled(name: str, w: int, h: int, crop=None) -> None:
    f = "SELECT DISTINCT frame_no FROM pixels"
    sql = f"""WITH {PIXELS}, f AS ({f}), g AS (SELECT frame_no, CAST(i % {w} AS INTEGER) AS x, CAST(i // {w} AS INTEGER) AS y FROM f, range({w * h}) t(i))
SELECT g.frame_no, g.x, g.y, {byte('p.r')} AS r FROM g JOIN pixels p ON p.frame_no = g.frame_no AND p.x = g.x * 8 // {w} AND p.y = g.y * 8 // {h}"""
    plans.query(name, sql)(lambda spark, d: pixels.scale(media.pixels(spark, d), 8, 8, w, h).select("frame_no", "x", "y", fb.to_byte(F.col("r")).alias("r")))


_scaled("scale_up", 13, 11)
_scaled("scale_half", 4, 4)


@plans.query("fit_to_aspect", f"WITH {PIXELS}, f AS (SELECT DISTINCT frame_no FROM pixels), g AS (SELECT frame_no, CAST(i % 16 AS INTEGER) AS x, CAST(i // 16 AS INTEGER) AS y FROM f, range(144) t(i)) SELECT g.frame_no, g.x, g.y, {byte('coalesce(p.r, 0.0)')} AS r FROM g LEFT JOIN pixels p ON p.frame_no = g.frame_no AND g.x >= 3 AND g.x < 12 AND p.x = (g.x - 3) * 8 // 9 AND p.y = g.y * 8 // 9")
def fit_to_aspect(spark, d):
    return pixels.fit(media.pixels(spark, d), 8, 8, 16, 9).select("frame_no", "x", "y", fb.to_byte(F.col("r")).alias("r"))


@plans.query("fill_to_aspect", f"WITH {PIXELS}, f AS (SELECT DISTINCT frame_no FROM pixels), g AS (SELECT frame_no, CAST(i % 16 AS INTEGER) AS x, CAST(i // 16 AS INTEGER) AS y FROM f, range(144) t(i)) SELECT g.frame_no, g.x, g.y, {byte('p.r')} AS r FROM g JOIN pixels p ON p.frame_no = g.frame_no AND p.x = g.x * 8 // 16 AND p.y = (g.y + 3) * 8 // 16")
def fill_to_aspect(spark, d):
    return pixels.fill(media.pixels(spark, d), 8, 8, 16, 9).select("frame_no", "x", "y", fb.to_byte(F.col("r")).alias("r"))


def _remapped(name: str, sx: str, sy: str, f) -> None:
    """Each pixel of each frame."""
    sql = f"""WITH {PIXELS}, s AS (SELECT frame_no, x, y, CAST(round({sx}) AS INTEGER) AS sx, CAST(round({sy}) AS INTEGER) AS sy FROM pixels)
SELECT s.frame_no, s.x, s.y, {byte('coalesce(p.r, 0.0)')} AS r FROM s LEFT JOIN pixels p ON p.frame_no = s.frame_no AND p.x = s.sx AND p.y = s.sy"""
    plans.query(name, sql)(lambda spark, d: _each_pixel(f(media.planes(spark, d))))


def _each_pixel(frames, plane="r"):
    """A row for each pixel of a plane; no shuffle."""
    at = frames.select("frame_no", "w", F.posexplode(plane).alias("i", "v"))
    return at.select("frame_no", (F.col("i") % F.col("w")).alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), fb.to_byte(F.col("v")).alias("r"))


def _placed_sum(frames, plane="r"):
    """Per frame, the sum of a plane's bytes times their place, from 1."""
    weighed = F.transform(plane, lambda v, i: fb.to_byte(v).cast("long") * (i + 1))
    return frames.select("frame_no", F.aggregate(weighed, F.lit(0).cast("long"), lambda a, v: a + v).alias("r"))


def _plane_mean(frames, plane="r"):
    """Per frame, the mean of a plane to six digits; no shuffle."""
    return frames.select("frame_no", F.round(F.aggregate(plane, F.lit(0.0), lambda a, v: a + v) / F.size(plane), 6).alias("r"))


def _frame_means(name: str, sql: str, f) -> None:
    plans.query(name, sql)(lambda spark, d: _plane_mean(f(media.planes(spark, d))))


_c20, _s20 = math.cos(math.radians(20)), math.sin(math.radians(20))
_remapped("rotate_frame", f"(x - 3.5) * {_c20!r}::DOUBLE + (y - 3.5) * {_s20!r}::DOUBLE + 3.5", f"(y - 3.5) * {_c20!r}::DOUBLE - (x - 3.5) * {_s20!r}::DOUBLE + 3.5", lambda p: planes.rotate(p, 20.0))
_R2 = "((x - 3.5) / 4.0::DOUBLE * ((x - 3.5) / 4.0::DOUBLE) + (y - 3.5) / 4.0::DOUBLE * ((y - 3.5) / 4.0::DOUBLE))"
_LF = f"(1 + 0.13::DOUBLE * {_R2} + 0.07::DOUBLE * {_R2} * {_R2})"
_remapped("lens_correction", f"(x - 3.5) / 4.0::DOUBLE * {_LF} * 4 + 3.5", f"(y - 3.5) / 4.0::DOUBLE * {_LF} * 4 + 3.5", lambda p: planes.lens(p, 0.13, 0.07))


def _means(name: str, sql: str | None, f) -> None:
    """Per frame, the mean of red to six digits."""
    plans.query(name, sql)(lambda spark, d: f(media.pixels(spark, d)).groupBy("frame_no").agg(F.round(F.avg("r"), 6).alias("r")))


def _blur_sql(taps: list[float]) -> str:
    reach = len(taps) // 2
    w = ", ".join(f"({i}, {k!r}::DOUBLE)" for i, k in zip(range(-reach, reach + 1), taps))
    return f"""k(i, w) AS (VALUES {w}), h AS (SELECT p.frame_no, p.x, p.y, sum(q.r * w) / sum(w) AS r FROM pixels p, k JOIN pixels q ON q.frame_no = p.frame_no AND q.y = p.y AND q.x = p.x + i GROUP BY ALL),
v AS (SELECT p.frame_no, p.x, p.y, sum(q.r * w) / sum(w) AS r FROM h p, k JOIN h q ON q.frame_no = p.frame_no AND q.x = p.x AND q.y = p.y + i GROUP BY ALL)"""


_frame_means("gaussian_blur", f"WITH {PIXELS}, {_blur_sql(pixels.weights(1.0))} SELECT frame_no, round(avg(r), 6) AS r FROM v GROUP BY frame_no", lambda p: planes.blur(p, 1.0))
_frame_means("unsharp_mask", f"WITH {PIXELS}, {_blur_sql([0.2] * 5)} SELECT p.frame_no, round(avg(p.r + 0.8 * (p.r - v.r)), 6) AS r FROM pixels p JOIN v USING (frame_no, x, y) GROUP BY p.frame_no", lambda p: planes.unsharp(p, 0.8))
_frame_means(
    "glow_highlights",
    f"WITH {PIXELS.replace('pixels AS', 'raw AS')}, pixels AS (SELECT frame_no, x, y, greatest(r - 0.55::DOUBLE, 0.0) / (1 - 0.55::DOUBLE) AS r FROM raw), {_blur_sql(pixels.weights(1.0))} SELECT raw.frame_no, round(avg(least(1.0, raw.r + v.r * 1.5)), 6) AS r FROM raw JOIN v USING (frame_no, x, y) GROUP BY raw.frame_no",
    lambda p: planes.glow(p, 0.55, 1.0, 1.5),
)
_frame_means(
    "glow_node",
    f"WITH {PIXELS.replace('pixels AS', 'raw AS')}, pixels AS (SELECT frame_no, x, y, CASE WHEN 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b >= 0.55::DOUBLE THEN r ELSE 0.0 END AS r FROM raw), {_blur_sql(pixels.weights(1.0))} SELECT raw.frame_no, round(avg(least(1.0, raw.r + v.r * 1.5)), 6) AS r FROM raw JOIN v USING (frame_no, x, y) GROUP BY raw.frame_no",
    lambda p: planes.glow(p, 0.55, 1.0, 1.5, hard=True),
)
_means("chromatic_aberration", f"WITH {PIXELS}, s AS (SELECT frame_no, coalesce(lag(r, 1) OVER (PARTITION BY frame_no, y ORDER BY x), r) AS r FROM pixels) SELECT frame_no, round(avg(r), 6) AS r FROM s GROUP BY frame_no", lambda p: pixels.aberration(p, 1, -1))
_means("motion_blur_mix", f"WITH {PIXELS}, s AS (SELECT frame_no, r * (1 - 0.5) + coalesce(lag(r) OVER (PARTITION BY x, y ORDER BY frame_no), r) * 0.5 AS r FROM pixels) SELECT frame_no, round(avg(r), 6) AS r FROM s GROUP BY frame_no", lambda p: pixels.motion_mix(p, 180.0))
_means("deinterlace_rows", f"WITH {PIXELS}, s AS (SELECT frame_no, CASE WHEN y % 2 = 1 THEN (coalesce(lag(r) OVER w, lead(r) OVER w) + coalesce(lead(r) OVER w, lag(r) OVER w)) / 2 ELSE r END AS r FROM pixels WINDOW w AS (PARTITION BY frame_no, x ORDER BY y)) SELECT frame_no, round(avg(r), 6) AS r FROM s GROUP BY frame_no", pixels.deinterlace)


@plans.query(
    "motion_trail_recursive",
    """WITH RECURSIVE f AS MATERIALIZED (SELECT vec_id % 8 AS stream_id, vec_id AS frame_no, row_number() OVER (PARTITION BY vec_id % 8 ORDER BY vec_id) AS i, CAST(embedding AS DOUBLE[]) AS plane FROM embeddings),
t AS (SELECT stream_id, frame_no, i, plane FROM f WHERE i = 1 UNION ALL
  SELECT f.stream_id, f.frame_no, f.i, list_transform(range(1, len(f.plane) + 1), lambda j: f.plane[j] + (t.plane[j] - f.plane[j]) * 0.4::DOUBLE) FROM t JOIN f ON f.stream_id = t.stream_id AND f.i = t.i + 1)
SELECT stream_id, frame_no, round(list_sum(plane), 6) AS total FROM t""",
)
def motion_trail_recursive(spark, d):
    e = media.table(spark, d, "embeddings")
    frames = e.select((F.col("vec_id") % 8).alias("stream_id"), F.col("vec_id").alias("frame_no"), F.transform("embedding", lambda x: x.cast("double")).alias("plane"))
    return pixels.motion_trail(frames, 0.4).select("stream_id", "frame_no", F.round(F.aggregate("plane", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@plans.query("lut_trilinear", f"WITH {PIXELS} SELECT frame_no, round(avg(1 - r), 6) AS r, round(avg(b), 6) AS g, round(avg(g * 0.5), 6) AS b FROM pixels GROUP BY frame_no")
def lut_trilinear(spark, d):
    """A cube of an affine map: interpolation reproduces the map itself."""
    n = 5
    cube = spark.range(n**3).select((F.col("id") % n).cast("int").alias("r_idx"), (F.floor(F.col("id") / n) % n).cast("int").alias("g_idx"), F.floor(F.col("id") / (n * n)).cast("int").alias("b_idx"))
    cube = cube.select("*", (1 - F.col("r_idx") / (n - 1)).alias("r"), (F.col("b_idx") / (n - 1)).alias("g"), (F.col("g_idx") / (n - 1) * 0.5).alias("b"))
    return pixels.apply_lut(media.pixels(spark, d), cube, n).groupBy("frame_no").agg(*(F.round(F.avg(c), 6).alias(c) for c in RGB))


# ---- measures --------------------------------------------------------------------------------------------------------

_BYTES = f"{PIXELS}, bt AS (SELECT frame_no, x, y, {byte('r')} AS r, {byte('g')} AS g, {byte('b')} AS b FROM pixels)"
_LUMA = "CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) AS INTEGER)"


def _bytes(spark, d):
    return media.pixels(spark, d).select("frame_no", "x", "y", *(fb.to_byte(F.col(c)).alias(c) for c in RGB))


@plans.query(
    "histogram_256",
    f"""WITH {_BYTES}, ch AS (SELECT frame_no, 'r' AS channel, r AS bin FROM bt UNION ALL SELECT frame_no, 'g', g FROM bt UNION ALL SELECT frame_no, 'b', b FROM bt UNION ALL SELECT frame_no, 'luma', {_LUMA} FROM bt),
got AS (SELECT frame_no, channel, bin, count(*) AS n FROM ch GROUP BY ALL), f AS (SELECT DISTINCT frame_no, channel FROM ch)
SELECT f.frame_no, f.channel, CAST(t.i AS INTEGER) AS bin, coalesce(got.n, 0) AS n FROM f CROSS JOIN range(256) t(i) LEFT JOIN got ON got.frame_no = f.frame_no AND got.channel = f.channel AND got.bin = t.i""",
)
def histogram_256(spark, d):
    return _histogram(_bytes(spark, d))


def _histogram(p):
    luma = F.floor(fc.luma601(*(F.col(c) for c in RGB)) + 0.5)
    return analysis.histogram(p, {**{c: F.col(c) for c in RGB}, "luma": luma})


plans.query("histogram_256_whole", ORACLE["histogram_256"])(histogram_256)


@plans.query("luma_bt601", f"WITH {_BYTES} SELECT frame_no, CAST(sum({_LUMA}) AS BIGINT) AS luma FROM bt GROUP BY frame_no")
def luma_bt601(spark, d):
    return _bytes(spark, d).groupBy("frame_no").agg(F.sum(F.floor(fc.luma601(*(F.col(c) for c in RGB)) + 0.5)).alias("luma"))


@plans.query(
    "yuv_to_rgb_int",
    f"""WITH {_BYTES}, o AS (SELECT frame_no, least(255, greatest(0, r + CAST(floor((b - 128) * 1436 / 1024.0) AS INTEGER))) AS r,
  least(255, greatest(0, r - CAST(floor((g - 128) * 352 / 1024.0) AS INTEGER) - CAST(floor((b - 128) * 731 / 1024.0) AS INTEGER))) AS g, least(255, greatest(0, r + CAST(floor((g - 128) * 1815 / 1024.0) AS INTEGER))) AS b FROM bt)
SELECT frame_no, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM o GROUP BY frame_no""",
)
def yuv_to_rgb_int(spark, d):
    p = _bytes(spark, d)
    return _sums(p.select("frame_no", *(v.alias(c) for c, v in zip(RGB, fc.yuv_to_rgb_int(F.col("r"), F.col("g"), F.col("b"))))))


@plans.query("rgb_parade", f"WITH {_BYTES} SELECT frame_no, x, {', '.join(f'round(avg({c} / 255.0::DOUBLE), 6) AS {c}' for c in RGB)} FROM bt GROUP BY frame_no, x")
def rgb_parade(spark, d):
    return _bytes(spark, d).groupBy("frame_no", "x").agg(*(F.round(F.avg(F.col(c) / 255), 6).alias(c) for c in RGB))


@plans.query("waveform_monitor", f"WITH {_BYTES} SELECT frame_no, x, string_agg(CAST(r AS VARCHAR), ',' ORDER BY y) AS levels FROM bt GROUP BY frame_no, x")
def waveform_monitor(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("y", "r")))
    return _bytes(spark, d).groupBy("frame_no", "x").agg(F.array_join(F.transform(ordered, lambda s: s["r"].cast("string")), ",").alias("levels"))


@plans.query("vectorscope", f"WITH {_BYTES} SELECT frame_no, x, y, round(g / 255.0::DOUBLE - 0.5, 6) AS cb, round(b / 255.0::DOUBLE - 0.5, 6) AS cr FROM bt WHERE x % 2 = 0 AND y % 2 = 0")
def vectorscope(spark, d):
    return _bytes(spark, d).filter("x % 2 = 0 AND y % 2 = 0").select("frame_no", "x", "y", F.round(F.col("g") / 255 - 0.5, 6).alias("cb"), F.round(F.col("b") / 255 - 0.5, 6).alias("cr"))


_LAP = f"""{_BYTES}, n AS (SELECT *, lag(r) OVER h + lead(r) OVER h + lag(r) OVER v + lead(r) OVER v - 4 * r AS l FROM bt WINDOW h AS (PARTITION BY frame_no, y ORDER BY x), v AS (PARTITION BY frame_no, x ORDER BY y)),
lap AS (SELECT frame_no, avg(r) AS luma, var_pop(l) AS sharpness FROM n GROUP BY frame_no)"""


@plans.query("laplacian_variance", f"WITH {_LAP} SELECT frame_no, round(luma, 6) AS luma, round(sharpness, 6) AS sharpness FROM lap")
def laplacian_variance(spark, d):
    return analysis.laplacian(_bytes(spark, d), "r").select("frame_no", F.round("luma", 6).alias("luma"), F.round("sharpness", 6).alias("sharpness"))


@plans.query(
    "thumbnail_select",
    f"""WITH {_LAP}, ok AS (SELECT frame_no // 10 AS clip, frame_no, round(sharpness, 6) AS sharpness FROM lap WHERE luma BETWEEN 10 AND 245)
SELECT clip, coalesce(min(CASE WHEN sharpness >= 4000 THEN frame_no END), (SELECT o.frame_no FROM ok o WHERE o.clip = ok.clip ORDER BY o.sharpness DESC, o.frame_no LIMIT 1)) AS frame_no FROM ok GROUP BY clip""",
)
def thumbnail_select(spark, d):
    lap = analysis.laplacian(_bytes(spark, d), "r").withColumns({"clip": F.floor(F.col("frame_no") / 10), "sharpness": F.round("sharpness", 6)})
    return analysis.choose_thumbnail(lap, ["clip"], sharp=4000.0)


@plans.query(
    "psnr_pairs",
    f"WITH {_BYTES}, m AS (SELECT a.frame_no, avg((a.r - b.r) * (a.r - b.r)) AS mse FROM bt a JOIN bt b ON b.frame_no = a.frame_no + 1 AND a.x = b.x AND a.y = b.y GROUP BY a.frame_no) SELECT frame_no, round(mse, 6) AS mse, CASE WHEN mse > 0 THEN round(10 * log10(255.0 * 255.0 / mse), 6) END AS psnr FROM m",
)
def psnr_pairs(spark, d):
    p = _bytes(spark, d)
    after = media.next_frames(p)
    both = p.join(after.select("frame_no", "x", "y"), pixels.KEY, "left_semi")
    shown = after.join(p.select("frame_no", "x", "y"), pixels.KEY, "left_semi")
    out = analysis.mean_psnr(both, shown, "r")
    return out.select("frame_no", F.round("mse", 6).alias("mse"), F.when(F.col("psnr") < float("inf"), F.round("psnr", 6)).alias("psnr"))


@plans.query(
    "ssim_pairs",
    f"""WITH {_BYTES}, m AS (SELECT a.frame_no, avg(a.r) AS mu, avg(b.r) AS mv, var_pop(a.r) AS vu, var_pop(b.r) AS vv, covar_pop(a.r, b.r) AS c FROM bt a JOIN bt b ON b.frame_no = a.frame_no + 1 AND a.x = b.x AND a.y = b.y GROUP BY a.frame_no)
SELECT frame_no, round((2 * mu * mv + 6.5025) * (2 * c + 58.5225) / ((mu * mu + mv * mv + 6.5025) * (vu + vv + 58.5225)), 6) AS ssim FROM m""",
)
def ssim_pairs(spark, d):
    p = _bytes(spark, d)
    return analysis.ssim(p, media.next_frames(p), "r").select("frame_no", F.round("ssim", 6).alias("ssim"))


@plans.query(
    "frame_difference",
    f"WITH {PIXELS} SELECT a.frame_no, round(avg((abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b)) / 3), 6) AS score FROM pixels a JOIN pixels b ON b.frame_no + 1 = a.frame_no AND a.x = b.x AND a.y = b.y GROUP BY a.frame_no",
)
def frame_difference(spark, d):
    return analysis.frame_difference(media.pixels(spark, d)).select("frame_no", F.round("score", 6).alias("score"))
