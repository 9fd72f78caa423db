"""What a chain of steps asks for, looked at before any frame is read. Steps are rows: (step_id, kind, params map<string, double>)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (kinds, parameter, least, most, whether the least itself is refused): fixed values. None is no bound. A parameter that a
#: step doesn't have is not looked at. An animated parameter is looked at by its first value.
RULES = [
    ("speed", "factor", 0.1, 100.0, False),
    ("loudness_normalize", "lra", 1.0, 50.0, False),
    ("loudness_normalize", "true_peak_db", None, 0.0, False),
    ("normalize_peak", "target_db", None, 0.0, False),
    ("freeze_frame", "pts", 0.0, None, False),
    ("freeze_frame", "duration", 0.0, None, True),
    ("crop crop_animated rect_mask pad fit_to_aspect fill_to_aspect", "width", 0.0, None, True),
    ("crop crop_animated rect_mask pad fit_to_aspect fill_to_aspect", "height", 0.0, None, True),
    ("gblur gblur_animated", "sigma", 0.0, None, False),
    ("unsharp unsharp_animated", "luma_strength", -1.5, 1.5, False),
    ("unsharp unsharp_animated", "chroma_strength", -1.5, 1.5, False),
    ("eq eq_animated", "brightness", -1.0, 1.0, False),
    ("eq eq_animated", "contrast", 0.0, 3.0, False),
    ("eq eq_animated", "saturation", 0.0, 3.0, False),
    ("eq_animated", "gamma", 0.1, 10.0, False),
    ("eq eq_animated", "temperature", -1.0, 1.0, False),
    ("eq eq_animated white_balance", "tint", -1.0, 1.0, False),
    ("color_balance_animated", "lift", -1.0, 1.0, False),
    ("color_balance_animated", "gamma", -1.0, 1.0, False),
    ("color_balance_animated", "gain", -1.0, 1.0, False),
    ("fade_in fade_out fade_in_white fade_out_white afade_in afade_out xfade", "duration", 0.0, None, True),
    ("noise_gate compressor", "attack_ms", 0.0, None, True),
    ("noise_gate compressor", "release_ms", 0.0, None, True),
    ("compressor", "ratio", 1.0, None, False),
    ("concat_video concat_audio", "n", 2.0, None, False),
    ("draw_text overlay_image", "opacity", 0.0, 1.0, False),
    ("ticker", "speed_px_per_sec", 0.0, None, True),
    ("overlay", "x", 0.0, None, False),
    ("overlay", "y", 0.0, None, False),
    ("chroma_key color_key", "similarity", 0.0, 1.0, False),
    ("chroma_key color_key", "blend", 0.0, 1.0, False),
    ("spill_suppress", "strength", 0.0, 1.0, False),
    ("luma_key", "threshold", 0.0, 1.0, False),
    ("luma_key", "tolerance", 0.0, 1.0, False),
    ("luma_key", "softness", 0.0, 1.0, False),
    ("feather_mask", "radius", 0.0, None, True),
    ("polygon_matte", "vertices", 3.0, 16.0, False),
    ("white_balance", "temperature_k", 1000.0, 40000.0, False),
    ("hue", "degrees", -360.0, 360.0, False),
    ("gamma", "r", 0.1, 10.0, False),
    ("gamma", "g", 0.1, 10.0, False),
    ("gamma", "b", 0.1, 10.0, False),
    ("three_way three_way_animated", "gamma", 0.0, None, True),
    ("vignette", "angle", 0.0, math.pi / 2, False),
    ("vignette_animated", "amount", 0.0, 1.0, False),
    ("hqdn3d", "luma_spatial", 0.0, None, False),
    ("hqdn3d", "chroma_spatial", 0.0, None, False),
    ("hqdn3d", "luma_tmp", 0.0, None, False),
    ("hqdn3d", "chroma_tmp", 0.0, None, False),
    ("nlmeans", "strength", 1.0, 30.0, False),
]
#: Steps whose target must lie under 0: fixed values.
UNDER_ZERO = [("loudness_normalize", "target_lufs")]
#: Steps that may leave a frame at another size: fixed values.
SIZE_CHANGING = ["crop", "crop_animated", "fill_to_aspect", "fit_to_aspect", "pad", "parse_desc", "raw", "rotate", "rotate_animated", "scale", "scale_animated", "scale_multiplier"]


def faults(steps: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, kind, param, value): a row for each parameter out of its range; nan is out of every range."""
    checks = []
    for kinds, name, least, most, open_ in RULES + [(k, p, None, 0.0, False) for k, p in UNDER_ZERO]:
        v = F.col("params")[name]
        bad = F.isnan(v)
        if least is not None:
            bad = bad | ((v <= least) if open_ else (v < least))
        if most is not None:
            bad = bad | ((v >= most) if (kinds, name) in UNDER_ZERO else (v > most))
        checks.append(F.when(F.col("kind").isin(kinds.split(" ")) & bad, F.struct(F.lit(name).alias("param"), v.alias("value"))))
    return steps.select(*keep, "kind", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("f")).select(*keep, "kind", "f.*")


def may_change_size(kind: Column) -> Column:
    return kind.isin(SIZE_CHANGING)
