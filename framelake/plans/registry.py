"""All registered queries of the library itself (the ten pipeline operators register themselves)."""

from __future__ import annotations

from . import audio, delivery, extras, levels, more, pictures, sourced, steps, timelines

FLAGSHIP = "waveform_gap_filled"
MODULES = (levels, audio, pictures, timelines, extras, steps, delivery, sourced, more)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
