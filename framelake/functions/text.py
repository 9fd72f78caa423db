"""Subtitle text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def strip_ass(text: Column) -> Column:
    """Override blocks go, line-break marks become newlines."""
    return F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\}", ""), r"\\[Nn]", "\n")


def clock_to_ns(text: Column) -> Column:
    """Nanoseconds of [HH:]MM:SS with , or . and a fraction of up to nine digits; null if it doesn't parse."""
    pattern = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[.,](\d{1,9}))?\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = lambda i: part(i).try_cast("long")
    whole = (F.coalesce(number(1), F.lit(0)) * 60 + number(2)) * 60 + number(3)
    return F.when(text.rlike(pattern), whole * 1_000_000_000 + F.rpad(part(4), 9, "0").try_cast("long"))


def ns_to_clock(ns: Column, comma: bool = True) -> Column:
    """HH:MM:SS,mmm (or with a point)."""
    ms = F.floor(ns / 1_000_000)
    pad = lambda v, n=2: F.lpad(v.cast("long").cast("string"), n, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), pad(F.floor(ms / 60_000) % 60), F.lit(":"), pad(F.floor(ms / 1000) % 60), F.lit("," if comma else "."), pad(ms % 1000, 3))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case, null without one."""
    found = F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))
    return F.when(found != "", found)
