"""Subtitle files as tables: (index, start_ns, end_ns, text, raw), and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock_to_ns, ns_to_clock, strip_ass, strip_html

ARROW = r"^\s*([0-9:.,]+)\s*-->\s*([0-9:.,]+).*$"


def parse_blocks(files: DataFrame, content: str = "content") -> DataFrame:
    """SRT and WebVTT: blocks separated by empty lines; blocks without a valid time line are skipped. ``files`` has
    path and ``content``."""
    blocks = F.split(F.regexp_replace(F.regexp_replace(content, "\r\n?", "\n"), "^﻿", ""), r"\n[ \t]*\n+")
    lines = files.select("path", F.posexplode(blocks).alias("block", "b")).withColumn("lines", F.split(F.btrim("b", F.lit(" \t\n")), "\n"))
    at = F.array_position(F.transform("lines", lambda x: x.rlike(ARROW)), True)
    timed = lines.withColumn("at", at).filter("at > 0").withColumn("time", F.get("lines", F.col("at").cast("int") - 1))
    out = timed.select(
        "path",
        "block",
        clock_to_ns(F.regexp_extract("time", ARROW, 1)).alias("start_ns"),
        clock_to_ns(F.regexp_extract("time", ARROW, 2)).alias("end_ns"),
        F.array_join(F.slice("lines", F.col("at").cast("int") + 1, F.size("lines")), "\n").alias("raw"),
    ).filter("start_ns IS NOT NULL AND end_ns IS NOT NULL AND end_ns >= start_ns AND raw <> ''")
    return out.withColumns({"text": strip_html(F.col("raw")), "index": F.expr("row_number() OVER (PARTITION BY path ORDER BY block)")}).drop("block")


def parse_ass(files: DataFrame, content: str = "content") -> DataFrame:
    """The Dialogue lines of the event section: ten comma-separated fields, the last of which is the text."""
    lines = files.select("path", F.posexplode(F.split(content, r"\r?\n")).alias("line", "b")).filter(F.col("b").rlike(r"^Dialogue:"))
    fields = F.split(F.regexp_replace("b", r"^Dialogue:\s*", ""), ",", 10)
    out = lines.select("path", "line", clock_to_ns(F.get(fields, 1)).alias("start_ns"), clock_to_ns(F.get(fields, 2)).alias("end_ns"), F.get(fields, 9).alias("raw"))
    out = out.filter("start_ns IS NOT NULL AND end_ns IS NOT NULL AND raw IS NOT NULL")
    return out.withColumns({"text": strip_ass(F.col("raw")), "index": F.expr("row_number() OVER (PARTITION BY path ORDER BY line)")}).drop("line")


def demand_events(files: DataFrame, events: DataFrame) -> DataFrame:
    """``events``; the job fails when it reaches a file of ``files`` (path) that has none."""
    counted = events.groupBy("path").agg(F.count("*").alias("n"))
    checked = files.select("path").join(counted, "path", "left").withColumn("ok", F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("no subtitle events in "), "path"))).otherwise(F.lit(True)))
    return events.join(checked.filter("ok").select("path"), "path")


def read(spark: SparkSession, paths: str | list[str], *, strict: bool = True) -> DataFrame:
    """Files by extension: .srt and .vtt, or .ass and .ssa. A file without events is an error when ``strict``."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    ass = F.lower("path").rlike(r"\.(ass|ssa)$")
    events = parse_blocks(files.filter(~ass)).unionByName(parse_ass(files.filter(ass)))
    return demand_events(files, events) if strict else events


def format_srt(events: DataFrame, by: str = "path") -> DataFrame:
    """(by, content): the events of each file as SRT text, in time order."""
    block = F.concat_ws("\n", F.col("index").cast("string"), F.concat(ns_to_clock(F.col("start_ns")), F.lit(" --> "), ns_to_clock(F.col("end_ns"))), F.col("text"))
    rows = events.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start_ns", "index", block.alias("b")))).alias("e"))
    return rows.select(by, F.concat(F.array_join(F.transform("e", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("content"))


def _written(events: DataFrame, by: str, head: str, block, between: str) -> DataFrame:
    rows = events.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start_ns", "index", block.alias("b")))).alias("e"))
    return rows.select(by, F.concat(F.lit(head), F.array_join(F.transform("e", lambda x: x["b"]), between), F.lit("\n")).alias("content"))


def format_vtt(events: DataFrame, by: str = "path") -> DataFrame:
    """(by, content): the events of each file as WebVTT text, in time order."""
    clock = lambda c: F.replace(ns_to_clock(F.col(c)), F.lit(","), F.lit("."))
    return _written(events, by, "WEBVTT\n\n", F.concat(clock("start_ns"), F.lit(" --> "), clock("end_ns"), F.lit("\n"), F.col("text")), "\n\n")


def format_ass(events: DataFrame, by: str = "path") -> DataFrame:
    """(by, content): the events of each file as the event section of an ASS file; times in hundredths."""

    def clock(c: str):
        s = F.floor(F.col(c) / 10_000_000)
        return F.format_string("%d:%02d:%02d.%02d", F.floor(s / 360_000), F.floor(s / 6000) % 60, F.floor(s / 100) % 60, s % 100)

    head = "[Script Info]\nScriptType: v4.00+\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    line = F.concat(F.lit("Dialogue: 0,"), clock("start_ns"), F.lit(","), clock("end_ns"), F.lit(",Default,,0,0,0,,"), F.replace("text", F.lit("\n"), F.lit("\\N")))
    return _written(events, by, head, line, "\n")
