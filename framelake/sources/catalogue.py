"""What a probe tells of files: containers and chapters from stream tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containers(streams: DataFrame) -> DataFrame:
    """One row a file from ``streams`` (path, kind, stream_index, duration_ns, size): how many streams of each kind, the
    primary ones, the longest stream's duration, the size, and the bits a second over all."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("stream_index")))
    many = lambda kind: F.count_if(F.col("kind") == kind)
    out = streams.groupBy("path").agg(
        many("video").alias("n_video"), many("audio").alias("n_audio"), first("video").alias("primary_video"), first("audio").alias("primary_audio"), F.max("duration_ns").alias("duration_ns"), F.sum("size").alias("size")
    )
    rate = F.when(F.col("duration_ns") > 0, F.round(F.col("size") * 8e9 / F.col("duration_ns")).cast("long"))
    return out.withColumn("bit_rate", rate)


def chapters(marks: DataFrame, durations: DataFrame) -> DataFrame:
    """(path, number, start_ns, end_ns, title): a chapter lasts from its mark (path, start_ns, title) to the next one, the
    last one to the file's end (path, duration_ns). Marks beyond the end give none."""
    w = Window.partitionBy("path").orderBy("start_ns", "title")
    numbered = marks.join(durations, "path").filter("start_ns < duration_ns").withColumns({"number": F.row_number().over(w), "end_ns": F.coalesce(F.lead("start_ns").over(w), F.col("duration_ns"))})
    return numbered.select("path", "number", "start_ns", "end_ns", "title")
