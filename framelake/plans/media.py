"""The driver's tables read as media, in Spark and, as text, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: stream = user, t_us = microseconds, value as it is."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "event_id", "event_type", "value")


SAMPLES = "samples AS (SELECT user_id AS stream_id, epoch_us(ts) AS t_us, event_id, event_type, value FROM events)"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples numbered in each stream, values scaled to about [-1, 1], two channels by turns of the id."""
    s = samples(spark, sf_dir)
    n = F.expr("row_number() OVER (PARTITION BY stream_id ORDER BY t_us, event_id) - 1")
    return s.select("stream_id", n.cast("long").alias("n"), (F.col("event_id") % 2).cast("int").alias("ch"), (F.col("value") / 100).alias("value"), "t_us")


NUMBERED = f"""{SAMPLES},
numbered AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t_us, event_id) - 1 AS n, CAST(event_id % 2 AS INTEGER) AS ch, value / 100 AS value, t_us FROM samples)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 frames; green and blue are the same plane shifted by a third."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i"))
    at = lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.get("embedding", (F.col("i") + k) % 64).cast("double") + 1) / 2))
    return e.select("frame_no", (F.col("i") % SIDE).cast("int").alias("x"), F.floor(F.col("i") / SIDE).cast("int").alias("y"), at(0).alias("r"), at(21).alias("g"), at(42).alias("b"))


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as rows with planes."""
    at = lambda k: F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.get("embedding", (i + k) % 64).cast("double") + 1) / 2)))
    side = F.lit(SIDE).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"), side.alias("w"), side.alias("h"), *(at(k).alias(c) for k, c in ((0, "r"), (21, "g"), (42, "b"))))


def _plane(k: int) -> str:
    return f"least(1.0, greatest(0.0, (CAST(embedding[(i + {k}) % 64 + 1] AS DOUBLE) + 1) / 2))"


PIXELS = f"""pixels AS (SELECT vec_id AS frame_no, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, {_plane(0)} AS r, {_plane(21)} AS g, {_plane(42)} AS b
  FROM embeddings, range(64) AS t(i))"""
#: Each frame with the next one as the overlay.
PAIRS = f"""{PIXELS}, pairs AS (SELECT p.*, q.r AS r2, q.g AS g2, q.b AS b2 FROM pixels p JOIN pixels q ON q.frame_no = p.frame_no + 1 AND q.x = p.x AND q.y = p.y)"""


def next_frames(p: DataFrame) -> DataFrame:
    return p.withColumn("frame_no", F.col("frame_no") - 1)


def byte(v: str) -> str:
    return f"CAST(floor(greatest(0.0, least(1.0, {v})) * 255 + 0.5) AS INTEGER)"


_SORT = "l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"


#: Line items of a task where they are dealt by their number, tasks up to which Spark writes a shuffle without sorting (and
#: holding) it, and line items from which on there are more.
TASK_ROWS, UNSORTED_TASKS, MOST_TASK_ROWS = 500_000, 200, 4_000_000


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Over how many tasks the line items are dealt, so that a task's sorts don't grow with the table; None where Spark's
    own choice is as many."""
    rows = table(spark, sf_dir, "lineitem").count()
    n = max(min(rows // TASK_ROWS, UNSORTED_TASKS), rows // MOST_TASK_ROWS)
    return n if n > spark.sparkContext.defaultParallelism else None


def clips(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Line items as clips on tracks (orders); times are whole milliseconds in ns. ``tasks``: over how many the tracks are
    dealt (default: Spark's choice)."""
    li = table(spark, sf_dir, "lineitem")
    li = li.repartition(tasks, "l_orderkey") if tasks else li
    pos = F.expr(f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SORT}) - 1")
    ms = lambda c: (F.round(c).cast("long") * 1_000_000)
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / DAY_US)
    out = li.select(F.col("l_orderkey").alias("track_id"), pos.cast("long").alias("pos"), "*")
    out = out.withColumn("clip_id", F.col("track_id") * 100 + F.col("pos"))
    return out.select(
        "track_id",
        "clip_id",
        "pos",
        F.when(F.col("l_returnflag") == "A", F.col("track_id")).alias("group_id"),
        F.when(F.col("l_partkey") % 10 == 0, "text").otherwise("file").alias("source_kind"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("source_path"),
        ms(F.col("l_discount") * 100_000).alias("in_ns"),
        F.when(F.col("l_suppkey") % 7 != 0, ms(F.col("l_discount") * 100_000 + F.col("l_quantity") * 1000)).alias("out_ns"),
        (F.pmod(day, F.lit(97)).cast("long") * 1_000_000_000).alias("offset_ns"),
        (1 + F.round(F.col("l_tax") * 100) / 4).alias("speed"),
        ms(F.col("l_tax") * 100_000).alias("fade_in_ns"),
        ms(F.col("l_quantity") * 100).alias("fade_out_ns"),
        ms(F.col("l_quantity") * 50).alias("transition_ns"),
        ms(F.col("l_discount") * 100_000 + F.col("l_quantity") * 1020).alias("source_ns"),
    )


def _ms(v: str) -> str:
    return f"CAST(round({v}) AS BIGINT) * 1000000"


CLIPS = f"""li AS (SELECT *, l_orderkey AS track_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SORT}) - 1 AS pos FROM lineitem),
clips AS (SELECT track_id, track_id * 100 + pos AS clip_id, pos, CASE WHEN l_returnflag = 'A' THEN track_id END AS group_id,
  CASE WHEN l_partkey % 10 = 0 THEN 'text' ELSE 'file' END AS source_kind, 'part-' || l_partkey AS source_path,
  {_ms('l_discount * 100000')} AS in_ns, CASE WHEN l_suppkey % 7 <> 0 THEN {_ms('l_discount * 100000 + l_quantity * 1000')} END AS out_ns,
  (epoch_us(l_shipdate) // {DAY_US}) % 97 * 1000000000 AS offset_ns, 1 + round(l_tax * 100) / 4 AS speed,
  {_ms('l_tax * 100000')} AS fade_in_ns, {_ms('l_quantity * 100')} AS fade_out_ns, {_ms('l_quantity * 50')} AS transition_ns,
  {_ms('l_discount * 100000 + l_quantity * 1020')} AS source_ns FROM li),
spans AS (SELECT *, CAST(floor((out_ns - in_ns) / greatest(speed, 0.01)) AS BIGINT) AS footprint_ns, offset_ns + CAST(floor((out_ns - in_ns) / greatest(speed, 0.01)) AS BIGINT) AS end_ns FROM clips)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tracks of timelines (customers)."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("timeline_id"),
        F.col("o_orderkey").alias("track_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "audio").otherwise("video").alias("kind"),
        (F.col("o_orderstatus") == "F").alias("mute"),
        (F.substring("o_orderpriority", 1, 1) == "1").alias("solo"),
        (F.col("o_orderstatus") != "P").alias("enabled"),
    )


TRACKS = """tracks AS (SELECT o_custkey AS timeline_id, o_orderkey AS track_id, CASE WHEN o_orderkey % 3 = 0 THEN 'audio' ELSE 'video' END AS kind,
  o_orderstatus = 'F' AS mute, o_orderpriority[1] = '1' AS solo, o_orderstatus <> 'P' AS enabled FROM orders)"""
