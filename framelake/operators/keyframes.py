"""Keyframe interpolation: as-of lookup of the segment, easing, linear mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.easing import ease


def segments(keyframes: DataFrame) -> DataFrame:
    """(owner_id, prop) tracks as segments: of equal times the last written (largest ``seq``) stays."""
    key = ["owner_id", "prop"]
    row = F.struct("value", "easing", "x1", "y1", "x2", "y2")
    kept = keyframes.groupBy(*key, "ts_ns").agg(F.max_by(row, "seq").alias("k"))
    w = Window.partitionBy(*key).orderBy("ts_ns")
    return kept.select(
        *key, F.col("ts_ns").alias("t0"), F.lead("ts_ns").over(w).alias("t1"), F.col("k.value").alias("v0"), F.lead("k.value").over(w).alias("v1"), "k.easing", "k.x1", "k.y1", "k.x2", "k.y2",
    )


def value_at(times: DataFrame, keyframes: DataFrame) -> DataFrame:
    """``times`` (owner_id, prop, ts_ns, ...) with value: the first before any keyframe, the last after all, else eased
    between two; a keyframe at exactly that time starts its segment. Null for a track without keyframes. Of equal times the
    last written keyframe stays; one without owner, property or time belongs to no track. One shuffle and one sort."""
    key = ["owner_id", "prop"]
    fields = ["ts_ns", "value", "easing", "x1", "y1", "x2", "y2"]
    own = [c for c in times.columns if c not in (*key, "ts_ns", "value")]
    empty = lambda row: F.lit(None).cast(row)
    rows = times.select(*key, "ts_ns", F.lit(True).alias("_asked"), empty(keyframes.schema["seq"].dataType).alias("_seq"), F.struct(*own).alias("_row"), empty(keyframes.select(F.struct(*fields)).schema[0].dataType).alias("_key"))
    keys = keyframes.filter("owner_id IS NOT NULL AND prop IS NOT NULL AND ts_ns IS NOT NULL")
    keys = keys.select(*key, "ts_ns", F.lit(False).alias("_asked"), F.col("seq").alias("_seq"), empty(rows.schema["_row"].dataType).alias("_row"), F.struct(*fields).alias("_key"))
    # Times and keyframes meet in one order, which both windows share: a keyframe comes before times equal to its own, and
    # one with another of its own time right after it has been overwritten.
    w = "PARTITION BY owner_id, prop ORDER BY ts_ns, _asked, _seq"
    both = rows.unionByName(keys).withColumn("_after", F.expr(f"lead(IF(_asked, NULL, ts_ns)) OVER ({w})"))
    both = both.withColumn("_key", F.when(F.col("_after").isNull() | (F.col("_after") != F.col("ts_ns")), F.col("_key")))
    both = both.withColumns({
        "_from": F.expr(f"last(_key) IGNORE NULLS OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
        "_to": F.expr(f"lead(_key) IGNORE NULLS OVER ({w})"),
    }).filter("_asked")
    a, b = F.col("_from"), F.col("_to")
    u = ease(a["easing"], (F.col("ts_ns") - a["ts_ns"]) / (b["ts_ns"] - a["ts_ns"]), *(a[c] for c in ("x1", "y1", "x2", "y2")))
    value = F.when(a.isNull(), b["value"]).when(b.isNull(), a["value"]).otherwise(a["value"] + (b["value"] - a["value"]) * u)
    return both.select(*key, "ts_ns", *(F.col("_row")[c].alias(c) for c in own), value.alias("value"))


#: Keyframes of one property that ``animate`` broadcasts at most.
MOST_KEYFRAMES = 100_000


def animate(frames: DataFrame, keyframes: DataFrame, props: list[str], frame: str = "frame_no") -> DataFrame:
    """``frames`` with a column for each property: its track's value at the frame's number (owner 0). Tracks are looked
    up once a frame, not once a pixel. Each track is broadcast as one sorted array; tracks of more than MOST_KEYFRAMES
    keyframes are joined as of each frame instead."""
    times = frames.select(frame).distinct().select(F.lit(0).cast("long").alias("owner_id"), F.explode(F.array(*map(F.lit, props))).alias("prop"), F.col(frame).cast("long").alias("ts_ns"))
    wanted = keyframes.filter((F.col("owner_id") == 0) & F.col("prop").isin(props))
    if (wanted.groupBy("prop").count().agg(F.max("count")).first()[0] or 0) > MOST_KEYFRAMES:
        valued = value_at(times, keyframes)
    else:
        fields = ["t0", "t1", "v0", "v1", "easing", "x1", "y1", "x2", "y2"]
        tracks = segments(wanted).groupBy("prop").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("track"))
        found = times.join(F.broadcast(tracks), "prop", "left")
        found = found.withColumn("s", F.get(F.filter("track", lambda s: s["t0"] <= F.col("ts_ns")), F.size(F.filter("track", lambda s: s["t0"] <= F.col("ts_ns"))) - 1))
        u = ease(F.col("s.easing"), (F.col("ts_ns") - F.col("s.t0")) / (F.col("s.t1") - F.col("s.t0")), *(F.col(f"s.{c}") for c in ("x1", "y1", "x2", "y2")))
        value = F.when(F.col("s").isNull(), F.get("track", 0)["v0"]).when(F.col("s.t1").isNull(), F.col("s.v0")).otherwise(F.col("s.v0") + (F.col("s.v1") - F.col("s.v0")) * u)
        valued = found.select("prop", "ts_ns", value.alias("value"))
    values = valued.groupBy("ts_ns").agg(*(F.max(F.when(F.col("prop") == p, F.col("value"))).alias(p) for p in props))
    return frames.join(values.withColumnRenamed("ts_ns", frame), frame, "left")
