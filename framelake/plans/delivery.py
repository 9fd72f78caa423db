"""Containers, presets, proxies, sequences, generated sources, blocks of samples, metadata, formats, and live sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio, select
from ..operators import delivery as dv
from ..streaming import live
from . import media
from .media import DAY_US, SAMPLES
from .register import Plans
from .timelines import _streamed

plans = Plans()
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE

_NAMES = "CASE p_partkey % 6 WHEN 0 THEN '/a/b.' || p_partkey || '.MP4' WHEN 1 THEN 'c.mkv' WHEN 2 THEN 'd.txt' WHEN 3 THEN 'e' WHEN 4 THEN 'f.webm' ELSE 'g.m4v' END"


def _names(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 6 == 0, F.concat(F.lit("/a/b."), k.cast("string"), F.lit(".MP4"))).when(k % 6 == 1, "c.mkv").when(k % 6 == 2, "d.txt").when(k % 6 == 3, "e").when(k % 6 == 4, "f.webm").otherwise("g.m4v")
    return media.table(spark, d, "part").select("p_partkey", name.alias("path"), "p_size")


@plans.query("container_by_name", f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'mp4' WHEN 1 THEN 'matroska' WHEN 4 THEN 'webm' WHEN 5 THEN 'mp4' END AS container FROM part WHERE {_NAMES} IS NOT NULL")
def container_by_name(spark, d):
    return _names(spark, d).select("p_partkey", dv.container_of(F.col("path")).alias("container"))


_TRIED = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'youtube_4k' WHEN 1 THEN 'instagram_square' WHEN 2 THEN 'instagram_reels' ELSE 'twitter' END AS name, p_size * 9 AS width, CASE WHEN p_partkey % 3 = 0 THEN p_size * 16 ELSE p_size * 9 END AS height, p_size * 2.0 AS fps FROM part"


@plans.query(
    "preset_limits",
    f"""WITH t AS ({_TRIED}) SELECT p_partkey, 'fps' AS fault FROM t WHERE name IN ('youtube_4k', 'instagram_reels') AND fps > 60
UNION ALL SELECT p_partkey, 'aspect' FROM t WHERE name = 'instagram_square' AND width <> height OR name = 'instagram_reels' AND width * 16 <> height * 9""",
)
def preset_limits(spark, d):
    """Presets with sizes and rates of their own, against their platforms' limits."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, "youtube_4k").when(k % 4 == 1, "instagram_square").when(k % 4 == 2, "instagram_reels").otherwise("twitter")
    tried = media.table(spark, d, "part").select(
        "p_partkey", name.alias("preset"), (F.col("p_size") * 9).alias("width"), F.when(k % 3 == 0, F.col("p_size") * 16).otherwise(F.col("p_size") * 9).alias("height"), (F.col("p_size") * 2.0).alias("fps")
    )
    return dv.preset_faults(tried.withColumnRenamed("preset", "name"), keep=["p_partkey"]).select("p_partkey", "fault")


@plans.query(
    "preset_catalogue",
    """SELECT p_partkey, name, height, fps, audio_codec FROM part JOIN (SELECT *, row_number() OVER (ORDER BY name) - 1 AS i FROM (VALUES ('bluray_1080p', 1080, 24.0::DOUBLE, 'ac3'), ('instagram_reels', 1920, 30.0, 'aac'), ('instagram_square', 1080, 30.0, 'aac'), ('lossless_rgb', NULL, NULL, 'flac'), ('podcast_mono', NULL, NULL, 'aac'), ('twitter', 720, 30.0, 'aac'), ('web_h264', 720, 30.0, 'opus'), ('youtube_1080p', 1080, 30.0, 'aac'), ('youtube_4k', 2160, 30.0, 'aac')) AS v(name, height, fps, audio_codec)) ON p_partkey % 9 = i""",
)
def preset_catalogue(spark, d):
    """Each part exported by one of the presets, taken in turn by name."""
    names = F.array_sort(F.array(*(F.lit(r.name) for r in dv.presets(spark).select("name").collect())))
    asked = media.table(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % F.size(names)).cast("int")).alias("name"))
    return asked.join(F.broadcast(dv.presets(spark)), "name").select("p_partkey", "name", "height", "fps", "audio_codec")


@plans.query(
    "proxy_sizes",
    f"SELECT p_partkey, p.proxy, regexp_replace(path, '\\.[^./]*$', '') || '_proxy_' || p.proxy || '.mp4' AS proxy_path, CAST(p_size * 41 // p.d // 2 * 2 AS INTEGER) AS proxy_width, CAST(p_size * 23 // p.d // 2 * 2 AS INTEGER) AS proxy_height FROM (SELECT *, {_NAMES} AS path FROM part), (VALUES ('half', 2), ('quarter', 4), ('eighth', 8)) AS p(proxy, d)",
)
def proxy_sizes(spark, d):
    sources = _names(spark, d).select("p_partkey", "path", (F.col("p_size") * 41).alias("width"), (F.col("p_size") * 23).alias("height"))
    return dv.proxies(sources, keep=["p_partkey"]).select("p_partkey", "proxy", "proxy_path", "proxy_width", "proxy_height")


@plans.query("video_classes", "SELECT p_partkey, round(CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE p_size * 60.0::DOUBLE / (p_size % 10 * 270) END, 6) AS aspect, p_size % 10 * 270 >= 720 AS hd, p_size % 10 * 270 >= 1080 AS full_hd, p_size % 10 * 270 >= 2160 AS uhd, p_partkey % 2 = 0 AND 8 + p_partkey % 3 >= 10 AS hdr FROM part")
def video_classes(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    aspect, *flags = dv.video_class(s * 60, s % 10 * 270, k % 2 == 0, 8 + k % 3)
    return media.table(spark, d, "part").select("p_partkey", F.round(aspect, 6).alias("aspect"), *flags)


@plans.query(
    "image_sequence",
    "WITH f AS (SELECT 'shot' || (c_nationkey) || '/' AS folder, c_custkey AS number FROM customer WHERE c_custkey % 11 <> 0) SELECT folder, number, CAST(round((number - min(number) OVER (PARTITION BY folder)) * (1e9 / 24)) AS BIGINT) AS ts_ns FROM f",
)
def image_sequence(spark, d):
    """Numbered pictures in folders; files without a number are no frames."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("shot"), F.col("c_nationkey").cast("string"), F.lit("/"), F.when(k % 11 == 0, "cover").otherwise(F.format_string("v2_%05d", k)), F.lit(".exr"))
    return dv.sequence_frames(media.table(spark, d, "customer").select(name.alias("path")), 24.0).select("folder", "number", "ts_ns")


@plans.query(
    "generated_tone",
    "SELECT s_suppkey, range AS n, round(CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE 0.5 * sin(range * (2 * 3.141592653589793::DOUBLE * (220 + s_suppkey % 220) / 48000)) END, 9) AS value FROM supplier, range(50) WHERE range < 10 + s_suppkey % 40",
)
def generated_tone(spark, d):
    """A tone for each supplier, of its own pitch and length; every fifth is silent."""
    k = F.col("s_suppkey")
    sources = media.table(spark, d, "supplier").select(k, F.when(k % 5 != 0, 220 + k % 220).alias("frequency"), (10 + k % 40).alias("count"))
    return dv.tones(sources, ["s_suppkey"], 48_000, 0.5).select("s_suppkey", "n", F.round("value", 9).alias("value"))


@plans.query(
    "generated_solid",
    """SELECT p_partkey, i // (w * h) AS frame_no, CAST(i % w AS INTEGER) AS x, CAST(i // w % h AS INTEGER) AS y, p_partkey % 5 / 4.0::DOUBLE AS r, 0.5::DOUBLE AS g, p_partkey % 3 / 2.0::DOUBLE AS b
FROM (SELECT p_partkey, 2 + p_partkey % 3 AS w, 1 + p_partkey % 2 AS h FROM part), range(24) t(i) WHERE i < 3 * w * h""",
)
def generated_solid(spark, d):
    """Three frames of one colour for each part, of its own size."""
    k = F.col("p_partkey")
    sources = media.table(spark, d, "part").select(k, F.lit(3).alias("frames"), (2 + k % 3).alias("w"), (1 + k % 2).alias("h"), (k % 5 / 4).alias("r"), F.lit(0.5).alias("g"), (k % 3 / 2).alias("b"))
    return dv.solids(sources, ["p_partkey"])


_BLOCKS = "b AS (SELECT vec_id % 7 AS stream_id, vec_id AS t, list_transform(embedding[1:vec_id % 5 + 1], lambda v: round(CAST(v AS DOUBLE), 6)) AS v FROM embeddings)"


def _blocks(spark, d):
    i = F.col("vec_id")
    size = (i % 5 + 1).cast("int")
    return media.table(spark, d, "embeddings").select((i % 7).alias("stream_id"), i.alias("t"), F.transform(F.slice("embedding", F.lit(1), size), lambda v: F.round(v.cast("double"), 6)).alias("v"))


@plans.query("audio_blocks_joined", f"WITH {_BLOCKS}, e AS (SELECT stream_id, t, unnest(v) AS value, unnest(range(len(v))) AS i FROM b) SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t, i) - 1 AS n, value FROM e")
def audio_blocks_joined(spark, d):
    """Blocks of one to five samples, one after the other."""
    return dv.concatenated(_blocks(spark, d), ["stream_id"], "t", "v")


@plans.query("audio_blocks_in_range", f"WITH {_BLOCKS} SELECT stream_id, t, CAST(len(v) AS INTEGER) AS n FROM b WHERE t >= 40 AND t < 90")
def audio_blocks_in_range(spark, d):
    return dv.blocks_in(_blocks(spark, d), "t", 40, 90).select("stream_id", "t", F.size("v").alias("n"))


@plans.query("metadata_map", "SELECT user_id AS path, max_by(event_type, event_id) AS title, count(DISTINCT event_type) AS n_keys FROM events GROUP BY user_id")
def metadata_map(spark, d):
    """A file's tags as a map: of equal keys the last one counts."""
    e = media.table(spark, d, "events")
    tags = e.select(F.col("user_id").alias("path"), "event_id", F.explode(F.array(F.struct(F.lit("title").alias("k"), F.col("event_type").alias("v")), F.struct(F.col("event_type").alias("k"), F.lit("x").alias("v")))).alias("t"))
    last = tags.groupBy("path", "t.k").agg(F.max_by("t.v", "event_id").alias("v"))
    maps = last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("tags"))
    return maps.select("path", F.col("tags")["title"].alias("title"), (F.size("tags") - 1).cast("long").alias("n_keys"))


@plans.query(
    "format_choice",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 2) THEN CASE p_partkey % 4 WHEN 0 THEN 'yuv420p' ELSE 'rgb24' END ELSE 'yuv420p' END AS pixel_format, p_partkey % 4 NOT IN (0, 2) AS converted FROM part",
)
def format_choice(spark, d):
    """Streams keep a format that is asked for, the others are converted to the first one."""
    k = F.col("p_partkey")
    have = F.element_at(F.array(*map(F.lit, ("yuv420p", "yuv444p", "rgb24", "nv12"))), (k % 4 + 1).cast("int"))
    return dv.formatted(media.table(spark, d, "part").select("p_partkey", have.alias("pixel_format")), "pixel_format", ["yuv420p", "rgb24"])


# ---- live ------------------------------------------------------------------------------------------------------------


@plans.query(
    "stream_av_offset",
    f"WITH {SAMPLES} SELECT v.stream_id, v.t_us AS video_us, a.t_us AS audio_us FROM samples v JOIN samples a ON v.stream_id = a.stream_id AND v.event_type = 'click' AND a.event_type = 'view' AND abs(a.t_us - v.t_us) <= {DAY_US // 4}",
)
def stream_av_offset(spark, d):
    """Clicks as frames and views as sound, within six hours, joined as streams."""

    def build(e):
        video = e.filter("event_type = 'click'").select("stream_id", F.col("ts").alias("video_ts"))
        audio = e.filter("event_type = 'view'").select("stream_id", F.col("ts").alias("audio_ts"))
        return live.av_offset(video, audio, ["stream_id"], "6 hours")

    out = _streamed(spark, d, build, columns=["event_type"])
    return out.select("stream_id", F.unix_micros("video_ts").alias("video_us"), F.unix_micros("audio_ts").alias("audio_us"))


@plans.query("stream_gaps_stateful", f"WITH {SAMPLES}, g AS (SELECT stream_id, t_us - lag(t_us) OVER (PARTITION BY stream_id ORDER BY t_us) AS gap FROM samples) SELECT stream_id, count(*) AS n, count(*) FILTER (gap > {DAY_US}) AS gaps FROM g GROUP BY stream_id")
def stream_gaps_stateful(spark, d):
    """Rows and gaps of more than a day of each stream, kept as state from batch to batch."""
    out = _streamed(spark, d, lambda e: live.gap_counts(e.select("stream_id", "ts"), "stream_id", "ts", DAY_US), mode="update", sink="latest", key="stream_id")
    return out.select("stream_id", "n", "gaps")


@plans.query("stream_fan_out", f"WITH {SAMPLES} SELECT target, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM samples, (VALUES ('a'), ('b')) v(target) GROUP BY target")
def stream_fan_out(spark, d):
    """Every batch delivered to two targets."""
    out = _streamed(spark, d, lambda e: e.select("event_id"), sink="fan_out")
    return out.groupBy("target").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


# ---- looped sound, and a range at a lower rate -----------------------------------------------------------------------


@plans.query(
    "add_audio_cycled",
    f"""WITH {SAMPLES}, s AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY t_us, event_id) - 1 AS n, value FROM samples), l AS (SELECT stream_id, max(n) + 1 AS own, 40 + stream_id % 7 AS length FROM s GROUP BY stream_id)
SELECT l.stream_id, t.i AS n, s.value FROM l, range(47) t(i) JOIN s ON s.stream_id = l.stream_id AND s.n = t.i % l.own WHERE t.i < l.length""",
)
def add_audio_cycled(spark, d):
    """Each stream's samples repeated, or cut off, to about forty."""
    s = media.samples(spark, d).select("stream_id", F.expr("row_number() OVER (PARTITION BY stream_id ORDER BY t_us, event_id) - 1").cast("long").alias("n"), "value")
    lengths = s.select("stream_id").distinct().withColumn("length", 40 + F.col("stream_id") % 7)
    return audio.cycled(s, lengths, ["stream_id"])


@plans.query(
    "gif_frames",
    f"""WITH {SAMPLES}, r AS (SELECT stream_id, event_id, t_us - min(t_us) OVER (PARTITION BY stream_id) AS t FROM samples), c AS (SELECT * FROM r WHERE t >= {2 * DAY_US} AND t < {9 * DAY_US}),
g AS (SELECT stream_id, unnest(range(0, max(t) - {2 * DAY_US} + 1, {DAY_US // 2})) AS grid FROM c GROUP BY stream_id)
SELECT g.stream_id, g.grid, c.event_id FROM g ASOF JOIN (SELECT stream_id, event_id, t - {2 * DAY_US} AS t FROM c) c ON g.stream_id = c.stream_id AND g.grid <= c.t""",
)
def gif_frames(spark, d):
    """Days two to nine of each stream at two frames a day."""
    cut = select.trim(select.rebase(media.samples(spark, d), "t_us", ["stream_id"]), "t_us", 2 * DAY_US, 9 * DAY_US)
    moved = select.shift(cut, "t_us", -2 * DAY_US).withColumnRenamed("t_us", "t")
    return select.sample_grid(moved, ["stream_id"], "t", DAY_US // 2, ["event_id"]).select("stream_id", "grid", "event_id")
