"""What goes out: containers by file name, export presets and their limits, proxies; and what is known of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each container format: fixed values.
CONTAINERS = {"mp4": "mp4", "m4v": "mp4", "webm": "webm", "mkv": "matroska", "avi": "avi", "mov": "mov", "flac": "flac", "ogg": "ogg"}
#: name, video codec, width, height, frames a second, quality factor, audio codec, sample rate, channels, audio bits a second:
#: fixed values.
PRESETS = [
    ("youtube_1080p", "h264", 1920, 1080, 30.0, 18, "aac", 48000, 2, 192_000),
    ("youtube_4k", "h265", 3840, 2160, 30.0, 20, "aac", 48000, 2, 256_000),
    ("twitter", "h264", 1280, 720, 30.0, 23, "aac", 48000, 2, 128_000),
    ("instagram_square", "h264", 1080, 1080, 30.0, 23, "aac", 48000, 2, 128_000),
    ("instagram_reels", "h264", 1080, 1920, 30.0, 23, "aac", 48000, 2, 128_000),
    ("bluray_1080p", "h264", 1920, 1080, 24.0, 18, "ac3", 48000, 2, 384_000),
    ("podcast_mono", None, None, None, None, None, "aac", 48000, 1, 128_000),
    ("lossless_rgb", "ffv1", None, None, None, 0, "flac", 48000, 2, 0),
    ("web_h264", "vp9", 1280, 720, 30.0, 33, "opus", 48000, 2, 128_000),
]
PRESET = "name string, video_codec string, width int, height int, fps double, crf int, audio_codec string, sample_rate int, channels int, audio_bitrate long"
#: Divisors of the proxies: fixed values.
PROXIES = {"half": 2, "quarter": 4, "eighth": 8}


def container_of(path: Column) -> Column:
    """The container format that a file's extension names, in any case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(x) for pair in CONTAINERS.items() for x in pair)), lambda k, _: k == ext)), 0)


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, PRESET)


def preset_faults(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(keep, name, fault) of presets that break their platform's limits: a rate over 60, a picture that isn't square or 9:16.
    Sizes and rates that aren't set break none."""
    fast = F.col("fps") > 60
    square, tall = F.col("width") != F.col("height"), F.col("width") * 16 != F.col("height") * 9
    youtube, reels = F.col("name").isin("youtube_1080p", "youtube_4k"), F.col("name") == "instagram_reels"
    faults = [(youtube & fast, "fps"), ((F.col("name") == "instagram_square") & square, "aspect"), (reels & tall, "aspect"), (reels & fast, "fps")]
    return rows.select(*keep, "name", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(f)) for c, f in faults)))).alias("fault"))


def proxies(sources: DataFrame, sizes: list[str] = tuple(PROXIES), keep: list[str] = ()) -> DataFrame:
    """Each source (path, width, height) at each lower resolution: proxy, its path beside the source, and its even size."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("proxy"), F.lit(PROXIES[s]).alias("by")) for s in sizes))).alias("p")
    stem = F.regexp_replace("path", r"\.[^./\\]*$", "")
    even = lambda c: (F.floor(F.floor(F.col(c) / F.col("p.by")) / 2) * 2).cast("int")
    return sources.select(*keep, "path", "width", "height", each).select(
        *keep, "path", "p.proxy", F.concat(stem, F.lit("_proxy_"), F.col("p.proxy"), F.lit(".mp4")).alias("proxy_path"), even("width").alias("proxy_width"), even("height").alias("proxy_height")
    )


def video_class(width: Column, height: Column, wide_gamut: Column, bits: Column) -> list[Column]:
    """aspect (0 without a height), hd, full_hd, uhd and hdr of a video stream."""
    aspect = F.when(height == 0, 0.0).otherwise(width / height)
    return [aspect.alias("aspect"), (height >= 720).alias("hd"), (height >= 1080).alias("full_hd"), (height >= 2160).alias("uhd"), (wide_gamut & (bits >= 10)).alias("hdr")]


def formatted(streams: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    """Streams whose format is accepted keep it, the others get the first accepted one; ``converted`` says which."""
    if not accepted:
        raise ValueError("at least one format")
    fits = F.coalesce(F.col(column).isin(accepted), F.lit(False))
    return streams.withColumns({column: F.when(fits, F.col(column)).otherwise(accepted[0]), "converted": ~fits})


def sequence_frames(files: DataFrame, fps: float) -> DataFrame:
    """(folder, number, ts_ns, path) of numbered picture files: the last digits before the extension are the number, the
    folder's least number starts at 0."""
    number = F.regexp_extract("path", r"([0-9]+)\.[^./\\]+$", 1)
    got = files.withColumns({"folder": F.regexp_extract("path", r"^(.*?)[^/\\]*$", 1), "number": F.when(number != "", number).cast("long")}).filter("number IS NOT NULL")
    first = got.groupBy("folder").agg(F.min("number").alias("_first"))
    return got.join(first, "folder").select("folder", "number", F.round((F.col("number") - F.col("_first")) * (1e9 / fps)).cast("long").alias("ts_ns"), "path")


def generated(spark: SparkSession, kind: str, count: int, rate: int, *, frequency: float = 440.0, amplitude: float = 1.0) -> DataFrame:
    """(n, value) of a bounded source: 'silence' or 'tone' samples."""
    if count < 0 or rate <= 0:
        raise ValueError("a generated source needs a length and a rate")
    if kind not in ("silence", "tone"):
        raise ValueError(f"unknown source {kind!r}")
    value = F.lit(0.0) if kind == "silence" else amplitude * F.sin(F.col("id") * (2 * 3.141592653589793 * frequency / rate))
    return spark.range(count).select(F.col("id").alias("n"), value.alias("value"))


def solid(spark: SparkSession, frames: int, w: int, h: int, colour: tuple[float, float, float]) -> DataFrame:
    """Pixels of a bounded run of frames of one colour."""
    if min(frames, w, h) < 1:
        raise ValueError("a solid source needs a length and a size")
    i = F.col("id")
    return spark.range(frames * w * h).select(F.floor(i / (w * h)).alias("frame_no"), (i % w).cast("int").alias("x"), (F.floor(i / w) % h).cast("int").alias("y"), *(F.lit(float(v)).alias(c) for v, c in zip(colour, "rgb")))


def tones(sources: DataFrame, keep: list[str], rate: int, amplitude: float = 1.0) -> DataFrame:
    """(keep, n, value): a tone for each source (frequency, count); a frequency that is null is silence."""
    if rate <= 0:
        raise ValueError("a generated source needs a rate")
    n = F.explode(F.when(F.col("count") > 0, F.sequence(F.lit(0).cast("long"), F.col("count").cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))).alias("n")
    each = sources.select(*keep, "frequency", n)
    value = F.coalesce(amplitude * F.sin(F.col("n") * (2 * 3.141592653589793 * F.col("frequency") / rate)), F.lit(0.0))
    return each.select(*keep, "n", value.alias("value"))


def solids(sources: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, frame_no, x, y, r, g, b): frames of one colour for each source (frames, w, h, r, g, b)."""
    size = F.col("w") * F.col("h")
    cells = F.explode(F.when((size > 0) & (F.col("frames") > 0), F.sequence(F.lit(0).cast("long"), F.col("frames") * size - 1)).otherwise(F.array().cast("array<bigint>"))).alias("_i")
    each = sources.select(*keep, "w", "h", *"rgb", cells)
    return each.select(*keep, F.floor(F.col("_i") / size).alias("frame_no"), (F.col("_i") % F.col("w")).cast("int").alias("x"), (F.floor(F.col("_i") / F.col("w")) % F.col("h")).cast("int").alias("y"), *"rgb")


def concatenated(blocks: DataFrame, by: list[str], order: str, values: str) -> DataFrame:
    """Blocks of samples (by, order, an array) as one run of samples (by, n, value): offsets come from the blocks' sizes,
    so no samples are sorted or gathered."""
    at = F.expr(f"sum(size({values})) OVER (PARTITION BY {', '.join(by)} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return blocks.withColumn("_at", F.coalesce(at, F.lit(0))).select(*by, "_at", F.posexplode(values).alias("_i", "value")).select(*by, (F.col("_at") + F.col("_i")).cast("long").alias("n"), "value")


def blocks_in(blocks: DataFrame, t: str, start: int, end: int) -> DataFrame:
    """Whole blocks whose first sample is in [start, end)."""
    if start >= end:
        raise ValueError(f"empty range: {start} >= {end}")
    return blocks.filter((F.col(t) >= start) & (F.col(t) < end))
