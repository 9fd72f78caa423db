"""Look-up cubes, project files and metadata catalogues as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "format_version int, timeline struct<canvas_w:int,canvas_h:int,fps:double,fps_num:int,fps_den:int,clips:array<struct<track_id:bigint,clip_id:bigint,in_ns:bigint,out_ns:bigint,offset_ns:bigint,speed:double>>>"
#: Decimal rates that stand for a ratio: fixed values.
STANDARD_RATES = [(23.976, 24000, 1001), (29.97, 30000, 1001), (59.94, 60000, 1001), (47.952, 48000, 1001), (119.88, 120000, 1001)]


_NUMBER = r"^\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*$"
_WHOLE = r"^\s*([0-9]+)\s+([0-9]+)\s+([0-9]+)\s*$"


def _entries(raw: DataFrame, keep: list[str], pattern: str) -> DataFrame:
    """(keep, _lines, _i, r, g, b as text): the lines of three numbers of each file's ``value``, numbered."""
    lines = raw.withColumn("_lines", F.split("value", r"\r?\n"))
    rows = lines.select(*keep, "_lines", F.filter("_lines", lambda x: x.rlike(pattern)).alias("_rows"))
    each = rows.select(*keep, "_lines", F.size("_rows").alias("_count"), F.posexplode("_rows").alias("_i", "_l"))
    return each.select(*keep, "_lines", "_count", "_i", *(F.regexp_extract("_l", pattern, k + 1).alias(c) for k, c in enumerate("rgb")))


def _cut(good: Column, value: Column, why: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(why)).cast("int"))


def parse_cubes(raw: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, size, r_idx, g_idx, b_idx, r, g, b) of each .cube file (``value``: its whole text); red runs fastest."""
    head = F.get(F.filter("_lines", lambda x: x.startswith("LUT_3D_SIZE")), F.lit(0))
    n = F.element_at(F.split(F.trim(head), r"\s+"), -1).cast("int")
    e = _entries(raw, keep, _NUMBER).withColumn("size", _cut(n.isNotNull(), n, "no LUT_3D_SIZE"))
    i, n = F.col("_i"), F.col("size")
    return e.select(*keep, "size", (i % n).alias("r_idx"), (F.floor(i / n) % n).cast("int").alias("g_idx"), F.floor(i / (n * n)).cast("int").alias("b_idx"), *(F.col(c).cast("double").alias(c) for c in "rgb"))


def parse_3dls(raw: DataFrame, keep: list[str]) -> DataFrame:
    """The same of each .3dl file: a line of mesh points, then whole numbers, blue fastest, up to the largest value of 10, 12
    or 16 bits that a file's need."""
    lines = raw.select(*keep, "value", F.array_max(F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: x.rlike(_WHOLE)), lambda x: F.array_max(F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("int"))))).alias("_top"))
    e = _entries(lines, [*keep, "_top"], _WHOLE)
    n = F.round(F.pow(F.col("_count"), F.lit(1 / 3))).cast("int")
    e = e.withColumn("size", _cut((n >= 2) & (n * n * n == F.col("_count")), n, "entries are no cube"))
    scale = F.when(F.col("_top") < 1024, 1023).when(F.col("_top") < 4096, 4095).when(F.col("_top") < 65536, 65535)
    scale = _cut(scale.isNotNull(), scale, "a value is more than 16 bits hold")
    i, n = F.col("_i"), F.col("size")
    return e.select(*keep, "size", F.floor(i / (n * n)).cast("int").alias("r_idx"), (F.floor(i / n) % n).cast("int").alias("g_idx"), (i % n).alias("b_idx"), *((F.col(c).cast("int") / scale).alias(c) for c in "rgb"))


def _single(cubes: DataFrame, why: str) -> tuple[DataFrame, int]:
    size = cubes.select("size").first()
    if size is None:
        raise ValueError(why)
    return cubes.drop("size"), size[0]


def read_cube(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """One .cube file as (r_idx, g_idx, b_idx, r, g, b) and its size."""
    raw = spark.read.text(path, wholetext=True)
    if not raw.filter(F.col("value").rlike("(?m)^LUT_3D_SIZE")).take(1):
        raise ValueError("no LUT_3D_SIZE")
    return _single(parse_cubes(raw, []), "no entries")


def read_3dl(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """One .3dl file as (r_idx, g_idx, b_idx, r, g, b) and its size."""
    raw = spark.read.text(path, wholetext=True)
    count, top = _entries(raw, [], _WHOLE).agg(F.count("*"), F.max(F.greatest(*(F.col(c).cast("int") for c in "rgb")))).first()
    if count < 8 or round(count ** (1 / 3)) ** 3 != count:
        raise ValueError(f"{count} entries are no cube")
    if top >= 1 << 16:
        raise ValueError(f"{top} is more than 16 bits hold")
    return _single(parse_3dls(raw, []), "no entries")


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Versioned project files: a bare timeline is version 0; older versions are migrated step by step."""
    return parse_projects(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value")))


def parse_projects(raw: DataFrame) -> DataFrame:
    """Projects from their text (path, value)."""
    whole = F.when(F.get_json_object("value", "$.format_version").isNotNull(), F.col("value")).otherwise(F.concat(F.lit('{"format_version":0,"timeline":'), F.col("value"), F.lit("}")))
    docs = raw.select("path", F.from_json(whole, PROJECT).alias("d")).select("path", "d.*")
    return docs.transform(_to_v1).transform(_to_v2)


def _to_v1(docs: DataFrame) -> DataFrame:
    return docs.withColumn("format_version", F.greatest("format_version", F.lit(1)))


def _to_v2(docs: DataFrame) -> DataFrame:
    """A decimal rate becomes a ratio."""
    fps = F.col("timeline.fps")
    num, den = F.round(fps * 1000).cast("int"), F.lit(1000)
    num, den = F.when(fps == F.floor(fps), fps.cast("int")).otherwise(num), F.when(fps == F.floor(fps), 1).otherwise(den)
    for decimal, n, d in STANDARD_RATES:
        near = F.abs(fps - decimal) < 0.005
        num, den = F.when(near, n).otherwise(num), F.when(near, d).otherwise(den)
    old = F.col("timeline.fps_num").isNull()
    timeline = F.col("timeline").withField("fps_num", F.when(old, num).otherwise(F.col("timeline.fps_num"))).withField("fps_den", F.when(old, den).otherwise(F.col("timeline.fps_den"))).dropFields("fps")
    return docs.withColumns({"timeline": timeline, "format_version": F.greatest("format_version", F.lit(2))})


def primary_streams(streams: DataFrame) -> DataFrame:
    """The first stream of each kind in each file."""
    return streams.groupBy("path", "kind").agg(F.min("stream_index").alias("stream_index"))
