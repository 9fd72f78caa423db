"""Files that Spark writes from the tables and reads back through the library's own formats, the live playlist, edit logs,
and work on one stream that holds all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..folders import shared_folder
from ..functions import blend as fb
from ..operators import editlog, even
from ..sources import metadata, pcm
from ..streaming import playlist
from . import media
from .media import CLIPS, DAY_US, NUMBERED, PIXELS, SAMPLES, byte
from .register import Plans

plans = Plans()
QUERIES, ORACLE = plans.QUERIES, plans.ORACLE


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _done(df) -> None:
    df.write.format("noop").mode("overwrite").save()


@plans.query("wav_round_trip", f"WITH {NUMBERED} SELECT stream_id, n, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS value FROM numbered WHERE n >= 5")
def wav_round_trip(spark, d):
    """A WAV file a stream; only the frames asked for are read again."""
    folder = _folder(spark, "wav")
    _done(pcm.write_wav(media.numbered(spark, d).withColumn("ch", F.lit(0)), folder, "stream_id", 48_000))
    back = pcm.read_wav(spark, folder, ["path", "n", "value"]).filter("n >= 5")
    return back.select(F.regexp_extract("path", r"(-?\d+)\.wav$", 1).cast("long").alias("stream_id"), "n", F.round("value", 6).alias("value"))


@plans.query("wav_stream", f"WITH {NUMBERED} SELECT stream_id, count(*) AS n, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) AS total FROM numbered GROUP BY stream_id")
def wav_stream(spark, d):
    """The files as a stream: half of them first, then, by a second query from the first one's offsets, the others."""
    folder = _folder(spark, "wav")
    samples = media.numbered(spark, d).withColumn("ch", F.lit(0))
    for part in (0, 1):
        _done(pcm.write_wav(samples.filter(F.pmod("stream_id", F.lit(2)) == part), f"{folder}/in", "stream_id", 48_000))
        stream = pcm.read_wav(spark, f"{folder}/in", ["path", "value"], stream=True)
        out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("path string, value double").parquet(f"{folder}/out")
    named = F.regexp_extract("path", r"(-?\d+)\.wav$", 1).cast("long").alias("stream_id")
    return got.groupBy(named).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@plans.query("picture_scan", f"WITH {PIXELS} SELECT frame_no, 8 AS width, 8 AS height, CAST(sum({byte('r')}) AS BIGINT) AS total FROM pixels GROUP BY frame_no")
def picture_scan(spark, d):
    """A grey picture file a frame, read again."""
    folder = _folder(spark, "pictures")
    hexed = F.array_join(F.transform("r", lambda v: F.lpad(F.hex(fb.to_byte(v).cast("long")), 2, "0")), "")
    frames = media.planes(spark, d).select("frame_no", F.col("w").alias("width"), F.col("h").alias("height"), F.lit(1).alias("channels"), F.unhex(hexed).alias("plane"))
    _done(pcm.write_pictures(frames, folder, "frame_no"))
    back = pcm.read_pictures(spark, folder, ["path", "width", "height", "plane"])
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length("plane")), lambda i: F.conv(F.hex(F.substr("plane", i, F.lit(1))), 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return back.select(F.regexp_extract("path", r"(-?\d+)\.pgm$", 1).cast("long").alias("frame_no"), "width", "height", total.alias("total"))


@plans.query(
    "stream_playlist",
    f"""WITH {SAMPLES}, s AS (SELECT stream_id, t_us // {DAY_US} AS segment, count(*) AS n, min(t_us) AS start, max(t_us) AS "end" FROM samples GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY segment DESC) AS left_behind FROM s)
SELECT stream_id, 'add' AS action, segment, n, start, "end" FROM r UNION ALL SELECT stream_id, 'delete', segment, NULL, NULL, NULL FROM r WHERE left_behind > 3""",
)
def stream_playlist(spark, d):
    """A live playlist of three days for each stream, in append mode: the events come in three parts, each by a query
    that goes on from the state of the one before, and marks with the last part flush what is open."""
    return _live(spark, d, 3)


@plans.query("stream_flushed_segments", f"WITH {SAMPLES} SELECT stream_id, t_us // {DAY_US} AS day, count(*) AS n FROM samples GROUP BY ALL")
def stream_flushed_segments(spark, d):
    """Live segments with what is still open when the input ends, in append mode."""
    return _live(spark, d, 1).filter("action = 'add'").select("stream_id", F.col("segment").alias("day"), "n")


def _live(spark, d, keep: int):
    folder = _folder(spark, "playlist")
    events = media.samples(spark, d).select("stream_id", F.timestamp_micros("t_us").alias("t"), F.lit(False).alias("last"))
    lo, hi = events.agg(F.min(F.unix_micros("t")), F.max(F.unix_micros("t"))).first()
    cuts = [lo + (hi - lo) * i // 3 for i in (1, 2)]
    third = F.when(F.unix_micros("t") <= cuts[0], 0).when(F.unix_micros("t") <= cuts[1], 1).otherwise(2)
    marks = events.groupBy("stream_id").agg(F.max("t").alias("t")).withColumn("last", F.lit(True))
    for part in (events.filter(third == 0), events.filter(third == 1), events.filter(third == 2).unionByName(marks)):
        part.write.mode("append").parquet(f"{folder}/in")  # a batch a part; each query goes on from the state before it
        rows = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        out = playlist.playlist_events(rows, "stream_id", "t", DAY_US, keep).writeStream.format("parquet").option("path", f"{folder}/out")
        out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("stream_id", "action", "segment", "n", "start", "end")


_LOG = f"""{CLIPS}, lk AS (SELECT o_orderkey AS track_id, o_orderstatus = 'F' AS lock FROM orders), free AS (SELECT clips.* FROM clips JOIN lk USING (track_id) WHERE group_id IS NULL),
del AS (SELECT track_id, arg_min(clip_id, pos) AS clip_id FROM free WHERE track_id % 7 = 0 GROUP BY track_id), fast AS (SELECT track_id, arg_max(clip_id, pos) AS clip_id FROM free WHERE track_id % 7 < 2 GROUP BY track_id),
gone AS (SELECT spans.track_id, clip_id, offset_ns, coalesce(footprint_ns, 0) AS f FROM (SELECT clip_id, track_id, offset_ns, CAST(floor((out_ns - in_ns) / greatest(speed, 0.01)) AS BIGINT) AS footprint_ns FROM clips) spans
  JOIN del USING (clip_id) JOIN lk ON lk.track_id = spans.track_id WHERE NOT lock)"""


@plans.query(
    "edit_log",
    f"""WITH {_LOG} SELECT c.clip_id, CASE WHEN g.clip_id IS NOT NULL AND c.offset_ns > g.offset_ns THEN greatest(0, c.offset_ns - g.f) ELSE c.offset_ns END AS offset_ns,
CASE WHEN f.clip_id IS NOT NULL AND NOT lk.lock THEN 2.5::DOUBLE ELSE c.speed END AS speed
FROM clips c JOIN lk USING (track_id) LEFT JOIN gone g ON g.track_id = c.track_id LEFT JOIN fast f ON f.clip_id = c.clip_id WHERE g.clip_id IS NULL OR g.clip_id <> c.clip_id""",
)
def edit_log(spark, d):
    """Two edits on many tracks in one pass: the first free clip goes with a ripple, then the last one gets faster; tracks of
    finished orders are locked and refuse both."""
    return editlog.apply_log(*_log(spark, d), on_error="skip")[0].select("clip_id", "offset_ns", "speed")


@plans.query(
    "edit_log_refused",
    f"""WITH {_LOG} SELECT del.track_id * 10 AS seq, 'track ' || del.track_id || ' is locked' AS reason FROM del JOIN lk USING (track_id) WHERE lock
UNION ALL SELECT fast.track_id * 10 + 1, CASE WHEN lock THEN 'track ' || fast.track_id || ' is locked' ELSE 'no clip ' || fast.clip_id END FROM fast JOIN lk USING (track_id) LEFT JOIN gone ON gone.clip_id = fast.clip_id WHERE lock OR gone.clip_id IS NOT NULL""",
)
def edit_log_refused(spark, d):
    return editlog.apply_log(*_log(spark, d), on_error="skip")[2]


def _log(spark, d):
    """The clips are read many times: they are numbered once and written to the shared folder, without what no edit looks at."""
    folder = _folder(spark, "clips")
    media.clips(spark, d).drop("source_kind", "source_path", "transition_ns", "source_ns").write.parquet(folder)
    clips = spark.read.parquet(folder)
    locks = media.table(spark, d, "orders").select(F.col("o_custkey").alias("timeline_id"), F.col("o_orderkey").alias("track_id"), (F.col("o_orderstatus") == "F").alias("lock"))
    free = clips.filter("group_id IS NULL").join(locks, "track_id")
    t = F.col("track_id")
    ends = free.filter(t % 7 < 2).groupBy("track_id").agg(F.min_by("clip_id", "pos").alias("first"), F.max_by("clip_id", "pos").alias("last"))
    edit = lambda seq, kind, clip: F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), F.col(clip).alias("clip_id"))
    both = F.array(F.when(t % 7 == 0, edit(t * 10, "ripple_delete", "first")), edit(t * 10 + 1, "set_speed", "last"))
    more = {"track_id": "long", "clip_ids": "array<long>", "a": "long", "b": "long", "batch": "long"}
    log = ends.select(F.explode(both).alias("e")).filter("e IS NOT NULL").select("e.*")
    log = log.withColumns({c: F.lit(None).cast(k) for c, k in more.items()} | {"value": F.lit(2.5)})
    return clips, locks, log


@plans.query(
    "asof_one_stream",
    f"""WITH {SAMPLES}, a AS (SELECT event_id, t_us FROM samples), k AS (SELECT t_us, max(event_id) AS key_id FROM samples WHERE event_id % 9 = 0 GROUP BY t_us)
SELECT event_id, key_id FROM a ASOF LEFT JOIN k ON a.t_us >= k.t_us""",
)
def asof_one_stream(spark, d):
    """The last ninth event at or before each event of one stream that holds all rows, dealt to even ranges."""
    s = media.samples(spark, d).select(F.lit(0).alias("stream"), "t_us", "event_id")
    keys = s.filter("event_id % 9 = 0").withColumnRenamed("event_id", "key_id")
    return even.asof(s, keys, ["stream"], "t_us", ["key_id"], per_task=1000).select("event_id", "key_id")


@plans.query(
    "islands_one_stream",
    f"""WITH {SAMPLES}, m AS (SELECT event_id, value >= 20 AS f, sum(CASE WHEN value >= 20 THEN 0 ELSE 1 END) OVER (ORDER BY t_us, event_id) AS island FROM samples)
SELECT CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first FROM m WHERE f GROUP BY island""",
)
def islands_one_stream(spark, d):
    """Stretches without a low value in one stream that holds all rows."""
    s = media.samples(spark, d).withColumn("stream", F.lit(0))
    found = even.islands(s, ["stream"], ["t_us", "event_id"], F.col("value") >= 20, per_task=1000)
    return found.groupBy(F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


_MARKED = f"""{SAMPLES}, m AS (SELECT stream_id, t_us // 1000 AS start_ms, 'a=b; #' || event_id || CASE WHEN event_id % 2 = 0 THEN chr(10) || chr(92) || 'x' ELSE '' END AS title, event_id FROM samples WHERE event_id % 5 = 0),
c AS (SELECT *, row_number() OVER w AS number, coalesce(lead(start_ms) OVER w, start_ms + 1000) AS end_ms FROM m WINDOW w AS (PARTITION BY stream_id ORDER BY start_ms, event_id))"""


def _metadata(spark, d):
    """A metadata file and an attachment a stream, written and read again: (stream_id, tags, chapters, attachment)."""
    s = media.samples(spark, d).filter("event_id % 5 = 0")
    title = F.concat(F.lit("a=b; #"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit("\n\\x")).otherwise(""))
    w = Window.partitionBy("stream_id").orderBy("start_ms", "event_id")
    marks = s.select("stream_id", F.floor(F.col("t_us") / 1000).alias("start_ms"), "event_id", title.alias("title"))
    marks = marks.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("start_ms") + 1000))
    files = marks.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "event_id", "end_ms", "title"))).alias("c"))
    tags = F.create_map(F.lit("title"), F.concat(F.lit("no. #"), F.col("stream_id").cast("string")), F.lit("empty"), F.lit(None).cast("string"), F.lit("marks"), F.size("c").cast("string"))
    chapters = F.transform("c", lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["title"].alias("title")))
    texts = files.select("stream_id", metadata.text(tags, chapters).alias("meta"), F.encode(F.concat(F.lit("font "), F.col("stream_id").cast("string")), "UTF-8").alias("font"))
    folder = _folder(spark, "metadata")
    _done(metadata.write(texts, folder, "stream_id", {"meta": ".ffmeta", "font": ".ttf"}))
    raw = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"(-?\d+)\.\w+$", 1).cast("long").alias("stream_id"), "path", F.decode("content", "UTF-8").alias("value"))
    fonts = raw.filter(F.col("path").endswith(".ttf")).select("stream_id", F.col("value").alias("attachment"))
    return metadata.parse(raw.filter(F.col("path").endswith(".ffmeta")), ["stream_id"]).join(fonts, "stream_id")


@plans.query("metadata_round_trip", f"WITH {_MARKED} SELECT stream_id, 'no. #' || stream_id AS title, CAST(count(*) AS VARCHAR) AS marks, CAST(2 AS INTEGER) AS n_tags, 'font ' || stream_id AS attachment FROM c GROUP BY stream_id")
def metadata_round_trip(spark, d):
    return _metadata(spark, d).select("stream_id", F.col("tags")["title"].alias("title"), F.col("tags")["marks"].alias("marks"), F.size("tags").alias("n_tags"), "attachment")


@plans.query("chapters_round_trip", f"WITH {_MARKED} SELECT stream_id, number, start_ms, end_ms, title FROM c")
def chapters_round_trip(spark, d):
    # posexplode would have the parsed file looked at by a filter first, and so parsed again for it.
    each = _metadata(spark, d).select("stream_id", F.posexplode_outer("chapters").alias("i", "c")).filter("i IS NOT NULL")
    return each.select("stream_id", (F.col("i") + 1).cast("long").alias("number"), "c.start_ms", "c.end_ms", "c.title")
