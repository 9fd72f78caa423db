"""Queries against their SQL on rows that the given small tables don't have."""

import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.functions import time as tm
from framelake.operators import even, grouped, keyframes, timeline
from framelake.plans import media, registry
from framelake.sources import metadata, pcm
from framelake.streaming import playlist

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
SF = "/root/testdata/sf0.001"


def plain(row):
    return tuple(round(v, 5) if isinstance(v, float) else None if v is None else str(v) for v in row)


def same(spark, folder, name, **tables):
    """The query and its SQL on Parquet files made of SQL over the smallest tables."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    got = Counter(plain(r) for r in df.collect())
    want = Counter(plain(r) for r in con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in df.columns)} FROM ({ORACLE[name]})").fetchall())
    assert got == want and got


def test_batch_whose_named_clip_goes(spark, tmp_path):
    same(spark, tmp_path, "edit_batch", lineitem=f"SELECT * REPLACE ('A' AS l_returnflag, l_suppkey * 7 + 1 AS l_suppkey) FROM '{SF}/lineitem.parquet' WHERE l_orderkey < 30")


@pytest.mark.parametrize("name", ["planar_to_packed", "packed_to_planar", "stride_removal"])
def test_layouts_scale_in_single_precision(spark, tmp_path, name):
    near = "[CAST(v AS FLOAT) FOR v IN list_transform(range(64), lambda i: ((vec_id * 64 + i) % 4000 - 2000) / 1000.0::DOUBLE)]"  # products that are whole but for rounding
    same(spark, tmp_path, name, embeddings=f"SELECT vec_id, {near} AS embedding FROM range(100) t(vec_id)")


@pytest.mark.parametrize("name", ["rotate_frame", "lens_correction"])
def test_remapped_frames_are_given_pixel_by_pixel(spark, name):
    df = QUERIES[name](spark, SF)
    frames = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert df.select("frame_no", "x", "y").distinct().count() == df.count() == frames * 64


def test_equal_levels_are_gated_alike(spark, tmp_path):
    # Streams of few frames whose values have one digit: many levels are equal but for rounding, the median among them.
    rows = "SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(i) AS ts, i % 40 AS user_id, 'a' AS event_type, hash(i) % 7 / 10.0::DOUBLE AS value FROM range(12800) t(i)"
    same(spark, tmp_path, "noise_reduce_fft", events=rows)


class Counted:
    """A handle, or a state that holds nothing, which counts its calls."""

    calls = 0

    def __getattr__(self, name):
        def call(*a):
            Counted.calls += 1
            return Counted() if name.endswith("State") else False if name in ("exists", "containsKey") else [] if name in ("keys", "listTimers") else None

        return call


def test_state_calls_dont_grow_with_a_streams_segments():
    state = playlist.Playlist("k", 1_000_000, 3)
    state.init(Counted())
    Counted.calls = 0
    rows = pd.DataFrame({"t_us": [i * 500_000 for i in range(200)], "last": False})
    list(state.handleInputRows((1,), iter([rows]), None))
    assert 0 < Counted.calls <= 4


def test_small_wav_files_share_tasks(tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.wav").write_bytes(pcm.wav_head(1, 1, 8000) + b"\0\0\0\0")
    whole, cut = ({"path": str(tmp_path), "range": n} for n in (pcm.RANGE, 20))
    schema = pcm.StructType().add("n", "long")
    for options, tasks in ((whole, 3), (cut, 900)):
        reader, stream = pcm.WavReader(options, schema), pcm.WavStream(options, schema)
        for parts in (reader.partitions(), stream.partitions({}, stream.latestOffset())):
            assert len(parts) == tasks
            assert sum(b.num_rows for p in parts for b in reader.read(p)) == 300


def test_clips_without_a_group_dont_meet_in_one_task(spark):
    clips = spark.range(4000).selectExpr("id AS clip_id", "id % 50 AS track_id", "IF(id % 10 = 0, id % 7, NULL) AS group_id")
    tracks = spark.range(50).selectExpr("id AS track_id", "id % 4 = 0 AS lock")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = timeline.lock_targets(clips, tracks)
        rows = df.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = {r.clip_id: (r.clip_lock, r.group_lock) for r in rows}
    sizes = Counter(r.task for r in rows).values()
    lock = {i: i % 50 if i % 50 % 4 == 0 else None for i in range(4000)}
    first = {g: min((lock[i] for i in range(0, 4000, 10) if i % 7 == g and lock[i] is not None), default=None) for g in range(7)}
    assert got == {i: (lock[i], first[i % 7] if i % 10 == 0 else lock[i]) for i in range(4000)}
    assert max(sizes) < 2000


def test_ranges_are_bounded_in_number(spark, monkeypatch):
    monkeypatch.setattr(even, "MOST_RANGES", 8)
    rows = spark.range(300).selectExpr("0 AS g", "id AS t", "id % 50 <> 0 AS f")
    assert even.ranged(rows, ["g"], ["t"], per_task=3).select("_part").distinct().count() <= 8
    found = even.islands(rows, ["g"], ["t"], F.col("f"), per_task=3).groupBy("island").count().collect()
    assert sorted(r["count"] for r in found) == [49] * 6
    monkeypatch.setattr(even, "PER_TASK", 10)
    assert even.ranged(rows, ["g"], ["t"], per_task=3).select("_part").distinct().count() > 20


def test_a_ripple_reads_its_clip_once(spark, monkeypatch):
    clips = spark.sql("SELECT id AS clip_id, 1L AS track_id, NULL AS group_id, 0L AS in_ns, 100L AS out_ns, id * 100 AS offset_ns, 1.0D AS speed FROM range(4)").withColumn("group_id", F.lit(None).cast("long"))
    one, read = timeline._one, []
    monkeypatch.setattr(timeline, "_one", lambda *a: read.append(1) or one(*a))
    got = {r.clip_id: r.offset_ns for r in timeline.ripple_trim(clips, 1, 0, 60).collect()}
    assert got == {0: 0, 1: 100, 2: 160, 3: 260} and len(read) == 1


def test_ratios_take_no_steps_in_a_lambda(spark):
    df = QUERIES["rational_operations"](spark, SF)
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
    r = spark.sql("SELECT * FROM VALUES (-9223372036854775807L - 1, 6L), (6L, -4L), (0L, 5L), (3L, 0L), (null, 4L) t(n, d)").select(tm.reduce_ratio(F.col("n"), F.col("d")).alias("r"))
    assert [x and tuple(x) for x, in r.collect()] == [(-(1 << 62), 3), (-3, 2), (0, 1), None, (None, None)]
    big = spark.range(1).select(tm.ratio_product(F.lit(1 << 62), F.lit(1), F.lit(4), F.lit(3)).alias("r"))  # a part passes a long
    assert big.first().r is None


def test_groups_stream_whole_whatever_the_batches(spark):
    rows = spark.sql("SELECT IF(id % 11 = 0, null, id % 11) AS k, id % 3 AS b, id AS n, IF(id % 5 = 0, null, id * 3) AS v FROM range(900)")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        seen = grouped.apply(rows, ["k", "b"], ["n"], lambda pdf: pdf.iloc[:1].assign(v=len(pdf), n=int(pdf["n"].is_monotonic_increasing)), "k long, b long, n long, v long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = Counter((r.k, r.b) for r in rows.collect())
    assert Counter({(r.k, r.b): r.v for r in seen}) == want and len(seen) == len(want) == 33 and all(r.n == 1 for r in seen)


@pytest.mark.parametrize("name", ["eq_chain", "r128_measures", "compressor_envelope"])
def test_streams_cost_no_batch_each(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"FlatMap(CoGroups|GroupsInPandas \[stream_id#\d+L, _block#)", plan)


def test_timelines_of_an_edit_log_cost_no_batch_each(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    def refuse(*_):
        raise AssertionError("a group a timeline")

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", refuse)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert QUERIES["edit_log_refused"](spark, SF).count() > 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chapters_are_parsed_once(spark):
    plan = QUERIES["chapters_round_trip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "TIMEBASE" in plan and not re.search(r"(?m)^\W*Filter .*TIMEBASE", plan)


def test_the_last_of_equal_tags_counts(spark):
    text = ";FFMETADATA1\na=1\nb=x\na=2\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=1\nEND=2\ntitle=p\ntitle=q\\=r\n"
    r = metadata.parse(spark.createDataFrame([(1, text)], "k long, value string"), ["k"]).first()
    assert r.tags == {"a": "2", "b": "x"} and [tuple(c) for c in r.chapters] == [(1, 2, "q=r")]


@pytest.mark.parametrize("name", ["keyframe_lerp_linear", "keyframe_easing_all", "keyframe_easing_bezier"])
def test_keyframes_and_times_share_one_sort(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on large tables
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_keyframes_overwritten_unwritten_and_without_an_owner(spark):
    line = ("linear", 0.0, 0.0, 1.0, 1.0)
    keys = [(1, "p", 10, 5.0, *line, 7), (1, "p", 10, 6.0, *line, 2), (1, "p", 20, 1.0, *line, 1), (1, "p", 20, 9.0, *line, 3), (1, "p", None, 4.0, *line, 4), (None, "p", 0, 4.0, *line, 5), (1, "q", 30, None, *line, 6)]
    k = spark.createDataFrame(keys, "owner_id long, prop string, ts_ns long, value double, easing string, x1 double, y1 double, x2 double, y2 double, seq long")
    t = spark.createDataFrame([(1, "p", v, v) for v in (None, 0, 10, 15, 15, 20)] + [(None, "p", 1, 1), (1, "q", 40, 40)], "owner_id long, prop string, ts_ns long, n long")
    got = Counter((r.owner_id, r.prop, r.n, r.value) for r in keyframes.value_at(t, k).collect())
    assert got == Counter([(1, "p", None, 5.0), (1, "p", 0, 5.0), (1, "p", 10, 5.0), (1, "p", 15, 7.0), (1, "p", 15, 7.0), (1, "p", 20, 9.0), (None, "p", 1, None), (1, "q", 40, None)])


CLIP = "track_id long, clip_id long, pos long, group_id long, source_kind string, in_ns long, out_ns long, offset_ns long, speed double, fade_in_ns long, fade_out_ns long, transition_ns long, source_ns long"
TRACK = "timeline_id long, track_id long, kind string"


def test_validation_shares_one_sort(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as on large tables
    try:
        plan = timeline.validate(spark.read.schema(CLIP).parquet(f"{SF}/lineitem.parquet"), spark.read.schema(TRACK).parquet(f"{SF}/orders.parquet"), tasks=7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1 and ", 7)" in plan


@pytest.mark.parametrize("tasks", [None, 5])
def test_validation_counts_overlaps_of_odd_clips(spark, tasks):
    rng = np.random.default_rng(23)
    draw = lambda *values: values[rng.integers(len(values))]
    rows = []
    for i in range(600):
        track, start = draw(1, 2, 3, 4, 5, None), draw(0, 5, None)
        out = draw(None, start, (start or 0) - 3, (start or 0) + int(rng.integers(1, 40)))
        rows.append((track, i, int(i * 7 % 600), None, draw("file", "text"), start, out, draw(None, *range(0, 200, 10)), draw(1.0, 2.0), draw(0, 30), 0, draw(0, 9), None))
    tracks = [(1, 1, "video"), (1, 2, "audio"), (1, 3, "audio"), (1, 3, "audio"), (1, 4, None), (1, 9, "audio"), (1, None, "audio")]
    clips = spark.createDataFrame(rows, CLIP)
    want = Counter()
    size = lambda r: None if r[6] is None or r[5] is None else (r[6] - r[5]) // r[8]
    for r in rows:
        key, length, kinds = r[:2], size(r), [k for _, t, k in tracks if t == r[0] and t is not None]
        faults = {"trim_out_before_in": length is not None and r[6] < r[5], "empty_footprint": length is not None and r[6] == r[5], "generated_clip_without_out_point": r[4] != "file" and r[6] is None, "fade_longer_than_clip": length is not None and r[9] > length}
        for rule, bad in faults.items():
            want[rule, *key] += bad * max(1, len(kinds))
        want["clip_cannot_serve_track", *key] += (r[4] != "file") * kinds.count("audio")
        want["dangling_transition", *key] += r[11] > 0 and r[2] == min(x[2] for x in rows if x[0] == r[0])
        for a in rows:
            if a[0] == r[0] is not None and None not in (size(a), length, a[7], r[7]) and min(size(a), length) >= 0:
                want["clip_overlap", *key] += (a[7], a[2]) < (r[7], r[2]) and r[7] < a[7] + size(a)
    got = Counter(tuple(r) for r in timeline.validate(clips, spark.createDataFrame(tracks, TRACK), tasks=tasks).collect())
    assert got == +want and len({k[0] for k in got}) == 7
    pairs = Counter(("clip_overlap", r.track_id, r.second) for r in timeline.overlaps(clips, width=7).collect())
    assert pairs == Counter({k: n for k, n in got.items() if k[0] == "clip_overlap"})


def test_line_items_are_dealt_by_their_number(spark, monkeypatch):
    assert media.tasks(spark, SF) is None
    monkeypatch.setattr(media, "TASK_ROWS", 100)
    rows = media.table(spark, SF, "lineitem").count()
    assert media.tasks(spark, SF) == rows // 100
    monkeypatch.setattr(media, "UNSORTED_TASKS", 20)
    assert media.tasks(spark, SF) == 20
    monkeypatch.setattr(media, "MOST_TASK_ROWS", 200)
    assert media.tasks(spark, SF) == rows // 200
    monkeypatch.undo()
    monkeypatch.setattr(media, "TASK_ROWS", 100)
    dealt = QUERIES["validate_report"](spark, SF)
    assert dealt._jdf.queryExecution().executedPlan().toString().count(f", {rows // 100})") == 2
    want = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        want.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert Counter(map(tuple, dealt.collect())) == Counter(want.execute(ORACLE["validate_report"]).fetchall())
