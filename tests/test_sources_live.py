"""The sample and picture formats, and the live playlist, with restarts."""

import datetime as dt
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.sources import metadata, pcm
from framelake.streaming import playlist


def wav(path, data, kind, channels, rate, bits, extra=b"", size=None):
    form = struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"fmt " + struct.pack("<I", 16) + form + extra + b"data" + struct.pack("<I", len(data) if size is None else size) + data
    with open(path, "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)


def rows(df):
    return [(os.path.basename(r.path), r.n, r.ch, r.value) for r in df.orderBy("path", "n", "ch").collect()]


@pytest.fixture
def folder(tmp_path):
    a = np.array([0, 16384, -32768, 8192, 1, -1], "<i2")
    wav(tmp_path / "a.wav", a.tobytes(), 1, 2, 8000, 16, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0")
    wav(tmp_path / "b.wav", np.array([0.5, -0.25, 1e-9], "<f4").tobytes(), 3, 1, 44100, 32)
    wav(tmp_path / "c.wav", bytes([0, 0, 64, 0, 0, 192, 255]), 1, 1, 9, 24)  # half a frame at the end
    wav(tmp_path / "d.wav", bytes([0, 128, 255]), 1, 1, 9, 8)
    wav(tmp_path / "e.wav", b"", 1, 1, 9, 8, size=0xFFFFFFFF)
    (tmp_path / "notes.txt").write_text("no sound")
    return tmp_path


WANT = [
    ("a.wav", 0, 0, 0.0), ("a.wav", 0, 1, 0.5), ("a.wav", 1, 0, -1.0), ("a.wav", 1, 1, 0.25), ("a.wav", 2, 0, 1 / 32768), ("a.wav", 2, 1, -1 / 32768),
    ("b.wav", 0, 0, 0.5), ("b.wav", 1, 0, -0.25), ("b.wav", 2, 0, float(np.float32(1e-9))), ("c.wav", 0, 0, 0.5), ("c.wav", 1, 0, -0.5),
    ("d.wav", 0, 0, -1.0), ("d.wav", 1, 0, 0.0), ("d.wav", 2, 0, 127 / 128),
]


@pytest.mark.parametrize("size", [1, 3, 50, 1 << 20])
def test_wav_is_read_by_ranges(spark, folder, size):
    assert rows(pcm.read_wav(spark, str(folder), range=size)) == WANT


def test_wav_reads_only_what_is_asked(spark, folder):
    df = pcm.read_wav(spark, str(folder), ["n", "rate"])
    assert df.columns == ["n", "rate"] and df.count() == len(WANT)
    cut = pcm.read_wav(spark, str(folder)).filter("n >= 1 AND n < 2 AND value < 0")
    assert rows(cut) == [x for x in WANT if x[1] == 1 and x[3] < 0]
    assert rows(pcm.read_wav(spark, str(folder)).filter("n = 2")) == [x for x in WANT if x[1] == 2]
    reader = pcm.WavReader({"path": str(folder)}, df.schema)
    left = list(reader.pushFilters([pcm.ds.GreaterThan(("n",), 0), pcm.ds.LessThanOrEqual(("n",), 4), pcm.ds.EqualTo(("rate",), 9)]))
    assert (reader.lo, reader.hi, len(left)) == (1, 5, 1)
    read = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in read) == len([x for x in WANT if 1 <= x[1] <= 4])
    with pytest.raises(ValueError):
        pcm.read_wav(spark, str(folder), ["loudness"])


def test_wav_refuses_other_files(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(b"RIFX....WAVE")
    with pytest.raises(Exception, match="RIFF|no samples"):
        pcm.read_wav(spark, str(tmp_path)).collect()
    assert pcm.read_wav(spark, str(tmp_path / "none")).count() == 0


def test_wav_stream_resumes(spark, tmp_path):
    source, state, out = (tmp_path / x for x in ("in", "state", "out"))
    source.mkdir()
    pcm.register(spark)

    def run():
        q = pcm.read_wav(spark, str(source), stream=True, range=7).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.schema(pcm.WAV).parquet(str(out)))

    grow = np.arange(10, dtype="<i2") * 1000
    wav(source / "a.wav", grow[:4].tobytes() + b"\1", 1, 1, 8000, 16, size=0)  # being written
    first = run()
    assert [x[1] for x in first] == [0, 1, 2, 3]
    wav(source / "a.wav", grow.tobytes(), 1, 1, 8000, 16, size=0)
    wav(source / "b.wav", grow[:2].tobytes(), 1, 1, 8000, 16)
    again = run()  # a new query, from the offsets of the old one
    assert [(p, n) for p, n, *_ in again] == [("a.wav", i) for i in range(10)] + [("b.wav", 0), ("b.wav", 1)]
    assert run() == again


def test_wav_round_trip(spark, tmp_path):
    data = spark.range(4000).selectExpr("id % 3 AS s", "id div 3 AS n", "0 AS ch", "CAST(sin(id) AS FLOAT) AS value").repartition(4)
    made = pcm.write_wav(data, str(tmp_path / "w"), "s", 8000)
    assert {r.s: r.frames for r in made.collect()} == {0: 1334, 1: 1333, 2: 1333}
    back = pcm.read_wav(spark, str(tmp_path / "w")).select(F.regexp_extract("path", r"(\d+)\.wav", 1).cast("long").alias("s"), "n", "ch", F.col("value").cast("float").alias("value"))
    assert back.exceptAll(data).count() == 0 and back.count() == 4000
    assert not [x for x in os.listdir(tmp_path / "w") if x.endswith(".part")]


def test_pictures(spark, tmp_path):
    frames = spark.createDataFrame([(i, 2, 3, c, bytearray(range(i, i + 6 * c))) for i, c in ((0, 1), (1, 3), (2, 1))], "f long, width int, height int, channels int, plane binary")
    pcm.write_pictures(frames, str(tmp_path / "p"), "f").collect()
    (tmp_path / "p" / "odd.pgm").write_bytes(b"P5 # a comment\n1  1\n255\n\x07")
    got = {os.path.basename(r.path): (r.width, r.height, r.channels, bytes(r.plane)) for r in pcm.read_pictures(spark, str(tmp_path / "p"), per_task=2).collect()}
    assert got == {"0.pgm": (2, 3, 1, bytes(range(6))), "1.ppm": (2, 3, 3, bytes(range(1, 19))), "2.pgm": (2, 3, 1, bytes(range(2, 8))), "odd.pgm": (1, 1, 1, b"\7")}
    assert pcm.read_pictures(spark, str(tmp_path / "p"), ["width"]).columns == ["width"]
    (tmp_path / "p" / "short.pgm").write_bytes(b"P5 9 9 255\n\x07")
    with pytest.raises(Exception, match="ends early"):
        pcm.read_pictures(spark, str(tmp_path / "p")).collect()


SCHEMA = "k long, t timestamp, last boolean"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.fixture
def feed(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    sent = []

    def put(batch):
        name = f"{len(sent):03d}"
        spark.createDataFrame([(k, at(s), last) for k, s, last in batch], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "stage" / name))
        part = next(x for x in (tmp_path / "stage" / name).iterdir() if x.suffix == ".parquet")
        part.rename(source / f"{name}.parquet")
        sent.append(name)

    def run(deliver):
        events = playlist.playlist_events(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source)), "k", "t", 10_000_000, 2)
        q = events.writeStream.foreachBatch(deliver).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
        q.awaitTermination()

    return put, run


def test_playlist_with_restart(spark, feed, tmp_path):
    put, run = feed
    seen = []
    folder = str(tmp_path / "list")
    sink = playlist.segment_sink(folder, "k")

    def deliver(batch, number):
        seen.extend(tuple(r) for r in batch.orderBy("k", "segment", "action").collect())
        sink(batch, number)
        sink(batch, number)  # twice leaves the same

    base = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp()) // 10
    put([(1, s, None) for s in range(0, 35, 2)] + [(2, 5, False)])
    put([(1, s, None) for s in range(36, 60, 4)])
    run(deliver)
    adds = {(e[0], e[2] - base): e[3] for e in seen if e[1] == "add"}
    assert adds == {(1, 0): 5, (1, 1): 5, (1, 2): 5, (1, 3): 4, (1, 4): 3, (2, 0): 1}
    put([(1, 3, None), (1, 64, None)])  # late for the first segment; a new session goes on with the same state
    put([(1, 66, True), (2, 66, True)])
    put([(1, 90, None)])  # after the end
    run(deliver)
    adds = [(e[0], e[2] - base, e[3]) for e in seen if e[1] == "add"]
    assert sorted(adds) == [(1, 0, 5), (1, 1, 5), (1, 2, 5), (1, 3, 4), (1, 4, 3), (1, 5, 2), (1, 6, 1), (2, 0, 1)]
    assert sorted((e[0], e[2] - base) for e in seen if e[1] == "delete") == [(1, i) for i in range(5)]
    left = {(r.k, r.segment - base): r.n for r in spark.read.parquet(folder).collect()}
    assert left == {(1, 5): 2, (1, 6): 1, (2, 0): 1}



def test_metadata_files(spark):
    value = ";FFMETADATA1\n# note\ntitle=a\\=b\\\nc\\\\\ntitle=last\nempty=\n; other\n[STREAM]\nx=1\n[CHAPTER]\nTIMEBASE=1/90000\nSTART=90000\nEND=135000\ntitle=one\\;\n[CHAPTER]\nSTART=3000000000\nEND=4000000000"
    r = metadata.parse(spark.createDataFrame([(1, value), (2, ";FFMETADATA1")], "k long, value string"), ["k"]).orderBy("k").collect()
    assert r[0].tags == {"title": "last", "empty": ""}
    assert [tuple(c) for c in r[0].chapters] == [(1000, 1500, "one;"), (3000, 4000, None)]
    assert r[1].tags == {} and r[1].chapters == []
    odd = [({"a=b": "x;y#z\\\n\n=", "k": None}, [(0, 5, "t=\n[CHAPTER]\n"), (5, 9, None)]), (None, None), ({}, [])]
    df = spark.createDataFrame([(i, *o) for i, o in enumerate(odd)], "k long, tags map<string,string>, chapters array<struct<start_ms:long,end_ms:long,title:string>>")
    back = metadata.parse(df.select("k", metadata.text(F.col("tags"), F.col("chapters")).alias("value")), ["k"]).orderBy("k").collect()
    assert back[0].tags == {"a=b": "x;y#z\\\n\n="} and [tuple(c) for c in back[0].chapters] == odd[0][1]
    assert [(b.tags, b.chapters) for b in back[1:]] == [({}, [])] * 2
    other = metadata.parse(df.select("k", F.lit("x=1").alias("value")), ["k"]).first()
    assert other.tags is None and other.chapters is None
