"""Readers of sample and picture files as Spark data sources, batch and streaming.

``register(spark)`` adds two formats. ``wav`` gives (path, n, ch, value, rate) of RIFF files, ``netpbm`` (path, width,
height, channels, plane) of binary grey or colour pictures. The schema that a reader is given is what it decodes: columns
left out of it are neither read nor sent (``read_wav`` does that), and comparisons of ``n`` with numbers are pushed into
the reader, which then reads only those bytes. Files are cut into ranges of bytes; a frame belongs to the range in which
it ends, so a task needs no other task's bytes and a growing file goes on where the last batch stopped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WAV = "path string, n long, ch int, value double, rate int"
PICTURE = "path string, width int, height int, channels int, plane binary"
#: Bytes of a range and of a task, bytes that a file counts for at least in a task, and frames decoded at once.
RANGE, SMALL, AT_ONCE = 32 << 20, 256 << 10, 1 << 16
INT, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def files(folder: str, suffixes: tuple[str, ...]) -> tuple[object, list]:
    """(filesystem, its files of these kinds in order); the folder may be a path or a URI that Arrow knows."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return store, sorted((f for f in found if f.is_file and f.path.lower().endswith(suffixes)), key=lambda f: f.path)


def opened(uri: str, path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)[0].open_input_file(path)


@dataclass(frozen=True)
class Layout:
    kind: int  # INT or FLOAT
    channels: int
    rate: int
    bits: int
    begin: int  # where the samples start and end
    end: int

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8


def wav_layout(f, size: int) -> Layout:
    """What a file's chunks say; samples run to the end of the file if their chunk says so or its size isn't known yet."""
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    form = None
    while len(chunk := f.read(8)) == 8:
        name, length = struct.unpack("<4sI", chunk)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", (body := f.read(length))[:16])
            form = (struct.unpack("<H", body[24:26])[0] if kind == EXTENSIBLE else kind, channels, rate, bits)
            f.seek(length % 2, 1)
        elif name == b"data":
            if form is None or form[0] not in (INT, FLOAT) or form[3] not in (8, 16, 24, 32, 64) or not form[1]:
                raise ValueError(f"unknown sample format {form}")
            begin = f.tell()
            known = 0 < length < 0xFFFFFFFF - 64
            return Layout(*form, begin, min(size, begin + length) if known else size)
        else:
            f.seek(length + length % 2, 1)
    raise ValueError("no samples")


def decoded(data: bytes, kind: int, bits: int) -> np.ndarray:
    """Samples as doubles; whole numbers are scaled to [-1, 1)."""
    if kind == FLOAT:
        return np.frombuffer(data, "<f4" if bits == 32 else "<f8").astype(float)
    if bits == 8:  # unsigned
        return (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    if bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(float) / (1 << 23)
    return np.frombuffer(data, f"<i{bits // 8}").astype(float) / float(1 << (bits - 1))


@dataclass
class Range(ds.InputPartition):
    path: str
    size: int
    begin: int  # frames that end after ``begin`` and not after ``end``
    end: int


@dataclass
class Ranges(ds.InputPartition):
    parts: list[Range]


class _Wav:
    def __init__(self, options: dict, schema: StructType):
        self.uri, self.names, self.arrow = options["path"], schema.names, None
        self.range = int(options.get("range", RANGE))
        self.lo, self.hi = 0, None  # frames asked for

    def ranges(self, path: str, size: int, begin: int = 0) -> Iterator[Range]:
        for at in range(begin, size, self.range):
            yield Range(path, size, at, min(size, at + self.range))

    def tasks(self, ranges: Iterator[Range]) -> list[Ranges]:
        """Small files share a task, so there are as many tasks as the bytes and a share of the files ask for."""
        out, room = [], 0
        for r in ranges:
            weight = max(r.end - r.begin, SMALL)
            if not out or weight > room:
                out.append(Ranges([]))
                room = self.range
            out[-1].parts.append(r)
            room -= weight
        return out

    def read(self, task: Ranges | None) -> Iterator[pa.RecordBatch]:
        for part in task.parts if task else []:  # none without partitions
            yield from self._range(part)

    def _range(self, part: Range) -> Iterator[pa.RecordBatch]:
        with opened(self.uri, part.path) as f:
            lay = wav_layout(f, part.size)
            frames = (lay.end - lay.begin) // lay.frame
            done = lambda at: min(frames, max(0, (at - lay.begin) // lay.frame))  # noqa: E731  frames that end by then
            lo, hi = max(done(part.begin), self.lo), min(done(part.end), frames if self.hi is None else self.hi)
            kinds = {"path": pa.string(), "n": pa.int64(), "ch": pa.int32(), "value": pa.float64(), "rate": pa.int32()}
            for at in range(lo, hi, AT_ONCE):
                upto = min(hi, at + AT_ONCE)
                n = (upto - at) * lay.channels
                columns = {
                    "path": lambda n=n: pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [part.path]).cast(pa.string()),
                    "n": lambda at=at, upto=upto: np.repeat(np.arange(at, upto), lay.channels),
                    "ch": lambda at=at, upto=upto: np.tile(np.arange(lay.channels, dtype=np.int32), upto - at),
                    "value": lambda at=at, n=n: self._values(f, lay, at, n),
                    "rate": lambda n=n: np.full(n, lay.rate, np.int32),
                }
                yield pa.RecordBatch.from_arrays([pa.array(columns[c](), kinds[c]) for c in self.names], names=self.names)

    def _values(self, f, lay: Layout, at: int, n: int) -> np.ndarray:
        f.seek(lay.begin + at * lay.frame)
        return decoded(f.read(n * lay.bits // 8), lay.kind, lay.bits)


class WavReader(_Wav, ds.DataSourceReader):
    def pushFilters(self, filters):
        """Bounds of n become frames to read; other filters stay with Spark."""
        for f in filters:
            at = getattr(f, "attribute", None)
            kind = type(f)
            if at == ("n",) and isinstance(getattr(f, "value", None), int) and kind in (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual):
                if kind in (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual):
                    self.lo = max(self.lo, f.value + (kind is ds.GreaterThan))
                if kind in (ds.EqualTo, ds.LessThan, ds.LessThanOrEqual):
                    top = f.value + (kind is not ds.LessThan)
                    self.hi = top if self.hi is None else min(self.hi, top)
            else:
                yield f

    def partitions(self):
        return self.tasks(r for f in files(self.uri, (".wav",))[1] for r in self.ranges(f.path, f.size))


class WavStream(_Wav, ds.DataSourceStreamReader):
    """Offsets are the sizes of the files that have been read: new files and what is added to old ones make a batch."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f.path: f.size for f in files(self.uri, (".wav",))[1]}

    def partitions(self, start: dict, end: dict):
        return self.tasks(r for path, size in sorted(end.items()) for r in self.ranges(path, size, start.get(path, 0)))


class WavSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return WAV

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options, schema)

    def streamReader(self, schema: StructType) -> WavStream:
        return WavStream(self.options, schema)


class PictureReader(ds.DataSourceReader):
    """Binary PGM and PPM files of bytes; ``per_task`` files a task. Without the plane only headers are read."""

    def __init__(self, options: dict, schema: StructType):
        self.uri, self.names, self.per_task = options["path"], schema.names, int(options.get("per_task", 64))

    def partitions(self):
        paths = [f.path for f in files(self.uri, (".pgm", ".ppm"))[1]]
        return [ds.InputPartition(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)]

    def read(self, part: ds.InputPartition | None):
        for path in part.value if part else []:
            with opened(self.uri, path) as f:
                channels, width, height = picture_head(f)
                row = {"path": path, "width": width, "height": height, "channels": channels}
                if "plane" in self.names:
                    row["plane"] = f.read(width * height * channels)
                    if len(row["plane"]) < width * height * channels:
                        raise ValueError(f"{path}: a picture ends early")
                yield tuple(row[c] for c in self.names)


def picture_head(f) -> tuple[int, int, int]:
    """(channels, width, height); the file is left where the plane begins. Comments are skipped."""
    fields: list[bytes] = []
    word, comment = b"", False
    while len(fields) < 4:
        c = f.read(1)
        if not c:
            raise ValueError("a picture without a header")
        comment = (comment or c == b"#") and c != b"\n"
        if comment:
            continue
        if c.isspace():
            fields, word = (fields + [word] if word else fields), b""
        else:
            word += c
    if fields[0] not in (b"P5", b"P6") or fields[3] != b"255":
        raise ValueError("a binary PGM or PPM of bytes is asked for")
    return 1 if fields[0] == b"P5" else 3, int(fields[1]), int(fields[2])


class PictureSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "netpbm"

    def schema(self) -> str:
        return PICTURE

    def reader(self, schema: StructType) -> PictureReader:
        return PictureReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # so that bounds of n reach the reader
    for source in (WavSource, PictureSource):
        spark.dataSource.register(source)


def read_wav(spark: SparkSession, folder: str, columns: list[str] | None = None, stream: bool = False, **options) -> DataFrame:
    """The samples of a folder's files, of them only ``columns``."""
    register(spark)
    kinds = dict(c.strip().split(" ") for c in WAV.split(","))
    if columns is not None and (odd := set(columns) - set(kinds)):
        raise ValueError(f"no such columns: {sorted(odd)}")
    reader = (spark.readStream if stream else spark.read).format("wav").options(**options)
    return reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(folder)


def read_pictures(spark: SparkSession, folder: str, columns: list[str] | None = None, **options) -> DataFrame:
    register(spark)
    kinds = dict(c.strip().split(" ") for c in PICTURE.split(","))
    return spark.read.format("netpbm").options(**options).schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(folder)


def wav_head(frames: int, channels: int, rate: int) -> bytes:
    """The header of 32-bit float samples."""
    size = frames * channels * 4
    if size > 0xFFFFFFFF - 64:
        raise ValueError("a WAV file holds at most 4 GB")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, FLOAT, channels, rate, rate * channels * 4, channels * 4, 32, b"data", size)


def write_wav(samples: DataFrame, folder: str, key: str, rate: int, channels: int = 1) -> DataFrame:
    """(key, path, frames) of a file for each ``key`` in ``folder``, of samples (key, n, ch, value) of which none is missing.
    Rows arrive sorted and are written as they come, so a stream's length is no matter; a file appears under its name when
    it is whole, so a task that runs again replaces it."""
    sizes = samples.groupBy(key).agg(F.count("*").alias("_rows"))
    dealt = samples.select(key, "n", "ch", F.col("value").cast("float").alias("value")).join(sizes, key)
    kind = samples.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        made: list[tuple] = []
        now, out = None, None

        def close() -> None:
            out.close()
            store.move(f"{root}/.{now}.part", f"{root}/{now}.wav")

        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            values = batch.column(3).to_numpy().astype("<f4")
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if keys[i] != now or out is None:
                    if out is not None:
                        close()
                    now, frames = keys[i], batch.column(4)[i].as_py() // channels
                    out = store.open_output_stream(f"{root}/.{now}.part")
                    out.write(wav_head(frames, channels, rate))
                    made.append((now, f"{root}/{now}.wav", frames))
                out.write(values[i:j].tobytes())
        if out is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=[key, "path", "frames"])

    return dealt.repartition(key).sortWithinPartitions(key, "n", "ch").mapInArrow(run, f"`{key}` {kind}, path string, frames long")


def write_pictures(frames: DataFrame, folder: str, key: str) -> DataFrame:
    """(key, path) of a PGM or PPM file for each row (key, width, height, channels, plane of bytes)."""
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            made = []
            for name, w, h, channels, plane in zip(*(batch.column(i).to_pylist() for i in range(5))):
                path = f"{root}/{name}.{'pgm' if channels == 1 else 'ppm'}"
                with store.open_output_stream(path) as out:
                    out.write(b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, w, h) + plane)
                made.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "path"])

    return frames.select(key, "width", "height", "channels", "plane").mapInArrow(run, f"`{key}` {kind}, path string")
