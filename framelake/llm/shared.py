"""What several operators need: settled intermediate tables, connected components, whole-row helpers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import shared_folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, as the session's checkpoint folder too."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if not now.isDefined():
        sc.setCheckpointDir(shared_folder(spark))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


#: Rows that go to a Python kernel at once, instead of Spark's default of 10,000: texts are long.
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; lowers the session's rows per Arrow batch if it is the default, which bounds what a task holds of long
    texts in the JVM and in Python. A value that the user has set stays."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY) == BATCH_DEFAULT:
        conf.set(BATCH_KEY, BATCH_ROWS)
    return df


#: Bytes a core under which a table of files is dealt anew: Spark doesn't split files below its open cost of 4 MB.
SMALL_SHARE = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it is a table of a few megabytes, which may lie in a single row group. Larger ones are
    split by the scan and never shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL_SHARE else df


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, which survives lost executors, and cut from its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer read."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """The folders right in a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().toString() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where) if s.isDirectory()]


def bitmap(prints: DataFrame, bits: int, slices: int = 64) -> bytes:
    """A bitmap of ``bits`` bits (a power of two, 8 * slices at least), set by the leading bits of each 64-bit value of the
    only column. Tasks' bitmaps are united by slice; the driver gets bits / 8 bytes."""
    width = bits // 8 // slices

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            place = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
            np.bitwise_or.at(marks, place >> 3, (128 >> (place & 7)).astype(np.uint8))
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(marks, slices)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "marks"])

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(width, np.uint8)
        for x in pdf["marks"]:
            marks |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "marks": [marks.tobytes()]})

    rows = prints.mapInArrow(mark, "slice int, marks binary").groupBy("slice").applyInPandas(unite, "slice int, marks binary").collect()
    return b"".join(bytes(r.marks) for r in sorted(rows)) or bytes(bits // 8)


def marked(marks: bytes, values: np.ndarray) -> np.ndarray:
    """Which 64-bit values have their bit set in a ``bitmap``."""
    place = (values.view(np.uint64) >> np.uint64(64 - (8 * len(marks)).bit_length() + 1)).astype(np.int64)
    return np.frombuffer(marks, np.uint8)[place >> 3] >> (7 - (place & 7)) & 1 == 1


def pick(rows: DataFrame, key: str, wanted: DataFrame, count: int, most_bits: int = 1 << 28) -> DataFrame:
    """Those of ``rows`` whose key may be among the ``count`` values of ``wanted``'s only column, before they are shuffled
    to meet them: looked up in a bitmap of 16 bits a value, ``most_bits`` at most (a full one lets every row through)."""
    bits = min(most_bits, 1 << max(10, (16 * count - 1).bit_length()))
    marks = rows.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64(wanted.columns[0])), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(marks.value, batch.column(batch.num_columns - 1).to_numpy())))

    hashed = rows.withColumn("_hash", F.xxhash64(key))
    return hashed.mapInArrow(run, hashed.schema).drop("_hash")


def _hubs(keyed: DataFrame, key: str, value, total: int, most: int = 1000) -> DataFrame:
    """(key, value) of keys that hold over 1/most of the ``total`` rows: fewer than ``most``."""
    return settle(keyed.groupBy(key).agg(value, F.count("*").alias("_n")).filter(F.col("_n") * most > total).drop("_n"))


def join_back(rows: DataFrame, found: DataFrame, keys: list[str], copies: str, most: int = 1000, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``found`` (settled; one row a key, with how many ``copies`` of it ``rows`` has), but
    ``copies``. Keys that hold over 1/most of all copies are at most ``most``: they are broadcast, so that none gathers
    in a task; the others are joined by shuffle (``how``: left or inner). Keys are not null."""
    total, largest = found.agg(F.sum(copies), F.max(copies)).first()
    is_hot = F.col(copies) * most > (total or 0)
    if (largest or 0) * most <= (total or 0):  # nothing to broadcast
        return rows.join(found.drop(copies), keys, how)
    hot = F.broadcast(found.filter(is_hot).drop(copies))  # fewer than ``most`` rows
    cold = rows.join(hot, keys, "left_anti").join(found.filter(~is_hot).drop(copies), keys, how)
    return rows.join(hot, keys).unionByName(cold)


def _summed(edges: DataFrame) -> tuple:
    """How many edges, and 128 bits of their sum and parity: equal if no edge has changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(edges: DataFrame, most: int = 60, per_task: int = 500_000, hubs_from: int = 10_000) -> DataFrame:
    """(node, component) of an undirected graph given as edges (u, v) of longs; component is the least node reached.

    Alternates large-star and small-star steps (each node's neighbours are linked to the least of them). In the large
    star, nodes that hold over a thousandth of all edges get their least neighbour by broadcast, so a hub's neighbours
    are never gathered (under ``hubs_from`` edges there is nothing to spread); the small star groups by the larger end, which has few smaller neighbours. Tasks are as many as the edges need, about ``per_task`` each, however many partitions
    the session shuffles into. Rounds grow with the logarithm of the node count; raises if ``most`` don't suffice.
    """
    least_tasks = edges.sparkSession.sparkContext.defaultParallelism
    edges = settle(edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    before = _summed(edges)
    if not before[0]:
        return edges.selectExpr("u AS node", "v AS component")
    for _ in range(most):
        tasks = max(least_tasks, -(-before[0] // per_task))
        edges = edges.coalesce(tasks)
        both = edges.union(edges.selectExpr("v AS u", "u AS v")).coalesce(tasks)
        least = F.least(F.min("v"), F.first("u")).alias("m")
        found = None if before[0] < hubs_from else _hubs(both, "u", least, 2 * before[0])
        if found is None or not found.take(1):
            near = both.join(both.groupBy("u").agg(least), "u")
        else:
            hubs = F.broadcast(found)
            others = both.join(hubs, "u", "left_anti")
            near = others.join(others.groupBy("u").agg(least), "u").unionByName(both.join(hubs, "u"))
        large = near.filter("v > u").selectExpr("v AS u", "m AS v").filter("u <> v").coalesce(tasks)
        large = large.repartition("u").dropDuplicates(["u", "v"])  # here u > v throughout; what follows keeps this partitioning
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").selectExpr("v AS u", "m AS v").union(least.selectExpr("u", "m AS v"))
        edges = settle(small.coalesce(tasks).distinct().coalesce(tasks))
        now = _summed(edges)
        if now == before:
            own = edges.select(F.col("v").alias("u"), "v").distinct()
            return edges.union(own).selectExpr("u AS node", "v AS component")
        before = now
    raise RuntimeError(f"components: not settled after {most} rounds")
