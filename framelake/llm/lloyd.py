"""Exact k-means on integer vectors, sharded by dimension.

A vector's components become whole numbers, ``floor(scale * x)``. The table is cut twice: rows into chunks (a batch
each), columns into blocks of ``width``; a tile is a chunk's part of a block. In a round

* a tile meets its block's slice of the centroids and gives partial squared distances, rows by centroids;
* the partial distances of a chunk are added up by key, and the least centroid of each row is its cluster;
* the clusters go back to the tiles, which sum their columns by cluster; every block adds its tasks' sums and floors
  them by the counts: each shard makes its own next slice.

Nothing is keyed by cluster or by value, so equal vectors and large clusters don't gather anywhere. Only the slices
(``k`` times the dimensions) and a row for each cluster are broadcast, both bounded by MOST_ENTRIES.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle, spread

#: Largest absolute value of a component after scaling: squared distances of up to 64 such components fit into a long.
LARGEST = 1 << 27
#: Most numbers that all centroids together may have; they are broadcast.
MOST_ENTRIES = 1 << 22

TILE = "chunk long, block int, n int, width int, cells binary, ids array<long>"


def usable(vector: Column, dims: int, scale: float) -> Column:
    """Whether a vector takes part: ``dims`` components, none of them null, not finite or beyond LARGEST."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= LARGEST))
    return vector.isNotNull() & (F.size(vector) == dims) & ~bad


def tiles(vectors: DataFrame, dims: int, width: int) -> DataFrame:
    """(chunk, block, n, width, cells, ids) of (id, whole numbers); block 0 has the ids. Cells are the narrowest integers
    that hold the tile."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            rows = []
            for block, at in enumerate(range(0, dims, width)):
                part = cells[:, at : at + width]
                kind = next(t for t in (np.int8, np.int16, np.int32) if np.abs(part).max() <= np.iinfo(t).max)
                ids = batch.column(0).to_pylist() if block == 0 else None
                rows.append((task << 32 | seen, block, len(part), part.shape[1], part.astype(kind).tobytes(), ids))
            seen += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())))],
                names=["chunk", "block", "n", "width", "cells", "ids"],
            )

    return vectors.mapInArrow(cut, TILE)


def _cells(n: int, width: int, cells: bytes) -> np.ndarray:
    return np.frombuffer(cells, f"i{len(cells) // (n * width)}").reshape(n, width).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial squared distances of tiles (chunk, n, width, cells, slice), rows by centroids."""
    for batch in batches:
        parts = []
        for n, width, cells, centres in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            x, c = _cells(n, width, cells), np.frombuffer(centres, np.int64).reshape(-1, width)
            near = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
            parts.append(near.astype(np.int32 if near.max() < 1 << 31 else np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], names=["chunk", "n", "part"])


def _nearest(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Adds the partial distances of a chunk; ties go to the smaller centroid."""
    n = int(pdf["n"].iloc[0])
    total = np.zeros((n, k), np.int64)
    for part in pdf["part"]:
        total += np.frombuffer(part, f"i{len(part) // (n * k)}").reshape(n, k)
    best = total.argmin(1)
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "labels": [best.astype(np.int32).tobytes()], "near": [total.min(1).tobytes()]})


def assign(cut: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """(chunk, labels, near): each row's cluster and squared distance, as bytes of int32 and int64."""
    met = cut.join(F.broadcast(slices), "block").select("chunk", "n", "width", "cells", "slice")  # at most MOST_ENTRIES numbers
    parts = met.mapInArrow(_partial, "chunk long, n int, part binary")
    return settle(parts.groupBy("chunk").applyInPandas(lambda pdf: _nearest(pdf, k), "chunk long, labels binary, near binary"))


def update(cut: DataFrame, labels: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """The next slices: floor(sum / count) of every column by cluster; a cluster without rows keeps its centroid."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, n, width, cells, own in zip(*(batch.column(i).to_pylist() for i in range(5))):
                x, label = _cells(n, width, cells), np.frombuffer(own, np.int32)
                got = sums.setdefault(block, [np.zeros((k, width), np.int64), np.zeros(k, np.int64)])
                order = np.argsort(label, kind="stable")
                at = np.flatnonzero(np.diff(label[order], prepend=-1))
                got[0][label[order][at]] += np.add.reduceat(x[order], at, axis=0)
                got[1] += np.bincount(label, minlength=k)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s, _ in sums.values()], pa.binary()), pa.array([c.tobytes() for _, c in sums.values()], pa.binary())],
                names=["block", "sums", "counts"],
            )

    def floor(sums: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        centres = np.frombuffer(old["slice"].iloc[0], np.int64).reshape(k, -1).astype(object)
        total = sum(np.frombuffer(x, np.int64).reshape(k, -1).astype(object) for x in sums["sums"])
        count = sum(np.frombuffer(x, np.int64).astype(object) for x in sums["counts"])
        for j in range(k):
            if count[j]:
                centres[j] = total[j] // count[j]  # Python's whole numbers: exact, however many rows
        return pd.DataFrame({"block": [int(old["block"].iloc[0])], "slice": [centres.astype(np.int64).tobytes()]})

    met = cut.join(labels, "chunk").select("block", "n", "width", "cells", "labels")
    sums = met.mapInArrow(add, "block int, sums binary, counts binary")
    return settle(sums.groupBy("block").cogroup(slices.groupBy("block")).applyInPandas(floor, "block int, slice binary"))


def lloyd(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, width: int = 32, seed: str = "1", key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Clusters ``vectors`` by ``rounds`` of exact Lloyd and a last assignment; a row for each vector that takes part:
    ``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the final centroid's components, in
    decimal, joined by commas). Other columns, whatever their names, are not read.

    Centroids start as the ``k`` vectors with the least hex SHA-256 of ``seed:key``, in that order, and are never more than
    there are vectors. Defined results: null vectors, vectors of another length and those with null, non-finite or very
    large components (see LARGEST; their distances pass a long) give no row; a null key gives a row but no starting
    centroid; repeated rows each count, and each may start a centroid (equal keys in order of their vectors); ties go to
    the smaller centroid; an empty table gives an empty result. A sum of distances beyond a long is null.
    """
    if k * dims > MOST_ENTRIES:
        raise ValueError(f"k * dims is {k * dims}; at most {MOST_ENTRIES} numbers are broadcast")
    spark = vectors.sparkSession
    kept = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter(usable(F.col("v"), dims, scale))
    kept = kept.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = [r.v for r in kept.filter("id IS NOT NULL").orderBy(hashed, "v").limit(k).collect()]  # k vectors
    schema = f"{key} {dict(vectors.dtypes)[key]}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    k = len(first)
    start = np.array(first, np.int64)
    cut = settle(tiles(spread(kept), dims, width))
    slices = spark.createDataFrame([(b, bytearray(start[:, at : at + width].tobytes())) for b, at in enumerate(range(0, dims, width))], "block int, slice binary")
    for _ in range(rounds):
        slices = update(cut, assign(cut, slices, k), slices, k)
    labels = assign(cut, slices, k)
    centres = np.concatenate([np.frombuffer(r.slice, np.int64).reshape(k, -1) for r in slices.orderBy("block").collect()], 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own, near in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(own, np.int32)), pa.array(np.frombuffer(near, np.int64))], names=["id", "cluster", "distance"])

    each = cut.filter("block = 0").select("chunk", "ids").join(labels, "chunk").select("ids", "labels", "near").mapInArrow(rows, "id long, cluster int, distance long")
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    sums = {r.cluster: r.s for r in each.groupBy("cluster").agg(exact.alias("s")).collect()}  # k rows
    as_long = lambda x: int(x) if x < 1 << 63 else None
    told = [(j, as_long(s), as_long(sum(sums.values())), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for j, s in sums.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return each.join(F.broadcast(about), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
