"""Operator 6: approximate nearest neighbours by collision-counting hashing with query-aware windows.

Every vector is projected on PROJECTIONS random directions; each projection of a block of vectors is one sorted array.
A query opens a window around its own projection in every array, of half-width W at radius 1, and widens all windows
from radius to radius (virtual rehashing: no bucket borders, nothing is rebuilt). A vector that falls into at least
COLLISIONS of the windows is a candidate and verified by its true distance. A query stops in a block when enough
candidates have been verified, or when its k nearest found are no farther than its windows reach: a vector outside any
window is farther than that, so nothing nearer is left. With ``exact`` only the second rule (or windows that cover the
block) stops it, and the result is that of brute force.

Vectors are dealt to blocks by a hash of vec_id, sized by the number of rows, and the stated queries to blocks of their
own; every block of queries meets every block of vectors, and a block's k nearest are merged by query. Equal vectors are reduced to the k + 1 smallest ids before anything is dealt,
which changes no result: ties go to the smaller id, so no further copy can be among k neighbours.

Vectors that are null, zero, empty, or hold null or non-finite components take no part; vectors of different lengths
are never compared. Rows with a null vec_id take no part. Repeated rows of one vec_id and vector count once. A vec_id
with several vectors is as many candidates, and a query whose nearest to any of its vectors are ranked in one list.
An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, PROJECTIONS, COLLISIONS = 10, 128, 100
#: Growth of the radius; share of a block that is verified at most before a query stops (and ENOUGH rows at least).
GROWTH, SHARE, ENOUGH = 1.1, 0.05, 400
BLOCK_ROWS, LEAST_ROWS, BLOCKS_AT_LEAST = 100_000, 5_000, 12
#: Queries that one task holds beside a block; more are dealt into several blocks, and each meets a copy of the vectors.
QUERY_ROWS = 25_000
_RESULT = "query_id long, vec_id long, score double"


def clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0)
    )


def _directions(width: int, seed: int) -> np.ndarray:
    a = np.random.default_rng([seed, width]).standard_normal((width, PROJECTIONS))
    return a / np.linalg.norm(a, axis=0)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [first, last)."""
    size = last - first
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def search_block(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, *, k: int = K, seed: int = 7, exact: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, distances) of its k nearest found in the block, in order."""
    a = _directions(x.shape[1], seed)
    projected = (x @ a).T
    n, out = x.shape[0], []
    order = np.argsort(projected, axis=1, kind="stable")
    # All sorted arrays in one, each shifted clear of the last, so that one search finds every window's border.
    centre = queries @ a
    shift = np.arange(PROJECTIONS) * (2.0 * max(np.abs(projected).max(), np.abs(centre).max(), 1e-12) + 1.0) * 4
    arrays = (np.take_along_axis(projected, order, axis=1) + shift[:, None]).ravel()
    order = order.ravel()
    begin = np.arange(PROJECTIONS) * n
    limit = min(max(ENOUGH, int(SHARE * n)), n - 1)
    for q, c, own in zip(queries, centre + shift, query_ids):
        count = np.zeros(n, np.int64)
        seen = np.zeros(n, bool)
        rows, found = np.zeros(0, np.int64), np.zeros(0)
        low = high = np.searchsorted(arrays, c).clip(begin, begin + n)
        # Radius 1: half of the windows hold a tenth of the block on one side.
        radius = max(float(np.median(np.abs(arrays[np.minimum(low + n // 10, begin + n - 1)] - c))), 1e-12)
        while True:
            new_low = np.minimum(low, np.searchsorted(arrays, c - radius, "left").clip(begin, begin + n))
            new_high = np.maximum(high, np.searchsorted(arrays, c + radius, "right").clip(begin, begin + n))
            count += np.bincount(order[_spread(np.concatenate((new_low, high)), np.concatenate((low, new_high)))], minlength=n)
            low, high = new_low, new_high
            whole = bool(((low == begin) & (high == begin + n)).all())
            fresh = np.flatnonzero(((count >= COLLISIONS) | whole) & ~seen)
            seen[fresh] = True
            fresh = fresh[ids[fresh] != own]
            rows, found = np.concatenate((rows, fresh)), np.concatenate((found, np.sqrt(((x[fresh] - q) ** 2).sum(axis=1))))
            # Directions have length 1, so a distance is at least any projected one.
            certain = len(found) >= k and np.partition(found, k - 1)[k - 1] <= radius * (1 - 1e-9)
            if whole or certain or not exact and len(found) >= max(limit, k):
                break
            radius *= GROWTH
        best = np.lexsort((ids[rows], found))[:k]
        out.append((ids[rows[best]], found[best]))
    return out


def _block(base: pd.DataFrame, asked: pd.DataFrame, k: int, exact: bool = False) -> pd.DataFrame:
    if base.empty or asked.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    base = base.sort_values("vec_id")
    got = search_block(np.stack(base["v"].to_numpy()), base["vec_id"].to_numpy(), np.stack(asked["v"].to_numpy()), asked["vec_id"].to_numpy(), k=k, exact=exact)
    sizes = [len(i) for i, _ in got]
    return pd.DataFrame({"query_id": np.repeat(asked["vec_id"].to_numpy(), sizes), "vec_id": np.concatenate([i for i, _ in got]), "score": np.concatenate([d for _, d in got])})


def _meetings(base: DataFrame, asked: DataFrame, blocks: int, query_blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their width, once for each (block, query_block) that they belong to."""

    def own(name, many):
        return {name: F.pmod(F.xxhash64("vec_id"), F.lit(many)).cast("int")}

    def every(name, many):
        return {name: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))}

    base = base.withColumns({"width": F.size("v")} | own("block", blocks)).withColumns(every("query_block", query_blocks))
    return base, asked.withColumns({"width": F.size("v")} | own("query_block", query_blocks)).withColumns(every("block", blocks))


def nearest(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 100, k: int = K, query_rows: int = QUERY_ROWS, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``; the k nearest
    of all if ``exact``."""
    spark = vectors.sparkSession
    every_row = clean(vectors, vec_id, embedding)
    n, n_asked = vectors.agg(F.count("*"), F.count_if(F.col(vec_id).cast("long") % every == 0)).first()
    wanted = max(spark.sparkContext.defaultParallelism, BLOCKS_AT_LEAST)
    blocks = max(1, -(-n // max(LEAST_ROWS, min(BLOCK_ROWS, -(-n // wanted)))))
    # The k + 1 smallest ids of each vector; the limit is applied before the shuffle too.
    ranked = every_row.dropDuplicates(["vec_id", "v"]).withColumn("_n", F.expr("row_number() OVER (PARTITION BY v ORDER BY vec_id)")).filter(F.col("_n") <= k + 1).drop("_n")
    asked = every_row.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    base, asked = _meetings(ranked, asked, blocks, max(1, -(-n_asked // query_rows)))
    meeting = ["width", "block", "query_block"]
    found = base.groupBy(*meeting).cogroup(asked.groupBy(*meeting)).applyInPandas(lambda b, a: _block(b, a, k, exact), _RESULT)
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)")
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
