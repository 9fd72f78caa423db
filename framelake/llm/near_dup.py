"""Operator 10: MinHash near-dedup with fast similarity sketching.

A document's set is its distinct 5-word shingles (the whole sequence if it has fewer words). The sketch has T bins: in
round i < T every shingle is thrown into a hashed bin with the value i + u, in round T + j all go to bin j, a bin keeps
its least value, and a document stops after the first round that leaves no bin empty; so every coordinate fills within
2T rounds and agreement of coordinates estimates the Jaccard similarity with concentration bounds. Sketches are cut
into bands of ROWS coordinates; a pair at the threshold 0.85 misses all BANDS bands with probability
(1 - 0.85^5)^32 < 1e-8.

Documents of equal sets form a class (one representative goes on). Classes that share a band are linked to the band's
least member only; the connected parts of that graph are candidate clusters, supersets of the true components. Clusters
too large for one task are cut once more by prefix filtering: of two linked sets of n shingles the rarest
n - ceil(0.85 n) + 1 of each, in any order that all sets share, have one in common, so members that share none of these
are parted (pages alike by their template only fall apart here). The order is by counts in a table of CELLS cells,
which covers all members and only decides how well the filter cuts.

Within clusters every link is decided on the full sets (64-bit shingle hashes): small clusters whole, in one task;
large ones in blocks, twice under different deals, after which whoever is not in a cluster's largest part meets all
members of like size, both sides in blocks of bounded size. So no bucket is expanded into pairs in Spark, none is
capped, no link between different texts is lost, and no task holds more than two blocks. What a row carries while it is
dealt to clusters is its id; texts follow when their tasks are known.

Null, empty and all-space texts have empty sets and are linked with nothing. Rows with a null doc_id take no part in
links and stay. Repeated rows are equal sets. Rows that share a doc_id but not a text may join one component. Very long
texts are read in slices and never cut off. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, join_back, pick, settle, small_batches, spread
from .words import byte_table, grams, groups, large_list, mix, whole

SHINGLE, PERCENT = 5, 85
ROWS, BANDS = 5, 32
BINS = ROWS * BANDS
#: Shingles that one task compares at once; clusters beyond are dealt in blocks of about this size.
BLOCK_SHINGLES = 200_000
#: Blocks of a cluster's left-overs, and of those that they meet, are so many times as large: it saves copies.
ACROSS = 5
#: Cells of the table of shingle counts, and the slices in which tasks' tables are added up.
CELLS, SLICES = 1 << 22, 64
_TABLE = byte_table(words="nonspace", lower=True)
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def shingle_sets(a, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a group, by document and hash; and each document's count."""
    bounds = a.bounds()
    n = np.diff(bounds)
    ok = whole(a.doc, k)
    doc, h = a.doc[: len(ok)][ok], grams(a.hash, k)[ok]
    for length in np.unique(n[(n > 0) & (n < k)]):
        short = np.flatnonzero(n == length)
        doc, h = np.concatenate((doc, short)), np.concatenate((h, grams(a.hash, int(length))[bounds[short]] + _U(length)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return doc, h, np.bincount(doc, minlength=a.n_docs)


def sketches(doc: np.ndarray, h: np.ndarray, n_docs: int, bins: int = BINS) -> np.ndarray:
    """(n_docs, bins) sketch values; rows of documents without shingles stay empty."""
    out = np.full((n_docs, bins), _NONE)
    active = np.unique(doc)
    slot = np.searchsorted(active, doc)
    for i in range(2 * bins):
        if not len(active):
            break
        x = mix(h ^ mix(np.array([i + 1], _U)))
        at = ((x >> _U(40)) * _U(bins) >> _U(24)).astype(np.int64) if i < bins else np.full(len(x), i - bins)
        value = mix(x + _U(0x9E3779B97F4A7C15)) >> _U(1)
        new = np.full(len(active) * bins, _NONE)
        np.minimum.at(new, slot * bins + at, value)
        new = new.reshape(len(active), bins)
        old = out[active]
        out[active] = np.where((old == _NONE) & (new != _NONE), new, old)
        open_ = (out[active] == _NONE).any(axis=1)
        if not open_.all():
            keep = open_[slot]
            h, slot = h[keep], (np.cumsum(open_) - 1)[slot[keep]]
            active = active[open_]
    return out


def band_keys(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bands = len(s), s.shape[1] // rows
    s = s.reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (n, bands)).copy()
    for j in range(rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + s[:, :, j])
    return key


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in groups(batch.column(1), _TABLE):
            doc, h, n = shingle_sets(a)
            one, two = np.zeros(a.n_docs, _U), np.zeros(a.n_docs, _U)
            some = np.flatnonzero(n)
            if len(some):
                at = np.searchsorted(doc, some)
                one[some], two[some] = np.add.reduceat(mix(h), at), np.add.reduceat(mix(h ^ _U(0xA5A5A5A5A5A5A5A5)), at)
            keys = band_keys(sketches(doc, h, a.n_docs)).view(np.int64)
            counts = np.where(n > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a.first, a.n_docs), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), large_list(pa.array(keys[n > 0].ravel()), counts)],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in groups(batch.column(2), _TABLE):
            own = [batch.column(i).slice(a.first, a.n_docs) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in _each_set(a)], pa.binary())], names=["rep", "cluster", "hashes"])


def _each_set(a) -> list[np.ndarray]:
    _, h, n = shingle_sets(a)
    return np.split(h, np.cumsum(n)[:-1])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's count of shingles in each cell, one row a slice of the cells."""
    counts = np.zeros(CELLS, np.uint32)
    for batch in batches:
        for blob in batch.column(0):
            cells = (np.frombuffer(blob.as_buffer(), _U) % _U(CELLS)).astype(np.int64)
            np.add.at(counts, cells, 1)
    parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """A slice's sums, as orders of magnitude (a byte each: they only rank shingles)."""
    total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in pdf["counts"])
    return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "counts": [np.minimum(np.log2(total + 1.0) * 6, 255).astype(np.uint8).tobytes()]})


def _prefixes(shared):
    """Rows (rep, cluster, shingle): the rarest of each set that one of any linked set must be among."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            picked = [np.zeros(0, _U)]
            for blob in batch.column(2):
                h = np.frombuffer(blob.as_buffer(), _U)
                most = len(h) - -(-PERCENT * len(h) // 100) + 1
                picked.append(h[np.lexsort((h, rank[(h % _U(CELLS)).astype(np.int64)]))[:most]])
            rows = pa.array(np.repeat(np.arange(len(picked) - 1), [len(x) for x in picked[1:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(picked).view(np.int64))], names=["rep", "cluster", "shingle"])

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class _Postings:
    """Sets by member and members by hash, to intersect one set with all others at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.n)
        flat = np.concatenate(sets) if sets else np.zeros(0, _U)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.keys, self.begin, self.count = np.unique(flat[order], return_index=True, return_counts=True)

    def linked(self, own: np.ndarray) -> np.ndarray:
        """Members whose similarity with the set is at least the threshold."""
        if not len(self.keys) or not len(own):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, own)
        at = at[self.keys[np.minimum(at, len(self.keys) - 1)] == own] if len(at) else at
        count = self.count[at]
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.begin[at], count)
        both = np.bincount(self.owner[rows], minlength=len(self.n))
        return np.flatnonzero((both > 0) & (100 * both >= PERCENT * (len(own) + self.n - both)))


def _links(reps: np.ndarray, clusters: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """All links inside each cluster, as edges (member, least of its part)."""
    out = []
    order = np.lexsort((reps, clusters))
    for mine in np.split(order, np.flatnonzero(np.diff(clusters[order])) + 1) if len(order) else ():
        own = [sets[i] for i in mine]
        index, union = _Postings(own), _Union(len(own))
        for i, x in enumerate(own):
            for j in index.linked(x):
                if j > i:
                    union.join(i, int(j))
        out += [(reps[i], reps[mine[union.find(k)]]) for k, i in enumerate(mine) if union.find(k) != k]
    return np.array(out, np.int64).reshape(-1, 2)


def _within_texts(table: pa.Table) -> pa.Table:
    """Links of the clusters of a bin (columns rep, cluster, text)."""
    sets = [x for a in groups(table["text"], _TABLE) for x in _each_set(a)]
    edges = _links(table["rep"].to_numpy(), table["cluster"].to_numpy(), sets)
    return pa.table({"u": edges[:, 0], "v": edges[:, 1]})


def _within_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links inside a block of a large cluster (columns rep, cluster, hashes)."""
    return pd.DataFrame(_links(pdf["rep"].to_numpy(), pdf["cluster"].to_numpy(), [np.frombuffer(x, _U) for x in pdf["hashes"]]), columns=["u", "v"])


def _across(asked: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
    """Links of the asked members with a block of their cluster: one edge for each of the other's parts."""
    out = []
    parts, reps = base["part"].to_numpy(), base["rep"].to_numpy()
    index = _Postings([np.frombuffer(x, _U) for x in base["hashes"]])
    for rep, part, b in zip(asked["rep"], asked["part"], asked["hashes"]):
        found = index.linked(np.frombuffer(b, _U))
        _, first = np.unique(parts[found], return_index=True)
        out += [(int(rep), int(reps[j])) for j in found[first] if parts[j] != part]
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def _meetings(parted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The (asked, base) rows of each pair of blocks that has to be compared: each side in blocks of about ``most`` shingles.

    Linked sets differ in size by less than a size class, so a class's asked blocks meet the base blocks of its own
    class and of the two beside it. Every asked member meets every base member of these classes once.
    """
    parted = parted.withColumn("size", F.floor(F.log("n") / float(np.log(100 / (PERCENT - 1)))).cast("int")).withColumn("out", F.col("part") != F.col("main"))
    cuts = parted.groupBy("cluster", "size").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("out"), F.col("n"))).alias("left"))
    cuts = settle(cuts.select("cluster", "size", F.ceil(F.col("all") / most).cast("int").alias("bases"), F.coalesce(F.ceil(F.col("left") / most), F.lit(0)).cast("int").alias("askeds")))
    beside = cuts.withColumn("near", F.explode(F.array(*[F.col("size") + i for i in (-1, 0, 1)])))

    def block(size, many):
        return F.struct(F.col(size).alias("size"), F.pmod(F.xxhash64("rep", F.lit(3)), F.col(many)).alias("no"))

    def met(rows, mine, theirs, own, other):
        """The rows once for each block of the other side: ``beside`` turned to the other side's classes."""
        numbers = beside.filter(f"{theirs} > 0").select("cluster", F.col("near").alias("size"), F.col("size").alias("other"), F.col(theirs).alias("many"))
        rows = rows.join(cuts.select("cluster", "size", mine), ["cluster", "size"]).withColumn(own, block("size", mine)).join(numbers, ["cluster", "size"])
        rows = rows.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        other_block = F.struct(F.col("other").alias("size"), F.col("no").cast("long").alias("no")).alias(other)
        fields = ["cluster", "asked_block", "base_block", "rep", "part", "hashes"]
        return rows.select("cluster", own, other_block, "rep", "part", "hashes").select(fields).toDF(*fields)

    return met(parted.filter("out"), "askeds", "bases", "asked_block", "base_block"), met(parted, "bases", "askeds", "base_block", "asked_block")


def _star(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Edges from each rep to the least rep of its keys. Keys of many reps get it by broadcast."""
    least = rows.groupBy(*keys).agg(F.min("rep").alias("v"), F.max("rep").alias("top"), F.count("*").alias("n")).filter("v < top")
    return join_back(rows, settle(least.drop("top")), keys, "n", how="inner").filter("rep <> v").selectExpr("rep AS u", "v")


def _sized(members: DataFrame, block_shingles: int) -> DataFrame:
    """``members`` (rep, n, cluster) with the number of blocks that their cluster fills; rows carry no sets here."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / block_shingles).cast("long").alias("blocks"))
    large = sizes.filter("blocks > 1")  # fewer rows than there are blocks
    return settle(members.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))))


def _parted(sets: DataFrame) -> DataFrame:
    """(node, component) of the large clusters' members (rep, cluster, hashes) that share a rarest shingle in one."""
    spark = sets.sparkSession
    slices = sets.select("hashes").mapInArrow(_tally, "slice int, counts binary").groupBy("slice").applyInPandas(_add_up, "slice int, counts binary")
    ranks = spark.sparkContext.broadcast(b"".join(r.counts for r in sorted(slices.collect())))  # CELLS bytes
    rare = settle(sets.mapInArrow(_prefixes(ranks), "rep long, cluster long, shingle long"))
    return components(_star(rare, ["cluster", "shingle"]))


def _large_links(sets: DataFrame, block_shingles: int) -> DataFrame:
    """The links of clusters of more than one block; ``sets`` has rep, n, cluster, blocks and hashes."""
    dealt = [sets.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(seed)), "blocks")).withColumn("round", F.lit(seed)) for seed in (1, 2)]
    known = settle(dealt[0].union(dealt[1]).groupBy("cluster", "round", "block").applyInPandas(_within_block, "u long, v long"))
    part = components(known).selectExpr("node AS rep", "component AS part")
    slim = settle(sets.select("rep", "cluster").join(part, "rep", "left").withColumn("part", F.coalesce("part", "rep")))
    main = slim.groupBy("cluster", "part").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    parted = settle(sets.join(slim.join(F.broadcast(main), "cluster").select("rep", "part", "main"), "rep"))  # main: fewer rows than blocks
    asked, base = _meetings(parted, block_shingles * ACROSS)
    meeting = ["cluster", "asked_block", "base_block"]
    return known.union(asked.groupBy(*meeting).cogroup(base.groupBy(*meeting)).applyInPandas(_across, "u long, v long"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = spread(small_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))))
    seen = settle(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"))
    real = seen.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets have equal bands.
    classes = settle(real.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    nodes = components(_star(classes.select("rep", F.explode("bands").alias("band")), ["band"]))
    n_of = classes.groupBy("rep").agg(F.max("n_shingles").alias("n"))
    members = _sized(nodes.selectExpr("node AS rep", "component AS cluster").join(n_of, "rep"), block_shingles)

    def with_texts(some: DataFrame) -> DataFrame:
        wanted = pick(docs.filter("doc_id IS NOT NULL"), "doc_id", some.select("rep"), some.count())
        return wanted.join(some, wanted.doc_id == some.rep).drop("doc_id")

    def with_sets(some: DataFrame) -> DataFrame:
        return settle(with_texts(some).select("rep", "cluster", "text").mapInArrow(_sets, "rep long, cluster long, hashes binary"))

    small, links = members.filter("blocks = 1"), []
    if members.filter("blocks > 1").take(1):
        sets = with_sets(members.filter("blocks > 1"))
        finer = _parted(sets).selectExpr("node AS rep", "component AS cluster")
        finer = _sized(finer.join(n_of, "rep"), block_shingles)
        small = settle(small.unionByName(finer.filter("blocks = 1")))
        large = finer.filter("blocks > 1")
        if large.take(1):
            links.append(_large_links(settle(sets.drop("cluster").join(large, "rep")), block_shingles))
    bins = max(1, -(-(small.agg(F.sum("n")).first()[0] or 0) // block_shingles))
    small = with_texts(small).withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins))).select("bin", "rep", "cluster", "text")
    links.append(small.groupBy("bin").applyInArrow(_within_texts, "u long, v long"))
    found = components(links[0].union(links[1]) if len(links) > 1 else links[0])
    resolved = classes.join(found, classes.rep == found.node, "left").select("n_shingles", "d1", "d2", "copies", F.coalesce("component", "rep").alias("c"))
    # Empty sets and null ids have no class; they don't go through the join.
    alone = seen.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("c"))
    linked = join_back(real.drop("bands"), settle(resolved), ["n_shingles", "d1", "d2"], "copies").select("doc_id", "n_shingles", "c")
    return linked.union(alone).select("doc_id", "n_shingles", F.col("c").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("c")).alias("kept"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The contract by plain loops, for small tests."""
    import re

    sets = {}
    for d, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    comp = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= PERCENT * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return [(d, len(s), comp[d], comp[d] == d) for d, s in sets.items()]
