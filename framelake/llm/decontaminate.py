"""Operator 7: benchmark decontamination by winnowing.

Both sides are cut into words (ASCII letters lower-cased, digits, all non-ASCII characters). Of each W consecutive
K-grams the least hash is kept as a fingerprint, so every shared run of K + W - 1 = ``window`` words shares one. A
document's fingerprints are looked up among the benchmark's; around each hit the windows that hold it are compared
with the benchmark's windows (128-bit digests of whole word sequences), which extends hits to the full shared span.
An item shorter than ``window`` words is one window of its own length, found by its full n-gram.

A benchmark of at most ``block_words`` words (checked before anything is read to the driver) is broadcast. A larger
one is joined by shuffle: both sides give their windows, keyed by their digests, the documents only those whose
fingerprint is set in a bitmap of the benchmark's fingerprints (at most BITS bits, however large the benchmark; a full
one only prunes less), then what was found goes back to the documents by the digest of their text.

Null and empty texts have no words; items without words hit nothing; an item with a null id is listed as ''. Repeated
rows are judged alike, repeated items count once. Very long texts are read in slices and never cut off. An empty table
of documents gives an empty result, an empty benchmark marks nothing. Extra columns are kept; those named like the
results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bitmap, settle, small_batches, spread
from .words import byte_table, covered, grams, groups, sliding_least, whole, winnow

WINDOW, K = 10, 5
BLOCK_WORDS = 2_000_000
BITS = 1 << 28
_TABLE = byte_table(words="alnum", lower=True)
RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_items", "hit_spans")


class Block:
    """The windows of some benchmark items: sorted fingerprints, window digests and the items of each window."""

    def __init__(self, ids: list[str], texts: list[str], window: int, k: int):
        self.ids, self.window, self.k = np.array(ids, object), window, min(k, window)
        prints: list[np.ndarray] = [np.zeros(0, np.uint64)]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        column = pa.array(texts, pa.string())
        for a, b in zip(groups(column, _TABLE), groups(column, _TABLE, 1)):
            n = np.diff(a.bounds())
            g = grams(a.hash, self.k)
            at = winnow(g, a.doc, self.k, window - self.k + 1)
            prints.append(g[at])
            ok = np.flatnonzero(whole(a.doc, window))
            found.setdefault(window, []).append((grams(a.hash, window)[ok], grams(b.hash, window)[ok], a.doc[ok] + a.first))
            for length in np.unique(n[(n > 0) & (n < window)]):
                at = a.bounds()[:-1][n == length]
                found.setdefault(int(length), []).append((grams(a.hash, length)[at], grams(b.hash, length)[at], np.flatnonzero(n == length) + a.first))
        self.prints = np.unique(np.concatenate(prints))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length, rows in found.items():
            one, two, item = (np.concatenate(x) for x in zip(*rows))
            if len(one):
                order = np.lexsort((item, two, one))
                self.windows[length] = one[order], two[order], item[order]

    def hits(self, a, b) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, word positions at which a benchmark window starts, items) for each window length; positions repeat
        for each item."""
        for length, (one, two, item) in self.windows.items():
            if length == self.window:
                g = grams(a.hash, self.k)
                at = winnow(g, a.doc, self.k, self.window - self.k + 1)
                at = at[_among(self.prints, g[at])]
                at = np.unique((at[:, None] - np.arange(self.window - self.k + 1)[None, :]).ravel())
                at = at[(at >= 0) & (at + length <= len(a.hash))]
                at = at[a.doc[at] == a.doc[at + length - 1]] if len(at) else at
            else:
                at = np.flatnonzero(whole(a.doc, length))
            if not len(at):
                continue
            x = _grams_at(a.hash, at, length)
            some = _among(one, x)
            at, x = at[some], x[some]
            y = _grams_at(b().hash, at, length) if len(at) else x
            low, high = np.searchsorted(one, x, "left"), np.searchsorted(one, x, "right")
            each = np.repeat(np.arange(len(at)), high - low)
            row = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[each]
            same = two[row] == y[each]
            yield length, at[each[same]], item[row[same]]


def _among(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _grams_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    if len(at) * 4 > len(h):
        return grams(h, k)[at]
    return grams(h[at[:, None] + np.arange(k)[None, :]].ravel(), k)[::k] if len(at) else np.zeros(0, np.uint64)


def _marker(shared, text: str, keep: list[str]):
    """The broadcast way: marks a batch's documents with one block."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for batch in batches:
            n_words, spans, items = [], [], []
            column = batch.column(batch.schema.get_field_index(text))
            for a in groups(column, _TABLE):
                n_words.append(np.diff(a.bounds()))
                hit = np.zeros(len(a.hash), bool)
                pairs: list[np.ndarray] = [np.zeros(0, np.int64)]
                memo: list = []

                def other():
                    if not memo:
                        memo.extend(groups(column.slice(a.first, a.n_docs), _TABLE, 1))
                    return memo[0]

                for length, at, item in block.hits(a, other):
                    hit |= covered(len(hit), at, length)
                    pairs.append(np.unique(a.doc[at] * len(block.ids) + item))
                mine: dict[int, set[str]] = {}
                for d, i in zip(*divmod(np.concatenate(pairs), max(1, len(block.ids)))):
                    mine.setdefault(int(d), set()).add(str(block.ids[i]))
                per = _runs(hit, a.bounds())
                for d in range(a.n_docs):
                    spans.append([{"start": s, "end": e} for s, e in per.get(d, [])])
                    items.append(sorted(mine.get(d, ())))
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(counts.astype(np.int64)), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                names=[*keep, "n_words", "hit_spans", "hit_items"],
            )

    return mark


def _runs(hit: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Each document's runs of hit words."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    per: dict[int, list[tuple[int, int]]] = {}
    for s, e in zip(begin.tolist(), stop.tolist()):
        while s < e:  # a run may go on in the next document
            d = int(np.searchsorted(bounds, s, "right")) - 1
            end = min(e, int(bounds[d + 1]))
            per.setdefault(d, []).append((s - int(bounds[d]), end - int(bounds[d])))
            s = end
    return per


_WINDOWS = "length int, one long, two long"


def _item_windows(window: int, k: int):
    """Rows (length, one, two, print, item) of the windows of items (columns item, text). A window's fingerprint is the
    least of its K-grams, a short item's its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            for a, b in zip(groups(column, _TABLE), groups(column, _TABLE, 1)):
                n, first = np.diff(a.bounds()), a.bounds()[:-1]
                at = np.flatnonzero(whole(a.doc, window))
                found = [(np.full(len(at), window), at, sliding_least(grams(a.hash, k), window - k + 1)[at] if len(at) else np.zeros(0, np.uint64))]
                for length in np.unique(n[(n > 0) & (n < window)]):
                    at = first[n == length]
                    found.append((np.full(len(at), length), at, grams(a.hash, int(length))[at]))
                for size, at, least in found:
                    if len(at):
                        one, two = (grams(x.hash, int(size[0]))[at] for x in (a, b))
                        item = batch.column(0).slice(a.first, a.n_docs).take(pa.array(a.doc[at]))
                        yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), *(pa.array(x.view(np.int64)) for x in (one, two, least)), item], names=["length", "one", "two", "print", "item"])

    return run


def _doc_windows(shared, lengths: list[int], window: int, k: int):
    """Rows (length, one, two, key, at) of those windows of documents (columns key, text) whose fingerprint is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(shared.value, np.uint8)
        shift = np.uint64(64 - (len(marks) * 8).bit_length() + 1)
        for batch in batches:
            column = batch.column(1)
            for a in groups(column, _TABLE):
                b = None
                for length in lengths:
                    ok = whole(a.doc, length)
                    if not len(ok):
                        continue
                    one = grams(a.hash, length)
                    least = sliding_least(grams(a.hash, k), window - k + 1) if length == window else one
                    place = (least >> shift).astype(np.int64)
                    at = np.flatnonzero(ok & (marks[place >> 3] >> (7 - (place & 7)) & 1 == 1))
                    if not len(at):
                        continue
                    b = b or next(groups(column.slice(a.first, a.n_docs), _TABLE, 1))
                    key = batch.column(0).slice(a.first, a.n_docs).take(pa.array(a.doc[at]))
                    first = a.bounds()[a.doc[at]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), length), pa.int32()), pa.array(one[at].view(np.int64)), pa.array(grams(b.hash, length)[at].view(np.int64)), key, pa.array((at - first).astype(np.int32))],
                        names=["length", "one", "two", "key", "at"],
                    )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (columns key, spans) that touch become one."""
    for batch in batches:
        spans = [_union([(x["start"], x["end"]) for x in row]) for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=["key", "hit_spans"])


def _counted(text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(a.bounds()) for a in groups(batch.column(batch.schema.get_field_index(text)), _TABLE)] or [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(np.concatenate(counts).astype(np.int64))], names=[*keep, "n_words"])

    return run


def _by_shuffle(docs: DataFrame, items: DataFrame, text: str, kept: list[T.StructField], window: int, k: int, bits: int) -> DataFrame:
    """The way of large benchmarks; ``items`` has item and text."""
    windows = settle(items.mapInArrow(_item_windows(window, k), f"{_WINDOWS}, print long, item string"))
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(windows.select("print"), bits))
    lengths = [r[0] for r in windows.select("length").distinct().collect()]  # at most ``window`` of them
    keyed = docs.withColumn("_key", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    asked = keyed.select(F.col("_key").alias("key"), text).mapInArrow(_doc_windows(marks, lengths, window, k), f"{_WINDOWS}, key binary, at int")
    found = settle(asked.join(windows.drop("print").distinct(), ["length", "one", "two"]).select("key", "at", "length", "item"))
    span = F.struct(F.col("at").cast("long").alias("start"), (F.col("at") + F.col("length")).cast("long").alias("end"))
    spans = found.groupBy("key").agg(F.collect_set(span).alias("spans")).mapInArrow(_merged, T.StructType([T.StructField("key", T.BinaryType()), _ADDED["hit_spans"]]))
    listed = found.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("hit_items"))
    names = [f.name for f in kept]
    counted = keyed.mapInArrow(_counted(text, [*names, "_key"]), T.StructType([*kept, T.StructField("_key", T.BinaryType()), _ADDED["n_words"]]))
    return counted.join(spans.join(listed, "key").withColumnRenamed("key", "_key"), "_key", "left").select(
        *names, "n_words", *(F.coalesce(c, F.array().cast(_ADDED[c].dataType)).alias(c) for c in ("hit_spans", "hit_items"))
    )


def _union(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [{"start": s, "end": e} for s, e in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(_SPAN)), T.StructField("hit_items", T.ArrayType(T.StringType()))])


def decontaminate(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS, bits: int = BITS, keep_text: bool = True
) -> DataFrame:
    """``docs`` with n_words, hit_spans (array of struct(start, end), in words), hit_items (sorted ids as strings)
    and contaminated. keep_text=False leaves the text out of the result, so that it never comes back from Python."""
    docs = spread(small_batches(docs.drop(*RESULTS)))
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if n + (size or 0) // 2 <= block_words:  # a word takes two bytes, but the last
        rows = items.collect()
        shared = docs.sparkSession.sparkContext.broadcast(Block([r[0] for r in rows], [r[1] for r in rows], window, k))
        marked = docs.mapInArrow(_marker(shared, text, [f.name for f in kept]), T.StructType([*kept, *_ADDED]))
    else:
        fits = 1 << max(10, (8 * size).bit_length())  # at least 16 bits a word
        marked = _by_shuffle(docs, items, text, kept, window, min(k, window), min(bits, fits))
    return marked.withColumn("contaminated", F.size("hit_spans") > 0)


def summary(marked: DataFrame) -> DataFrame:
    """The counts and the digest of a ``decontaminate`` result."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract by plain loops, for small tests."""
    import re

    def cut(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    out = []
    want = [(str(i), [w[j : j + min(window, len(w))] for j in range(max(1, len(w) - window + 1))]) for i, t in items if (w := cut(t))]
    for doc_id, t in docs:
        w = cut(t)
        hit, got = set(), set()
        for i, wins in want:
            for win in wins:
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        got.add(i)
        out.append((doc_id, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return out
