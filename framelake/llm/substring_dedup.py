"""Operator 8: substring dedup with a log-structured fingerprint index.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it also starts in a document
with a smaller doc_id. Three steps:

1. Index. Documents come in batches of ascending doc_id. The fingerprints of a batch (winnowed K-gram hashes: every
   window holds one) are dealt to buckets by their leading bits, sorted, and merge-joined by bucket with the sorted
   immutable runs of earlier batches; what is new becomes the next run, and runs are compacted once FANOUT of them have
   gathered. A run keeps each hash once, with whether two documents share it. The index is a folder of runs and a
   manifest: it can be opened again later, and ``dedup_batch`` then takes a new batch without any work on the pairs of
   older documents (the older texts are read once to verify what is shared).
2. Verify. Shared fingerprints set bits of a bitmap of bounded size (it only prunes: a full one lets every window
   through). Windows whose fingerprint is marked are compared by 96-bit digests of their words: the least doc_id of each
   digest is found by bucket, after each task has settled what it can among its own documents. What a bucket settles
   leaves it as one row a window, so the rows grow with the windows removed and not with documents times buckets.
3. Remove. Only documents that lose words (a second bounded bitmap) are shuffled to meet their digests.

No group gathers documents: a fingerprint or window that a third of all documents share leaves each task once.

Null and empty texts have no words. Null doc_ids count as larger than all others, remove nothing, and are spread by
their texts over ids from NULL_FROM on, where no real id may be. Rows with equal doc_ids never remove each other's words.
Windows are taken for equal by 96 bits of keyed hashes; in a document of their own they are looked up by 64. Very long
texts are read in slices and never cut off. An empty table gives an empty result. Extra columns are kept; n_words,
n_removed and kept_text are replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpoint_dir, drop, folders_in, settle, small_batches, spread
from .words import byte_table, covered, grams, groups, sliding_least, whole, winnow

WINDOW, K = 13, 6
BATCHES, FANOUT = 3, 2
#: Fingerprints in a bucket, about; bits of the bitmap of shared fingerprints at most; bits of that of documents.
BUCKET, SHARED_BITS, DOC_BITS = 1 << 20, 1 << 28, 1 << 25
_TABLE = byte_table(words="nonspace", lower=False)
NULL_FROM, NULL_SPAN = (1 << 63) - (1 << 40), 1 << 40
_U = np.uint64
_PRINTS = "bucket int, hashes binary, ids binary, multi binary"
_RUN = "bucket int, hashes binary, multi binary"
#: Windows that a task compares at once before it sends them on, and the documents they come from, about.
CHUNK_WINDOWS, CHUNK_DOCS = 500_000, 60_000


def _least(h: np.ndarray, ids: np.ndarray, multi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash once, ascending, with its least id and whether it has two ids or was marked."""
    order = np.lexsort((ids, h))
    h, ids, multi = h[order], ids[order], multi[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    if not len(at):
        return h, ids, multi
    return h[at], ids[at], np.logical_or.reduceat(multi, at) | (np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at))


def _by_bucket(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets that occur, bounds in the sorted hashes)."""
    bucket = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    have, at = np.unique(bucket, return_index=True)
    return have, np.append(at, len(h))


def _prints(bits: int):
    """Rows (bucket, hashes, ids, multi): each fingerprint once a chunk."""

    def chunk(found: list, owner: list) -> pa.RecordBatch:
        h = np.concatenate(found)
        h, least, multi = _least(h, np.concatenate(owner).astype(np.int64), np.zeros(len(h), bool))
        have, at = _by_bucket(h, bits)
        cut = [slice(at[i], at[i + 1]) for i in range(len(have))]
        return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), *(pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (h, least, multi))], names=["bucket", "hashes", "ids", "multi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, owner, held = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a in groups(batch.column(1), _TABLE):
                g = grams(a.hash, K)
                at = winnow(g, a.doc, K, WINDOW - K + 1)
                found.append(g[at])
                owner.append(ids[a.first + a.doc[at]])
                held += len(at)
            if held >= CHUNK_WINDOWS:
                yield chunk(found, owner)
                found, owner, held = [], [], 0
        if held:
            yield chunk(found, owner)

    return run


def _joined_blobs(rows: pd.DataFrame, **kinds) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(b"".join(rows[c]), kind) for c, kind in kinds.items())


def _merge(bits: int, shared_bits: int):
    """Merge-joins a bucket's new fingerprints with its runs; gives the new run and the bucket's part of the bitmap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, ids, multi = _joined_blobs(pdf[pdf["run"] < 0], hashes=_U, ids=np.int64, multi=bool)
        new, least, shared = _least(hashes, ids, multi)
        known = np.zeros(len(new), bool)
        bucket = int(pdf["bucket"].iloc[0])
        for _, old in pdf[pdf["run"] >= 0].groupby("run"):
            h, marked = _joined_blobs(old, hashes=_U, multi=bool)
            if len(h) and len(new):
                at = np.minimum(np.searchsorted(h, new), len(h) - 1)
                hit = h[at] == new
                shared = shared | hit  # earlier batches hold smaller ids only
                known |= hit & marked[at]
        keep = ~known & (least < NULL_FROM)  # a hash already marked as shared needs no new entry
        width = shared_bits >> bits
        marks = np.zeros(width, np.uint8)
        marks[(new[shared] >> _U(64 - shared_bits.bit_length() + 1)).astype(np.int64) - bucket * width] = 1
        return pd.DataFrame({"bucket": [bucket], "hashes": [new[keep].tobytes()], "multi": [shared[keep].tobytes()], "marks": [np.packbits(marks).tobytes()]})

    return run


def _compact(pdf: pd.DataFrame) -> pd.DataFrame:
    h, multi = _joined_blobs(pdf, hashes=_U, multi=bool)
    h, _, multi = _least(h, np.zeros(len(h), np.int64), multi)
    return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "hashes": [h.tobytes()], "multi": [multi.tobytes()]})


class FingerprintIndex:
    """Sorted immutable runs in a shared folder, and a manifest that names them. Runs and manifests have names of their own;
    a run counts once a manifest names it, so work that was killed at any point is simply done again. One session writes to
    an index at a time."""

    def __init__(self, spark, folder: str, *, buckets: int, shared_bits: int, runs: list[str] = (), made: int = 0, last: int | None = None):
        self.spark, self.folder, self.runs, self.made, self.last = spark, folder, list(runs), made, last
        self.pending: tuple[list[str], int | None] | None = None
        self.bits = buckets.bit_length() - 1
        self.shared_bits = max(shared_bits, buckets * 8)

    @classmethod
    def for_size(cls, spark, folder: str, text_bytes: int) -> FingerprintIndex:
        """A new index laid out for about so many bytes of text; more make its buckets larger."""
        buckets = _power_of_two(text_bytes / 24 / BUCKET, 16, SHARED_BITS // 8)
        return cls(spark, folder, buckets=buckets, shared_bits=_power_of_two(text_bytes / 2, 1 << 16, SHARED_BITS))

    @classmethod
    def open(cls, spark, folder: str) -> FingerprintIndex:
        """The index that the folder's latest manifest describes."""
        state = max((json.loads(r.value) for r in spark.read.text(f"{folder}/manifest-*").collect()), key=lambda m: m["made"])
        for found in folders_in(spark, folder):  # what a killed session has left
            if found.rpartition("/")[2].startswith("run-") and found.rpartition("/")[2] not in {r.rpartition("/")[2] for r in state["runs"]}:
                drop(spark, found)
        return cls(spark, folder, **state)

    def add(self, docs: DataFrame, last: int | None = None, commit: bool = True) -> np.ndarray:
        """Merges a batch (columns id, text), whose ids must all be larger than those added before, the largest being
        ``last``. Gives the bitmap of its fingerprints that another of its documents or an earlier one has. Without
        ``commit`` the batch belongs to the index only after ``commit()``."""
        if len(self.runs) >= FANOUT:
            self.compact()
        new = docs.mapInArrow(_prints(self.bits), _PRINTS).withColumn("run", F.lit(-1))
        for i, path in enumerate(self.runs):
            new = new.union(self.spark.read.parquet(path).select("bucket", "hashes", F.lit(None).cast("binary").alias("ids"), "multi", F.lit(i).alias("run")))
        path = self._fresh()
        new.groupBy("bucket").applyInPandas(_merge(self.bits, self.shared_bits), f"{_RUN}, marks binary").write.parquet(path)
        width = self.shared_bits // 8 >> self.bits
        out = np.zeros(self.shared_bits // 8, np.uint8)
        for bucket, marks in self.spark.read.parquet(path).select("bucket", "marks").toLocalIterator():  # shared_bits / 8 bytes in all
            out[bucket * width : (bucket + 1) * width] |= np.frombuffer(marks, np.uint8)
        self.pending = ([*self.runs, path], last if last is not None else self.last)
        if commit:
            self.commit()
        return out

    def commit(self) -> None:
        """Names the batch that was added last in the manifest."""
        if self.pending:
            self._replace(*self.pending)
            self.pending = None

    def _fresh(self) -> str:
        return f"{self.folder}/run-{self.made}-{uuid.uuid4().hex}"

    def compact(self) -> None:
        """All runs become one."""
        path, old = self._fresh(), self.runs
        self.spark.read.parquet(*old).select("bucket", "hashes", "multi").groupBy("bucket").applyInPandas(_compact, _RUN).write.parquet(path)
        self._replace([path], self.last)
        for run in old:  # the manifest no longer names them
            drop(self.spark, run)

    def _replace(self, runs: list[str], last: int | None) -> None:
        self.runs, self.made, self.last = runs, self.made + 1, last
        state = {"buckets": 1 << self.bits, "shared_bits": self.shared_bits, "runs": self.runs, "made": self.made, "last": self.last}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.made}-{uuid.uuid4().hex}")


_ASKED = "bucket int, id long, one binary, two binary, ids binary, who binary"
_GONE = "id long, one long, many binary"


def _ask(bits: int, shared_bits: int, marks, low: int | None = None):
    """Windows whose fingerprint, the least of their K-grams, is marked, as rows (bucket, digests, documents), each digest once a chunk with its
    least id; and rows (id, digests) of what has a larger id than that, dealt to buckets below 0. Documents below ``low``
    are asked for what they hold only, not for what they lose."""
    shift = _U(64 - shared_bits.bit_length() + 1)

    def chunk(one: list, two: list, owner: list) -> Iterator[pa.RecordBatch]:
        x, y, who = (np.concatenate(v) for v in (one, two, owner))
        order = np.lexsort((who, y, x))
        x, y, who = x[order], y[order], who[order]
        head = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        least = who[head][np.cumsum(head) - 1]
        gone = (who > least) & (least < NULL_FROM)
        gone &= who >= low if low is not None else True
        ids, blobs = _by_id(x[gone], who[gone])
        if len(ids):
            none = [None] * len(ids)
            yield _rows(-1 - (ids % (1 << bits)), ids, blobs, none, none, none)
        x, y, who = x[head], y[head], who[head]
        have, at = _by_bucket(x, bits)
        cut = [slice(at[i], at[i + 1]) for i in range(len(have))]
        named = [np.unique(who[c], return_inverse=True) for c in cut]
        yield _rows(have, [None] * len(have), [x[c].tobytes() for c in cut], [y[c].tobytes() for c in cut], [n.tobytes() for n, _ in named], [i.astype(np.uint16 if len(n) <= 1 << 16 else np.uint32).tobytes() for n, i in named])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = marks.value
        one, two, owner, docs = [], [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in zip(groups(batch.column(1), _TABLE), groups(batch.column(1), _TABLE, 1)):
                place = (sliding_least(grams(a.hash, K), WINDOW - K + 1) >> shift).astype(np.int64)
                at = np.flatnonzero((bitmap[place >> 3] >> (7 - (place & 7)) & 1 == 1) & whole(a.doc, WINDOW))
                if not len(at):
                    continue
                if docs + a.n_docs > CHUNK_DOCS or sum(map(len, one)) + len(at) > CHUNK_WINDOWS:
                    if one:
                        yield from chunk(one, two, owner)
                    one, two, owner, docs = [], [], [], 0
                one.append(grams(a.hash, WINDOW)[at])
                two.append((grams(b.hash, WINDOW)[at] >> _U(32)).astype(np.uint32))
                owner.append(ids[a.first + a.doc[at]])
                docs += a.n_docs
        if one:
            yield from chunk(one, two, owner)

    return run


def _rows(buckets, ids, one, two, names, who) -> pa.RecordBatch:
    blobs = [pa.array(x, pa.binary()) for x in (one, two, names, who)]
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(ids, pa.int64()), *blobs], names=["bucket", "id", "one", "two", "ids", "who"])


def _by_id(x: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    order = np.argsort(who, kind="stable")
    x, who = x[order], who[order]
    ids, at = np.unique(who, return_index=True)
    at = np.append(at, len(who))
    return ids, [x[at[i] : at[i + 1]].tobytes() for i in range(len(ids))]


def _settle_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, digest) of each of a bucket's windows that a smaller id has too; what is settled already, many digests a
    row, passes through."""
    if pdf["bucket"].iloc[0] < 0:
        return pd.DataFrame({"id": pdf["id"], "one": None, "many": pdf["one"]})
    x, y = _joined_blobs(pdf, one=_U, two=np.uint32)
    who = np.concatenate([np.frombuffer(n, np.int64)[np.frombuffer(i, np.uint16 if len(n) <= 8 << 16 else np.uint32)] for n, i in zip(pdf["ids"], pdf["who"])])
    order = np.lexsort((who, y, x))
    x, y, who = x[order], y[order], who[order]
    head = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    least = who[head][np.cumsum(head) - 1]
    gone = np.flatnonzero((who > least) & (least < NULL_FROM))
    gone = gone[np.argsort(who[gone], kind="stable")]
    return pd.DataFrame({"id": who[gone], "one": x[gone].view(np.int64), "many": None})


def _strip(text: str, names: list[str], bitmap=None):
    """Drops the words that the row's digests cover (64 bits of each: they are only looked up in their own document).
    With a bitmap: keeps only the documents that lose nothing, which have no digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bitmap:
                batch = batch.filter(pa.array(~_marked(bitmap, batch)))
            lists = None if bitmap else [batch.column(batch.schema.get_field_index(c)) for c in ("_one", "_many")]
            n_words, n_removed, kept = [], [], []
            for a in groups(batch.column(batch.schema.get_field_index(text)), _TABLE):
                bounds = a.bounds()
                gone = np.zeros(len(a.hash), bool)
                for d in range(a.n_docs if lists is not None else 0):
                    one, many = (x[a.first + d] for x in lists)
                    if one.is_valid:  # both are lists, or both null
                        own = grams(a.hash[bounds[d] : bounds[d + 1]], WINDOW)
                        digests = np.concatenate((one.values.to_numpy().view(_U), np.frombuffer(b"".join(many.as_py()), _U)))
                        at = np.flatnonzero(np.isin(own, digests))
                        gone[bounds[d] : bounds[d + 1]] = covered(int(bounds[d + 1] - bounds[d]), at, WINDOW)
                n = np.diff(bounds)
                n_words.append(n)
                n_removed.append(n - np.bincount(a.doc[~gone], minlength=a.n_docs))
                kept += _joined(a, ~gone)
            counts = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (n_words, n_removed)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), *map(pa.array, counts), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept_text"]
            )

    return run


def _joined(a, keep: np.ndarray) -> list[bytes]:
    """Each document's kept words, joined by one space."""
    lo, hi = int(a.offs[0]), int(a.offs[-1])
    change = np.zeros(hi - lo + 1, np.int8)
    s, e, doc = a.start[keep] - lo, a.end[keep] - lo, a.doc[keep]
    change[s] += 1
    change[e] -= 1
    take = np.cumsum(change[:-1], dtype=np.int8) > 0
    data = a.data[lo:hi].copy()
    inner = e[:-1][doc[1:] == doc[:-1]]  # the byte after every kept word but a document's last
    data[inner] = 0x20
    take[inner] = True
    sizes = np.add.reduceat(np.append(take, False).astype(np.int64), np.append(a.offs[:-1] - lo, hi - lo))[:-1] if hi > lo else np.zeros(a.n_docs, np.int64)
    sizes = np.where(np.diff(a.offs) > 0, sizes, 0)
    flat, cut = data[take].tobytes(), np.concatenate(([0], np.cumsum(sizes)))
    return [flat[cut[i] : cut[i + 1]] for i in range(a.n_docs)]


def _power_of_two(n: float, least: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))))


def _named(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with _id, and (id, text) of them."""
    docs = spread(small_batches(docs).drop("n_words", "n_removed", "kept_text", "_id", "_one", "_many", "_place"))
    null_id = F.lit(NULL_FROM) + F.pmod(F.xxhash64(text), F.lit(NULL_SPAN))
    named = docs.withColumn("_id", F.coalesce(F.col(doc_id).cast("long"), null_id))
    return named, named.select(F.col("_id").alias("id"), F.col(text).alias("text"))


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_removed and kept_text (the kept words joined by one space).
    Builds an index of its own for the purpose."""
    spark = docs.sparkSession
    named, slim = _named(docs, doc_id, text)
    share = [F.percentile_approx("id", [(i + 1) / batches for i in range(batches - 1)], 1000)] if batches > 1 else []
    size, *cuts = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), *share).first()
    edges = sorted(set(cuts[0] or [])) if cuts else []
    folder = f"{checkpoint_dir(spark)}/substrings-{uuid.uuid4().hex}"
    index = FingerprintIndex.for_size(spark, f"{folder}/index", size)
    marks = np.zeros(index.shared_bits // 8, np.uint8)
    for low, high in zip([None, *edges], [*edges, None]):
        part = slim if low is None else slim.filter(F.col("id") > low)
        marks |= index.add(part if high is None else part.filter(F.col("id") <= high), high)
    drop(spark, index.folder)
    return _removed(named, slim, index, marks, folder, text, keep)


def dedup_batch(index: FingerprintIndex, docs: DataFrame, history: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The same for a batch of new documents, whose ids are all larger than those in the index: they lose what earlier
    documents of the batch or of ``history`` (all documents added before, with their texts) hold, and join the index.
    Null ids lose words as ever but are not remembered.

    The result is settled before the manifest names the batch: a session that dies on the way leaves the index as it was,
    and the batch can be given again. Verifying reads the texts of ``history`` once (windows whose fingerprint isn't shared
    are passed over; their digests aren't stored, which would take several times the texts' size)."""
    spark = docs.sparkSession
    named, slim = _named(docs, doc_id, text)
    low, high = slim.filter(F.col("id") < NULL_FROM).agg(F.min("id"), F.max("id")).first()
    if low is not None and index.last is not None and low <= index.last:
        raise ValueError(f"doc_id {low} isn't larger than {index.last}, which the index holds")
    low = NULL_FROM if low is None else low
    marks = index.add(slim, high, commit=False)
    asked = slim
    if history is not None:
        asked = slim.unionByName(_named(history.filter(F.col(doc_id) < low), doc_id, text)[1])
    done = settle(_removed(named, asked, index, marks, f"{checkpoint_dir(spark)}/substrings-{uuid.uuid4().hex}", text, keep, low))
    index.commit()
    return done


def _removed(named: DataFrame, asked: DataFrame, index: FingerprintIndex, marked_prints: np.ndarray, folder: str, text: str, keep: list[str] | None, low: int | None = None) -> DataFrame:
    """Verifies the windows whose fingerprint is marked among the documents ``asked``, and strips ``named``."""
    spark = named.sparkSession
    docs = named.drop("_id")
    marks = spark.sparkContext.broadcast(marked_prints)  # at most SHARED_BITS / 8 bytes
    windows = asked.mapInArrow(_ask(index.bits, index.shared_bits, marks, low), _ASKED)
    settled = windows.groupBy("bucket").applyInPandas(_settle_bucket, _GONE)
    (settled if low is None else settled.filter(F.col("id") >= low)).write.parquet(f"{folder}/gone")
    gone = spark.read.parquet(f"{folder}/gone")
    place = F.pmod(F.xxhash64("id"), F.lit(DOC_BITS))
    words = gone.select("id").distinct().groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {DOC_BITS}) % 64 AS int))")).alias("b"))
    losing = np.zeros(DOC_BITS // 64, np.int64)
    for w, b in words.toLocalIterator():  # at most DOC_BITS / 64 rows
        losing[w] = b
    bitmap = spark.sparkContext.broadcast(losing)
    fields = [f for f in docs.schema.fields if keep is None or f.name in keep]
    names = [f.name for f in fields]
    lean = named.select(*names, *([] if text in names else [text]), "_id").withColumn("_place", F.pmod(F.xxhash64("_id"), F.lit(DOC_BITS)))
    losing_docs = lean.mapInArrow(_pick(bitmap), lean.schema).drop("_place")
    lists = gone.groupBy(F.col("id").alias("_id")).agg(F.collect_list("one").alias("_one"), F.collect_list("many").alias("_many"))
    out = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    changed = losing_docs.join(lists, "_id", "left").mapInArrow(_strip(text, names), out)
    return changed.union(lean.mapInArrow(_strip(text, names, bitmap), out))


def _marked(bitmap, batch: pa.RecordBatch) -> np.ndarray:
    at = batch.column(batch.schema.get_field_index("_place")).to_numpy(zero_copy_only=False)
    return (bitmap.value[at >> 6] >> (at & 63)) & 1 == 1


def _pick(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(bitmap, batch)))

    return run


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract by plain loops: (doc_id, n_words, n_removed, kept text)."""
    import re

    cut = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in docs}
    first: dict[tuple, int] = {}
    for d, w in cut.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in cut.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out
