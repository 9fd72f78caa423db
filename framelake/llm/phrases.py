"""Phrase collocation mining over depth-truncated suffix subtrees, partitioned vertically by word prefixes.

A suffix starts at every word and ends with its piece or after ``longest`` words. The tree of all suffixes is never
built whole:

1. Words, then pairs of frequent words, then triples of frequent pairs are counted by hashes of them with their
   language. Bitmaps of the frequent ones (of bounded size, they only prune) tell where a suffix can be cut: a phrase is
   frequent only if its words, pairs and triples are.
2. Equal cut suffixes, of one word or more, become one leaf with a total.
3. Prefixes of leaves are counted word by word: one that holds more leaves than a group may is extended by its next
   word. Prefixes are dealt into groups of at most about ``budget`` leaves, and each group builds its subtrees alone:
   leaves are sorted, a node is a run of leaves with equal first words, its count is the sum of their totals.
4. Counts of nodes above an extended prefix are added over groups.

Words are identified by their text from the leaves on; hashes only prune and tell equal suffixes of one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bitmap, join_back, marked, settle, small_batches, spread
from .words import Words, byte_table, factors, grams, groups, mix

#: Bytes that part pieces, and bytes that part words within a piece.
STOPS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
#: Most bits of a bitmap.
MOST_BITS = 1 << 28
#: Groups that subtrees are dealt to, at least.
LEAST_GROUPS = 256
#: Keys that a task counts before it hands them on, and bytes of text for a bucket of counts.
AT_ONCE, BUCKET_BYTES = 4_000_000, 8 << 20


def _table() -> np.ndarray:
    kept = byte_table(words="nonspace", lower=True)
    kept[list(STOPS + BLANKS)] = 0
    return kept


def _passages(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, np.ndarray, list[str]]]:
    """For groups of documents of (text, lang): their words, a key of each word with its language, whether the next word is
    in the same piece, and the language of each document."""
    is_stop = np.isin(np.arange(256), list(STOPS))
    langs = batch.column(1).to_pylist()
    salt = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    salts = np.array([salt[x] for x in langs], np.uint64)
    for w in groups(batch.column(0), _table()):
        if not len(w.start):
            continue
        first = int(w.offs[0])
        piece = np.cumsum(is_stop[w.data[first : int(w.offs[-1])]])[w.start - first]
        same = np.zeros(len(w.start), bool)
        same[:-1] = (w.doc[1:] == w.doc[:-1]) & (piece[1:] == piece[:-1])
        yield w, mix(w.hash + salts[w.first + w.doc]), same, langs


def _words_at(w: Words, at: np.ndarray) -> list[str]:
    data = w.data
    return [data[s:e].tobytes().lower().decode() for s, e in zip(w.start[at].tolist(), w.end[at].tolist())]


def _bits(count: int) -> int:
    return min(MOST_BITS, 1 << max(10, (16 * count - 1).bit_length()))


_BLOBS = "bucket int, keys binary, counts binary, lang string, n long"


class _Tally:
    """A task's counts of 64-bit keys, handed on as blobs by bucket: the ``top`` leading bits of a key are its bucket, the
    next 32 are kept (keys that agree in both count as one, which only prunes less). Counts stop at ``least``."""

    def __init__(self, top: int, least: int):
        self.top, self.least, self.keys, self.counts, self.held = top, least, [], [], 0
        self.kind = np.uint8 if least < 256 else np.uint32

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys >> np.uint64(32 - self.top))
        self.counts.append(np.ones(len(keys), np.int64))
        self.held += len(keys)
        if self.held > AT_ONCE:
            self._merge()
            if self.held > AT_ONCE // 2:
                yield from self.flush()

    def _merge(self) -> None:
        keys, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        self.counts = [np.bincount(where, np.concatenate(self.counts), len(keys)).astype(np.int64)]
        self.keys, self.held = [keys], len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        self._merge()
        keys, counts = self.keys[0], np.minimum(self.counts[0], self.least).astype(self.kind)
        have, at = np.unique((keys >> np.uint64(32)).astype(np.int64), return_index=True)
        cuts = [slice(i, j) for i, j in zip(at, [*at[1:], len(keys)])]
        low = keys.astype("<u4")
        none = [None] * len(have)
        yield _blobs(have, [low[c].tobytes() for c in cuts], [counts[c].tobytes() for c in cuts], none, none)
        self.keys, self.counts, self.held = [], [], 0


def _blobs(*columns) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["bucket", "keys", "counts", "lang", "n"])


def _frequent(rows: DataFrame, top: int, least: int) -> DataFrame:
    """(key, lang, n) of blobs: the keys that reach ``least`` in all, and the sums of languages."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:
            sums = pdf.groupby("lang")["n"].sum()
            return pd.DataFrame({"key": [None] * len(sums), "lang": sums.index, "n": sums.to_numpy()})
        keys, where = np.unique(np.frombuffer(b"".join(pdf["keys"]), "<u4"), return_inverse=True)
        counts = np.bincount(where, np.frombuffer(b"".join(pdf["counts"]), kind), len(keys))
        found = (np.uint64(bucket << 32) | keys[counts >= least].astype(np.uint64)) << np.uint64(32 - top)
        return pd.DataFrame({"key": found.view(np.int64), "lang": None, "n": None})

    return rows.groupBy("bucket").applyInPandas(run, "key long, lang string, n long")


def count_words(docs: DataFrame, top: int, least: int) -> DataFrame:
    """(key, lang, n): keys of words that occur ``least`` times in a language, and how many words each language has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, langs_seen = _Tally(top, least), {}
        for batch in batches:
            for w, key, _, langs in _passages(batch):
                yield from tally.add(key)
                for x, n in zip(langs[w.first : w.first + w.n_docs], np.bincount(w.doc, minlength=w.n_docs).tolist()):
                    langs_seen[x] = langs_seen.get(x, 0) + n
            if len(langs_seen) > 100_000:
                yield _lang_rows(langs_seen)
                langs_seen = {}
        yield from tally.flush()
        if langs_seen:
            yield _lang_rows(langs_seen)

    return _frequent(docs.mapInArrow(run, _BLOBS), top, least)


def _lang_rows(seen: dict[str, int]) -> pa.RecordBatch:
    spread_to = [-1 - hashlib.blake2b(x.encode(), digest_size=1).digest()[0] for x in seen]
    none = [None] * len(seen)
    return _blobs(spread_to, none, none, list(seen), list(seen.values()))


def _chains(key: np.ndarray, same: np.ndarray, marks: list) -> list[np.ndarray]:
    """For each run of 1, 2, ... words, whether it lies in a piece and is marked, as are all its parts."""
    ok = [marked(marks[0].value, key)]
    for k, m in enumerate(marks[1:], 2):
        n = len(key) - k + 1
        now = np.zeros(len(key), bool)
        if n > 0:
            now[:n] = ok[-1][:n] & ok[-1][1 : n + 1]
            if k == 2:
                now[:n] &= same[:n]
            now[:n] &= marked(m.value, grams(key, k))
        ok.append(now)
    return ok


def count_runs(docs: DataFrame, marks: list, top: int, least: int) -> DataFrame:
    """(key, ...): keys of runs of one word more than the last of ``marks`` that occur ``least`` times, of marked parts."""
    k = len(marks) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(top, least)
        for batch in batches:
            for _, key, same, _ in _passages(batch):
                n = len(key) - k + 1
                if n > 0:
                    ok = _chains(key, same, marks)[-1]
                    parts = ok[:n] & ok[1 : n + 1]
                    yield from tally.add(grams(key, k)[parts & same[:n] if k == 2 else parts])
        yield from tally.flush()

    return _frequent(docs.mapInArrow(run, _BLOBS), top, least)


def leaves(docs: DataFrame, marks: list, longest: int) -> DataFrame:
    """(lang, path, n): suffixes that begin with a marked word, cut where a word, pair or triple isn't marked, with their
    totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = factors(longest)
        for batch in batches:
            for w, key, same, langs in _passages(batch):
                ok = _chains(key, same, marks)
                at = np.flatnonzero(ok[0])
                if not len(at):
                    continue
                depth, path, still = np.ones(len(at), np.int64), key[at] * by[0], np.ones(len(at), bool)
                for j in range(1, longest):
                    k = min(j + 1, len(ok))  # the last run of up to as many words as are marked ends with word j
                    still = still & ok[k - 1][np.minimum(at + j + 1 - k, len(key) - 1)]
                    depth += still
                    path = path + np.where(still, key[np.minimum(at + j, len(key) - 1)] * by[j], np.uint64(0))
                _, first, n = np.unique(mix(path), return_index=True, return_counts=True)
                at, depth = at[first], depth[first]
                need = np.unique(np.concatenate([at + j for j in range(longest)]).clip(max=len(key) - 1))
                texts = dict(zip(need.tolist(), _words_at(w, need)))
                paths = [" ".join([texts[j] for j in range(a, a + d)]) for a, d in zip(at.tolist(), depth.tolist())]
                lang = [langs[w.first + d] for d in w.doc[at]]
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(paths, pa.string()), pa.array(n.astype(np.int64))], names=["lang", "path", "n"])

    return docs.mapInArrow(run, "lang string, path string, n long").groupBy("lang", "path").agg(F.sum("n").alias("n"))


def grouped(tree: DataFrame, longest: int, budget: int) -> DataFrame:
    """``tree`` (settled leaves) with depth, the words of its prefix, and group; a prefix of more leaves than a group may
    hold is extended, so that at most as many prefixes as there are groups are broadcast at each depth."""
    total = tree.count()
    n_groups = max(LEAST_GROUPS, -(-total // budget))
    out = tree.withColumn("depth", F.lit(1))
    for k in range(1, longest):
        prefix = F.substring_index("path", " ", k)
        own = out.filter(F.col("depth") == k).select("lang", prefix.alias("p"))
        heavy = settle(own.groupBy("lang", "p").count().filter(F.col("count") * n_groups > total).select("lang", "p", F.lit(True).alias("more")))
        if heavy.isEmpty():
            break
        out = out.withColumn("p", F.when(F.col("depth") == k, prefix)).join(F.broadcast(heavy), ["lang", "p"], "left")  # fewer than n_groups rows
        out = out.withColumn("depth", F.when(F.col("more"), k + 1).otherwise(F.col("depth"))).drop("p", "more")
    key = F.expr("substring_index(path, ' ', depth)")
    return out.withColumn("group", F.pmod(F.xxhash64("lang", key), F.lit(n_groups)))


def subtrees(pdf: pd.DataFrame, least: int, longest: int) -> pd.DataFrame:
    """(lang, phrase, n) of the nodes of a group's subtrees; complete nodes under ``least`` are left out."""
    words = [[lang, *path.split(" ")] for lang, path in zip(pdf["lang"], pdf["path"])]
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[i] for i in order]
    total, prefix = pdf["n"].to_numpy()[order], pdf["depth"].to_numpy()[order]
    size = np.array([len(x) - 1 for x in words])
    # How many first words (after the language's) each leaf shares with the one before it; -1 for another language.
    shared = np.full(len(words), -1)
    for i in range(1, len(words)):
        a, b, j = words[i - 1], words[i], 0
        while j < len(a) and j < len(b) and a[j] == b[j]:
            j += 1
        shared[i] = j - 1
    out = []
    for depth in range(1, longest + 1):
        starts = np.flatnonzero(shared < depth)  # a run of leaves that agree to this depth begins
        sums = np.add.reduceat(total, starts)
        for i in np.flatnonzero((size[starts] >= depth) & ((sums >= least) | (prefix[starts] > depth))):
            node = words[starts[i]]
            out.append((node[0], " ".join(node[1 : depth + 1]), int(sums[i])))
    return pd.DataFrame(out, columns=["lang", "phrase", "n"])


def frequencies(docs: DataFrame, least: int = 100, longest: int = 5, budget: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all words and phrases of up to ``longest`` words that occur ``least`` times, and (lang, n) of all
    words, of documents given as (text, lang). Both are settled."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    top = max(8, (size // BUCKET_BYTES).bit_length())
    counted, totals, marks = None, None, []
    for k in range(1, min(3, longest) + 1):
        counted = settle(count_words(docs, top, least) if k == 1 else count_runs(docs, marks, top, least))
        totals = counted.filter("lang IS NOT NULL").select("lang", "n") if k == 1 else totals
        keys = counted.filter("key IS NOT NULL").select("key")
        marks.append(spark.sparkContext.broadcast(bitmap(keys, _bits(keys.count()))))  # at most MOST_BITS each
    tree = settle(leaves(docs, marks, longest))
    nodes = grouped(tree, longest, budget).groupBy("group").applyInPandas(lambda pdf: subtrees(pdf, least, longest), "lang string, phrase string, n long")
    nodes = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return settle(nodes), totals


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, budget: int = 100_000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language by their least cut: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), parted at ``.,;:!?`` and line ends into pieces and at blanks into words. a counts the
    phrase's occurrences (overlaps included), l and r those of its parts at the cut with the least
    ``floor(1000 a n / (l r))`` (ties: the first cut), n all words of the language. A phrase within a longer one that has at
    least ``percent`` of its occurrences is left out. All arithmetic is exact. ``budget``: leaves of a group.

    Defined results: null texts are empty, a null language is ``und``; ties in score and a are broken by the phrase's bytes;
    repeated rows count each time; texts of any length are read whole; other columns are not read; an empty table, or one
    without frequent phrases, gives an empty result.
    """
    docs = spread(small_batches(docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))))
    found, totals = frequencies(docs, least, longest, budget)
    phrases = found.filter(F.col("phrase").contains(" ")).withColumn("words", F.split("phrase", " ", -1))
    # Parts of every cut: each phrase's beginnings and the ends that follow them.
    size, joined = F.size("words"), (lambda at, n: F.array_join(F.slice("words", at, n), " "))
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = settle(cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, size - F.col("k")).alias("rest")))

    def with_counts(rows: DataFrame, part: str, name: str) -> DataFrame:
        wanted = rows.groupBy("lang", part).agg(F.count("*").alias("_copies"))
        counts = settle(wanted.join(found.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part]))
        return join_back(rows, counts, ["lang", part], "_copies", how="inner")

    cuts = with_counts(with_counts(cuts, "first", "l"), "rest", "r")
    per_lang = settle(cuts.groupBy("lang").agg(F.count("*").alias("_copies")).join(totals, "lang"))
    cuts = join_back(cuts, per_lang, ["lang"], "_copies", how="inner")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("score", F.expr("1000BD * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    # Phrases within longer ones: the most that any longer one has.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: F.array_join(F.slice("words", at, m), " "))))
    inner = phrases.filter(size > 2).select("lang", "n", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * wide("longer") < percent * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)  # a partial limit runs before the shuffle
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
