"""Operator 5: byte-level BPE encoding and decoding as a monoid tree reduction.

Each match of the split pattern is encoded by itself: its bytes are halved down to single bytes, whose tokens are known,
and neighbours are joined up the tree. A join re-encodes a window of tokens around the boundary by rank, doubled until
the tokens outside provably stay: a token sequence is the encoding of its bytes exactly if every two adjacent tokens are
the encoding of theirs, so it is enough that the window's outer tokens pass that test with the tokens beside it. Joins
are associative, so any tree gives the same ids. Decoding concatenates token bytes up a tree too.

The split pattern is run by the ``regex`` module, whose Unicode tables may be newer than the tokenizer library's, which
the ids have to equal; the letters and numbers that only ``regex`` knows are found once, by asking the library how it
splits, and masked while splitting. The library encodes nothing here.

Null and empty texts have no tokens. Repeated rows are encoded alike. Very long texts are split in runs of matches and
never cut off; a match without an end (a megabyte of one letter) is one tree, whose joins may re-encode all of it. An
empty table gives an empty result. Extra columns are kept (``keep`` names which); those named like results are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, spread

#: Pieces, pairs of tokens and subtrees that a worker remembers, of each so many; longer ones are encoded each time.
CACHED, CACHED_CHARS, CACHED_BYTES = 200_000, 64, 8
LONG_TEXT = 1 << 20
_MASK = "\ue000"  # private use: neither space nor letter nor number
RESULTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


@lru_cache(1)
def unknown_letters() -> str:
    """Characters that ``regex`` calls letters or numbers and the tokenizer library doesn't."""
    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    out: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}"):
        own = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        out |= set(regex.findall(kind, every)) - set(bytes(own.encode_ordinary(every)).decode())
    return "".join(sorted(out))


def concatenate(parts: Sequence[bytes]) -> bytes:
    """All parts in order, joined up a tree."""
    while len(parts) > 1:
        joined = [a + b for a, b in zip(parts[::2], parts[1::2])]
        parts = [*joined, parts[-1]] if len(parts) % 2 else joined
    return parts[0] if parts else b""


class _Pieces(dict):
    """Each piece's ids, the ids as text, and the bytes decoded from them; filled as pieces are asked for."""

    def __init__(self, own: Codec):
        self.own = own

    def __missing__(self, piece: str) -> tuple[list[int], str, bytes]:
        ids = self.own.encode_bytes(piece.encode())
        got = ids, ",".join(map(str, ids)), self.own.decode(ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = got
        return got


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, masked: str):
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack the bytes {missing}")
        self.ranks = ranks
        self.single = [[ranks[bytes([i])]] for i in range(256)]
        self.pattern = regex.compile(pattern)
        self.mask = dict.fromkeys(map(ord, masked), _MASK)
        self.masked = frozenset(masked)
        self.may_mask = re.compile(f"[{re.escape(min(masked))}-\U0010ffff]") if masked else None
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.parts: dict[bytes, list[int]] = {}
        self.known = _Pieces(self)

    def merge(self, data: bytes) -> list[int]:
        """A window's tokens: adjacent parts of least rank are merged, the leftmost first, until none is a token."""
        n, rank_of = len(data), self.ranks.get
        # A part is named by its start; ``end`` of a start is where the next part starts, ``before`` the part to its left.
        end, before = list(range(1, n + 2)), list(range(-1, n))
        queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank_of(data[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, middle, stop = heapq.heappop(queue)
            if end[i] != middle or end[middle] != stop:
                continue  # one of the two has been merged since
            end[i], end[middle], before[stop] = stop, -1, i
            left = before[i]
            if left >= 0 and (r := rank_of(data[left:stop])) is not None:
                heapq.heappush(queue, (r, left, i, stop))
            if stop < n and (r := rank_of(data[i : end[stop]])) is not None:
                heapq.heappush(queue, (r, i, stop, end[stop]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : end[i]]])
            i = end[i]
        return out

    def pair(self, left: int, right: int) -> list[int]:
        """The encoding of two tokens' bytes."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= CACHED:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right])
        return got

    def beside(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        return self.pair(left, right) == [left, right]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of a's and b's bytes."""
        k = 1
        while True:
            window = self.pair(a[-1], b[0]) if k == 1 else self.merge(self.decode(a[-k:] + b[:k]))
            left = k >= len(a) or self.beside(a[-k - 1], window[0])
            right = k >= len(b) or self.beside(window[-1], b[k])
            if left and right:
                return a[: max(0, len(a) - k)] + window + b[k:]
            k *= 2

    def encode_bytes(self, data: bytes) -> list[int]:
        n = len(data)
        if n == 1:
            return self.single[data[0]]
        if n > CACHED_BYTES:
            return self.join(self.encode_bytes(data[: n // 2]), self.encode_bytes(data[n // 2 :]))
        got = self.parts.get(data)
        if got is None:
            if len(self.parts) >= CACHED:
                self.parts.clear()
            got = self.parts[data] = self.join(self.encode_bytes(data[: n // 2]), self.encode_bytes(data[n // 2 :]))
        return got

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, in runs."""
        masked = None
        if self.may_mask and not text.isascii() and self.may_mask.search(text) and not self.masked.isdisjoint(text):
            masked = text.translate(self.mask)
        if masked is None and len(text) <= LONG_TEXT:
            yield self.pattern.findall(text)
            return
        spans = (m.span() for m in self.pattern.finditer(text if masked is None else masked))
        while run := [text[s:e] for s, e in itertools.islice(spans, 50_000)]:
            yield run

    def encode(self, text: str) -> list[int]:
        return [i for run in self.pieces(text) for piece in run for i in self.known[piece][0]]

    def decode(self, ids: Iterable[int]) -> bytes:
        return concatenate([self.bytes_of[i] for i in ids])

    def digests(self, text: str) -> tuple[int, str, str]:
        """(token count, SHA-256 of the ids, SHA-256 of the bytes decoded from them)."""
        n, coded, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for run in self.pieces(text):
            if not run:
                continue
            ids, coded_ids, bytes_of = zip(*map(self.known.__getitem__, run))
            coded.update((("," if n else "") + ",".join(coded_ids)).encode())
            decoded.update(concatenate(bytes_of))
            n += sum(map(len, ids))
        return n, coded.hexdigest(), decoded.hexdigest()


_codecs: dict[tuple, Codec] = {}


def codec(data: bytes, pattern: str, masked: str) -> Codec:
    key = (hash(data), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(read_ranks(data), pattern, masked)
    return _codecs[key]


def _shared(df: DataFrame, ranks_path: str, pattern: str):
    small_batches(df)
    with open(ranks_path, "rb") as f:  # the vocabulary, about 1 MB, goes to the tasks from here
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern, unknown_letters()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", ids: bool = True, digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ids array<int>, and/or n_tokens, ids_sha256 and decoded_sha256."""
    docs = spread(docs.drop(*(("ids",) if ids else ()), *(RESULTS if digests else ())))
    fields = [f for f in docs.schema.fields if keep is None or f.name in keep]
    names = [f.name for f in fields]
    shared = _shared(docs, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            texts = [x.as_py() or "" for x in column]
            if ids:
                arrays.append(pa.array([own.encode(t) for t in texts], pa.list_(pa.int32())))
            if digests:
                rows = [own.digests(t) for t in texts]
                arrays += [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *(["ids"] if ids else []), *(RESULTS if digests else ())])

    added = ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []) + ([T.StructField(RESULTS[0], T.LongType()), *(T.StructField(c, T.StringType()) for c in RESULTS[1:])] if digests else [])
    return docs.mapInArrow(run, T.StructType([*fields, *added]))


def decode(coded: DataFrame, ranks_path: str, pattern: str, *, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its ids (null ids: no bytes)."""
    shared = _shared(coded, ranks_path, pattern)

    @F.pandas_udf("binary")
    def bytes_of(column):
        own = codec(*shared.value)
        return column.map(lambda x: own.decode(x) if x is not None else b"")

    return coded.withColumn(to, bytes_of(F.col(ids)))
