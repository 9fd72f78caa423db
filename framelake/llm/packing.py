"""Packing of token sequences: bounded-space best fit by partition, then left-overs merged up a tree.

A task encodes its documents and keeps ``windows`` open sequences. A document goes to the open window that it fills
best; where it fits none, a new one is opened, or, if all are open, the fullest is filled up with the document's head
and emitted, and the rest goes on. So emitted sequences are full, and a task leaves at most ``windows`` open ones,
whatever it reads. Those meet in groups of FAN tasks, round by round; each group fills sequences one after another and
leaves one. The very last one is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from .shared import settle, small_batches, spread

#: Tasks whose left-overs meet in one group.
FAN = 16
#: Words that a worker remembers, and the longest of them in bytes.
MOST_WORDS, LONGEST_WORD = 800_000, 64
#: Bytes of texts that are taken apart at once, and words that are encoded at once.
SLICE, AT_ONCE = 1 << 20, 4096

_SPACE = re.compile(rb"[ \t-\r]")
#: How the tokenizer parts lower-case ASCII words, and how it marks a piece's last token: fixed values of its file.
_PIECE, END = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"), "</w>"
#: A lower-cased word of letters that no normalising changes (Latin, Cyrillic), and what ASCII marks follow: a piece each.
_PARTED = re.compile(r"^(?:([a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľłńņňōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžа-я]++)([!-/:-@\[-`{-~]*+)|.+)$", re.M)
RESULT = ["start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Encoder:
    """Ids of whole texts by a tokenizer file whose normalising and splitting never reach across ASCII white space (words
    have their own ends), so that words can be encoded one by one and remembered, as bytes."""

    def __init__(self, path: str, special_as_text: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = self.special_as_text = special_as_text
        # Tokens that end a piece of a word; where words lie in a text of many is told by counting them.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _joined(self, texts: list[str], pieces: list[int]) -> list[bytes] | None:
        """Many texts encoded as one, each of so many pieces at least; None if there are more."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        at, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(pieces)
        if len(at) != last[-1]:  # every piece has one end at least, so equal sums are equal throughout
            return None
        data, ends = ids.tobytes(), (4 * at[last - 1]).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd(self, words: list[str]) -> list[bytes]:
        """Those whose pieces can't be told beforehand are encoded each alone."""
        pieces = [1 if w.isalpha() else len(_PIECE.findall(w.lower())) if w.isascii() else 0 for w in words]
        if not self.special_as_text:
            pieces = [0 if "<|" in w else k for w, k in zip(words, pieces)]
        many, alone = [w for w, k in zip(words, pieces) if k], [w for w, k in zip(words, pieces) if not k]
        got = self._joined(many, [k for k in pieces if k]) if many else []
        if got is None:
            return self._alone(words)
        out = dict(zip([*many, *alone], [*got, *self._alone(alone)]))
        return [out[w] for w in words]

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Many words are encoded as one text. Most are letters and a mark or two, whose ids follow each other; letters
        recur with other marks and in capitals, so parts are remembered too."""
        text = b"\n".join(words).decode()
        parted = _PARTED.findall(text.lower())
        need = list({p for pair in parted for p in pair}.difference(self.parts, ("",)))
        if need:
            self.parts.update(zip(need, self._joined(need, [1] * len(need)) or self._alone(need)))
        out = {w: self.parts[a] + self.parts[b] if b else self.parts[a] for w, (a, b) in zip(words, parted) if a}
        if len(out) < len(words):
            odd = [(w, x) for w, x, (a, _) in zip(words, text.split("\n"), parted) if not a]
            out.update(zip([w for w, _ in odd], self._odd([x for _, x in odd])))
        for p in need:
            if len(p) > LONGEST_WORD:
                del self.parts[p]
        return out

    def _ids(self, lists: list[list[bytes]]) -> list[bytes]:
        """The ids of each list of words."""
        found = [list(map(self.known.get, x)) for x in lists]
        gaps = [(x, y, [i for i, ids in enumerate(y) if ids is None]) for x, y in zip(lists, found) if None in y]
        new, fresh = list({x[i] for x, _, at in gaps for i in at}), {}
        if max(len(self.known), len(self.parts)) + len(new) > MOST_WORDS:
            self.known, self.parts = {}, {}
        for i in range(0, len(new), AT_ONCE):
            fresh.update(self._fresh(new[i : i + AT_ONCE]))
        for x, y, at in gaps:
            for i in at:
                y[i] = fresh[x[i]]
        self.known.update((w, ids) for w, ids in fresh.items() if len(w) <= LONGEST_WORD)
        return [b"".join(y) for y in found]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        lists, size = [], 0
        for text in map(str.encode, texts):
            if len(text) > SLICE:
                yield from (np.frombuffer(x, "<u4") for x in self._ids(lists))
                yield np.frombuffer(b"".join(self._ids([x])[0] for x in self._slices(text)), "<u4")
                lists, size = [], 0
                continue
            lists.append(text.split())  # of bytes: at ASCII white space only
            size += len(text)
            if size > SLICE:
                yield from (np.frombuffer(x, "<u4") for x in self._ids(lists))
                lists, size = [], 0
        yield from (np.frombuffer(x, "<u4") for x in self._ids(lists))

    def _slices(self, text: bytes) -> Iterator[list[bytes]]:
        at = 0
        while at < len(text):
            space = _SPACE.search(text, at + SLICE)
            upto = space.start() if space else len(text)
            yield text[at:upto].split()
            at = upto


@lru_cache(2)
def encoder(path: str, special_as_text: bool) -> Encoder:
    """One for each worker, with what it remembers."""
    return Encoder(path, special_as_text)


class Packer:
    """Places token arrays; a piece is (row, start, ids, number of the document's tokens)."""

    def __init__(self, size: int, windows: int, first_id: int) -> None:
        self.size, self.windows, self.next_id = size, windows, first_id
        self.open: list[list] = []  # [free, id, pieces]
        self.done: list[tuple] = []  # (piece, sequence, offset, open)

    def _new(self) -> list:
        self.next_id += 1
        return [self.size, self.next_id - 1, []]

    def _put(self, window: list, piece: tuple) -> None:
        window[0] -= len(piece[2])
        window[2].append(piece)

    def emit(self, window: list, still_open: bool = False) -> None:
        at = 0
        for piece in window[2]:
            self.done.append((piece, window[1], at, still_open))
            at += len(piece[2])
        if window in self.open:
            self.open.remove(window)

    def place(self, row: tuple, start: int, ids: np.ndarray, total: int) -> None:
        at = 0
        while at < len(ids):
            rest = len(ids) - at
            if rest >= self.size:  # a full sequence of its own
                window = self._new()
                take = self.size
            else:
                fits = [w for w in self.open if w[0] >= rest]
                if fits:
                    window, take = min(fits, key=lambda w: w[0]), rest
                elif len(self.open) < self.windows:
                    window, take = self._new(), rest
                    self.open.append(window)
                else:
                    window = min(self.open, key=lambda w: w[0])
                    take = window[0]
            self._put(window, (row, start + at, ids[at : at + take], total))
            at += take
            if not window[0]:
                self.emit(window)

    def finish(self) -> None:
        """Cuts what is open into sequences of powers of two."""
        for window in list(self.open):
            pieces, at = window[2], 0
            left = self.size - window[0]
            self.open.remove(window)
            for bit in reversed(range(left.bit_length())):
                if left >> bit & 1:
                    small, room = self._new(), 1 << bit
                    while room:
                        row, start, ids, total = pieces[0]
                        take = min(room, len(ids) - at)
                        small[2].append((row, start + at, ids[at : at + take], total))
                        room, at = room - take, at + take
                        if at == len(ids):
                            pieces, at = pieces[1:], 0
                    self.emit(small)


def _rows(done: list[tuple], schema: pa.Schema, keep_ids: bool) -> pa.RecordBatch:
    """The result's rows; open pieces always carry their ids."""
    columns: list[list] = [[] for _ in schema]
    for (row, start, ids, total), sequence, at, still_open in done:
        data = ids.astype("<u4").tobytes()
        for out, x in zip(columns, (*row, start, len(ids), data if keep_ids or still_open else None, zlib.crc32(data), total, sequence, at, still_open)):
            out.append(x)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def pack(
    docs: DataFrame, path: str, size: int = 4096, end: int | None = 2, windows: int = 16, ids: bool = True, keep: list[str] | None = None,
    text: str = "text", special_as_text: bool = False,
) -> DataFrame:
    """Packs every document's ids (and ``end`` after them, unless None) into sequences of at most ``size`` tokens; a row for
    each piece: the columns ``keep`` (default: doc_id), then start (the document's tokens before the piece), length, ids (if
    ``ids``: little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset (in the sequence). Every sequence
    is full, but at most 12 whose lengths are different powers of two: nothing is padded.

    ``path`` names a file of the tokenizers library whose words have ends; ``special_as_text`` reads its special tokens'
    strings as ordinary text. Sequence ids are unique, not gapless. Defined results: a null or empty text has only ``end``
    (no row without it); texts of any length are encoded whole (a run without ASCII white space at once); repeated rows
    are packed each; other columns, whatever their names, are dropped; an empty table gives an empty result. A kept
    column may not have the name of a result's column (ValueError).
    """
    keep = ["doc_id"] if keep is None else keep
    if clash := set(keep) & {*RESULT, "_open", "_group"}:
        raise ValueError(f"kept columns named like the result's: {sorted(clash)}")
    long, flag = (lambda name: StructField(name, LongType())), StructField("_open", BooleanType())
    out = StructType([*(docs.schema[c] for c in keep), long("start"), long("length"), StructField("ids", BinaryType()), *map(long, RESULT[3:]), flag])

    def schema_of(kept: pa.Schema) -> pa.Schema:
        rest = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), *((c, pa.int64()) for c in RESULT[3:]), ("_open", pa.bool_())]
        return pa.schema([*(kept.field(c) for c in keep), *(pa.field(*x) for x in rest)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, windows, TaskContext.get().partitionId() << 32)
        tail = np.array([] if end is None else [end], np.uint32)
        for batch in batches:
            schema = schema_of(batch.schema)
            kept = zip(*(batch.column(c).to_pylist() for c in keep)) if keep else (() for _ in range(batch.num_rows))
            texts = [x or "" for x in batch.column(len(keep)).to_pylist()]
            for row, x in zip(kept, encoder(path, special_as_text).encode(texts)):
                got = np.concatenate((x, tail))
                packer.place(row, 0, got, len(got))
            if packer.done:
                yield _rows(packer.done, schema, ids)
                packer.done = []
        for window in list(packer.open):
            packer.emit(window, still_open=True)
        if packer.done:
            yield _rows(packer.done, schema, ids)

    def merge(level: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            packer = Packer(size, 1, level << 56 | table["_group"][0].as_py() << 32)
            rows = table.drop_columns(["_group"]).sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            schema = schema_of(rows.schema)
            kept = zip(*(rows[c].to_pylist() for c in keep)) if keep else (() for _ in range(rows.num_rows))
            for row, start, data, total in zip(kept, *(rows[c].to_pylist() for c in ("start", "ids", "doc_tokens"))):
                data = np.frombuffer(data, "<u4")
                at = 0
                while at < len(data):  # sequences are filled one after another
                    room = packer.open[0][0] if packer.open else size
                    packer.place(row, start + at, data[at : at + room], total)
                    at += room
            if last:
                packer.finish()
            for window in list(packer.open):
                packer.emit(window, still_open=True)
            return pa.Table.from_batches([_rows(packer.done, schema, ids)])

        return run

    first = spread(small_batches(docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias("_text"))))
    pieces = settle(first.mapInArrow(place, out))
    done = pieces.filter("NOT _open")
    tasks, level = (pieces.filter("_open").agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0) + 1, 0
    left = pieces.filter("_open")
    while level == 0 or tasks > 1:
        level, tasks = level + 1, -(-tasks // FAN)
        task = F.shiftright("sequence_id", 32).bitwiseAND((1 << 24) - 1)
        merged = left.withColumn("_group", F.floor(task / FAN).cast("long")).groupBy("_group").applyInArrow(merge(level, tasks == 1), out)
        merged = settle(merged)
        done, left = done.unionByName(merged.filter("NOT _open")), merged.filter("_open")
    return done.select(*(F.col(f"`{c}`") for c in keep), *(c for c in RESULT if ids or c != "ids"))
