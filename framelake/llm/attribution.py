"""Operator 3: token counts by offset-mapped attribution.

A document is encoded once, whole. Token byte lengths give every token's character span (a token inside a character
counts as that whole character), and the spans are interval-joined with the document's sections, both in order, by
binary search. A token that crosses a border is allocated by an explicit rule:

* ``first``: to the section that holds its first character (the default);
* ``last``: to the section that holds its last character;
* ``split``: to every section it touches, by the share of its characters there.

Sections are given as a column array<struct<start, end>> in code points (they may overlap and leave gaps), or are the
pieces that end after each match of a separator pattern (lines by default; the empty text is one empty section).

Null texts are empty texts. Null section arrays give no rows; null or inverted bounds are empty sections. Repeated rows
are counted alike. Very long texts are encoded whole. An empty table gives an empty result. Extra columns listed in
``keep`` (all but the text and the sections by default) are kept; those named like results (section, start, end, n_tokens,
n_crossing) are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import CACHED_CHARS, Codec, _shared, codec
from .shared import spread

RULES = ("first", "last", "split")
#: Pieces that a worker remembers, twice as many at most, and characters of texts that are attributed at once.
REMEMBERED, AT_ONCE = 200_000, 1 << 18
_OUT = [("section", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())]


class _Lengths(dict):
    """The byte lengths of each piece's tokens, as bytes of 32-bit numbers; filled as pieces are asked for. Where too many
    are remembered, those not asked for since the last time go."""

    def __init__(self, own: Codec):
        self.own, self.size, self.older = own, list(map(len, own.bytes_of)), {}

    def __missing__(self, piece: str) -> bytes:
        got = self.older.get(piece)
        if got is None:
            got = array("I", map(self.size.__getitem__, self.own.encode_bytes(piece.encode()))).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = got
        return got


@lru_cache(1)
def lengths(own: Codec) -> _Lengths:
    """One for each worker, with what it remembers."""
    return _Lengths(own)


def token_spans(known: _Lengths, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Character spans of the tokens of many texts as if these were one, then each text's first token and first character
    (and where the last one ends)."""
    coded = [b"".join([b"".join(map(known.__getitem__, run)) for run in known.own.pieces(text)]) for text in texts]
    first = np.cumsum([0, *(len(x) >> 2 for x in coded)])
    size = np.frombuffer(b"".join(coded), np.uint32).astype(np.int64)
    whole = "".join(texts)
    base = np.cumsum([0, *map(len, texts)])
    byte = base if whole.isascii() else np.cumsum([0, *(len(x.encode()) for x in texts)])
    total = np.concatenate(([0], np.cumsum(size)))
    stop = total[1:] + np.repeat(byte[:-1] - total[first[:-1]], np.diff(first))
    start = stop - size
    if byte is base:
        return start, stop, first, base
    char = np.cumsum(np.frombuffer(whole.encode(), np.uint8) & 0xC0 != 0x80) - 1
    return char[start], char[stop - 1] + 1, first, base


def cut(text: str, separator: re.Pattern) -> tuple[np.ndarray, np.ndarray]:
    ends = [m.end() for m in separator.finditer(text) if m.end() > m.start()]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    ends = np.array(ends, np.int64)
    return np.concatenate(([0], ends[:-1])), ends


def attribute(start: np.ndarray, stop: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a border) of each section [lo, hi); token spans are in order."""
    hi = np.maximum(lo, hi)
    begin, end = np.searchsorted(stop, lo, "right"), np.searchsorted(start, hi, "left")  # tokens that touch the section
    begin, end = np.where(hi > lo, begin, 0), np.where(hi > lo, end, 0)
    inside = np.maximum(np.searchsorted(stop, hi, "right") - np.searchsorted(start, lo, "left"), 0)
    crossing = np.maximum(end - begin, 0) - np.where(hi > lo, inside, 0)
    if rule == "first":
        return (np.searchsorted(start, hi) - np.searchsorted(start, lo)).astype(float), crossing
    if rule == "last":
        return (np.searchsorted(stop, hi, "right") - np.searchsorted(stop, lo, "right")).astype(float), crossing
    # Characters of tokens before a position, weighted so that every token sums to one: exact at borders inside tokens.
    def before(at: np.ndarray) -> np.ndarray:
        full = np.searchsorted(stop, at, "right")
        last = np.minimum(np.searchsorted(start, at, "left"), len(start))
        out = full.astype(float)
        for i in np.flatnonzero(last > full):  # tokens open at the position
            own = slice(full[i], last[i])
            out[i] += ((at[i] - start[own]) / (stop[own] - start[own])).sum()
        return out

    return before(hi) - before(lo), crossing


def attribute_tokens(
    docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", sections: str | None = None, separator: str = r"\n", rule: str = "first", keep: list[str] | None = None
) -> DataFrame:
    """One row for each section: the columns ``keep`` of ``docs``, section (from 0), start, end, n_tokens (whole
    numbers but under ``split``) and n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    taken = {name for name, _ in _OUT}
    names = [c for c in (docs.columns if keep is None else keep) if c not in taken and c != sections and (keep is not None or c != text)]
    docs = spread(docs.select(*dict.fromkeys([*names, text, *([sections] if sections else [])])))
    shared, by = _shared(docs, ranks_path, pattern), re.compile(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lengths(codec(*shared.value))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            given = batch.column(batch.schema.get_field_index(sections)) if sections else None
            parts, counts, texts = [], [], []

            def settle(upto: int) -> None:
                """Attributes the tokens of the texts gathered, which end before row ``upto``."""
                start, stop, first, base = token_spans(known, texts)
                if given is None:
                    bounds = [cut(body, by) for body in texts]
                else:
                    rows = [given[i].as_py() or [] for i in range(upto - len(texts), upto)]
                    bounds = [tuple(np.array([(x or {}).get(f) or 0 for x in own], np.int64) for f in ("start", "end")) for own in rows]
                sizes = [len(lo) for lo, _ in bounds]
                lo, hi = (np.concatenate(x) for x in zip(*bounds))
                if rule == "split":  # shares are added up from a text's own start, so that their rounding stays
                    got = [attribute(start[i:j] - at, stop[i:j] - at, *own, rule) for own, i, j, at in zip(bounds, first, first[1:], base)]
                    n, crossing = (np.concatenate(x) for x in zip(*got))
                else:  # sections end with their text
                    at, end = np.repeat(base[:-1], sizes), np.repeat(base[1:], sizes)
                    n, crossing = attribute(start, stop, np.clip(lo, 0, end - at) + at, np.clip(hi, 0, end - at) + at, rule)
                parts.append((np.concatenate([np.arange(k) for k in sizes]), lo, hi, n, crossing))
                counts.extend(sizes)
                texts.clear()

            size = 0
            for i, value in enumerate(column):
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= AT_ONCE or i == len(column) - 1:
                    settle(i + 1)
                    size = 0
            rows = np.repeat(np.arange(len(counts)), counts)
            kept = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in names], names=names).take(pa.array(rows)) if names else None
            flat = [pa.array(np.concatenate([p[j] for p in parts]), kind) if parts else pa.array([], kind) for j, (_, kind) in enumerate(_OUT)]
            yield pa.RecordBatch.from_arrays([*(kept.columns if kept is not None else []), *flat], names=[*names, *(c for c, _ in _OUT)])

    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.LongType()]
    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, k) for (c, _), k in zip(_OUT, kinds))]))
