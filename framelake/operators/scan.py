"""Recursive filters over long streams: blocks run side by side, and an associative scan joins them.

A block (``size`` rows of one stream) maps the state before it to the state after it. For a linear filter that is an
affine map, s -> a s + b, and maps compose. Blocks are first run from rest, which gives b (a follows from the length);
the maps are composed up a tree, FAN blocks a node, and the states before all nodes go down again; then every block is
run from its own state. So no task holds a stream, and a stream's blocks meet only as a row each, FAN at a time.

A level follower isn't linear (it rises and falls at different speeds), but it forgets: after ``memory`` samples nothing
of an earlier level is left in double precision. Its blocks begin that much earlier, from rest.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..folders import settle
from . import grouped

#: Rows of a block, and blocks of a node of the tree.
BLOCK, FAN = 1 << 17, 1024
#: Samples under which a loop is quicker than columns side by side.
SHORT = 512
_MAP = "a binary, b binary, first binary"


class Affine:
    """s -> a s + b; a is a matrix, or one number for all components. ``first`` stands in for a state that is missing or
    of another size (None: a state of zeros)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, first: np.ndarray | None = None):
        self.a, self.b, self.first = a, b, first

    def __call__(self, state: np.ndarray | None) -> np.ndarray:
        if self.first is not None and (state is None or len(state) != len(self.first)):
            state = self.first
        if state is None or not self.a.any():
            return self.b
        return (self.a[0] * state if self.a.size == 1 else self.a @ state) + self.b

    def after(self, other: Affine) -> Affine:
        """This map after the other one."""
        if not self.a.any() or self.first is not None and len(self.first) != len(other.b):
            a = np.zeros(1)  # nothing of an earlier state is left
        else:
            a = self.a * other.a if self.a.size == 1 else self.a @ other.a
        return Affine(a, self(other.b), other.first)

    def row(self) -> dict:
        return {"a": self.a.astype(float).tobytes(), "b": self.b.tobytes(), "first": None if self.first is None else self.first.tobytes()}

    @staticmethod
    def of(row) -> Affine:
        a, b = np.frombuffer(row.a), np.frombuffer(row.b)
        return Affine(a if a.size == 1 else a.reshape(len(b), -1), b, None if row.first is None else np.frombuffer(row.first))


def _keys(rows: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)


def _one(pdf: pd.DataFrame, by: list[str], **more) -> pd.DataFrame:
    return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, **{k: [v] for k, v in more.items()}})


def states(maps: DataFrame, by: list[str], fan: int = FAN) -> DataFrame:
    """(by, _block, state): the state before each block, null before a stream's first, of (by, _block, a, b, first)."""
    keys, last = _keys(maps, by), maps.agg(F.max("_block")).first()[0] or 0

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        begun = pdf[pdf["a"].isna()]
        now = np.frombuffer(begun["state"].iloc[0]) if len(begun) and begun["state"].iloc[0] is not None else None
        rows = pdf[pdf["a"].notna()]
        out = []
        for row in rows.itertuples():
            out.append(None if now is None else now.tobytes())
            now = Affine.of(row)(now)
        return rows[[*by, "_block"]].assign(state=out)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for row in pdf.sort_values("_block").itertuples():
            total = Affine.of(row) if total is None else Affine.of(row).after(total)
        return _one(pdf, by, _block=int(pdf["_node"].iloc[0]), **total.row())

    noded = maps.withColumn("_node", F.floor(F.col("_block") / fan)).withColumn("state", F.lit(None).cast("binary"))
    if last >= fan:
        nodes = noded.groupBy(*by, "_node").applyInPandas(compose, f"{keys}, _block long, {_MAP}")
        before = states(nodes, by, fan).select(*by, F.lit(-1).cast("long").alias("_block"), *(F.lit(None).cast("binary").alias(c) for c in ("a", "b", "first")), F.col("_block").alias("_node"), "state")
        noded = noded.unionByName(before)
    return noded.groupBy(*by, "_node").applyInPandas(fold, f"{keys}, _block long, state binary")


def filtered(
    rows: DataFrame, by: list[str], n: str, begin: Callable[[pd.DataFrame], Affine], run: Callable[[pd.DataFrame, np.ndarray | None], pd.DataFrame], size: int = BLOCK, fan: int = FAN
) -> DataFrame:
    """``rows`` as ``run`` gives them, block by block in the order of ``n`` (whole numbers from 0), each from the state that
    the maps ``begin`` of the blocks before it lead to. A stream of one block begins and ends in it: only longer ones have
    maps."""
    blocks = rows.withColumn("_block", F.floor(F.col(n) / size).cast("long"))
    schema, names = rows.schema, rows.columns
    # Only streams of several blocks have states to hand on.
    several = blocks.groupBy(*by).agg(F.min("_block").alias("_first"), F.max("_block").alias("_end")).filter("_first < _end").select(*(F.col(c).alias(f"_of_{c}") for c in by))
    same = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by))
    ends = grouped.apply(blocks.join(several, same, "left_semi"), [*by, "_block"], [n], lambda pdf: _one(pdf, by, _block=int(pdf["_block"].iloc[0]), **begin(pdf).row()), f"{_keys(rows, by)}, _block long, {_MAP}")
    before = states(settle(ends), by, fan).filter("state IS NOT NULL").withColumn("_row", F.lit(0))
    blank = {c: F.lit(0 if isinstance(schema[c].dataType, T.NumericType) else None).cast(schema[c].dataType) for c in names if c not in by}
    both = blocks.withColumns({"state": F.lit(None).cast("binary"), "_row": F.lit(1)}).unionByName(before.withColumns(blank).select(*names, "_block", "state", "_row"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        now, own = pdf["state"].iloc[0], pdf[pdf["_row"] == 1]
        return run(own, None if now is None else np.frombuffer(now))[names]

    return grouped.apply(both, [*by, "_block"], ["_row", n], each, schema)


def section(x: np.ndarray, b: np.ndarray, a: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A second-order section from a state of two numbers: columns of about sqrt(n) samples run side by side from rest, then
    each gets what is left of the state before it. Under SHORT samples one follows the other."""
    tall = int(np.sqrt(len(x))) if len(x) >= SHORT else 0
    wide = len(x) // tall if tall else 0
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    inputs = x[: tall * wide].reshape(wide, tall).T
    out, left = np.empty((tall, wide)), np.empty((tall, 2))
    z1, z2, power = np.zeros(wide), np.zeros(wide), np.eye(2)
    for i in range(tall):
        v = inputs[i]
        y = out[i] = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * y + z2, b[2] * v - a[2] * y
        left[i], power = power[0], step @ power
    starts = np.empty((2, wide))
    for c in range(wide):
        starts[:, c] = state
        state = power @ state + (z1[c], z2[c])
    out += left @ starts
    tail = np.empty(len(x) - tall * wide)
    z = list(state)
    for i, v in enumerate(x[tall * wide :].tolist()):  # fewer than SHORT, or than tall
        tail[i] = y = b[0] * v + z[0]
        z = [b[1] * v - a[1] * y + z[1], b[2] * v - a[2] * y]
    return np.concatenate((out.T.ravel(), tail)), np.array(z)


def cascade(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]], state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sections one after the other, from and to a state of two numbers each."""
    state = np.zeros(2 * len(sections)) if state is None else state
    ends = []
    for i, (b, a) in enumerate(sections):
        x, end = section(x, b, a, state[2 * i : 2 * i + 2])
        ends.append(end)
    return x, np.concatenate(ends)


def sections(samples: DataFrame, by: list[str], chain: list[tuple[np.ndarray, np.ndarray]], n: str = "n", value: str = "value", size: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Samples through a chain of second-order sections (b, a)."""
    d = 2 * len(chain)
    if not d:
        return samples
    step = np.stack([cascade(np.zeros(1), chain, unit)[1] for unit in np.eye(d)], 1)

    def begin(pdf: pd.DataFrame) -> Affine:
        return Affine(np.linalg.matrix_power(step, len(pdf)), cascade(pdf[value].to_numpy(float), chain, None)[1])

    return filtered(samples, by, n, begin, lambda pdf, state: pdf.assign(**{value: cascade(pdf[value].to_numpy(float), chain, state)[0]}), size, fan)


def pole(ms: float, rate: int) -> float:
    return float(np.exp(-1000 / (max(ms, 1e-3) * rate)))


def envelope(x: np.ndarray, attack: float, release: float, rate: int) -> np.ndarray:
    """A level follower with attack and release times in ms, from rest."""
    up, down = pole(attack, rate), pole(release, rate)
    out, level = np.empty(len(x)), 0.0
    for i, v in enumerate(np.abs(x).tolist()):  # each step depends on the level: a block's worth, never a stream's
        k = up if v > level else down
        level = k * level + (1 - k) * v
        out[i] = level
    return out


def followed(
    samples: DataFrame, by: list[str], attack: float, release: float, rate: int, gain: Callable[[np.ndarray], np.ndarray], n: str = "n", value: str = "value", of: str | None = None, size: int = BLOCK
) -> DataFrame:
    """Samples (numbered without gaps) times ``gain`` of the level followed in the column ``of`` (default: their own)."""
    memory = int(np.ceil(37 * max(attack, release, 1e-3) * rate / 1000)) + 1  # exp(-37) is under double precision
    size = max(size, memory)
    own, late = F.floor(F.col(n) / size), F.col(n) % size >= size - memory
    dealt = samples.withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = (pdf[n] // size == pdf["_block"]).to_numpy()
        if not mine.any():  # only the head of a block that the stream doesn't reach
            return pdf.iloc[:0].drop(columns="_block")
        level = envelope(pdf[of or value].to_numpy(float), attack, release, rate)
        return pdf.assign(**{value: pdf[value].to_numpy(float) * gain(level)})[mine].drop(columns="_block")

    return grouped.apply(dealt, [*by, "_block"], [n], run, samples.schema)


def trail(frames: DataFrame, weight: float, by: str = "stream_id", n: str = "frame_no", plane: str = "plane", size: int = 256, fan: int = 64) -> DataFrame:
    """Each frame mixed with the output before it; a change of size starts anew."""

    def planes(pdf: pd.DataFrame, last: np.ndarray | None) -> list[np.ndarray]:
        out = []
        for x in pdf[plane]:
            now = np.asarray(x, float)
            last = now if last is None or last.shape != now.shape else now + (last - now) * weight
            out.append(last)
        return out

    def begin(pdf: pd.DataFrame) -> Affine:
        first = np.asarray(pdf[plane].iloc[0], float)
        out = planes(pdf, np.zeros(len(first)))
        same = all(len(x) == len(first) for x in out)
        return Affine(np.array([weight ** len(out) if same else 0.0]), out[-1], first)

    return filtered(frames, [by], n, begin, lambda pdf, state: pdf.assign(**{plane: [x.tolist() for x in planes(pdf, state)]}), size, fan)

