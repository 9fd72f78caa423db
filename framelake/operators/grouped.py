"""Many small groups in Python: they stream through a task one after the other, so a group costs no batch of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of results that leave a task at once, at least.
TOGETHER = 10_000


def _begins(t: pa.Table, keys: list[str]) -> np.ndarray:
    """The rows (but the first) at which a key changes."""
    new = np.zeros(max(0, len(t) - 1), bool)
    for k in keys:
        now, was = t[k].combine_chunks()[1:], t[k].combine_chunks()[:-1]
        new |= pc.fill_null(pc.not_equal(now, was), False).to_numpy(zero_copy_only=False)
        new |= (pc.is_null(now).to_numpy(zero_copy_only=False)) != (pc.is_null(was).to_numpy(zero_copy_only=False))
    return np.flatnonzero(new) + 1


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys; only the run that a batch ends in is held until it is whole."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        cuts = [*_begins(t.select(keys), keys).tolist(), len(t)]
        if held:
            seam = pa.concat_tables([held[-1].slice(len(held[-1]) - 1), t.slice(0, 1)]).select(keys)
            if len(_begins(seam, keys)):
                yield pa.concat_tables(held)
                held = []
        at = 0
        for end in cuts:
            if at:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(at, end - at))
            at = end
    if held:
        yield pa.concat_tables(held)


def together(made: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Small tables as batches of at least TOGETHER rows."""
    held, rows = [], 0
    for t in made:
        held.append(t)
        rows += len(t)
        if rows >= TOGETHER:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, rows = [], 0
    if rows:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _frame(t: pa.Table) -> pd.DataFrame:
    return t.to_pandas(use_threads=False)


def _table(pdf: pd.DataFrame, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(pdf[f.name].to_numpy(), type=f.type, from_pandas=True) for f in schema], schema=schema)


def dealt(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of equal keys in one task, one group after the other, each in order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def apply(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """``run`` of every group in order, as groupBy(keys).applyInPandas gives it."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together(_table(run(_frame(g)), out) for g in groups(batches, keys))

    return dealt(rows, keys, order).mapInArrow(each, schema)
