"""A live playlist in append mode: keyed state with timers, and a sink that adds and removes segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENTS = "action string, segment long, n long, start long, end long"


class Playlist(StatefulProcessor):
    """Segments of ``length_us``. A segment is added once the watermark has passed its end, and with it the oldest is
    deleted if more than ``keep`` are listed; a row marked ``last`` ends its stream, and what is open is added at once.
    Rows of a segment that was added already are late and dropped, as are rows after the end. State is what is open and
    what is listed, whatever the stream's length."""

    def __init__(self, key: str, length_us: int, keep: int):
        self.key, self.length, self.keep = key, length_us, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value and one timer a stream: each call of a state is a round trip, whatever it carries.
        self.state = handle.getValueState("state", "newest long, over boolean, open binary, listed binary")

    def _read(self) -> tuple[int, bool, np.ndarray, np.ndarray]:
        """Newest segment added, whether the stream has ended, (segment, n, start, end) of what is open in order, listed segments."""
        got = self.state.get()
        if got is None:
            return -(1 << 62), False, np.empty((0, 4), np.int64), np.empty(0, np.int64)
        return got[0], got[1], np.frombuffer(bytes(got[2]), np.int64).reshape(-1, 4), np.frombuffer(bytes(got[3]), np.int64)

    def _write(self, newest: int, over: bool, opened: np.ndarray, listed: np.ndarray) -> None:
        self.state.update((int(newest), bool(over), opened.tobytes(), listed.tobytes()))

    def _due(self, opened: np.ndarray) -> int | None:
        """When the first open segment ends, in ms; the stream's timer stands there."""
        return -(-(int(opened[0, 0]) + 1) * self.length // 1000) if len(opened) else None

    def _timer(self, was: int | None, now: int | None) -> None:
        if was != now:
            if was is not None:
                self.handle.deleteTimer(was)
            if now is not None:
                self.handle.registerTimer(now)

    def _out(self, key: tuple, added: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
        """What stays listed, and the rows of what is added and deleted."""
        listed = np.concatenate((listed, added[:, 0]))
        gone, stay = np.split(listed, [max(0, len(listed) - self.keep)])
        blank = np.arange(len(added) + len(gone)) >= len(added)
        rows = np.concatenate((added, np.column_stack((gone, np.zeros((len(gone), 3), np.int64)))))
        action = pd.Series(["add"] * len(added) + ["delete"] * len(gone), dtype=object)
        out = {self.key: [key[0]] * len(rows), "action": action, "segment": rows[:, 0]}
        out |= {c: pd.arrays.IntegerArray(rows[:, i].copy(), blank.copy()) for i, c in ((1, "n"), (2, "start"), (3, "end"))}
        return stay, pd.DataFrame(out)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, over, opened, listed = self._read()
        was, ends, met = self._due(opened), False, [opened]
        for pdf in rows:
            last = pdf["last"].to_numpy(bool)
            ends |= bool(last.any())
            t = np.sort(pdf["t_us"].to_numpy(np.int64)[~last])
            segment = t // self.length
            at = np.flatnonzero(np.diff(segment, prepend=segment[:1] - 1))
            upto = np.append(at[1:], len(t))
            met.append(np.column_stack((segment[at], upto - at, t[at], t[upto - 1]))[segment[at] > newest] if len(t) else opened[:0])
        if over:
            return
        every = np.concatenate(met)
        every = every[np.argsort(every[:, 0], kind="stable")]
        at = np.flatnonzero(np.diff(every[:, 0], prepend=every[:1, 0] - 1))
        if len(at):
            opened = np.column_stack((every[at, 0], np.add.reduceat(every[:, 1], at), np.minimum.reduceat(every[:, 2], at), np.maximum.reduceat(every[:, 3], at)))
        if not ends:
            self._timer(was, self._due(opened))
            self._write(newest, False, opened, listed)
            return
        self._timer(was, None)
        listed, out = self._out(key, opened, listed)
        self._write(max([newest, *opened[-1:, 0].tolist()]), True, opened[:0], listed)
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, over, opened, listed = self._read()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        ready = (opened[:, 0] + 1) * self.length <= passed
        if ready.any():
            added, opened = opened[ready], opened[~ready]
            listed, out = self._out(key, added, listed)
            self._write(max(newest, int(added[-1, 0])), over, opened, listed)
            yield out
        self._timer(None, self._due(opened))

    def close(self) -> None:
        pass


def playlist_events(rows: DataFrame, key: str, t: str, length_us: int, keep: int, last: str = "last", tolerance: str = "1 second") -> DataFrame:
    """(key, action, segment, n, start, end) as they happen, in append mode: add or delete, times in microseconds."""
    if length_us <= 0 or keep < 1:
        raise ValueError("segments have a length and a list at least one entry")
    rows.sparkSession.conf.set(*STORE)
    kind = rows.schema[key].dataType.simpleString()
    slim = rows.withWatermark(t, tolerance).select(key, t, F.unix_micros(t).alias("t_us"), F.coalesce(last, F.lit(False)).alias("last"))
    return slim.groupBy(key).transformWithStateInPandas(Playlist(key, length_us, keep), f"`{key}` {kind}, {EVENTS}", "Append", "EventTime")


def segment_sink(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a folder as the playlist is: an added segment's row lies under its key and number,
    a deleted one's folder is removed by a task. A batch delivered twice leaves the same."""

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for pdf in frames:
            for k, s in zip(pdf[key], pdf["segment"]):
                where = f"{root}/{key}={k}/segment={s}"
                if store.get_file_info(where).type != fs.FileType.NotFound:
                    store.delete_dir(where)
            yield pdf.iloc[:0]

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            added = batch.filter("action = 'add'").drop("action")
            added.repartition(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, "segment").parquet(folder)
            deleted = batch.filter("action = 'delete'").select(key, "segment")
            deleted.mapInPandas(remove, deleted.schema).write.format("noop").mode("overwrite").save()
        finally:
            batch.unpersist()

    return deliver
