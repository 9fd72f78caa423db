"""The same operators on unbounded input, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def drop_late(frames: DataFrame, t: str, tolerance: str = "33 milliseconds") -> DataFrame:
    """Event-time watermark of one frame period: what comes later is dropped by the next stateful step."""
    return frames.withWatermark(t, tolerance)


def live_segments(frames: DataFrame, by: list[str], t: str, length: str = "6 seconds", tolerance: str = "1 second") -> DataFrame:
    """Segments as tumbling windows, emitted when the watermark has passed them."""
    return drop_late(frames, t, tolerance).groupBy(*by, F.window(t, length).alias("w")).agg(F.count("*").alias("n"), F.min(t).alias("start"), F.max(t).alias("end"))


def activity(frames: DataFrame, by: list[str], t: str, gap: str, tolerance: str = "1 second") -> DataFrame:
    """Stretches of activity: sessions that end after a gap."""
    return drop_late(frames, t, tolerance).groupBy(*by, F.session_window(t, gap).alias("w")).agg(F.count("*").alias("n"))


def av_offset(video: DataFrame, audio: DataFrame, by: list[str], tolerance: str = "5 seconds") -> DataFrame:
    """Pairs of video and audio times of one stream within the tolerance: a stream-stream interval join."""
    v = video.withWatermark("video_ts", tolerance)
    a = audio.withWatermark("audio_ts", tolerance)
    near = F.expr(f"audio_ts >= video_ts - INTERVAL {tolerance} AND audio_ts <= video_ts + INTERVAL {tolerance}")
    same = [v[c] == a[c] for c in by]
    return v.join(a, [*same, near]).select(*(v[c] for c in by), "video_ts", "audio_ts")


def fan_out(targets: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that delivers to all targets even if some fail, then raises what failed."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        failed = []
        try:
            for i, target in enumerate(targets):
                try:
                    target(batch, number)
                except Exception as e:  # delivered to the others first
                    failed.append(f"target {i}: {e}")
        finally:
            batch.unpersist()
        if failed:
            raise RuntimeError("; ".join(failed))

    return deliver


def gap_counts(rows: DataFrame, key: str, t: str, gap_us: int) -> DataFrame:
    """(key, n, gaps) of each key that a batch touches: how many rows it has had so far, and how often its time has gone
    on by more than the gap. The state is two counts and the last time, whatever the stream's length."""

    def count(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, gaps, last = state.get if state.exists else (0, 0, None)
        times = np.sort(np.concatenate([f[t].to_numpy("datetime64[us]").view(np.int64) for f in frames]))
        reached = np.maximum.accumulate(np.concatenate(([times[0] if last is None else last], times)))
        gaps += int((times - reached[:-1] > gap_us).sum())
        n, last = n + len(times), int(reached[-1])
        state.update((n, gaps, last))
        yield pd.DataFrame({key: [k[0]], "n": [n], "gaps": [gaps]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, n long, gaps long", "n long, gaps long, last long", "update", GroupStateTimeout.NoTimeout)


def to_folders(folder: str, names: list[str]) -> list[Callable[[DataFrame, int], None]]:
    """Targets for ``fan_out``: each batch as Parquet under target=name and its number, so that a batch delivered twice
    replaces itself."""

    def target(name: str) -> Callable[[DataFrame, int], None]:
        return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/target={name}/batch={number}")

    return [target(n) for n in names]
