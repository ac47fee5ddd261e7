"""Running aggregates over streams of points: files that arrive in a folder, windowed by GpsTime with a watermark, and reports kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.geometry import AXES

POSITION = "Position3D"


def arriving_points(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of points as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def timed(points: DataFrame, lateness: str) -> DataFrame:
    return points.withColumn("event_time", F.timestamp_seconds("GpsTime")).withWatermark("event_time", lateness)


def _bounds() -> list:
    out = []
    for a in AXES:
        c = F.when(~F.isnan(F.col(POSITION)[a]), F.col(POSITION)[a])
        out += [F.min(c).alias(f"min_{a}"), F.max(c).alias(f"max_{a}")]
    return out


def running_bounds(points: DataFrame, width: str = "1 day", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Count and bounds of each tumbling or sliding window; points later than the watermark are dropped."""
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return timed(points, lateness).groupBy(window).agg(F.count("*").alias("n_points"), *_bounds()).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_points", *[f"{m}_{a}" for a in AXES for m in ("min", "max")])


def running_voxel_counts(points: DataFrame, origin: tuple[float, float, float], leaf: float, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Points of each occupied cell of a fixed grid, for each tumbling window: a stream has no bounds to start a grid from."""
    cells = [F.floor((F.col(POSITION)[a] - o) / leaf).alias(f"i{a}") for a, o in zip(AXES, origin, strict=True)]
    counted = timed(points, lateness).groupBy(F.window("event_time", width), *cells).agg(F.count("*").alias("n_points"))
    return counted.select(F.col("window.start").alias("start"), *[f"i{a}" for a in AXES], "n_points")


def sessions(points: DataFrame, key: str, gap: str, lateness: str = "1 day") -> DataFrame:
    """Count and bounds of each key's sessions, closed by a gap without points."""
    grouped = timed(points, lateness).groupBy(F.session_window("event_time", gap), key).agg(F.count("*").alias("n_points"), *_bounds())
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n_points", *[f"{m}_{a}" for a in AXES for m in ("min", "max")])


BOUNDS = [f"{m}_{a}" for a in AXES for m in ("min", "max")]
#: change: +1 for a report that holds from now on, -1 for one that no longer does, 0 for one that is closed; start and last are seconds.
REPORT = "change int, start double, last double, n_points long, " + ", ".join(f"{b} double" for b in BOUNDS)


def _joined(a: tuple, b: tuple) -> tuple:
    """One report of two: (start, last, points, least and greatest coordinates)."""
    ends = [f(x, y) for x, y, f in zip(a[3:], b[3:], [np.fmin, np.fmax] * 3, strict=True)]
    return (min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], *map(float, ends))


def running_reports(points: DataFrame, key: str, gap: float, lateness: str = "1 day") -> DataFrame:
    """Each key's reports (count and bounds of a session) as a log of changes: a report that grows is taken back and given anew.

    A session ends where no point follows for more than `gap` seconds; it is closed, and its state goes, when a later point begins another or the watermark
    has passed its end. State is one report a key. A point more than gap before an open session, or before the watermark, comes too late and changes nothing;
    one that reaches into the gap before it extends it. NaN coordinates don't count in bounds, points without a time in nothing.
    """
    fields = ["start", "last", "n_points", *BOUNDS]
    kind = points.schema[key].dataType.simpleString()

    def changed(before: tuple | None, after: tuple | None) -> list[tuple]:
        return [] if before == after else ([(-1, *before)] if before is not None else []) + [(1, *after)]

    def grow(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append((0, *held))
            state.remove()
        else:
            before, rows = held, pd.concat(list(batches)).sort_values("GpsTime", kind="stable")
            rows = rows[rows["GpsTime"].notna()]
            if held is not None:
                rows = rows[rows["GpsTime"] >= held[0] - gap]
            time = rows["GpsTime"].to_numpy()
            # Points of the batch by session; the first of them may belong to the open one.
            for part in np.split(np.arange(len(time)), np.flatnonzero(np.diff(time) > gap) + 1):
                if len(part):
                    at = rows.iloc[part][list(AXES)].to_numpy(float)
                    ends = np.stack([np.fmin.reduce(at), np.fmax.reduce(at)], 1).ravel()
                    new = (float(time[part[0]]), float(time[part[-1]]), len(part), *map(float, ends))
                    if held is not None and new[0] <= held[1] + gap:
                        held = _joined(held, new)
                        continue
                    out += changed(before, held) + ([(0, *held)] if held is not None else [])
                    before, held = None, new
            out += changed(before, held)
            if held is not None:
                state.update(held)
                state.setTimeoutTimestamp(max(int((held[1] + gap) * 1000), state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["change", *fields])
        frame.insert(0, key, name[0])
        yield frame

    flat = timed(points, lateness).select(key, "GpsTime", "event_time", *[F.col(POSITION)[a].cast("double").alias(a) for a in AXES])
    stored = REPORT.partition(", ")[2]
    return flat.groupBy(key).applyInPandasWithState(grow, f"{key} {kind}, {REPORT}", stored, "append", GroupStateTimeout.EventTimeTimeout)
