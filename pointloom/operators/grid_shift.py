"""Datum shifts by NTv2 grids: bilinear lookup of the shifts at the corners of a point's cell, and the way back by iteration.

A file holds grids of shifts in latitude and longitude, some inside others; a point takes the finest grid that contains it, borders
included, and the first file with one. Files are read by Spark's binary reader, so any path that Spark knows will do; they are parameters
of a transform, not data: parsed once, checked against MAX_BYTES together and broadcast. Points are shifted in Arrow batches where they lie.

Defined results: points that no grid contains, and null, NaN or infinite coordinates, become NaN, unless one of the names is "null", the
grid without shifts that contains all the rest. A name with a leading @ may be missing. A point comes back only if it and all that the
iteration tries lie in a grid; others, at a grid's border, become NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of all files of a transform; beyond, it raises.
MAX_BYTES = 128 << 20
#: Degrees to which coming back is iterated, and the rounds it has; a shift changes by far less than its own length within that length.
CLOSE, ROUNDS = 1e-12, 20

# Fixed values of the format: records of eight bytes of name and eight of value; a cell's corner holds two shifts and two accuracies.
RECORD, CORNER = 16, 16
SECONDS = {"SECONDS": 1.0, "MINUTES": 60.0, "DEGREES": 3600.0}


@dataclass(frozen=True)
class Grid:
    """Shifts in seconds by row from the south and by column from the east; longitudes are counted westwards, in seconds, as in the files."""

    south: float
    east: float
    high: float
    wide: float
    lat: np.ndarray
    west: np.ndarray

    def shifts(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the grid contains each point, degrees of latitude, degrees of longitude eastwards)."""
        rows, columns = self.lat.shape
        y = (lat * 3600 - self.south) / self.high
        x = np.mod(-lon * 3600 - self.east, 360 * 3600) / self.wide
        slack = 1e-9  # of a cell: borders in degrees have no exact seconds
        x = np.where(x > 360 * 3600 / self.wide - slack, 0.0, x)
        inside = (y >= -slack) & (y <= rows - 1 + slack) & (x <= columns - 1 + slack)
        y, x = (np.where(inside, np.clip(c, 0, n - 1), 0.0) for c, n in ((y, rows), (x, columns)))
        i, j = np.minimum(y.astype(int), max(rows - 2, 0)), np.minimum(x.astype(int), max(columns - 2, 0))
        up, left = np.minimum(i + 1, rows - 1), np.minimum(j + 1, columns - 1)
        v, u = y - i, x - j
        at = lambda a: (a[i, j] * (1 - u) + a[i, left] * u) * (1 - v) + (a[up, j] * (1 - u) + a[up, left] * u) * v
        return inside, at(self.lat) / 3600, -at(self.west) / 3600


def parse(content: bytes) -> list[Grid]:
    """The grids of a file in NTv2's binary layout, of either byte order, finest first."""
    order = next((o for o in "<>" if len(content) >= RECORD and np.frombuffer(content, f"{o}i4", 1, 8)[0] == 11), None)
    if order is None or not content.startswith(b"NUM_OREC"):
        raise ValueError("not a file of NTv2 grids")

    def header(at: int, n: int) -> dict[str, bytes]:
        if at + n * RECORD > len(content):
            raise ValueError("a file of grids that ends in a header")
        return {content[k : k + 8].decode("ascii", "replace").strip(): content[k + 8 : k + RECORD] for k in range(at, at + n * RECORD, RECORD)}

    count = lambda value: int(np.frombuffer(value, f"{order}i4", 1)[0])
    real = lambda value: float(np.frombuffer(value, f"{order}f8", 1)[0])
    top = header(0, 11)
    unit = SECONDS.get(top["GS_TYPE"].decode("ascii", "replace").strip().upper())
    if unit is None:
        raise ValueError(f"grids of unknown unit {top['GS_TYPE']!r}")
    found, at = [], 11 * RECORD
    for _ in range(count(top["NUM_FILE"])):
        sub = header(at, count(top["NUM_SREC"]))
        south, north, east, west, high, wide = (real(sub[k]) * unit for k in ("S_LAT", "N_LAT", "E_LONG", "W_LONG", "LAT_INC", "LONG_INC"))
        at += count(top["NUM_SREC"]) * RECORD
        rows, columns, corners = round((north - south) / high) + 1, round((west - east) / wide) + 1, count(sub["GS_COUNT"])
        if rows * columns != corners or at + corners * CORNER > len(content):
            raise ValueError(f"a grid of {rows} x {columns} corners with {corners} in a file of {len(content)} bytes")
        values = np.frombuffer(content, f"{order}f4", corners * 4, at).reshape(rows, columns, 4)
        found.append(Grid(south, east, high, wide, *(values[:, :, k].astype(np.float32) * np.float32(unit) for k in (0, 1))))
        at += corners * CORNER
    return sorted(found, key=lambda g: g.high * g.wide)


def shift(files: list[list[Grid] | None], lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees that the points' first file with a grid adds; NaN where there is none. None is the grid without shifts."""
    dlat, dlon = np.full(len(lat), np.nan), np.full(len(lat), np.nan)
    left = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
    for grids in files:
        if grids is None:
            dlat[left] = dlon[left] = 0.0
            break
        for grid in grids:
            inside, a, b = grid.shifts(lat[left], lon[left])
            dlat[left[inside]], dlon[left[inside]] = a[inside], b[inside]
            left = left[~inside]
    return dlat, dlon


def unshift(files: list[list[Grid] | None], lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points that `shift` takes to these, by repeated correction."""
    a, b = lat.astype(float), lon.astype(float)
    for _ in range(ROUNDS):
        dlat, dlon = shift(files, a, b)
        last, (a, b) = (a, b), (lat - dlat, lon - dlon)
        if not len(a) or not (np.fmax(np.abs(a - last[0]), np.abs(b - last[1])) > CLOSE).any():
            break
    return a, b


def load(spark: SparkSession, names: tuple[str, ...]) -> list[list[Grid] | None]:
    """The grids of the named files, in order."""
    files: list[list[Grid] | None] = []
    left = MAX_BYTES
    for name in names:
        if name == "null":
            files.append(None)
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(name.removeprefix("@"))
        if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            if name.startswith("@"):
                continue
            raise FileNotFoundError(name)
        found = spark.read.format("binaryFile").load(name.removeprefix("@"))
        left -= found.agg(F.sum("length")).first()[0] or 0
        if left < 0:
            raise ValueError(f"grids of more than {MAX_BYTES} bytes")
        files.append([g for row in found.select("content").collect() for g in parse(bytes(row[0]))])
    return files


def shifted(names: tuple[str, ...], lat: Column, lon: Column, back: bool = False) -> tuple[Column, Column]:
    """(latitude, longitude) in degrees, moved by the grids of the named files, or back to where they were moved from."""
    spark = SparkSession.active()
    sent = spark.sparkContext.broadcast(load(spark, names))

    @F.pandas_udf("lat double, lon double")
    def run(lats: pd.Series, lons: pd.Series) -> pd.DataFrame:
        a, b = (c.to_numpy(dtype=float, na_value=np.nan) for c in (lats, lons))
        if back:
            a, b = unshift(sent.value, a, b)
        else:
            dlat, dlon = shift(sent.value, a, b)
            a, b = a + dlat, b + dlon
        return pd.DataFrame({"lat": a, "lon": b})

    moved = run(lat, lon)
    lost = F.lit(float("nan"))  # Arrow brings NaN back as null
    return F.coalesce(moved["lat"], lost), F.coalesce(moved["lon"], lost)
