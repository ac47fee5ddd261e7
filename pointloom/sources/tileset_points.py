"""The points of a tileset as a Spark data source (`format("points_tileset")`), one partition for each point tile.

The tree is followed from its root file, through external tilesets too; transforms are composed on the way down and applied to positions (after
RTC_CENTER, in double precision) and normals. Tiles that children replace are left out unless their geometric error is small enough: the option
geometricError (default 0: the finest tiles) stops the refinement there; tiles that children add to are always read.

Filters on the coordinates are pushed: tiles whose bounding volume (region, box or sphere) lies outside aren't read, and Spark filters what is. The
options minX .. maxZ cut whole branches before their files are opened, and points are numbered without those; they filter no points. A tile's volume holds
all that is under it, as the format asks. Planning reads the JSON files of what isn't cut and the heads of its tiles, many at a time.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.schema import BUILTIN, POINT_IDX, Attribute, PointSchema
from .files import each, open_binary
from .pnts import SEMANTICS, Tile, load_tile, tile_head
from .tileset import check_tile

#: The WGS 84 ellipsoid, in which regions are given.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
MOST_NESTED = 64


@dataclass
class Content:
    """A tile's file, its transform (row by row) and the box of its volume in the tileset's coordinates."""

    path: str
    matrix: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _times(a: tuple[float, float], b: tuple[float, float]) -> tuple[float, float]:
    ends = [x * y for x in a for y in b]
    return min(ends), max(ends)


def _cosines(low: float, high: float) -> tuple[float, float]:
    """Least and greatest cosine of angles in a range."""
    ends = [math.cos(low), math.cos(high)]
    top = math.floor(high / (2 * math.pi)) * 2 * math.pi >= low
    bottom = math.floor((high - math.pi) / (2 * math.pi)) * 2 * math.pi + math.pi >= low
    return -1.0 if bottom else min(ends), 1.0 if top else max(ends)


def region_box(west: float, south: float, east: float, north: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """A box of earth-centred coordinates that holds a region of longitudes, latitudes (radians) and heights; it may be larger than needed."""
    east = east if east >= west else east + 2 * math.pi  # across the date line
    e2 = FLATTENING * (2 - FLATTENING)
    sines = [math.sin(south), math.sin(north)]
    squares = (0.0 if south <= 0 <= north else min(s * s for s in sines), max(s * s for s in sines))
    radius = [AXIS / math.sqrt(1 - e2 * s) for s in squares]
    across = _times((radius[0] + low, radius[1] + high), _cosines(south, north))
    x, y = _times(across, _cosines(west, east)), _times(across, _cosines(west - math.pi / 2, east - math.pi / 2))
    z = _times((radius[0] * (1 - e2) + low, radius[1] * (1 - e2) + high), (sines[0], sines[1]))
    return tuple(np.array(v) for v in zip(x, y, z, strict=True))


def volume_box(volume: dict, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The axis-aligned box of a bounding volume under a transform; regions aren't transformed."""
    if "region" in volume:
        return region_box(*volume["region"])
    turn = matrix[:3, :3]
    if "box" in volume:
        v = np.array(volume["box"], float)
        reach = np.abs(turn @ v[3:].reshape(3, 3).T).sum(1)
    else:
        v = np.array(volume["sphere"], float)
        reach = v[3] * np.linalg.norm(turn, axis=1)
    middle = turn @ v[:3] + matrix[:3, 3]
    return middle - reach, middle + reach


def join_uri(base: str, uri: str) -> str:
    return uri if "://" in uri or uri.startswith("/") else f"{base.rpartition('/')[0]}/{uri}"


def _document(path: str) -> dict:
    with open_binary(path) as f:
        doc = json.loads(f.read())
    if "asset" not in doc or "root" not in doc:
        raise ValueError(f"{path}: a tileset needs asset and root")
    check_tile(doc["root"])
    return doc


def contents(path: str, limits: list[tuple[float, float]], error: float = 0.0) -> list[Content]:
    """The point tiles of a tileset, parents first, without branches outside the limits of x, y and z. External tilesets are read a level at a time."""
    out: list[tuple[tuple[int, ...], Content]] = []
    waiting = [(path, np.eye(4), (), "ADD")]
    for _ in range(MOST_NESTED):
        documents = each(_document, [w[0] for w in waiting])
        found = []
        for doc, (base, matrix, place, refine) in zip(documents, waiting, strict=True):
            stack = [(doc["root"], matrix, place, refine)]
            while stack:
                tile, m, at, refine = stack.pop()
                if "transform" in tile:
                    m = m @ np.array(tile["transform"], float).reshape(4, 4).T  # columns in the file
                low, high = volume_box(tile["boundingVolume"], m)
                if any(h < a or v > b for v, h, (a, b) in zip(low, high, limits, strict=True)):
                    continue
                refine, content, children = tile.get("refine", refine), tile.get("content") or {}, tile.get("children", [])
                uri = content.get("uri", content.get("url"))
                deeper = bool(children) and (error <= 0 or tile["geometricError"] > error)
                if uri and uri.split("?")[0].lower().endswith(".json"):
                    found.append((join_uri(base, uri), m, at, refine))
                elif uri and not (refine == "REPLACE" and deeper):
                    if not uri.split("?")[0].lower().endswith(".pnts"):
                        raise ValueError(f"{base}: {uri} is no point tile")
                    inner = volume_box(content["boundingVolume"], m) if "boundingVolume" in content else (low, high)
                    out.append((at, Content(join_uri(base, uri), m, *inner)))
                if deeper:
                    stack += [(c, m, (*at, i), refine) for i, c in enumerate(children)]
        waiting = found
        if not waiting:
            return [c for _, c in sorted(out, key=lambda x: x[0])]
    raise ValueError(f"{path}: tilesets nest deeper than {MOST_NESTED}; do they refer to each other?")


class ContentPart(InputPartition):
    def __init__(self, content: Content, first: int):
        self.content, self.first = content, first


class TilesetReader(DataSourceReader):
    def __init__(self, options: dict):
        bound = lambda name, default: float(options.get(name.lower(), options.get(name, default)))
        limits = [(bound(f"min{a}", -math.inf), bound(f"max{a}", math.inf)) for a in "XYZ"]
        self.contents = contents(options["path"], limits, bound("geometricError", 0.0))
        self.pushed = {a: [-math.inf, math.inf] for a in "xyz"}

    def point_schema(self) -> PointSchema:
        if not self.contents:
            return PointSchema((BUILTIN["Position3D"],))
        return PointSchema(tuple(a for _, a, _, _ in self.attributes(tile_head(self.contents[0].path))))

    @staticmethod
    def attributes(tile: Tile) -> list[tuple[str, Attribute, str, int]]:
        return [(n, BUILTIN["Position3D"] if n == "POSITION" else a, k, w) for n, a, k, w in SEMANTICS if n in tile.features]

    def partitions(self) -> list[ContentPart]:
        out, first = [], 0
        heads = each(lambda c: tile_head(c.path), self.contents)
        for c, head in zip(self.contents, heads, strict=True):
            if head.attributes != heads[0].attributes:
                raise ValueError(f"{c.path}: its semantics differ from those of {self.contents[0].path}")
            if all(c.high[i] >= self.pushed[a][0] and c.low[i] <= self.pushed[a][1] for i, a in enumerate("xyz")):
                out.append(ContentPart(c, first))
            first += head.length
        return out

    def read(self, partition: ContentPart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no tiles are left
            return
        tile, m = load_tile(partition.content.path), partition.content.matrix
        n, turn = tile.length, m[:3, :3]
        columns, names = [pa.array(np.arange(partition.first, partition.first + n))], [POINT_IDX]
        for name, a, kind, width in self.attributes(tile):
            raw = np.frombuffer(tile.body, kind, n * width, tile.features[name]["byteOffset"]).reshape(n, width)
            if name == "POSITION":
                raw = (raw.astype(np.float64) + (tile.value("RTC_CENTER") or [0.0, 0.0, 0.0])) @ turn.T + m[:3, 3]
            elif name == "NORMAL":
                raw = raw.astype(np.float64) @ np.linalg.inv(turn)
                raw = (raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-300)).astype(np.float32)
            else:
                raw = raw.astype(np.int16)
            columns.append(pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(raw[:, i])) for i in range(width)], list("xyzw")[:width]))
            names.append(a.name)
        yield pa.RecordBatch.from_arrays(columns, names)


class PushingTilesetReader(TilesetReader):
    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            at = getattr(f, "attribute", ())
            if len(at) == 2 and at[0] == "Position3D" and at[1] in self.pushed:
                limits = self.pushed[at[1]]
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    limits[0] = max(limits[0], f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    limits[1] = min(limits[1], f.value)
            yield f  # tiles are read whole, so Spark filters their points


class TilesetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "points_tileset"

    def schema(self):
        return TilesetReader(self.options).point_schema().struct_type()

    def reader(self, schema) -> TilesetReader:
        return (PushingTilesetReader if self.options.get("pushdown", "false").lower() == "true" else TilesetReader)(self.options)


def read_tileset_points(spark: SparkSession, path: str, **options) -> DataFrame:
    """The points of a tileset file. Filters are pushed unless pushdown=False; that needs a Spark setting, which is turned on for the session."""
    spark.dataSource.register(TilesetSource)
    if str(options.setdefault("pushdown", True)).lower() == "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("points_tileset").options(**{k: str(v) for k, v in options.items()}).load(path)
