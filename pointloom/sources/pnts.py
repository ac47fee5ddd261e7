"""Point tiles (PNTS) as a Spark data source (`format("points_pnts")`), one partition for each tile.

Options: positionsMode "absolute" (default; adds RTC_CENTER) or "relative"; for writing rtcCenter "x,y,z" (stored, not applied) and
pointsPerTile. Planning reads headers only, many at a time; all tiles of a folder need the same semantics.
Only POSITION, RGB, RGBA and NORMAL are read and written; other attributes are dropped.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.casts import can_cast, point_cast
from ..functions.schema import POINT_IDX, Attribute, PointSchema
from .files import each, list_files, open_binary, remove, write_whole

# Semantic, attribute, stored component type and count, in the order of writing.
SEMANTICS = (
    ("POSITION", Attribute("Position3D", "vec3f32"), "<f4", 3),
    ("RGBA", Attribute("ColorRGBA", "vec4u8"), "u1", 4),
    ("RGB", Attribute("ColorRGB", "vec3u8"), "u1", 3),
    ("NORMAL", Attribute("Normal", "vec3f32"), "<f4", 3),
)
HEADER = struct.Struct("<4sIIIIII")
POINTS_PER_TILE = 1_000_000


@dataclass
class Tile:
    """A tile's feature table: JSON header, body and the bytes of the batch table."""

    features: dict
    body: bytes
    batch: dict = field(default_factory=dict)
    batch_body: bytes = b""

    @property
    def length(self) -> int:
        if "POINTS_LENGTH" not in self.features:
            raise ValueError("the feature table has no POINTS_LENGTH")
        return int(self.value("POINTS_LENGTH")[0])

    def value(self, name: str) -> list[float] | None:
        """A global value: a number, an array, or a reference into the body."""
        v = self.features.get(name)
        if v is None:
            return None
        if isinstance(v, dict):
            kind = {"POINTS_LENGTH": "<u4", "BATCH_LENGTH": "<u4", "CONSTANT_RGBA": "u1"}.get(name, "<f4")
            n = {"POINTS_LENGTH": 1, "BATCH_LENGTH": 1, "CONSTANT_RGBA": 4}.get(name, 3)
            return np.frombuffer(self.body, kind, n, v["byteOffset"]).tolist()
        return v if isinstance(v, list) else [v]

    @property
    def attributes(self) -> list[tuple[str, Attribute, str, int]]:
        return [s for s in SEMANTICS if s[0] in self.features]


def read_tile(data: bytes) -> Tile:
    if len(data) < HEADER.size or data[:4] != b"pnts":
        raise ValueError("no point tile")
    _, version, size, fj, fb, bj, bb = HEADER.unpack_from(data)
    if version != 1:
        raise ValueError(f"point tile of version {version}")
    if HEADER.size + fj + fb + bj + bb > len(data):
        raise ValueError("the tile is cut off")
    at = HEADER.size
    text = lambda a, n: json.loads(data[a : a + n] or b"{}")
    return Tile(text(at, fj), data[at + fj : at + fj + fb], text(at + fj + fb, bj) if bj else {}, data[at + fj + fb + bj : at + fj + fb + bj + bb])


def _padded(data: bytes, fill: bytes, at: int = 0) -> bytes:
    return data + fill * (-(len(data) + at) % 8)


def pack_tile(columns: dict[str, np.ndarray], n: int, rtc_center: list[float] | None = None, batch: dict | None = None, batch_body: bytes = b"") -> bytes:
    """columns: semantic -> array (n, components); batch: the batch table's JSON, whose references point into batch_body."""
    features: dict = {"POINTS_LENGTH": n}
    if rtc_center:
        features["RTC_CENTER"] = rtc_center
    body = b""
    for name, _, kind, _ in SEMANTICS:
        if name in columns:
            body = _padded(body, b"\0")
            features[name] = {"byteOffset": len(body)}
            body += np.ascontiguousarray(columns[name]).astype(kind).tobytes()
    head = _padded(json.dumps(features, separators=(",", ":")).encode(), b" ", HEADER.size)
    body = _padded(body, b"\0")
    table = _padded(json.dumps(batch, separators=(",", ":")).encode(), b" ") if batch else b""
    tail = _padded(batch_body, b"\0") if batch else b""
    sizes = [len(p) for p in (head, body, table, tail)]
    return HEADER.pack(b"pnts", 1, HEADER.size + sum(sizes), *sizes) + head + body + table + tail


def load_tile(path: str) -> Tile:
    with open_binary(path) as f:
        return read_tile(f.read())


GLOBALS = ("POINTS_LENGTH", "RTC_CENTER", "QUANTIZED_VOLUME_OFFSET", "QUANTIZED_VOLUME_SCALE", "CONSTANT_RGBA", "BATCH_LENGTH")


def tile_head(path: str) -> Tile:
    """A tile without its body: its header, its feature table's JSON, and of the body the global values that the JSON refers to."""
    with open_binary(path) as f:
        head = f.read(HEADER.size)
        if len(head) < HEADER.size or head[:4] != b"pnts":
            raise ValueError("no point tile")
        _, version, _, fj, fb, bj, bb = HEADER.unpack(head)
        if version != 1:
            raise ValueError(f"point tile of version {version}")
        if HEADER.size + fj + fb + bj + bb > f.size():
            raise ValueError("the tile is cut off")
        tile = Tile(json.loads(f.read(fj) or b"{}"), b"")
        for name in GLOBALS:
            if isinstance(v := tile.features.get(name), dict):
                f.seek(HEADER.size + fj + v["byteOffset"])
                tile.features[name] = Tile({name: v | {"byteOffset": 0}}, f.read(16)).value(name)
    return tile


class TilePart(InputPartition):
    def __init__(self, path: str, first: int):
        self.path, self.first = path, first


class PntsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = list_files(options["path"], (".pnts",))
        self.absolute = {"absolute": True, "relative": False}[options.get("positionsmode", options.get("positionsMode", "absolute")).lower()]

    def point_schema(self) -> PointSchema:
        return PointSchema(tuple(a for _, a, _, _ in tile_head(self.paths[0]).attributes))

    def partitions(self) -> list[TilePart]:
        out, first = [], 0
        tiles = each(tile_head, self.paths)
        for p, tile in zip(self.paths, tiles, strict=True):
            if tile.attributes != tiles[0].attributes:
                raise ValueError(f"{p}: its semantics differ from those of {self.paths[0]}; read tiles of different semantics apart")
            out.append(TilePart(p, first))
            first += tile.length
        return out

    def read(self, partition: TilePart) -> Iterator[pa.RecordBatch]:
        tile = load_tile(partition.path)
        n = tile.length
        columns, names = [pa.array(np.arange(partition.first, partition.first + n))], [POINT_IDX]
        for name, a, kind, width in SEMANTICS:
            if name not in tile.features:
                continue
            raw = np.frombuffer(tile.body, kind, n * width, tile.features[name]["byteOffset"]).reshape(n, width)
            center = tile.value("RTC_CENTER")
            if name == "POSITION" and center and self.absolute:
                raw = (raw.astype(np.float64) + center).astype(np.float32)
            wide = np.int16 if kind == "u1" else np.float32
            columns.append(pa.StructArray.from_arrays([pa.array(raw[:, i].astype(wide)) for i in range(width)], list("xyzw")[:width]))
            names.append(a.name)
        yield pa.RecordBatch.from_arrays(columns, names)


class TileWritten(WriterCommitMessage):
    """(name, points, lowest and highest coordinates) of the tiles of a partition."""

    def __init__(self, tiles: list[tuple[str, int, list[float], list[float]]]):
        self.tiles = tiles


class PntsWriter(DataSourceArrowWriter):
    """Tiles of at most pointsPerTile points for each partition, and a tileset.json that lists them with their boxes."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        center = options.get("rtccenter", options.get("rtcCenter"))
        self.center = [float(v) for v in center.split(",")] if center else None
        self.most = int(options.get("pointspertile", options.get("pointsPerTile", POINTS_PER_TILE)))

    def write(self, batches: Iterator[pa.RecordBatch]) -> TileWritten:
        from pyspark import TaskContext

        parts: dict[str, list[np.ndarray]] = {}
        held, tiles = 0, []

        def flush() -> None:
            nonlocal held
            if held:
                name = f"part-{TaskContext.get().partitionId():05d}-{len(tiles):05d}.pnts"
                columns = {k: np.concatenate(v) for k, v in parts.items()}
                write_whole(f"{self.path}/{name}", pack_tile(columns, held, self.center))
                where = columns["POSITION"].astype(float) + (self.center or [0.0, 0.0, 0.0])
                tiles.append((name, held, where.min(0).tolist(), where.max(0).tolist()))
            parts.clear()
            held = 0

        for batch in batches:
            for s in range(0, batch.num_rows, self.most):
                some = batch.slice(s, min(self.most, batch.num_rows - s))
                if held and held + some.num_rows > self.most:
                    flush()
                held += some.num_rows
                for name, a, _, width in SEMANTICS:
                    if a.name in some.schema.names:
                        column = some.column(a.name).flatten()
                        parts.setdefault(name, []).append(np.stack([column[c].to_numpy(zero_copy_only=False) for c in range(width)], 1))
        flush()
        return TileWritten(tiles)

    def commit(self, messages: list[TileWritten | None]) -> None:
        from .tileset import box_volume, tileset

        tiles = sorted(t for m in messages if m for t in m.tiles)
        if tiles:
            low, high = np.min([t[2] for t in tiles], 0).tolist(), np.max([t[3] for t in tiles], 0).tolist()
            children = [{"boundingVolume": box_volume(t[2], t[3]), "geometricError": 0.0, "content": {"uri": t[0]}} for t in tiles]
            root = {"boundingVolume": box_volume(low, high), "geometricError": 0.0, "refine": "ADD", "children": children}
            write_whole(f"{self.path}/tileset.json", json.dumps(tileset(root, 0.0)).encode())

    def abort(self, messages: list[TileWritten | None]) -> None:
        for m in messages:
            for name, *_ in m.tiles if m else ():
                remove(f"{self.path}/{name}")


class PntsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "points_pnts"

    def schema(self):
        return PntsReader(self.options).point_schema().struct_type()

    def reader(self, schema) -> PntsReader:
        return PntsReader(self.options)

    def writer(self, schema, overwrite: bool) -> PntsWriter:
        return PntsWriter(self.options)


def read_pnts(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(PntsSource)
    return spark.read.format("points_pnts").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_pnts(points: DataFrame, path: str, rtc_center: tuple[float, float, float] | None = None) -> None:
    """A folder of tiles in index order with their tileset; attributes are cast to the tile's types, others are dropped."""
    schema = PointSchema.of_frame(points)
    out = []
    for _, a, _, _ in SEMANTICS:
        found = schema.find(a.name)
        if found and can_cast(found.type, a.type):
            out.append(point_cast(F.col(a.name), found.type, a.type).alias(a.name))
    if not any(schema.has_name(a.name) for _, a, _, _ in SEMANTICS[:1]):
        raise ValueError("tiles need positions")
    rows = points.select(POINT_IDX, *out).repartitionByRange(POINT_IDX).sortWithinPartitions(POINT_IDX).drop(POINT_IDX)
    points.sparkSession.dataSource.register(PntsSource)
    writer = rows.write.format("points_pnts").mode("append")
    (writer.option("rtcCenter", ",".join(map(str, rtc_center))) if rtc_center else writer).save(path)


def pnts_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each tile: its global values; tiles have no bounds of their own."""
    rows, paths = [], list_files(path, (".pnts",))
    for p, t in zip(paths, each(tile_head, paths), strict=True):
        one = lambda n, t=t: int(t.value(n)[0]) if n in t.features else None
        many = lambda n, t=t: [float(v) for v in t.value(n)] if n in t.features else None
        rows.append((p, t.length, many("RTC_CENTER"), many("QUANTIZED_VOLUME_OFFSET"), many("QUANTIZED_VOLUME_SCALE"), many("CONSTANT_RGBA"), one("BATCH_LENGTH")))
    return spark.createDataFrame(
        rows,
        "path string, points_length long, rtc_center array<double>, quantized_volume_offset array<double>, quantized_volume_scale array<double>, constant_rgba array<double>, batch_length long",
    )
