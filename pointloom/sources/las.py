"""LAS files as a Spark data source (`format("points_las")`), one partition for each range of point records.

Compressed files (.laz) are read and written too, beside others in one folder: their partitions are ranges of chunks, planned from the table of chunks
that each file carries, and a chunk is decoded by itself (laz_codec says which records have a codec; others raise).

Read options: pointsPerPartition, exact (stored instead of decoded attributes), columns (comma-separated attributes to keep: Spark
prunes no columns of Python sources). Filters on point_idx and on the position's coordinates are pushed: ranges of records and files
whose header bounds lie outside are not read, and Spark applies the filters to what is. The options minX .. maxZ skip files by their
bounds without filtering points. All files of a folder need the same attributes. Headers are read many at a time by the driver.
Writing streams records to the file system; a file's header is put before them in the end.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from ..functions.bits import BASIC_FLAGS, EXTENDED_FLAGS
from ..functions.casts import can_cast, default_value, point_cast
from ..functions.schema import BUILTIN, POINT_IDX, PointSchema
from . import las_format as las
from . import laz_codec as laz
from .files import Spool, each, list_files, make_folder, move, open_binary, remove, write_whole

POINTS_PER_PARTITION = 1_000_000
BATCH = 65_536


def is_compressed_path(path: str) -> bool:
    """By extension; other extensions than las and laz raise."""
    ending = path.lower().rsplit(".", 1)[-1]
    if ending not in ("las", "laz"):
        raise ValueError(f"{path}: neither .las nor .laz")
    return ending == "laz"


def file_header(path: str) -> las.Header:
    with open_binary(path) as f:
        head = f.read(375)
        point_at = struct.unpack_from("<I", head, 96)[0] if len(head) >= 100 else 0
        return las.read_header(head + f.read(max(0, point_at - len(head))))


def coding(header: las.Header) -> laz.Description:
    record = next((v for v in header.vlrs if v.user == laz.VLR_USER and v.record == laz.VLR_RECORD), None)
    if record is None:
        raise ValueError("compressed points without the record that describes their coding")
    found = laz.Description.unpack(record.data)
    found.check(header.fmt, header.dtype().itemsize - las.record_dtype(header.fmt).itemsize)
    return found


def chunks(path: str, header: las.Header) -> list[tuple[int, int, int]]:
    """(place in the file, bytes, points) of each chunk of a compressed file, from its table of chunks."""
    if not header.count:
        return []
    how = coding(header)
    with open_binary(path) as f:
        f.seek(header.point_at)
        (table_at,) = struct.unpack("<q", f.read(8))
        if table_at == -1:  # writers that can't go back put it last
            f.seek(f.size() - 8)
            (table_at,) = struct.unpack("<q", f.read(8))
        f.seek(table_at)
        head = f.read(8)
        table = head + f.read(16 + 9 * struct.unpack_from("<I", head, 4)[0])
    out, at, left = [], header.point_at + 8, header.count
    for points, size in laz.unpack_table(table, how.chunk_size == laz.WORD):
        points = min(how.chunk_size, left) if points < 0 else points
        out.append((at, size, points))
        at, left = at + size, left - points
    if left:
        raise ValueError(f"{path}: {header.count} points announced, the chunks hold {header.count - left}")
    return out


def decode(raw: np.ndarray, header: las.Header, schema: PointSchema, start: int) -> pa.RecordBatch:
    """Point records as an Arrow batch of a schema's attributes, with indices from `start`."""
    flags = las.is_extended(header.fmt)
    packed = {n: (s, (1 << b) - 1) for n, s, b in (EXTENDED_FLAGS if flags else BASIC_FLAGS)}
    vectors = {"ColorRGB": ("red", "green", "blue"), "WaveformParameters": ("wx", "wy", "wz")}
    columns, names = [pa.array(np.arange(start, start + len(raw)))], [POINT_IDX]
    wanted = schema.struct_type(False)
    for a, f in zip(schema.attributes, wanted.fields, strict=True):
        if a.name == "Position3D":
            parts = [raw[c] * s + o for c, s, o in zip("xyz", header.scale, header.offset, strict=True)]
            column = pa.StructArray.from_arrays([pa.array(p) for p in parts], list("xyz"))
        elif a.name == "LASLocalPosition":
            column = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(raw[c])) for c in "xyz"], list("xyz"))
        elif a.name in ("LASBasicFlags", "LASExtendedFlags"):
            column = pa.array(raw["flags"].astype(np.int32 if flags else np.int16))
        elif a.name in packed and a.name not in raw.dtype.names:
            shift, mask = packed[a.name]
            column = pa.array((raw["flags"] >> shift & mask).astype(np.int16))
        elif a.name in vectors:
            wide = np.int32 if a.name == "ColorRGB" else np.float32
            column = pa.StructArray.from_arrays([pa.array(raw[c].astype(wide)) for c in vectors[a.name]], list("xyz"))
        elif a.type.startswith("bytes"):
            column = pa.array([bytes(b) for b in raw[a.name]], pa.binary())
        elif a.type == "u64":
            column = pa.array([int(v) for v in raw[a.name]], pa.decimal128(20, 0))
        else:
            widened = {"u8": np.int16, "u16": np.int32, "u32": np.int64}.get(a.type)
            column = pa.array(raw[a.name].astype(widened) if widened else np.ascontiguousarray(raw[a.name]))
        columns.append(column)
        names.append(f.name)
    return pa.RecordBatch.from_arrays(columns, names)


class Range(InputPartition):
    """Points start to end of a file, the first of them with index `first`; of a compressed file with its chunks (place, bytes, points, first point)."""

    def __init__(self, path: str, start: int, end: int, first: int, chunks: list[tuple[int, int, int, int]] = ()):
        self.path, self.start, self.end, self.first, self.chunks = path, start, end, first, chunks


def chunk_ranges(path: str, table: list[tuple[int, int, int]], start: int, end: int, first: int, step: int) -> Iterator[Range]:
    """Ranges of whole chunks, `step` points or one chunk each, that cover points start to end of a file whose first point has index `first`."""
    held, at = [], 0
    for i, (place, size, points) in enumerate(table):
        if at < end and at + points > start:
            held.append((place, size, points, at))
        at += points
        if held and (at - held[0][3] + (table[i + 1][2] if i + 1 < len(table) else step) > step or at >= end):
            low = max(start, held[0][3])
            yield Range(path, low, min(end, at), first + low, held)
            held = []


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.paths = list_files(options["path"], (".las", ".laz"))
        for p in self.paths:
            is_compressed_path(p)
        self.exact = options.get("exact", "false").lower() == "true"
        # Closed ranges that points must lie in: of the index, and of the coordinates.
        self.limits = {name: [-float("inf"), float("inf")] for name in (POINT_IDX, *"xyz")}
        for axis in "xyz":
            low, high = options.get(f"min{axis.upper()}"), options.get(f"max{axis.upper()}")
            self.narrow(axis, low if low is None else float(low), high if high is None else float(high))

    def narrow(self, name: str, low: float | None, high: float | None) -> None:
        limits = self.limits[name]
        if low is not None:
            limits[0] = max(limits[0], low)
        if high is not None:
            limits[1] = min(limits[1], high)

    def schema(self) -> PointSchema:
        schema = file_header(self.paths[0]).schema(self.exact)
        if self.options.get("columns"):
            kept = [c.strip() for c in self.options["columns"].split(",")]
            missing = [c for c in kept if not schema.has_name(c)]
            if missing:
                raise ValueError(f"no attributes {missing}")
            schema = PointSchema(tuple(a for a in schema.attributes if a.name in kept), schema.packed)
        return schema

    def outside(self, header: las.Header) -> bool:
        """Whether the header's bounds, which writers may have rounded, are off the limits by more than a step of the grid."""
        low, high, step = header.bounds[:3], header.bounds[3:], [abs(s) for s in header.scale]
        return any(high[i] + step[i] < self.limits[a][0] or low[i] - step[i] > self.limits[a][1] for i, a in enumerate("xyz"))

    def partitions(self) -> list[Range]:
        step = int(self.options.get("pointsPerPartition", POINTS_PER_PARTITION))
        low, high = self.limits[POINT_IDX]
        out, first = [], 0
        headers = each(file_header, self.paths)
        layout = headers[0].schema(self.exact)
        packed = [(p, h) for p, h in zip(self.paths, headers, strict=True) if h.compressed and not self.outside(h)]
        tables = dict(zip([p for p, _ in packed], each(lambda x: chunks(*x), packed), strict=True))
        for path, header in zip(self.paths, headers, strict=True):
            if not header.schema(self.exact).same_attributes(layout):
                raise ValueError(f"{path}: its attributes differ from those of {self.paths[0]}; read files of different formats apart")
            if not self.outside(header):
                start, end = (int(min(max(0, v), header.count)) for v in (low - first, high + 1 - first))
                if header.compressed:
                    out += chunk_ranges(path, tables[path], start, end, first, step)
                else:
                    out += [Range(path, s, min(s + step, end), first + s) for s in range(start, end, step)]
            first += header.count
        return out or [Range(self.paths[0], 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        header, schema = file_header(partition.path), self.schema()
        dtype = header.dtype()
        with open_binary(partition.path) as f:
            for place, size, points, begin in partition.chunks:
                f.seek(place)
                low, high = max(partition.start, begin), min(partition.end, begin + points)
                raw = laz.decode_chunk(f.read(size), high - begin, dtype, header.fmt, points)[low - begin :]
                yield decode(raw, header, schema, partition.first + low - partition.start)
            if partition.chunks:
                return
            f.seek(header.point_at + partition.start * dtype.itemsize)
            for at in range(partition.start, partition.end, BATCH):
                n = min(BATCH, partition.end - at)
                data = f.read(n * dtype.itemsize)
                if len(data) < n * dtype.itemsize:
                    raise ValueError(f"{partition.path}: {header.count} points announced, the file ends before")
                yield decode(np.frombuffer(data, dtype), header, schema, partition.first + at - partition.start)


class PushingLasReader(LasReader):
    """Reads no more than filters on the index and the coordinates need."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            name = {(POINT_IDX,): POINT_IDX} | {("Position3D", a): a for a in "xyz"}
            if (at := name.get(getattr(f, "attribute", None))) is not None and not (at in "xyz" and self.exact):
                if isinstance(f, In):
                    values = [v for v in f.value if v is not None]
                    self.narrow(at, *((min(values), max(values)) if values else (float("inf"), -float("inf"))))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.narrow(at, f.value, None)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.narrow(at, None, f.value)
                elif isinstance(f, EqualTo):
                    self.narrow(at, f.value, f.value)
            yield f  # ranges are kept whole, so Spark filters their points


class Part(WriterCommitMessage):
    def __init__(self, path: str, count: int):
        self.path, self.count = path, count


class LasWriter(DataSourceArrowWriter):
    """One file for each partition, in the point format of options; rows hold the stored (exact) attributes."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.scale = tuple(float(v) for v in options.get("scale", "0.001,0.001,0.001").split(","))
        self.offset = tuple(float(v) for v in options.get("offset", "0,0,0").split(","))
        pairs = [p.rpartition(":") for p in options.get("extra", "").split(",") if p]
        self.extra = [(name, kind) for name, _, kind in pairs]
        if 0.0 in self.scale:
            raise ValueError("a scale of zero")
        #: Points of a chunk of compressed files, 0 for others.
        self.chunk = int(options.get("chunkSize", laz.CHUNK_SIZE)) if options.get("compressed", "false").lower() == "true" else 0
        if self.chunk < 0:
            raise ValueError("chunks hold at least one point")

    @property
    def ending(self) -> str:
        return "laz" if self.chunk else "las"

    def place(self, partition: int) -> str:
        """One name for each partition, whichever attempt writes it: a lost task's file is replaced whole."""
        return f"{self.options['path'].rstrip('/')}/part-{partition:05d}.{self.ending}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        fmt = int(self.options["pointFormat"])
        dtype = las.record_dtype(fmt, self.extra)
        vlrs = [las.Vlr(las.VLR_USER, las.EXTRA_BYTES, b"".join(las.ExtraField(n, t).pack() for n, t in self.extra))] if self.extra else []
        if self.chunk:
            how = laz.Description.of(fmt, dtype.itemsize - las.record_dtype(fmt).itemsize, self.chunk)
            vlrs.append(las.Vlr(laz.VLR_USER, laz.VLR_RECORD, how.pack(), "chunks of coded points"))
        low, high = np.full(3, np.inf), np.full(3, -np.inf)
        counts, total = np.zeros(15, np.int64), 0
        bits = 15 if las.is_extended(fmt) else 7
        path = self.place(TaskContext.get().partitionId())
        spool = Spool(path)
        waiting, sizes = np.zeros(0, dtype), []

        def put(records: np.ndarray) -> None:
            data = laz.encode_chunk(records, fmt) if self.chunk else records.tobytes()
            sizes.append(len(data))
            spool.write(data)

        for batch in batches:
            raw = np.zeros(batch.num_rows, dtype)
            for name in dtype.names:
                raw[name] = np.asarray(batch.column(name).to_numpy(zero_copy_only=False)).astype(dtype[name])
            if self.chunk:
                waiting = np.concatenate([waiting, raw])
                while len(waiting) >= self.chunk:
                    put(waiting[: self.chunk])
                    waiting = waiting[self.chunk :]
            else:
                put(raw)
            if len(raw):
                local = np.stack([raw[c] for c in "xyz"]).astype(float)
                low, high = np.minimum(low, local.min(1)), np.maximum(high, local.max(1))
                counts += np.bincount(raw["flags"] & bits, minlength=16)[1:16]
                total += len(raw)
        world = lambda v: tuple(float(c) * s + o for c, s, o in zip(v if total else (0, 0, 0), self.scale, self.offset, strict=True))
        header = las.Header((1, 4), fmt, dtype.itemsize, total, 375, self.scale, self.offset, world(low) + world(high), counts.tolist(), vlrs, bool(self.chunk), software="pointloom")
        head = las.pack_header(header)
        if self.chunk:
            if len(waiting):
                put(waiting)
            head += struct.pack("<q", len(head) + 8 + sum(sizes))
            spool.write(laz.pack_table(sizes))
        spool.finish(head)
        return Part(path, total)

    def commit(self, messages: list[Part | None]) -> None:
        """Empty files go, unless all are empty: then one stays to carry the schema."""
        done = [m for m in messages if m]
        some = any(m.count for m in done)
        for i, m in enumerate(done):
            if not m.count and (some or i):
                remove(m.path)

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m:
                remove(m.path)


class LasStream(DataSourceStreamReader):
    """Files that arrive in a folder. An offset is a number of files of a log, which the reader keeps in the folder of the option `log`: which files have been seen,
    in which order, and the index of each one's first point. So a query that starts again reads each record once, whatever has arrived meanwhile.

    A trigger reads all files that are there; ranges of their records are its partitions. Files must be moved into the folder whole, and one must be there at
    the start, to give the schema.
    """

    def __init__(self, options: dict):
        if not options.get("log"):
            raise ValueError("a stream of files needs the option log, a folder for what has been read")
        self.points, self.path, self.log = LasReader(options), options["path"], options["log"].rstrip("/")
        self.seen: list[tuple[str, int, int]] | None = None

    def entries(self) -> list[tuple[str, int, int]]:
        """(path, points, index of the first) of all files of the log."""
        if self.seen is None:
            make_folder(self.log)
            self.seen = []
            for name in list_files(self.log, (".json",)):
                with open_binary(name) as f:
                    self.seen += [tuple(e) for e in json.loads(f.read())]
        return self.seen

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        seen = self.entries()
        known = {e[0] for e in seen}
        paths = [p for p in list_files(self.path, (".las", ".laz")) if p not in known]
        if paths:
            new, layout = [], self.points.schema()
            first = seen[-1][1] + seen[-1][2] if seen else 0
            for p, header in zip(paths, each(file_header, paths), strict=True):
                if not self.points.options.get("columns") and not header.schema(self.points.exact).same_attributes(layout):
                    raise ValueError(f"{p}: its attributes differ from those the stream began with")
                new.append((p, header.count, first))
                first += header.count
            write_whole(f"{self.log}/{len(seen):012d}.json", json.dumps(new).encode())
            seen += new
        return {"files": len(seen)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        step = int(self.points.options.get("pointsPerPartition", POINTS_PER_PARTITION))
        some = self.entries()[start["files"] : end["files"]]
        out: list[Range] = []
        for (path, count, first), header in zip(some, each(file_header, [e[0] for e in some]), strict=True):
            if header.compressed:
                out += chunk_ranges(path, chunks(path, header), 0, count, first, step)
            else:
                out += [Range(path, s, min(s + step, count), first + s) for s in range(0, count, step)]
        return out or [Range(self.points.paths[0], 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.points.read(partition)


class LasStreamWriter(DataSourceStreamArrowWriter):
    """Each batch's files are written aside and moved into place under the batch's number when it commits; committing it again replaces them."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.files = LasWriter(options, schema, overwrite)
        self.files.place = lambda _: f"{self.path}/_arriving/{uuid4().hex}.{self.files.ending}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        return self.files.write(batches)

    def commit(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        begin = f"batch-{batchId:010d}-"
        make_folder(self.path)
        for old in list_files(self.path, (".las", ".laz")):
            if old.rsplit("/", 1)[-1].startswith(begin):
                remove(old)
        for i, m in enumerate(m for m in messages if m):
            if m.count:
                move(m.path, f"{self.path}/{begin}{i:05d}.{self.files.ending}")
            else:
                remove(m.path)

    def abort(self, messages: list[Part | None], batchId: int) -> None:  # noqa: N803
        self.files.abort(messages)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "points_las"

    def schema(self):
        return LasReader(self.options).schema().struct_type()

    def reader(self, schema) -> LasReader:
        return (PushingLasReader if self.options.get("pushdown", "false").lower() == "true" else LasReader)(self.options)

    def writer(self, schema, overwrite: bool) -> LasWriter:
        return LasWriter(self.options, schema, overwrite)

    def streamReader(self, schema) -> LasStream:  # noqa: N802
        return LasStream(self.options)

    def streamWriter(self, schema, overwrite: bool) -> LasStreamWriter:  # noqa: N802
        return LasStreamWriter(self.options, schema, overwrite)


def read_las(spark: SparkSession, path: str, **options) -> DataFrame:
    """Points of a file or folder. Filters are pushed unless pushdown=False; that needs a Spark setting, which is turned on for the session."""
    spark.dataSource.register(LasSource)
    if str(options.setdefault("pushdown", True)).lower() == "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("points_las").options(**{k: str(v) for k, v in options.items()}).load(path)


def las_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: version, format, count, bounds, scale, offset, by-return counts and named records."""
    rows, paths = [], list_files(path, (".las", ".laz"))
    for p, h in zip(paths, each(file_header, paths), strict=True):
        find = lambda k, h=h: next((v for v in h.vlrs if v.user == las.VLR_USER and v.record == k), None)
        lookup, text = find(las.CLASS_LOOKUP), find(las.TEXT_AREA)
        rows.append((p, f"{h.version[0]}.{h.version[1]}", h.fmt, h.count, list(h.bounds), list(h.scale), list(h.offset), h.by_return, h.system, h.software, las.class_lookup(lookup) if lookup else {}, las.text_area(text) if text else None, [(e.name, e.type, e.scale, e.offset, e.description) for e in h.described]))
    schema = (
        "path string, version string, point_format int, point_count long, bounds array<double>, scale array<double>, offset array<double>, points_by_return array<long>, "
        "system_id string, software string, class_names map<int,string>, text string, extra_fields array<struct<name:string,type:string,scale:double,offset:double,description:string>>"
    )
    return spark.createDataFrame(rows, schema)


def crs_text(path: str) -> str | None:
    """What a file says about its coordinate system: its WKT, or "EPSG:" and the number of its keys, as reproject takes them; None if nothing."""
    records = {v.record: v.data for v in file_header(path).vlrs if v.user == "LASF_Projection"}
    if 2112 in records:
        return records[2112].split(b"\0")[0].decode("utf-8", "replace")
    if 34735 in records:
        keys = np.frombuffer(records[34735][: len(records[34735]) // 8 * 8], "<u2").reshape(-1, 4)[1:]
        found = {int(k): int(v) for k, where, _, v in keys if where == 0}
        code = next((found[k] for k in (3072, 2048) if 0 < found.get(k, 0) < 32767), None)  # projected, then geographic
        return code and f"EPSG:{code}"
    return None


def stored_columns(points: DataFrame, fmt: int, scale, offset, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Points as the fields of a format's records, extra attributes after them. Other attributes are dropped, missing ones are zero."""
    from ..functions.bits import pack
    from ..functions.geometry import local_position

    schema = PointSchema.of_frame(points)

    def value(name: str):
        a = schema.find(name)
        if a is None:
            return default_value(BUILTIN[name].type)
        if not can_cast(a.type, BUILTIN[name].type):
            raise ValueError(f"no conversion from {a} to {BUILTIN[name]}")
        return point_cast(F.col(name), a.type, BUILTIN[name].type)

    place = local_position(value("Position3D"), scale, offset)
    vectors = {"red": ("ColorRGB", "x"), "green": ("ColorRGB", "y"), "blue": ("ColorRGB", "z"), "wx": ("WaveformParameters", "x"), "wy": ("WaveformParameters", "y"), "wz": ("WaveformParameters", "z")}
    out = []
    parts = EXTENDED_FLAGS if las.is_extended(fmt) else BASIC_FLAGS
    kinds = dict(extra)
    for name in las.record_dtype(fmt, extra).names:
        if name in kinds:
            out.append((F.col(name).cast("long") if kinds[name] == "u64" else F.col(name)).alias(name))
        elif name in "xyz":
            out.append(place[name].alias(name))
        elif name == "flags":
            out.append(pack({n: value(n) for n, _, _ in parts}, parts).alias(name))
        elif name in vectors:
            out.append(value(vectors[name][0])[vectors[name][1]].alias(name))
        else:
            column = value(name)
            out.append((column.cast("long") if name == "WaveformDataOffset" else column).alias(name))
    return points.select(POINT_IDX, *out)


def write_las(points: DataFrame, path: str, fmt: int | None = None, scale=(0.001, 0.001, 0.001), offset=(0.0, 0.0, 0.0), extra: tuple[str, ...] = (), compressed: bool = False, chunk_size: int = laz.CHUNK_SIZE) -> None:
    """A folder of LAS 1.4 files in index order; the format follows from the attributes unless given.

    compressed: .laz files of chunks of chunk_size points; not with waveforms. extra names scalar attributes that no format has; they are stored as described extra bytes.
    """
    rows, options = _stored(points, fmt, scale, offset, extra, compressed, chunk_size)
    rows = rows.repartitionByRange(POINT_IDX).sortWithinPartitions(POINT_IDX)
    rows.write.format("points_las").options(**options).mode("append").save(path)


def _stored(points: DataFrame, fmt: int | None, scale, offset, extra: tuple[str, ...], compressed: bool, chunk_size: int) -> tuple[DataFrame, dict]:
    """The records' fields of points and the options of their writer."""
    schema = PointSchema.of_frame(points)
    fmt = las.best_format(schema) if fmt is None else fmt
    if 0.0 in scale:
        raise ValueError("a scale of zero")
    pairs = []
    for name in extra:
        a = schema.find(name)
        if a is None or a.type not in las.NUMPY:
            raise ValueError(f"no scalar attribute {name!r}")
        pairs.append((name, a.type))
    if compressed:
        laz.Description.of(fmt, 0, chunk_size)  # raises where there is no codec
    points.sparkSession.dataSource.register(LasSource)
    join = lambda v: ",".join(map(repr, map(float, v)))
    options = {"pointFormat": fmt, "scale": join(scale), "offset": join(offset), "compressed": str(compressed).lower(), "chunkSize": chunk_size, "extra": ",".join(f"{n}:{t}" for n, t in pairs)}
    return stored_columns(points, fmt, scale, offset, pairs), {k: str(v) for k, v in options.items()}


def stream_las(spark: SparkSession, path: str, log: str, **options) -> DataFrame:
    """Points of files that arrive in a folder, as a stream; log: a folder of its own in shared storage for what has been read."""
    spark.dataSource.register(LasSource)
    return spark.readStream.format("points_las").options(log=log, **{k: str(v) for k, v in options.items()}).load(path)


def write_las_stream(points: DataFrame, path: str, checkpoint: str, fmt: int | None = None, scale=(0.001, 0.001, 0.001), offset=(0.0, 0.0, 0.0), extra: tuple[str, ...] = (), compressed: bool = False, chunk_size: int = laz.CHUNK_SIZE):
    """The writer of a stream of points into a folder of files, each batch's once; the caller sets a trigger and starts it."""
    rows, options = _stored(points, fmt, scale, offset, extra, compressed, chunk_size)
    return rows.writeStream.format("points_las").options(**options).option("path", path).option("checkpointLocation", checkpoint)


def write_laz(points: DataFrame, path: str, **options) -> None:
    """write_las with compressed points."""
    write_las(points, path, compressed=True, **options)


def las_bytes(header: las.Header, records: np.ndarray) -> bytes:
    """A whole file in memory, for small files and tests."""
    return las.pack_header(header) + records.tobytes()
