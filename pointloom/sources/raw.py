"""Binary records of a point schema, without any header, as a Spark data source (`format("points_raw")`).

A file is records one after the other, laid out as the schema's offsets say (packed or aligned), little-endian. Reading needs the schema
as JSON (option schema, and packed for its alignment) and splits files into ranges of records (pointsPerPartition); writing gives
one file for each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions.schema import POINT_IDX, VECTORS, PointSchema, parse_type
from .files import Spool, each, list_files, open_binary, remove, system_of
from .las_format import NUMPY

POINTS_PER_PARTITION, BATCH = 1_000_000, 65_536


def attribute_dtype(kind: str) -> np.dtype:
    base, size = parse_type(kind)
    if base in NUMPY:
        return np.dtype(NUMPY[base])
    return np.dtype((NUMPY[VECTORS[base][0]], len(VECTORS[base][1]))) if base in VECTORS else np.dtype(f"V{size}")


def record_dtype(schema: PointSchema) -> np.dtype:
    names = [a.name for a in schema.attributes]
    return np.dtype({"names": names, "formats": [attribute_dtype(a.type) for a in schema.attributes], "offsets": schema.offsets(), "itemsize": schema.size})


def to_arrow(values: np.ndarray, kind: str) -> pa.Array:
    base, _ = parse_type(kind)
    if base in VECTORS:
        inner, parts = VECTORS[base]
        return pa.StructArray.from_arrays([to_arrow(values[:, i], inner) for i in range(len(parts))], list(parts))
    if base == "u64":
        return pa.array([int(v) for v in values], pa.decimal128(20, 0))
    if base not in NUMPY:
        return pa.array([bytes(v) for v in values], pa.binary())
    wide = {"u8": np.int16, "u16": np.int32, "u32": np.int64}.get(base)
    return pa.array(values.astype(wide) if wide else np.ascontiguousarray(values))


def from_arrow(column: pa.Array, kind: str) -> np.ndarray:
    base, size = parse_type(kind)
    if base in VECTORS:
        return np.stack([from_arrow(c, VECTORS[base][0]) for c in column.flatten()], 1)
    if base not in NUMPY:
        return np.array([bytes(v.as_py()).ljust(size, b"\0")[:size] for v in column], f"V{size}")
    values = np.array([int(v.as_py()) for v in column], np.uint64) if base == "u64" else column.to_numpy(zero_copy_only=False)
    return values.astype(NUMPY[base])


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int):
        self.path, self.start, self.end, self.first = path, start, end, first


def schema_of(options: dict) -> PointSchema:
    packed = int(options.get("packed", "0"))
    return PointSchema(PointSchema.from_json(options["schema"]).attributes, packed or None)


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.schema = options, schema_of(options)
        self.paths = list_files(options["path"], (".bin",))

    def partitions(self) -> list[Range]:
        def count(path: str) -> int:
            system, inner = system_of(path)
            n, rest = divmod(system.get_file_info(inner).size, self.schema.size)
            if rest:
                raise ValueError(f"{path}: its size is no multiple of a record's {self.schema.size} bytes")
            return n

        step = int(self.options.get("pointsperpartition", self.options.get("pointsPerPartition", POINTS_PER_PARTITION)))
        out, first = [], 0
        for path, n in zip(self.paths, each(count, self.paths), strict=True):
            out += [Range(path, s, min(s + step, n), first + s) for s in range(0, n, step)]
            first += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        dtype = record_dtype(self.schema)
        names = [POINT_IDX, *dtype.names]
        with open_binary(partition.path) as f:
            f.seek(partition.start * dtype.itemsize)
            for at in range(partition.start, partition.end, BATCH):
                raw = np.frombuffer(f.read(min(BATCH, partition.end - at) * dtype.itemsize), dtype)
                first = partition.first + at - partition.start
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(raw))), *[to_arrow(raw[a.name], a.type) for a in self.schema.attributes]], names)


class Written(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class RawWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.schema = options["path"].rstrip("/"), schema_of(options)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        dtype = record_dtype(self.schema)
        spool = Spool(f"{self.path}/part-{TaskContext.get().partitionId():05d}.bin")
        for batch in batches:
            raw = np.zeros(batch.num_rows, dtype)
            for a in self.schema.attributes:
                raw[a.name] = from_arrow(batch.column(a.name), a.type)
            spool.write(raw.tobytes())
        spool.finish(b"")
        return Written(spool.path)

    def commit(self, messages: list[Written | None]) -> None:
        pass

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                remove(m.path)


class RawSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "points_raw"

    def schema(self) -> T.StructType:
        return schema_of(self.options).struct_type()

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options)


def read_raw(spark: SparkSession, path: str, schema: PointSchema, **options) -> DataFrame:
    """Points of a file, or of a folder's .bin files in name order."""
    spark.dataSource.register(RawSource)
    reader = spark.read.format("points_raw").option("schema", schema.json()).option("packed", schema.packed or 0)
    return reader.options(**{k: str(v) for k, v in options.items()}).load(path)


def write_raw(points: DataFrame, path: str, packed: int | None = None) -> PointSchema:
    """A folder of record files in index order; the schema of the records, with this alignment, is returned."""
    schema = PointSchema(PointSchema.of_frame(points).attributes, packed)
    points.sparkSession.dataSource.register(RawSource)
    rows = points.repartitionByRange(POINT_IDX).sortWithinPartitions(POINT_IDX).select(*[a.name for a in schema.attributes])
    rows.write.format("points_raw").option("schema", schema.json()).option("packed", packed or 0).mode("append").save(path)
    return schema


def raw_attribute(points: DataFrame, name: str) -> DataFrame:
    """(point_idx, attribute as the bytes of its record): an attribute without its type."""
    a = PointSchema.of_frame(points).find(name)
    if a is None:
        raise ValueError(f"no attribute {name!r}")

    def packed(value: Column) -> Column:
        @F.pandas_udf(T.BinaryType())
        def run(batch: pd.DataFrame) -> pd.Series:
            columns = [from_arrow(pa.array(batch[c], from_pandas=True), inner) for c in batch.columns]
            return pd.Series([row.tobytes() for row in np.stack(columns, 1)])

        base, _ = parse_type(a.type)
        inner = VECTORS[base][0] if base in VECTORS else base
        whole = F.struct(*[value[p].alias(p) for p in VECTORS[base][1]]) if base in VECTORS else F.struct(value.alias("x"))
        return value if base not in VECTORS and base not in NUMPY else run(whole)

    return points.select(POINT_IDX, packed(F.col(name)).alias(name))
