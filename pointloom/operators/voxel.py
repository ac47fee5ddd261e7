"""Voxel-grid downsampling: one point for each occupied cell, attributes reduced by kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..functions.schema import BUILTIN, POINT_IDX, PointSchema, spark_type
from .aggregates import POSITION, bounds

CELL = ("ix", "iy", "iz")
Reducer = Callable[[str], Column]


def mean_vector(name: str) -> Column:
    return F.struct(*[F.avg(F.col(name)[p].cast("double")).alias(p) for p in AXES])


def mean_vector_whole(name: str) -> Column:
    return F.struct(*[F.floor(F.avg(F.col(name)[p].cast("double"))).cast("int").alias(p) for p in AXES])


def mean_vector_single(name: str) -> Column:
    return F.struct(*[F.avg(F.col(name)[p].cast("double")).cast("float").alias(p) for p in AXES])


def mean_whole(name: str) -> Column:
    return F.floor(F.avg(F.col(name).cast("double"))).cast("int")


def most_common(name: str) -> Column:
    """The most frequent value, the smallest among equals."""
    return F.mode(F.col(name), True)


def most_common_flag(name: str) -> Column:
    return F.when(F.mode(F.col(name), True) != 0, 1).otherwise(0).cast("short")


def largest(name: str) -> Column:
    """The largest value, at least 0."""
    return F.greatest(F.max(F.col(name)), F.lit(0).cast(spark_type(BUILTIN[name].type)))


# How each built-in attribute is reduced.
REDUCERS: dict[str, Reducer] = {
    "Position3D": mean_vector,
    "Intensity": mean_whole,
    "ReturnNumber": most_common,
    "NumberOfReturns": most_common,
    "ClassificationFlags": largest,
    "ScannerChannel": most_common,
    "ScanDirectionFlag": most_common_flag,
    "EdgeOfFlightLine": most_common_flag,
    "Classification": most_common,
    "ScanAngleRank": most_common,
    "ScanAngle": most_common,
    "UserData": most_common,
    "PointSourceID": most_common,
    "ColorRGB": mean_vector_whole,
    "GpsTime": largest,
    "NIR": mean_whole,
    "PointID": largest,
    "Normal": mean_vector_single,
}


def voxel_cells(df: DataFrame, leaf: tuple[float, float, float]) -> DataFrame:
    """df with its cell (ix, iy, iz). Cells are centred on min + k * leaf, k >= 1, except that cell 0 reaches down to the minimum.

    The bounds are one row joined to all points, so the whole stays one lazy query of two jobs.
    """
    if any(not size > 0 for size in leaf):
        raise ValueError("leaf sizes must be positive")
    low = F.broadcast(bounds(df).select("min_x", "min_y", "min_z"))
    cell = lambda a, size: F.greatest(F.floor((F.col(POSITION)[a] - F.col(f"min_{a}")) / size - 0.5), F.lit(0)).cast("long")
    named = [cell(a, size).alias(c) for a, size, c in zip(AXES, leaf, CELL, strict=True)]
    return df.join(low).select(*df.columns, *named)


def voxel_counts(df: DataFrame, leaf: tuple[float, float, float]) -> DataFrame:
    return voxel_cells(df, leaf).groupBy(*CELL).agg(F.count("*").alias("n_points"))


def voxel_downsample(df: DataFrame, leaf: tuple[float, float, float], reducers: dict[str, Reducer] | None = None, index: bool = True) -> DataFrame:
    """One point for each occupied cell, in the order of cells (ix, iy, iz), which stay as columns.

    Attributes need their default type or a reducer of their own. index=False leaves out the numbering, which sorts the cells.
    """
    schema = PointSchema.of_frame(df)
    position = schema.find(POSITION)
    if position is None or position.type != "vec3f64":
        raise ValueError("positions of type vec3f64 are needed")
    chosen = {}
    for a in schema.attributes:
        reduce = (reducers or {}).get(a.name) or (REDUCERS.get(a.name) if BUILTIN.get(a.name) == a else None)
        if reduce is None:
            raise ValueError(f"no reducer for {a}")
        chosen[a.name] = reduce
    used = voxel_cells(df, leaf).select(*CELL, *chosen)
    out = used.groupBy(*CELL).agg(*[r(n).alias(n) for n, r in chosen.items()])
    if not index:
        return out
    from .frame import reindex

    return reindex(out.withColumn(POINT_IDX, F.lit(0).cast("long")), *[F.col(c) for c in CELL]).select(POINT_IDX, *CELL, *chosen)


