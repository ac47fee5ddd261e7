"""Point-table operators: projection, ranges, filters, edits, concatenation, order. All keep point_idx meaningful."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.casts import default_value, point_cast
from ..functions.schema import POINT_IDX, Attribute, PointSchema
from .materialize import stable


def idx() -> Column:
    return F.col(POINT_IDX)


def require(df: DataFrame, name: str) -> Attribute:
    found = PointSchema.of_frame(df).find(name)
    if found is None:
        raise ValueError(f"no attribute {name!r}")
    return found


def point_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_points"))


def view_attribute(df: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """(point_idx, attribute), cast to another point type if asked; the attribute must exist, and without a cast as it is."""
    a = require(df, name)
    return df.select(idx(), point_cast(F.col(name), a.type, kind or a.type).alias(name))


def attribute_range(df: DataFrame, name: str, start: int, end: int, kind: str | None = None) -> DataFrame:
    """(point_idx, attribute) of the points [start, end), cast if asked."""
    return slice_points(view_attribute(df, name, kind), start, end, reindex=False)


def get_point(df: DataFrame, index: int) -> DataFrame:
    return df.where(idx() == index)


def seek(df: DataFrame, index: int) -> DataFrame:
    """Points from an index on; indices below 0 are an error, those beyond the end give no points."""
    if index < 0:
        raise ValueError("cannot seek before the first point")
    return df.where(index <= idx())


def slice_points(df: DataFrame, start: int, end: int, reindex: bool = True) -> DataFrame:
    """Points [start, end), numbered from 0 unless reindex is off. An end before the start gives none."""
    if start < 0:
        raise ValueError("slice out of range")
    out = df.where((start <= idx()) & (end > idx()))
    return out.withColumn(POINT_IDX, idx() - start) if reindex else out


def take(df: DataFrame, n: int) -> DataFrame:
    """The first n points by index: a top-n, no global sort."""
    return df.orderBy(POINT_IDX).limit(n)


def filter_points(df: DataFrame, keep: Column) -> DataFrame:
    """Points that satisfy a predicate over attributes or point_idx; they keep their numbers (see reindex)."""
    return df.where(keep)


def reindex(df: DataFrame, *order: Column) -> DataFrame:
    """Consecutive numbers from 0 in the given order (point_idx by default), without moving all points to one task.

    Points are range-partitioned by the order and numbered inside their partition; only one count for each partition goes through
    a window. Ties fall back on the old index, so a sort by any key is stable.
    """
    keys = [*order, idx()]
    # Computed once: the ranges are sampled, so a second computation of the counts could see other partitions.
    parted = stable(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    counts = parted.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = parted.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row for each partition
    return joined.select((F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(POINT_IDX), *[c for c in df.columns if c != POINT_IDX])


def sort_by(df: DataFrame, *order: Column) -> DataFrame:
    """Stable sort: points numbered in the new order."""
    return reindex(df, *order)


def transform_attribute(df: DataFrame, name: str, change: Callable[[Column, Column], Column]) -> DataFrame:
    """attribute = change(point_idx, attribute), kept in the attribute's type."""
    a = require(df, name)
    return df.withColumn(name, change(idx(), F.col(name)).cast(df.schema[name].dataType)).withMetadata(name, {"point_type": a.type})


def set_at(df: DataFrame, index: int, values: dict[str, Column]) -> DataFrame:
    for name, value in values.items():
        require(df, name)
        df = df.withColumn(name, F.when(index == idx(), value.cast(df.schema[name].dataType)).otherwise(F.col(name)))
    return df


def swap(df: DataFrame, i: int, j: int) -> DataFrame:
    """Two points change places."""
    return df.withColumn(POINT_IDX, F.when(i == idx(), F.lit(j)).when(j == idx(), F.lit(i)).otherwise(idx()).cast("long"))


def zero_points(df: DataFrame, start: int, end: int) -> DataFrame:
    schema = PointSchema.of_frame(df)
    empty = df.sparkSession.range(start, max(start, end)).withColumnRenamed("id", POINT_IDX)
    return empty.select(POINT_IDX, *[default_value(a.type).alias(a.name, metadata={"point_type": a.type}) for a in schema.attributes])


def resize(df: DataFrame, n: int, current: int | None = None) -> DataFrame:
    """The first n points, with zero points at the end where there are fewer. The count is read unless given."""
    current = df.count() if current is None else current
    kept = df.where(n > idx())
    return kept if n <= current else kept.unionByName(zero_points(df, current, n))


def clear(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def append(df: DataFrame, other: DataFrame, length: int | None = None) -> DataFrame:
    """other's points after df's; both need the same attributes. The length of df is read unless given."""
    if not PointSchema.of_frame(df).same_attributes(PointSchema.of_frame(other)):
        raise ValueError("layouts differ")
    if length is None:
        length = df.agg(F.coalesce(F.max(POINT_IDX) + 1, F.lit(0))).first()[0]
    return df.unionByName(other.withColumn(POINT_IDX, idx() + length))


def write_at(df: DataFrame, other: DataFrame, at: int) -> DataFrame:
    """df with other's points in place of those from index `at` on, and beyond its end where there are more."""
    if at < 0:
        raise ValueError("cannot write before the first point")
    if not PointSchema.of_frame(df).same_attributes(PointSchema.of_frame(other)):
        raise ValueError("layouts differ")
    fresh = other.withColumn(POINT_IDX, (idx() + at).cast("long"))
    return df.join(fresh.select(POINT_IDX), POINT_IDX, "left_anti").unionByName(fresh)


def equal_points(df: DataFrame, other: DataFrame) -> DataFrame:
    """One row `equal`: the same indices with the same values of the same attributes. One full outer join on the index."""
    if not PointSchema.of_frame(df).same_attributes(PointSchema.of_frame(other)):
        return df.sparkSession.range(1).select(F.lit(False).alias("equal"))
    names = [c for c in df.columns if c != POINT_IDX]
    pack = lambda d, to: d.select(POINT_IDX, F.struct(*names).alias(to))
    both = pack(df, "a").join(pack(other, "b"), POINT_IDX, "full_outer")
    return both.agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("equal"))


def in_memory(spark, schema: PointSchema, rows: list[tuple]) -> DataFrame:
    """A points table of Python rows, numbered in order; vectors are tuples."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema.struct_type())
