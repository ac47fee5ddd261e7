"""Aggregates of points. Each is one partial-to-final aggregation; nothing but a few numbers for each task is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..functions.schema import VECTORS, PointSchema

POSITION = "Position3D"


def components(df: DataFrame, name: str) -> list[tuple[str, Column]]:
    """(suffix, column) of an attribute's components; a scalar's suffix is empty."""
    found = PointSchema.of_frame(df).find(name)
    if found is None:
        raise ValueError(f"no attribute {name!r}")
    return [(f"_{p}", F.col(name)[p]) for p in VECTORS[found.type][1]] if found.type in VECTORS else [("", F.col(name))]


def numbers_only(c: Column, kind: str) -> Column:
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


def bounds(df: DataFrame, position: str = POSITION) -> DataFrame:
    """min_x .. max_z of the positions as doubles: NaN coordinates don't count, no points give nulls."""
    parts = []
    for p in AXES:
        c = F.col(position)[p].cast("double")
        c = F.when(~F.isnan(c), c)
        parts += [F.min(c).alias(f"min_{p}"), F.max(c).alias(f"max_{p}")]
    return df.agg(*parts)


def minmax(df: DataFrame, name: str) -> DataFrame:
    """Smallest and largest value of an attribute, by component; NaN doesn't count, no points give nulls."""
    out = []
    for suffix, c in components(df, name):
        kind = df.select(c.alias("c")).schema["c"].dataType.typeName()
        out += [F.min(numbers_only(c, kind)).alias(f"min{suffix}"), F.max(numbers_only(c, kind)).alias(f"max{suffix}")]
    return df.agg(*out)


def centroid(df: DataFrame, position: str = POSITION) -> DataFrame:
    """Mean position. With a NaN anywhere only points of finite coordinates count; without one all do, infinite ones too."""
    p = {a: F.col(position)[a].cast("double") for a in AXES}
    any_nan = F.lit(False)
    finite = F.lit(True)
    for c in p.values():
        any_nan = any_nan | F.isnan(c)
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    means = [F.struct(F.avg(c).alias("all"), F.avg(F.when(finite, c)).alias("finite")).alias(a) for a, c in p.items()]
    return df.agg(F.max(any_nan).alias("nan"), *means).select(*[F.when(F.col("nan"), F.col(a)["finite"]).otherwise(F.col(a)["all"]).alias(a) for a in AXES])


PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def covariance(df: DataFrame, position: str = POSITION) -> DataFrame:
    """Scatter sums about the centroid, not divided by the count, over finite points; fewer than three of them raise.

    covar_pop is computed by merging centred moments, so one pass is stable however far the points are from the origin.
    """
    p = {a: F.col(position)[a].cast("double") for a in AXES}
    finite = F.lit(True)
    for c in p.values():
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    n = F.count(F.when(finite, F.lit(1)))
    sums = [(F.covar_pop(F.when(finite, p[a]), F.when(finite, p[b])) * n).alias(a + b) for a, b in PAIRS]
    out = df.agg(n.alias("n"), *sums)
    checked = F.when(F.col("n") >= 3, F.col("n")).otherwise(F.raise_error(F.lit("covariance needs three valid points")).cast("long"))
    return out.select(checked.alias("n"), *PAIRS)


def return_histogram(df: DataFrame, bins: int = 5, name: str = "ReturnNumber") -> DataFrame:
    """Points of each return number from 1 to `bins`, zeros included; other numbers don't count."""
    counts = df.where(F.col(name).between(1, bins)).groupBy(F.col(name).cast("int").alias("return_number")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("return_number"))
    return every.join(F.broadcast(counts), "return_number", "left").select("return_number", F.coalesce("n", F.lit(0)).cast("long").alias("n_points"))  # `bins` rows


def info(df: DataFrame) -> DataFrame:
    """One row for each attribute component: type, smallest and largest value as doubles, count. A single pass over the points."""
    schema = PointSchema.of_frame(df)
    aggs, keys = [F.count("*").alias("n")], []
    for a in schema.attributes:
        if a.type in VECTORS or not a.type.startswith(("bytes", "custom")):
            for suffix, c in components(df, a.name):
                key = f"k{len(keys)}"
                d = c.cast("double")
                aggs += [F.min(F.when(~F.isnan(d), d)).alias(f"{key}_min"), F.max(F.when(~F.isnan(d), d)).alias(f"{key}_max")]
                keys.append((key, a.name + suffix.replace("_", "."), a.type))
    rows = [F.struct(F.lit(n).alias("attribute"), F.lit(t).alias("type"), F.col(f"{k}_min").alias("min"), F.col(f"{k}_max").alias("max"), F.col("n").alias("n_points")) for k, n, t in keys]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
