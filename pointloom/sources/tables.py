"""The test tables as points, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import vec
from ..functions.schema import BUILTIN, POINT_IDX

EVENT_CODES = ("click", "error", "purchase", "signup", "view")


def _point(name: str, c: Column) -> Column:
    return c.alias(name, metadata={"point_type": BUILTIN[name].type})


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as points without an index: (l_orderkey, l_linenumber) isn't unique."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(
        _point("Position3D", vec(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount") * 100)),
        _point("Intensity", F.floor(F.col("l_extendedprice") / 2).cast("int")),
        _point("ReturnNumber", F.col("l_linenumber").cast("short")),
        _point("PointSourceID", F.col("l_suppkey").cast("int")),
        _point("GpsTime", F.unix_timestamp("l_shipdate").cast("double")),
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: position (value, days since 2024-01-01, user)."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.unix_timestamp("ts").cast("double")
    code = F.coalesce(*[F.when(F.col("event_type") == e, i) for i, e in enumerate(EVENT_CODES, 1)], F.lit(0))
    return t.select(
        F.col("event_id").alias(POINT_IDX),
        _point("Position3D", vec(F.col("value"), F.floor((seconds - 1704067200) / 86400).cast("double"), F.col("user_id").cast("double"))),
        _point("Classification", code.cast("short")),
        _point("GpsTime", seconds),
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as points of their first three components."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = F.col("embedding")
    return t.select(
        F.col("vec_id").alias(POINT_IDX),
        _point("Position3D", vec(*[e[i].cast("double") for i in range(3)])),
        _point("Classification", F.col("label").cast("short")),
    )
