"""Casts between point types with machine semantics, as column expressions.

Integers wrap modulo 2^n, floats truncate towards zero and saturate with NaN as 0, integers round to floats. ANSI casts would raise
instead, so every narrowing goes through these expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import SCALARS, VECTORS, parse_type, spark_type


def whole(value: int, kind: T.DataType) -> Column:
    """An integer literal; as text, because literals beyond 64 bits have no other way in."""
    return F.lit(str(value)).cast(kind)


def _wrap(c: Column, source: str, kind: str) -> Column:
    low, high = SCALARS[kind][2]
    wide = T.DecimalType(38, 0) if kind in ("u64", "i64") or source == "u64" else T.LongType()
    span = whole(high - low + 1, wide)
    start = whole(low, wide)
    rest = F.pmod(c.cast(wide), span) if wide == T.LongType() else c.cast(wide)  # so that the difference fits a long
    return (F.pmod(rest - start, span) + start).cast(SCALARS[kind][0])


def _saturate(c: Column, kind: str) -> Column:
    low, high = SCALARS[kind][2]
    d, out = c.cast("double"), SCALARS[kind][0]
    big = T.DecimalType(38, 0)
    # A long holds what is below 2^63; the rest of an unsigned value is added apart. CASE keeps the casts inside their range.
    inner = d.cast("long").cast(big)
    if kind == "u64":
        half = float(2**63)
        inner = F.when(d < half, inner).otherwise((d - half).cast("long").cast(big) + whole(2**63, big))
    return (
        F.when(F.isnan(d), F.lit(0).cast(out))
        .when(d >= float(high), whole(high, out))
        .when(d <= float(low), whole(low, out))
        .otherwise(inner.cast(out))
    )


def cast_scalar(c: Column, source: str, target: str) -> Column:
    if source == target:
        return c
    if SCALARS[target][2] is None:
        return c.cast(SCALARS[target][0])
    return _saturate(c, target) if SCALARS[source][2] is None else _wrap(c, source, target)


def can_cast(source: str, target: str) -> bool:
    """Equal types, two scalars, or two vectors of three components."""
    a, b = parse_type(source)[0], parse_type(target)[0]
    three = lambda k: k in VECTORS and len(VECTORS[k][1]) == 3
    return source == target or (a in SCALARS and b in SCALARS) or (three(a) and three(b))


def point_cast(c: Column, source: str, target: str) -> Column:
    """c, of point type `source`, as `target`. Other pairs than can_cast allows raise when the plan is built."""
    if source == target:
        return c
    if not can_cast(source, target):
        raise ValueError(f"no conversion from {source} to {target}")
    if source in SCALARS:
        return cast_scalar(c, source, target)
    (inner, parts), (into, _) = VECTORS[source], VECTORS[target]
    return F.when(c.isNotNull(), F.struct(*[cast_scalar(c[p], inner, into).alias(p) for p in parts]))


def default_value(kind: str) -> Column:
    """Zero in every component; zero bytes for byte arrays and custom types."""
    base, size = parse_type(kind)
    if base in SCALARS:
        return F.lit(0).cast(spark_type(kind))
    if base in VECTORS:
        inner, parts = VECTORS[base]
        return F.struct(*[F.lit(0).cast(SCALARS[inner][0]).alias(p) for p in parts])
    return F.lit(bytearray(size))
