"""Vectors, boxes and distances as column expressions. A box is struct<min:struct<x,y,z>, max:struct<x,y,z>>."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyz"


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def vector(v: Column | tuple[float, float, float]) -> Column:
    return v if isinstance(v, Column) else vec(*[F.lit(float(c)) for c in v])


def sub(a: Column, b: Column) -> Column:
    return vec(*[a[c] - b[c] for c in AXES])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def infimum(a: Column, b: Column) -> Column:
    return vec(*[F.least(a[c], b[c]) for c in AXES])


def supremum(a: Column, b: Column) -> Column:
    return vec(*[F.greatest(a[c], b[c]) for c in AXES])


def box_unchecked(low, high) -> Column:
    return F.struct(vector(low).alias("min"), vector(high).alias("max"))


def box(low, high) -> Column:
    """A box; raises where a minimum is above its maximum: at once for numbers, when evaluated for columns."""
    if not isinstance(low, Column) and not isinstance(high, Column) and any(a > b for a, b in zip(low, high, strict=True)):
        raise ValueError(f"minimum {low} is above maximum {high}")
    a, b = vector(low), vector(high)
    good = reduce(and_, [a[c] <= b[c] for c in AXES])
    checked = F.when(good, b).otherwise(F.raise_error(F.lit("box minimum above its maximum")).cast("struct<x:double,y:double,z:double>"))
    return F.struct(a.alias("min"), checked.alias("max"))


def box_extent(b: Column) -> Column:
    return sub(b["max"], b["min"])


def box_center(b: Column) -> Column:
    return vec(*[(b["min"][c] + b["max"][c]) / 2 for c in AXES])


def box_contains(b: Column, p: Column) -> Column:
    """Closed on all sides."""
    return reduce(and_, [(p[c] >= b["min"][c]) & (p[c] <= b["max"][c]) for c in AXES])


def box_contains_approx(b: Column, p: Column, eps: float) -> Column:
    """Not farther outside than eps on any axis; a NaN coordinate is inside."""
    inside = lambda c: F.isnan(p[c]) | ~((p[c] - b["min"][c] < -eps) | (p[c] - b["max"][c] > eps))
    return reduce(and_, [inside(c) for c in AXES])


def box_intersects(a: Column, b: Column) -> Column:
    """Touching boxes intersect."""
    return reduce(and_, [(a["min"][c] <= b["max"][c]) & (a["max"][c] >= b["min"][c]) for c in AXES])


def box_union(a: Column, b: Column) -> Column:
    return F.struct(infimum(a["min"], b["min"]).alias("min"), supremum(a["max"], b["max"]).alias("max"))


def box_extended(b: Column, p: Column) -> Column:
    return F.struct(infimum(b["min"], p).alias("min"), supremum(b["max"], p).alias("max"))


def box_cubic(b: Column) -> Column:
    """The cube around the same center with the longest edge."""
    e, m = box_extent(b), box_center(b)
    half = F.greatest(*[e[c] for c in AXES]) / 2
    return F.struct(vec(*[m[c] - half for c in AXES]).alias("min"), vec(*[m[c] + half for c in AXES]).alias("max"))


def point_plane_distance(p: Column, plane: Column) -> Column:
    """plane: struct<a,b,c,d>."""
    return F.abs(plane["a"] * p["x"] + plane["b"] * p["y"] + plane["c"] * p["z"] + plane["d"]) / F.sqrt(plane["a"] * plane["a"] + plane["b"] * plane["b"] + plane["c"] * plane["c"])


def point_line_distance(p: Column, a: Column, b: Column) -> Column:
    return norm(cross(sub(b, a), sub(a, p))) / norm(sub(b, a))


def point_segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance to the nearest point of the segment from a to b."""
    along, to = sub(b, a), sub(p, a)
    t = F.least(F.greatest(F.when(dot(along, along) > 0, dot(to, along) / dot(along, along)).otherwise(F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return norm(vec(*[to[c] - t * along[c] for c in AXES]))


def point_edge_signed_distance(p: Column, a: Column, b: Column, normal: Column) -> Column:
    """Distance of p from the line a-b within the plane of `normal`; positive on the side that normal x (b - a) points to."""
    side = cross(normal, sub(b, a))
    return dot(sub(p, a), side) / norm(side)


def triangle_normal(a: Column, b: Column, c: Column) -> Column:
    return cross(sub(b, a), sub(c, a))


def world_position(local: Column, scale, offset) -> Column:
    """local * scale + offset on each axis."""
    s, o = vector(scale), vector(offset)
    return vec(*[local[c].cast("double") * s[c] + o[c] for c in AXES])


def local_position(p: Column, scale, offset) -> Column:
    """(p - offset) / scale truncated towards zero to 32 bits; raises outside them."""
    s, o = vector(scale), vector(offset)

    def part(c: str) -> Column:
        q = (p[c] - o[c]) / s[c]
        return F.when(q.between(-2147483648.0, 2147483647.0), q.cast("long").cast("int")).otherwise(F.raise_error(F.lit("position outside 32 bits")).cast("int"))

    return vec(*[part(c) for c in AXES])
