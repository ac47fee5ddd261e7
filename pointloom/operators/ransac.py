"""RANSAC planes and lines: the points are scanned once for the draws and once for all hypotheses' counts.

Hypothesis h is spanned by the points that come h * size to (h + 1) * size - 1 in the order of a seeded hash of their index, a sample
without replacement that any subset of points, with any gaps in its numbers, can give. With fewer points than that the order is gone
through again, each time with wider steps. Counts are conditional sums of one aggregate: no join, and one row from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES, point_line_distance, point_plane_distance, vector
from ..functions.schema import POINT_IDX
from .aggregates import POSITION

Place = tuple[float, float, float]
#: Hypotheses that one scan counts: more columns would leave generated code.
SCAN = 90


def draws(points: DataFrame, iterations: int, size: int, seed: int, position: str = POSITION) -> list[tuple[Place, ...]]:
    """The positions that span each hypothesis. At most iterations * size points reach the driver."""
    p = F.col(position)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(POINT_IDX).cast("string")).cast("binary"))
    placed = points.where(p.isNotNull()).select(order.alias("o"), POINT_IDX, *[p[a].cast("double").alias(a) for a in AXES])
    pool = [tuple(r[2:]) for r in placed.orderBy("o", POINT_IDX).limit(iterations * size).collect()]
    n = len(pool)
    if n < size:
        raise ValueError(f"{size} points are needed, there are {n}")
    out = []
    for h in range(iterations):
        step, picked = 1 + h * size // n, []
        for j in range(size):
            at = (h * size + j * step) % n
            while at in picked:
                at = (at + 1) % n
            picked.append(at)
        out.append(tuple(pool[at] for at in picked))
    return out


def _ranked(points: DataFrame, hypotheses: list[tuple[dict[str, Column], Column]], threshold: float) -> DataFrame:
    """(hypothesis, its columns, ranking): how many points are closer than the threshold, for each hypothesis."""
    parts = []
    for s in range(0, len(hypotheses), SCAN):
        some = list(enumerate(hypotheses[s : s + SCAN], s))
        counted = points.agg(*[F.count_if(distance < threshold).alias(f"r{h}") for h, (_, distance) in some])
        rows = [F.struct(F.lit(h).alias("hypothesis"), *[c.alias(n) for n, c in columns.items()], F.col(f"r{h}").alias("ranking")) for h, (columns, _) in some]
        parts.append(counted.select(F.inline(F.array(*rows))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _best(ranked: DataFrame):
    return ranked.orderBy(F.desc("ranking"), F.desc("hypothesis")).first()


def plane_hypotheses(points: DataFrame, iterations: int, seed: int, position: str = POSITION) -> list[tuple[float, float, float, float]]:
    """(a, b, c, d) through three drawn points each; collinear draws make planes that no point is near."""
    out = []
    for p, q, r in draws(points, iterations, 3, seed, position):
        u, v = [y - x for x, y in zip(p, q, strict=True)], [y - x for x, y in zip(p, r, strict=True)]
        a, b, c = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        out.append((a, b, c, -(a * p[0] + b * p[1] + c * p[2])))
    return out


def ransac_planes(points: DataFrame, threshold: float, iterations: int, seed: int = 1, position: str = POSITION) -> DataFrame:
    """(hypothesis, a, b, c, d, ranking) of every hypothesis; points at a distance strictly below the threshold count."""
    hypotheses = []
    for plane in plane_hypotheses(points, iterations, seed, position):
        columns = {n: F.lit(v) for n, v in zip("abcd", plane, strict=True)}
        at = point_plane_distance(F.col(position), F.struct(*[c.alias(n) for n, c in columns.items()]))
        hypotheses.append((columns, at if plane[0] ** 2 + plane[1] ** 2 + plane[2] ** 2 > 0 else F.lit(None).cast("double")))
    return _ranked(points, hypotheses, threshold)


def ransac_plane(points: DataFrame, threshold: float, iterations: int, seed: int = 1, position: str = POSITION) -> tuple[dict, DataFrame]:
    """The plane with most inliers (the last of equals) and the indices of its inliers."""
    best = _best(ransac_planes(points, threshold, iterations, seed, position))
    plane = F.struct(*[F.lit(best[c]).alias(c) for c in "abcd"])
    near = F.lit(best["a"] ** 2 + best["b"] ** 2 + best["c"] ** 2 > 0) & (F.when(F.lit(best["ranking"] > 0), point_plane_distance(F.col(position), plane)) < threshold)
    return best.asDict(), points.where(near).select(POINT_IDX)


def ransac_lines(points: DataFrame, threshold: float, iterations: int, seed: int = 1, position: str = POSITION) -> DataFrame:
    """(hypothesis, p, q, ranking) of every hypothesis, a line through two drawn points p and q."""
    hypotheses = []
    for p, q in draws(points, iterations, 2, seed, position):
        at = point_line_distance(F.col(position), vector(p), vector(q)) if p != q else F.lit(None).cast("double")
        hypotheses.append(({"p": vector(p), "q": vector(q)}, at))
    return _ranked(points, hypotheses, threshold)


def ransac_line(points: DataFrame, threshold: float, iterations: int, seed: int = 1, position: str = POSITION) -> tuple[dict, DataFrame]:
    """The line with most inliers (the last of equals) and the indices of its inliers."""
    best = _best(ransac_lines(points, threshold, iterations, seed, position))
    ends = [F.struct(*[F.lit(best[e][a]).alias(a) for a in AXES]) for e in "pq"]
    near = F.when(F.lit(best["ranking"] > 0), point_line_distance(F.col(position), *ends)) < threshold
    return best.asDict(recursive=True), points.where(near).select(POINT_IDX)
