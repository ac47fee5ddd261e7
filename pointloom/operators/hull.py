"""Convex hulls in three dimensions.

1. The farthest points along DIRECTIONS directions make a polytope whose vertices are the hull's. The scan drops all points inside it and keeps, of each
   piece of CHUNK others, the vertices of the piece's hull.
2. Up to SECTOR points that are left fit one task. More are dealt to sectors of directions from the polytope's middle, about equally full; a sector
   makes the hull of its points, of those near its border and of the polytope. Each plane of it that touches one of its own points is shown to the
   sectors that may have points beyond; the farthest such point joins, until there are none. Then all those planes are the hull's, and no task has held
   more than a sector and what joined it.

Positions with a NaN or infinite coordinate are no points. Where all points are on one plane, its polygon comes from hulls of parts, merged in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..functions.schema import POINT_IDX
from .aggregates import POSITION
from .materialize import stable
from .neighbours import Tree, blocks, gap2

MERGE, DIRECTIONS, CHUNK = 32, 200, 4000
#: Points of one task, most sectors, and how far beyond their directions sectors borrow points, in their width.
SECTOR, MOST_SECTORS, MARGIN = 8000, 1 << 16, 0.15


def hull_faces(p: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(vertices, triangles) of the hull of points p, indices into p. Triangles face outwards.

    One point or equal points: that vertex; collinear points: the two ends; both without triangles. Coplanar points: the polygon's
    vertices, triangulated on both sides.
    """
    none = np.zeros((0, 3), int)
    if not len(p):
        raise ValueError("no points")
    scale = float(np.abs(p - p[0]).max()) or 1.0
    eps = 1e-12 * scale
    a = int(np.lexsort(p.T[::-1])[0])
    b = int(np.argmax(((p - p[a]) ** 2).sum(1)))
    if np.linalg.norm(p[b] - p[a]) <= eps:
        return [a], none
    u = (p[b] - p[a]) / np.linalg.norm(p[b] - p[a])
    off = np.linalg.norm(np.cross(p - p[a], u), axis=1)
    c = int(np.argmax(off))
    if off[c] <= eps:
        t = (p - p[a]) @ u
        return sorted({int(np.argmin(t)), int(np.argmax(t))}), none
    n = np.cross(p[b] - p[a], p[c] - p[a])
    n /= np.linalg.norm(n)
    height = (p - p[a]) @ n
    d = int(np.argmax(np.abs(height)))
    if abs(height[d]) <= eps:
        ring = _polygon(p, a, u, np.cross(n, u))
        top = [(ring[0], ring[i], ring[i + 1]) for i in range(1, len(ring) - 1)]
        return sorted(ring), np.array(top + [t[::-1] for t in top])
    return _quickhull(p, [a, b, c, d], eps)


def _polygon(p: np.ndarray, origin: int, u: np.ndarray, v: np.ndarray) -> list[int]:
    """Vertices of the hull of coplanar points, in order."""
    q = np.stack([(p - p[origin]) @ u, (p - p[origin]) @ v], 1)
    order = np.lexsort((q[:, 1], q[:, 0])).tolist()

    def chain(points: list[int]) -> list[int]:
        out: list[int] = []
        for i in points:
            while len(out) > 1:
                s, t = q[out[-1]] - q[out[-2]], q[i] - q[out[-2]]
                if s[0] * t[1] - s[1] * t[0] > 0:
                    break
                out.pop()
            out.append(i)
        return out

    return chain(order)[:-1] + chain(order[::-1])[:-1]


def _quickhull(p: np.ndarray, start: list[int], eps: float) -> tuple[list[int], np.ndarray]:
    """Each face keeps the points outside it; the farthest of one is added until no face has any."""
    middle = p[start].mean(0)
    faces: dict[tuple[int, int, int], tuple[np.ndarray, float, np.ndarray]] = {}
    edges: dict[tuple[int, int], tuple[int, int, int]] = {}

    def put(i: int, j: int, k: int, candidates: np.ndarray) -> np.ndarray:
        """Add a face; the candidates outside it stay with it, the others are returned."""
        n = np.cross(p[j] - p[i], p[k] - p[i])
        size = np.linalg.norm(n)
        n = n / size if size > 0 else n
        far = (p[candidates] - p[i]) @ n > eps
        f = (i, j, k)
        faces[f] = (n, float(n @ p[i]), candidates[far])
        edges[i, j] = edges[j, k] = edges[k, i] = f
        return candidates[~far]

    rest = np.setdiff1d(np.arange(len(p)), start)
    for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        f = [start[i], start[j], start[k]]
        if np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]]) @ (middle - p[f[0]]) > 0:
            f[1], f[2] = f[2], f[1]
        rest = put(*f, rest)
    waiting = [f for f, x in faces.items() if len(x[2])]
    while waiting:
        f = waiting.pop()
        if f not in faces or not len(faces[f][2]):
            continue
        n, _, outside = faces[f]
        apex = int(outside[np.argmax(p[outside] @ n)])
        seen, stack, horizon = {f}, [f], []
        while stack:
            i, j, k = stack.pop()
            for e in ((i, j), (j, k), (k, i)):
                g = edges[e[1], e[0]]
                if g in seen:
                    continue
                if faces[g][0] @ p[apex] - faces[g][1] > eps:
                    seen.add(g)
                    stack.append(g)
                else:
                    horizon.append(e)
        horizon = [e for e in horizon if edges[e[1], e[0]] not in seen]
        orphans = np.unique(np.concatenate([faces[g][2] for g in seen]))
        orphans = orphans[orphans != apex]
        for g in seen:
            del faces[g]
        for i, j in horizon:
            orphans = put(i, j, apex, orphans)
            if len(faces[i, j, apex][2]):
                waiting.append((i, j, apex))
    out = np.array(list(faces))
    return np.unique(out).tolist(), out


def directions(n: int = DIRECTIONS) -> np.ndarray:
    """n directions, evenly spread (a spiral on the sphere)."""
    i = np.arange(n) + 0.5
    z, turn = 1 - 2 * i / n, i * (3 - 5**0.5) * np.pi
    return np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], 1)


def planes(p: np.ndarray, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit normals, offsets) of triangles; a point q is beyond one where q @ normal > offset."""
    a, b, c = (p[faces[:, i]] for i in range(3))
    n = np.cross(b - a, c - a)
    n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
    return n, (n * a).sum(1)


def _extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The farthest point of a partition along each direction, the first of equal ones."""
    to, best = directions(), None
    for batch in batches:
        if len(batch):
            both = batch if best is None else pd.concat([best, batch])
            both = both.sort_values(POINT_IDX, kind="stable")
            at = np.argmax(both[list(AXES)].to_numpy() @ to.T, axis=0)
            best = both.iloc[np.unique(at)]
    if best is not None:
        yield best


def _flat_vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hull's vertices of all rows of a partition, folded batch by batch."""
    held = None
    for batch in batches:
        both = batch if held is None else pd.concat([held, batch])
        if len(both):
            held = both.iloc[hull_faces(both[list(AXES)].to_numpy())[0]]
    if held is not None:
        yield held


def _outer(normals: np.ndarray, offsets: np.ndarray):
    """The vertices of the hulls of pieces of CHUNK points that aren't inside a polytope."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def vertices() -> pd.DataFrame:
            rows = pd.concat(held)
            held.clear()
            return rows.iloc[hull_faces(rows[list(AXES)].to_numpy())[0]]

        for batch in batches:
            for i in range(0, len(batch), CHUNK):
                part = batch.iloc[i : i + CHUNK]
                held.append(part[((part[list(AXES)].to_numpy() @ normals.T) >= offsets).any(1)])
                if sum(map(len, held)) >= CHUNK:
                    yield vertices()
        if sum(map(len, held)):
            yield vertices()

    return work


class Solid:
    """The polytope of the farthest points along some directions, and a point inside it; None of them where all points are on a plane."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(POINT_IDX)
        p = rows[list(AXES)].to_numpy()
        self.flat = True
        if len(p) > 3:
            spread = np.linalg.svd(p - p.mean(0), compute_uv=False)
            self.flat = bool(spread[2] <= 1e-9 * spread[0])
        if not self.flat:
            vertices, faces = hull_faces(p)
            self.rows, self.middle = rows.iloc[vertices], p[vertices].mean(0)
            self.scale = float(np.abs(p - self.middle).max())
            self.normals, self.offsets = planes(p, faces)
            self.offsets = self.offsets - 1e-9 * self.scale


def _finite(points: DataFrame, position: str) -> DataFrame:
    x = {a: F.col(position)[a].cast("double") for a in AXES}
    return points.select(POINT_IDX, *[c.alias(a) for a, c in x.items()]).where(reduce(and_, [F.abs(F.col(a)) < float("inf") for a in AXES]))


SECTOR_ROWS = "sector long, own boolean, point_idx long, x double, y double, z double"


def _sectors(outer: DataFrame, n: int, solid: Solid) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(SECTOR_ROWS, lowest and highest corner of each sector's own points). Sectors are the leaves of a tree over directions from the middle, so
    they hold about equally many points; a point is its own sector's, and is lent to those whose directions are near."""
    depth = max(1, int(np.ceil(np.log2(min(MOST_SECTORS, n / SECTOR)))))
    towards = lambda p: (p - solid.middle) / np.maximum(np.linalg.norm(p - solid.middle, axis=1, keepdims=True), 1e-300)
    share = int(min(1.0, 64 * (1 << depth) / n) * (1 << 40))
    sample = outer.where(F.pmod(F.xxhash64(*AXES), F.lit(1 << 40)) < share).select(*AXES).limit(128 << depth).toPandas().to_numpy().reshape(-1, 3)
    tree = Tree(towards(sample), depth)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sector=tree.leaf(towards(batch[list(AXES)].to_numpy())) if len(batch) else 0, own=True)[["sector", "own", POINT_IDX, *AXES]]

    own = stable(outer.mapInPandas(deal, SECTOR_ROWS))

    def measure(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[list(AXES)].to_numpy()
        u = towards(p)
        return pd.DataFrame([[rows["sector"].iloc[0], *[v.tolist() for v in (p.min(0), p.max(0), u.min(0), u.max(0))]]], columns=["sector", "low", "high", "from", "to"])

    boxes = own.groupBy("sector").applyInPandas(measure, "sector long, low array<double>, high array<double>, from array<double>, to array<double>").toPandas()  # a row a sector
    corners = {c: np.full((1 << depth, 3), np.inf if c in ("low", "from") else -np.inf) for c in ("low", "high", "from", "to")}
    for c, values in corners.items():
        values[boxes["sector"].to_numpy()] = np.stack(boxes[c])
    wide = np.where(np.isfinite(corners["from"]), MARGIN * (corners["to"] - corners["from"]).max(1, keepdims=True), 0)

    def lend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                u, home = towards(batch[list(AXES)].to_numpy()), batch["sector"].to_numpy()
                for part in blocks(u):
                    some = np.flatnonzero(gap2(corners["from"] - wide, corners["to"] + wide, u[part].min(0), u[part].max(0)) == 0)
                    i, j = np.nonzero(gap2(corners["from"][some] - wide[some], corners["to"][some] + wide[some], u[part][:, None], u[part][:, None]) == 0)
                    lent = some[j] != home[part[i]]
                    yield batch.iloc[part[i[lent]]].assign(sector=some[j[lent]], own=False)

    return own.union(own.mapInPandas(lend, SECTOR_ROWS)), corners["low"], corners["high"]


#: kind 0: a vertex of a sector's hull; 1: a plane of it, for another sector (`to`) to look beyond; 2: a triangle of it.
ROUND = "kind int, sector long, own boolean, point_idx long, x double, y double, z double, to long, offset double, b long, c long"


def _hulls(solid: Solid, low: np.ndarray, high: np.ndarray):
    """One sector's hull with the polytope's vertices: its vertices, and the planes that touch one of its own points and may have another sector's points beyond."""
    eps = 1e-12 * solid.scale

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        here = int(rows["sector"].iloc[0])
        rows = pd.concat([rows.sort_values("own", ascending=False, kind="stable"), solid.rows.assign(sector=here, own=False)]).drop_duplicates(POINT_IDX).reset_index(drop=True)
        p, own, ids = rows[list(AXES)].to_numpy(), rows["own"].to_numpy(bool), rows[POINT_IDX].to_numpy()
        vertices, faces = hull_faces(p)
        faces = faces[own[faces].any(1)]
        out = [rows.iloc[vertices].assign(kind=0)]
        if len(faces):
            n, d = planes(p, faces)
            others = np.flatnonzero(np.isfinite(low[:, 0]) & (np.arange(len(low)) != here))
            for i in range(0, len(faces), 256):
                reach = np.maximum(n[i : i + 256, None] * low[others], n[i : i + 256, None] * high[others]).sum(-1)
                f, j = np.nonzero(reach > d[i : i + 256, None] + eps)
                out.append(pd.DataFrame({"kind": 1, "sector": here, "to": others[j], "x": n[i + f, 0], "y": n[i + f, 1], "z": n[i + f, 2], "offset": d[i + f]}))
            # A triangle is given by the owner of its first vertex.
            turned = np.take_along_axis(faces, (np.argmin(ids[faces], 1)[:, None] + np.arange(3)) % 3, 1)
            turned = turned[own[turned[:, 0]]]
            out.append(pd.DataFrame({"kind": 2, "sector": here, POINT_IDX: ids[turned[:, 0]], "b": ids[turned[:, 1]], "c": ids[turned[:, 2]]}))
        names = [f.split()[0] for f in ROUND.split(", ")]
        whole = {c: "Int64" for c in (POINT_IDX, "to", "b", "c")}
        return pd.concat([o.reindex(columns=names).astype(whole | {"own": "boolean"}) for o in out])

    return work


def _beyond(eps: float):
    """Of a sector's own points the farthest beyond each plane that it is asked about."""

    def work(points: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asks):
            return pd.DataFrame(columns=["sector", POINT_IDX, *AXES], dtype=object)
        p, n, d, out = points[list(AXES)].to_numpy(), asks[list(AXES)].to_numpy(), asks["offset"].to_numpy(), []
        for i in range(0, len(n), 1024):
            far = n[i : i + 1024] @ p.T
            best = far.argmax(1)
            hit = np.flatnonzero(far[np.arange(len(far)), best] > d[i : i + 1024] + eps)
            out.append(points.iloc[best[hit]][[POINT_IDX, *AXES]].assign(sector=asks["sector"].to_numpy()[i + hit]))
        return pd.concat(out).drop_duplicates(["sector", POINT_IDX])[["sector", POINT_IDX, *AXES]]

    return work


def _by_sectors(outer: DataFrame, n: int, solid: Solid) -> DataFrame:
    """ROUND rows of the last round, in which no sector has a point beyond a plane of another.

    A plane that touches a sector's own point and has nothing beyond is the hull's, so the own vertices that are left are the hull's vertices. Where another
    sector has points beyond, the farthest of them joins the sector, and it looks again.
    """
    rows, low, high = _sectors(outer, n, solid)
    work, eps = _hulls(solid, low, high), 1e-12 * solid.scale
    while True:
        made = stable(rows.groupBy("sector").applyInPandas(work, ROUND))
        held = made.where("kind = 0").select("sector", "own", POINT_IDX, *AXES)
        asks = made.where("kind = 1").select("to", "sector", *AXES, "offset")
        own = held.where("own")
        came = own.groupBy("sector").cogroup(asks.groupBy("to")).applyInPandas(_beyond(eps), "sector long, point_idx long, x double, y double, z double")
        new = stable(came.distinct().join(held.select("sector", POINT_IDX), ["sector", POINT_IDX], "left_anti"))
        if new.isEmpty():
            return made
        rows = held.unionByName(new.withColumn("own", F.lit(False)))


def _rounds(points: DataFrame, position: str) -> tuple[DataFrame, DataFrame | None]:
    """(vertices, ROUND rows where sectors were needed)."""
    flat = _finite(points, position)
    solid = Solid(_collected(flat))
    if solid.flat:
        part = flat.mapInPandas(_flat_vertices, flat.schema)
        wide = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        for n in ([wide, MERGE] if wide > MERGE else []) + [1]:
            part = part.repartition(n).mapInPandas(_flat_vertices, flat.schema)
        return part, None
    outer = stable(flat.mapInPandas(_outer(solid.normals, solid.offsets), flat.schema))
    n = outer.count()
    if n <= SECTOR:
        return outer.repartition(1).mapInPandas(_flat_vertices, flat.schema), None
    made = _by_sectors(outer, n, solid)
    return made.where("kind = 0 and own").select(POINT_IDX, *AXES), made


def _collected(flat: DataFrame) -> pd.DataFrame:
    """The farthest point along each direction."""
    part = flat.mapInPandas(_extremes, flat.schema)
    return part.repartition(1).mapInPandas(_extremes, flat.schema).toPandas()


def hull_vertices(points: DataFrame, position: str = POSITION) -> DataFrame:
    """(point_idx, x, y, z) of the hull's vertices. No points give no rows."""
    return _rounds(points, position)[0]


def hull_mesh(points: DataFrame, position: str = POSITION) -> DataFrame:
    """(a, b, c): point indices of the hull's triangles. Points on a line, or fewer than three, raise when evaluated."""
    vertices, made = _rounds(points, position)
    if made is not None:
        faces = made.where("kind = 2").select(F.col(POINT_IDX).alias("a"), "b", "c").distinct()
        sides = F.array(*[F.struct(F.least(u, v), F.greatest(u, v)) for u, v in (("a", "b"), ("b", "c"), ("c", "a"))])
        if faces.select(F.explode(sides).alias("side")).groupBy("side").count().where("count != 2").isEmpty():
            return faces
        # Sectors have cut a plane with more than three vertices in different ways: all vertices are triangulated together.

    def mesh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))  # vertices only
        if not len(rows):
            raise ValueError("no points")
        faces = hull_faces(rows[list(AXES)].to_numpy())[1]
        if len(faces) < 2:
            raise ValueError("all points are on a line")
        yield pd.DataFrame(rows[POINT_IDX].to_numpy()[faces], columns=list("abc"))

    return vertices.repartition(1).mapInPandas(mesh, "a long, b long, c long")
