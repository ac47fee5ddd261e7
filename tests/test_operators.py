"""Aggregates, conversion, joins and global algorithms on small points with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.schema import POINT_IDX, Attribute, PointSchema
from pointloom.operators import aggregates, frame, hull, joins, neighbours, normals, ransac, reproject, voxel
from pointloom.operators.convert import LayoutConverter

POSITION = PointSchema.of("Position3D")
NAN, INF = float("nan"), float("inf")


def points(spark, positions):
    return frame.in_memory(spark, POSITION, [(tuple(map(float, p)),) for p in positions])


def test_bounds_ignore_nan(spark):
    b = aggregates.bounds(points(spark, [(0, NAN, 1), (1, 1, 1), (-1, 2, NAN)])).first()
    assert tuple(b) == (-1, 1, 1, 2, 1, 1)
    assert tuple(aggregates.bounds(points(spark, [(0, 0, 0)]).where("false")).first()) == (None,) * 6


def test_centroid_and_covariance(spark):
    p = points(spark, [(1, 0, 0), (0, 1, 0), (1, 1, 0), (-1, 0, 0)])
    assert tuple(aggregates.centroid(p).first()) == (0.25, 0.5, 0.0)
    c = aggregates.covariance(p).first().asDict()
    assert c["n"] == 4 and c["xx"] == pytest.approx(2.75) and c["xy"] == pytest.approx(0.5) and c["yy"] == pytest.approx(1.0) and c["zz"] == 0
    assert tuple(aggregates.centroid(points(spark, [(1, 1, 1), (NAN, 5, 5), (INF, 0, 0), (3, 3, 3)])).first()) == (2, 2, 2)
    assert aggregates.centroid(points(spark, [(INF, 1, 1), (0, 1, 1)])).first()["x"] == INF
    with pytest.raises(Exception, match="three valid points"):
        aggregates.covariance(points(spark, [(NAN, 0, 0)] * 4)).first()


def test_return_histogram_has_zero_bins(spark):
    s = PointSchema.of("ReturnNumber")
    h = aggregates.return_histogram(frame.in_memory(spark, s, [(1,), (1,), (3,), (0,), (9,)]))
    assert sorted(map(tuple, h.collect())) == [(1, 2), (2, 0), (3, 1), (4, 0), (5, 0)]


def test_voxel_grid_of_three_thousand_points(spark):
    rows = [(0.0, 0.0, 0.0), (10.0, 10.0, 10.0)]
    rows += [(i + d, j + d, k + d) for i in range(10) for j in range(10) for k in range(10) for d in (0.5, 0.6, 0.7)]
    out = voxel.voxel_downsample(points(spark, rows), (1.0, 1.0, 1.0)).orderBy(POINT_IDX).collect()
    assert len(out) == 1000 and [r[POINT_IDX] for r in out] == list(range(1000))
    assert tuple(out[1]["Position3D"]) == pytest.approx((0.6, 0.6, 1.6))
    with pytest.raises(ValueError):
        voxel.voxel_downsample(points(spark, rows[:3]), (0.0, 1.0, 1.0))


def test_voxel_reducers(spark):
    s = PointSchema.of("Position3D", "Intensity", "Classification", "EdgeOfFlightLine", "ColorRGB", "GpsTime")
    rows = [((0.0, 0.0, 0.0), 1, 3, 1, (1, 2, 3), -5.0), ((0.1, 0.0, 0.0), 2, 3, 1, (2, 2, 4), -7.0), ((0.2, 0.0, 0.0), 2, 1, 0, (2, 2, 5), -9.0)]
    r = voxel.voxel_downsample(frame.in_memory(spark, s, rows), (1.0, 1.0, 1.0)).first()
    assert (r["Intensity"], r["Classification"], r["EdgeOfFlightLine"], tuple(r["ColorRGB"]), r["GpsTime"]) == (1, 3, 1, (1, 2, 4), 0.0)
    other = PointSchema((Attribute("Position3D", "vec3f64"), Attribute("Odd", "u8")))
    with pytest.raises(ValueError):
        voxel.voxel_downsample(frame.in_memory(spark, other, [((0.0, 0.0, 0.0), 1)]), (1.0, 1.0, 1.0))
    assert voxel.voxel_downsample(frame.in_memory(spark, other, [((0.0, 0.0, 0.0), 1)]), (1.0, 1.0, 1.0), {"Odd": lambda n: F.max(n)}).first()["Odd"] == 1


def test_conversion_errors_and_ranges(spark):
    source = PointSchema.of("Position3D", "Intensity")
    p = frame.in_memory(spark, source, [((float(i), 0.0, 0.0), i) for i in range(6)])
    with pytest.raises(ValueError):
        LayoutConverter(source, PointSchema.of("GpsTime"))
    with pytest.raises(ValueError):
        LayoutConverter(source, PointSchema.of("Intensity")).map("Position3D", "Intensity")
    target = PointSchema((Attribute("Intensity", "u8"),))
    c = LayoutConverter(source, target).map("Intensity", "Intensity", before=lambda v: v * 100)
    assert [r["Intensity"] for r in c.convert(p, 2, 5).orderBy(POINT_IDX).collect()] == [200, 44, 144]
    into = frame.in_memory(spark, target, [(9,)] * 8)
    assert [r["Intensity"] for r in LayoutConverter(source, target).convert_into(p, into, 1).orderBy(POINT_IDX).collect()] == [9, 0, 1, 2, 3, 4, 5, 9]


def test_edits(spark):
    p = points(spark, [(i, 0, 0) for i in range(4)])
    xs = lambda d: [r["Position3D"]["x"] for r in d.orderBy(POINT_IDX).collect()]
    assert xs(frame.swap(p, 0, 3)) == [3, 1, 2, 0]
    assert xs(frame.resize(p, 6)) == [0, 1, 2, 3, 0, 0] and xs(frame.resize(p, 2)) == [0, 1]
    assert xs(frame.append(p, p)) == [0, 1, 2, 3] * 2
    assert xs(frame.sort_by(p, F.col("Position3D.x").desc())) == [3, 2, 1, 0]
    assert frame.slice_points(p, 3, 1).count() == 0 and frame.clear(p).count() == 0
    assert frame.equal_points(p, p).first()[0] and not frame.equal_points(p, frame.swap(p, 0, 1)).first()[0]
    with pytest.raises(ValueError):
        frame.append(p, frame.in_memory(spark, PointSchema.of("Intensity"), [(1,)]))
    with pytest.raises(ValueError):
        joins.zip_points(p, frame.resize(p, 2))


def test_ransac_finds_plane_and_line(spark):
    rows = [(0, 0, p * p) if p % 5 == 0 else (p, p * p, 1) for p in range(2, 2002)]
    p = points(spark, rows)
    best, near = ransac.ransac_plane(p, 0.1, 60)
    assert best["ranking"] == near.count() == 1600
    best, near = ransac.ransac_line(p, 0.1, 120)
    assert best["ranking"] == near.count() == 400
    with pytest.raises(ValueError):
        ransac.ransac_plane(points(spark, rows[:2]), 0.1, 5)
    flat = ransac.ransac_planes(points(spark, [(i, 0, 0) for i in range(9)]), 0.1, 3)
    assert {r["ranking"] for r in flat.collect()} == {0}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    dense = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(100, 3)) * 0.01 + 5, np.repeat([[1.0, 1.0, 1.0]], 6, 0)])
    found = joins.knn(points(spark, dense), 5).collect()
    d = ((dense[:, None] - dense[None]) ** 2).sum(-1)
    expected = {(i, k + 1): j for i, row in enumerate(d) for k, j in enumerate(np.lexsort((np.arange(len(row)), row))[:5].tolist())}
    assert {(r[POINT_IDX], r["rank"]): r["neighbour"] for r in found} == expected
    with pytest.raises(ValueError):
        joins.knn(points(spark, dense[:3]), 5)


def test_normals_of_a_plane(spark):
    for r in normals.normals(points(spark, [(1, 0, 0), (0, 1, 0), (1, 1, 0), (-1, 0, 0)]), 3).collect():
        assert abs(r["nz"]) == pytest.approx(1) and r["curvature"] == pytest.approx(0)
    with pytest.raises(ValueError):
        normals.normals(points(spark, [(0, 0, 0)] * 4), 2)


@pytest.mark.parametrize(
    ("rows", "vertices", "faces"),
    [
        ([(0, 0, 0)], {0}, None),
        ([(0, 0, 0)] * 3, 1, None),
        ([(0, 0, 0), (1, 1, 1), (3, 3, 3), (2, 2, 2)], {0, 2}, None),
        ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], {0, 1, 2}, 2),
        ([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 0)], {0, 1, 2, 3}, 4),
        ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0.1, 0.1, 0.1)], {0, 1, 2, 3}, 4),
    ],
)
def test_hull_shapes(spark, rows, vertices, faces):
    got = {r[POINT_IDX] for r in hull.hull_vertices(points(spark, rows)).collect()}
    assert (len(got) if isinstance(vertices, int) else got) == vertices
    mesh = hull.hull_mesh(points(spark, rows))
    if faces is None:
        with pytest.raises(Exception, match="on a line"):
            mesh.collect()
    else:
        assert mesh.count() == faces


@pytest.mark.parametrize("seed", range(3))
def test_hull_holds_all_points(spark, seed):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-100, 100, (1500, 3)) if seed else rng.integers(0, 4, (400, 3)).astype(float)
    faces = np.array([tuple(r) for r in hull.hull_mesh(points(spark, p).repartition(5)).collect()])
    a, b, c = p[faces[:, 0]], p[faces[:, 1]], p[faces[:, 2]]
    n = np.cross(b - a, c - a)
    n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
    assert ((p[:, None] - a[None]) * n[None]).sum(-1).max() < 1e-7
    assert len(faces) == 2 * len(set(faces.ravel().tolist())) - 4


def test_reprojection(spark):
    p = points(spark, [(45.0, 9.0, 1.0), (-33.9, 18.4, 2.0), (0.0, 3.0, 0.0)])
    utm = reproject.reproject(p, "EPSG:4326", "EPSG:32632").orderBy(POINT_IDX).collect()
    assert tuple(utm[0]["Position3D"]) == pytest.approx((500000.0, 4982950.4, 1.0), abs=0.1)
    for code in ("EPSG:3857", "EPSG:32632", "EPSG:32733"):
        back = reproject.reproject(reproject.reproject(p, 4326, code), code, 4326).orderBy(POINT_IDX).collect()
        assert tuple(back[0]["Position3D"]) == pytest.approx((45.0, 9.0, 1.0), abs=1e-6)
    with pytest.raises(ValueError):
        reproject.transform("EPSG:4326", "EPSG:3035")
    moved = reproject.reproject(p, "a", "b", by=lambda x, y, z: (y, x, z)).orderBy(POINT_IDX).first()
    assert tuple(moved["Position3D"]) == (9.0, 45.0, 1.0)


def test_reprojection_to_california_albers(spark):
    p = points(spark, [(1, 22, 0), (12, 23, 0), (10, 8, 2), (10, 0, 1)])
    got = reproject.reproject(p, "EPSG:4326", "EPSG:3309").orderBy(POINT_IDX).collect()
    # What the same points have in other implementations.
    expected = [(12185139.590523569, 7420953.944297638, 0.0), (11104667.534080556, 7617693.973680517, 0.0), (11055663.927418157, 5832081.512011217, 2.0), (10807262.110686881, 4909128.916889962, 1.0)]
    for r, e in zip(got, expected, strict=True):
        assert tuple(r["Position3D"]) == pytest.approx(e, abs=1e-4)


@pytest.mark.parametrize(("code", "lat", "lon", "east", "north"), [(5070, 23.0, -96.0, 0.0, 0.0), (2154, 46.5, 3.0, 700_000.0, 6_600_000.0), (3034, 52.0, 10.0, 4_000_000.0, 2_800_000.0), (2193, 0.0, 173.0, 1_600_000.0, 10_000_000.0)])
def test_projected_systems(spark, code, lat, lon, east, north):
    p = points(spark, [(lat, lon, 5.0), (lat + 2, lon + 1.5, 1.0), (lat - 1, lon - 2, 0.0)])
    there = reproject.reproject(p, 4326, code).orderBy(POINT_IDX)
    assert tuple(there.first()["Position3D"]) == pytest.approx((east, north, 5.0), abs=1e-3)
    for r, e in zip(reproject.reproject(there, code, 4326).orderBy(POINT_IDX).collect(), p.orderBy(POINT_IDX).collect(), strict=True):
        assert tuple(r["Position3D"]) == pytest.approx(tuple(e["Position3D"]), abs=1e-7)


@pytest.mark.parametrize("code", [3309, 3310, 3577])
def test_projected_systems_and_back(spark, code):
    at = (-25.0, 133.0) if code == 3577 else (37.0, -121.0)
    p = points(spark, [(at[0] + i / 3, at[1] - i / 2, float(i)) for i in range(5)])
    for r, e in zip(reproject.reproject(reproject.reproject(p, 4326, code), code, 4326).orderBy(POINT_IDX).collect(), p.orderBy(POINT_IDX).collect(), strict=True):
        assert tuple(r["Position3D"]) == pytest.approx(tuple(e["Position3D"]), abs=1e-7)


def test_ransac_of_filtered_points(spark):
    rows = [(0, 0, p * p) if p % 5 == 0 else (p, p * p, 1) for p in range(2, 2002)]
    p = points(spark, rows).where(F.col(POINT_IDX) % 3 == 0)
    best, near = ransac.ransac_plane(p, 0.1, 60)
    assert best["ranking"] == near.count() == sum(i % 3 == 0 and (i + 2) % 5 != 0 for i in range(2000))
    assert ransac.ransac_line(p, 0.1, 120)[0]["ranking"] == sum(i % 3 == 0 and (i + 2) % 5 == 0 for i in range(2000))
    few = points(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0)]).where(F.col(POINT_IDX) >= 0)
    assert {r["ranking"] for r in ransac.ransac_planes(few, 0.1, 200).collect()} == {3}


def test_knn_of_copies_and_outliers(spark):
    rng = np.random.default_rng(8)
    dense = np.concatenate([np.repeat([[2.0, 2.0, 2.0]], 300, 0), rng.normal(size=(60, 3)) * 1e-6, [[1e6, 0, 0], [0.0, -0.0, 0.0], [-0.0, 0.0, 0.0]]])
    found = joins.knn(points(spark, dense), 4).collect()
    d = ((dense[:, None] - dense[None]) ** 2).sum(-1)
    expected = {(i, k + 1): j for i, row in enumerate(d) for k, j in enumerate(np.lexsort((np.arange(len(row)), row))[:4].tolist())}
    assert {(r[POINT_IDX], r["rank"]): r["neighbour"] for r in found} == expected


def test_hull_keeps_the_scan_parallel(spark):
    rng = np.random.default_rng(9)
    p = rng.normal(size=(3000, 3))
    one = {r[POINT_IDX] for r in hull.hull_vertices(points(spark, p).coalesce(1)).collect()}
    assert {r[POINT_IDX] for r in hull.hull_vertices(points(spark, p).repartition(40)).collect()} == one


def test_points_written_over_others(spark):
    p = points(spark, [(i, 0, 0) for i in range(5)])
    xs = lambda d: [r["Position3D"]["x"] for r in d.orderBy(POINT_IDX).collect()]
    assert xs(frame.write_at(p, points(spark, [(9, 0, 0), (8, 0, 0)]), 1)) == [0, 9, 8, 3, 4]
    assert xs(frame.write_at(p, points(spark, [(9, 0, 0), (8, 0, 0)]), 4)) == [0, 1, 2, 3, 9, 8]
    assert [r["Position3D"]["x"] for r in frame.attribute_range(p, "Position3D", 1, 3, "vec3i32").orderBy(POINT_IDX).collect()] == [1, 2]
    with pytest.raises(ValueError):
        frame.write_at(p, p, -1)


def brute_neighbours(p, k):
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    return {(i, r + 1): j for i, row in enumerate(d) for r, j in enumerate(np.lexsort((np.arange(len(row)), row))[:k].tolist())}


@pytest.mark.parametrize(("leaf", "block", "k"), [(40, 8, 5), (25, 16, 1), (60, 128, 7)])
def test_knn_across_leaves(spark, monkeypatch, leaf, block, k):
    """Many leaves and blocks, clusters of all widths, points far outside, copies, and positions on a grid, which tie."""
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(leaf)
    p = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(150, 3)) * 1e-5 + 3, rng.integers(0, 4, (200, 3)), np.repeat([[1.5, 1.5, 1.5]], 20, 0), [[1e9, 0, 0], [-1e12, 1e9, 4]]])
    found = joins.knn(points(spark, p), k).collect()
    assert {(r[POINT_IDX], r["rank"]): r["neighbour"] for r in found} == brute_neighbours(p, k)


def test_knn_of_positions_that_are_not_finite(spark):
    p = [(0, 0, 0), (1, 0, 0), (NAN, 0, 0), (0, INF, 0), (5, 0, 0), (0, 0, -INF)]
    found = joins.knn(points(spark, p), 3).collect()
    assert {r[POINT_IDX] for r in found} == {0, 1, 4} == {r["neighbour"] for r in found} and len(found) == 9
    with pytest.raises(ValueError):
        joins.knn(points(spark, p), 4)


def test_tree_leaves_are_even_whatever_the_extent():
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(size=(20_000, 3)), rng.normal(size=(20, 3)) * 1e9])
    tree = neighbours.Tree(p[::10], 5)
    assert np.bincount(tree.leaf(p), minlength=32).max() < 2.5 * len(p) / 32
    parts = neighbours.blocks(p)
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(p))) and max(map(len, parts)) <= neighbours.BLOCK


def boxes_of(spark, rows):
    vector = "struct<x:double,y:double,z:double>"
    return spark.createDataFrame([(i, (tuple(map(float, a)), tuple(map(float, b)))) for i, (a, b) in enumerate(rows)], f"id long, box struct<min:{vector},max:{vector}>")


@pytest.mark.parametrize("cell", [0.5, 3.0])
def test_boxes_of_mixed_sizes(spark, cell):
    rng = np.random.default_rng(4)
    low = rng.uniform(-50, 50, (60, 3))
    size = 10.0 ** rng.uniform(-3, 6, (60, 3))
    boxes = [(tuple(a), tuple(a + s)) for a, s in zip(low, size, strict=True)]
    boxes += [((-INF, -INF, -INF), (INF, INF, INF)), ((0, 0, 0), (INF, 1, 1)), ((3, 3, 3), (3, 3, 3)), ((1, 1, 1), (-1, 2, 2)), ((NAN, 0, 0), (1, 1, 1)), ((-1e300, 0, 0), (1e300, 1, 1))]
    p = np.concatenate([rng.uniform(-60, 60, (150, 3)), low[:20], [[3, 3, 3], [INF, 0.5, 0.5], [NAN, 0, 0], [1e200, 0.5, 0.5]]])
    holds = lambda b, q: all(x <= y <= z for x, y, z in zip(b[0], q, b[1], strict=True))
    got = sorted((r["id"], r[POINT_IDX]) for r in joins.points_in_boxes(points(spark, p), boxes_of(spark, boxes), cell).collect())
    assert got == [(i, j) for i, b in enumerate(boxes) for j, q in enumerate(p.tolist()) if holds(b, q)]
    right = boxes[::3] + [((2, 2, 2), (2.5, 1000, 2.5))]
    proper = lambda b: all(x <= y for x, y in zip(*b, strict=True))
    meet = lambda a, b: proper(a) and proper(b) and all(a[0][i] <= b[1][i] and a[1][i] >= b[0][i] for i in range(3))
    found = joins.boxes_intersecting(boxes_of(spark, boxes), boxes_of(spark, right), cell)
    assert sorted((r["id"], r["id_right"]) for r in found.collect()) == [(i, j) for i, a in enumerate(boxes) for j, b in enumerate(right) if meet(a, b)]


def test_large_boxes_are_listed_in_few_cells(spark):
    rows = joins.listed(boxes_of(spark, [((0, 0, 0), (100, 100, 100)), ((-1e9, 0, 0), (1e9, 1, 1)), ((0.1, 0.1, 0.1), (0.2, 0.2, 0.2))]), 1.0).groupBy("id").count().collect()
    assert max(r["count"] for r in rows) < 100 and joins.levels(boxes_of(spark, [((0, 0, 0), (1, 1, 1)), ((0, 0, 0), (100, 1, 1))]), 1.0) == [0, 6]
    assert joins.points_in_boxes(points(spark, [(0, 0, 0)]), boxes_of(spark, []), 1.0).count() == 0


FLAT = [((-5.0 * k, k, 0), (1e6, k + 0.5, 10.0**k)) for k in range(8)] + [((k, -1e5, 0), (k + 0.5, 1e5, 2)) for k in range(8)] + [((0, 0, -INF), (2, 2, INF)), ((1, 1, 1), (0, 9, 9))]


def test_points_in_flat_boxes(spark):
    """Boxes that are wide along one axis are told apart along the others, whether one cell holds them or more than a pack."""
    way, (shapes,) = joins._shapes([(boxes_of(spark, FLAT), "box")], 1.0)
    assert way == (True, 1) and 2 < len(shapes) <= joins.SHAPES
    shared = joins.listed(boxes_of(spark, FLAT[:8]), 1.0, way=way).groupBy("_shape", "_cell.i", "_cell.j", "_cell.k").count()
    assert max(r["count"] for r in shared.collect()) <= 2
    p = [(x, y, 1.0) for x in (-3.0, 0.25, 4.25, 5e5) for y in (-2.0, 0.25, 1.0, 3.75, 7.5)]
    got = sorted((r["id"], r[POINT_IDX]) for r in joins.points_in_boxes(points(spark, p), boxes_of(spark, FLAT), 1.0).collect())
    assert got == [(i, j) for i, b in enumerate(FLAT) for j, q in enumerate(p) if all(x <= y <= z for x, y, z in zip(b[0], q, b[1], strict=True))]


def test_flat_boxes_that_cross(spark):
    """Neither box of a pair is the larger one along all axes; each pair is found once. Both sides are dealt to all cores, for a table may be one partition."""
    meet = lambda a, b: all(max(a[0][i], b[0][i]) <= min(a[1][i], b[1][i]) for i in range(3))
    one = boxes_of(spark, FLAT)
    found = joins.boxes_intersecting(one, one, 1.0)
    assert sorted((r["id"], r["id_right"]) for r in found.collect()) == [(i, j) for i, a in enumerate(FLAT) for j, b in enumerate(FLAT) if meet(a, b)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 2


@pytest.mark.parametrize("shape", ["sphere", "ball", "grid", "stretched"])
def test_hull_by_sectors(spark, monkeypatch, shape):
    """Sectors find what one task finds, and their triangles close and hold all points."""
    rng = np.random.default_rng(3)
    p = rng.normal(size=(1500, 3))
    if shape in ("sphere", "stretched"):
        p /= np.linalg.norm(p, axis=1, keepdims=True)
    if shape == "stretched":
        p = np.concatenate([p * [1000, 1, 0.01] + 7, rng.normal(size=(300, 3)) * 1e-3])
    if shape == "grid":
        p = rng.integers(0, 9, (1500, 3)).astype(float)
    whole, faces = hull.hull_faces(p)
    monkeypatch.setattr(hull, "SECTOR", 150)
    monkeypatch.setattr(hull, "CHUNK", 100)
    got = [r[POINT_IDX] for r in hull.hull_vertices(points(spark, p).repartition(3)).collect()]
    assert len(got) == len(set(got))
    if shape != "grid":  # copies and points on edges: either is a vertex
        assert sorted(got) == sorted(whole)
    else:
        corners = p[np.isin(p, (0, 8)).all(1)]
        assert len(corners) and {tuple(v) for v in corners.tolist()} <= {tuple(v) for v in p[got].tolist()}
    mesh = np.array([tuple(r) for r in hull.hull_mesh(points(spark, p).repartition(3)).collect()])
    n, d = hull.planes(p, mesh)
    assert (p @ n.T - d).max() < 1e-7 * np.abs(p).max() and (shape == "grid" or len(mesh) == len(faces))
    edges = {(int(a), int(b)) for f in mesh for a, b in zip(f, np.roll(f, -1), strict=True)}
    assert len(edges) == 3 * len(mesh) and all((b, a) in edges for a, b in edges)


def test_hull_of_positions_that_are_not_finite(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(50, 3))
    odd = np.concatenate([p, [[NAN, 0, 0], [0, INF, 0], [0, 0, -INF]]])
    assert sorted(r[POINT_IDX] for r in hull.hull_vertices(points(spark, odd)).collect()) == sorted(hull.hull_faces(p)[0])
    assert hull.hull_mesh(points(spark, odd)).count() == len(hull.hull_faces(p)[1])
    assert hull.hull_vertices(points(spark, [(NAN, 0, 0)])).count() == 0


def place(spark, crs, lat, lon, h=0.0):
    """A position of the datum itself in a system, and back."""
    s = reproject._system(crs)
    there, back = reproject.FORMULAS[s.method]
    x, y = there(s, F.lit(lat), F.lit(lon))
    row = spark.range(1).select((x / s.unit).alias("x"), (y / s.unit).alias("y")).first()
    again = back(s, F.lit(row["x"] * s.unit), F.lit(row["y"] * s.unit))
    assert tuple(spark.range(1).select(again[0].alias("a"), again[1].alias("b")).first()) == pytest.approx((lat, lon), abs=2e-9)
    return tuple(row)


# The worked examples of the registry's guidance on coordinate operations.
EXAMPLES = [
    ("+proj=stere +lat_0=90 +lon_0=0 +k=0.994 +x_0=2000000 +y_0=2000000 +datum=WGS84", 73.0, 44.0, 3320416.75, 632668.43),
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000 +datum=WGS84", -75.0, 120.0, 7255380.79, 7053389.56),
    ("+proj=merc +lon_0=110 +k=0.997 +x_0=3900000 +y_0=900000 +ellps=bessel", -3.0, 120.0, 5009726.58, 569150.82),
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 50.5, 0.5, 577274.99, 69740.50),
    ("+proj=lcc +lat_0=27.833333333333333 +lat_1=28.383333333333333 +lat_2=30.283333333333333 +lon_0=-99 +x_0=609601.2192024384 +y_0=0 +ellps=clrk66 +units=us-ft", 28.5, -96.0, 2963503.91, 254759.80),
    ("+proj=omerc +lat_0=4 +lonc=115 +alpha=53.31582047222222 +gamma=53.13010236111111 +k=0.99984 +x_0=590476.87 +y_0=442857.65 +a=6377298.556 +rf=300.8017", 5.387253583333, 115.805505444444, 679245.73, 596562.78),
]


@pytest.mark.parametrize(("crs", "lat", "lon", "east", "north"), EXAMPLES)
def test_projections_by_their_worked_examples(spark, crs, lat, lon, east, north):
    assert place(spark, crs, lat, lon) == pytest.approx((east, north), abs=0.011)


def test_systems_by_text(spark):
    utm = 'PROJCS["WGS 84 / UTM zone 32N",GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",9],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],PARAMETER["false_northing",0],UNIT["metre",1],AUTHORITY["EPSG","32632"]]'
    assert reproject.of_wkt(utm) == reproject._system(32632) == reproject.of_wkt(f'COMPD_CS["both",{utm},VERT_CS["h",VERT_DATUM["v",2005],UNIT["metre",1]]]') == reproject.of_proj("+proj=utm +zone=32 +datum=WGS84 +units=m +no_defs")
    feet = utm.replace("500000", "1640416.6666666667").replace('UNIT["metre",1]', 'UNIT["US survey foot",0.3048006096012192]')
    assert place(spark, feet, 50.0, 8.0)[0] * 1200 / 3937 == pytest.approx(place(spark, utm, 50.0, 8.0)[0], abs=1e-6)
    p = points(spark, [(8.0, 50.0, 100.0)])
    lonlat, latlon = (tuple(reproject.reproject(q, crs, utm).first()["Position3D"]) for q, crs in ((p, "+proj=longlat +datum=WGS84"), (points(spark, [(50.0, 8.0, 100.0)]), 4326)))
    assert lonlat == latlon and lonlat[2] == 100.0
    polar = 'PROJCS["p",GEOGCS["WGS 84",DATUM["d",SPHEROID["s",6378137,298.257223563]],PRIMEM["Greenwich",0]],PROJECTION["Polar_Stereographic"],PARAMETER["latitude_of_origin",-71],PARAMETER["central_meridian",70],PARAMETER["false_easting",6000000],PARAMETER["false_northing",6000000],UNIT["metre",1]]'
    assert place(spark, polar, -75.0, 120.0) == pytest.approx((7255380.79, 7053389.56), abs=0.011)
    # A datum that is turned and scaled: there and back, and moved by about a hundred metres.
    british = "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +datum=OSGB36"
    there = reproject.reproject(points(spark, [(52.5, -1.5, 0.0)]), 4326, british)
    assert tuple(reproject.reproject(there, british, 4326).first()["Position3D"]) == pytest.approx((52.5, -1.5, 0.0), abs=1e-6)
    same = reproject.reproject(points(spark, [(52.5, -1.5, 0.0)]), 4326, british.replace("+datum=OSGB36", "+ellps=airy")).first()["Position3D"]
    assert 50 < np.hypot(there.first()["Position3D"]["x"] - same["x"], there.first()["Position3D"]["y"] - same["y"]) < 300
    for bad in ("+proj=robin", "+proj=utm +zone=3 +geoidgrids=x.gtx", "+proj=utm +zone=3 +nadgrids=x.gsb +towgs84=1,2,3", "+proj=merc +datum=nowhere", 'LOCAL_CS["x"]', 'PROJCS["x"', "+proj=stere +lat_0=45"):
        with pytest.raises(ValueError):
            reproject._system(bad)
