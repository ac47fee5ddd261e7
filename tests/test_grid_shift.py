"""Shifts by grids: files laid out by hand, bilinear lookup against a loop over points, there and back."""

import struct

import numpy as np
import pytest

from pointloom.functions.schema import POINT_IDX, PointSchema
from pointloom.operators import frame, grid_shift, reproject

NAN = float("nan")


def layout(grids, order="<", unit="SECONDS"):
    """A file of (name, parent, south, north, east, west, step, shifts by corner), borders in the unit, longitudes westwards."""
    record = lambda name, kind, v: name.ljust(8).encode() + (v.ljust(8).encode() if kind == "s" else struct.pack(order + kind + ("4x" if kind == "i" else ""), v))
    out = [record("NUM_OREC", "i", 11), record("NUM_SREC", "i", 11), record("NUM_FILE", "i", len(grids)), record("GS_TYPE", "s", unit), record("VERSION", "s", "T"), record("SYSTEM_F", "s", "A"), record("SYSTEM_T", "s", "B")]
    out += [record(n, "d", 1.0) for n in ("MAJOR_F", "MINOR_F", "MAJOR_T", "MINOR_T")]
    for name, parent, south, north, east, west, step, shifts in grids:
        rows, columns = round((north - south) / step) + 1, round((west - east) / step) + 1
        out += [record(n, "s", v) for n, v in (("SUB_NAME", name), ("PARENT", parent), ("CREATED", "x"), ("UPDATED", "x"))]
        out += [record(n, "d", v) for n, v in (("S_LAT", south), ("N_LAT", north), ("E_LONG", east), ("W_LONG", west), ("LAT_INC", step), ("LONG_INC", step))]
        out.append(record("GS_COUNT", "i", rows * columns))
        out += [struct.pack(order + "4f", *shifts(south + i * step, east + j * step), 0.0, 0.0) for i in range(rows) for j in range(columns)]
    return b"".join(out) + b"END     " + bytes(8)


# Shifts that single precision holds exactly, linear in the corners' places, so that bilinear lookup is exact anywhere.
COARSE = ("COARSE", "NONE", 45 * 3600.0, 47 * 3600.0, -9 * 3600.0, -6 * 3600.0, 1800.0, lambda y, x: (1.5 + y / 28800, -4.0 + x / 14400))
FINE = ("FINE", "COARSE", 45.5 * 3600, 46 * 3600.0, -8 * 3600.0, -7.5 * 3600, 600.0, lambda y, x: (2.0 + y / 19200, -3.0))


def expected(lat, lon):
    for g in (FINE, COARSE):
        if g[2] <= lat * 3600 <= g[3] and g[4] <= -lon * 3600 <= g[5]:
            dlat, dlon = g[7](lat * 3600, -lon * 3600)
            return dlat / 3600, -dlon / 3600
    return NAN, NAN


PLACES = [(45.0, 6.0), (47.0, 9.0), (46.2, 6.7), (45.75, 7.6), (45.5, 8.0), (46.0, 7.5), (45.49, 7.7), (44.99, 7.0), (46.0, 9.01), (NAN, 7.0), (46.0, -7.0)]


@pytest.mark.parametrize("order", ["<", ">"])
def test_finest_grid_of_a_file(order):
    grids = grid_shift.parse(layout([COARSE, FINE], order))
    assert [g.lat.shape for g in grids] == [(4, 4), (5, 7)]
    lat, lon = map(np.array, zip(*PLACES, strict=True))
    got = grid_shift.shift([grids], lat, lon)
    np.testing.assert_allclose(np.transpose(got), [expected(*p) for p in PLACES], atol=1e-11)
    over = [np.nan_to_num(x, nan=0.0) for x in grid_shift.shift([grids, None], lat[:9], lon[:9])]
    np.testing.assert_allclose(np.transpose(over), np.nan_to_num([expected(*p) for p in PLACES[:9]]), atol=1e-11)
    far = grid_shift.shift([grids], lat[2:3], lon[2:3] - 360)  # the same meridian
    np.testing.assert_allclose(np.ravel(far), expected(*PLACES[2]), atol=1e-11)


def test_lookup_matches_a_loop_and_comes_back():
    rng = np.random.default_rng(5)
    corners = {}
    rough = lambda y, x: corners.setdefault((y, x), tuple(map(float, rng.normal(0, 30, 2).astype(np.float32))))
    grids = grid_shift.parse(layout([("R", "NONE", -2.0, 1.0, 1.0, 6.0, 0.25, rough)], unit="DEGREES"))
    lat, lon = rng.uniform(-2, 1, 500), -rng.uniform(1, 6, 500)
    got = grid_shift.shift([grids], lat, lon)
    for k, (y, w) in enumerate(zip(lat, -lon, strict=True)):
        i, j = np.floor((y + 2) / 0.25), np.floor((w - 1) / 0.25)
        v, u = (y + 2) / 0.25 - i, (w - 1) / 0.25 - j
        value = sum(np.array(corners[-2 + a * 0.25, 1 + b * 0.25]) * p * q for a, p in ((i, 1 - v), (i + 1, v)) for b, q in ((j, 1 - u), (j + 1, u)))
        assert got[0][k] == pytest.approx(value[0], rel=1e-5, abs=1e-4) and got[1][k] == pytest.approx(-value[1], rel=1e-5, abs=1e-4)  # degrees here
    mild = lambda y, x: (3 + np.sin(y / 900), 5 * np.cos(x / 700))
    grids = grid_shift.parse(layout([("M", "NONE", 0.0, 7200.0, 0.0, 7200.0, 300.0, mild)]))
    lat, lon = rng.uniform(0.1, 1.9, 500), -rng.uniform(0.1, 1.9, 500)
    dlat, dlon = grid_shift.shift([grids], lat, lon)
    back = grid_shift.unshift([grids], lat + dlat, lon + dlon)
    assert np.abs(dlat).min() > 1e-4
    np.testing.assert_allclose(back, [lat, lon], atol=1e-11)
    assert len(grid_shift.unshift([grids], lat[:0], lon[:0])[0]) == 0


def test_systems_with_grids(spark, tmp_path, monkeypatch):
    file = tmp_path / "shifts.gsb"
    file.write_bytes(layout([COARSE, FINE]))
    own = f"+proj=longlat +ellps=clrk66 +nadgrids=@{tmp_path}/absent.gsb,{file}"
    there = [(lat, lon) for lat, lon in PLACES[:9] if not np.isnan(expected(lat, lon)[0])]
    p = frame.in_memory(spark, PointSchema.of("Position3D"), [((lon, lat, 7.0),) for lat, lon in [*there, (44.0, 7.0)]])
    wgs = reproject.reproject(p, own, 4326)
    got = [tuple(r["Position3D"]) for r in wgs.orderBy(POINT_IDX).collect()]
    for (lat, lon), g in zip(there, got, strict=False):
        a, b = expected(lat, lon)
        assert g == pytest.approx((lat + a, lon + b, 7.0), abs=1e-11)
    assert np.isnan(got[-1][:2]).all() and got[-1][2] == 7.0
    assert wgs._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    inner = frame.in_memory(spark, PointSchema.of("Position3D"), [((lon, lat, 0.0),) for lat, lon in PLACES[2:4]])
    utm = f"+proj=utm +zone=32 +ellps=clrk66 +nadgrids={file},null"
    back = reproject.reproject(reproject.reproject(inner, own, utm), utm, own)
    for r, (lat, lon) in zip(back.orderBy(POINT_IDX).collect(), PLACES[2:4], strict=True):
        assert tuple(r["Position3D"]) == pytest.approx((lon, lat, 0.0), abs=1e-8)
    assert reproject.reproject(inner.limit(0), own, 4326).count() == 0
    with pytest.raises(FileNotFoundError):
        reproject.reproject(p, f"+proj=longlat +nadgrids={tmp_path}/absent.gsb", 4326)
    monkeypatch.setattr(grid_shift, "MAX_BYTES", 100)
    with pytest.raises(ValueError, match="more than 100 bytes"):
        reproject.reproject(p, own, 4326)


@pytest.mark.parametrize("spoil", [lambda b: b"", lambda b: b[:500], lambda b: b.replace(b"SECONDS", b"FATHOMS"), lambda b: b[:200], lambda b: b"X" + b[1:]])
def test_files_that_are_no_grids(spoil):
    with pytest.raises(ValueError):
        grid_shift.parse(spoil(layout([COARSE])))
