"""Readers and writers on files made here."""

import json
import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.schema import POINT_IDX, Attribute, PointSchema
from pointloom.operators import frame
from pointloom.sources import ascii as text_points
from pointloom.sources import las_format as fmt
from pointloom.sources import laz_codec, raw
from pointloom.sources.dispatch import read_points, read_points_into, write_points
from pointloom.sources.las import crs_text, las_bytes, las_metadata, read_las, write_las, write_laz
from pointloom.sources.pnts import PntsSource, pack_tile, pnts_metadata, read_pnts, read_tile, write_pnts
from pointloom.sources.tileset_points import contents, read_tileset_points, region_box, volume_box
from pointloom.sources.tileset import box_volume, check_tile, read_tileset, sphere_volume, tileset

SIZES = [20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67]
BY_INDEX = lambda d: d.orderBy(POINT_IDX).collect()


def ten_points(number, extra=(), trailing=0):
    dtype = fmt.record_dtype(number, extra, trailing)
    raw = np.zeros(10, dtype)
    i = np.arange(10)
    for c in "xyz":
        raw[c] = i * 1000
    raw["Intensity"] = i * 255
    raw["flags"] = i % 8 | (i % 8) << (4 if number >= 6 else 3)
    raw["Classification"] = i
    for name in ("GpsTime", "red", "green", "blue", "NIR"):
        if name in dtype.names:
            raw[name] = i + 0.5 if name == "GpsTime" else i << 4
    return raw


def las_file(path, number, vlrs=(), extra=(), trailing=0):
    raw = ten_points(number, extra, trailing)
    h = fmt.Header((1, 4), number, raw.dtype.itemsize, 10, 0, (0.001,) * 3, (0.0,) * 3, (0.0, 0.0, 0.0, 9.0, 9.0, 9.0), [2, 1, 1, 1, 1], list(vlrs), software="test")
    path.write_bytes(las_bytes(h, raw))
    return str(path)


@pytest.mark.parametrize("number", range(11))
def test_las_formats(spark, tmp_path, number):
    assert fmt.record_dtype(number).itemsize == SIZES[number]
    path = las_file(tmp_path / "a.las", number)
    rows = BY_INDEX(read_las(spark, path, pointsPerPartition=3))
    assert [r[POINT_IDX] for r in rows] == list(range(10))
    assert [tuple(r["Position3D"]) for r in rows] == [pytest.approx((i, i, i)) for i in range(10)]
    assert [r["Intensity"] for r in rows] == [i * 255 for i in range(10)]
    assert [(r["ReturnNumber"], r["NumberOfReturns"]) for r in rows] == [(i % 8, i % 8) for i in range(10)]
    exact = read_las(spark, path, exact=True)
    assert ("LASExtendedFlags" if number >= 6 else "LASBasicFlags") in exact.columns and BY_INDEX(exact)[3]["LASLocalPosition"]["x"] == 3000
    assert fmt.best_format(fmt.format_schema(number)) == number


@pytest.mark.parametrize("number", range(11))
def test_las_round_trip(spark, tmp_path, number):
    points = read_las(spark, las_file(tmp_path / "a.las", number))
    write_las(points, str(tmp_path / "out"))
    back = read_points(spark, str(tmp_path / "out"))
    assert frame.equal_points(points, back.select(points.columns)).first()[0]
    meta = las_metadata(spark, str(tmp_path / "out")).collect()
    assert sum(m["point_count"] for m in meta) == 10 and {m["point_format"] for m in meta} == {number}
    assert sum(sum(m["points_by_return"]) for m in meta) == 8


def test_las_extra_bytes_and_records(spark, tmp_path):
    described = fmt.ExtraField("Quality", "f32", scale=0.5, low=1.0, description="how good")
    vlrs = [
        fmt.pack_class_lookup({2: "ground", 6: "building"}),
        fmt.Vlr(fmt.VLR_USER, fmt.TEXT_AREA, b"hello\0"),
        fmt.Vlr(fmt.VLR_USER, fmt.EXTRA_BYTES, described.pack()),
    ]
    path = las_file(tmp_path / "a.las", 1, vlrs, [("Quality", "f32")], 3)
    df = read_las(spark, path)
    assert df.schema["Quality"].metadata == {"point_type": "f32"} and df.schema["UndescribedExtraBytes"].metadata == {"point_type": "bytes[3]"}
    m = las_metadata(spark, path).first()
    assert m["class_names"] == {2: "ground", 6: "building"} and m["text"] == "hello" and m["extra_fields"][0]["scale"] == 0.5
    assert fmt.ExtraField.unpack(described.pack()) == described


def test_las_extra_attributes_round_trip(spark, tmp_path):
    schema = PointSchema.of("Position3D", "Intensity").add(Attribute("Quality", "f32")).add(Attribute("Tag", "u32"))
    p = frame.in_memory(spark, schema, [((float(i), 0.0, 0.0), i, i / 2, 2**32 - 1 - i) for i in range(5)])
    write_las(p, str(tmp_path / "o"), extra=("Quality", "Tag"))
    back = read_las(spark, str(tmp_path / "o"))
    assert frame.equal_points(p, back.select(p.columns)).first()[0]
    assert [e["name"] for e in las_metadata(spark, str(tmp_path / "o")).first()["extra_fields"]] == ["Quality", "Tag"]
    with pytest.raises(ValueError):
        write_las(p, str(tmp_path / "q"), extra=("Position3D",))


def test_las_pruning_and_errors(spark, tmp_path):
    las_file(tmp_path / "a.las", 0)
    las_file(tmp_path / "b.las", 0)
    both = read_las(spark, str(tmp_path))
    assert both.count() == 20 and both.select(F.max(POINT_IDX)).first()[0] == 19
    assert read_las(spark, str(tmp_path), minX=100).count() == 0
    assert read_las(spark, str(tmp_path), columns="Position3D,Intensity").columns == [POINT_IDX, "Position3D", "Intensity"]
    assert read_points_into(both, str(tmp_path / "a.las")).count() == 30
    (tmp_path / "c.laz").write_bytes(b"LASF")
    for bad in (tmp_path / "c.laz", tmp_path / "d.xyz"):
        with pytest.raises(Exception, match="no LAS file|no reader"):
            read_points(spark, str(bad)).count()
    with pytest.raises(ValueError):
        write_las(both, str(tmp_path / "o"), scale=(0.0, 1.0, 1.0))
    with pytest.raises(ValueError):
        write_points(both, str(tmp_path / "o"), kind="xyz")
    (tmp_path / "e").mkdir()
    las_file(tmp_path / "e" / "a.las", 0)
    (tmp_path / "e" / "b.pnts").write_bytes(pack_tile({"POSITION": np.zeros((1, 3), np.float32)}, 1))
    with pytest.raises(ValueError, match="different kinds"):
        read_points(spark, str(tmp_path / "e"))


def test_las_filters_are_pushed(spark, tmp_path):
    for k, name in enumerate("abc"):
        raw = ten_points(1)
        raw["x"] += k * 100_000
        h = fmt.Header((1, 4), 1, raw.dtype.itemsize, 10, 0, (0.001,) * 3, (0.0,) * 3, (k * 100.0, 0.0, 0.0, k * 100 + 9.0, 9.0, 9.0), [2, 1, 1, 1, 1], [])
        (tmp_path / f"{name}.las").write_bytes(las_bytes(h, raw))
    p = read_las(spark, str(tmp_path), pointsPerPartition=4)
    parts = lambda d: d.rdd.getNumPartitions()
    assert parts(p) == 9
    idx, x = F.col(POINT_IDX), F.col("Position3D.x")
    for keep, count, most in (
        (idx >= 25, 5, 2), (idx < 3, 3, 1), (idx == 17, 1, 1), ((idx >= 8) & (idx < 12), 4, 2), (idx.isin(4, 29), 2, 9), (x > 150, 10, 3), (x <= 9, 10, 3),
        ((x >= 100) & (x < 105), 5, 3), (F.col("Position3D.y") > 50, 0, 1), (idx == 99, 0, 1),
    ):
        some = p.where(keep)
        assert some.count() == count == read_las(spark, str(tmp_path), pushdown=False).where(keep).count() and parts(some) <= most
    seeked = BY_INDEX(frame.seek(p, 28))
    assert [r[POINT_IDX] for r in seeked] == [28, 29] and seeked[0]["Position3D"]["x"] == pytest.approx(208)
    exact = read_las(spark, str(tmp_path), exact=True).where(F.col("LASLocalPosition.x") > 150_000)
    assert exact.count() == 10


def test_folders_of_different_layouts_raise(spark, tmp_path):
    las_file(tmp_path / "a.las", 0)
    las_file(tmp_path / "b.las", 3)
    with pytest.raises(Exception, match="b.las: its attributes differ"):
        read_las(spark, str(tmp_path)).count()
    at = np.zeros((1, 3), np.float32)
    (tmp_path / "a.pnts").write_bytes(pack_tile({"POSITION": at}, 1))
    (tmp_path / "b.pnts").write_bytes(pack_tile({"POSITION": at, "NORMAL": at}, 1))
    with pytest.raises(Exception, match="b.pnts: its semantics differ"):
        read_pnts(spark, str(tmp_path)).count()


def test_reading_into_a_layout(spark, tmp_path):
    path = las_file(tmp_path / "a.las", 0)
    layout = PointSchema((Attribute("Intensity", "u8"), Attribute("GpsTime", "f64"), Attribute("Position3D", "vec3f32")))
    got = read_points(spark, path, layout)
    assert got.columns == [POINT_IDX, "Intensity", "GpsTime", "Position3D"]
    assert [(r["Intensity"], r["GpsTime"]) for r in BY_INDEX(got)] == [(i * 255 % 256, 0.0) for i in range(10)]
    over = read_points_into(got.where(F.col(POINT_IDX) < 6), path, at=3)
    assert [r["Position3D"]["x"] for r in BY_INDEX(over)] == [0, 1, 2, *range(10)]


def test_tiles_are_planned_from_their_heads(spark, tmp_path, monkeypatch):
    from pointloom.sources import pnts

    at = np.arange(30, dtype=np.float32).reshape(10, 3)
    whole = pack_tile({"POSITION": at}, 10, [1.0, 2.0, 3.0])
    (tmp_path / "a.pnts").write_bytes(whole)
    body = np.array([7, 0], np.uint32).tobytes() + at[:7].tobytes()
    head = json.dumps({"POINTS_LENGTH": {"byteOffset": 0}, "POSITION": {"byteOffset": 8}}).encode().ljust(100)
    (tmp_path / "b.pnts").write_bytes(pnts.HEADER.pack(b"pnts", 1, 28 + 100 + len(body), 100, len(body), 0, 0) + head + body)
    monkeypatch.setattr(pnts, "load_tile", None)
    parts = pnts.PntsReader({"path": str(tmp_path)}).partitions()
    assert [(p.path[-6:], p.first) for p in parts] == [("a.pnts", 0), ("b.pnts", 10)] and pnts.tile_head(str(tmp_path / "b.pnts")).length == 7
    monkeypatch.undo()
    assert read_pnts(spark, str(tmp_path)).count() == 17
    (tmp_path / "c.pnts").write_bytes(whole[:-9])
    with pytest.raises(ValueError, match="cut off"):
        pnts.tile_head(str(tmp_path / "c.pnts"))


def test_tiles_of_bounded_size(spark, tmp_path):
    p = frame.in_memory(spark, PointSchema.of("Position3D", "ColorRGB"), [((float(i), 0.0, 0.0), (i, i, 255)) for i in range(25)]).coalesce(1)
    p.sparkSession.dataSource.register(PntsSource)
    rows = p.select(F.struct(*[F.col("Position3D")[a].cast("float").alias(a) for a in "xyz"]).alias("Position3D"), F.struct(*[F.col("ColorRGB")[a].cast("short").alias(a) for a in "xyz"]).alias("ColorRGB"))
    rows.write.format("points_pnts").mode("append").option("pointsPerTile", 10).save(str(tmp_path / "o"))
    assert sorted(m["points_length"] for m in pnts_metadata(spark, str(tmp_path / "o")).collect()) == [5, 10, 10]
    assert [r["Position3D"]["x"] for r in BY_INDEX(read_pnts(spark, str(tmp_path / "o")))] == list(range(25))


def test_las_writes_what_it_can(spark, tmp_path):
    schema = PointSchema((Attribute("Classification", "u16"), Attribute("Intensity", "i64"), Attribute("ColorRGB", "vec3f64"), Attribute("GpsTime", "f32"), Attribute("Normal", "vec3f32"), Attribute("Position3D", "vec3f32")))
    p = frame.in_memory(spark, schema, [(300, -1, (1.5, 2.5, 70000.0), 2.0, (0.0, 0.0, 1.0), (1.0, 2.0, 3.0))])
    write_points(p, str(tmp_path / "o"), kind="las")
    r = read_las(spark, str(tmp_path / "o")).first()
    assert (r["Classification"], r["Intensity"], tuple(r["ColorRGB"]), r["GpsTime"], r["UserData"]) == (44, 65535, (1, 2, 65535), 2.0, 0)
    assert "Normal" not in r


def test_tiles(spark, tmp_path):
    at = np.array([[10, 20, 30], [20, 30, 40]], np.float32)
    (tmp_path / "a.pnts").write_bytes(pack_tile({"POSITION": at, "RGB": np.array([[1, 2, 3], [4, 5, 255]])}, 2, [10.0, 10.0, 10.0]))
    path = str(tmp_path / "a.pnts")
    assert [tuple(r["Position3D"]) for r in BY_INDEX(read_points(spark, path))] == [(20, 30, 40), (30, 40, 50)]
    relative = BY_INDEX(read_pnts(spark, path, positionsMode="relative"))
    assert [tuple(r["Position3D"]) for r in relative] == [(10, 20, 30), (20, 30, 40)] and tuple(relative[1]["ColorRGB"]) == (4, 5, 255)
    assert tuple(pnts_metadata(spark, path).first()[1:3]) == (2, [10.0, 10.0, 10.0])
    with pytest.raises(ValueError):
        read_tile(b"pnts")
    named = read_tile(pack_tile({"POSITION": at}, 2, batch={"id": [1, 2], "h": {"byteOffset": 0, "componentType": "FLOAT", "type": "SCALAR"}}, batch_body=b"12345678"))
    assert named.batch["id"] == [1, 2] and named.batch_body == b"12345678" and named.length == 2
    points = read_points(spark, path)
    write_pnts(points, str(tmp_path / "out"), (1.0, 2.0, 3.0))
    assert read_pnts(spark, str(tmp_path / "out"), positionsMode="relative").count() == 2
    tiles = read_tileset(spark, str(tmp_path / "out" / "tileset.json")).orderBy("tile_path").collect()
    assert tiles[0]["uri"] is None and all(t["uri"].endswith(".pnts") for t in tiles[1:])


def test_tilesets(spark, tmp_path):
    child = {"boundingVolume": sphere_volume([0.0, 0.0, 0.0], 1.0), "geometricError": 0.0, "content": {"uri": "a.pnts"}}
    root = {"boundingVolume": box_volume([0, 0, 0], [2, 4, 6]), "geometricError": 5.0, "refine": "REPLACE", "children": [child, child | {"children": [child]}]}
    (tmp_path / "t.json").write_text(json.dumps(tileset(root, 10.0)))
    rows = [tuple(r)[1:] for r in read_tileset(spark, str(tmp_path / "t.json")).orderBy("tile_path").collect()]
    assert [r[0] for r in rows] == ["0", "0/0", "0/1", "0/1/0"] and {r[3] for r in rows} == {"REPLACE"}
    assert rows[0][5] == [1, 2, 3, 1, 0, 0, 0, 2, 0, 0, 0, 3]
    with pytest.raises(ValueError):
        check_tile({"geometricError": 1.0})


ALL = "xyzirncuRGBtpedaI"


def all_lines(n=10):
    return "".join(", ".join(str(v) for v in (i, i, i, i, i % 8, i, i, i, i, i, i, i, i, i % 2, i % 2, -i, i)) + "\n" for i in range(n))


def test_ascii_all_fields(spark, tmp_path):
    (tmp_path / "a.txt").write_text(all_lines())
    rows = BY_INDEX(text_points.read_ascii(spark, str(tmp_path / "a.txt"), ALL, ", "))
    assert [tuple(r["Position3D"]) for r in rows] == [(i, i, i) for i in range(10)]
    r = rows[7]
    assert (r["Intensity"], r["UserData"], tuple(r["ColorRGB"]), r["GpsTime"], r["EdgeOfFlightLine"], r["ScanAngleRank"], r["NIR"]) == (7, 7, (7, 7, 7), 7.0, 1, -7, 7)
    points = text_points.read_ascii(spark, str(tmp_path / "a.txt"), ALL, ", ")
    text_points.write_ascii(points, str(tmp_path / "out"), ALL)
    back = text_points.read_ascii(spark, str(tmp_path / "out"), ALL, ", ")
    assert frame.equal_points(points, back).first()[0]


@pytest.mark.parametrize("most", [0, 50_000])
def test_ascii_of_many_splits(spark, tmp_path, monkeypatch, most):
    """Lines are numbered in the order of files and splits, with the splits' row numbers broadcast or shuffled."""
    monkeypatch.setattr(text_points, "BROADCAST_SPLITS", most)
    for k, name in enumerate("abc"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{k * 500 + i},0,0\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = text_points.read_ascii(spark, str(tmp_path), "xyz")
        assert [(r[POINT_IDX], r["Position3D"]["x"]) for r in BY_INDEX(got)] == [(i, float(i)) for i in range(1500)]
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == bool(most)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(("line", "letters"), [("67.3", "i"), ("2", "e"), ("2.0.0", "x"), ("1", "xi"), ("300", "r"), ("-5", "r"), ("65536", "i"), ("-1", "R"), ("128", "a"), ("-129", "a"), ("99999999999", "u"), (" 1", "i")])
def test_ascii_errors(spark, tmp_path, line, letters):
    (tmp_path / "a.txt").write_text(line + "\n")
    with pytest.raises(Exception, match="line 1"):
        text_points.read_ascii(spark, str(tmp_path / "a.txt"), letters).collect()


@pytest.mark.parametrize(("line", "letters"), [("255", "r"), ("0", "u"), ("65535", "i"), ("-128", "a"), ("127", "a"), ("+7", "I")])
def test_ascii_limits(spark, tmp_path, line, letters):
    (tmp_path / "a.txt").write_text(line + "\n")
    assert int(text_points.read_ascii(spark, str(tmp_path / "a.txt"), letters).first()[1]) == int(line)


def test_ascii_lines(spark, tmp_path):
    p = frame.in_memory(spark, PointSchema.of("Position3D", "Intensity"), [((1.5, 100.0, 0.123456789), 7)])
    assert text_points.ascii_lines(p, "xyzis").first()["value"] == "1.5, 100.0, 0.12346, 7, "
    assert text_points.ascii_lines(p, "y", precision=0).first()["value"] == "100.0"
    with pytest.raises(ValueError):
        text_points.ascii_lines(p, "q")
    with pytest.raises(ValueError):
        text_points.ascii_lines(p, "t")


@pytest.mark.parametrize("packed", [None, 1, 4])
def test_raw_records(spark, tmp_path, packed):
    kinds = {"a": "u8", "b": "f64", "c": "u64", "d": "vec3u16", "e": "bytes[5]", "f": "i8", "g": "u32", "h": "vec3f32"}
    schema = PointSchema(tuple(Attribute(n, k) for n, k in kinds.items()), packed)
    rows = [(i % 256, i / 3, 2**64 - 1 - i, (i, 65535 - i, 7), bytes([i % 256] * 5), i % 256 - 128, 2**32 - 1 - i, (i + 0.5, 0.0, -1.0)) for i in range(300)]
    p = frame.in_memory(spark, schema, [(*r[:2], Decimal(r[2]), *r[3:]) for r in rows]).repartition(3)
    written = raw.write_raw(p, str(tmp_path / "o"), packed)
    assert written.offsets() == schema.offsets() and sum(f.stat().st_size for f in (tmp_path / "o").glob("*.bin")) == 300 * schema.size
    back = raw.read_raw(spark, str(tmp_path / "o"), written, pointsPerPartition=70)
    assert frame.equal_points(p, back).first()[0] and back.rdd.getNumPartitions() >= 5
    one = np.frombuffer(b"".join(f.read_bytes() for f in sorted((tmp_path / "o").glob("*.bin"))), raw.record_dtype(schema))
    assert one["c"][17] == 2**64 - 18 and one["d"][17].tolist() == [17, 65518, 7]
    with open(next((tmp_path / "o").glob("*.bin")), "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="no multiple"):
        raw.read_raw(spark, str(tmp_path / "o"), written).count()


def test_raw_attributes(spark):
    schema = PointSchema.of("Position3D", "Intensity", "ColorRGB")
    p = frame.in_memory(spark, schema, [((1.0, 2.0, 3.0), 513, (1, 2, 65535))])
    assert bytes(raw.raw_attribute(p, "Position3D").first()[1]) == np.array([1.0, 2.0, 3.0]).tobytes()
    assert bytes(raw.raw_attribute(p, "Intensity").first()[1]) == b"\x01\x02" and bytes(raw.raw_attribute(p, "ColorRGB").first()[1]) == b"\1\0\2\0\xff\xff"
    with pytest.raises(ValueError):
        raw.raw_attribute(p, "NIR")


def random_records(number, n, seed, smooth, extra=()):
    """Records that change a little or in all bits. Formats 6 on have returns that exist, and channels."""
    rng, dtype = np.random.default_rng(seed), fmt.record_dtype(number, list(extra))
    raw, t = np.frombuffer(rng.bytes(n * dtype.itemsize), dtype).copy(), np.arange(n)
    if smooth:
        raw = np.zeros(n, dtype)
        raw["x"], raw["y"], raw["z"] = t * 13 + rng.integers(-5, 5, n), t // 100 * 50, 1000 + rng.integers(-3, 3, n)
        raw["Intensity"], raw["Classification"], raw["PointSourceID"], raw["UserData"] = rng.integers(0, 400, n), t // 50 % 3, t // 70, t // 30 % 2
        raw["ScanAngle" if number >= 6 else "ScanAngleRank"] = t // 20 % 60 - 30
        for name in {"GpsTime", "red", "green", "blue", "NIR"} & set(dtype.names):
            raw[name] = 1e5 + t // 3 * 1e-5 + (t // 40 % 3) * 1e4 if name == "GpsTime" else t % 200 * 100
        for name, _ in extra:
            raw[name] = t % 7
    numbers = rng.integers(1, 4 if smooth else 16, n)
    returns = 1 + rng.integers(0, 99, n) % numbers
    if number >= 6:
        raw["flags"] = returns | numbers << 4 | (0 if smooth else rng.integers(0, 16, n) << 8 | rng.integers(0, 4, n) << 14) | t // 40 % 3 << 12
    elif smooth:
        raw["flags"] = returns | numbers << 3
    return raw


@pytest.mark.parametrize("number", [0, 1, 2, 3, 6, 7, 8])
def test_coded_chunks_hold_their_records(number):
    for smooth in (True, False):
        for extra in ((), (("a", "u16"), ("b", "u8"))):
            for n in (1, 2, 40, 700):
                raw = random_records(number, n, n, smooth, extra)
                data = laz_codec.encode_chunk(raw, number)
                assert laz_codec.decode_chunk(data, n, raw.dtype, number).tobytes() == raw.tobytes()
                assert laz_codec.decode_chunk(data, (n + 1) // 2, raw.dtype, number, n).tobytes() == raw[: (n + 1) // 2].tobytes()
            assert smooth == (len(data) < raw.nbytes / 2)


def test_coded_numbers():
    """Sizes of chunks and single numbers of all widths; steps of time that leave and come back."""
    rng = np.random.default_rng(2)
    for sizes in ([], [5], rng.integers(0, 1 << 31, 300).tolist(), [7] * 300):
        assert [s for _, s in laz_codec.unpack_table(laz_codec.pack_table(sizes), False)] == sizes
    values = [0, 1, -1, 127, -128, 2**31 - 1, -(2**31), *rng.integers(-(2**31), 2**31, 200).tolist()]
    coder, numbers = laz_codec.Encoder(), laz_codec.Integers(32)
    for near, v in zip(values[1:], values, strict=False):
        coder.integer(numbers, near, v)
    coder, numbers = laz_codec.Decoder(coder.finish()), laz_codec.Integers(32)
    assert [coder.integer(numbers, near) for near in values[1:]] == values[:-1]
    for same in (True, False):
        steps = [0, 1, 1, 1, 9, 500, 501, -3, -10, -11, 2**31, -(2**40), 2**40, 5, 7] * 20
        times = np.cumsum(steps).tolist()
        times = times if same else [v for i, v in enumerate(times) if not i or v != times[i - 1]]
        coder, state = laz_codec.Encoder(), laz_codec.Times(3, same)
        for v in times:
            state.code(coder, v)
        coder, state = laz_codec.Decoder(coder.finish()), laz_codec.Times(3, same)
        assert [state.code(coder, 0) for _ in times] == times


@pytest.mark.parametrize("number", [1, 3, 6, 8])
def test_laz_files_are_their_las_twins(spark, tmp_path, number):
    raw = random_records(number, 1000, number, True)
    (tmp_path / "in").mkdir()
    h = fmt.Header((1, 4), number, raw.dtype.itemsize, 1000, 0, (2**-10,) * 3, (0.0,) * 3, (-1.0, -1.0, 0.0, 99.0, 99.0, 9.0), [1000], [])
    (tmp_path / "in" / "a.las").write_bytes(las_bytes(h, raw))
    points = read_las(spark, str(tmp_path / "in"))
    write_laz(points.repartitionByRange(3, POINT_IDX), str(tmp_path / "out"), fmt=number, scale=(2**-10,) * 3, chunk_size=60)
    assert {p.suffix for p in (tmp_path / "out").iterdir() if p.name.startswith("part")} == {".laz"}
    back = read_points(spark, str(tmp_path / "out"), pointsPerPartition=130)
    assert BY_INDEX(back) == BY_INDEX(points) and back.columns == points.columns
    parts = lambda d: d.rdd.getNumPartitions()
    assert parts(back) >= 8
    some = back.where((F.col(POINT_IDX) >= 250) & (F.col(POINT_IDX) < 300))
    assert parts(some) <= 2 and [r[POINT_IDX] for r in BY_INDEX(some)] == list(range(250, 300))
    assert las_metadata(spark, str(tmp_path / "out")).agg(F.sum("point_count")).first()[0] == 1000
    (tmp_path / "out" / "b.las").write_bytes(las_bytes(h, raw))  # both kinds in one folder
    assert read_points(spark, str(tmp_path / "out")).count() == 2000


def test_laz_files_of_other_writers(spark, tmp_path):
    """Chunks of varying sizes, the place of their table at the file's end; records that have no codec; files that end early."""
    raw = random_records(0, 100, 0, True)
    parts = [raw[:10], raw[10:75], raw[75:]]
    how = laz_codec.Description(laz_codec.POINTWISE, laz_codec.WORD, laz_codec.items(0, 0))
    vlr = fmt.Vlr(laz_codec.VLR_USER, laz_codec.VLR_RECORD, how.pack())
    h = fmt.Header((1, 4), 0, 20, 100, 0, (0.001,) * 3, (0.0,) * 3, (-1.0, -1.0, 0.0, 99.0, 99.0, 9.0), [100], [vlr], compressed=True)
    body = [laz_codec.encode_chunk(p, 0) for p in parts]
    coder, numbers, was = laz_codec.Encoder(), laz_codec.Integers(32, 2), (0, 0)
    for now in zip(map(len, parts), map(len, body), strict=True):
        for context in (0, 1):
            coder.integer(numbers, was[context], now[context], context)
        was = now
    head = fmt.pack_header(h)
    table = struct.pack("<II", 0, 3) + coder.finish()
    at = len(head) + 8 + sum(map(len, body))
    (tmp_path / "a.laz").write_bytes(head + struct.pack("<q", -1) + b"".join(body) + table + struct.pack("<q", at))
    back = read_las(spark, str(tmp_path / "a.laz"), pointsPerPartition=1, exact=True)
    assert back.rdd.getNumPartitions() == 3
    assert [r["LASLocalPosition"]["x"] for r in BY_INDEX(back)] == raw["x"].tolist()
    whole = (tmp_path / "a.laz").read_bytes()
    (tmp_path / "b.laz").write_bytes(whole[: len(head)] + struct.pack("<q", at) + whole[len(head) + 8 : at - 40])
    with pytest.raises(Exception):  # noqa: B017
        read_las(spark, str(tmp_path / "b.laz")).count()
    for number in (4, 9):
        with pytest.raises(ValueError, match="no codec"):
            write_laz(read_las(spark, las_file(tmp_path / f"{number}.las", number)), str(tmp_path / "o"))
    bad = random_records(6, 5, 1, True)
    bad["flags"] = 3 | 2 << 4
    with pytest.raises(ValueError, match="return 3 of 2"):
        laz_codec.encode_chunk(bad, 6)


def test_laz_of_no_points_and_extra_attributes(spark, tmp_path):
    points = read_las(spark, las_file(tmp_path / "a.las", 0, extra=(("height", "f32"),), vlrs=[fmt.Vlr("LASF_Spec", 4, fmt.ExtraField("height", "f32").pack())]))
    write_laz(points, str(tmp_path / "o"), extra=("height",), chunk_size=4)
    assert BY_INDEX(read_las(spark, str(tmp_path / "o"))) == BY_INDEX(points)
    write_laz(points.where("false"), str(tmp_path / "none"))
    empty = read_las(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and "Intensity" in empty.columns


def turned(angle, scale, at):
    """A transform by columns: turned about z, scaled, moved."""
    c, s = scale * np.cos(angle), scale * np.sin(angle)
    return [c, s, 0, 0, -s, c, 0, 0, 0, 0, scale, 0, *at, 1]


def tree_of_tiles(tmp_path):
    """A root that children add to, a tile that its child replaces, and an external tileset under a transform."""
    rng = np.random.default_rng(6)
    tiles = {n: rng.uniform(0, 10, (20, 3)).astype(np.float32) for n in ("root", "coarse", "fine", "far")}
    (tmp_path / "sub").mkdir()
    for name, at in tiles.items():
        path = tmp_path / "sub" / "far.pnts" if name == "far" else tmp_path / f"{name}.pnts"
        path.write_bytes(pack_tile({"POSITION": at, "NORMAL": at * 0 + [1, 0, 0]}, 20, [1.0, 0.0, 0.0] if name == "far" else None))
    box = box_volume([0.0] * 3, [11.0] * 3)
    fine = {"boundingVolume": box, "geometricError": 0, "content": {"uri": "fine.pnts"}}
    coarse = {"boundingVolume": box, "geometricError": 4, "refine": "REPLACE", "content": {"uri": "coarse.pnts"}, "transform": turned(0, 1, [100, 0, 0]), "children": [fine]}
    outer = {"boundingVolume": box_volume([-20.0] * 3, [20.0] * 3), "geometricError": 2, "transform": turned(np.pi / 2, 2, [0, 1000, 5]), "content": {"uri": "sub/tileset.json"}}
    root = {"boundingVolume": sphere_volume([0.0] * 3, 5000.0), "geometricError": 9, "refine": "ADD", "content": {"uri": "root.pnts", "boundingVolume": box}, "children": [coarse, outer]}
    (tmp_path / "tileset.json").write_text(json.dumps(tileset(root, 9.0)))
    (tmp_path / "sub" / "tileset.json").write_text(json.dumps(tileset({"boundingVolume": box, "geometricError": 0, "content": {"uri": "far.pnts"}, "transform": turned(0, 1, [0, 0, 3])}, 1.0)))
    x, y, z = (tiles["far"].astype(float) + [1, 0, 0]).T
    where = {"root": tiles["root"].astype(float), "coarse": tiles["coarse"] + [100.0, 0, 0], "fine": tiles["fine"] + [100.0, 0, 0], "far": np.stack([-2 * y, 2 * x + 1000, 2 * (z + 3) + 5], 1)}
    return str(tmp_path / "tileset.json"), where


def test_points_of_a_tileset(spark, tmp_path):
    path, where = tree_of_tiles(tmp_path)
    at = lambda d: np.array([tuple(r["Position3D"]) for r in BY_INDEX(d)])
    points = read_points(spark, path)
    assert np.allclose(at(points), np.concatenate([where[n] for n in ("root", "fine", "far")]), atol=1e-9)
    assert [r[POINT_IDX] for r in BY_INDEX(points)] == list(range(60))
    assert np.allclose([tuple(r["Normal"]) for r in BY_INDEX(points)][-20:], [(0, 1, 0)] * 20, atol=1e-6)
    assert np.allclose(at(read_points(spark, path, geometricError=4)), np.concatenate([where[n] for n in ("root", "coarse", "far")]), atol=1e-9)
    parts = lambda d: d.rdd.getNumPartitions()
    assert parts(points) == 3
    x, y = F.col("Position3D.x"), F.col("Position3D.y")
    for keep, tiles, most in ((x > 90, ("fine",), 1), ((y > 500) & (x <= 0), ("far",), 1), (x > 1e6, (), 0), (y < 50, ("root", "fine"), 2), (F.col("Position3D.z") < 5, ("root", "fine"), 2)):
        some, all_ = points.where(keep), read_tileset_points(spark, path, pushdown=False).where(keep)
        assert BY_INDEX(some) == BY_INDEX(all_) and parts(some) <= max(most, 1)
        assert sum(len(where[t]) for t in tiles) >= some.count()
    (tmp_path / "sub" / "tileset.json").unlink()  # a branch that is cut isn't opened
    assert read_points(spark, path, maxY=500).count() == 40
    with pytest.raises(Exception):  # noqa: B017
        read_points(spark, path).count()


def test_tilesets_that_refer_to_each_other_raise(tmp_path):
    box = box_volume([0.0] * 3, [1.0] * 3)
    (tmp_path / "a.json").write_text(json.dumps(tileset({"boundingVolume": box, "geometricError": 1, "content": {"uri": "a.json"}}, 1.0)))
    with pytest.raises(ValueError, match="nest"):
        contents(str(tmp_path / "a.json"), [(-np.inf, np.inf)] * 3)
    (tmp_path / "b.json").write_text(json.dumps(tileset({"boundingVolume": box, "geometricError": 1, "content": {"uri": "mesh.b3dm"}}, 1.0)))
    with pytest.raises(ValueError, match="no point tile"):
        contents(str(tmp_path / "b.json"), [(-np.inf, np.inf)] * 3)


def test_boxes_of_volumes_hold_them():
    rng = np.random.default_rng(7)
    for _ in range(60):
        west, south = rng.uniform(-np.pi, np.pi), rng.uniform(-np.pi / 2, np.pi / 2)
        east, north = west + rng.uniform(0, 3), min(np.pi / 2, south + rng.uniform(0, 2))
        low, high = -100.0, 3000.0
        lon, lat, h = rng.uniform(west, east, 300), rng.uniform(south, north, 300), rng.uniform(low, high, 300)
        n = 6378137.0 / np.sqrt(1 - 0.0066943799901413165 * np.sin(lat) ** 2)
        p = np.stack([(n + h) * np.cos(lat) * np.cos(lon), (n + h) * np.cos(lat) * np.sin(lon), (n * (1 - 0.0066943799901413165) + h) * np.sin(lat)], 1)
        east = east - 2 * np.pi if east > np.pi else east
        a, b = region_box(west, south, east, north, low, high)
        assert (p >= a - 1e-6).all() and (p <= b + 1e-6).all()
        m = np.eye(4)
        m[:3] = rng.normal(size=(3, 4))
        half = rng.normal(size=(3, 3))
        inside = rng.uniform(-1, 1, (200, 3)) @ half + [1, 2, 3]
        a, b = volume_box({"box": [1, 2, 3, *half.ravel()]}, m)
        q = inside @ m[:3, :3].T + m[:3, 3]
        assert (q >= a - 1e-9).all() and (q <= b + 1e-9).all()
        u = rng.normal(size=(200, 3))
        q = ([1, 2, 3] + 2 * u / np.linalg.norm(u, axis=1, keepdims=True)) @ m[:3, :3].T + m[:3, 3]
        a, b = volume_box({"sphere": [1, 2, 3, 2]}, m)
        assert (q >= a - 1e-9).all() and (q <= b + 1e-9).all()


def test_coordinate_systems_of_files(tmp_path):
    from pointloom.operators.reproject import _system

    keys = struct.pack("<16H", 1, 1, 0, 3, 1024, 0, 1, 1, 3072, 0, 1, 32632, 2048, 0, 1, 4326)
    wkt = 'GEOGCS["WGS 84",DATUM["d",SPHEROID["s",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433],AXIS["Latitude",NORTH],AXIS["Longitude",EAST]]'
    found = [crs_text(las_file(tmp_path / f"{i}.las", 0, vlrs=[fmt.Vlr("LASF_Projection", r, d)])) for i, (r, d) in enumerate([(34735, keys), (2112, wkt.encode() + b"\0")])]
    assert found == ["EPSG:32632", wkt] and crs_text(las_file(tmp_path / "n.las", 0)) is None
    assert _system(found[0]).lon == 9 and _system(found[1]).lat_first
