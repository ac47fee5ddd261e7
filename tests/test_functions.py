"""Schemas, casts, geometry and bits on hand-computed values."""

import pytest
from pyspark.sql import functions as F

from pointloom.functions import bits, geometry
from pointloom.functions.casts import default_value, point_cast
from pointloom.functions.schema import BUILTIN, Attribute, PointSchema, display_type, point_class, spark_type


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_schema_lookups_and_offsets():
    s = PointSchema.of("Position3D", "Intensity", "Classification")
    assert s.offsets() == [0, 24, 26] and s.size == 32
    assert PointSchema.of("Classification", "GpsTime", packed=1).offsets() == [0, 1]
    assert s.has_name("Intensity") and not s.has(Attribute("Intensity", "i16")) and s.has(BUILTIN["Intensity"])
    assert s.index_of(BUILTIN["Classification"]) == 2 and s.offset_of(BUILTIN["Intensity"]) == 24
    assert s.same_attributes(PointSchema.of("Classification", "Position3D", "Intensity"))
    with pytest.raises(ValueError):
        s.add(BUILTIN["Intensity"])
    assert PointSchema.from_json(s.json()) == s
    assert str(BUILTIN["Position3D"]) == "[Position3D;Vec3<f64>]" and display_type("bytes[4]") == "ByteArray[4]"


def test_point_class():
    @point_class(position="Position3D", kind="Kind:u32")
    class Point: ...

    assert [a.type for a in Point.point_schema.attributes] == ["vec3f64", "u32"]


@pytest.mark.parametrize(
    ("value", "source", "target", "expected"),
    [
        (300, "i32", "u8", 44), (-1, "i32", "u8", 255), (-1, "i64", "u32", 2**32 - 1), (200, "u8", "i8", -56), (-129, "i16", "i8", 127),
        (1.9, "f64", "i32", 1), (-1.9, "f64", "i32", -1), (1e20, "f64", "i32", 2**31 - 1), (-5.0, "f64", "u16", 0), (float("nan"), "f64", "i64", 0),
        (1e30, "f64", "i64", 2**63 - 1), (-1e30, "f64", "i64", -(2**63)), (float("inf"), "f32", "u8", 255), (2**63, "u64", "i64", -(2**63)), (-1, "i64", "u64", 2**64 - 1),
        (1e19, "f64", "u64", 10**19), (16777217, "i32", "f32", 16777216.0),
    ],
)
def test_scalar_casts(spark, value, source, target, expected):
    got = one(spark, point_cast(F.lit(str(value) if isinstance(value, int) else value).cast(spark_type(source)), source, target))[0]
    assert got == expected


def test_vector_casts(spark):
    v = geometry.vec(F.lit(1.7), F.lit(-2.5), F.lit(300.0))
    assert tuple(one(spark, point_cast(v, "vec3f64", "vec3u8"))[0]) == (1, 0, 255)
    for a, b in (("f64", "vec3f64"), ("vec4u8", "vec3u8"), ("bytes[2]", "u16")):
        with pytest.raises(ValueError):
            point_cast(v, a, b)
    assert tuple(one(spark, default_value("vec3u16"))[0]) == (0, 0, 0)
    assert one(spark, default_value("bytes[3]"))[0] == bytearray(3)


def test_boxes(spark):
    b = geometry.box((1.0, 1.0, 1.0), (2.0, 2.0, 2.0))
    p = geometry.vector((0.99, 1.5, 2.0))
    q = geometry.vector((2.001, 1.999, 2.0))
    nan = geometry.vector((float("nan"), 1.5, 1.5))
    got = one(spark, *[geometry.box_contains_approx(b, x, e) for x, e in ((p, 0.015), (p, 0.001), (q, 0.0015), (q, 0.0001), (nan, 0.1))], geometry.box_contains(b, p))
    assert got == (True, False, True, False, True, False)
    cube = one(spark, geometry.box_cubic(geometry.box((0.0, 0.0, 0.0), (1.0, 2.0, 4.0))))[0]
    assert tuple(cube["min"]) == (-1.5, -1.0, 0.0) and tuple(cube["max"]) == (2.5, 3.0, 4.0)
    with pytest.raises(ValueError):
        geometry.box((1.0, 0.0, 0.0), (0.0, 1.0, 1.0))
    touching = geometry.box((2.0, 2.0, 2.0), (3.0, 3.0, 3.0))
    assert one(spark, geometry.box_intersects(b, touching), geometry.box_intersects(b, geometry.box((2.1, 0.0, 0.0), (3.0, 3.0, 3.0)))) == (True, False)


def test_bits(spark):
    for value in (0, 1, 0b101, 2**21 - 1, 123_456):
        spread = sum((value >> i & 1) << 3 * i for i in range(21))
        assert one(spark, bits.spread3(F.lit(value)))[0] == spread
    for value in (0, 1, -1, 2**63 - 1, 0x0123456789ABCDEF):
        back = int(f"{value & 2**64 - 1:064b}"[::-1], 2)
        assert one(spark, bits.reverse_bits(F.lit(value)))[0] & 2**64 - 1 == back
    assert one(spark, bits.align_to(F.lit(13), 8), bits.align_to(F.lit(16), 8)) == (16, 16)


def test_local_positions(spark):
    p = geometry.vector((1.9999, -1.9999, 0.0))
    assert tuple(one(spark, geometry.local_position(p, (0.001, 0.001, 0.001), (0.0, 0.0, 0.0)))[0]) == (1999, -1999, 0)
    with pytest.raises(Exception, match="32 bits"):
        one(spark, geometry.local_position(geometry.vector((1e12, 0.0, 0.0)), (0.001, 1.0, 1.0), (0.0, 0.0, 0.0)))


def test_untyped_points(spark):
    from pyspark.sql import functions as F

    from pointloom.functions.casts import point_cast
    from pointloom.functions.schema import SCALARS, PointSchema, spark_type
    from pointloom.functions.untyped import UntypedPoint, cast_value
    from pointloom.operators.frame import in_memory
    from decimal import Decimal

    values = {"f64": [-1e30, -300.7, -0.5, 0.0, 1.5, 255.5, 1e10, 1e30, float("inf"), float("nan")], "i64": [-(2**63), -300, -1, 0, 127, 128, 255, 256, 70_000, 2**40 + 5, 2**63 - 1], "u64": [0, 300, 2**63, 2**64 - 1]}
    for source, numbers in values.items():
        numbers = [Decimal(v) for v in numbers] if source == "u64" else numbers
        d = spark.createDataFrame([(i, v) for i, v in enumerate(numbers)], f"i int, v {spark_type(source).simpleString()}")
        targets = [t for t in SCALARS if t != source]
        for r in d.select("i", *[point_cast(F.col("v"), source, t).alias(t) for t in targets]).collect():
            for t in targets:
                got, expected = cast_value(numbers[r["i"]], source, t), r[t]
                assert got == expected or (got != got and expected != expected), (source, numbers[r["i"]], t)
    schema = PointSchema.of("Position3D", "Intensity", "ColorRGB")
    p = UntypedPoint.of_row(schema, in_memory(spark, schema, [((1.5, -2.5, 3.0), 7, (1, 2, 3))]).first())
    assert p.get("Position3D", "vec3i32") == (1, -2, 3) and p.get("Intensity", "f64") == 7.0
    p.set("Intensity", -1, "i32")
    p.set("ColorRGB", (1.9, 70000.0, -3.0), "vec3f64")
    assert p.get("Intensity") == 65535 and p.get("ColorRGB") == (1, 65535, 0) and p.get("Intensity", "u8") == 255
    assert in_memory(spark, schema, [p.row(0)[1:]]).first()["Intensity"] == 65535 and UntypedPoint(schema).get("Position3D") == (0.0, 0.0, 0.0)
    for bad in (lambda: p.get("GpsTime"), lambda: p.get("Intensity", "vec3f64"), lambda: p.set("Intensity", (1, 2, 3), "vec3u8")):
        with pytest.raises(ValueError):
            bad()


def test_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from pointloom.plans.scratch import shared_dir

    for master in ("spark://host:7077", "local-cluster[3,2,1024]"):
        session = SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda key, default: default))
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session)
