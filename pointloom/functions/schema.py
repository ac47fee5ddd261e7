"""Point types, built-in attributes and schemas of point tables.

A points table is a DataFrame with one column for each attribute and an explicit row index `point_idx`: the index is part of the
data model, because algorithms return indices and Spark keeps no row order. Each field's metadata names its point type.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POINT_IDX = "point_idx"


def _struct(names: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names])


#: Scalar point types: Spark type, bytes, signed range (None for floats). Unsigned types take the next wider Spark type.
SCALARS: dict[str, tuple[T.DataType, int, tuple[int, int] | None]] = {
    "u8": (T.ShortType(), 1, (0, 2**8 - 1)),
    "i8": (T.ByteType(), 1, (-(2**7), 2**7 - 1)),
    "u16": (T.IntegerType(), 2, (0, 2**16 - 1)),
    "i16": (T.ShortType(), 2, (-(2**15), 2**15 - 1)),
    "u32": (T.LongType(), 4, (0, 2**32 - 1)),
    "i32": (T.IntegerType(), 4, (-(2**31), 2**31 - 1)),
    "u64": (T.DecimalType(20, 0), 8, (0, 2**64 - 1)),
    "i64": (T.LongType(), 8, (-(2**63), 2**63 - 1)),
    "f32": (T.FloatType(), 4, None),
    "f64": (T.DoubleType(), 8, None),
}
#: Vector point types: component type and component names.
VECTORS: dict[str, tuple[str, str]] = {
    "vec3u8": ("u8", "xyz"),
    "vec3u16": ("u16", "xyz"),
    "vec3f32": ("f32", "xyz"),
    "vec3i32": ("i32", "xyz"),
    "vec3f64": ("f64", "xyz"),
    "vec4u8": ("u8", "xyzw"),
}


def parse_type(name: str) -> tuple[str, int]:
    """(base name, bytes). Byte arrays are "bytes[n]", custom types "custom:name[n]"."""
    if name in SCALARS:
        return name, SCALARS[name][1]
    if name in VECTORS:
        inner, parts = VECTORS[name]
        return name, SCALARS[inner][1] * len(parts)
    if name.endswith("]") and (name.startswith("bytes[") or name.startswith("custom:")):
        return name.split("[")[0], int(name[name.index("[") + 1 : -1])
    raise ValueError(f"unknown point type {name!r}")


def spark_type(name: str) -> T.DataType:
    base, _ = parse_type(name)
    if base in SCALARS:
        return SCALARS[base][0]
    if base in VECTORS:
        return _struct(VECTORS[base][1], SCALARS[VECTORS[base][0]][0])
    return T.BinaryType()


def alignment(name: str) -> int:
    base, _ = parse_type(name)
    return SCALARS[VECTORS[base][0] if base in VECTORS else base][1] if base in SCALARS or base in VECTORS else 1


def display_type(name: str) -> str:
    base, size = parse_type(name)
    if base in SCALARS:
        return base.upper()
    if base in VECTORS:
        return f"Vec{base[3]}<{base[4:]}>"
    return f"ByteArray[{size}]" if base == "bytes" else base.removeprefix("custom:")


@dataclass(frozen=True)
class Attribute:
    """A named, typed attribute. The name is its identity within a schema."""

    name: str
    type: str

    def with_type(self, kind: str) -> Attribute:
        return Attribute(self.name, kind)

    @property
    def size(self) -> int:
        return parse_type(self.type)[1]

    def __str__(self) -> str:
        return f"[{self.name};{display_type(self.type)}]"


# Names and default types of the built-in attributes.
BUILTIN = {
    name: Attribute(name, kind)
    for name, kind in (
        ("Position3D", "vec3f64"),
        ("Intensity", "u16"),
        ("ReturnNumber", "u8"),
        ("NumberOfReturns", "u8"),
        ("ClassificationFlags", "u8"),
        ("ScannerChannel", "u8"),
        ("ScanDirectionFlag", "u8"),
        ("EdgeOfFlightLine", "u8"),
        ("Classification", "u8"),
        ("ScanAngleRank", "i8"),
        ("ScanAngle", "i16"),
        ("UserData", "u8"),
        ("PointSourceID", "u16"),
        ("ColorRGB", "vec3u16"),
        ("GpsTime", "f64"),
        ("NIR", "u16"),
        ("WavePacketDescriptorIndex", "u8"),
        ("WaveformDataOffset", "u64"),
        ("WaveformPacketSize", "u32"),
        ("ReturnPointWaveformLocation", "f32"),
        ("WaveformParameters", "vec3f32"),
        ("PointID", "u64"),
        ("Normal", "vec3f32"),
        ("LASBasicFlags", "u8"),
        ("LASExtendedFlags", "u16"),
        ("LASLocalPosition", "vec3i32"),
        ("ColorRGBA", "vec4u8"),
    )
}


@dataclass(frozen=True)
class PointSchema:
    """An ordered set of attributes with unique names. packed: the binary layout's alignment; None takes each type's own."""

    attributes: tuple[Attribute, ...] = field(default=())
    packed: int | None = None

    def __post_init__(self):
        names = [a.name for a in self.attributes]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"attributes {twice} appear more than once")

    @classmethod
    def of(cls, *attributes: Attribute | str, packed: int | None = None) -> PointSchema:
        return cls(tuple(BUILTIN[a] if isinstance(a, str) else a for a in attributes), packed)

    def add(self, attribute: Attribute) -> PointSchema:
        return PointSchema((*self.attributes, attribute), self.packed)

    # Look-ups by name alone, and by name and type.
    def find(self, name: str) -> Attribute | None:
        return next((a for a in self.attributes if a.name == name), None)

    def has_name(self, name: str) -> bool:
        return self.find(name) is not None

    def has(self, attribute: Attribute) -> bool:
        return attribute in self.attributes

    def index_of(self, attribute: Attribute) -> int | None:
        return self.attributes.index(attribute) if attribute in self.attributes else None

    def same_attributes(self, other: PointSchema) -> bool:
        """Equal sets of (name, type), in any order and at any offset."""
        return set(self.attributes) == set(other.attributes)

    def offsets(self) -> list[int]:
        """Byte offset of each attribute in a packed or aligned record."""
        out, at = [], 0
        for a in self.attributes:
            step = min(alignment(a.type), self.packed) if self.packed else alignment(a.type)
            at = -(-at // step) * step
            out.append(at)
            at += a.size
        return out

    def offset_of(self, attribute: Attribute) -> int | None:
        i = self.index_of(attribute)
        return None if i is None else self.offsets()[i]

    @property
    def size(self) -> int:
        """Bytes of a record, padded to its largest alignment."""
        if not self.attributes:
            return 0
        end = self.offsets()[-1] + self.attributes[-1].size
        most = max(min(alignment(a.type), self.packed) if self.packed else alignment(a.type) for a in self.attributes)
        return -(-end // most) * most

    def struct_type(self, with_index: bool = True) -> T.StructType:
        fields = [T.StructField(a.name, spark_type(a.type), True, {"point_type": a.type}) for a in self.attributes]
        return T.StructType(([T.StructField(POINT_IDX, T.LongType())] if with_index else []) + fields)

    def json(self) -> str:
        return self.struct_type(False).json()

    @classmethod
    def from_struct(cls, schema: T.StructType) -> PointSchema:
        """The schema of a points table; fields without metadata get the point type that their Spark type stands for."""
        kinds = {T.ByteType(): "i8", T.ShortType(): "i16", T.IntegerType(): "i32", T.LongType(): "i64", T.FloatType(): "f32", T.DoubleType(): "f64"}
        out = []
        for f in schema.fields:
            if f.name == POINT_IDX:
                continue
            kind = (f.metadata or {}).get("point_type")
            shown = f.dataType.simpleString()  # without nullability, which edits change
            if kind is None and f.name in BUILTIN and shown == spark_type(BUILTIN[f.name].type).simpleString():
                kind = BUILTIN[f.name].type
            if kind is None and isinstance(f.dataType, T.StructType):
                kind = next((v for v in VECTORS if spark_type(v).simpleString() == shown), None)
            kind = kind or kinds.get(f.dataType)
            if kind is None:
                raise ValueError(f"{f.name}: {f.dataType.simpleString()} stands for no point type")
            out.append(Attribute(f.name, kind))
        return cls(tuple(out))

    @classmethod
    def from_json(cls, text: str) -> PointSchema:
        import json

        return cls.from_struct(T.StructType.fromJson(json.loads(text)))

    @classmethod
    def of_frame(cls, df: DataFrame) -> PointSchema:
        return cls.from_struct(df.schema)

    def __str__(self) -> str:
        return "PointSchema { " + ", ".join(f"{a} @ {o}" for a, o in zip(self.attributes, self.offsets(), strict=True)) + " }"


def point_class(**attributes: str):
    """Class decorator that declares a schema: a keyword names the class's field, its value a built-in attribute or "Name:type"."""

    def wrap(cls):
        found = []
        for name in attributes.values():
            head, _, kind = name.partition(":")
            found.append(Attribute(head, kind) if kind else BUILTIN[head])
        cls.point_schema = PointSchema(tuple(found))
        return cls

    return wrap
