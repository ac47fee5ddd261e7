"""The LAS binary format: headers, variable-length records, point records as numpy types. No Spark in here."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions.schema import BUILTIN, Attribute, PointSchema

# Names and types of the fields of a point record, by group, and the groups of each point format.
CORE = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("Intensity", "<u2")]
OLD = [("flags", "u1"), ("Classification", "u1"), ("ScanAngleRank", "i1"), ("UserData", "u1"), ("PointSourceID", "<u2")]
NEW = [("flags", "<u2"), ("Classification", "u1"), ("UserData", "u1"), ("ScanAngle", "<i2"), ("PointSourceID", "<u2")]
GPS = [("GpsTime", "<f8")]
RGB = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
INFRARED = [("NIR", "<u2")]
WAVE = [
    ("WavePacketDescriptorIndex", "u1"), ("WaveformDataOffset", "<u8"), ("WaveformPacketSize", "<u4"), ("ReturnPointWaveformLocation", "<f4"),
    ("wx", "<f4"), ("wy", "<f4"), ("wz", "<f4"),
]
FORMATS = {
    0: [OLD],
    1: [OLD, GPS],
    2: [OLD, RGB],
    3: [OLD, GPS, RGB],
    4: [OLD, GPS, WAVE],
    5: [OLD, GPS, RGB, WAVE],
    6: [NEW, GPS],
    7: [NEW, GPS, RGB],
    8: [NEW, GPS, RGB, INFRARED],
    9: [NEW, GPS, WAVE],
    10: [NEW, GPS, RGB, INFRARED, WAVE],
}
# Types of described extra bytes by their code, 1 to 10.
EXTRA_TYPES = {1: "u8", 2: "i8", 3: "u16", 4: "i16", 5: "u32", 6: "i32", 7: "u64", 8: "i64", 9: "f32", 10: "f64"}
NUMPY = {"u8": "u1", "i8": "i1", "u16": "<u2", "i16": "<i2", "u32": "<u4", "i32": "<i4", "u64": "<u8", "i64": "<i8", "f32": "<f4", "f64": "<f8"}
VLR_USER = "LASF_Spec"
CLASS_LOOKUP, TEXT_AREA, EXTRA_BYTES = 0, 3, 4


def record_dtype(fmt: int, extra: list[tuple[str, str]] = (), trailing: int = 0) -> np.dtype:
    """The packed record of a point format with described extra attributes and undescribed bytes after them."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown point format {fmt}")
    fields = CORE + [f for group in FORMATS[fmt] for f in group] + [(n, NUMPY[t]) for n, t in extra]
    return np.dtype(fields + ([("UndescribedExtraBytes", f"V{trailing}")] if trailing else []))


def is_extended(fmt: int) -> bool:
    return fmt >= 6


def format_schema(fmt: int, extra: list[tuple[str, str]] = (), trailing: int = 0, exact: bool = False) -> PointSchema:
    """Attributes of a point format: decoded, or exactly as stored (local positions, packed flags)."""
    groups = FORMATS[fmt]
    names = ["LASLocalPosition" if exact else "Position3D", "Intensity"]
    if is_extended(fmt):
        flags = ["ReturnNumber", "NumberOfReturns", "ClassificationFlags", "ScannerChannel", "ScanDirectionFlag", "EdgeOfFlightLine"]
        names += [*(["LASExtendedFlags"] if exact else flags), "Classification", *(["UserData", "ScanAngle"]), "PointSourceID"]
    else:
        flags = ["ReturnNumber", "NumberOfReturns", "ScanDirectionFlag", "EdgeOfFlightLine"]
        names += [*(["LASBasicFlags"] if exact else flags), "Classification", "ScanAngleRank", "UserData", "PointSourceID"]
    for group, found in ((GPS, ["GpsTime"]), (RGB, ["ColorRGB"]), (INFRARED, ["NIR"])):
        names += found if group in groups else []
    if WAVE in groups:
        names += [n for n, _ in WAVE[:4]] + ["WaveformParameters"]
    attributes = [BUILTIN[n] for n in names] + [Attribute(n, t) for n, t in extra]
    return PointSchema(tuple(attributes + ([Attribute("UndescribedExtraBytes", f"bytes[{trailing}]")] if trailing else [])), packed=1)


def best_format(schema: PointSchema) -> int:
    """The smallest point format with the schema's time, colour, infrared, waveform and extended attributes."""
    has = schema.has_name
    wave = any(has(n) for n in [*(n for n, _ in WAVE[:4]), "WaveformParameters"])
    extended = any(has(n) for n in ("ClassificationFlags", "ScannerChannel", "ScanAngle", "NIR"))
    if extended:
        if has("NIR"):
            return 10 if wave else 8
        if has("ColorRGB"):
            return 10 if wave else 7
        return 9 if wave else 6
    if wave:
        return 5 if has("ColorRGB") else 4
    return {(False, False): 0, (True, False): 1, (False, True): 2, (True, True): 3}[has("GpsTime"), has("ColorRGB")]


@dataclass
class Vlr:
    user: str
    record: int
    data: bytes
    description: str = ""

    def pack(self) -> bytes:
        return struct.pack("<H16sHH32s", 0, self.user.encode(), self.record, len(self.data), self.description.encode()) + self.data


def class_lookup(vlr: Vlr) -> dict[int, str]:
    rows = [vlr.data[i : i + 16] for i in range(0, len(vlr.data) - 15, 16)]
    return {r[0]: r[1:].split(b"\0")[0].decode("ascii", "replace") for r in rows if any(r)}


def pack_class_lookup(names: dict[int, str]) -> Vlr:
    rows = b"".join(struct.pack("<B15s", k, v.encode()) for k, v in sorted(names.items()))
    return Vlr(VLR_USER, CLASS_LOOKUP, rows.ljust(256 * 16, b"\0"))


def text_area(vlr: Vlr) -> str:
    return vlr.data.split(b"\0")[0].decode("utf-8", "replace")


@dataclass
class ExtraField:
    """One described extra attribute; absent limits are None. Values are raw: value * scale + offset where those are given."""

    name: str
    type: str
    scale: float | None = None
    offset: float | None = None
    low: float | None = None
    high: float | None = None
    no_data: float | None = None
    description: str = ""

    @classmethod
    def unpack(cls, raw: bytes) -> ExtraField | None:
        code, options = raw[2], raw[3]
        if code not in EXTRA_TYPES:
            return None
        kind = EXTRA_TYPES[code]
        any_type = "<d" if kind.startswith("f") else "<Q" if kind.startswith("u") else "<q"
        value = lambda bit, at, f: struct.unpack_from(f, raw, at)[0] if options & bit else None
        text = lambda a, b: raw[a:b].split(b"\0")[0].decode("utf-8", "replace")
        return cls(text(4, 36), kind, value(8, 112, "<d"), value(16, 136, "<d"), value(2, 64, any_type), value(4, 88, any_type), value(1, 40, any_type), text(160, 192))

    def pack(self) -> bytes:
        code = next(k for k, v in EXTRA_TYPES.items() if v == self.type)
        any_type = "<d" if self.type.startswith("f") else "<Q" if self.type.startswith("u") else "<q"
        raw = bytearray(192)
        raw[2] = code
        raw[4:36] = self.name.encode()[:32].ljust(32, b"\0")
        raw[160:192] = self.description.encode()[:32].ljust(32, b"\0")
        for bit, at, f, v in ((1, 40, any_type, self.no_data), (2, 64, any_type, self.low), (4, 88, any_type, self.high), (8, 112, "<d", self.scale), (16, 136, "<d", self.offset)):
            if v is not None:
                raw[3] |= bit
                struct.pack_into(f, raw, at, v if f == "<d" else int(v))
        return bytes(raw)


@dataclass
class Header:
    """What a file says about itself. bounds: (min x, y, z, max x, y, z); by_return: points of each return number."""

    version: tuple[int, int]
    fmt: int
    record_size: int
    count: int
    point_at: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    bounds: tuple[float, ...]
    by_return: list[int]
    vlrs: list[Vlr] = field(default_factory=list)
    compressed: bool = False
    system: str = ""
    software: str = ""

    @property
    def described(self) -> list[ExtraField]:
        for v in self.vlrs:
            if v.user == VLR_USER and v.record == EXTRA_BYTES:
                rows = [ExtraField.unpack(v.data[i : i + 192]) for i in range(0, len(v.data) - 191, 192)]
                return [r for r in rows if r]
        return []

    @property
    def extra(self) -> list[tuple[str, str]]:
        return [(e.name, e.type) for e in self.described]

    @property
    def trailing(self) -> int:
        """Bytes of a record that nothing describes."""
        return self.record_size - record_dtype(self.fmt, self.extra).itemsize

    def dtype(self) -> np.dtype:
        if self.trailing < 0:
            raise ValueError("point records are shorter than their format")
        return record_dtype(self.fmt, self.extra, self.trailing)

    def schema(self, exact: bool = False) -> PointSchema:
        return format_schema(self.fmt, self.extra, self.trailing, exact)


def read_header(data: bytes) -> Header:
    """data: the file's head, up to the point data. Only the fixed part is needed where the records that follow don't matter."""
    if len(data) < 227 or data[:4] != b"LASF":
        raise ValueError("no LAS file")
    version = (data[24], data[25])
    size, point_at, n_vlrs, raw_fmt, record_size = struct.unpack_from("<HIIBH", data, 94)
    count, *by_return = struct.unpack_from("<I5I", data, 107)
    sx, sy, sz, ox, oy, oz, hx, lx, hy, ly, hz, lz = struct.unpack_from("<12d", data, 131)
    if version >= (1, 4):
        count, *by_return = struct.unpack_from("<Q15Q", data, 247)
    vlrs, at = [], size
    for _ in range(n_vlrs):
        if at + 54 > len(data):
            break
        _, user, record, n, text = struct.unpack_from("<H16sHH32s", data, at)
        vlrs.append(Vlr(user.split(b"\0")[0].decode("ascii", "replace"), record, data[at + 54 : at + 54 + n], text.split(b"\0")[0].decode("ascii", "replace")))
        at += 54 + n
    name = lambda a, b: data[a:b].split(b"\0")[0].decode("ascii", "replace")
    compressed = bool(raw_fmt & 0x80) or any(v.user == "laszip encoded" for v in vlrs)
    return Header(version, raw_fmt & 0x3F, record_size, count, point_at, (sx, sy, sz), (ox, oy, oz), (lx, ly, lz, hx, hy, hz), list(by_return), vlrs, compressed, name(26, 58), name(58, 90))


def pack_header(h: Header) -> bytes:
    """Version 1.4 header with its records; counts beyond 32 bits and formats 6 to 10 leave the old count fields empty."""
    body = b"".join(v.pack() for v in h.vlrs)
    old = h.count < 2**32 and not is_extended(h.fmt)
    raw = bytearray(375)
    raw[0:4] = b"LASF"
    raw[24:26] = bytes((1, 4))
    raw[26:58] = h.system.encode()[:32].ljust(32, b"\0")
    raw[58:90] = h.software.encode()[:32].ljust(32, b"\0")
    struct.pack_into("<HIIBH", raw, 94, 375, 375 + len(body), len(h.vlrs), h.fmt | 0x80 * h.compressed, h.record_size)
    first = (h.by_return + [0] * 15)[:15]
    struct.pack_into("<I5I", raw, 107, h.count if old else 0, *(first[:5] if old else [0] * 5))
    lx, ly, lz, hx, hy, hz = h.bounds
    struct.pack_into("<12d", raw, 131, *h.scale, *h.offset, hx, lx, hy, ly, hz, lz)
    struct.pack_into("<QQIQ15Q", raw, 227, 0, 0, 0, h.count, *first)
    return bytes(raw) + body
