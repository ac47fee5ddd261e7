"""Delimited text points: a format string with one letter for each field, read and written with DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.casts import point_cast
from ..functions.schema import BUILTIN, POINT_IDX, PointSchema, spark_type

# Letters of the format and the attribute, or component, that each stands for.
LETTERS = {
    "s": None,
    "x": ("Position3D", "x"),
    "y": ("Position3D", "y"),
    "z": ("Position3D", "z"),
    "i": ("Intensity", None),
    "r": ("ReturnNumber", None),
    "n": ("NumberOfReturns", None),
    "c": ("Classification", None),
    "t": ("GpsTime", None),
    "u": ("UserData", None),
    "p": ("PointSourceID", None),
    "R": ("ColorRGB", "x"),
    "G": ("ColorRGB", "y"),
    "B": ("ColorRGB", "z"),
    "I": ("NIR", None),
    "a": ("ScanAngleRank", None),
    "e": ("EdgeOfFlightLine", None),
    "d": ("ScanDirectionFlag", None),
}
FLAGS = "ed"
#: Splits up to which one row for each (about 200 bytes) is broadcast to number lines; beyond, lines are shuffled by split.
BROADCAST_SPLITS = 50_000
RANGES = {"u8": (0, 255), "i8": (-128, 127), "u16": (0, 65_535)}
INTEGER, NUMBER = r"^[+-]?[0-9]+$", r"^[+-]?(inf|infinity|nan|[0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?)$"


def parse_format(text: str) -> list[tuple[str, tuple[str, str | None] | None]]:
    for c in text:
        if c not in LETTERS:
            raise ValueError(f"unknown letter {c!r} in the format {text!r}")
    return [(c, LETTERS[c]) for c in text]


def format_schema(text: str) -> PointSchema:
    names = dict.fromkeys(found[0] for _, found in parse_format(text) if found)
    return PointSchema.of(*names)


def _component_type(name: str) -> str:
    kind = BUILTIN[name].type
    return {"vec3f64": "f64", "vec3u16": "u16"}.get(kind, kind)


def read_ascii(spark: SparkSession, path: str, fmt: str, delimiter: str = ",") -> DataFrame:
    """Points of text files, in file and line order. Fields aren't trimmed; extra fields are ignored.

    A missing field, a value that is no number of its type or outside the type's range, and a flag other than 0 or 1 raise, naming line
    and letter.
    """
    fields = parse_format(fmt)
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).where("value != ''").withColumn("_order", order)
    numbered = _numbered(lines)
    parts = F.split("value", _literal(delimiter), -1)
    values: dict[tuple[str, str | None], Column] = {}
    for at, (letter, found) in enumerate(fields):
        if found is None:
            continue
        text = F.when(F.size(parts) > at, parts[at]).otherwise(F.raise_error(F.concat(F.lit("line "), F.col(POINT_IDX) + 1, F.lit(f": no field for {letter!r}"))).cast("string"))
        kind = _component_type(found[0])
        good = F.lower(text).rlike(NUMBER) if kind in ("f64", "f32") else text.rlike("^[01]$" if letter in FLAGS else INTEGER)
        value = F.when(good, F.when(good, text).try_cast(spark_type(kind)))
        if kind in RANGES:  # Spark's type is wider than the unsigned types
            value = F.when(value.between(*RANGES[kind]), value)
        message = F.concat(F.lit("line "), (F.col(POINT_IDX) + 1).cast("string"), F.lit(f": cannot read {letter!r} from "), text)
        values[found] = F.coalesce(value, F.raise_error(message).cast(spark_type(kind)))
    out = []
    for a in format_schema(fmt).attributes:
        parts_of = {c: v for (n, c), v in values.items() if n == a.name}
        kind = _component_type(a.name)
        if None in parts_of:
            column = parts_of[None]
        else:
            column = F.struct(*[parts_of.get(c, F.lit(0).cast(spark_type(kind))).alias(c) for c in "xyz"])
        out.append(column.alias(a.name, metadata={"point_type": a.type}))
    return numbered.select(POINT_IDX, *out)


def _literal(text: str) -> str:
    import re

    return re.escape(text)


def _splits(lines: DataFrame) -> int:
    """No fewer than the splits of the files, by their number and size: nothing is read."""
    spark = lines.sparkSession
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return len(lines.inputFiles()) + int(str(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // most


def _numbered(lines: DataFrame) -> DataFrame:
    """Consecutive numbers in the order of splits and lines: one count for each split goes through a window, not the lines."""
    placed = lines.select("value", F.col("_order.file_path").alias("_f"), F.col("_order.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    starts = placed.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_i").alias("_least"))
    before = starts.select("_f", "_b", "_least", (F.sum("_n").over(Window.orderBy("_f", "_b")) - F.col("_n")).alias("_before"))
    rows = placed.join(F.broadcast(before) if _splits(lines) <= BROADCAST_SPLITS else before, ["_f", "_b"])  # one row for each split
    return rows.select("value", (F.col("_before") + F.col("_i") - F.col("_least")).alias(POINT_IDX))


def _shown(value: Column, kind: str, precision: int) -> Column:
    if kind in ("f64", "f32"):
        text = F.format_string(f"%.{precision}f", value.cast("double"))
        if precision == 0:
            return F.concat(text, F.lit(".0"))
        return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")
    return value.cast("string")


def ascii_lines(points: DataFrame, fmt: str, delimiter: str = ", ", precision: int = 5) -> DataFrame:
    """(point_idx, value): each point's line. Trailing zeros of fractions go, one digit stays; a skipped field is empty."""
    schema = PointSchema.of_frame(points)
    parts = []
    for _, found in parse_format(fmt):
        if found is None:
            parts.append(F.lit(""))
            continue
        name, component = found
        a = schema.find(name)
        if a is None:
            raise ValueError(f"no attribute {name!r}")
        value = point_cast(F.col(name), a.type, BUILTIN[name].type)
        parts.append(_shown(value[component] if component else value, _component_type(name), precision))
    return points.select(POINT_IDX, F.concat_ws(delimiter, *parts).alias("value"))


def write_ascii(points: DataFrame, path: str, fmt: str, delimiter: str = ", ", precision: int = 5, mode: str = "errorifexists") -> None:
    """Text files of points in index order: range-partitioned, sorted inside each part, so parts in name order are the whole."""
    ascii_lines(points, fmt, delimiter, precision).repartitionByRange(POINT_IDX).sortWithinPartitions(POINT_IDX).select("value").write.mode(mode).text(path)
