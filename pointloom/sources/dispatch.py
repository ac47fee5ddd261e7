"""Reading and writing by file extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.schema import PointSchema
from ..operators.convert import LayoutConverter
from ..operators.frame import append, write_at
from .files import list_files
from .las import read_las, write_las, write_laz
from .pnts import read_pnts, write_pnts
from .tileset_points import read_tileset_points

READERS = {"las": read_las, "laz": read_las, "pnts": read_pnts}
#: A tileset file names its tiles; in a folder of tiles it is no data file.
TREES = {"json": read_tileset_points}
WRITERS = {"las": write_las, "laz": write_laz, "pnts": write_pnts}


def extension(path: str) -> str:
    """The extension in lower case; of a folder, that of its first data file. Files that need different readers raise: they'd be left out."""
    inside = list_files(path, tuple(f".{e}" for e in READERS))
    if len({READERS.get(p.rsplit(".", 1)[-1].lower()) for p in inside}) > 1:
        raise ValueError(f"{path}: files of different kinds in one folder; read them apart")
    name = (inside[0] if inside else path).rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_points(spark: SparkSession, path: str, layout: PointSchema | None = None, **options) -> DataFrame:
    """All points of a file or folder, converted to a layout if one is given: attributes by name, zero where the file has none.

    Text files have no extension of their own: see ascii.read_ascii.
    """
    reader = (READERS | TREES).get(extension(path))
    if reader is None:
        raise ValueError(f"{path}: no reader for the extension {extension(path)!r}")
    points = reader(spark, path, **options)
    return points if layout is None else LayoutConverter(PointSchema.of_frame(points), layout, defaults=True).convert(points)


def read_points_into(points: DataFrame, path: str, at: int | None = None, **options) -> DataFrame:
    """points with those of a file, in points' layout, appended, or written over those from index `at` on."""
    layout = PointSchema.of_frame(points)
    found = read_points(points.sparkSession, path, **options)
    if at is None:
        return append(points, found)
    return write_at(points, LayoutConverter(PointSchema.of_frame(found), layout, defaults=True).convert(found), at)


def write_points(points: DataFrame, path: str, kind: str | None = None, **options) -> None:
    """A folder of files of a kind (las, laz, pnts), or of the kind that the path's extension names."""
    writer = WRITERS.get(kind or extension(path))
    if writer is None:
        raise ValueError(f"{path}: no writer for {kind or extension(path)!r}")
    writer(points, path, **options)
