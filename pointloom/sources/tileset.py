"""Tilesets: a JSON tree of tiles as a flat table, and builders of trees and bounding volumes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOLUMES = {"region": 6, "box": 12, "sphere": 4}
TILES = "tile_path string, depth int, geometric_error double, refine string, volume_kind string, volume array<double>, uri string, transform array<double>, n_children int"


def box_volume(low: list[float], high: list[float]) -> dict:
    """The box volume of an axis-aligned box: centre, then the three half axes."""
    half = [(h - m) / 2 for m, h in zip(low, high, strict=True)]
    return {"box": [(m + h) / 2 for m, h in zip(low, high, strict=True)] + [half[0], 0.0, 0.0, 0.0, half[1], 0.0, 0.0, 0.0, half[2]]}


def region_volume(west: float, south: float, east: float, north: float, low: float, high: float) -> dict:
    return {"region": [west, south, east, north, low, high]}


def sphere_volume(center: list[float], radius: float) -> dict:
    return {"sphere": [*center, radius]}


def tileset(root: dict, geometric_error: float, version: str = "1.0", properties: dict | None = None) -> dict:
    check_tile(root)
    out = {"asset": {"version": version}, "geometricError": geometric_error, "root": root}
    return out | ({"properties": properties} if properties else {})


def check_tile(tile: dict) -> None:
    """A tile needs one bounding volume with the right number of values and a geometric error; so do its children."""
    stack = [tile]
    while stack:
        t = stack.pop()
        volume = t.get("boundingVolume") or {}
        found = [k for k in VOLUMES if k in volume]
        if len(found) != 1 or len(volume[found[0]]) != VOLUMES[found[0]]:
            raise ValueError("a tile needs one bounding volume: a region of 6, a box of 12 or a sphere of 4 numbers")
        if "geometricError" not in t:
            raise ValueError("a tile needs a geometric error")
        if t.get("refine", "ADD") not in ("ADD", "REPLACE"):
            raise ValueError(f"refinement {t['refine']!r}")
        if len(t.get("transform", [0] * 16)) != 16:
            raise ValueError("a transform has 16 numbers")
        stack += t.get("children", [])


def flatten_tileset(text: str) -> list[tuple]:
    """The rows of TILES of a tileset, parents first; a tile's path is its child numbers from the root, "0/2/1"."""
    doc = json.loads(text)
    if "asset" not in doc or "root" not in doc:
        raise ValueError("a tileset needs asset and root")
    check_tile(doc["root"])
    rows, stack = [], [("0", 0, doc["root"], "ADD")]
    while stack:
        path, depth, t, refine = stack.pop()
        refine = t.get("refine", refine)
        kind = next(k for k in VOLUMES if k in t["boundingVolume"])
        content = t.get("content") or {}
        children = t.get("children", [])
        rows.append((path, depth, float(t["geometricError"]), refine, kind, [float(v) for v in t["boundingVolume"][kind]], content.get("uri", content.get("url")), [float(v) for v in t["transform"]] if "transform" in t else None, len(children)))
        stack += [(f"{path}/{i}", depth + 1, c, refine) for i, c in reversed(list(enumerate(children)))]
    return rows


def read_tileset(spark: SparkSession, path: str) -> DataFrame:
    """One row for each tile of one or many tileset files, with the file's path; trees are flattened where the files are read."""
    schema = T.ArrayType(T._parse_datatype_string(TILES))
    names = schema.elementType.names

    @F.pandas_udf(schema)
    def flat(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, r, strict=True)) for r in flatten_tileset(t)] for t in texts])

    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), flat("value").alias("t")).select("path", F.inline("t"))
