"""Surface normals and curvature from the neighbours of each point.

The normal is the unit eigenvector of the smallest eigenvalue of the neighbourhood's scatter matrix, its sign fixed so that the first
component that isn't zero is positive; curvature is that eigenvalue over the trace (0 for a trace of 0).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import AXES
from ..functions.schema import POINT_IDX
from .aggregates import PAIRS, POSITION
from .joins import knn


RESULT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("nx", "ny", "nz", "curvature")])


@F.pandas_udf(RESULT)
def smallest_axis(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
    m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
    values, vectors = np.linalg.eigh(m)
    normal = vectors[:, :, 0]
    solid = np.abs(normal) > 1e-12
    first = np.take_along_axis(normal, solid.argmax(1)[:, None], 1)
    normal = np.where(first < 0, -normal, normal)
    trace = values.sum(1)
    curvature = np.divide(np.abs(values[:, 0]), trace, out=np.zeros(len(trace)), where=trace > 0)
    return pd.DataFrame({"nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "curvature": curvature})


def neighbourhoods(points: DataFrame, k: int, position: str = POSITION) -> DataFrame:
    """(point_idx, n, scatter sums) over the k nearest points of each point."""
    if k < 3:
        raise ValueError("three neighbours are needed")
    flat = points.select(F.col(POINT_IDX).alias("neighbour"), *[F.col(position)[a].cast("double").alias(a) for a in AXES])
    near = knn(points, k, position).join(flat, "neighbour")
    n = F.count("*")
    return near.groupBy(POINT_IDX).agg(n.alias("n"), *[(F.covar_pop(a, b) * n).alias(a + b) for a, b in PAIRS])


def normals(points: DataFrame, k: int, position: str = POSITION) -> DataFrame:
    """(point_idx, nx, ny, nz, curvature)."""
    return neighbourhoods(points, k, position).select(POINT_IDX, smallest_axis(*PAIRS).alias("n")).select(POINT_IDX, "n.*")
