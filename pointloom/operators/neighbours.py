"""The k nearest neighbours of all points, by a kd-tree over a sample as a partitioner, exact trees inside its leaves and a halo exchange.

1. Of each position the k first points are kept: more copies can't be among anyone's neighbours. A sample of positions, PER_LEAF for each leaf
   wanted, is split at medians on the driver; its leaves hold about equally many points whatever the extent, so an outlier makes one leaf wider
   and nothing else. Number of leaves and sample are bounded (MOST_LEAVES); beyond, leaves grow.
2. Points are dealt to leaves. A leaf cuts its points into blocks by an exact kd-tree and finds each point's k nearest inside the leaf. The k-th
   distance, or the farthest corner of the tight box of any leaf with k points if that is nearer, bounds how far other neighbours can be.
3. Points ask the other leaves whose tight box is within their bound; those answer with at most k points each. Local and foreign answers meet by
   asker.

A task holds one leaf and what is asked of it. Positions with a NaN or infinite coordinate neither have neighbours nor are any.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from ..functions.schema import POINT_IDX
from .aggregates import POSITION
from .materialize import stable

LEAF, PER_LEAF, MOST_LEAVES, BLOCK = 20_000, 16, 1 << 17, 128


class Tree:
    """Splits at medians of a sample: axis and value of each inner node, in heap order; leaves are numbered from the left."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros((1 << depth) - 1, np.int8), np.zeros((1 << depth) - 1)
        parts = [sample]
        for node in range((1 << depth) - 1):
            part = parts[node]
            if len(part):
                a = int(np.argmax(np.subtract(*np.percentile(part, (90, 10), axis=0))))
                self.axis[node], self.value[node] = a, np.median(part[:, a])
            high = part[:, self.axis[node]] > self.value[node]
            parts += [part[~high], part[high]]
            parts[node] = None

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.value[node])
        return node - ((1 << self.depth) - 1)


def blocks(p: np.ndarray) -> list[np.ndarray]:
    """Rows of p in blocks of at most BLOCK that are near each other: halves along the widest axis."""
    waiting, out = [np.arange(len(p))], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        axis = int(np.argmax(np.ptp(p[rows], axis=0)))
        half = np.argpartition(p[rows, axis], len(rows) // 2)
        waiting += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return out


def gap2(low: np.ndarray, high: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from boxes (low, high) to the boxes (p, q); of a point both are the same."""
    apart = np.maximum(np.maximum(low - q, p - high), 0)
    return (apart * apart).sum(-1)


def reach2(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances from points to the farthest corners of boxes."""
    far = np.maximum(np.abs(p - low), np.abs(high - p))
    return (far * far).sum(-1)


class Found:
    """The k nearest of a set of points, for queries that come block by block."""

    def __init__(self, p: np.ndarray, ids: np.ndarray, k: int):
        self.p, self.ids, self.k = p, ids, k
        self.parts = blocks(p)
        self.low, self.high = (np.array([f(p[b], axis=0) for b in self.parts]).reshape(-1, 3) for f in (np.min, np.max))
        self.sizes = np.array([len(b) for b in self.parts])

    def near(self, q: np.ndarray, bound2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, squared distance) of the k nearest to each query within its bound, by distance, then id."""
        gaps = gap2(self.low, self.high, q.min(0), q.max(0))
        order = np.argsort(gaps, kind="stable")
        # Some nearest blocks with k points bound the distance: no query is farther from them than from their corners.
        first = order[: int(np.searchsorted(np.cumsum(self.sizes[order]), self.k)) + 1]
        if self.sizes[first].sum() >= self.k:
            bound2 = np.minimum(bound2, np.max([reach2(self.low[b], self.high[b], q) for b in first], axis=0) * (1 + 1e-9))
        some = np.flatnonzero(gaps <= bound2.max() * (1 + 1e-9))
        if not len(some):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows = np.concatenate([self.parts[b] for b in some])
        d2 = reduce(np.add, [(q[:, a, None] - self.p[rows, a]) ** 2 for a in range(3)])
        d2[d2 > bound2[:, None]] = np.inf
        if len(rows) > self.k:
            bound = np.partition(d2, self.k - 1, axis=1)[:, self.k - 1]
            which, column = np.nonzero((d2 <= bound[:, None]) & (d2 < np.inf))
        else:
            which, column = np.nonzero(d2 < np.inf)
        ids, d = self.ids[rows[column]], d2[which, column]
        order = np.lexsort((ids, d, which))
        which, ids, d = which[order], ids[order], d[order]
        nth = np.arange(len(which)) - np.searchsorted(which, which)
        keep = nth < self.k
        return which[keep], ids[keep], d[keep]


ANSWER = "leaf long, asker long, x double, y double, z double, bound2 double, ids array<long>, d2 array<double>"


def _lists(which: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(which, np.arange(1, n)))


def inside(low: np.ndarray, high: np.ndarray, counts: np.ndarray, k: int):
    """Each point's k nearest in its leaf (a row without leaf), and a row for each other leaf that it has to ask. low, high: tight boxes of leaves."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        here, p, ids = int(rows["leaf"].iloc[0]), rows[list(AXES)].to_numpy(), rows[POINT_IDX].to_numpy()
        found, out = Found(p, ids, k), []
        full = np.flatnonzero(counts >= k)
        for part in found.parts:
            q = p[part]
            which, near, d2 = found.near(q, np.full(len(q), np.inf))
            nears, d2s = _lists(which, near, len(q)), _lists(which, d2, len(q))
            bound2 = np.array([d[-1] if len(d) == k else np.inf for d in d2s])
            # A leaf whose nearest corner to the whole block is near gives a bound where the own leaf has too few points or far ones.
            closest = full[np.argsort(gap2(low[full], high[full], q.min(0), q.max(0)))[:4]]
            for leaf in closest:
                bound2 = np.minimum(bound2, reach2(low[leaf], high[leaf], q) * (1 + 1e-9))
            out.append(pd.DataFrame({"leaf": pd.array([None] * len(q), "Int64"), "asker": ids[part], "bound2": bound2, "ids": nears, "d2": d2s}))
            others = np.flatnonzero(gap2(low, high, q.min(0), q.max(0)) <= bound2.max())
            others = others[others != here]
            if len(others):
                i, j = np.nonzero(gap2(low[others], high[others], q[:, None], q[:, None]) <= bound2[:, None])
                asks = pd.DataFrame({"leaf": pd.array(others[j], "Int64"), "asker": ids[part[i]], "bound2": bound2[i]})
                out.append(asks.assign(**{a: q[i, n] for n, a in enumerate(AXES)}, ids=None, d2=None))
        return pd.concat([o.reindex(columns=["leaf", "asker", *AXES, "bound2", "ids", "d2"]) for o in out])

    return search


def answers(k: int):
    """What a leaf knows of the points that ask it."""

    def search(points: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asks):
            return pd.DataFrame({"asker": [], "ids": [], "d2": []}, dtype=object)
        found, out = Found(points[list(AXES)].to_numpy(), points[POINT_IDX].to_numpy(), k), []
        p, bound2, askers = asks[list(AXES)].to_numpy(), asks["bound2"].to_numpy(), asks["asker"].to_numpy()
        for part in blocks(p):
            which, near, d2 = found.near(p[part], bound2[part])
            out.append(pd.DataFrame({"asker": askers[part], "ids": _lists(which, near, len(part)), "d2": _lists(which, d2, len(part))}))
        return pd.concat(out)

    return search


def knn(points: DataFrame, k: int, position: str = POSITION) -> DataFrame:
    """(point_idx, rank, neighbour, distance2): the k nearest points of each point, itself included, ties by index."""
    if k < 1:
        raise ValueError("k must be positive")
    p = F.col(position)
    finite = reduce(and_, [F.abs(p[a].cast("double")) < float("inf") for a in AXES])
    flat = points.where(finite).select(POINT_IDX, *[(p[a].cast("double") + F.lit(0.0)).alias(a) for a in AXES])
    n = flat.count()
    if n < k:
        raise ValueError(f"{n} points have no {k} neighbours")
    nth = F.row_number().over(Window.partitionBy(*AXES).orderBy(POINT_IDX))
    held = stable(flat.withColumn("nth", nth).where(F.col("nth") <= k))
    depth = max(0, int(np.ceil(np.log2(min(MOST_LEAVES, max(1, n / max(LEAF, 8 * k)))))))
    wanted = PER_LEAF << depth
    drawn = held.where((F.col("nth") == 1) & (F.pmod(F.xxhash64(*AXES), F.lit(1 << 40)) < int(min(1.0, 2 * wanted / n) * (1 << 40))))
    tree = Tree(drawn.select(*AXES).limit(4 * wanted).toPandas().to_numpy().reshape(-1, 3) if depth else np.zeros((0, 3)), depth)

    @F.pandas_udf("long")
    def leaf(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(np.stack([x, y, z], 1)))

    placed = stable(held.select(POINT_IDX, *AXES, "nth", leaf(*AXES).alias("leaf")))
    ends = [f(a).alias(f"{f.__name__}_{a}") for f in (F.min, F.max) for a in AXES]
    stats = placed.groupBy("leaf").agg(F.count("*").alias("n"), *ends).toPandas()  # a row for each leaf
    low, high, counts = np.full((1 << depth, 3), np.inf), np.full((1 << depth, 3), -np.inf), np.zeros(1 << depth, np.int64)
    at = stats["leaf"].to_numpy()
    counts[at] = stats["n"]
    for box, name in ((low, "min"), (high, "max")):
        box[at] = stats[[f"{name}_{a}" for a in AXES]]
    local = stable(placed.groupBy("leaf").applyInPandas(inside(low, high, counts, k), ANSWER))
    asked = local.where(F.col("leaf").isNotNull()).select("leaf", "asker", *AXES, "bound2")
    foreign = placed.groupBy("leaf").cogroup(asked.groupBy("leaf")).applyInPandas(answers(k), "asker long, ids array<long>, d2 array<double>")
    both = local.where(F.col("leaf").isNull()).select("asker", "ids", "d2").union(foreign)
    pairs = F.arrays_zip(F.col("d2"), F.col("ids"))
    best = both.groupBy("asker").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("best"))  # k of each leaf asked
    ranked = best.select("asker", F.posexplode("best").alias("nth0", "b")).select("asker", (F.col("nth0") + 1).alias("rank"), F.col("b.ids").alias("neighbour"), F.col("b.d2").alias("distance2"))
    first = held.where("nth = 1").select(F.col(POINT_IDX).alias("asker"), *AXES)
    return flat.join(first, list(AXES)).select(POINT_IDX, "asker").join(ranked, "asker").select(POINT_IDX, "rank", "neighbour", "distance2")
