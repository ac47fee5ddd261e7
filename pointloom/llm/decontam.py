"""Benchmark decontamination by greedy string tiling.

Texts and test items become token arrays. Token n-grams of the items are the seeds; a document is compared with an item only where
they share one. Tiles are then found longest first: the longest unmarked match is searched by bisection with running Karp-Rabin hashes
(prefix sums, from which windows of any length take one subtraction each), matches are verified token by token, marked when they overlap
no earlier tile, and the length falls until it is the seed's. As tiles may stand in any order, reordered passages count in full. A pair
is contaminated when tiles cover at least `coverage` of the item's tokens.

The benchmark is the stated query set: it is read in blocks of at most BLOCK_BYTES of text, and SCAN_BLOCKS of them are broadcast and
joined with all documents' seeds in one scan, as sorted arrays, so what is sent to a task is bounded whatever the benchmark's size. A
join by shuffle would move every n-gram of every document; a benchmark of n scans moves nothing but its blocks.

Defined results: null and empty texts match nothing; an item with fewer tokens than a seed is matched as one seed of its own length,
unless it has fewer than `least` tokens; an item without tokens matches nothing; repeated rows are compared one by one; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import batched, chain
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, row_keys

TOKEN = re.compile(r"[^\W_]+")
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES, SCAN_BLOCKS = 8 << 20, 4
_powers: dict[int, np.ndarray] = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        p = np.full(max(n, 2 * len(_powers[base])), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Running:
    """Karp-Rabin hashes of the windows of an id array, modulo 2^64."""

    def __init__(self, ids: np.ndarray):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mixed * powers(BASE, len(ids)), out=self.sums[1:])

    def of(self, n: int) -> np.ndarray:
        """Of every window of n ids, in order."""
        windows = max(0, len(self.sums) - n)
        return (self.sums[n:] - self.sums[:windows]) * powers(INVERSE, windows)


def greedy_tiles(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(doc position, item position, length) of non-overlapping tiles, longest first and leftmost first among equals."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    in_doc, in_item = Running(doc), Running(item)
    tiles: list[tuple[int, int, int]] = []
    equal = lambda d, i, n: (doc[d : d + n] == item[i : i + n]).all()

    def unmarked(free: np.ndarray, n: int) -> np.ndarray:
        ahead = np.append(0, np.cumsum(free))
        return np.flatnonzero(ahead[n:] - ahead[:-n] == n)

    def hits(n: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """Unmarked windows of n tokens of the document with the range, in an order of the item's, of those of equal hash."""
        at_item, at_doc = unmarked(free_item, n), unmarked(free_doc, n)
        of_item = in_item.of(n)[at_item]
        order = np.argsort(of_item, kind="stable")
        of_item, h = of_item[order], in_doc.of(n)[at_doc]
        begin, end = np.searchsorted(of_item, h, "left"), np.searchsorted(of_item, h, "right")
        hit = begin < end
        return list(zip(at_doc[hit].tolist(), begin[hit].tolist(), end[hit].tolist(), strict=True)), at_item[order]

    def any_match(n: int) -> bool:
        found, places = hits(n)
        return any(equal(d, places[k], n) for d, begin, end in found for k in range(begin, end))

    def mark(n: int) -> None:
        """Leftmost first; places in the item that are taken are passed once, so repetitive texts take linear time."""
        found, places = hits(n)
        passed: dict[int, int] = {}
        done = 0
        for d, begin, end in found:
            if d < done:
                continue
            k = passed.get(begin, begin)
            while k < end and not free_item[places[k] : places[k] + n].all():
                k += 1
            passed[begin] = k
            for i in places[k:end].tolist():
                if free_item[i : i + n].all() and equal(d, i, n):
                    free_doc[d : d + n] = free_item[i : i + n] = False
                    tiles.append((d, i, n))
                    done = d + n
                    break

    n = min(len(item), len(doc))
    while n >= shortest:
        if not any_match(n):
            # The longest match left: the largest length with one, by bisection (a match of n tokens holds one of n - 1).
            lo, hi = shortest - 1, n - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if any_match(mid):
                    lo = mid
                else:
                    hi = mid - 1
            n = lo
            if n < shortest:
                break
        mark(n)
        n -= 1
    return tiles


class Items:
    """A block of test items with the seeds that lead to them, as sorted arrays."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int, least: int):
        self.seed = seed
        self.vocabulary: dict[str, int] = {}
        self.ids, self.arrays = [], []
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for item_id, text in rows:
            a = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)], np.int64)
            if len(a) >= max(least, 1):
                n = min(seed, len(a))
                h = np.unique(Running(a).of(n))
                found[n].append((h, np.full(len(h), len(self.ids))))
                self.ids.append(item_id)
                self.arrays.append(a)
        self.seeds = {}
        for n, parts in found.items():
            h, item = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(h, kind="stable")
            distinct, begin = np.unique(h[order], return_index=True)
            self.seeds[n] = distinct, np.append(begin, len(h)), item[order]

    def compare(self, words: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(item id, tokens covered, tokens of the item, tiles) for each item that shares a seed with the text's tokens."""
        get = self.vocabulary.get
        doc = np.array([get(t, 0) for t in words], np.int64)
        running = Running(doc)
        near: dict[int, list[int]] = defaultdict(list)
        for n, (distinct, begin, items) in self.seeds.items():
            h = running.of(n)
            at = np.searchsorted(distinct, h)
            at[at == len(distinct)] = 0
            for p in np.flatnonzero(distinct[at] == h).tolist():
                for i in items[begin[at[p]] : begin[at[p] + 1]].tolist():
                    near[i].append(p)
        for i, places in near.items():
            item = self.arrays[i]
            n = min(self.seed, len(item))
            # Tiles only lie where seeds do: keep the seeded stretches, apart from each other by a token that matches nothing.
            mask = np.zeros(len(doc) + 1, bool)
            for k in range(n):
                mask[np.array(places) + k] = True
            keep = mask.copy()
            keep[1:] |= mask[:-1]
            seeded = np.where(mask[:-1], doc, 0)[keep[:-1]]
            covered = greedy_tiles(seeded, item, n)
            if covered:
                yield self.ids[i], sum(t[2] for t in covered), len(item), len(covered)


_items: dict[str, list[Items]] = {}


def items_of(name: str, sent: list[Broadcast], seed: int, least: int) -> list[Items]:
    """This process's items of a scan's broadcast blocks, built once; only the latest scan's are kept."""
    if name not in _items:
        _items.clear()
        _items[name] = [Items(b.value, seed, least) for b in sent]
    return _items[name]


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark's rows in order, in lists of at most BLOCK_BYTES of text or one row."""
    held, size = [], 0
    for row in benchmark.select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        n = len(row[1] or "") * 4
        if held and size + n > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield held


def matcher(
    scan: tuple[list[tuple[int, str | None]], ...], item_type: T.DataType, seed: int, coverage: float, least: int, spark: SparkSession
) -> Callable[[Column], Column]:
    """text -> array of struct(item, n_covered, n_item, n_tiles), for the blocks of one scan."""
    sent, name = [spark.sparkContext.broadcast(rows) for rows in scan], uuid4().hex
    names = ("item", "n_covered", "n_item", "n_tiles")
    fields = [T.StructField("item", item_type), *[T.StructField(n, T.LongType()) for n in names[1:]]]

    @F.pandas_udf(T.ArrayType(T.StructType(fields)))
    def compare(texts: pd.Series) -> pd.Series:
        held = items_of(name, sent, seed, least)
        found = lambda words: (m for items in held for m in items.compare(words))
        return pd.Series([[dict(zip(names, m, strict=True)) for m in found(tokens(t)) if m[1] >= coverage * m[2]] for t in texts])

    return compare


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed: int = 5, coverage: float = 0.8, least: int = 1,
) -> DataFrame:
    """(id, item id, n_covered, n_item, n_tiles, coverage) for each pair of which tiles cover at least `coverage` of the item.

    Items of fewer than `least` tokens match nothing.
    """
    item_type = benchmark.schema[item_col].dataType
    parts = []
    for scan in chain([([],)], batched(blocks(benchmark, item_col, item_text_col), SCAN_BLOCKS)):  # the empty block gives an empty benchmark's schema
        compare = matcher(scan, item_type, seed, coverage, least, docs.sparkSession)
        parts.append(docs.select(F.col(id_col), compare(F.col(text_col)).alias("m")).select(id_col, F.inline("m")))
    found = reduce(DataFrame.unionAll, parts[1:] or parts)
    return found.withColumnRenamed("item", item_col).withColumn("coverage", F.col("n_covered") / F.col("n_item"))


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed: int = 5, coverage: float = 0.8, least: int = 1,
) -> DataFrame:
    """docs without the rows of which `contaminated` finds a pair. With one scan rows stay where they are; more are joined by text hashes."""
    item_type, spark = benchmark.schema[item_col].dataType, docs.sparkSession
    match = [matcher(scan, item_type, seed, coverage, least, spark) for scan in batched(blocks(benchmark, item_col, item_text_col), SCAN_BLOCKS)]
    if len(match) < 2:
        return docs.where(F.size(match[0](F.col(text_col))) == 0) if match else docs
    k1, k2 = row_keys(F.lit(0), F.coalesce(F.col(text_col), F.lit("")))
    gone = cut(reduce(DataFrame.unionAll, [docs.where(F.size(m(F.col(text_col))) > 0).select(k1.alias("k1"), k2.alias("k2")) for m in match]).distinct())
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(gone, ["k1", "k2"], "left_anti").select("row.*")
