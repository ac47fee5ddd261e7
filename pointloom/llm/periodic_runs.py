"""All maximal periodic runs of words in each document, and the text with all but one period of each run removed.

A run is a stretch of consecutive words of smallest period q, at least `least` words and two periods long, that no neighbouring word extends.
They are found by the way of longest previous factors, for all documents of a batch at once in numpy:

* A suffix sort by prefix doubling; the ranks of each round are kept, so that the common extension of two places, forwards or
  backwards, takes a comparison a round. Words of different documents never count as equal.
* The longest earlier factor of a place is its longer extension with one of the two nearest suffixes in sorted order that begin earlier
  (nearest smaller values, by jumping along all pointers at once). Greedily taken from the left they divide a document into Lempel-Ziv blocks.
* A run either touches the border of a block or lies strictly inside one. Let b be the last border that a run of period p touches, the block that
  begins there of length L, the one before of length M. Then either a whole period lies right of b, so p <= L, or one lies left of it; and
  the run begins less than p words before the block before, for else that block would have been found earlier and be longer, so p < L + M. Main's
  extensions of b and b + p, and of b - p and b, for these p find all such runs; there are at most three pairs a word.
* Runs strictly inside a block are copies of runs of its earlier occurrence: runs in buckets by start are copied from the left to the right.

Each document is worked on by itself, so no row is shuffled; a worker holds a batch of documents. A document of n words needs about 4 n log2(n) bytes
for the ranks if it repeats itself at length, and pairs of places are made in slices of SLICE.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; repeated rows and rows with a null id are documents of
their own; other columns are kept, except those named like a result, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE_CLASS, sha_hex
from .suffixes import common, heads, suffix_ranks

#: Words of the documents that are sorted together (one document, if it is longer), and pairs of places that are extended together.
GROUP, SLICE = 250_000, 1 << 20
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def nearest_smaller(values: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each slot the nearest slot before it in its group (groups lie together) with a smaller value, -1 if none."""
    v, group = np.append(0, values), np.append(-1, groups)  # slot 0 ends all searches
    before = np.maximum(np.arange(len(v)) - 1, 0)
    open_ = np.arange(1, len(v))
    while len(open_ := open_[(group[before[open_]] == group[open_]) & (v[before[open_]] > v[open_])]):
        before[open_] = before[before[open_]]
    return np.where(group[before] == group, before - 1, -1)[1:]


def longest_previous(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest factor that begins at each place and also earlier; length 0 where there is none."""
    n, first = len(order), levels[0][order]
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    after = nearest_smaller(order[::-1], first[::-1])[::-1]
    for near in (nearest_smaller(order, first), np.where(after < 0, -1, n - 1 - after)):
        slots = np.flatnonzero(near >= 0)
        at, earlier = order[slots], order[near[slots]]
        size = common(levels, at, earlier)
        more = size > length[at]
        length[at[more]], source[at[more]] = size[more], earlier[more]
    return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks."""
    sizes, at, out = length.tolist(), 0, []
    while at < len(sizes):
        out.append(at)
        at += sizes[at] or 1
    return np.array(out, np.int64)


def _pairs(borders: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(border, p) for p from 1 to each border's count, in slices."""
    ends = np.cumsum(counts)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
        t = np.arange(lo, min(lo + SLICE, int(ends[-1])))
        which = np.searchsorted(ends, t, "right")
        yield borders[which], t - (ends - counts)[which] + 1


def bordering(starts: np.ndarray, sizes: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """(start, end, period) rows of all runs that touch a block's border; sizes of documents' last places are 0."""
    word, found = levels[0], []
    before = np.append(0, sizes[:-1])
    for right, counts in ((True, sizes), (False, np.maximum(before + sizes - 1, 0))):
        for b, p in _pairs(starts, counts):
            i = b if right else b - p
            inside = i >= 0
            b, p, i = b[inside], p[inside], i[inside]
            near = (word[i] == word[i + p]) | (word[i - 1] == word[i + p - 1]) & (i > 0)
            i, p = i[near], p[near]
            after = common(levels, i, i + p)
            ahead = common(levels, i - 1, i + p - 1, back=True)
            total = after + ahead + p
            runs = total >= np.maximum(least, 2 * p)
            found.append(np.stack([i - ahead, i + p + after, p], 1)[runs])
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def all_runs(keys: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of at least `least` keys, in order. Keys of documents differ, and each document ends with a unique key."""
    if not len(keys):
        return []
    order, levels = suffix_ranks(keys)
    length, source = longest_previous(order, levels)
    starts = blocks(length)
    sizes = np.diff(np.append(starts, len(keys)))
    # A place that is alone in its group and has no word like it is a block of one, a document's end too; ends have no words of their own.
    last = np.append(keys[1:] >> 32 != keys[:-1] >> 32, True)
    sizes[last[starts]] = 0
    rows = bordering(starts, sizes, levels, least)
    rows = rows[np.lexsort(rows.T[[2, 1, 0]])]
    rows = rows[heads(rows[:, 0] * (len(keys) + 1) + rows[:, 1])] if len(rows) else rows  # of one stretch the smallest period
    at: dict[int, dict[int, int]] = defaultdict(dict)
    for s, e, p in rows.tolist():
        at[s][e] = p
    buckets = sorted(at)
    long = sizes >= least + 2
    for b, size, src in zip(starts[long].tolist(), sizes[long].tolist(), source[starts[long]].tolist(), strict=True):
        i = bisect_right(buckets, src)
        while i < len(buckets) and (s := buckets[i]) < src + size - 1:
            for e, p in list(at[s].items()):
                if e < src + size:
                    if s - src + b not in at:
                        insort(buckets, s - src + b)
                    at[s - src + b][e - src + b] = p
            i += 1
    return sorted((s, e, p) for s, ends in at.items() for e, p in ends.items())


def runs_of(texts: list[list[bytes]], least: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    names: dict[bytes, int] = defaultdict()
    names.default_factory = names.__len__
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    keys = np.repeat(np.arange(len(texts), dtype=np.int64) << 32, sizes)
    words = np.fromiter(map(names.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()) - len(texts))
    ends = begins + sizes - 1
    inner = np.ones(len(keys), bool)
    inner[ends] = False
    keys[inner] += words
    keys[ends] += len(names)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, p in all_runs(keys, least):
        doc = int(np.searchsorted(begins, s, "right")) - 1
        out[doc].append((s - int(begins[doc]), e - s, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        gone[s + p] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g] if runs else words


def periodic_runs(docs: DataFrame, least: int = 12, text_col: str = "text") -> DataFrame:
    """docs with n_words, runs (array of start, length, period, counted in words, by start, then period) and collapsed (words joined by one space)."""
    if least < 2:
        raise ValueError("runs have at least two words")
    results = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c not in results]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    place = kept.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split() for t in batch.column(place).cast(pa.binary()).to_pylist()]
            found, begin, size = [], 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or (size and size + len(texts[i]) > GROUP):
                    found += runs_of(texts[begin:i], least)
                    begin, size = i, 0
                size += len(texts[i]) if i < len(texts) else 0
            named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rows] for rows in found]
            made = [
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array(named, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                pa.array([b" ".join(collapse(t, r)) for t, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + made, names=[*kept, *results])

    return docs.select(*kept).mapInArrow(work, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The text; of ids whose crc32 is divisible by 10, with a run: from word a on, words repeat with period p (a and p follow from the id)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS + "+"), lambda w: w != "")

    def periodic(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))))

    # One-element arrays hold the words for the expression that uses them often.
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.lit(""))), 0)
    return F.when(h % 10 == 0, made).otherwise(text)


def digest(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the documents after `planted`."""
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), least)
    # The longest run; of equal ones the first, then the shortest period.
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.array_min(order)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period"),
        F.floor(1000 * -best["l"] / best["p"]).cast("long").alias("exponent_milli"), sha_hex(listed).alias("runs_sha256"), sha_hex(F.col("collapsed")).alias("collapsed_sha256"),
    )
