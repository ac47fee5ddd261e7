"""Near-dedup: fingerprints or shingle sets, exact tiled comparison, connected components.

SimHash fingerprints are compared once each, however many documents share one, and only inside blocks: pairs of radius + 2 bands of the
fingerprint. Two fingerprints within the radius agree on a pair at least, so every link is found.

For a similarity of word shingles a node is a set of distinct shingles (as 64-bit hashes), however many documents have it, and two nodes
link if the exact Jaccard similarity of their sets is the given one or more. Candidates come from the SimHash of the set, 64 * WORDS
bits: a block's fingerprints are compared as above, with a radius that similar sets exceed with probability below two in a million
(wide_radius). A pair of bands says nothing at such a radius, so blocks are MINIMA minima of the shingle hashes, which come from the set
alone: sets of similarity s share none of them with probability (1 - s)^MINIMA, 3 in a million at 0.8. Blocks of the same members are
compared once. Sets are made again from the texts of nodes with a candidate only. A component of candidates is one group, to which each
set travels once; of a component beyond a tile the blocks are dealt into tiles again.

A block of at most TILE fingerprints is one tile (of SET_TILE sets and SET_SHINGLES shingles, for a similarity). A larger one is cut by
level (population count for a small radius; the number of distinct shingles for a similarity, which is part of the node) and by hash
into tiles, and each pair of tiles whose levels differ by one at most is a group of its own, on any executor: by their sizes alone,
nodes whose levels differ by more can't link. Inside a pair of tiles, sub-blocks of fingerprints sorted by population count are compared
by exclusive-or and bit counts; sets are compared where they share one of the rarest shingles that a similar set can't lack all of. A
pair of tiles returns a spanning forest of its links, so a large group of near copies gives as many rows as members, not pairs.
Components come from alternating large-star and small-star steps over a table.

Defined results: null and empty texts and texts of white space have fingerprint zero, or the empty set, and link like any other; repeated
rows share a fingerprint or set; a null id is never the smallest unless all of a component's are null; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, row_keys

TILE, BLOCK, SMALL = 512, 256, 32
SET_TILE, SET_SHINGLES = 2048, 1_000_000
#: Rows of removed documents (16 bytes each) up to which they are broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000
CHUNK = 50_000
MINIMA, WORDS = 8, 4
ODD = [np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x1000193) for k in range(16)]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hashes of a hash; the first is the hash itself."""
    if k == 0:
        return h
    h = (h ^ (h >> np.uint64(31))) * ODD[k]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """Hashes of the word shingles, with repeats; a text of fewer words is one shingle.

    bytes.lower and bytes.split know only ASCII letters and white space, as wanted here.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return []
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return list(map(xxhash.xxh64_intdigest, grams, repeat(42)))


def sketches(texts: list[str | None], shingle: int) -> np.ndarray:
    """The 64-bit SimHash of each text."""
    fp = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    held: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            h = np.array(hashes, np.uint64)
            row = np.array([i for i, _ in held])
            n = np.array([k for _, k in held])
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
            fp[row] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
            hashes.clear()
            held.clear()

    for i, text in enumerate(texts):
        found = shingle_hashes(text, shingle)
        if not found:
            continue
        hashes.extend(found)
        held.append((i, len(found)))
        if len(hashes) > CHUNK:
            flush()
    flush()
    return fp


def distinct_shingles(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, shingle), np.uint64))


def set_print(h: np.ndarray) -> bytes:
    """The SimHash of a set by WORDS hashes of each member, one row of h for each."""
    sums = np.zeros(64 * WORDS, np.int64)
    for s in range(0, h.shape[1], 255):  # a byte holds the sum of so many bits
        bits = np.unpackbits(np.ascontiguousarray(h[:, s : s + 255].T).view(np.uint8), axis=1, bitorder="little")
        sums += bits.view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * sums > h.shape[1], bitorder="little").tobytes()


def wide_radius(similarity: float) -> int:
    """Bits in which the SimHashes of sets of at least this Jaccard similarity differ at most: the mean and seven standard deviations."""
    bits = 64 * WORDS
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + 7 * math.sqrt(bits * p * (1 - p)))


def fingerprint(text: Column, shingle: int) -> Column:
    """The 64-bit SimHash as a signed long."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(sketches(texts.tolist(), shingle).view(np.int64))

    return run(text)


def set_sketch(text: Column, shingle: int) -> Column:
    """struct(fp binary, sim binary, keys array<long>, n long): 128 bits that name the set of distinct shingles, its SimHash, minima and size."""
    binary, long = T.BinaryType(), T.LongType()
    schema = T.StructType([T.StructField("fp", binary), T.StructField("sim", binary), T.StructField("keys", T.ArrayType(long)), T.StructField("n", long)])

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        fp, sim, keys, n = [], [], [], []
        for text in texts:
            h = distinct_shingles(text, shingle)
            fp.append(xxhash.xxh3_128_digest(h.tobytes()))
            family = np.stack([mixed(h, m) for m in range(MINIMA)])
            sim.append(set_print(family[-WORDS:]))
            keys.append((family.min(axis=1) if len(h) else np.zeros(MINIMA, np.uint64)).view(np.int64))
            n.append(len(h))
        return pd.DataFrame({"fp": fp, "sim": sim, "keys": keys, "n": n})

    return run(text)


def shingle_set(text: Column, shingle: int) -> Column:
    """The hashes of the distinct shingles, ascending, 8 bytes each."""

    @F.pandas_udf(T.BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([distinct_shingles(text, shingle).tobytes() for text in texts])

    return run(text)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each of n nodes' components under the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (last axis: their 64-bit words), broadcast."""
    d = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for w in range(1, a.shape[-1]):
        d += np.bitwise_count(a[..., w] ^ b[..., w])
    return d


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int, words: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root) of the links inside tile a, or between tiles a and b. Words after the first ones are names only."""
    ones = lambda x: np.bitwise_count(x[:, :words]).sum(1).astype(int)
    same = b is None
    a = a[np.argsort(ones(a), kind="stable")]
    b = a if same else b[np.argsort(ones(b), kind="stable")]
    pa, pb = ones(a), ones(b)
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    found_i, found_j = [], []
    for s in range(0, len(a), BLOCK):
        x = a[s : s + BLOCK]
        for t in range(s if same else 0, len(b), BLOCK):
            if pb[t] > pa[s + len(x) - 1] + radius:
                break
            y = b[t : t + BLOCK]
            if pb[t + len(y) - 1] < pa[s] - radius:
                continue
            i, j = np.nonzero(distance(x[:, None, :words], y[None, :, :words]) <= radius)
            i, j = i + s, j + t + shift
            later = i < j
            # Only a forest of each pair of sub-blocks is kept, so a dense tile holds as many links as fingerprints.
            i, j = i[later], j[later]
            if len(i) > len(x) + len(y):
                both, k = np.unique(np.concatenate([i, j]), return_inverse=True)
                root = forest(k[: len(i)], k[len(i) :], len(both))
                i, j = both[root], both
                i, j = i[i != j], j[i != j]
            found_i.append(i)
            found_j.append(j)
    i, j = np.concatenate(found_i or [[]]).astype(int), np.concatenate(found_j or [[]]).astype(int)
    root = forest(i, j, len(nodes))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def compare_groups(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int, words: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside each run of equal group numbers; small groups together, by distance within their group."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(fp)))
    small = np.repeat((size <= SMALL) & (np.maximum.reduceat(side, first) == 0), size)
    g, f = group[small], fp[small]
    for d in range(1, min(SMALL, len(g))):
        near = np.flatnonzero(g[d:] == g[:-d])
        if not len(near):
            break
        hit = near[distance(f[near + d, :words], f[near, :words]) <= radius]
        if len(hit):
            yield f[hit + d], f[hit]
    for s, k in zip(first.tolist(), size.tolist(), strict=True):
        if not small[s]:
            part, which = fp[s : s + k], side[s : s + k]
            yield tile_links(part, None, radius, words) if which.max() == 0 else tile_links(part[which == 1], part[which == 2], radius, words)


def set_links(sets: list[np.ndarray], side: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect all sets of one group whose Jaccard similarity is the given one or more.

    Sides as dealt: 0 for all, or 1 and 2, of which only pairs across are due. A set is done when it has been compared with all that
    share one of its rarest shingles; sets that aren't done need no comparison once they are all in one component.
    """
    n, num, den = len(sets), similarity.numerator, similarity.denominator
    size = np.array([len(x) for x in sets])
    at = np.cumsum(size) - size
    code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(n), size)
    listed = np.argsort(code, kind="stable")
    listed, begin = owner[listed], np.cumsum(count) - count
    has = np.zeros(len(count), bool)
    root, done = np.arange(n), np.zeros(n, bool)
    found_i, found_j = [], []
    while True:
        left = np.flatnonzero(~done)
        most = np.bincount(root[left], minlength=n).argmax() if len(left) else 0
        todo = left[root[left] != most]
        if not len(todo):
            break
        if n > SMALL and len(left) == n:  # begin with a set that shares much
            todo = np.array([np.argmax([count[code[k : k + m]].sum() for k, m in zip(at, size, strict=True)])])
        for i in todo[: max(1, len(todo) // 4)].tolist():
            done[i] = True
            own = code[at[i] : at[i] + size[i]]
            rare = own[np.argsort(count[own], kind="stable")[: size[i] - -(-num * size[i] // den) + 1]]
            rare = rare[count[rare] > 1]
            if not len(rare):
                continue
            j = np.unique(np.concatenate([listed[begin[c] : begin[c] + count[c]] for c in rare.tolist()]))
            low, high = np.minimum(size[j], size[i]), np.maximum(size[j], size[i])
            j = j[~done[j] & (root[j] != root[i]) & ((side[j] != side[i]) | (side[i] == 0)) & (den * low >= num * high)]
            if not len(j):
                continue
            has[own] = True
            start = np.cumsum(size[j]) - size[j]
            member = np.repeat(at[j] - start, size[j]) + np.arange(size[j].sum())
            both = np.add.reduceat(has[code[member]], start, dtype=np.int64)
            has[own] = False
            j = j[den * both >= num * (size[i] + size[j] - both)]
            if len(j):
                found_i.append(np.full(len(j), i))
                found_j.append(j)
                root[np.isin(root, root[j])] = root[i]
    i, j = np.concatenate(found_i or [[]]).astype(int), np.concatenate(found_j or [[]]).astype(int)
    tree = forest(i, j, n)
    moved = np.flatnonzero(tree != np.arange(n))
    return moved, tree[moved]


def bands(fp: Column, radius: int) -> Column:
    """The keys of a fingerprint: it has radius + 2 bands of bits, and each pair of them is a key.

    Fingerprints within the radius differ in as many bands at most, so they agree on a pair. For two bits that is six keys of 32 bits,
    by which unlike fingerprints rarely meet, however many there are.
    """
    n = radius + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    masks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[fp.bitwiseAND(F.lit(signed(x | y))) for x, y in combinations(masks, 2)])


def deal(rows: DataFrame, small: Column, parts: Column, levels: Column) -> DataFrame:
    """(fp, g, side): a small block is one group; of others, parts tiles of each level, each pair of tiles whose levels may link."""
    own = F.struct(F.col("level").alias("level"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    others = F.flatten(F.transform(levels, lambda c: F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(c.alias("level"), p.alias("part")))))
    pair = lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b"), F.when(own == o, 0).when(own < o, 1).otherwise(2).alias("side"))
    nowhere = F.struct(F.lit(-1).alias("level"), F.lit(0).alias("part"))
    alone = F.array(F.struct(nowhere.alias("a"), nowhere.alias("b"), F.lit(0).alias("side")))
    return rows.select("fp", "band", "value", F.explode(F.when(small, alone).otherwise(F.transform(others, pair))).alias("p")).select(
        "fp", F.xxhash64("band", "value", "p.a", "p.b").alias("g"), F.col("p.side").alias("side")
    )


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of g, as frames that hold each group whole."""
    held: list[pd.DataFrame] = []  # a group is at most two tiles, so this is bounded
    for batch in batches:
        held.append(batch)
        if batch["g"].iloc[-1] != held[0]["g"].iloc[0]:
            both = pd.concat(held)
            last = both["g"].to_numpy() == batch["g"].iloc[-1]
            yield both[~last]
            held = [both[last]]
    if held:
        yield pd.concat(held)


def links(distinct: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (u, v), u > v, that connect all fingerprints within the radius that share a key.

    distinct has one row for each fingerprint: fp (long), keys (array<long>) and level (fingerprints whose levels differ
    by more than one never link).
    """
    keyed = distinct.select("fp", "level", F.posexplode("keys").alias("band", "value"))
    sizes = cut(keyed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1"))
    rows = keyed.join(sizes, ["band", "value"])
    level = F.col("level")
    dealt = deal(rows, F.col("n") <= tile, F.ceil(F.col("n") / tile).cast("int"), F.sequence(level - 1, level + 1))

    def found(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp = part["fp"].to_numpy().view(np.uint64)[:, None]
        for x, y in compare_groups(part["g"].to_numpy(), part["side"].to_numpy(), fp, radius):
            x, y = x[:, 0].view(np.int64), y[:, 0].view(np.int64)
            yield pd.DataFrame({"u": np.maximum(x, y), "v": np.minimum(x, y)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches):
            yield from found(part)

    return dealt.repartition("g").sortWithinPartitions("g").mapInPandas(run, "u long, v long").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether the edges are stars already: no node has two smaller ones, or both a smaller and a larger one."""
    ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.explode(ends).alias("e")).select("e.*").groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) of every node that isn't the smallest of its component; root is that smallest node. Edges are (u, v), u > v.

    Alternates large-star and small-star until all components are stars; each step is a grouped minimum (combined before the shuffle)
    and a join. Both sides of a join are tables by then, so it has plain exchanges, of which Spark splits those of nodes with very many
    links.
    """
    now = cut(edges)
    for _ in range(limit):
        if settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.union(now.select("v", "u")).toDF("x", "y")
        low = cut(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")))
        large = cut(both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        now = cut(large.join(low, "u").select(F.explode(pairs).alias("e")).select("e.*").where("u > v").distinct())
    raise RuntimeError(f"components did not settle in {limit} steps")


def named(distinct: DataFrame, edges: DataFrame, least: str) -> DataFrame:
    """(fp, component) of every fingerprint; component is the smallest `least` of its component."""
    rooted = cut(distinct.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").select("fp", least, F.coalesce("root", "fp").alias("root")))
    smallest = cut(rooted.groupBy("root").agg(F.min(least).alias("component")))
    return rooted.join(smallest, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id): one row for each row of docs; component_id is the smallest id reachable over links of `radius` bits."""
    marked = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    level = (F.bit_count("fp") / max(radius, 1)).cast("int")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("least")).withColumn("keys", bands(F.col("fp"), radius)).withColumn("level", level)
    groups = named(distinct, links(distinct.select("fp", "keys", "level"), radius), "least")
    return marked.join(groups, "fp").select(F.col("id").alias(id_col), "fp", F.col("component").alias("component_id"))


def dealt_blocks(nodes: DataFrame, tile: int, shingles: int) -> DataFrame:
    """(fp, g, side) of the nodes that share a key; nodes has one row for each set: fp, keys, n (its size) and level."""
    keyed = nodes.select("fp", "n", "level", F.posexplode("keys").alias("band", "value"))
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "fp")).alias(f"m{k}") for k in (1, 2)]
    sizes = keyed.groupBy("band", "value").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"), F.min("level").alias("low"), F.max("level").alias("high"), *marks)
    # Of blocks with the same members one is compared.
    same = sizes.where("sets > 1").groupBy("sets", "shingles", "low", "high", "m1", "m2").agg(F.min(F.struct("band", "value")).alias("b"))
    blocks = cut(same.select("b.*", "sets", "shingles", "low", "high"))
    level = F.col("level")
    small = (F.col("sets") <= tile) & (F.col("shingles") <= shingles)
    parts = F.greatest(F.ceil(F.col("sets") / tile), F.ceil(F.col("shingles") / shingles)).cast("int")
    near = F.sequence(F.greatest(level - 1, F.col("low")), F.least(level + 1, F.col("high")))
    return cut(deal(keyed.join(blocks, ["band", "value"]), small, parts, near))


def ordered(ends: list[tuple[bytes, bytes]]) -> pd.DataFrame:
    return pd.DataFrame({"u": [max(e) for e in ends], "v": [min(e) for e in ends]})


def candidates(nodes: DataFrame, radius: int, tile: int = SET_TILE) -> DataFrame:
    """Links (u, v), u > v, that connect all nodes that share a key and whose SimHashes (sim) are within the radius."""
    dealt = dealt_blocks(nodes.withColumn("n", F.lit(0)), tile, SET_SHINGLES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches):
            # A row is the words of the fingerprint, which are compared, and the two of the name.
            named = np.frombuffer(b"".join(part["sim"] + part["fp"]), np.uint64).reshape(len(part), -1)
            for x, y in compare_groups(part["g"].to_numpy(), part["side"].to_numpy(), named, radius, WORDS):
                if len(x):
                    yield ordered([(a.tobytes(), b.tobytes()) for a, b in zip(x[:, WORDS:], y[:, WORDS:], strict=True)])

    return dealt.join(nodes.select("fp", "sim"), "fp").repartition("g").sortWithinPartitions("g").mapInPandas(run, "u binary, v binary").distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, text_col: str, shingle: int, similarity: float, tile: int, shingles: int) -> DataFrame:
    """Links (u, v), u > v, that connect all nodes that are candidates and whose sets have the similarity.

    nodes has one row for each set: fp, sim, keys, n (its size), level and the row keys k1, k2 of a row of docs with that set.
    """
    found = cut(components(candidates(nodes, wide_radius(similarity), tile)))
    member = found.select(F.col("node").alias("fp"), "root").union(found.select("root", "root").distinct())
    near = cut(nodes.drop("sim").join(member, "fp"))
    totals = near.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    whole = F.array(F.xxhash64("root"))
    blocks = F.transform("keys", lambda k, band: F.xxhash64("root", band, k))
    keys = F.when((F.col("sets") <= tile) & (F.col("shingles") <= shingles), whole).otherwise(blocks)
    near = cut(near.join(totals, "root").select("fp", "n", "level", "k1", "k2", keys.alias("keys")))
    dealt = dealt_blocks(near, tile, shingles)
    needed = cut(near.join(dealt.select("fp").distinct(), "fp", "left_semi").select("fp", "k1", "k2"))
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed.hint("shuffle_hash")
    texts = docs.select("k1", "k2", F.col(text_col).alias("text")).join(needed, ["k1", "k2"]).groupBy("fp").agg(F.first("text").alias("text"))
    sets = texts.select("fp", shingle_set(F.col("text"), shingle).alias("set"))
    exact = Fraction(str(similarity))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(batches):
            for _, rows in part.groupby("g", sort=False):
                fp = rows["fp"].tolist()
                links = zip(*set_links([np.frombuffer(x, np.uint64) for x in rows["set"]], rows["side"].to_numpy(), exact), strict=True)
                ends = [(fp[i], fp[j]) for i, j in links]
                if ends:
                    yield ordered(ends)

    return dealt.join(sets, "fp").repartition("g").sortWithinPartitions("g").mapInPandas(run, "u binary, v binary").distinct()


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, tile: int = SET_TILE, shingles: int = SET_SHINGLES
) -> DataFrame:
    """(k1, k2, id, first): the key of each row of docs and the (id, k1, k2) that comes first in its group of near copies."""
    k1, k2 = row_keys(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    named_rows = docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text"))
    marked = cut(named_rows.select("id", "k1", "k2", set_sketch(F.col("text"), shingle).alias("s")).select("id", "k1", "k2", "s.*"))
    level = F.floor(F.log(F.greatest("n", F.lit(1))) / -math.log(similarity)).cast("int")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    distinct = marked.groupBy("fp").agg(F.min(order).alias("least"), F.first("sim").alias("sim"), F.first("keys").alias("keys"), F.first("n").alias("n"))
    distinct = cut(distinct)
    nodes = distinct.select("fp", "sim", "keys", "n", level.alias("level"), "least.k1", "least.k2")
    groups = named(distinct, similar_links(named_rows, nodes, "text", shingle, similarity, tile, shingles), "least")
    return marked.join(groups, "fp").select("k1", "k2", "id", F.col("component").alias("first"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group the row with the smallest id stays (rows equal in id and text are one document)."""
    found = similar_documents(docs, id_col, text_col, shingle, similarity)
    gone = cut(found.where((F.col("k1") != F.col("first.k1")) | (F.col("k2") != F.col("first.k2"))).select("k1", "k2").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("shuffle_hash")
    k1, k2 = row_keys(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    return rows.join(gone, ["k1", "k2"], "left_anti").select("row.*")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
