"""Exact substring dedup across documents by hash-compared suffix sorting of anchored strings.

Bytes are removed that lie in a string of `length` bytes which also starts in a document with a smaller id. Every string of that
length has an anchor: the leftmost K-gram of smallest hash in it, so equal strings have equal anchors at equal places, and one
anchor stands for about twenty strings that follow each other, its stretch. Three passes over chunks of documents find all repeats:

1. For each anchor a chunk sends 32 bits of its K-gram's hash beyond its bucket, 31 bits of its stretch's and the smallest document; the
   bucket answers with the entries whose bytes are needed: of K-grams that stand in unequal stretches, and of equal ones of unequal
   documents. Hashes only choose here: entries that are taken for equal and aren't, are told apart by their bytes.
2. Of those the chunk sends the stretches' bytes, once each. Stretches that are all equal are compared as a whole. Of others the bucket
   sorts the suffixes that start at the anchors: a merge sort that compares suffixes by prefix polynomial hashes and binary search for
   their common extension. Strings with the same anchor place are equal where suffixes beside each other have a long enough common
   extension and the bytes before the anchor agree; the smallest document of equal strings, verified byte by byte, is sent to each
   stretch that a smaller document shares a string with.
   A K-gram in very many unequal stretches would fill a task: an estimate from a sample of chunks finds those with more than HOT. Their
   entries take no part in pass 1; the chunk sends each of their strings once, and buckets go by the strings' hashes, so that a K-gram
   of a third of all documents spreads over all tasks. This only chooses a way: the result is the same whichever K-grams go by it.
3. Each chunk removes the strings found.

Nothing is removed on the word of a hash: equal strings are compared byte by byte inside chunks (each occurrence with the one before)
and in buckets. Prefix hashes make a comparison logarithmic. A chunk sends each anchor and each string once, however many of its
documents hold it, so a passage in a third of all documents reaches a bucket once for each chunk. Chunks grow with the square root of
the corpus, from CHUNK to MOST_CHUNK bytes, so that a chunk's message to a bucket holds many entries; beyond about a terabyte messages
get shorter, and there are never more of them than anchors. Chunks are written once to a table in the shared folder, bucketed by
chunk, and read from there by each pass; common.drop_scratch removes it once results have been used, at the latest when Python ends.

Defined results: a null text is empty; texts shorter than `length` stay; rows with the same id don't remove each other's bytes, nor
do rows with a null id, which come after all others; ids must be integers (others fail when they are cast to long); what is left of a
text may be no valid UTF-8 and is binary; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch

K = 18
#: Estimated stretches of a K-gram, counted once for each chunk, beyond which its strings go by their own hashes, and the most K-grams of
#: which all chunks are told (8 bytes each): those with most stretches.
HOT, MOST_HOT = 1 << 15, 1_000_000
CHUNK, BUCKET, SLICE = 8 << 20, 2 << 20, 1 << 18
MOST_CHUNK, MOST_BUCKET, MOST_FILES = 32 << 20, 8 << 20, 50_000
SAMPLED = 8
LAST = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_bytes = np.random.default_rng(20240229).integers(1 << 63, 1 << 64, 256, np.uint64)  # fixed values of the bytes in hashes
_powers: dict[int, np.ndarray] = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        p = np.full(max(n, 2 * len(_powers[base])), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


class Prefixes:
    """Hashes of all substrings of a text from the hashes of its prefixes, modulo 2^64."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_bytes[text] * powers(BASE, self.n), out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * powers(INVERSE, self.n + 1)[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Stretches of all texts: text number, first and last string (start in the text), anchor, K-gram hash and stretch hash."""
    parts = []
    begin = size = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (size and size + len(texts[i]) > SLICE):
            if size >= length:
                parts.append(_anchors(texts[begin:i], begin, length))
            begin, size = i, 0
        size += len(texts[i]) if i < len(texts) else 0
    names = ("doc", "lo", "hi", "at", "gram", "stretch")
    kinds = (np.int32, np.int32, np.int32, np.int32, np.uint64, np.uint64)
    return {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, k) for n, k in zip(names, kinds, strict=True)}


def _anchors(texts: list[bytes], number: int, length: int) -> dict[str, np.ndarray]:
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    prefix = Prefixes(buf)
    n = len(buf) - length + 1
    value = mixed(prefix.of(np.arange(len(buf) - K + 1), K))
    # Smallest K-gram of each string, by doubling the number of K-grams looked at.
    width, have, low = length - K + 1, 1, value
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    inside = np.ones(n, bool)  # strings of one text only
    for end in (begins + sizes).tolist():
        inside[max(0, end - length + 1) : end] = False
    start = np.flatnonzero(inside)
    least = low[start]
    leaves = value[start] == least  # the anchor is the string's first K-gram, so the next string has another
    first = np.append(True, (least[1:] != least[:-1]) | leaves[:-1] | (start[1:] != start[:-1] + 1))[: len(start)]
    last = np.append(first[1:], True)[: len(start)]
    lo, hi, gram = start[first], start[last], least[last]
    at = hi.copy()
    later = np.flatnonzero(~leaves[last])
    if len(later):
        ahead = value[hi[later][:, None] + np.arange(1, width)] == gram[later][:, None]
        at[later] += 1 + ahead.argmax(1)
    size = hi - lo + length
    stretch = mixed(prefix.of(lo, size) + (size * 64 + (at - lo)).astype(np.uint64) * np.uint64(BASE))
    doc = np.searchsorted(begins + sizes, lo, side="right")
    own = begins[doc]
    return {
        "doc": (doc + number).astype(np.int32), "lo": (lo - own).astype(np.int32), "hi": (hi - own).astype(np.int32), "at": (at - own).astype(np.int32),
        "gram": mixed(gram + np.uint64(BASE)), "stretch": stretch >> np.uint64(33),
    }


def sorted_by(gram: np.ndarray, stretch: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order by K-gram, stretch and document. Most K-grams occur once, so only the others are compared further."""
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    same = np.append(False, g[1:] == g[:-1])[: len(g)]
    tied = np.flatnonzero(same | np.append(same[1:], False)[: len(g)])
    part = order[tied]
    order[tied] = part[np.lexsort((doc[part], stretch[part], gram[part]))]
    return order


def padded_rows(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of one width with the bytes of each piece, zeros after its end."""
    step = np.arange(size.max())
    return np.where(step < size[:, None], text[np.minimum(start[:, None] + step, len(text) - 1)], 0).astype(np.uint8)


class Chunk:
    """A chunk's documents in order, their stretches, and its entries: distinct stretches with the smallest document.

    Entries of hot K-grams are apart from the others; those are numbered by `cold`.
    """

    def __init__(self, rows: pd.DataFrame, length: int, hot: np.ndarray):
        rows = rows.sort_values(["rank", "k1", "k2"], kind="stable")
        self.rows, self.rank = rows, rows["rank"].to_numpy(np.int64)
        self.texts = [bytes(t) for t in rows["text"]]
        a = anchors(self.texts, length)
        order = sorted_by(a["gram"], a["stretch"], a["doc"])
        self.a = {k: v[order] for k, v in a.items()}
        gram, stretch = self.a["gram"], self.a["stretch"]
        first = np.append(True, (gram[1:] != gram[:-1]) | (stretch[1:] != stretch[:-1])) if len(gram) else np.zeros(0, bool)
        again = np.flatnonzero(~first)
        if len(again):
            first[again] = ~self.equal(again, again - 1, length)
        self.first = np.flatnonzero(first)
        self.entry = np.cumsum(first) - 1
        last = np.append(self.first[1:], len(gram)) - 1
        self.gram, self.stretch = gram[self.first], stretch[self.first]
        self.low = self.rank[self.a["doc"][self.first]]
        self.shared = self.rank[self.a["doc"][last[: len(self.first)]]] != self.low if len(self.first) else np.zeros(0, bool)
        crowded = np.isin(self.gram, hot)
        self.cold, self.hot = np.flatnonzero(~crowded), np.flatnonzero(crowded)

    def equal(self, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
        """Whether the stretches of occurrences x and y are the same bytes."""
        sizes = np.array([len(t) for t in self.texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"".join(self.texts), np.uint8)
        start, size = [], []
        for k in (x, y):
            lo = self.a["lo"][k].astype(np.int64)
            start.append(begins[self.a["doc"][k]] + lo)
            size.append(self.a["hi"][k] - lo + length)
        words = np.ndarray(len(text) - 7, np.uint64, text.tobytes(), strides=(1,))  # eight bytes at a time, the last ones up to the end
        out = size[0] == size[1]
        for k in range(0, int(size[0].max()), 8):
            off = np.minimum(k, size[0] - 8)
            out &= words[start[0] + off] == words[np.minimum(start[1] + off, len(words) - 1)]
        return out

    def buckets(self, n: int) -> Iterator[tuple[int, slice]]:
        """Cold entries by K-gram bucket; they are sorted by K-gram, so a bucket is a range."""
        return ranges_of(bucket_of(self.gram[self.cold], n))

    def bytes_of(self, entries: np.ndarray, length: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes of the entries' stretches, their sizes, and where in them their anchors are."""
        run = self.first[entries]
        doc, lo, hi = self.a["doc"][run], self.a["lo"][run].astype(np.int64), self.a["hi"][run].astype(np.int64)
        text = b"".join(self.texts[d][i : j + length] for d, i, j in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True))
        return text, hi - lo + length, self.a["at"][run] - lo


def ranges_of(b: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, range) of runs of equal values."""
    edges = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, int), len(b))
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(b[s]), slice(s, e)


def bucket_of(gram: np.ndarray, n: int) -> np.ndarray:
    return ((gram >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: integers that fit 32 bits take 32."""
    out = []
    for a in arrays:
        if a.dtype == np.int64 and (not len(a) or (a.min() >= 0 and a.max() < 2**32)):
            a = a.astype(np.uint32)
        out.append(struct.pack("<cI", a.dtype.char.encode(), len(a)) + a.tobytes())
    return b"".join(out)


_codec: list = []


def codec() -> list:
    """This process's compressor and decompressor."""
    if not _codec:
        _codec.extend([zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()])
    return _codec


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = struct.unpack_from("<cI", data, at)
        a = np.frombuffer(data, kind.decode(), n, at + 5)
        at += 5 + a.nbytes
        out.append(a.astype(np.int64) if a.dtype == np.uint32 else a)
    return out


ROWS = "chunk long, bucket long, kind int, data binary"
COLUMNS = ["chunk", "bucket", "kind", "data"]


def many_stretches(rows: pd.DataFrame, length: int, least: int) -> pd.DataFrame:
    """(K-gram, stretches) of those with at least `least` unequal stretches in this chunk."""
    c = Chunk(rows, length, np.zeros(0, np.uint64))
    gram, n = np.unique(c.gram, return_counts=True)
    many = n >= least
    return pd.DataFrame({"gram": gram[many].view(np.int64), "n": n[many]})


def send_anchors(rows: pd.DataFrame, length: int, n_buckets: int, hot: np.ndarray) -> pd.DataFrame:
    c = Chunk(rows, length, hot)
    gram = (c.gram[c.cold] & np.uint64(2**32 - 1)).astype(np.uint32)
    marked = (c.stretch[c.cold] << np.uint64(1) | c.shared[c.cold].astype(np.uint64)).astype(np.uint32)
    low = c.low[c.cold]
    out = [(int(rows["chunk"].iloc[0]), b, 1, packed(gram[s], marked[s], low[s])) for b, s in c.buckets(n_buckets)]
    return pd.DataFrame(out, columns=COLUMNS)


def answer_anchors(rows: pd.DataFrame) -> pd.DataFrame:
    """To each chunk: entries whose bytes are needed, and whether they are to be sorted (or only compared as a whole)."""
    rows = rows.sort_values("chunk")
    parts = [unpacked(d) for d in rows["data"]]
    sizes = np.array([len(p[0]) for p in parts])
    gram, marked, low = (np.concatenate([p[i] for p in parts]) for i in range(3))
    stretch, shared = marked >> 1, (marked & 1).astype(bool)
    order = np.lexsort((stretch, gram))
    g, s, m = gram[order], stretch[order], low[order]
    new_gram = np.append(True, g[1:] != g[:-1])
    new_stretch = new_gram | np.append(True, s[1:] != s[:-1])
    by_stretch, by_gram = np.flatnonzero(new_stretch), np.flatnonzero(new_gram)
    of_gram, of_stretch = np.cumsum(new_gram) - 1, np.cumsum(new_stretch) - 1
    several = np.add.reduceat(new_stretch.astype(np.int64), by_gram) > 1
    apart = (np.minimum.reduceat(m, by_gram) != np.maximum.reduceat(m, by_gram)) | np.logical_or.reduceat(shared[order], by_gram)
    copied = np.minimum.reduceat(m, by_stretch) != np.maximum.reduceat(m, by_stretch)
    sort, compare = np.empty(len(g), bool), np.empty(len(g), bool)
    sort[order] = (several & apart)[of_gram]
    compare[order] = copied[of_stretch]
    out, at = [], 0
    for chunk, n in zip(rows["chunk"].tolist(), sizes.tolist(), strict=True):
        part = slice(at, at + n)
        at += n
        ask = np.flatnonzero(sort[part] | compare[part])
        if len(ask):
            out.append((chunk, int(rows["bucket"].iloc[0]), 2, packed(ask, sort[part][ask].astype(np.uint8))))
    return pd.DataFrame(out, columns=COLUMNS)


class HotStrings:
    """The distinct strings of a chunk's stretches of hot K-grams, by hash, with the smallest document, and where each occurs."""

    def __init__(self, c: Chunk, length: int):
        data, size, _ = c.bytes_of(c.hot, length)
        text = np.frombuffer(data, np.uint8)
        strings = size - length + 1
        record = np.repeat(np.arange(len(c.hot)), strings)
        string = np.arange(len(record)) - np.repeat(np.cumsum(strings) - strings, strings)
        at = np.repeat(np.cumsum(size) - size, strings) + string
        h = mixed(Prefixes(text).of(at, length))
        order = np.lexsort((c.low[c.hot][record], h))
        h, at = h[order], at[order]
        rows = padded_rows(text, at, np.full(len(at), length)) if len(at) else np.zeros((0, length), np.uint8)
        new = np.append(True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1]).any(1)) if len(h) else np.zeros(0, bool)
        self.entry, self.string, self.klass = c.hot[record[order]], string[order], np.cumsum(new) - 1
        self.h, self.low, self.text = h[new], c.low[self.entry[new]], rows[new]

    def buckets(self, n: int) -> Iterator[tuple[int, slice]]:
        return ranges_of(bucket_of(self.h, n))


def by_chunk_bucket(answers: pd.DataFrame, kind: int) -> dict[int, list[np.ndarray]]:
    return {b: unpacked(d) for b, k, d in zip(answers["bucket"], answers["kind"], answers["data"], strict=True) if k == kind}


def send_stretches(rows: pd.DataFrame, answers: pd.DataFrame, length: int, n_buckets: int, hot: np.ndarray) -> pd.DataFrame:
    if not len(rows):
        return pd.DataFrame([], columns=COLUMNS)
    asked = by_chunk_bucket(answers, 2)
    c = Chunk(rows, length, hot)
    chunk = int(rows["chunk"].iloc[0])
    out = []
    for b, s in c.buckets(n_buckets):
        if b in asked:
            e = c.cold[s.start + asked[b][0]]
            text, size, anchor = c.bytes_of(e, length)
            data = packed(c.gram[e], c.low[e], size.astype(np.uint16), anchor.astype(np.uint16), asked[b][1], np.frombuffer(text, np.uint8))
            out.append((chunk, b, 3, codec()[0].compress(data)))
    if len(c.hot):
        strings = HotStrings(c, length)
        out += [(chunk, b, 5, codec()[0].compress(packed(strings.h[s], strings.low[s], strings.text[s].ravel()))) for b, s in strings.buckets(n_buckets)]
    return pd.DataFrame(out, columns=COLUMNS)


class Suffixes:
    """Suffixes of a text compared on their first `length` bytes."""

    def __init__(self, text: np.ndarray, length: int):
        self.text, self.length, self.prefix = text, length, Prefixes(text)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common extension, at most `length`: binary search on equal prefix hashes."""
        out = np.full(len(x), self.length)
        apart = np.flatnonzero(self.prefix.of(x, self.length) != self.prefix.of(y, self.length))
        x, y = x[apart], y[apart]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length - 1)
        for _ in range((self.length - 1).bit_length()):
            middle = (low + high + 1) // 2
            same = self.prefix.of(x, middle) == self.prefix.of(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[apart] = low
        return out

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        end = n == self.length
        n = np.minimum(n, self.length - 1)
        return np.where(end, or_equal, self.text[x + n] < self.text[y + n])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes within groups (group numbers ascending): a bottom-up merge sort, all runs of a width at once.

        Each element finds by binary search how many of the neighbouring run go before it; those ahead win ties.
        """
        n = len(at)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(first, n))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        offset = np.arange(n) - begin
        order = np.arange(n)
        width = 1
        while width < size.max():
            live = np.flatnonzero(count > width)
            o = offset[live]
            run = o // width
            other = (run ^ 1) * width  # where the neighbouring run starts in the group
            low, high = np.zeros(len(live), np.int64), np.clip(count[live] - other, 0, width)
            x, second = at[order[live]], (run & 1).astype(bool)
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                y = at[order[begin[live[open_]] + other[open_] + middle]]
                before = self.less(y, x[open_], second[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            new = order.copy()
            new[begin[live] + (run & ~1) * width + o % width + low] = order[live]
            order = new
            width *= 2
        return order


def answer_stretches(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """To each chunk: (entry, string of its stretch or none for all of it, smallest document), where that is smaller than the stretch's own."""
    rows = rows.sort_values("chunk")
    out = []
    if len(own := rows[rows["kind"] == 3]):
        out += _answer_bytes(own, length)
    if len(own := rows[rows["kind"] == 5]):
        out += _answer_strings(own, length)
    return pd.DataFrame(out, columns=COLUMNS)


def least_of_equal(h: np.ndarray, rows: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The smallest document of the rows that are the same bytes as each; equal rows have equal hashes."""
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    if ((rows[order][1:] != rows[order][:-1]).any(1) & ~new[1:]).any():  # hashes collide: by the bytes themselves
        of = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(of, kind="stable")
        new = np.append(True, of[order][1:] != of[order][:-1])
    out = np.empty(len(low), np.int64)
    out[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _answer_strings(rows: pd.DataFrame, length: int) -> list[tuple]:
    parts = [unpacked(codec()[1].decompress(d)) for d in rows["data"]]
    counts = np.array([len(p[0]) for p in parts])
    h, low, text = (np.concatenate([p[i] for p in parts]) for i in range(3))
    least = least_of_equal(h, text.reshape(-1, length), low)
    out, at = [], 0
    for chunk, n in zip(rows["chunk"].tolist(), counts.tolist(), strict=True):
        smaller = np.flatnonzero(least[at : at + n] < low[at : at + n])
        if len(smaller):
            out.append((chunk, int(rows["bucket"].iloc[0]), 6, packed(smaller, least[at : at + n][smaller])))
        at += n
    return out


def _answer_bytes(rows: pd.DataFrame, length: int) -> list[tuple]:
    parts = [unpacked(codec()[1].decompress(d)) for d in rows["data"]]
    counts = np.array([len(p[0]) for p in parts])
    gram, low, size, anchor, sort, text = (np.concatenate([p[i] for p in parts]) for i in range(6))
    size, anchor, sort = size.astype(np.int64), anchor.astype(np.int64), sort.astype(bool)
    edges = np.append(0, np.cumsum(size)).tolist()
    data = text.tobytes()
    # Compared as a whole; a K-gram whose stretches turn out to be unequal is sorted after all.
    plain = np.flatnonzero(~sort)
    least: dict[bytes, int] = {}
    pieces = [data[edges[k] : edges[k + 1]] for k in plain.tolist()]
    for piece, doc in zip(pieces, low[plain].tolist(), strict=True):
        if least.get(piece, LAST + 1) > doc:
            least[piece] = doc
    own = np.array([least[p] for p in pieces], np.int64)
    kinds = {}
    for g, piece in zip(gram[plain].tolist(), pieces, strict=True):
        kinds.setdefault(g, piece)
    unequal = np.array([kinds[g] != piece for g, piece in zip(gram[plain].tolist(), pieces, strict=True)], bool)
    sort[plain] = np.isin(gram[plain], gram[plain[unequal]])
    starts = np.append(0, np.cumsum(counts))
    message = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(size)) - starts[message]
    found = np.zeros(len(size), bool)
    found[plain] = (own < low[plain]) & ~sort[plain]
    to = np.full(len(size), LAST)
    to[plain] = own
    record, string, smaller = _sorted_strings(np.flatnonzero(sort), gram, low, size, anchor, text, np.array(edges[:-1]), length)
    out = []
    bucket = int(rows["bucket"].iloc[0])
    ends = np.searchsorted(message[record], np.arange(len(counts) + 1))
    for k, chunk in enumerate(rows["chunk"].tolist()):
        whole = starts[k] + np.flatnonzero(found[starts[k] : starts[k + 1]])
        s = slice(ends[k], ends[k + 1])
        if len(whole) or s.start < s.stop:
            out.append((chunk, bucket, 4, packed(place[whole], to[whole], place[record[s]], string[s].astype(np.uint8), smaller[s])))
    return out


def _sorted_strings(
    which: np.ndarray, gram: np.ndarray, low: np.ndarray, size: np.ndarray, anchor: np.ndarray, text: np.ndarray, begin: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, string of its stretch, smallest document) of the records' strings that a smaller document has; in order of records."""
    if not len(which):
        return (np.zeros(0, np.int64),) * 3
    group = np.unique(gram[which], return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    # Each record's bytes from its anchor on, and those before it backwards, padded to rows of one width.
    which, group = which[order], group[order]
    size, anchor, low = size[which], anchor[which], low[which]
    place = begin[which] + anchor
    width = length - K
    step = np.arange(length)
    right = np.where(step < (size - anchor)[:, None], text[np.minimum(place[:, None] + step, len(text) - 1)], 0).astype(np.uint8)
    left = np.where(step[:width] < anchor[:, None], text[np.maximum(place[:, None] - 1 - step[:width], 0)], 0).astype(np.uint8)
    suffixes = Suffixes(right.ravel(), length)
    at = np.arange(len(which)) * length
    by = suffixes.sort(at, group)
    which, size, anchor, group, low, right, left = which[by], size[by], anchor[by], group[by], low[by], right[by], left[by]
    extension = np.append(-1, np.where(group[1:] == group[:-1], suffixes.common(at[by][1:], at[by][:-1]), -1))
    before = Prefixes(left.ravel())
    row = np.arange(len(which)) * width
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for p in range(width + 1):
        # Strings with p bytes before the anchor: equal suffixes of the rest stand together, and the p bytes must agree.
        string = anchor - p
        here = np.flatnonzero((string >= 0) & (string <= size - length))
        run = np.cumsum(extension < length - p)[here]
        side = before.of(row[here], p)
        o = np.lexsort((low[here], side, run))
        new = np.append(True, (run[o][1:] != run[o][:-1]) | (side[o][1:] != side[o][:-1])) if len(o) else np.zeros(0, bool)
        first = here[o][new][np.cumsum(new) - 1] if len(o) else o
        mine = here[o]
        smaller = np.flatnonzero(low[first] < low[mine])
        mine, first = mine[smaller], first[smaller]
        same = (right[mine, : length - p] == right[first, : length - p]).all(1) & (left[mine, :p] == left[first, :p]).all(1)
        found.append((which[mine[same]], string[mine[same]], low[first[same]]))
    record, string, least = (np.concatenate([f[i] for f in found]) for i in range(3))
    o = np.argsort(record, kind="stable")
    return record[o], string[o], least[o]


RESULT = "id long, k1 long, k2 long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def remove(rows: pd.DataFrame, answers: pd.DataFrame, length: int, n_buckets: int, hot: np.ndarray) -> pd.DataFrame:
    if not len(rows):
        return pd.DataFrame([], columns=["id", "k1", "k2", "n_bytes", "spans", "kept"])
    c = Chunk(rows, length, hot)
    low = c.low.copy()
    singles = []
    asked, told, hashed = (by_chunk_bucket(answers, kind) for kind in (2, 4, 6))
    for b, s in c.buckets(n_buckets):
        if b in told:
            entry = c.cold[s.start + asked[b][0]]
            whole, least, record, string, smaller = told[b]
            low[entry[whole]] = np.minimum(low[entry[whole]], least)
            singles.append([entry[record], string, smaller])
    if len(c.hot):
        strings = HotStrings(c, length)
        least = strings.low.copy()
        for b, s in strings.buckets(n_buckets):
            if b in hashed:
                least[s.start + hashed[b][0]] = hashed[b][1]
        singles.append([strings.entry, strings.string, least[strings.klass]])
    sizes = np.array([len(t) for t in c.texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    depth = np.zeros(int((sizes + 1).sum()) + 1, np.int32)

    def cover(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        np.add.at(depth, begins[doc] + lo, 1)
        np.add.at(depth, begins[doc] + hi, -1)

    a = c.a
    whole = low[c.entry] < c.rank[a["doc"]]
    cover(a["doc"][whole], a["lo"][whole], a["hi"][whole] + length)
    if singles:
        entry, string, least = (np.concatenate([s[i] for s in singles]) for i in range(3))
        # All occurrences of an entry follow each other; each is told of the strings of the entry.
        runs = np.append(c.first[1:], len(c.entry))[entry] - c.first[entry]
        which = np.repeat(np.arange(len(entry)), runs)
        run = c.first[entry][which] + np.arange(len(which)) - np.repeat(np.cumsum(runs) - runs, runs)
        hit = least[which] < c.rank[a["doc"][run]]
        run, start = run[hit], string[which[hit]].astype(np.int64)
        cover(a["doc"][run], a["lo"][run] + start, a["lo"][run] + start + length)
    gone = np.cumsum(depth) > 0
    out = []
    for i, (k, b) in enumerate(zip(sizes.tolist(), begins.tolist(), strict=True)):
        mask = gone[b : b + k]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        text = c.texts[i]
        kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if len(edges) else text
        out.append((k, [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)], kept))
    result = pd.DataFrame(out, columns=["n_bytes", "spans", "kept"])
    for name in ("k1", "k2"):
        result[name] = c.rows[name].to_numpy()
    result["id"] = pd.array([None if r == LAST else int(r) for r in c.rank], "Int64")
    return result[["id", "k1", "k2", "n_bytes", "spans", "kept"]]


def chunked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(documents by chunk, number of chunks, number of K-gram buckets). The table is written once, each chunk in one place."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    even = math.isqrt(1000 * total)  # then a chunk's message to a bucket holds about fifty entries
    n = max(1, -(-total // max(CHUNK, min(even, MOST_CHUNK))))
    n_buckets = max(1, -(-total // max(BUCKET, min(even, MOST_BUCKET))))
    files = min(n, MOST_FILES)  # beyond, a file holds several chunks
    k1, k2 = F.xxhash64(F.lit(1), F.col(id_col), text), F.xxhash64(F.lit(2), F.col(id_col), text)
    rank = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(rank.alias("rank"), k1.alias("k1"), k2.alias("k2"), text.alias("text")).withColumn("chunk", F.pmod("k1", F.lit(n)))
    name = f"pointloom_chunks_{uuid4().hex}"
    rows.repartition(files, "chunk").write.bucketBy(files, "chunk").option("path", scratch(spark, name, table=True)).saveAsTable(name)
    return spark.table(name), n, n_buckets


def hot_grams(chunks: DataFrame, n: int, length: int, hot: int) -> np.ndarray:
    """K-grams of which a sample of chunks (all, where there are few) lets expect more than `hot` stretches; MOST_HOT at most."""
    step = max(1, n // SAMPLED)
    seen = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(step)) == 0)
    least = max(1, hot // n // 8)  # chunks are dealt by hash, so a K-gram's stretches spread over all of them
    found = seen.groupBy("chunk").applyInPandas(lambda rows: many_stretches(rows, length, least), "gram long, n long")
    often = found.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") * step > hot)
    rows = often.orderBy(F.desc("n"), "gram").limit(MOST_HOT).select("gram").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, hot: int | None = None) -> DataFrame:
    """(id_col, n_bytes, spans, kept): removed byte spans and what is left of each row's text.

    hot: from how many stretches on (HOT, if it isn't given) a K-gram's strings go by their own hashes. Any value gives the same result.
    """
    if not K <= length <= 200:
        raise ValueError(f"lengths from {K} to 200")
    spark = docs.sparkSession
    chunks, n, buckets = chunked(docs, id_col, text_col)
    crowded = hot_grams(chunks, n, length, HOT if hot is None else hot)
    sent = chunks.groupBy("chunk").applyInPandas(lambda rows: send_anchors(rows, length, buckets, crowded), ROWS)
    answers = sent.groupBy("bucket").applyInPandas(answer_anchors, ROWS)
    path = scratch(spark, f"pointloom-answers-{uuid4().hex}")
    answers.write.parquet(path)  # read twice below
    answers = spark.read.schema(ROWS).parquet(path)
    stretches = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda rows, got: send_stretches(rows, got, length, buckets, crowded), ROWS)
    more = stretches.groupBy("bucket").applyInPandas(lambda rows: answer_stretches(rows, length), ROWS)
    done = chunks.groupBy("chunk").cogroup(answers.unionByName(more).groupBy("chunk")).applyInPandas(lambda rows, got: remove(rows, got, length, buckets, crowded), RESULT)
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_bytes", "spans", "kept")


def digest(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return done.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
