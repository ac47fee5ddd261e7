"""Collocations: phrases of two to `longest` words that are more frequent than their parts let expect, for each language.

Texts are gathered into shards of one language, whose words are numbered. A shard's suffix array comes from prefix doubling over word numbers, its
LCP values from the ranks of the rounds; an LCP interval at n is a phrase of n words and its size the phrase's count in the shard. Counts are then
merged by key over all shards, one length after the other, for a phrase can only be frequent if its parts are:

* Frequent phrases have names. What the merge of length n finds goes back to the shards that hold the phrase; a shard then counts phrases of n + 1 words
  only where the two phrases of n words inside have names, and the two names are the key: a phrase is known exactly, no hash stands for it.
* A shard sends a key once with its count, so a phrase that is everywhere meets as many counts as there are shards. Keys are dealt to buckets by
  a hash of both names. What a shard has for a bucket travels as one row: its keys in order, the first name as the difference from the one before,
  all numbers cut into bytes and those laid out by significance. The high ones are zeros, which the shuffle's compression takes away.
  A task merges one bucket at a time and tells a shard of its phrases there in one such row, of places and names. A phrase's name is its rank among the
  bucket's frequent ones and the bucket, so names stay small numbers. A word's name is the smallest of its places.
* The tables of frequent phrases take their texts and the counts of their beginnings and ends from the tables one word shorter by joins on names.

So all counts are over all documents, nothing is collected by the driver and nothing broadcast that grows. A shard is SHARD bytes of text (one document, if
that is longer), and a task holds one at a time while it counts, and while texts are gathered one for each language or HELD bytes.
Tables between the steps lie in the shared folder; the steps' own are removed when they have been used.

Defined results: a null text is empty, a null language `und`; languages without words give no rows; repeated rows count again; A-Z are lower-cased, nothing
else; ids and other columns are ignored; ties of score and count go by the phrase's bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remove_path, scratch
from .suffixes import common, suffix_ranks

SHARD, HELD, MOST_FILES = 4 << 20, 16 << 20, 50_000
#: Bits of a place inside a shard, and of a shard's number inside its partition; the rest of 63 bits is the partition's.
PLACE, SERIAL = 28, 15
#: Bytes of text for each bucket of keys, and the most buckets: with more, a shard's row for one would hold few keys.
BUCKET, MOST_BUCKETS = 4 << 20, 1 << 15
#: Breaks become new lines, tabs blanks, letters small.
_table = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(different words, numbers of all words in order) of texts; -1 stands where a piece ends."""
    tokens = b"\n".join(texts).translate(_table).replace(b"\n", b" \n ").split(b" ")
    names: dict[bytes, int] = defaultdict()
    names.default_factory = names.__len__
    names[b""], names[b"\n"]
    found = np.fromiter(map(names.__getitem__, tokens), np.int32, len(tokens))
    found = found[found > 0] - 2
    return list(names)[2:], found[(found >= 0) | np.append(True, found[:-1] >= 0)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    partition, serial, zip_ = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(3)
    texts: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def shard(lang: str) -> pa.RecordBatch:
        nonlocal serial
        words, ids = numbered(texts.pop(lang))
        if serial >> SERIAL or partition >> (63 - SERIAL - PLACE) or len(ids) >> PLACE:
            raise ValueError("too many partitions, too large ones or a text of over 2^28 words")
        sizes.pop(lang)
        row = [partition << SERIAL | serial, lang, int((ids >= 0).sum()), zip_.compress(b"\n".join(words)), zip_.compress(ids.tobytes())]
        serial += 1
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "lang", "n_words", "words", "ids"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if text:
                texts[lang].append(text)
                sizes[lang] += len(text)
                if sizes[lang] >= SHARD:
                    yield shard(lang)
                elif sum(sizes.values()) >= HELD:
                    yield shard(max(sizes, key=sizes.get))
    for lang in list(texts):
        yield shard(lang)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of shards with their counts."""
    for batch in batches:
        for shard, lang, words, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found = np.frombuffer(_open(ids), np.int32)
            counts = np.bincount(found[found >= 0])
            if len(counts):
                at = pa.array((shard << PLACE) + np.arange(len(counts)))
                yield pa.RecordBatch.from_arrays([at, pa.array([lang] * len(counts)), pa.array(_open(words).split(b"\n"), pa.binary()).cast(pa.string()), pa.array(counts)], names=["at", "lang", "word", "count"])


def phrase_counts(ids: np.ndarray, n: int, places: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, name of the first n - 1 words, of the last n - 1, count) of the shard's phrases of n words both of whose parts have names.

    places and names: a place of each named phrase of n - 1 words (of single words, their number) and its name.
    """
    kept = None
    if n > 2:  # other words than those of named phrases end pieces
        inside = np.zeros(int(ids.max()) + 2, bool)
        inside[ids[places[:, None] + np.arange(n - 1)]] = True
        inside[-1] = False
        word = inside[ids]
        kept = np.flatnonzero(word | np.append(False, word[:-1]))
        ids, places = np.where(word, ids, -1)[kept], np.searchsorted(kept, places)
    keys = np.append(ids, -1).astype(np.int64)
    breaks = np.flatnonzero(keys < 0)
    room = breaks[np.searchsorted(breaks, np.arange(len(keys)))] - np.arange(len(keys))
    keys[breaks] = keys.max() + 1 + np.arange(len(breaks))
    order, ranks = suffix_ranks(keys, depth=n)
    lcp = np.append(0, common(ranks, order[:-1], order[1:]))
    name = np.full(len(keys), -1, np.int64)
    if n == 2:
        of_word = np.full(int(keys.max()) + 1, -1, np.int64)
        of_word[places] = names
        name = of_word[keys]
    else:
        interval, slot = np.cumsum(lcp < n - 1) - 1, np.empty(len(keys), np.int64)
        slot[order] = np.arange(len(keys))
        of_interval = np.full(int(interval[-1]) + 1, -1, np.int64)
        of_interval[interval[slot[places]]] = names
        name[order] = of_interval[interval]
    first = np.flatnonzero(lcp < n)
    counts, at = np.diff(np.append(first, len(keys))), order[first]
    long = room[at] >= n
    at, counts = at[long], counts[long]
    known = (name[at] >= 0) & (name[at + 1] >= 0)
    at, counts = at[known], counts[known]
    return at if kept is None else kept[at], name[at], name[at + 1], counts


#: A shard's phrases of a bucket, packed: names of both parts, place, count. What goes back to it, packed: place, name.
COUNTED, COUNTS, NAMED = "shard long, bucket int, keys binary", ("<i8", "<i8", "<i4", "<i4"), ("<i4", "<i8")
#: A shard hands on so many keys at once, or one row.
BATCH = 1 << 21
#: What is told to a shard, or, where that is null, a frequent phrase.
FOUND = "shard long, told binary, name long, a long, p long, s long"


def _slots(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every key of rows with so many keys: the slot of its lowest byte, the way from there to the next byte, and whether it is its row's first."""
    way = np.repeat(sizes, sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = np.arange(len(way)) - start
    return start * width + inside, way, inside == 0


def pack(columns: tuple[np.ndarray, ...], kinds: tuple[str, ...], sizes: np.ndarray) -> pa.Array:
    """Rows of so many keys each, in which the first column doesn't fall."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    slot, way, first = _slots(sizes, width)
    lead = columns[0]
    step = np.where(first, lead, lead - np.append(0, lead[:-1])[: len(lead)])
    out = np.empty(len(lead) * width, np.uint8)
    for values, kind in zip((step, *columns[1:]), map(np.dtype, kinds), strict=True):
        for byte in np.ascontiguousarray(values, kind).view(np.uint8).reshape(-1, kind.itemsize).T:
            out[slot] = byte
            slot = slot + way
    ends = np.append(0, np.cumsum(sizes)) * width
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def unpack(rows: pa.Array, kinds: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, sizes) of packed rows."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2], np.uint8)[ends[0] :]
    sizes = np.diff(ends).astype(np.int64) // width
    slot, way, first = _slots(sizes, width)
    columns = []
    for kind in map(np.dtype, kinds):
        values = np.empty((len(slot), kind.itemsize), np.uint8)
        for k in range(kind.itemsize):
            values[:, k] = data[slot]
            slot = slot + way
        columns.append(values.reshape(-1).view(kind))
    upto, head = np.cumsum(columns[0], dtype=np.int64), np.flatnonzero(first)
    columns[0] = upto - np.repeat(upto[head] - columns[0][head], sizes[sizes > 0])
    return columns, sizes


def bucket_of(p: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    h = p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s.astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(n)).astype(np.int32)


def _phrases(n: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                ids = np.frombuffer(_open(batch.column(1)[i].as_py()), np.int32)
                if n == 2:
                    places, names = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                else:
                    (places, names), _ = unpack(batch.column(2)[i].values, NAMED)
                at, p, s, count = phrase_counts(ids, n, places, names)
                bucket = bucket_of(p, s, buckets)
                order = np.lexsort((s, p, bucket))
                bucket = bucket[order]
                first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
                p, s, at, count = p[order], s[order], at[order], count[order]
                cuts = np.flatnonzero(np.append(True, first[1:] // BATCH != first[:-1] // BATCH))[: len(first)].tolist()
                for i, j in pairwise([*cuts, len(first)]):
                    ends = np.append(first, len(p))[i : j + 1]
                    mine = slice(ends[0], ends[-1])
                    keys = pack((p[mine], s[mine], at[mine], count[mine]), COUNTS, np.diff(ends))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, shard)), pa.array(bucket[first[i:j]]), keys], names=["shard", "bucket", "keys"])

    return work


def _frequent(least: int, buckets: int):
    """Merges the counts that shards sent to a bucket."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        parts = [(np.asarray(b.column("shard")), *unpack(b.column("keys"), COUNTS)) for b in table.to_batches() if b.num_rows]
        p, s, place, count = (np.concatenate([columns[i] for _, columns, _ in parts]) for i in range(4))
        shard = np.concatenate([np.repeat(shards, sizes) for shards, _, sizes in parts])
        order = np.lexsort((s, p))
        p, s = p[order], s[order]
        head = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])))
        a, sizes = np.add.reduceat(count[order].astype(np.int64), head), np.diff(np.append(head, len(p)))
        enough = a >= least
        name = np.arange(int(enough.sum())) * buckets + key[0].as_py()
        kept, name_of = order[np.repeat(enough, sizes)], np.repeat(name, sizes[enough])
        by = np.lexsort((place[kept], shard[kept]))
        kept, name_of = kept[by], name_of[by]
        shards, sizes = np.unique(shard[kept], return_counts=True)
        told = [pa.array(shards), pack((place[kept], name_of), NAMED, sizes), *[pa.nulls(len(shards), pa.int64())] * 4]
        phrases = [pa.nulls(len(name), pa.int64()), pa.nulls(len(name), pa.binary()), *map(pa.array, (name, a[enough], p[head][enough], s[head][enough]))]
        return pa.concat_tables([pa.Table.from_arrays(c, names=[f.split()[0] for f in FOUND.split(", ")]) for c in (told, phrases)])

    return work


def _score() -> str:
    """The cut of lowest score, the first of equal ones: (score, k, l, r). Products of counts are decimals of 38 digits."""
    wide = lambda x: f"cast({x} as decimal(19,0))"
    cut = f"(1000BD * {wide('a')} * {wide('n')}) div ({wide('before[k - 1]')} * {wide('behind[size(behind) - k]')})"
    return f"array_min(transform(sequence(1, size(before)), k -> named_struct('score', {cut}, 'k', k, 'l', before[k - 1], 'r', behind[size(behind) - k])))"


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000, percent: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's `first` phrases.

    Candidates have a count a of at least `least`; the score is floor(1000 a n / (l r)) at the cut into a beginning (count l) and an end (r) where that is
    lowest. A candidate goes if one that is longer and contains it has `percent` hundredths of its count or more.
    """
    if least < 1 or longest < 2 or percent < 1:
        raise ValueError("least and percent must be positive, longest at least 2")
    spark = docs.sparkSession
    mine = f"phrases-{uuid4().hex}"

    def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = scratch(spark, f"{mine}-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path), path

    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    # One table for all lengths, bucketed by shard, a file for each bucket: only what is told to the shards is shuffled to them.
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files, shards_name = min(max(1, -(-total // SHARD)), MOST_FILES), f"pointloom_{mine.replace('-', '_')}"
    buckets = min(max(1, -(-total // BUCKET)), MOST_BUCKETS)
    gathered = texts.mapInArrow(_shards, "shard long, lang string, n_words long, words binary, ids binary").repartition(files, "shard")
    shards_at = scratch(spark, shards_name, table=True)
    gathered.write.bucketBy(files, "shard").option("path", shards_at).saveAsTable(shards_name)
    shards = spark.table(shards_name)
    sizes, _ = stored(shards.groupBy("lang").agg(F.sum("n_words").alias("n")), "sizes")

    words = shards.select("shard", "lang", "words", "ids").mapInArrow(_words, "at long, lang string, word string, count long")
    same = Window.partitionBy("lang", "word")
    summed = words.select("at", "lang", "word", F.sum("count").over(same).alias("a"), F.min("at").over(same).alias("name")).where(F.col("a") >= least)
    found, found_at = stored(summed, "found-1")
    none = F.array().cast("array<long>")
    known, _ = stored(found.where("at = name").select("name", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("before"), none.alias("behind")), "known-1")
    tables: list[DataFrame] = []
    for n in range(2, longest + 1):
        # What is told to one shard, dealt as the table of shards is.
        if n == 2:
            dealt = found.select(F.shiftright("at", PLACE).alias("shard"), F.col("at").bitwiseAND((1 << PLACE) - 1).alias("place"), "name")
            parts = ["place", "name"]
        else:
            dealt, parts = found.where("shard is not null").select("shard", "told"), ["told"]
        told = dealt.repartition(files, "shard").groupBy("shard").agg(F.collect_list(F.struct(*parts)).alias("told"))
        asked = shards.select("shard", "ids").join(told, "shard").select("shard", "ids", *[F.col(f"told.{c}").alias(c) for c in parts])
        sent = asked.mapInArrow(_phrases(n, buckets), COUNTED)
        used = found_at
        found, found_at = stored(sent.groupBy("bucket").applyInArrow(_frequent(least, buckets), FOUND), f"found-{n}")
        remove_path(spark, used)
        part = lambda c, k=known: k.select(*[F.col(x).alias(f"{c}_{x}") for x in k.columns])
        both = found.where("shard is null").select("name", "p", "s", "a").join(part("p"), F.col("p") == F.col("p_name")).join(part("s"), F.col("s") == F.col("s_name"))
        table, _ = stored(
            both.select(
                "name", F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_phrase", "s_last").alias("phrase"), F.col("s_last").alias("last"), "a",
                F.concat("p_before", F.array("p_a")).alias("before"), F.concat("s_behind", F.array("s_a")).alias("behind"), "p", "s",
            ),
            f"known-{n}",
        )
        known = table.drop("p", "s")
        tables.append(table)
    spark.sql(f"DROP TABLE {shards_name}")
    for path in (found_at, shards_at):
        remove_path(spark, path)
    kept = [_outstanding(t, longer, percent) for t, longer in zip(tables, [*tables[1:], None], strict=True)]
    scored = reduce(DataFrame.union, kept).join(sizes, "lang").withColumn("c", F.expr(_score()))
    rows = scored.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _outstanding(table: DataFrame, longer: DataFrame | None, percent: int) -> DataFrame:
    """The phrases of a length that no longer one has nearly all occurrences of. No phrase is more frequent than one inside it, so those a word longer decide."""
    if longer is not None:
        most = longer.select(F.explode(F.array("p", "s")).alias("part"), F.col("a").alias("longer")).groupBy("part").agg(F.max("longer").alias("longer"))
        table = table.join(most, F.col("name") == F.col("part"), "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    return table.select("lang", "phrase", "a", "before", "behind")
