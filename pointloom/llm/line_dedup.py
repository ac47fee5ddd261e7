"""Line dedup over a whole corpus, with DataFrame operations only.

Every line becomes a 128-bit hash with its document and position. The hashes are range-partitioned with a secondary sort by
document and position, so that a line shared by a third of all documents spreads over many ranges; the sorted stream gives each
document's first occurrence of a hash, and one partial count per range and hash is shuffled to find how many documents hold it.
What goes back to the documents is a compressed bitmap for each, as runs of dropped lines (those between them stay), never text.

Defined results: a null or empty text is one empty line; lines whose key is empty never count as repeated; repeated rows with the
same id count as one document, as do all rows with a null id; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut, row_keys, sha_hex

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is: lower() where the text is ASCII, character by character elsewhere."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, keep: str) -> DataFrame:
    """(k1, k2, gone): for each row key that loses lines, its bitmap of them as runs (start, length) in order."""
    k1, k2 = row_keys(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    key = F.col("key")
    lines = (
        docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
        .select("id", "k1", "k2", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length(key) >= min_chars)
        .select(F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2"), "id", "k1", "k2", "pos")
    )
    lines = cut(lines)  # the range bounds are sampled from it, and it is read again below
    firsts = (
        lines.repartitionByRange("h1", "h2", "id")
        .sortWithinPartitions("h1", "h2", "id", "pos")
        .groupBy("h1", "h2", "id")
        .agg(F.min("pos").alias("pos"))
    )
    held = (
        firsts.groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.min(F.struct("id", "pos")).alias("first"))
        .where(F.col("n_docs") >= min_docs)
    )
    held = cut(held)  # both sides of the join are then plain exchanges, of which Spark splits large partitions: one line may be in all documents
    found = lines.join(held, ["h1", "h2"])
    if keep == "first":
        found = found.where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))))
    return found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("at")).select("k1", "k2", runs_of(F.col("at")).alias("gone"))


def runs_of(at: Column) -> Column:
    """Sorted positions as runs (start, length)."""
    starts = F.filter(at, lambda p, i: ~F.coalesce(F.get(at, i - 1) == p - 1, F.lit(False)))
    ends = F.filter(at, lambda p, i: ~F.coalesce(F.get(at, i + 1) == p + 1, F.lit(False)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def keep_runs(gone: Column, n_lines: Column) -> Column:
    """The keep bitmap as runs (start, length) of kept lines: the gaps between runs of dropped ones."""
    ends = F.concat(F.transform(gone, lambda r: r["start"]), F.array(n_lines))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["start"] + r["length"]))
    return F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length"))), lambda r: r["length"] > 0)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none", info_col: str = "line_dedup"
) -> DataFrame:
    """docs with its columns, the text without repeated lines, and a struct `info_col` (n_lines, n_dropped, keep_runs).

    A column of docs that has the name of info_col is replaced.

    A line is repeated when its key (white space stripped at both ends, A-Z in lower case) of at least min_chars code points is in
    at least min_docs documents. keep="none" drops all its lines; keep="first" leaves the first by id and position.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    dropped = dropped_lines(docs, id_col, text_col, min_docs, min_chars, keep)
    k1, k2 = row_keys(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2"))
    lines = split_lines(F.col("row")[text_col])
    gone = F.coalesce(F.col("gone"), F.array().cast("array<struct<start:int,length:int>>"))
    marked = rows.join(dropped.hint("shuffle_hash"), ["k1", "k2"], "left").select(
        "row", lines.alias("lines"), gone.alias("gone"), keep_runs(gone, F.size(lines)).alias("runs")
    )
    kept = F.when(F.size("gone") == 0, F.coalesce(F.col("row")[text_col], F.lit(""))).otherwise(
        F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("lines", r["start"] + 1, r["length"]))), "\n")
    )
    info = F.struct(
        F.size("lines").cast("long").alias("n_lines"), F.aggregate("gone", F.lit(0).cast("long"), lambda n, r: n + r["length"]).alias("n_dropped"), F.col("runs").alias("keep_runs")
    )
    return marked.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != info_col], info.alias(info_col))


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", sha_hex(F.col("text")).alias("kept_sha256"), "line_dedup.keep_runs"
    )
