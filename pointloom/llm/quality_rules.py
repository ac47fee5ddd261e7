"""Quality rules with adaptive thresholds, with DataFrame operations only.

Each document is measured once. Mergeable quantile sketches of the measures (KLL sketches of K items, exact for groups of up to K
documents) give, for each language and source, for each language and for the whole corpus, an upper and a lower fence outside the
quartiles; a group with too few documents takes its language's fences, or the corpus's. The fences are joined back and a document
is kept when every measure is inside them.

Sketches are merged in steps, so that no task gets one of every other task: those of a group by SALTS classes of input partitions, then
those; a language's from its sources' by SALTS classes of sources, then those; the corpus's from the languages' likewise.

Defined results: a null text has no words; null languages and sources form groups of their own; a document without words is
rejected by the base rules; repeated rows each count and each get their row; other columns are ignored; an id column with the name of
a result raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CLASS, cut

#: Measures with an adaptive upper fence, and the least width of that fence above the upper quartile.
UPPER_FENCES = {"symbol_share": 0.05, "dup_line_share": 0.30, "repeat_share": 0.40, "mean_word": 2.0, "caps_share": 0.25}
#: Measures with an adaptive lower fence, and its least width below the lower quartile.
LOWER_FENCES = {"mean_word": 1.5}
K, SALTS = 4096, 256
MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "mean_word", "caps_share")
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "passed", *MEASURES)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS + "+", -1), lambda w: w != "")


def trigram_hashes(words: Column) -> Column:
    n = F.size(words)
    grams = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, F.slice(grams, 1, n - 2)).otherwise(F.array().cast("array<bigint>"))


def equal_neighbours(placed: Column) -> Column:
    """Of sorted (hash, position), the positions whose hash occurs twice or more, in order."""
    n = F.size(placed)
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    around = F.zip_with(
        F.concat(none, F.slice(placed, 1, n - 1)), F.concat(F.slice(placed, 2, n - 1), none), lambda p, q: F.struct(p["h"].alias("p"), q["h"].alias("q"))
    )
    marked = F.zip_with(placed, around, lambda x, o: F.when((x["h"] == o["p"]) | (x["h"] == o["q"]), x["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def covered_words(starts: Column) -> Column:
    """How many words the 3-word windows at these positions cover: each adds 3, or less up to the next start."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)


def measure(docs: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    """(id, groups, base counts, measures) of each row, one scan of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = [F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)]
    base = docs.select(F.col(id_col).alias("id"), *groups, text.alias("t")).select("id", *[f"g{i}" for i in range(len(groups))], "t", words_of(F.col("t")).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = base.select(
        "*", F.size("w").alias("n"), lines.alias("lines"), trigram_hashes(F.col("w")).alias("grams")
    ).select(
        *[c for c in base.columns if c not in ("t", "w")],
        F.col("n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", WHITE_CLASS + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).alias("n_caps"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ).alias("placed"),
    )
    counted = hashed.withColumn("starts", equal_neighbours(F.col("placed"))).withColumn(
        "n_repeat_words", F.coalesce(covered_words(F.col("starts")), F.lit(0)).cast("long")
    ).drop("placed", "starts")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counted.select(
        "id", *[f"g{i}" for i in range(len(groups))], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("word_chars", "n_words").alias("mean_word"),
        share("n_caps", "word_chars").alias("caps_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def merged(rows: DataFrame, keys: list[str], salt: Column) -> DataFrame:
    """One row of sketches for each value of the keys, of rows (..., n, a sketch for each measure); by classes of `salt` first."""
    both = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, K).alias(m) for m in MEASURES]]
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS))).groupBy(*keys, "salt").agg(*both).groupBy(*keys).agg(*both)


def fence(spread: float) -> Column:
    """Fences around the quartiles of a row's sketches; null where it counts nothing."""
    q1, q3 = (lambda m: F.kll_sketch_get_quantile_double(m, F.lit(0.25))), (lambda m: F.kll_sketch_get_quantile_double(m, F.lit(0.75)))
    width = lambda m, least: F.greatest(spread * (q3(m) - q1(m)), F.lit(least))
    ups = [(q3(m) + width(m, least)).alias(f"hi_{m}") for m, least in UPPER_FENCES.items()]
    downs = [(q1(m) - width(m, least)).alias(f"lo_{m}") for m, least in LOWER_FENCES.items()]
    return F.when(F.col("n") > 0, F.struct(*ups, *downs))


def fences(measured: DataFrame, n_groups: int, min_group: int, spread: float) -> DataFrame:
    """A fence row for each full group: its own, its first group column's, or the corpus's, by how many documents each has."""
    keys = [f"g{i}" for i in range(n_groups)]
    parted = measured.select(*keys, *MEASURES, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    parts = parted.groupBy(*keys, "salt").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, K).alias(m) for m in MEASURES])
    own = cut(parts.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, K).alias(m) for m in MEASURES]))
    first = cut(merged(own, ["g0"], F.xxhash64(*keys)))
    corpus = merged(first, [], F.xxhash64("g0")).select(fence(spread).alias("fence")).first()["fence"]
    whole = F.struct(*[F.lit(v).cast("double").alias(k) for k, v in corpus.asDict().items()]) if corpus else F.col("fence")
    first = first.select(F.col("g0").alias("p0"), F.col("n").alias("pn"), fence(spread).alias("pf"))
    return own.select(*keys, "n", fence(spread).alias("fence")).join(first, F.col("g0").eqNullSafe(F.col("p0")), "left").select(
        *[F.col(k).alias(f"f{k}") for k in keys],
        F.when(F.col("n") >= min_group, F.col("fence")).when(F.col("pn") >= min_group, F.col("pf")).otherwise(whole).alias("fence"),
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"),
    min_group: int = 100, spread: float = 3.0,
) -> DataFrame:
    """(id_col, base counts, measures, base_failed, passed, kept) for each row of docs.

    A group of fewer than min_group documents is judged by wider ones; spread is the fence's distance from the quartiles in
    interquartile ranges, never less than the widths in UPPER_FENCES and LOWER_FENCES.
    """
    if not 1 <= len(group_cols) <= 2:
        raise ValueError("one or two grouping columns")
    if id_col in RESULTS:
        raise ValueError(f"the id column has the name of a result: {id_col}")
    measured = cut(measure(docs, id_col, text_col, list(group_cols)))
    limits = fences(measured, len(group_cols), min_group, spread)
    same = [F.col(f"g{i}").eqNullSafe(F.col(f"fg{i}")) for i in range(len(group_cols))]
    inside = F.lit(True)
    for m in UPPER_FENCES:
        inside = inside & (F.col(m) <= F.col(f"fence.hi_{m}"))
    for m in LOWER_FENCES:
        inside = inside & (F.col(m) >= F.col(f"fence.lo_{m}"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    passed = F.coalesce(inside, F.lit(False))
    return measured.join(limits, on, "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & passed).alias("kept"), passed.alias("passed"), "symbol_share", "dup_line_share", "repeat_share", "mean_word", "caps_share",
    )
