"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from . import decontam, html_template, packing, periodic_runs, phrases, pii, piece_codec, quality_crf, quality_rules, secret_scan, simhash, suffix_dedup
from . import line_dedup as ld
from .common import table

#: The key of the registered query where the session sets none under KEY_SETTING. It is public, so it hides nothing: deployments set their own.
PUBLIC_KEY, KEY_SETTING = "public-test-key", "spark.pointloom.pii.key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymize(docs, spark.conf.get(KEY_SETTING, PUBLIC_KEY))
    return out.select("doc_id", "text", *[out.pii[k].alias(f"n_{k}") for k in pii.KINDS])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ld.digest(ld.line_dedup(docs, min_docs=10, min_chars=1, keep="none")).drop("keep_runs")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = piece_codec.round_trip(F.col("text"), public_tokenizers.path("piece_bpe_32k.model"))
    return docs.select("doc_id", done.alias("d")).select("doc_id", "d.*")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.digest(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=5)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, first=2000)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_line_dedup,
        op3_sentencepiece,
        op4_quality_classifier,
        op5_html_extraction,
        op6_simhash,
        op7_secret_scan,
        op8_suffix_dedup,
        op9_quality_rules,
        op10_decontamination,
        op11_packing,
        op12_phrases,
        op13_periodic_runs,
    )
}

OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM frequent) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Every 50-byte string, in hexadecimal; the union of those that a smaller id holds is cut out.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.least < w.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, run),
kept AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans),
found AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS front FROM kept JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(front || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN found USING (doc_id)
"""
#: Exact quantiles stand for the sketches, which are exact up to quality_rules.K documents a group.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p),
u AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) v(o) WHERE c.n > 1 GROUP BY doc_id),
b AS (SELECT d.doc_id, d.lang, d.source, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(u.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_caps
      FROM d JOIN w USING (doc_id) LEFT JOIN u USING (doc_id)),
s AS (SELECT *, CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word,
        CASE WHEN word_chars > 0 THEN n_caps / word_chars ELSE 0 END AS caps_share, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
q AS (SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, quantile_disc(symbol_share, [0.25, 0.75]) AS sy, quantile_disc(dup_line_share, [0.25, 0.75]) AS du,
        quantile_disc(repeat_share, [0.25, 0.75]) AS re, quantile_disc(mean_word, [0.25, 0.75]) AS me, quantile_disc(caps_share, [0.25, 0.75]) AS ca FROM s GROUP BY ROLLUP (lang, source)),
f AS (SELECT lang, source, level, n, {'sy': sy[2] + greatest(3.0 * (sy[2] - sy[1]), 0.05), 'du': du[2] + greatest(3.0 * (du[2] - du[1]), 0.30), 're': re[2] + greatest(3.0 * (re[2] - re[1]), 0.40),
        'me': me[2] + greatest(3.0 * (me[2] - me[1]), 2.0), 'ca': ca[2] + greatest(3.0 * (ca[2] - ca[1]), 0.25), 'lo': me[1] - greatest(3.0 * (me[2] - me[1]), 1.5)} AS f FROM q),
x AS (SELECT a.lang, a.source, CASE WHEN a.n >= 100 THEN a.f WHEN p.n >= 100 THEN p.f ELSE (SELECT f FROM f WHERE level = 3) END AS f
      FROM f a JOIN f p ON a.level = 0 AND p.level = 1 AND a.lang IS NOT DISTINCT FROM p.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (symbol_share <= f.sy AND dup_line_share <= f.du AND repeat_share <= f.re AND mean_word <= f.me AND caps_share <= f.ca AND mean_word >= f.lo) AS kept
FROM s JOIN x ON s.lang IS NOT DISTINCT FROM x.lang AND s.source IS NOT DISTINCT FROM x.source
"""

OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY lang, k, g HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
inner_ AS (SELECT lang, k, i, g[i : i + k - 2] AS part, a FROM f, (VALUES (1), (2)) v(i) WHERE k > 2),
longer AS (SELECT lang, part, max(a) AS longer FROM inner_ GROUP BY lang, part),
c AS (SELECT f.* FROM f LEFT JOIN longer ON f.lang = longer.lang AND f.g = longer.part WHERE k >= 2 AND (longer IS NULL OR 100 * longer < 100 * a)),
cuts AS (SELECT c.lang, c.g, c.a, cut, x.a AS l, y.a AS r FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : cut] JOIN f y ON y.lang = c.lang AND y.g = c.g[cut + 1 : c.k]),
scored AS (SELECT *, CAST((1000 * a::HUGEINT * n::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS BIGINT) AS score FROM cuts JOIN n USING (lang)),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS nth FROM scored),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best WHERE nth = 1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op12_phrases": OP12_SQL, "op2_line_dedup": OP2_SQL, "op8_suffix_dedup": OP8_SQL, "op9_quality_rules": OP9_SQL}
