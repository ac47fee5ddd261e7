"""Each stage of the pipeline, on its own input, and the whole of it against brute force."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_corpus_operators import edited, jaccard, least_of_similar
from test_model_operators import brute_pairs

from pointloom.llm import quality_crf

pipeline = pytest.importorskip("corpus_pipeline")
WHITE = " \t\n\x0b\x0c\r"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def good(spark, sf_dir, rows):
    """Each text scored by itself, with the model that the stage trains."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return [(i, t) for i, t in rows if quality_crf.score_texts([t], model)[0] >= 0.7]


def without_lines(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WHITE).translate(fold)
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = {k for k, ids in held.items() if k and len(ids) >= 10}
    return [(i, "\n".join(x for x in (t or "").split("\n") if key(x) not in gone)) for i, t in rows]


def one_of_each(rows):
    """Of each group the smallest id, null last; among its rows with other texts, any one; all of those with its text."""
    least = least_of_similar([t or "" for _, t in rows])
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[least[k]].append((i is None, i or 0, t))
    return [(min(g)[:2], {t for *i, t in g if tuple(i) == min(g)[:2]}) for g in groups.values()]


def no_leaks(spark, sf_dir, rows):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = {d for d, _, _ in brute_pairs(dict(enumerate(t for _, t in rows)), items, 5, 0.8, 5)}
    return [x for k, x in enumerate(rows) if k not in found]


def encoded(rows):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(i, LIBRARY.encode(t or "")) for i, t in rows]
    return [(i, len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x)), x) for i, x in ids]


def pairs(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()), key=str)


@pytest.fixture(scope="module")
def odd_docs(spark, sf_dir):
    """The documents with texts around the similarity, repeated, null, empty and long ones, and columns whose names clash."""
    rng = random.Random(41)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = sorted({w for r in docs.limit(40).collect() for w in r["text"].split()})
    word = lambda: rng.choice(words)
    rows, at = [], 10**6
    for edits in [*range(1, 9)] * 3:
        base = [word() for _ in range(120)]
        for t in (base, edited(rng, word, base, edits)):
            rows.append((at, " ".join(t)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n"), (None, "no id here"), (at + 3, "short"), (at + 3, "short"), (at + 4, " ".join(word() for _ in range(30_000)))]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    both = docs.unionByName(more)
    for c in ("k1", "k2", "row", "fp", "first", "lines", "gone", "line_dedup", "id", "score", "d"):
        both = both.withColumn(c, F.lit(f"mine-{c}"))
    return both


def test_each_stage_matches_brute_force(spark, sf_dir, odd_docs):
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    docs = odd_docs
    mine = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]

    def apply(name):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns and out.where(" OR ".join(f"{c} != 'mine-{c}'" for c in mine)).count() == 0
        return spark.createDataFrame(out.collect(), docs.schema)

    before = pairs(docs)
    kept = apply("quality_classifier")
    assert pairs(kept) == sorted(good(spark, sf_dir, before), key=str)
    # The odd rows go on whatever their quality.
    before = pairs(docs)
    docs = apply("line_dedup")
    assert pairs(docs) == sorted(without_lines(before), key=str) and docs.where("n_chars != length(text)").count() == 0
    before = pairs(docs)
    said = dict(before)
    close = [jaccard(said[10**6 + k], said[10**6 + k + 1]) for k in range(0, 48, 2)]
    assert any(0.7 < s < 0.8 for s in close) and any(0.8 <= s < 0.9 for s in close)
    docs = apply("near_dedup")
    after, expected = collections.Counter((i is None, i or 0) for i, _ in pairs(docs)), one_of_each(before)
    assert set(after) == {i for i, _ in expected} and all(t in ts for i, ts in expected for j, t in pairs(docs) if (j is None, j or 0) == i)
    before = pairs(docs)
    docs = apply("decontamination")
    assert pairs(docs) == sorted(no_leaks(spark, sf_dir, before), key=str) and len(pairs(docs)) < len(before)
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"])) for r in stages["sentencepiece"](spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted(encoded(pairs(docs)), key=str)


def test_stages_of_no_documents(spark, sf_dir, odd_docs):
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd_docs.limit(0), sf_dir)
        assert out.count() == 0 and (name == "sentencepiece" or out.columns == odd_docs.columns)


def test_run_matches_brute_force(spark, sf_dir):
    rows = pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = without_lines(good(spark, sf_dir, rows))
    groups = {i: ts for (_, i), ts in one_of_each(rows)}
    rows = no_leaks(spark, sf_dir, [(i, t) for i, t in rows if i in groups and t in groups[i]])
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], list(r["ids"])) for r in pipeline.run(spark, sf_dir).collect()]
    assert sorted(got) == sorted(encoded(rows)) and 0 < len(got)
