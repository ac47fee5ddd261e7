"""The SentencePiece codec, the line classifier and decontamination."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pointloom.llm import decontam, piece_codec, quality_crf, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(piece_codec.model_bytes(PATH))


def test_codec_equals_library_on_documents(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op3_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_codec_on_random_texts(library, codec):
    rng = random.Random(1)
    parts = [*"aaabethin   \n\t▁éñßŻ中文字😀.,0123=-<>/s", "</s>", "<unk>", "<0x41>", "the ", "ing", "  ", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 20, 150]))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 2000, "ab" * 2000, "=" * 900 + " " * 77 + "x" * 999, "the" * 3000, " ", " a", "a ", ""]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text)
    assert codec.decode(codec.encode(texts)) == [library.decode(library.encode(t)) for t in texts]


def test_decoder_on_random_ids(library, codec):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.choice([1, 2, 3, 8]))]
        assert codec.decode([ids])[0] == library.decode(ids)


def test_codec_forgets_and_cuts(library, codec, monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT_WORDS", 50)
    monkeypatch.setattr(piece_codec, "CHUNK", 200)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(6)) for _ in range(n)) for n in (10, 100, 1, 400, 5)]
    small = piece_codec.Codec(piece_codec.model_bytes(PATH))
    for _ in range(3):
        assert [i.tolist() for i in small.encode([*texts, None, ""])] == [*(library.encode(t) for t in texts), [], []]


def test_codec_columns(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (2, "a b"), (None, "é" * 9)], "doc_id long, text string")
    ids = d.select("*", piece_codec.encode_column(F.col("text"), PATH).alias("ids"))
    back = ids.select("text", piece_codec.decode_column(F.col("ids"), PATH).alias("back")).collect()
    assert [r["back"] for r in back] == [r["text"] or "" for r in back]
    assert d.limit(0).select(piece_codec.round_trip(F.col("text"), PATH)).count() == 0


def test_codec_beside_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a b", "mine", 1), (2, None, None, None), (2, "x" * 20_000 + " y", "z", 2)], "doc_id long, text string, ids_sha256 string, d int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op3_sentencepiece(spark, str(tmp_path)).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(LIBRARY.encode(t)) for t in ("a b", "", "x" * 20_000 + " y"))
    assert [r["doc_id"] for r in rows].count(None) == 1


def test_only_such_models():
    with pytest.raises(ValueError):
        piece_codec.PieceModel(b"")


def test_classifier_on_held_out_documents(spark, sf_dir):
    out = queries.op4_quality_classifier(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 5 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_classifier_edge_cases(spark):
    schema = "doc_id long, text string, score string"
    d = spark.createDataFrame([(None, None, "s"), (1, "", "s"), (1, "", "s"), (2, "x" * 100_000, "s"), (3, "\n" * 5000, "s")], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_crf.classify(d, labels).collect()} == {0.5}
    assert quality_crf.classify(d.limit(0), labels).count() == 0
    chain = quality_crf.Chain(np.linspace(-1, 1, quality_crf.features(*quality_crf.line_measures(["a"])[:2]).shape[1]), np.zeros((2, 2)))
    got = [quality_crf.score_texts([t], chain)[0] for t in (None, "", "a\nb", "a" * 10)]
    assert got[0] == got[1] and all(0 <= g <= 1 for g in got)


def test_classifier_trains_on_one_row_of_an_id(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    once = quality_crf.fit(docs, labels)
    copied = docs.unionByName(docs.join(labels.select("doc_id"), "doc_id", "left_semi").select(docs.columns))
    again = quality_crf.fit(copied, labels)
    assert (once.weights == again.weights).all() and (once.moves == again.moves).all()
    assert quality_crf.fit(docs, labels, max_lines=0) == 0.5 and isinstance(quality_crf.fit(docs, labels, max_docs=20), (quality_crf.Chain, float))


def plain_line(line):
    """The features of a line by itself, from their definitions, by character and word."""
    data = line.encode()
    tail = sum(0x80 <= c < 0xC0 for c in data)
    chars = len(data) - tail
    count = lambda members: sum(c in members for c in data)
    words = line.split()
    n, space = max(len(words), 1), count(b" \t\x0b\x0c\r")
    solid = max(chars - space, 1)
    m = {
        "symbol": count(quality_crf.SYMBOLS) / solid, "bar": count(b"|") / n, "upper": sum(65 <= c <= 90 for c in data) / solid, "shout": count(b"!?") / n,
        "digit": sum(48 <= c <= 57 for c in data) / solid, "stop": count(b".,;:") / n, "distinct": len(set(words)) / n if words else 1.0,
        "again": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, "mean": (chars - space) / n,
        "foreign": sum(c >= 0xC0 for c in data) / solid, "length": np.log(1 + chars),
    }
    out = [1.0]
    for k, steps in quality_crf.STEPS.items():
        value = np.float32(m[k])
        out += [min(value, np.float32(steps[-1])) / np.float32(steps[-1]), *[float(value > np.float32(s)) for s in steps]]
    return out


def plain_score(text, chain):
    """One document: probabilities of its lines' labels by sums in logarithms, forth and back."""
    lines = (text or "").split("\n")
    own = [plain_line(x) for x in lines]
    none = [0.0] * len(own[0])
    n = len(lines)
    weight = lambda i: np.dot([*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < n else none), float(i == 0), float(i == n - 1)], chain.weights)
    said = [(0.0, float(np.clip(weight(i), -30, 30))) for i in range(n)]
    ahead, behind = [said[0]], [(0.0, 0.0)]
    for i in range(1, n):
        ahead.append(tuple(said[i][b] + np.logaddexp(*[ahead[-1][a] + chain.moves[a, b] for a in (0, 1)]) for b in (0, 1)))
    for i in range(n - 2, -1, -1):
        behind.insert(0, tuple(np.logaddexp(*[chain.moves[a, b] + said[i + 1][b] + behind[0][b] for b in (0, 1)]) for a in (0, 1)))
    both = [np.add(x, y) for x, y in zip(ahead, behind, strict=True)]
    good = [np.exp(b - np.logaddexp(a, b)) for a, b in both]
    size = [len(x.encode()) + 1 for x in lines]
    return np.dot(good, size) / sum(size)


def test_classifier_query_matches_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    chain = quality_crf.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in queries.op4_quality_classifier(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        assert got[doc_id] == pytest.approx(plain_score(text, chain), abs=1e-6), doc_id


def test_training_sums_equal_products_and_slopes(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("aB1. |\n!é"), rng.integers(0, 60))) for _ in range(40)]
    measures, n_lines, _ = quality_crf.line_measures(texts)
    x = quality_crf.features(measures, n_lines)
    monkeypatch.setattr(quality_crf, "BLOCK", 7)
    lines = quality_crf.Lines(measures, n_lines)
    weights, values = rng.normal(size=x.shape[1]), rng.normal(size=len(x))
    np.testing.assert_allclose(lines.times(weights), x @ weights, atol=1e-9)
    np.testing.assert_allclose(lines.sums(values), values @ x, atol=1e-9)
    # One step of training moves each weight along the slope of the likelihood, taken here by differences.
    labels = np.arange(40) % 2

    def likelihood(w, moves):
        total, at = 0.0, 0
        for n, y in zip(n_lines.tolist(), labels.tolist(), strict=True):
            said = x[at : at + n] @ w
            ahead = np.array([0.0, said[0]])
            for i in range(1, n):
                ahead = np.array([0.0, said[i]]) + [np.logaddexp(*(ahead + moves[:, b])) for b in (0, 1)]
            total += y * said.sum() + (n - 1) * moves[y, y] - np.logaddexp(*ahead)
            at += n
        return total / len(labels)

    zero, still, step = np.zeros(x.shape[1]), np.zeros((2, 2)), 1e-5
    once = quality_crf.train(measures, n_lines, labels, rounds=1, rate=1.0, decay=0.0)
    for k in range(x.shape[1]):
        d = np.eye(1, x.shape[1], k)[0] * step
        slope = (likelihood(zero + d, still) - likelihood(zero - d, still)) / (2 * step)
        assert once.weights[k] == pytest.approx(slope / (abs(slope) + 1e-8), abs=1e-3) or abs(slope) < 1e-6
    for a in (0, 1):
        for b in (0, 1):
            d = np.zeros((2, 2))
            d[a, b] = step
            slope = (likelihood(zero, d) - likelihood(zero, -d)) / (2 * step)
            assert once.moves[a, b] == pytest.approx(slope / (abs(slope) + 1e-8), abs=1e-3)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    emit, moves, sizes = rng.lognormal(size=9), rng.normal(size=(2, 2)), np.array([4, 1, 3, 1])
    _, _, good = quality_crf.forward_backward(emit, sizes, moves)
    at = 0
    for n in sizes.tolist():
        weights = {}
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            w = np.prod([emit[at + i] if y[i] else 1 for i in range(n)]) * np.exp(sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            weights[tuple(y)] = w
        total = sum(weights.values())
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(w for y, w in weights.items() if y[i]) / total)
        at += n


def brute_tiles(doc, item, shortest):
    """Greedy string tiling from its definition."""
    used_d, used_i, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best, found = shortest - 1, []
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and not used_d[d + n] and not used_i[i + n]:
                    n += 1
                if n > best:
                    best, found = n, [(d, i)]
                elif n == best and n >= shortest:
                    found.append((d, i))
        if not found or best < shortest:
            return covered
        for d, i in found:
            if not any(used_d[d : d + best]) and not any(used_i[i : i + best]):
                used_d[d : d + best] = used_i[i : i + best] = [True] * best
                covered += best


def test_tiling_equals_definition():
    rng = random.Random(7)
    for _ in range(300):
        doc, item = ([rng.randrange(4) for _ in range(rng.randrange(1, 26))] for _ in range(2))
        n = rng.randrange(1, 5)
        assert sum(t[2] for t in decontam.greedy_tiles(np.array(doc), np.array(item), n)) == brute_tiles(doc, item, n) == table_tiles(doc, item, n)


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


def test_decontamination(spark):
    w = ITEM.split()
    texts = [
        "intro " + ITEM + " outro", " ".join(w[10:] + ["x"] + w[:10]), " ".join(w[:10]), ITEM.upper().replace(" ", ",\n"), None, "", "one two three", "short item", " ".join(w[:9] + ["a"] + w[10:])
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(1, ITEM), (2, "short item"), (3, None), (4, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.contaminated(d, bench).collect()}
    assert set(found) == {(0, 1), (1, 1), (3, 1), (7, 2), (8, 1)} and found[0, 1] == found[1, 1] == 1.0 and found[8, 1] == 0.95
    kept = decontam.without_contaminated(d, bench)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {2, 4, 5, 6}
    assert decontam.contaminated(d, bench.limit(0)).count() == 0 and decontam.contaminated(d.limit(0), bench).count() == 0
    many = decontam.BLOCK_BYTES
    decontam.BLOCK_BYTES = 1
    try:
        assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, bench).collect()} == set(found)
    finally:
        decontam.BLOCK_BYTES = many


def table_tiles(doc, item, shortest):
    """The definition again, by a table of how far the tokens from each pair of places on are equal and unmarked."""
    names = {t: k for k, t in enumerate({*doc, *item})}
    same = np.array([names[t] for t in doc])[:, None] == np.array([names[t] for t in item])
    covered = 0
    while True:
        run = np.zeros((len(doc) + 1, len(item) + 1), int)
        for i in range(len(item) - 1, -1, -1):
            run[:-1, i] = (run[1:, i + 1] + 1) * same[:, i]
        best = run.max()
        if best < shortest:
            return covered
        for d, i in np.argwhere(run == best):
            if run[d, i] == best and same[range(d, d + best), range(i, i + best)].all():
                same[d : d + best] = False
                same[:, i : i + best] = False
                covered += int(best)


def brute_pairs(texts, items, seed, coverage, least):
    """(document, item, covered tokens) by the definition, with the same words for tokens."""
    words = {i: re.findall(r"[^\W_]+", (x or "").lower()) for i, x in items.items()}
    out = set()
    for d, text in texts.items():
        doc = re.findall(r"[^\W_]+", (text or "").lower())
        grams = {tuple(doc[k : k + n]) for n in range(1, seed + 1) for k in range(len(doc) - n + 1)}
        for i, item in words.items():
            n = min(seed, len(item))
            if len(item) >= max(least, 1) and any(tuple(item[k : k + n]) in grams for k in range(len(item) - n + 1)):
                covered = table_tiles(doc, item, n)
                if covered >= coverage * len(item) and covered:
                    out.add((d, i, covered))
    return out


def test_decontamination_query_matches_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"], r["n_covered"]) for r in queries.op10_decontamination(spark, sf_dir).collect()}
    assert got and got == brute_pairs(texts, items, 5, 0.8, 5)


@pytest.mark.parametrize(("block", "scan"), [(1, 1), (1, 3), (8 << 20, 4)])
def test_decontamination_of_random_texts_matches_brute_force(spark, monkeypatch, block, scan):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "SCAN_BLOCKS", scan)
    rng = random.Random(31)
    some = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = {k: some(rng.randrange(1, 14)) for k in range(7)} | {7: "a a a a a a a a", 8: "", 9: None, 10: "a"}
    texts = {k: some(rng.randrange(50)) for k in range(40)} | {40: "a " * 60, 41: None, 42: "", 43: items[3], 44: items[3]}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("k1", F.lit("clash")).withColumn("row", F.lit(1))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = brute_pairs(texts, items, 3, 0.7, 4)
    got = {(r["doc_id"], r["item_id"], r["n_covered"]) for r in decontam.contaminated(d, bench, seed=3, coverage=0.7, least=4).collect()}
    assert got == expected
    kept = decontam.without_contaminated(d, bench, seed=3, coverage=0.7, least=4)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(texts) - {x for x, _, _ in expected})


def test_tiling_of_repetitive_texts_takes_linear_time():
    assert decontam.greedy_tiles(np.ones(30_000, int), np.ones(30_000, int), 5) == [(0, 0, 30_000)]
    assert sum(t[2] for t in decontam.greedy_tiles(np.ones(200_000, int), np.ones(999, int), 5)) == 999


def test_leaks_of_the_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert whole <= {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, sf_dir).collect()}
