"""Packing, collocations and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from pointloom.llm import packing, periodic_runs, phrases, queries

BPE = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


def check_packed(rows, texts, capacity):
    """rows: tuples of (doc, start, length, crc, doc tokens, sequence, offset); texts: {doc: text}. Every id is in one piece, sequences have no gaps."""
    ids = dict(zip(texts, [[*i, 0] for i in library_ids([t or "" for t in texts.values()])], strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in rows:
        assert length > 0 and total == len(ids[doc])
        assert crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
        pieces[doc].append((start, length))
        sequences[sequence].append((offset, length))
    for found, sizes in ((pieces, {d: len(i) for d, i in ids.items()}), (sequences, None)):
        for key, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == sizes[key] if sizes else at <= capacity
    assert set(pieces) == set(texts)
    filled = [sum(n for _, n in s) for s in sequences.values()]
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in filled) / sum(filled)


def test_packing_of_all_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_packed([tuple(r) for r in queries.op11_packing(spark, sf_dir).collect()], texts, 1024) < 0.004


@pytest.mark.parametrize(("capacity", "slack"), [(1, 0), (7, 0), (16, 0), (64, 2), (1000, 3)])
def test_packing_classes(capacity, slack):
    rng = random.Random(capacity)
    kinds = packing.classes(capacity, slack)
    assert all(size * k <= capacity and (capacity - size * k <= slack or size == 1) for size, k in kinds) and kinds[-1][0] == 1
    packer, rows, sizes = packing.Packer(capacity, slack), [], {d: rng.randrange(1, 3 * capacity + 2) for d in range(200)}
    for d, n in sizes.items():
        rows += packer.add(d, bytes(4 * n))
    rows += packer.finish()
    filled, tokens = Counter(), Counter()
    for doc, _, length, _, _, sequence, _ in rows:
        filled[sequence] += length
        tokens[doc] += length
    assert tokens == sizes
    if slack == 0 and capacity & (capacity - 1) == 0:
        assert all(n & (n - 1) == 0 for n in filled.values())
    assert all(capacity - n <= slack or n & (n - 1) == 0 or n == capacity // 1 for n in filled.values())


def test_packing_of_odd_texts(spark):
    odd = "".join(chr(c) for c in range(0x530)) + " a<|endoftext|>b 漢字 ﬁ  x  y  \n\n z's 'll"
    rows = [(1, None, "x"), (2, "", "x"), (3, odd, None), (4, "word " * 5000, "y"), (5, "\x1c \x1d\t 12½ ²x", "z"), (6, "a" * 300 + " " * 300, "z")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), BPE)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_packed([tuple(r) for r in out.collect()], {r[0]: r[1] for r in rows}, 1024)
    twice = packing.pack(spark.createDataFrame([(7, "same"), (7, "same"), (None, "same")], "doc_id long, text string"), BPE).collect()
    assert sorted((r.doc_id is None, r.start, r.length) for r in twice if r.start == 0)[0][1] == 0 and sum(r.length for r in twice) == 3 * len(library_ids(["same"])[0]) + 3
    assert packing.pack(spark.createDataFrame([], "doc_id string, text string"), BPE).count() == 0


def test_words_of_each_character_follow_the_library():
    encoder = packing.Encoder(BPE)
    texts = [f"a{c}b {c}{c} 1{c}1\n{c}" for c in map(chr, [*range(1, 0x530), *range(0x2000, 0x20D0)])]
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == library_ids(texts)


def brute_phrases(rows, least, longest, first, percent=100):
    counts, total = defaultdict(Counter), Counter()
    small = {c: c + 32 for c in range(65, 91)}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(small)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang or "und"] += len(w)
            for n in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + n] for g, a in found.items() for n in range(2, len(g)) for i in range(len(g) - n + 1) if 100 * a >= percent * f[g[i : i + n]]}
        scored = []
        for g in found.keys() - gone:
            score, k = min((1000 * f[g] * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -f[g], " ".join(g).encode(), f[g], f[g[:k]], f[g[k:]], score))
        out += [(lang, i, p.decode(), a, left, right, total[lang], s) for i, (_, _, p, a, left, right, s) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "first", "percent"), [(2, 5, 2000, 100), (3, 4, 7, 60), (1, 2, 50, 100)])
def test_phrases_match_brute_force(spark, monkeypatch, least, longest, first, percent):
    rng = random.Random(least)
    words = ["a", "B", "the", "\x1c", "naïve", " ", "x\x00y", "日本"]
    rows = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ";"]) for _ in range(rng.randrange(60)))) for _ in range(80)]
    rows += [("de", None), ("de", ""), ("de", " .,"), ("en", "say it again " * 40), ("en", "say it again " * 40)]
    frame = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, n long").repartition(3)
    got = phrases.collocations(frame, least=least, longest=longest, first=first, percent=percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, longest, first, percent)


def test_phrases_of_many_shards_and_of_none(spark):
    texts = [f"{w} of the {w} and of the other" for w in ("one", "two", "three") for _ in range(30)]
    frame = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(15)
    assert sorted(map(tuple, phrases.collocations(frame, least=20, longest=5, first=100).collect())) == brute_phrases([("en", t) for t in texts], 20, 5, 100)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_counts_of_a_shard_are_those_of_its_intervals():
    rng = random.Random(3)
    ids = np.array([rng.randrange(-1, 4) for _ in range(400)], np.int32)
    ids = ids[(ids >= 0) | np.append(True, ids[:-1] >= 0)]
    places, names = np.arange(4), np.arange(4)
    f = {(i,): i for i in range(4)}
    for n in range(2, 6):
        brute = Counter(tuple(ids[i : i + n].tolist()) for i in range(len(ids) - n + 1) if (ids[i : i + n] >= 0).all())
        at, p, s, counts = phrases.phrase_counts(ids, n, places, names)
        grams = [tuple(ids[i : i + n].tolist()) for i in at.tolist()]
        assert dict(zip(grams, counts.tolist(), strict=True)) == brute
        assert [f[g[:-1]] for g in grams] == p.tolist() and [f[g[1:]] for g in grams] == s.tolist()
        places, names, f = at, np.arange(len(at)) + 100, {g: i + 100 for i, g in enumerate(grams)}


def test_counts_of_a_shard_travel_in_few_bytes():
    """Compressed as the shuffle does it; arrays of whole names took 12.6 bytes a phrase here, packed rows take 7.8."""
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 200_000), 20_000).astype(np.int32) - 1
    ids[::9] = -1
    words = int(ids.max()) + 1
    names = (rng.integers(0, 4, words) << phrases.PLACE) + rng.permutation(words)
    told = [pa.array([list(range(words))], pa.list_(pa.int64())), pa.array([names.tolist()], pa.list_(pa.int64()))]
    shard = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([zstandard.compress(ids.tobytes())], pa.binary()), *told], names=["shard", "ids", "places", "names"])
    sent = list(phrases._phrases(2, 200)(iter([shard])))
    n = len(phrases.phrase_counts(ids, 2, np.arange(words), names)[0])
    size = sum(len(pa.compress(b, "lz4", asbytes=True)) for r in sent for c in r.columns for b in c.buffers() if b)
    assert n > 30_000 and size < 9 * n, (n, size / n)


def test_packed_rows_are_read_back():
    rng = np.random.default_rng(1)
    for sizes in map(np.array, ([3, 1, 5], [2, 0, 4], [0], np.zeros(0, int))):
        n = int(sizes.sum())
        lead = np.concatenate([np.zeros(0, np.int64), *[np.sort(rng.integers(0, 1 << 62, k)) for k in sizes]])
        columns = (lead, rng.integers(0, 1 << 62, n), rng.integers(0, 1 << 28, n), rng.integers(1, 1 << 28, n))
        rows = phrases.pack(columns, phrases.COUNTS, sizes)
        got, lengths = phrases.unpack(rows, phrases.COUNTS)
        assert [g.tolist() for g in got] == [c.tolist() for c in columns] and lengths.tolist() == sizes.tolist()
        got, lengths = phrases.unpack(rows[1:], phrases.COUNTS)
        assert [g.tolist() for g in got] == [c[sizes[:1].sum() :].tolist() for c in columns] and lengths.tolist() == sizes[1:].tolist()


def brute_runs(w, least):
    """Stretches of each period by definition, smallest period first."""
    ids = np.unique(np.array(w, object), return_inverse=True)[1] if w else np.zeros(0, int)
    found = {}
    for p in range(1, len(w) // 2 + 1):
        same = np.concatenate([[0], (ids[p:] == ids[:-p]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + p >= max(least, 2 * p):
                found.setdefault((a, b - a + p), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            w = [b"%d" % rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(70))]
            if w and rng.random() < 0.5:
                a = rng.randrange(len(w))
                p = 1 + rng.randrange(len(w) - a)
                w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
            docs.append(w)
        for least in (2, 5, 12):
            assert periodic_runs.runs_of(docs, least) == [brute_runs(w, least) for w in docs]


def test_runs_of_words_with_many_runs(monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE", 50)
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert periodic_runs.runs_of([b, [b"a"] * 500, b], 2) == [brute_runs(b, 2), [(0, 500, 1)], brute_runs(b, 2)]
    nested = (([b"x"] * 14 + [b"y"]) * 13 + [b"z"]) * 3
    assert periodic_runs.runs_of([nested], 12) == [brute_runs(nested, 12)]


def test_periodic_runs_of_all_documents(spark, sf_dir):
    got = {r["doc_id"]: r.asDict() for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if x]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(w, 12)
        best = min(((-size, s, p) for s, size, p in runs), default=None)
        gone = {i for s, size, p in runs for i in range(s + p, s + size)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[r["doc_id"]] == {
            "doc_id": r["doc_id"], "n_runs": len(runs), "start": best and best[1], "length": best and -best[0], "period": best and best[2],
            "exponent_milli": best and 1000 * -best[0] // best[2], "runs_sha256": sha("".join(f"{s},{size},{p}\n" for s, size, p in runs)),
            "collapsed_sha256": sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
        }


def test_periodic_runs_of_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a b " * 9, 5), (None, "a b " * 9, 5), (4, "  x\x1cy " * 12, 6)]
    out = periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs long"))
    assert out.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    assert got == [(0, 18, [(0, 18, 2)], "a b")] * 2 + [(1, 0, [], ""), (2, 0, [], ""), (4, 24, [(0, 24, 2)], "  x\x1cy")]
    assert periodic_runs.digest(spark.createDataFrame(rows, "doc_id long, text string, runs long")).count() == 5
    assert periodic_runs.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
