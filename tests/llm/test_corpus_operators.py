"""Near copies, substring dedup, page extraction and the pipeline against brute force."""

import hashlib
import html
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pointloom.llm import common, html_template, queries, simhash, suffix_dedup


def fingerprint(text, shingle=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """Smallest id of each id's component; linked(i, j) over positions."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_simhash_matches_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, sf_dir).collect()}
    ids = sorted(texts)
    fp = [fingerprint(texts[i]) for i in ids]
    least = components(ids, lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 2)
    assert got == {i: (f"{f:016x}", least[i]) for i, f in zip(ids, fp, strict=True)}


@pytest.mark.parametrize("tile", [7, 2048])
def test_links_connect_all_near_fingerprints(spark, tile):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(12)} | {0, 1, 2**64 - 1}
    fps = sorted({f & (1 << 64) - 1 for f in fps})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    d = spark.createDataFrame([(s,) for s in signed], "fp long").withColumn("keys", simhash.bands(F.col("fp"), 2))
    d = d.withColumn("level", (F.bit_count("fp") / 2).cast("int"))
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(d, 2, tile)).collect()}
    expected = components(signed, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert {s: got.get(s, s) for s in signed} == expected


def test_components_of_long_chains(spark):
    rng = random.Random(6)
    n = 150
    names = rng.sample(range(1000), n)
    edges = [(max(a, b), min(a, b)) for a, b in zip(names, names[1:], strict=False)][: n - 20]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    expected = components(names, lambda i, j: abs(i - j) == 1 and min(i, j) < n - 20)
    assert {x: got.get(x, x) for x in names} == expected


def test_simhash_edge_cases(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (5, "same text here now"), (4, "same text here now"), (4, "same text here now"), (None, "alone at last"), (9, "one")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("keys", F.lit(0))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (2, 1), (5, 4), (4, 4), (4, 4), (None, None), (9, 9)], key=str)
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def jaccard(a, b, n=5):
    grams = lambda t: {tuple(t.lower().split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_one_of_each_group_of_similar_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, group = [], []
    for g in range(40):
        base = [word() for _ in range(rng.randrange(120, 400))]
        for k in range(rng.randrange(1, 5)):
            copy = list(base)
            if k:
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            group.append(g)
    assert all(jaccard(texts[i], texts[j]) > 0.85 for i in range(len(texts)) for j in range(i) if group[i] == group[j])
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, first string")
    kept = simhash.one_of_each(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [group.index(g) for g in range(40)]


def edited(rng, word, base, edits):
    copy = list(base)
    for k in rng.sample(range(len(copy)), edits):
        copy[k] = word()
    return copy


def least_of_similar(texts, n=5):
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in words]
    return components(range(len(texts)), lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))


def kept_ids(spark, texts):
    return sorted(r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def test_one_of_each_keeps_pairs_below_the_similarity(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for edits in [*range(2, 16)] * 5:
        base = [word() for _ in range(200)]
        texts += [" ".join(base), " ".join(edited(rng, word, base, edits))]
    similar = [jaccard(texts[k], texts[k + 1]) for k in range(0, len(texts), 2)]
    assert sum(0.7 < s < 0.8 for s in similar) > 5 and sum(0.8 <= s < 0.85 for s in similar) > 5
    least = least_of_similar(texts)
    assert kept_ids(spark, texts) == sorted(set(least.values()))


def test_one_of_each_of_repeated_passages_and_short_texts(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for times in (5, 10) * 5:
        base, passage = [word() for _ in range(300)], [word() for _ in range(30)]
        texts += [" ".join(base + passage), " ".join(base + passage * times)]
    for _ in range(40):
        short = [word() for _ in range(8)]
        texts += [" ".join(short), " ".join([*short, word()])]
    assert all(jaccard(texts[k], texts[k + 1]) >= 0.8 for k in range(0, len(texts), 2))
    assert kept_ids(spark, texts) == list(range(0, len(texts), 2))


@pytest.mark.parametrize(("tile", "shingles"), [(3, 1 << 20), (1 << 20, 700), (1 << 20, 1 << 20)])
def test_similar_documents_by_any_tiles(spark, tile, shingles):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    texts = [" ".join(edited(rng, word, base, rng.randrange(12))) for _ in range(60)]
    texts += [" ".join(base[: rng.randrange(90, 151)]) for _ in range(30)] + [" ".join(base * k) for k in (1, 2, 3)]
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(5, 60))]) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["first"]["id"] for r in simhash.similar_documents(d, tile=tile, shingles=shingles).collect()}
    assert got == least_of_similar(texts)


def set_simhash(text):
    """By definition: bit b is set where it is in over half of the hashes of the distinct five-word shingles."""
    h = simhash.distinct_shingles(text, 5)
    family = [simhash.mixed(h, m).tolist() for m in range(simhash.MINIMA - simhash.WORDS, simhash.MINIMA)]
    return [2 * sum(x >> b & 1 for x in words) > len(words) for words in family for b in range(64)]


def nodes_of(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return d.select("doc_id", simhash.set_sketch(F.col("text"), 5).alias("s")).select("doc_id", "s.*").withColumn("level", F.floor(F.log(F.greatest("n", F.lit(1))) / -math.log(0.8)).cast("int"))


@pytest.mark.parametrize("tile", [3, 2048])
def test_candidates_by_fingerprints(spark, tile):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage, texts = [word() for _ in range(60)], []
    for edits in range(1, 16):
        base = [word() for _ in range(400 if edits == 7 else 200)]
        texts += [" ".join(base), " ".join(edited(rng, word, base, edits))]
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(300, 600))]) for _ in range(40)]
    nodes = nodes_of(spark, texts).cache()
    name = {bytes(r["fp"]): r["doc_id"] for r in nodes.collect()}
    sim = {r["doc_id"]: bytes(r["sim"]) for r in nodes.collect()}
    prints = [set_simhash(t) for t in texts]
    assert all([x >> b & 1 for x in sim[k] for b in range(8)] == prints[k] for k in range(len(texts)))
    radius = simhash.wide_radius(0.8)
    found = [(name[bytes(r["u"])], name[bytes(r["v"])]) for r in simhash.candidates(nodes, radius, tile).collect()]
    assert all(sum(a != b for a, b in zip(prints[i], prints[j], strict=True)) <= radius for i, j in found)
    # Texts that share a passage only have blocks in common, but no candidate, so their sets aren't made.
    assert len(set(nodes.where("doc_id >= 30").select(F.explode("keys")).toPandas()["col"])) < 8 * 40
    assert found and all(i < 30 and i // 2 == j // 2 for i, j in found)
    assert {i // 2 for i, _ in found} >= {k // 2 for k in range(0, 30, 2) if jaccard(texts[k], texts[k + 1]) >= 0.8}


def test_radius_loses_no_similar_sets():
    """The probability that sets differ in more bits than the radius, exactly, for all small sets at the similarity or above, and as n grows."""
    radius, bits = simhash.wide_radius(0.8), 64 * simhash.WORDS

    def heads(n):
        return [math.comb(n, k) / 2**n for k in range(n + 1)]

    def differ(c, x, y):
        return sum(p * q * r for i, p in enumerate(heads(c)) for j, q in enumerate(heads(x)) for k, r in enumerate(heads(y)) if (2 * (i + j) > c + x) != (2 * (i + k) > c + y))

    def beyond(p):
        return sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1, bits + 1))

    small = [differ(c, x, y) for c in range(1, 41) for x in range(11) for y in range(x, 11) if x + y and 5 * c >= 4 * (c + x + y)]
    assert max(map(beyond, small)) < 2e-6 and beyond(math.acos(0.8 / 0.9) / math.pi) < 1e-9


def test_sets_travel_for_candidates_only(spark, monkeypatch):
    """Of 80 texts in one block two are near copies: two sets are made, and each goes to one group."""
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = [" ".join(passage + [word() for _ in range(300)]) for _ in range(80)]
    texts[-1] = texts[0] + " " + word()
    dealt, deal_out = [], simhash.dealt_blocks

    def seen(*args):
        dealt.append(deal_out(*args))
        return dealt[-1]

    monkeypatch.setattr(simhash, "dealt_blocks", seen, raising=False)
    assert kept_ids(spark, texts) == list(range(79))
    assert dealt[0].count() > 2 and dealt[-1].count() == 2


def strip_repeats(texts, length=50):
    """By definition, over (id, bytes) in order of id."""
    seen, out = {}, []
    for i, b in sorted(texts, key=lambda x: x[0]):
        mask = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen.get(b[k : k + length], i) < i:
                mask[k : k + length] = b"\1" * length
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], i)
        runs = len([r for r in bytes(mask).split(b"\0") if r])
        out.append((i, len(b), sum(mask), runs, hashlib.sha256(bytes(c for c, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize(("chunk", "hot"), [(60_000, 1 << 15), (60_000, 3), (2 << 20, 1 << 15)])
def test_suffix_dedup_matches_brute_force(spark, sf_dir, monkeypatch, chunk, hot):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET", chunk)
    texts = [(r["doc_id"], r["text"].encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op8_suffix_dedup(spark, sf_dir).collect())) == strip_repeats(texts)


def test_suffix_dedup_of_periodic_and_edge_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 400)
    rng = random.Random(9)
    part = "".join(rng.choice("ab") for _ in range(90))
    texts = ["ab" * 60, "ba" * 40, "a" * 200, "a" * 49, "a" * 50, "", part + "é" + part, "x" + part[:60] + "y" + part[30:], "é" * 40, "é" * 30, "ab" * 60, part * 3]
    d = spark.createDataFrame([*enumerate(texts), (12, None)], "doc_id long, text string").withColumn("chunk", F.lit("clash"))
    got = sorted(map(tuple, suffix_dedup.digest(suffix_dedup.remove_repeats(d)).collect()))
    assert got == strip_repeats([(i, t.encode()) for i, t in enumerate([*texts, ""])])
    same = spark.createDataFrame([(1, part), (1, part), (None, part), (None, part)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(same)).collect()) == [(False, 0), (False, 0), (True, 90), (True, 90)]
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


@pytest.mark.parametrize("length", [150, 200])
def test_suffix_dedup_of_long_strings(spark, length):
    rng = random.Random(15)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    parts = [letters(rng.randrange(length, 3 * length)) for _ in range(12)]
    texts = [letters(rng.randrange(80)).join(["", *(part[rng.randrange(30) : len(part) - rng.randrange(30)] for part in rng.sample(parts, 4)), ""]) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.digest(suffix_dedup.remove_repeats(d, length=length)).collect()))
    assert got == strip_repeats([(i, t.encode()) for i, t in enumerate(texts)], length)


def test_suffix_dedup_trusts_no_hash(spark, monkeypatch):
    """With hashes of a few bits, stretches and strings that collide are told apart by their bytes."""
    rng = random.Random(16)
    part = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    shared = [part(rng.randrange(60, 140)) for _ in range(20)]
    texts = [part(rng.randrange(60)).join(rng.choice(shared)[rng.randrange(8) :] for _ in range(4)) for _ in range(80)]
    expected = strip_repeats([(i, t.encode()) for i, t in enumerate(texts)])
    real = suffix_dedup.anchors

    def weak(data, length):
        a = real(data, length)
        return a | {"stretch": a["stretch"] & np.uint64(1)}

    rows = pd.DataFrame({"rank": range(len(texts)), "k1": 0, "k2": 0, "text": [t.encode() for t in texts]})
    monkeypatch.setattr(suffix_dedup, "anchors", weak)
    for hot in ([], sorted(set(real([t.encode() for t in texts], 50)["gram"].tolist()))[::2]):
        hot = np.array(hot, np.uint64)
        chunks = [rows[rows["rank"] % 3 == k].assign(chunk=k) for k in range(3)]
        by_bucket = lambda sent, answer: [answer(g) for _, g in pd.concat(sent).groupby("bucket")]
        asked = pd.concat(by_bucket([suffix_dedup.send_anchors(c, 50, 4, hot) for c in chunks], suffix_dedup.answer_anchors))
        sent = [suffix_dedup.send_stretches(c, asked[asked["chunk"] == k], 50, 4, hot) for k, c in enumerate(chunks)]
        told = pd.concat([asked, *by_bucket(sent, lambda g: suffix_dedup.answer_stretches(g, 50))])
        done = pd.concat([suffix_dedup.remove(c, told[told["chunk"] == k], 50, 4, hot) for k, c in enumerate(chunks)]).sort_values("id")
        got = [(r.id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in done.itertuples()]
        assert got == expected


def test_equal_strings_with_colliding_hashes():
    rng = np.random.default_rng(17)
    rows = rng.integers(97, 99, (200, 6)).astype(np.uint8)
    low = rng.integers(0, 1000, 200)
    least = suffix_dedup.least_of_equal(rows[:, 0].astype(np.uint64), rows, low)
    assert [int(x) for x in least] == [min(int(l) for r, l in zip(rows, low, strict=True) if (r == row).all()) for row in rows]


def test_suffix_dedup_with_several_chunks_in_a_file(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 300)
    monkeypatch.setattr(suffix_dedup, "MOST_CHUNK", 300)
    monkeypatch.setattr(suffix_dedup, "MOST_FILES", 3)
    rng = random.Random(18)
    texts = ["".join(rng.choice("abcdef") for _ in range(70)) + rng.choice("xy") * 60 for _ in range(50)] * 2
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    got = sorted(map(tuple, suffix_dedup.digest(suffix_dedup.remove_repeats(d)).collect()))
    assert got == strip_repeats([(i, t.encode()) for i, t in enumerate(texts)])
    assert {t.name for t in spark.catalog.listTables()} > before
    common.drop_scratch()
    assert not any(t.name.startswith("pointloom_chunks") for t in spark.catalog.listTables())


def test_suffix_sort_equals_python_sort():
    rng = np.random.default_rng(10)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    s = suffix_dedup.Suffixes(text, 20)
    at = np.arange(300)
    group = np.sort(rng.integers(0, 9, 300))
    order = s.sort(at, group)
    assert (group[order] == group).all()
    keys = [(int(group[i]), text[i : i + 20].tobytes()) for i in order]
    assert keys == sorted(keys)


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def test_pages_match_their_articles(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op5_html_extraction(spark, sf_dir).collect():
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


DIRTY = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><header>Site</header><div class="cookie-notice"><p>Accept</p></div>
<nav><a href=/>Home</a></nav><div id="{main}"><h1>Head {i}</h1><p>First &amp; <b>bold</b>&nbsp;text<br>of page {i}<p>Second &lt;one&gt;<ul><li>x{i}<li>y</ul><form>Name<input></form></div>
<aside>More</aside><div class="comments"><div class=comment><p>Nice {i}!</p></div></div><!-- <p>gone</p> --><footer>&copy; us</footer></body></html>"""


def test_odd_markup_takes_linear_time():
    deep = "<article>" + "<div>z" * 20_000
    assert html_template.page_text(deep, None).count("z") == 20_000
    for page in ("<a " * 30_000, '<a "' * 20_000, "<p>" * 50_000 + "x", "<!--" * 30_000, "<div>x<section class=ad>y" * 5000):
        assert len(html_template.page_text(page, None)) <= len(page)
    nested = "<div>" * 30_000 + "".join(f"<p>z{i}</div>" for i in range(30_000))
    kept = html_template.Kept(["div/div/p", *("/".join(["div"] * k) for k in range(1, 70)), *("/".join(["div"] * k) + "/p" for k in range(1, 70))], [], [])
    assert html_template.page_text(nested, kept).count("z") == html_template.page_text(deep.replace("<article>", ""), kept).count("z") + 10_000 == 30_000
    assert html_template.page_text('<article><p title="a>b">One</p><p class=\'ad\'>no</p>two', None) == "One\ntwo"


@pytest.mark.parametrize("attrs", ["", "class='single no-sidebar'", "class='post with-comments'", "id='page' class='menu-open has-sidebar'"])
@pytest.mark.parametrize("tag", ["body", "main", "article", "div"])
def test_layout_classes_hide_no_main_text(tag, attrs):
    page = f"<{tag} {attrs}><article><p>One</p><svg class='x' /><p>Two</p><svg/><div class='cookie-notice'>no</div></article></{tag}><svg><text>no</text></svg><p class=ad>no</p>"
    assert html_template.page_text(page, None) == "One\nTwo"


@pytest.mark.parametrize("page", ["<body class=menu>{}</body>", "<main id=search>{}</main>", "<div class=widget><main>{}</main></div>", "<article class=notice>{}</article>"])
def test_words_of_elements_that_hold_the_main_text(page):
    text = "<article><p>One</p><article class=comment>no</article></article>" if "article" not in page else "<p>One</p><article class=comment>no</article>"
    assert html_template.page_text(page.format(text), None) == "One"


@pytest.mark.parametrize("main", ["article", "content"])
def test_dirty_pages(spark, main):
    pages = [(i, f"http://h.example/{i}", DIRTY.replace("{main}", main).replace("{i}", str(i))) for i in range(12)]
    odd = [(50, None, pages[0][2]), (51, "http://alone.example/", pages[0][2]), (52, "x", None), (53, "http://h.example/z", ""), (54, "http://h.example/y", "<"), (55, "http://h.example/1", pages[1][2])]
    d = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("slots", F.lit(1))
    out = html_template.extract(d)
    assert out.columns == [*d.columns, "text"]
    got = {r["page_id"]: r["text"] for r in out.collect()}
    for i in range(12):
        assert got[i] == f"Head {i}\nFirst & bold text of page {i}\nSecond <one>\nx{i}\ny"
    assert got[50] == got[51] == got[0] and got[52] == got[53] == "" and got[55] == got[1] and got[54] == "<"
    assert html_template.extract(d.limit(0)).count() == 0


def story(rng, n=5):
    sentence = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(8, 20))) + "."
    return [sentence() for _ in range(n)]


MENU, OWNER = ["Home", "World news", "About us"], "Printed by the owner of this place in the old town."
PLAIN = {
    "boxes": "<html><body><div><div>{menu}</div></div><div><p>{head}</p>{body}</div><div>{owner}</div></body></html>",
    "flat": "<html><body>{menu}<p>{head}</p>{body}<p>{owner}</p></body></html>",
    "listed": "<body><ul>{items}</ul><table><tr><td><p>{head}</p>{body}</td></tr></table><p>{owner}</p></body>",
    "opaque": "<body><div class=x1><p>Latest</p><div class='x2 y9'>{menu}</div></div><div class=x7 id=post-{i}><p>{head}</p>{body}</div><div class=z3><p>{owner}</p></div></body>",
}


@pytest.mark.parametrize("n", [2, 4, 5, 20])
@pytest.mark.parametrize("kind", sorted(PLAIN))
def test_template_of_plain_markup(spark, kind, n):
    """No element or class says what it is for: only what the pages of the host share does."""
    rng = random.Random(21)
    assert not any(t in html_template.ASIDE_TAGS or html_template.purposes(a) for t, a in re.findall(r"<(\w+)([^>]*)", PLAIN[kind]))
    stories = [story(rng) for _ in range(n)]
    fill = lambda i, s: PLAIN[kind].format(
        i=i, menu="".join(f"<p>{m}</p>" for m in MENU), items="".join(f"<li>{m}</li>" for m in MENU), head=s[0], body="".join(f"<p>{x}</p>" for x in s[1:]), owner=OWNER)
    pages = [(i, f"http://plain.example/{i}", fill(i, s)) for i, s in enumerate(stories)]
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(s) for i, s in enumerate(stories)}
    alone = [html_template.page_text(h, None) for _, _, h in pages]
    if kind in ("boxes", "flat"):  # a page by itself can't tell, so the template decides
        assert all(OWNER in t or MENU[0] in t for t in alone)


def test_template_inside_articles_and_copies(spark):
    rng = random.Random(22)
    shares = "<div><p>Send this to a friend</p><p>Print this page</p></div>"
    page = lambda s, more="": f"<body><article><h1>{s[0]}</h1>{''.join(f'<p>{x}</p>' for x in s[1:])}{more}<p>Written here.</p></article></body>"
    stories = [story(rng) for _ in range(8)]
    pages = [(i, f"http://a.example/{i}", page(s, shares)) for i, s in enumerate(stories)]
    same, near = story(rng, 9), story(rng, 9)
    pages += [(100 + i, f"http://copies.example/{i}", page(same)) for i in range(12)]
    pages += [(200 + i, f"http://near.example/{i}", page([*near[:8], f"Edition {i}."])) for i in range(12)]
    pages += [(300 + i, f"http://few.example/{i}", page(s, shares)) for i, s in enumerate(stories[:3])]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_template.extract(d).collect()}
    for i, s in enumerate(stories):
        assert got[i] == "\n".join([*s, "Written here."]) != html_template.page_text(pages[i][2], None)
    assert {got[100 + i] for i in range(12)} == {"\n".join([*same, "Written here."])}
    assert [got[200 + i] for i in range(12)] == ["\n".join([*near[:8], f"Edition {i}.", "Written here."]) for i in range(12)]
    assert got[300] == "\n".join([*stories[0], "Written here."])
    args = {"least": 4}  # a parameter: fewer pages than this give no evidence on text
    few = {r["page_id"]: r["text"] for r in html_template.extract(d.where("page_id >= 300"), **args).collect()}
    assert few[300] == "\n".join([*stories[0], "Send this to a friend", "Print this page", "Written here."])


@pytest.mark.parametrize("box", ["main", "div"])
@pytest.mark.parametrize("n", [6, 12, 60])
def test_changing_advert_is_no_contents(spark, box, n):
    """One of three adverts on each page, in a box of its own: its slot takes few values, though none is on nearly all pages."""
    rng = random.Random(24)
    stories = [story(rng) for _ in range(n)]
    page = lambda i, s: f"<body><{box}><h1>{s[0]}</h1>{''.join(f'<p>{x}</p>' for x in s[1:])}<div><p>Buy product {i % 3} today cheap</p></div></{box}></body>"
    pages = [(i, f"http://shop.example/{i}", page(i, s)) for i, s in enumerate(stories)]
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(s) for i, s in enumerate(stories)}
    assert all("Buy product" in html_template.page_text(h, None) for _, _, h in pages)


def test_lists_of_articles_may_repeat_words(spark):
    """Ingredients recur between pages, but in an article only what hardly ever varies is the template's."""
    rng = random.Random(25)
    goods, stories = [f"{w} of the best sort" for w in "salt flour eggs sugar milk rice oil".split()], [story(rng) for _ in range(20)]
    own = [[*rng.sample(goods, 4), *story(rng, 1)] for _ in stories]
    page = lambda s, g: f"<article><h1>{s[0]}</h1><ul>{''.join(f'<li>{x}</li>' for x in g)}</ul><h2>Method</h2>{''.join(f'<p>{x}</p>' for x in s[1:])}</article>"
    pages = [(i, f"http://food.example/{i}", page(s, g)) for i, (s, g) in enumerate(zip(stories, own, strict=True))]
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([s[0], *g, "Method", *s[1:]]) for i, (s, g) in enumerate(zip(stories, own, strict=True))}


def test_classes_decide_where_tags_say_nothing(spark):
    """The given pages with all sectioning elements and classes read as plain divisions: no page alone is right, nine in ten are by their host."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    truth = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    plain = F.regexp_replace(F.regexp_replace("html", r"<(/?)(article|main|nav|footer|aside|header|form)\b[^>]*>", "<$1div>"), '<div class="[^"]*">', "<div>")
    d = pages.withColumn("html", plain)
    got = {r["page_id"]: r["text"] for r in html_template.extract(d).collect()}
    alone = [html_template.page_text(r["html"], None) == truth[r["page_id"]] for r in d.collect()]
    right = [got[i] == t for i, t in truth.items()]
    assert not any(alone) and np.mean(right) >= 0.9
    assert all(set(t.split("\n")) <= set(got[i].split("\n")) for i, t in truth.items())  # where it is wrong, too much stays


@pytest.mark.parametrize("nested", [True, False])
def test_classes_nest_into_the_template(nested):
    """A box on most pages with a text that is always in it is the template's if it stands in slots of one class."""
    other = "body/div:a/p:y" if nested else "body/div:b/p:y"
    elements = [("", 1, 20), ("body", 1, 20), ("body/div:a", 1, 20), ("body/div:b", 3, 18), ("body/div:a/p:x", 2, 12), (other, 2, 12), ("body/div:a/p", 1, 20)]
    keys = {p: k for k, (p, *_) in enumerate(elements)}
    chars = {"body/div:a/p": 5000, "body/div:a/p:x": 120, other: 120}
    tokens = [(v, n, p, keys[p], keys[p], chars.get(p, 0), 0) for p, v, n in elements]
    tokens += [(2, 12, None, 100, keys["body/div:a/p:x"], 120, 0), (2, 12, None, 101, keys[other], 120, 0), (9, 11, None, 102, keys["body/div:a/p"], 40, 0)]
    t = html_template.Template(tokens)
    assert t.valid(1) and t.valid(3) and t.valid(2) == nested
    own = t.own_texts()
    assert own == ({100, 101} if nested else set())
    assert ("body/div:a/p" in t.contents(own)) and html_template.judged(t.contents(own))[0].startswith("body/div:a")


def test_template_of_a_host_with_very_many_paths(spark):
    rng = random.Random(23)
    letters = lambda: "".join(rng.choice("ghijklmnop") for _ in range(8))
    pages = [(i, f"http://many.example/{i}", "<article>" + "".join(f"<div class={letters()}><p>{letters()}</p></div>" for _ in range(100)) + "</article>") for i in range(60)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = html_template.templates(d).first()["template"]
    assert len(found["slots"]) + len(found["gone"]) + len(found["own"]) < 10
    assert all(len(r["text"].split("\n")) == 100 for r in html_template.extract(d).collect())


def test_pipeline_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        after = {r["doc_id"] for r in docs.collect()}
        assert docs.columns == columns and after <= before, name
        before = after
        if name == "quality_classifier":
            kept = [labels[i] for i in after if i in labels]
            assert np.mean(kept) > 0.95 and len(kept) >= 0.95 * sum(labels.values())
    assert docs.where("n_chars != length(text)").count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in last} == before and all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_pipeline_runs_whole(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, sf_dir)
    assert 0 < out.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()
