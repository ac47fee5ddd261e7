"""Document quality from a linear-chain conditional random field over lines.

Each line is described by shares and ratios of its characters and words, those of the lines before and after it, and its place.
A two-label chain (bad, good) is trained on labelled documents, every line of which carries its document's label; neighbouring
lines therefore vote together. A document's score is the mean of its lines' forward-backward marginals of "good", weighted by line
length. Only text is an input of the score.

Training reads a bounded sample of labelled rows: at most TRAIN_DOCS documents, the first by hash of the id among those with
crc32(id as text) mod 4 other than 2, one row of each (the text of smallest hash, where an id has several), and of them those with at
most TRAIN_LINES lines; both bounds are parameters of fit. Scoring covers all rows and whole texts.

Defined results: a null or empty text is one empty line and gets a score; without labels of both classes every score is the share
of good ones in the sample (0.5 without any); repeated labels of a document count as bad if one of them is; rows with a null id are
scored and not held out; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRAIN_DOCS, TRAIN_LINES = 3000, 256
CHUNK = 1_000_000
#: Training lines that are widened to double precision at once.
BLOCK = 1 << 15
SYMBOLS = b"#*$%&|<>@^~{}[]\\/_=+"


def byte_class(members: bytes | range) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


CLASSES = {
    "space": byte_class(b" \t\x0b\x0c\r"),
    "upper": byte_class(range(65, 91)),
    "digit": byte_class(range(48, 58)),
    "symbol": byte_class(SYMBOLS),
    "bar": byte_class(b"|"),
    "shout": byte_class(b"!?"),
    "stop": byte_class(b".,;:"),
    "lead": byte_class(range(0xC0, 0x100)),
    "tail": byte_class(range(0x80, 0xC0)),
}
#: Limits above which an indicator of a measure is set.
STEPS = {
    "symbol": (0.02, 0.08, 0.15), "bar": (0.1, 0.3), "upper": (0.15, 0.4, 0.7), "shout": (0.1, 0.4), "digit": (0.05, 0.3), "stop": (0.02, 0.3),
    "distinct": (0.2, 0.5, 0.8), "again": (0.05, 0.3, 0.7), "mean": (3.0, 4.5, 7.0, 10.0), "foreign": (0.02, 0.2), "length": (2.0, 4.0, 6.0),
}
BASE = tuple(STEPS)


def line_measures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures of every line, number of lines of each text, bytes of each line)."""
    lines = [line for t in texts for line in (t or "").split("\n")]
    n_lines = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
    buf = np.frombuffer(("\n".join(lines) + "\n").encode(), np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    count = {k: np.add.reduceat(c[buf], starts, dtype=np.int64) for k, c in CLASSES.items()}
    words = np.empty(len(lines), np.int64)
    distinct, again = np.empty(len(lines)), np.empty(len(lines))
    for i, line in enumerate(lines):
        w = line.split()
        words[i], distinct[i], again[i] = len(w), len(set(w)), sum(map(eq, w, w[1:]))
    chars = size - count["tail"]
    solid = np.maximum(chars - count["space"], 1)
    n = np.maximum(words, 1)
    m = {
        "symbol": count["symbol"] / solid, "bar": count["bar"] / n, "upper": count["upper"] / solid, "shout": count["shout"] / n,
        "digit": count["digit"] / solid, "stop": count["stop"] / n, "distinct": np.where(words > 0, distinct / n, 1.0), "again": again / n,
        "mean": (chars - count["space"]) / n, "foreign": count["lead"] / solid, "length": np.log1p(chars),
    }
    return np.stack([m[k] for k in BASE], 1).astype(np.float32), n_lines, size


def own_features(measures: np.ndarray) -> np.ndarray:
    """Indicators and clipped measures of each line by itself, in single precision, as the measures are."""
    own = [np.ones(len(measures), np.float32)]
    for j, k in enumerate(BASE):
        own.append(np.minimum(measures[:, j], STEPS[k][-1]) / STEPS[k][-1])
        own += [(measures[:, j] > s).astype(np.float32) for s in STEPS[k]]
    return np.stack(own, 1)


def edges(n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are the first and the last of their documents."""
    first, last = (np.zeros(int(n_lines.sum()), bool) for _ in range(2))
    ends = np.cumsum(n_lines)
    first[ends - n_lines] = last[ends - 1] = True
    return first, last


def features(measures: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Features of each line, of the lines before and after it, and its place in the document."""
    x = own_features(measures).astype(float)
    first, last = edges(n_lines)
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None]], 1)


class Lines:
    """Lines to train on: `features` by products, from a line's own features only, so that neighbours' aren't held thrice."""

    def __init__(self, measures: np.ndarray, n_lines: np.ndarray):
        self.parts = [own_features(measures[i : i + BLOCK]) for i in range(0, len(measures), BLOCK)]
        self.first, self.last = edges(n_lines)
        self.own = self.parts[0].shape[1]

    def times(self, weights: np.ndarray) -> np.ndarray:
        """features @ weights."""
        k = self.own
        mine, before, after = np.concatenate([p.astype(float) @ weights[: 3 * k].reshape(3, k).T for p in self.parts]).T
        return mine + np.where(self.first, weights[3 * k], np.roll(before, 1)) + np.where(self.last, weights[3 * k + 1], np.roll(after, -1))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """values @ features."""
        moved = np.stack([values, np.roll(np.where(self.first, 0, values), -1), np.roll(np.where(self.last, 0, values), 1)])
        own = sum(moved[:, i * BLOCK : i * BLOCK + len(p)] @ p.astype(float) for i, p in enumerate(self.parts))
        return np.concatenate([own.ravel(), [values[self.first].sum(), values[self.last].sum()]])


@dataclass
class Chain:
    """Emission weights of label "good" against "bad", and transition weights between labels."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(x @ self.weights, -30, 30))


def forward_backward(emit: np.ndarray, n_lines: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line the odds of good over bad from the lines up to it, from those after it, and the marginal of good.

    All documents advance together, longest first; the odds stay bounded by the transition odds times one emission.
    """
    t = np.exp(moves)
    order = np.argsort(-n_lines, kind="stable")
    start, size = (np.cumsum(n_lines) - n_lines)[order], n_lines[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    ahead, behind = np.empty(len(emit)), np.ones(len(emit))
    r = emit[start]
    ahead[start] = r
    for i in range(1, steps):
        at = start[: live[i]] + i
        r = r[: live[i]]
        r = emit[at] * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)
        ahead[at] = r
    for i in range(steps - 2, -1, -1):
        at = start[: live[i + 1]] + i
        e = emit[at + 1] * behind[at + 1]
        behind[at] = (t[1, 0] + t[1, 1] * e) / (t[0, 0] + t[0, 1] * e)
    odds = ahead * behind
    return ahead, behind, odds / (1 + odds)


def train(measures: np.ndarray, n_lines: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4) -> Chain:
    """Maximum conditional likelihood by full-batch Adam; every line of a document has its label."""
    x = Lines(measures, n_lines)
    y = np.repeat(labels, n_lines).astype(float)
    weights, moves = np.zeros(3 * x.own + 2), np.zeros((2, 2))
    follows = np.ones(len(y), bool)
    follows[np.cumsum(n_lines) - n_lines] = False
    here = np.flatnonzero(follows)
    seen = np.array([[((y[here] == b) & (y[here - 1] == a)).sum() for b in (0, 1)] for a in (0, 1)], float)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    docs = len(labels)
    for k in range(1, rounds + 1):
        emit = np.exp(np.clip(x.times(weights), -30, 30))
        ahead, behind, good = forward_backward(emit, n_lines, moves)
        t = np.exp(moves)
        e = emit[here] * behind[here]
        joint = np.stack([np.full(len(here), t[0, 0]), t[0, 1] * e, t[1, 0] * ahead[here - 1], t[1, 1] * ahead[here - 1] * e], 1)
        expected = (joint / joint.sum(1, keepdims=True)).sum(0).reshape(2, 2)
        for i, (value, slope) in enumerate(((weights, x.sums(y - good)), (moves, seen - expected))):
            g = slope / docs - decay * value
            m, v = state[2 * i], state[2 * i + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            value += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Chain(weights, moves)


def score_texts(texts: list[str | None], chain: Chain) -> np.ndarray:
    measures, n_lines, size = line_measures(texts)
    good = forward_backward(chain.emissions(features(measures, n_lines)), n_lines, chain.moves)[2]
    start = np.cumsum(n_lines) - n_lines
    weight = size + 1.0
    return np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)


def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES
) -> Chain | float:
    """A chain trained on a bounded sample of the labelled rows, or a constant score where both classes aren't there.

    max_docs * max_lines lines at most reach the driver, as numbers.
    """
    chosen = (
        labels.where((remainder(F.col(id_col)) != 2) & F.col("quality").isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_docs)
        .collect()
    )
    if not chosen:
        return 0.5
    spark = docs.sparkSession
    sample = spark.createDataFrame([(r["id"], r["quality"]) for r in chosen], T.StructType([T.StructField("id", labels.schema[id_col].dataType), T.StructField("quality", T.IntegerType())]))

    @F.pandas_udf(T.BinaryType())
    def measure(texts: pd.Series) -> pd.Series:
        short = [(t or "").count("\n") < max_lines for t in texts]
        return pd.Series([line_measures([t])[0].tobytes() if s else None for t, s in zip(texts, short, strict=True)])

    # The sample has max_docs rows at most, so it is safe to broadcast.
    several = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    found = several.groupBy("id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(map(tuple, found.select("id", "quality", measure("text").alias("m")).where("m IS NOT NULL").collect()))
    labels_of = np.array([q for _, q, _ in rows])
    if len(set(labels_of.tolist())) < 2:
        return float(np.mean(labels_of)) if rows else 0.5
    measures = [np.frombuffer(m, np.float32).reshape(-1, len(BASE)) for _, _, m in rows]
    n_lines = np.array([len(m) for m in measures])
    return train(np.concatenate(measures), n_lines, labels_of)


def score(text: Column, model: Chain | float) -> Column:
    """A score from 0 to 1, higher where the text is likelier good."""

    @F.pandas_udf(T.DoubleType())
    def run(column: pd.Series) -> pd.Series:
        texts = column.tolist()
        out = np.empty(len(texts))
        begin = chars = 0
        for i in range(len(texts) + 1):
            n = len(texts[i] or "") if i < len(texts) else 0
            if begin < i and (i == len(texts) or chars + n > CHUNK):
                out[begin:i] = score_texts(texts[begin:i], model) if isinstance(model, Chain) else model
                begin, chars = i, 0
            chars += n
        return pd.Series(out)

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) of each row."""
    model = fit(docs, labels, id_col, text_col)
    out = docs.select(id_col, score(F.col(text_col), model).alias("score"))
    return out.select(
        id_col, F.coalesce(remainder(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose score is below the threshold."""
    return docs.where(score(F.col(text_col), fit(docs, labels, id_col, text_col)) >= threshold)
