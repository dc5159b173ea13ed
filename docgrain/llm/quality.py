"""Quality classifier from weak labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

The labellers see the form of a text, not its words, so they hold for any language: each votes good, bad or
abstains. Votes of all documents are counted by pattern; expectation-maximisation over the patterns estimates how
often each labeller is right about good and about bad texts. The posterior labels of a bounded sample train a
logistic scorer on hashed word shapes, which then scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest number of different documents that train the scorer; all documents count in the labellers' accuracies.
SAMPLE = 4000
#: Size of the hashed feature space.
DIMENSIONS = 1 << 12
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "capitals", "shouting", "table", "stutter", "variety", "lines", "sentences", "word_length", "letters")

_SHAPE = bytes(
    ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else 32 if b in b" \t\r\n\x0b\x0c" else b
    for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)
_SYMBOLS = b"#$%&*+<=>@\\^_`{|}~"
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
_ENDS = (". ", ", ", "; ", ": ", "? ", ".\n", ",\n", "?\n")


def votes(text: str | None) -> list[int]:
    """One vote for each of LABELLERS: GOOD, BAD or NONE. Texts without words get no vote."""
    words = text.split() if text else []
    if not words:
        return [NONE] * len(LABELLERS)
    n, data = len(words), text.encode("utf-8", "surrogatepass")
    size = len(data)

    def by(value: float, good: float, bad: float) -> int:
        """Small is good."""
        return GOOD if value <= good else BAD if value >= bad else NONE

    filled = len(data.translate(None, b" \t\n\r\x0b\x0c"))
    letters = len(data.translate(None, _NO_LETTERS)) / max(1, filled)
    out = [by((size - len(data.translate(None, _SYMBOLS))) / n, 0.05, 0.3)]
    out.append(by(sum(map(str.isupper, words)) / n, 0.1, 0.35))
    out.append(by((text.count("!!") + text.count("??") + text.count("$$") + text.count("**") + text.count("##")) / n, 0.02, 0.2))
    out.append(by((text.count("|") + text.count("\t")) / n, 0.02, 0.2))
    out.append(by(sum(map(eq, words, words[1:])) / n, 0.05, 0.2) if n >= 8 else NONE)
    out.append(by(n**0.7 / len(set(words)), 0.7, 1.2) if n >= 20 else NONE)
    lines = [x for x in text.split("\n") if x.strip()]
    out.append(by(1 - len(set(lines)) / len(lines), 0.15, 0.5) if len(lines) >= 4 else NONE)
    stops = sum(map(text.count, _ENDS)) / n
    out.append((BAD if stops < 0.005 else GOOD if 0.02 <= stops <= 0.4 else NONE) if n >= 40 else NONE)
    mean = size / n
    out.append(GOOD if 3.5 <= mean <= 10 else BAD if mean > 25 or mean < 2 else NONE)
    out.append(GOOD if letters >= 0.85 else BAD if letters < 0.6 else NONE)
    return out


def shape_features(text: str | None) -> dict[int, float]:
    """Hashed features: shares of word shapes, of pairs of shapes, and of words that repeat the one before."""
    if not text:
        return {}
    data = text.encode("utf-8", "surrogatepass")
    shapes = _RUNS.sub(rb"\1\1", data.translate(_SHAPE).replace(b"xx", b"x")).split()
    if not shapes:
        return {}
    n, out = len(shapes), {}

    def add(name: bytes, value: float) -> None:
        k = zlib.crc32(name) % DIMENSIONS
        out[k] = out.get(k, 0.0) + value

    for shape, count in Counter(shapes).items():
        add(b"1" + shape, count / n)
    for (a, b), count in Counter(zip(shapes, shapes[1:], strict=False)).items():
        add(b"2" + a + b" " + b, count / n)
    words = data.split()
    add(b"stutter", sum(map(eq, words, words[1:])) / len(words))
    return out


@dataclass
class Accuracies:
    """Share of good texts, and each labeller's chances of each vote on good and on bad texts."""

    prior: float
    on_good: np.ndarray  # labellers x (BAD, GOOD), of the texts on which it votes
    on_bad: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Accuracies:
        """EM over vote patterns (rows) with their counts. It starts from texts without a bad vote as the good ones.

        Abstentions, of which short texts have many, weigh nothing.
        """
        m = patterns.shape[1]
        is_vote = np.stack([patterns == v for v in (BAD, GOOD)], axis=2).astype(float)
        p, model = np.where((patterns == BAD).any(axis=1), 0.05, 0.95), cls.unfitted(m)
        for _ in range(rounds):
            a, b = counts * p, counts * (1 - p)
            # Imagined votes, right more often than wrong, keep rare votes off the ends.
            on_good = np.einsum("i,ijv->jv", a, is_vote) + np.array([0.1, 2.0])
            on_bad = np.einsum("i,ijv->jv", b, is_vote) + np.array([2.0, 0.5])
            prior = float(np.clip((a.sum() + 1) / (counts.sum() + 2), 0.05, 0.95))
            before = model
            model = cls(prior, on_good / on_good.sum(1, keepdims=True), on_bad / on_bad.sum(1, keepdims=True))
            p = model.posterior(patterns)
            if max(np.abs(before.on_good - model.on_good).max(), np.abs(before.on_bad - model.on_bad).max()) < 1e-6:
                break
        return model

    @classmethod
    def unfitted(cls, m: int) -> Accuracies:
        return cls(0.8, np.tile([0.02, 0.98], (m, 1)), np.tile([0.5, 0.5], (m, 1)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these votes is good."""
        s = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        odds = np.log(self.on_good / self.on_bad)
        for v in (BAD, GOOD):
            s = s + ((patterns == v) * odds[:, v]).sum(1)
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


@dataclass
class Scorer:
    """Logistic model on hashed features."""

    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, rows: list[dict[int, float]], target: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Scorer:
        """Full-batch Adam on the cross-entropy with soft targets. Without rows everything scores 0.5."""
        w, b = np.zeros(DIMENSIONS, np.float32), 0.0
        if not rows:
            return cls(w, b)
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, row in enumerate(rows):
            x[i, list(row)] = list(row.values())
        m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(4 * (x @ w) + b, -60, 60)))
            miss = (p - target).astype(np.float32)
            g = np.append(4 * (miss @ x) / len(rows) + decay * w, miss.mean())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
        return cls(w, b)

    def score(self, features: dict[int, float]) -> float:
        """Probability of a good text."""
        if not features:
            return 0.0
        s = 4 * float(self.weights[list(features)] @ np.array(list(features.values()), np.float32)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(s, -60, 60))))


def _code(v: list[int]) -> int:
    return sum(x * 3**j for j, x in enumerate(v))


def _decode(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**j % 3 for j in range(len(LABELLERS))], axis=1)


def fit_quality(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[Accuracies, Scorer]:
    """Labellers' accuracies from the votes on all texts, and the scorer from ``sample`` different ones at most."""

    @F.pandas_udf("long")
    def pattern(texts: pd.Series) -> pd.Series:
        return pd.Series([_code(votes(t)) for t in texts], dtype="int64")

    @F.pandas_udf("k array<int>, v array<float>")
    def features(texts: pd.Series) -> pd.DataFrame:
        rows = [shape_features(t) for t in texts]
        return pd.DataFrame({"k": [list(r) for r in rows], "v": [list(r.values()) for r in rows]})

    text = F.col(text_col)
    # At most 3 ** labellers patterns, whatever the number of documents.
    seen = docs.select(pattern(text).alias("code")).groupBy("code").count().collect()
    codes, counts = np.array([r["code"] for r in seen], np.int64), np.array([r["count"] for r in seen], float)
    if not len(codes):
        return Accuracies.unfitted(len(LABELLERS)), Scorer.fit([], np.empty(0))
    accuracies = Accuracies.fit(_decode(codes), counts)
    # Copies of a text count once at every size: the texts with the smallest hashes are drawn, one row of each.
    whole = docs.where(text.isNotNull()).select(F.xxhash64(text, F.lit(5)).alias("h"), text.alias("t"))
    least = whole.select("h").distinct().orderBy("h").limit(sample)
    drawn = whole.join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.first("t").alias("t"))
    rows = drawn.select("h", pattern(F.col("t")).alias("code"), features(F.col("t")).alias("f")).collect()
    rows.sort(key=lambda r: r["h"])  # the order of arrival must not matter
    sparse = [dict(zip(r["f"]["k"], r["f"]["v"], strict=True)) for r in rows]
    target = accuracies.posterior(_decode(np.array([r["code"] for r in rows], np.int64))) if rows else np.empty(0)
    return accuracies, Scorer.fit(sparse, target)


def with_quality(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, into: str = "quality") -> DataFrame:
    """``docs`` with ``into``: the probability, 0 to 1, that the text is good.

    Null texts and texts without words score 0. Equal texts score alike. All rows and columns stay; an empty table
    gives an empty result. A table of few documents trains on all of them.
    """
    _, scorer = fit_quality(docs, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # DIMENSIONS floats

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(shape_features(t)) for t in texts], dtype="float64")

    return docs.withColumn(into, score(F.col(text_col)))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their own columns."""
    return with_quality(docs, text_col, sample, "__quality").where(F.col("__quality") >= threshold).drop("__quality")
