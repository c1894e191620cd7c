"""Toxicity by maximum-scoring segments of token log-odds.

Fit, on a bounded sample of labelled rows (FIT_ROWS, by hash of doc_id): words
and their prefixes are counted over toxic and clean texts, once a text; log-odds under an
informative Dirichlet prior, with their deviations, give a lexicon of features
that stand out by both. A word scores as its best feature, every other word a small
negative amount. Score, on all rows: the linear-time scan of Ruzzo and Tompa
finds every maximal scoring segment; a segment of score S among n words has the
extreme-value significance lambda * S - ln(K n) with K = 1 as its bound and
lambda solved on the clean frequencies. A logistic function, fitted to the same
sample, turns the best segment and the evidence over all significant
segments into a probability.

Edge cases: a null or empty text has no words and gets the probability of no
evidence; very long texts are taken whole; repeated rows are scored each; with
no labels of both kinds the score is the share of toxic labels (0 without any);
null labels are ignored, labels that repeat count once and the toxic one of two,
and of the texts of one doc_id the least is learned from; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

FIT_ROWS = 20_000
PRIOR, LEAST, DEVIATIONS, ODDS, DRIFT = 200.0, 0.5, 3.0, 3.5, 0.25
PREFIXES = range(4, 9)
SIGNIFICANT = 3.0  # natural logarithm of the inverse chance
MEMORY = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word and its shorter prefixes, marked as such."""
    return [word, *(word[:k] + "-" for k in PREFIXES if k < len(word))]


def segments(scores: list[tuple[int, float]], n: int, other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score).

    scores: the positive words by position; every other word scores `other` < 0.
    One pass; a list of open segments with the sums to their left (L) and to
    their end (R), as Ruzzo and Tompa keep it. Words without a positive score
    only add to the running sum.
    """
    stack: list[list] = []  # first, last, L, R
    total, before = 0.0, -1
    for at, s in scores:
        total += other * (at - before - 1)
        left, total, before = total, total + s, at
        one = [at, at, left, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= one[2]:
                j -= 1
            if j < 0 or stack[j][3] >= one[3]:
                break
            one = [stack[j][0], one[1], stack[j][2], one[3]]
            del stack[j:]
        stack.append(one)
    return [(a, b, r - l) for a, b, l, r in stack]


class Scorer:
    """Word scores of a lexicon; remembers a bounded number of words."""

    def __init__(self, lexicon: dict[str, float], other: float, scale: float):
        self.lexicon, self.other, self.scale, self.seen = lexicon, other, scale, {}

    def word(self, w: str) -> float:
        s = self.seen.get(w)
        if s is None:
            s = max((self.lexicon.get(f, 0.0) for f in features(w.lower())), default=0.0)
            if len(self.seen) < MEMORY:
                self.seen[w] = s
        return s

    def spans(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = _WORD.findall(text or "")
        word = self.word
        return len(words), segments([(i, s) for i, w in enumerate(words) if (s := word(w)) > 0], len(words), self.other)

    def inputs(self, n: int, found: list[tuple[int, int, float]]) -> list[float]:
        size = math.log(max(n, 1))
        e = [self.scale * s - size for _, _, s in found]
        best = self.scale * max((s for _, _, s in found), default=0.0)
        return [best, max(e, default=0.0), sum(x for x in e if x >= SIGNIFICANT), float(bool(found))]


def _scale(p0: list[float], s: list[float], other: float) -> float:
    """lambda > 0 with the mean of exp(lambda * score) over clean words = 1."""
    rest = max(1 - sum(p0), 0.0)
    f = lambda x: sum(p * math.exp(min(x * v, 600)) for p, v in zip(p0, s, strict=True)) + rest * math.exp(x * other) - 1
    lo, hi = 1e-3, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    if f(lo) >= 0:
        return lo
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return lo


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, the constant last; a small ridge keeps separable samples finite."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (len(w) - 1) + [1e-6]) * 10
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, scorer: Scorer | None, weights: np.ndarray, share: float):
        self.scorer, self.weights, self.share = scorer, weights, share

    def scores(self, found: list[tuple[int, list]]) -> list[float]:
        """Of texts by their (number of words, segments)."""
        if self.scorer is None or not found:
            return [self.share] * len(found)
        z = np.array([self.scorer.inputs(*x) for x in found]) @ self.weights[:-1] + self.weights[-1]
        return list(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """labels (doc_id, toxic): the rows that may be learned from."""
    some = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("toxic") == 1).alias("y"))
    # At most `rows` rows, a parameter: labels that repeat count once, the toxic one of two; of texts of one doc_id the least counts.
    some = materialize(some.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = materialize(sample)

    def count(batches):
        for b in batches:
            n = defaultdict(Counter)
            for text, y in zip(b["text"], b["y"], strict=True):
                n[bool(y)].update({w.lower() for w in _WORD.findall(text or "")})
            out: dict[str, list[int]] = {"": [0, 0]}
            for y, words in n.items():
                for w, c in words.items():
                    out[""][y] += c
                    for f in features(w):
                        out.setdefault(f, [0, 0])[y] += c
            yield pd.DataFrame([(f, c[1], c[0]) for f, c in out.items()], columns=["f", "y1", "y0"])

    counts = sample.mapInPandas(count, "f string, y1 long, y0 long").groupBy("f").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))
    counts = materialize(counts.where("y1 > 0 OR f = ''"))
    total = counts.where("f = ''").collect()
    n1, n0 = (total[0]["y1"], total[0]["y0"]) if total else (0, 0)
    if not n1 or not n0:
        got = some.agg(F.avg(F.col("y").cast("double")).alias("p")).collect()[0]["p"]
        return Model(None, np.zeros(0), float(got or 0.0))
    a = LEAST + PRIOR * (F.col("y1") + F.col("y0")) / float(n1 + n0)
    odds = lambda y, n: F.log((y + a) / (n + PRIOR - y - a))
    delta = odds(F.col("y1"), float(n1)) - odds(F.col("y0"), float(n0))
    z = delta / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    strong = counts.where("f <> ''").select("f", "y1", "y0", delta.alias("d"), z.alias("z")).where((F.col("z") >= DEVIATIONS) & (F.col("d") >= ODDS))
    # Words of the sample's toxic texts, so bounded by its rows.
    lex = strong.orderBy(F.desc("z"), "f").collect()
    p0 = [(r["y0"] + LEAST + PRIOR * (r["y1"] + r["y0"]) / (n1 + n0)) / (n0 + PRIOR) for r in lex if not r["f"].endswith("-")]
    scorer = Scorer({r["f"]: r["d"] for r in lex}, -DRIFT, 1.0)
    scorer.scale = _scale(p0, [r["d"] for r in lex if not r["f"].endswith("-")], -DRIFT)
    scale, lexicon = scorer.scale, scorer.lexicon

    def measure(batches):
        s = Scorer(lexicon, -DRIFT, scale)
        for b in batches:
            yield pd.DataFrame([(bool(y), s.inputs(*s.spans(t))) for t, y in zip(b["text"], b["y"], strict=True)], columns=["y", "x"])

    got = sample.mapInPandas(measure, "y boolean, x array<double>").collect()
    x, y = np.array([r["x"] for r in got]), np.array([float(r["y"]) for r in got])
    return Model(scorer, _logistic(x, y), float(y.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the significant passages by word numbers and their evidence."""
    bound = None if model.scorer is None else (model.scorer.lexicon, model.scorer.other, model.scorer.scale)
    weights, share = model.weights, model.share

    def run(batches):
        m = Model(Scorer(*bound) if bound else None, weights, share)
        for b in batches:
            rows = []
            every = [m.scorer.spans(t) if m.scorer else (0, []) for t in b["text"]]
            for doc, (n, found), p in zip(b["doc_id"], every, m.scores(every), strict=True):
                size = math.log(max(n, 1))
                e = [(i, j, m.scorer.scale * s - size) for i, j, s in found]
                rows.append((doc, p, [{"first": i, "last": j, "evidence": v} for i, j, v in e if v >= SIGNIFICANT]))
            yield pd.DataFrame(rows, columns=["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double, passages array<struct<first:long,last:long,evidence:double>>")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
