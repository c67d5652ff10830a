"""Toxicity by maximum-scoring segments over token log-odds.

Tokens (letter runs, lower-cased) go by their longest form, the word or a prefix of it, that is significant among all
forms, and get its log-odds of toxic against other labelled documents with a Dirichlet prior in proportion to the whole
sample; tokens without such a form get 0. Each token also pays ``drift``, which makes the expected score negative. A
linear-time scan (Ruzzo and Tompa) finds every maximal segment of a whole text. Segment scores s over a text of n tokens are calibrated by the extreme-value law
P(S >= s) = 1 - exp(-K n exp(-lambda s)): lambda solves sum p(x) exp(lambda x) = 1 over the token scores of other
documents, K is fitted to their best segments. Segments with an expectation under ``significant`` are toxic passages;
the text's evidence is the sum of their -log expectations, mapped to a probability by a logistic fit at the true share
of toxic rows.

Learned from a bounded sample, about ``per_class`` labelled rows of each class by a hash of doc_id, one row a doc_id;
the calibration uses words learned on the other half of the sample. Null or empty texts get the lowest score, that of no evidence.
Rows without a label, with another label than 0 or 1, or with null doc_id aren't learned from; without both classes
every score is the share of toxic rows (0 if none). Repeated rows are scored each; other columns aren't read.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hinted, slices, table

PREFIXES = (7, 5)
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if isinstance(text, str) else []


def forms(word: str) -> list[str]:
    """The word and its shorter prefixes (marked by a star), longest first: inflected and compounded words share these."""
    return [word, *(word[:k] + "*" for k in PREFIXES if k < len(word))]


def token_scores(tokens: list[str], odds: dict[str, float]) -> np.ndarray:
    def best(word: str) -> float:
        for form in forms(word):
            if form in odds:
                return odds[form]
        return 0.0

    known = {t: best(t) for t in set(tokens)}
    return np.fromiter((known[t] for t in tokens), float, len(tokens))


def _xlogx(x: float, of: float) -> float:
    return x * math.log(x / of) if x > 0 else 0.0


def log_odds(toxic: Counter, other: Counter, held: Counter, n1: int, n0: int, prior: float = 50.0, false_words: float = 0.5) -> dict[str, float]:
    """Forms by the log-odds of a token of a toxic document to have them, under a Dirichlet prior of ``prior`` tokens.

    Counts are of the tokens with the form, among n1 tokens of toxic documents and n0 of other ones; held: how many
    documents have it. Forms count from three documents on, if their likelihood-ratio statistic, divided by the tokens
    that a holding document has of it (which come together, so count once), is so high that about ``false_words`` of all
    such forms would reach it by chance.
    """
    words = [w for w, n in held.items() if n >= 3]
    least = 2 * math.log(max(len(words), 1) / false_words)
    out = {}
    for w in words:
        a, b = toxic[w], other[w]
        e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
        g = 2 * (_xlogx(a, e1) + _xlogx(b, e0) + _xlogx(n1 - a, n1 - e1) + _xlogx(n0 - b, n0 - e0))
        if a > e1 and g * held[w] / (a + b) >= least:
            p = prior * (a + b) / (n1 + n0)
            out[w] = math.log((a + p) / (n1 + prior - a - p)) - math.log((b + p) / (n0 + prior - b - p))
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in time linear in the number of positive scores."""
    if not (scores > 0).any():
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list[float]] = []  # start, end, sum before, sum after
    chain: list[int] = []  # for each, the nearest earlier one with a smaller sum before it, or -1
    for i in np.flatnonzero(scores > 0):
        start, end, left, right = int(i), int(i) + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = chain[j]
            if j < 0 or stack[j][3] >= right:
                stack.append([start, end, left, right])
                chain.append(j)
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:], chain[j:]
    return [(int(a), int(b), right - left) for a, b, left, right in stack]


@dataclass
class ToxicModel:
    odds: dict[str, float]
    drift: float
    rate: float  # lambda
    scale: float  # K
    significant: float
    slope: float
    offset: float

    def passages(self, tokens: list[str]) -> list[tuple[int, int, float]]:
        """Significant segments: start, end (tokens), expectation."""
        if not tokens:
            return []
        scores = token_scores(tokens, self.odds) - self.drift
        expect = [(a, b, self.scale * len(tokens) * math.exp(-self.rate * s)) for a, b, s in segments(scores)]
        return [x for x in expect if x[2] < self.significant]

    def evidence(self, tokens: list[str]) -> float:
        return sum(-math.log(max(e, 1e-300) / self.significant) for _, _, e in self.passages(tokens))

    def score(self, text: str | None) -> float:
        x = self.slope * math.log1p(self.evidence(tokens_of(text))) + self.offset
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def _root(values: np.ndarray, shares: np.ndarray) -> float:
    """lambda > 0 with sum shares * exp(lambda * values) = 1, for a negative mean and a positive value."""
    f = lambda x: float((shares * np.exp(x * values)).sum()) - 1
    low, high = 0.0, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def _calibrated(odds: dict[str, float], others: list[list[str]], drift: float, significant: float) -> ToxicModel:
    model = ToxicModel(odds, drift, 1.0, 1.0, significant, 1.0, 0.0)
    scores = [token_scores(ts, odds) - drift for ts in others if ts]
    values, n = np.unique(np.round(np.concatenate(scores or [np.array([-drift])]), 3), return_counts=True)
    if (values > 0).any() and (values * n).sum() < 0:
        model.rate = _root(values, n / n.sum())
    best = [(len(s), max([x[2] for x in segments(s)], default=0.0)) for s in scores]
    # Of texts without a segment only an upper bound is known, so K is set by the share of texts that have one.
    hits = sum(1 for _, b in best if b > 0)
    exposure = sum(size * math.exp(-model.rate * min([b for _, b in best if b > 0], default=0.0)) for size, _ in best)
    model.scale = max(hits, 0.5) / max(exposure, 1e-9)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """slope >= 0 and offset of a weighted logistic fit, by Newton steps with a small ridge."""
    w = np.array([0.0, math.log(max((weight * y).sum(), 1e-9) / max((weight * (1 - y)).sum(), 1e-9))])
    rows = np.column_stack([x, np.ones_like(x)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -60, 60)))
        h = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, rows.T @ (weight * (y - p)) - 1e-3 * w * np.array([1, 0]))
        w += np.clip(step, -2, 2)
    return max(float(w[0]), 0.0), float(w[1])


def fit(rows: list[tuple[int, list[str]]], share: float, drift: float = 0.3, significant: float = 0.5) -> ToxicModel:
    """rows: (label, tokens); share: of toxic rows among all labelled ones."""
    by_class = sorted(rows, key=lambda r: r[0])
    halves = [by_class[::2], by_class[1::2]]
    if len({y for y, _ in halves[0]}) < 2 or len({y for y, _ in halves[1]}) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicModel({}, drift, 1.0, 1.0, significant, 0.0, math.log(p / (1 - p)))

    def learn(part: list[tuple[int, list[str]]]) -> ToxicModel:
        counts, held, seen, n = (Counter(), Counter()), Counter(), (set(), set()), Counter()
        for y, ts in part:
            n[y] += len(ts)
            # A word between the same neighbours is one piece of evidence a class: copies add nothing.
            places = {hash(p): p[1] for p in zip(["", *ts], ts, [*ts[1:], ""])}
            fresh = Counter(w for h, w in places.items() if h not in seen[y])
            seen[y].update(places)
            of_text: Counter[str] = Counter()
            for w, k in fresh.items():
                for form in forms(w):
                    of_text[form] += k
            counts[y].update(of_text)
            held.update(of_text.keys())
        return _calibrated(log_odds(counts[1], counts[0], held, n[1], n[0]), [ts for y, ts in part if not y], drift, significant)

    x, y = [], []
    for fitted, other in ((0, 1), (1, 0)):
        model = learn(halves[fitted])
        x += [math.log1p(model.evidence(ts)) for _, ts in halves[other]]
        y += [label for label, _ in halves[other]]
    x, y = np.array(x), np.array(y, float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    model = learn(rows)
    model.slope, model.offset = _logistic(x, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1500) -> ToxicModel:
    """docs (doc_id, text), labels (doc_id, toxic); usable: which doc_ids may be learned from."""
    marks = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long")).agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not n:
        return fit([], 0.0)
    part = F.when(F.col("toxic") == 1, F.lit(per_class / max(n.get(1, 0), 1))).otherwise(F.lit(per_class / max(n.get(0, 0), 1)))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40)) < part * float(1 << 40))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            yield pd.DataFrame({"doc_id": frame.doc_id, "toxic": frame.toxic, "tokens": [tokens_of(t) for t in frame.text]})

    # Of repeated rows of a doc_id the text of least hash, so that reruns learn the same.
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(hinted(cut(chosen)), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = texts.mapInPandas(count, "doc_id long, toxic int, tokens array<string>").toPandas()
    got = got.assign(size=got.tokens.map(len)).sort_values(["doc_id", "size"], kind="stable")
    rows = [(int(y), list(map(sys.intern, ts))) for y, ts in zip(got.toxic, got.tokens)]
    del got
    return fit(rows, n.get(1, 0) / sum(n.values()))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score for each row of (doc_id, text)."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t if isinstance(t, str) else None) for t in texts], dtype=float)

    return docs.select("doc_id", F.pandas_udf(run, "double")(F.col("text")).alias("score"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = train(docs, table(spark, sf_dir, "labels"), F.coalesce(fold != 2, F.lit(False)))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
