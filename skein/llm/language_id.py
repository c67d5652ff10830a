"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text becomes the mean of the embeddings of its hashed character n-grams (of letters, with word boundaries), and a
linear softmax over that mean gives the languages. Embeddings and softmax are learned together by mini-batch
stochastic gradient descent in numpy, on a bounded sample: about ``per_class`` labelled rows of each language, chosen
by a hash of doc_id, one row a doc_id. Rejection is calibrated on a held-back part of that sample: a temperature
minimises the log loss, so that a score is the probability to be right, and predictions less likely than ``sure`` to be
right are rejected (Chow's rule for an error that costs 1 / (1 - sure) times a rejection).

Null texts and texts without a letter get ``und``, score 0, and are rejected. Rows with null doc_id or null lang are
not learned from. With no labelled row at all, every text gets ``und``. Repeated rows are predicted each. ``confident``
keeps all columns as they are, whatever their names; ``annotate`` does too but for columns named like its own three,
which it replaces. An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hinted, mix, slices

UND = "und"
ORDERS = (1, 2, 3, 4)
_is_letter: dict[str, np.ndarray] = {}


def letters_of(text: str) -> np.ndarray:
    """Lower-cased code points with each run of non-letters as one space, spaces at both ends; empty if no letter."""
    if "t" not in _is_letter:
        _is_letter["t"] = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _is_letter["t"]
    letter = known[codes]
    if not letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(letter, codes, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    return np.concatenate([np.array([32], np.uint32), codes, np.full(int(codes[-1] != 32), 32, np.uint32)])


def buckets_of(text: str, buckets: int) -> np.ndarray:
    """Hash bucket of each character n-gram of the text, for all orders."""
    codes = letters_of(text).astype(np.uint64)
    out = []
    acc = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        acc = acc[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            out.append((mix(acc + np.uint64(n)) & np.uint64(buckets - 1)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # buckets x labels: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """label, calibrated probability, rejected."""
        hits = buckets_of(text, len(self.table)) if text and self.labels else ()
        if not len(hits):
            return UND, 0.0, True
        logits = (np.bincount(hits, minlength=len(self.table)) @ self.table / len(hits) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        score = float(p[best] / p.sum())
        return self.labels[best], score, score < self.threshold


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_sgd(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: list[str], buckets: int, dim: int = 16, epochs: int = 12, rate: float = 2.0, batch: int = 32, sure: float = 0.5) -> LanguageModel:
    """bags: distinct buckets and their shares for each text."""
    rng = np.random.default_rng(7)
    emb = (rng.standard_normal((buckets, dim)) / dim).astype(np.float32)
    weights = np.zeros((dim, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 20 else order
    seen = order[len(y) // 5 :] if len(y) >= 20 else order
    share = np.bincount(y[seen], minlength=len(labels)) / max(1, len(seen))
    cost = (1 / np.maximum(share, 1e-9) / len(labels)).astype(np.float32)
    steps, total = 0, epochs * (len(seen) // batch + 1)
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(seen), max(1, len(seen) // batch)):
            mix_in = np.zeros((len(chunk), buckets), np.float32)
            for row, i in zip(mix_in, chunk):
                row[bags[i][0]] = bags[i][1]
            mean = mix_in @ emb
            err = _softmax(mean @ weights + bias)
            err[np.arange(len(chunk)), y[chunk]] -= 1
            err *= cost[y[chunk]][:, None] / len(chunk)
            lr = rate * (1 - steps / total)
            grad = err @ weights.T
            weights -= lr * (mean.T @ err)
            bias -= lr * 0.1 * err.sum(axis=0)
            used = np.unique(np.concatenate([bags[i][0] for i in chunk]))
            emb[used] -= lr * len(chunk) * (mix_in[:, used].T @ grad)
            steps += 1
    table = (emb @ weights).astype(np.float64)
    logits = np.array([bags[i][1] @ table[bags[i][0]] for i in held]) + bias
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    return LanguageModel(labels, table, bias.astype(np.float64), float(temperature), sure)


def train(docs: DataFrame, usable: Column, per_class: int = 600, buckets: int = 1 << 14) -> LanguageModel:
    """Learn from the rows of (doc_id, text, lang) for which ``usable`` holds; about per_class of each language."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang").where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = hinted(cut(rows.groupBy("lang").count()))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < F.lit(float(per_class) * (1 << 40)) / F.col("count")

    narrow = np.min_scalar_type(buckets - 1)

    def featurise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            out = []
            for doc, lang, text in zip(frame.doc_id, frame.lang, frame.text):
                hits = buckets_of(text, buckets) if isinstance(text, str) else ()
                if len(hits):
                    keys, n = np.unique(hits, return_counts=True)
                    out.append((doc, lang, keys.astype(narrow).tobytes(), (n / len(hits)).astype(np.float32).tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "lang", "keys", "shares"])

    # Of repeated rows of a doc_id and language the text of least hash, so that reruns learn the same.
    chosen = rows.join(counts, "lang").where(chance).groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = chosen.mapInPandas(featurise, "doc_id long, lang string, keys binary, shares binary").toArrow()  # bytes stay in place in Arrow
    if not got.num_rows:
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0)
    rows = zip(got["doc_id"].to_pylist(), got["lang"].to_pylist(), got["keys"], got["shares"])
    bags = [(doc, lang, np.frombuffer(k.as_buffer(), narrow), np.frombuffer(v.as_buffer(), np.float32)) for doc, lang, k, v in rows]
    bags.sort(key=lambda x: (x[0], x[1], len(x[2])))
    labels = sorted({x[1] for x in bags})
    y = np.array([labels.index(x[1]) for x in bags])
    return fit_sgd([x[2:] for x in bags], y, labels, buckets)


def annotate(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and rejected of each whole text."""

    guess = _guess(model)
    out = docs.drop("lang_pred", "score", "rejected").select("*", guess(F.col("text")).alias("_skein_guess"))
    return out.select("*", "_skein_guess.*").drop("_skein_guess")


def confident(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs whose language isn't rejected, with all their columns."""
    return docs.where(~_guess(model)(F.col("text"))["rejected"])


def _guess(model: LanguageModel):
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score", "rejected"])

    return F.pandas_udf(run, "lang_pred string, score double, rejected boolean")


def fold(mod: int) -> Column:
    """crc32 of doc_id as text, modulo ``mod``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, F.coalesce(fold(3) != 1, F.lit(False)))
    out = annotate(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
