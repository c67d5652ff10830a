"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased with white space collapsed. An item of m characters occurs in a document if some region of it is
within k = floor(m * edits) edits. By the q-gram lemma such a region shares at least m - q + 1 - q k of the item's
character q-grams, on diagonals (place in document less place in item) that lie within k of each other. So shared
q-grams are counted in bands of 2 (k + 1) diagonals that overlap by half, so that each run of k + 1 diagonals lies in
one band; bands with that many are regions to verify, by banded alignment of the item against the region. Counts are
taken over bounded numbers of shared q-grams at a time, so texts and items of repeated characters need no more memory.

Items for which k and that number of q-grams are positive are found so (with q = 8 and 8 % edits, from 20 characters on,
normalised); shorter ones word for word, where no word goes on beyond them. Items without characters occur nowhere. The items' q-grams are
broadcast if all items together have at most ``broadcast_chars`` characters; otherwise items are worked off in parts
of that size, each over all documents. Null or empty texts hold nothing; repeated rows are reported each (one row for
each); null doc_ids are reported as null; other columns aren't read. Without documents or items the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, table


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if isinstance(text, str) else ""


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    acc = np.zeros(len(codes) - q + 1, np.uint64)
    for i in range(q):
        acc = acc * np.uint64(0x100000001B3) + codes[i : len(codes) - q + 1 + i]
    return mix(acc)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def banded_distance(item: np.ndarray, text: np.ndarray, first: int, width: int, most: int) -> tuple[int, int] | None:
    """Fewest edits that turn the item into a part of the text, and that part's end, if ``most`` are enough.

    Only alignments on the ``width`` diagonals (place in text less place in item) from ``first`` on are tried; the part
    may start at any of them. A row of the table holds the cells of one character of the item on these diagonals.
    """
    steps = np.arange(width)
    far = len(item) + most + 1
    around = np.full(len(item) + width, -1, np.int64)  # the text from ``first`` on; -1 outside it
    low, high = max(0, first), min(len(text), first + len(around))
    if low < high:
        around[low - first : high - first] = text[low:high]
    row = np.where((first + steps >= 0) & (first + steps <= len(text)), 0, far)
    for i, c in enumerate(item.astype(np.int64)):
        best = row + (around[i : i + width] != c)  # take both characters
        best[around[i : i + width] < 0] = far
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)  # leave out the item's character
        at = first + i + 1 + steps
        best[(at < 0) | (at > len(text))] = far
        row = np.minimum.accumulate(best - steps) + steps  # leave out characters of the text
        row[(at < 0) | (at > len(text))] = far
        if row.min() > most:
            return None
    end = int(row.argmin())
    return int(row[end]), first + len(item) + end


class Items:
    """The q-gram index of benchmark items (id, normalised text)."""

    BITS = 20
    PAIRS = 250_000

    def __init__(self, items: list[tuple[int, str]], q: int, edits: float):
        self.short: dict[int, tuple[np.ndarray, dict[str, list[int]]]] = {}
        short = [(i, t) for i, t in items if not self._indexed(len(t), q, edits)]
        for m in {len(t) for _, t in short}:
            ids: dict[str, list[int]] = {}
            for i, t in short:
                if len(t) == m:
                    ids.setdefault(t, []).append(i)
            self.short[m] = np.concatenate([gram_hashes(codes_of(t), m) for t in ids]), ids
        items = [(i, t) for i, t in items if self._indexed(len(t), q, edits)]
        self.ids, self.texts, self.q = [i for i, _ in items], [t for _, t in items], q
        self.codes = [codes_of(t) for t in self.texts]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.most = np.floor(self.size * edits + 1e-9).astype(np.int64)
        self.least = self.size - q + 1 - q * self.most
        grams = [gram_hashes(c, q) for c in self.codes]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.flat = flat[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.empty(0, np.int64)
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[(self.flat & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    @staticmethod
    def _indexed(m: int, q: int, edits: float) -> bool:
        """Whether an item of m characters may have edits and the q-gram lemma finds it."""
        k = int(m * edits + 1e-9)
        return k > 0 and m - q + 1 - q * k > 0

    def _find_short(self, text: str, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """The first place of each short item that stands in the text word for word."""
        out: dict[int, tuple[int, int, int, int]] = {}
        for m, (hashes, ids) in self.short.items():
            for a in np.flatnonzero(np.isin(gram_hashes(codes, m), hashes)).tolist():
                part = text[a : a + m]
                inside = a and text[a - 1].isalnum() and part[0].isalnum() or text[a + m : a + m + 1].isalnum() and part[-1].isalnum()
                for i in () if inside else ids.get(part, ()):
                    out.setdefault(i, (i, a, a + m, 0))
        return list(out.values())

    def _full_bands(self, grams: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """item and band of each band with enough shared q-grams, in order of the bands of an item.

        Pairs of a place ``at`` and an entry of the index are laid out ``PAIRS`` at a time in order of places; counts are
        kept only of bands that later places can still reach, so a text and an item of one repeated character, or a
        q-gram that many items hold, takes no more memory than others.
        """
        low = np.searchsorted(self.flat, grams[at])
        n = np.searchsorted(self.flat, grams[at], "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return
        ends, far = np.cumsum(n), int(self.size.max())
        wide = (int(at[-1]) + far) // int(self.most.min() + 1) + 3
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for begin in range(0, int(ends[-1]), self.PAIRS):
            end = min(begin + self.PAIRS, int(ends[-1]))
            p, last = np.searchsorted(ends, [begin, end - 1], "right")
            shares = np.minimum(ends[p : last + 1], end) - np.maximum(ends[p : last + 1] - n[p : last + 1], begin)
            entry = np.arange(begin, end) + np.repeat(low[p : last + 1] - ends[p : last + 1] + n[p : last + 1], shares)
            item = self.item[entry]
            band = (np.repeat(at[p : last + 1], shares) - self.place[entry] + far) // (self.most[item] + 1)
            key = item * wide + band
            least = int(key.min())
            if int(key.max()) - least < 4 * len(key) + 1000:
                sums = np.bincount(key - least)
                sums = np.append(sums, 0) + np.append(0, sums)  # each counts for its own band and for the next, overlapping one
                new = np.flatnonzero(sums)
                new, sums = new + least, sums[new]
            else:
                new, sums = np.unique(np.concatenate([key + 1, key]), return_counts=True)
            keys, place = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, sums]), minlength=len(keys)).astype(np.int64)
            # A place from ``ahead`` on is on no diagonal of a band that ends before it by the item's length.
            ahead = int(at[np.searchsorted(ends, end, "right")]) if end < ends[-1] else np.iinfo(np.int64).max // 2
            item, band = keys // wide, keys % wide - 1
            over = (band + 2) * (self.most[item] + 1) - far <= ahead - self.size[item]
            full = over & (counts >= self.least[item])
            yield from zip(item[full].tolist(), band[full].tolist())
            keys, counts = keys[~over], counts[~over]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """item id, start and end in the normalised text, edits: the best region of each item that occurs."""
        codes = codes_of(text)
        short = self._find_short(text, codes)
        grams = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.bitmap[(grams & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.flat):
            return short
        found: dict[int, tuple[int, int, int]] = {}
        for k, b in self._full_bands(grams, at):
            reach, m = int(self.most[k]) + 1, int(self.size[k])
            first = b * reach - int(self.size.max())
            best = found.get(k)
            if best and not best[0]:  # bands of an item come in order, so the first exact place is known
                continue
            exact = text.find(self.texts[k], max(0, first), max(0, first + 2 * reach + m))
            if exact >= 0:
                found[k] = (0, exact, exact + m)
                continue
            less = best[0] - 1 if best else int(self.most[k])  # only a better region is looked for
            got = banded_distance(self.codes[k], codes, first, 2 * reach, less) if less else None
            if got is not None:
                found[k] = (got[0], max(0, got[1] - m), got[1])
        return [(self.ids[k], a, b, e) for k, (e, a, b) in sorted(found.items())] + short


def indexes(items: DataFrame, q: int = 8, edits: float = 0.08, broadcast_chars: int = 4_000_000) -> Iterator[Items]:
    """Indexes of all items (item_id, text), each of broadcast_chars characters or about."""
    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    tidy = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    total = rows.agg(F.sum(F.length(tidy))).first()[0] or 0
    parts = max(1, -(-total // broadcast_chars))
    for part in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        kept = [(r["item_id"], t) for r in mine.orderBy("item_id", "text").collect() if (t := normal(r["text"]))]
        if kept:
            yield Items(kept, q, edits)


def matches(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, start, end (in the normalised text), edits for each item that a row of docs holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, end long, edits int"
    out = spark.createDataFrame([], schema)
    for index in indexes(items, **how):
        sent = spark.sparkContext.broadcast(index)

        def run(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for frame in slices(frames):
                rows = [(doc, *hit) for doc, text in zip(frame.doc_id, frame.text) if isinstance(text, str) for hit in sent.value.find(normal(text))]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits"]).astype({"doc_id": "Int64"})

        out = out.union(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns."""
    for index in indexes(items, **how):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def held(texts: pd.Series, sent=sent) -> pd.Series:
            return pd.Series([bool(isinstance(t, str) and sent.value.find(normal(t))) for t in texts], dtype=bool)

        docs = docs.where(~_flag(held)(F.col("text")))
    return docs


def _flag(held):
    def run(texts: pd.Series) -> pd.Series:
        return held(texts)

    return F.pandas_udf(run, "boolean")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
