"""Sentences to assertions: weighted patterns over a chart, ordered patterns over tagged words, and repairs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_probabilities(tagged: DataFrame, closed: list[str], smooth: float) -> DataFrame:
    """word, tag, n, p = (n + smooth) / (tokens of the tag + smooth * words), without words of closed classes."""
    return counted_probabilities(tagged.where(~F.col("tag").isin(closed)).groupBy("word", "tag").agg(F.count("*").alias("n")), smooth)


def counted_probabilities(counts: DataFrame, smooth: float) -> DataFrame:
    """``tag_probabilities`` of counts (word, tag, n)."""
    of_tag = counts.groupBy("tag").agg(F.sum("n").alias("total"))
    size = counts.agg(F.count_distinct("word").alias("size"))
    rows = counts.join(F.broadcast(of_tag), "tag").crossJoin(F.broadcast(size))  # tags are few
    return rows.select("word", "tag", "n", ((F.col("n") + smooth) / (F.col("total") + smooth * F.col("size"))).alias("p"))


#: Words of closed classes, endings that tell open ones, and rules of phrases with their weights; all of our own.
CLOSED = {"a": "DT", "an": "DT", "the": "DT", "some": "DT", "my": "DT", "is": "BE", "are": "BE", "was": "BE", "were": "BE", "can": "MD", "will": "MD", "be": "BE0", "of": "IN", "in": "IN", "on": "IN", "at": "IN", "near": "IN", "with": "IN", "for": "IN", "to": "TO", "and": "CC", "it": "PR", "you": "PR", "they": "PR", "people": "NN"}
ENDS = [("ing", "VB", 0.5), ("ed", "VN", 0.6), ("ful", "JJ", 0.8), ("ous", "JJ", 0.8), ("ive", "JJ", 0.7), ("able", "JJ", 0.8), ("ly", "RB", 0.8), ("s", "NN", 0.5)]
OPEN = {"NN": 0.5, "VB": 0.25, "JJ": 0.15, "VN": 0.06, "RB": 0.04}
RULES = [("NP", ("NN",), 0.4), ("NP", ("PR",), 0.05), ("NP", ("DT", "NB"), 0.3), ("NP", ("JJ", "NB"), 0.1), ("NP", ("NP", "PP"), 0.1), ("NP", ("NN", "NB"), 0.05), ("NB", ("NN",), 0.7), ("NB", ("JJ", "NB"), 0.2), ("NB", ("NN", "NB"), 0.1), ("PP", ("IN", "NP"), 1.0), ("VP", ("VB",), 0.35), ("VP", ("VB", "NP"), 0.45), ("VP", ("VP", "PP"), 0.2), ("AP", ("JJ",), 0.8), ("AP", ("RB", "JJ"), 0.2), ("PA", ("VN",), 0.6), ("PA", ("VN", "PP"), 0.4)]
#: Relation, what stands in order (upper-case: a phrase; its first two are the concepts), weight.
PATTERNS = [
    ("IsA", ["NP", "is|are|was", "NP"], 0.2), ("HasProperty", ["NP", "is|are|was", "AP"], 0.2), ("HasProperty", ["NP", "can", "be", "AP"], 0.1),
    ("ReceivesAction", ["NP", "can", "be", "PA"], 0.2), ("CapableOf", ["NP", "can|will", "VP"], 0.2), ("AtLocation", ["NP", "is|are", "in|on|at", "NP"], 0.3),
    ("UsedFor", ["NP", "is|are", "used", "for|to", "NP"], 0.3), ("UsedFor", ["NP", "is|are", "used", "to", "VP"], 0.3), ("HasA", ["NP", "has|have", "NP"], 0.3), ("PartOf", ["NP", "is|are", "part", "of", "NP"], 0.4),
    ("Desires", ["NP", "wants|want", "to", "VP"], 0.4), ("Causes", ["NP", "causes|cause", "NP"], 0.4), ("MadeOf", ["NP", "is|are", "made", "of", "NP"], 0.4), ("junk", ["it|they|you", "is|are", "NP"], 0.5),
]
FLOOR = 1e-60


def tags_of(word: str) -> dict[str, float]:
    if word in CLOSED:
        return {CLOSED[word]: 1.0}
    out = dict(OPEN)
    for end, tag, p in ENDS:
        if word.endswith(end) and len(word) > len(end) + 2:
            out = {t: q * (1 - p) for t, q in out.items()}
            out[tag] += p
            break
    return {t: q * 0.01 for t, q in out.items()}


_SYMBOLS = {name: i for i, name in enumerate(sorted({t for t in [*CLOSED.values(), *OPEN]} | {x for made, parts, _ in RULES for x in (made, *parts)}))}
_ONE = [(_SYMBOLS[made], _SYMBOLS[parts[0]], p) for made, parts, p in RULES if len(parts) == 1]
_TWO = sorted((_SYMBOLS[made], _SYMBOLS[parts[0]], _SYMBOLS[parts[1]], p) for made, parts, p in RULES if len(parts) == 2)
_MADE = sorted({made for made, *_ in _TWO})
_FIRST = [[made for made, *_ in _TWO].index(m) for m in _MADE]
_LEFT, _RIGHT, _P = [r[1] for r in _TWO], [r[2] for r in _TWO], np.array([r[3] for r in _TWO])[:, None, None]


def charts(texts: np.ndarray) -> np.ndarray:
    """For texts of one length n, given as (text, word, symbol) probabilities of tags: (symbol, start, words, text) with
    the probability of each tag or phrase over each run of words, 0 where it is none, filled from short to long."""
    count, n, symbols = texts.shape
    cells = np.zeros((symbols, n, n + 1, count))
    cells[:, :, 1] = texts.transpose(2, 1, 0)
    for size in range(1, n + 1):
        starts = n - size + 1
        for d in range(1, size):
            left, right = cells[_LEFT, :starts, d], cells[_RIGHT, d : d + starts, size - d]
            best = np.maximum.reduceat(_P * left * right, _FIRST, axis=0)
            cells[_MADE, :starts, size] = np.maximum(cells[_MADE, :starts, size], best)
        for made, part, p in _ONE:
            cells[made, :starts, size] = np.maximum(cells[made, :starts, size], p * cells[part, :starts, size])
    return cells


@lru_cache(100_000)
def _tagged(word: str) -> tuple[float, ...]:
    tags = tags_of(word)
    return tuple(tags.get(name, 0.0) for name in _SYMBOLS)


def _charted(runs: set[tuple[str, ...]], at_once: int = 256) -> dict[tuple[str, ...], tuple[np.ndarray, np.ndarray]]:
    """For each run of words the cells (symbol, words) from its start and (symbol, start) to its end."""
    by_length: dict[int, list[tuple[str, ...]]] = {}
    for run in runs:
        by_length.setdefault(len(run), []).append(run)
    out = {}
    for n, mine in by_length.items():
        for first in range(0, len(mine), at_once):
            some = mine[first : first + at_once]
            cells = charts(np.array([[_tagged(w) for w in run] for run in some]))
            heads, tails = cells[:, 0].copy(), cells[:, np.arange(n), n - np.arange(n)]
            out |= {run: (heads[:, :, i], tails[:, :, i]) for i, run in enumerate(some)}
    return out


#: A sentence without any of these words fits no pattern.
_SAYING = {w for _, pattern, _ in PATTERNS for part in pattern if not part.isupper() for w in part.split("|")}


def _places(words: list[str], longest: int) -> list[tuple[int, int, int]]:
    """pattern, end of the first concept, start of the second, for each place where a pattern's words stand between two
    runs of words that can be its concepts; the first concept of a pattern that begins with words is empty."""
    n, out = len(words), []
    for nth, (_, pattern, _) in enumerate(PATTERNS):
        said = [part.split("|") for part in pattern if not part.isupper()]
        for end in range(1, min(n, longest) + 1) if pattern[0].isupper() else (0,):
            start = end + len(said)
            if 0 < n - start <= longest and all(words[end + i] in these for i, these in enumerate(said)):
                out.append((nth, end, start))
    return out


def parse_all(sentences: list[str | None], longest: int = 24) -> list[tuple[str, str, str] | None]:
    """For each sentence relation, first and second concept of the likeliest pattern; None for none and for junk.

    Sentences have any length; a concept is a phrase of at most ``longest`` words. Charts are filled for the runs of words
    before and after a pattern's only, for all sentences together."""
    asked, runs = {}, set()
    for nth, sentence in enumerate(sentences):
        plain = sentence.strip().rstrip(".!?").replace('"', "").split() if isinstance(sentence, str) else []
        words = [w.lower().strip(",;:") for w in plain]
        if _SAYING.isdisjoint(words) or len(words) > 2 * longest + max(len(p) for _, p, _ in PATTERNS):
            continue  # nothing to say it by, or more words than two concepts and a pattern have
        if places := _places(words, longest):
            head, tail = tuple(words[: max(end for _, end, _ in places)]), tuple(words[min(start for *_, start in places) :])
            asked[nth] = plain, places, head, tail
            runs |= {run for run in (head, tail) if run}
    known, out = _charted(runs), [None] * len(sentences)
    for nth, (plain, places, head, tail) in asked.items():
        best = {}
        for which, end, start in places:
            pattern = PATTERNS[which][1]
            p = known[tail][1][_SYMBOLS[pattern[-1]], start - len(plain) + len(tail)]
            if end:
                p = known[head][0][_SYMBOLS[pattern[0]], end] * p
            if p > best.get(which, (0.0,))[0]:
                best[which] = p, end, start
        likeliest = (FLOOR, "", 0, 0)
        for which, (p, end, start) in sorted(best.items()):
            if p * PATTERNS[which][2] > likeliest[0]:
                likeliest = (p * PATTERNS[which][2], PATTERNS[which][0], end, start)
        _, relation, end, start = likeliest
        if relation and relation != "junk" and end:
            out[nth] = relation, " ".join(plain[:end]), " ".join(plain[start:])
    return out


def parse(sentence: str, longest: int = 24) -> tuple[str, str, str] | None:
    """``parse_all`` of one sentence."""
    return parse_all([sentence], longest)[0]


def parsed(text: Column) -> Column:
    """struct<relation, text1, text2>, null where nothing fits."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([p or (None, None, None) for p in parse_all(texts.tolist())], columns=["relation", "text1", "text2"])

    return F.pandas_udf(run, "relation string, text1 string, text2 string")(text)


def repaired(df: DataFrame) -> DataFrame:
    """Assertions (relation, adverb, text1, text2) put right: near is LocatedNear, a thing or ability in, on, at or by is
    a place; without junk, places "of" something, and concepts of more than six words."""
    place = F.col("relation").isin("IsA", "CapableOf") & F.col("adverb").isin("in", "on", "at", "by")
    relation = F.when((F.col("relation") == "AtLocation") & (F.col("adverb") == "near"), "LocatedNear").when(place, "AtLocation").otherwise(F.col("relation"))
    long = lambda c: F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")) > 6
    good = F.col("relation").isNotNull() & (F.col("relation") != "junk") & ~((F.col("relation") == "AtLocation") & F.col("adverb").eqNullSafe("of"))
    rows = df.where(good & ~long("text1") & ~long("text2"))
    return rows.withColumns({"relation": relation, "adverb": F.when(place, "").otherwise(F.col("adverb"))})


#: Adverbs of our own with what they say of frequency, from -10 (never) to 10 (always); 5 is usual.
ADVERBS = {"never": -10, "not": -5, "rarely": -2, "seldom": -2, "sometimes": 4, "often": 6, "usually": 8, "mostly": 8, "always": 10}


def adverb_frequency(text: Column) -> Column:
    """The least value of the words, 5 without any."""
    known = F.create_map(*[F.lit(x) for pair in ADVERBS.items() for x in pair])
    values = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.element_at(known, w))
    return F.coalesce(F.array_min(F.filter(values, lambda v: v.isNotNull())), F.lit(5))


def dependency(text: Column) -> Column:
    """struct<link, word1, index1, word2, index2> of rel(word-1, word-2), null if it is none."""
    pattern = r"^(.+)\((.*)-(\d+)'*, (.*)-(\d+)'*\)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("link"), part(2).alias("word1"), part(3).cast("int").alias("index1"), part(4).alias("word2"), part(5).cast("int").alias("index2")))


def second_order(text: Column, patterns: list[tuple[str, int, bool]]) -> Column:
    """Each pattern (regular expression, group, abort) that is found leaves its group, or nothing if it aborts."""
    for regex, group, abort in patterns:
        text = F.when(text.rlike(regex), F.lit("") if abort else F.regexp_extract(text, regex, group)).otherwise(text)
    return text


