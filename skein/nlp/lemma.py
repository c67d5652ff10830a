"""Lemmas with residues that give the text back, a suffix-trie lemmatiser, and light stemmers."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import by_row
from ..operators.order import kept

from .normalize import CORRECT, STOP, SWAP
from .stem import stem

VOWELS = "aeiou"
#: Irregular forms with their lemma and ending.
IRREGULAR = {"went": ("go", "ed"), "gone": ("go", "en"), "people": ("person", "s"), "children": ("child", "s"), "men": ("man", "s"), "women": ("woman", "s"), "ran": ("run", "ed"), "better": ("good", "er"), "best": ("good", "est"), "feet": ("foot", "s"), "mice": ("mouse", "s")}
_FORMS = {pair: word for word, pair in IRREGULAR.items()}
ENDINGS = ("ing", "est", "ed", "er", "s")


def inflect(lemma: str, ending: str) -> str:
    """The lemma with an ending, as English spells it."""
    if (lemma, ending) in _FORMS:
        return _FORMS[lemma, ending]
    after_consonant = len(lemma) > 1 and lemma[-2] not in VOWELS
    if not ending:
        return lemma
    if ending == "s":
        if lemma.endswith(("s", "x", "z", "ch", "sh")):
            return lemma + "es"
        return lemma[:-1] + "ies" if lemma.endswith("y") and after_consonant else lemma + "s"
    if ending != "ing" and lemma.endswith("y") and after_consonant:
        return lemma[:-1] + "i" + ending
    if lemma.endswith("e") and not lemma.endswith(("ee", "oe", "ye")):
        return lemma[:-1] + ending
    short = re.fullmatch(r"[^aeiou]*[aeiou][^aeiouwxy]", lemma)
    return lemma + (lemma[-1] if short else "") + ending


@lru_cache(100_000)
def split_word(word: str) -> tuple[str, str]:
    """lemma, ending; only such that ``inflect`` gives the word back."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    for ending in ENDINGS:
        if not word.endswith(ending) or len(word) < len(ending) + 3:
            continue
        stem = word[: -len(ending)]
        tries = [stem]
        if ending == "s":
            tries = ([stem[:-2] + "y"] if stem.endswith("ie") else []) + ([stem[:-1]] if stem.endswith("e") else []) + ([] if stem.endswith("s") else [stem])
        else:
            if stem.endswith("i"):
                tries = [stem[:-1] + "y"]
            elif len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "aeiouls":
                tries = [stem[:-1], stem]
            elif re.search(r"([iy]z|[aeiou][cvu]|[^aeiou]at|[lr][csv]|[aeiou]s|dg|u[rt]|[aeiou]k)$", stem):
                tries = [stem + "e", stem]
        for lemma in tries:
            if len(lemma) > 1 and any(c in VOWELS + "y" for c in lemma) and inflect(lemma, ending) == word:
                return lemma, ending
    return word, ""


_TRIM = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'-`")


def lemma_split(text: str, lang: str = "en", keep_stop: bool = False) -> tuple[str, str]:
    """Normal form (lemmas of words that aren't stop words) and residue (all else, with numbered places for lemmas)."""
    found = [w.strip(_TRIM).lower() for w in text.replace("/", " ").split()]
    found = [CORRECT.get(w, w) for w in found if w]
    lemmas, residue = [], []
    for word in found:
        if not keep_stop and word in STOP.get(lang, []):
            residue.append(word)
        else:
            lemma, ending = split_word(word)
            lemmas.append(SWAP.get(lemma, lemma) if lemma == word else lemma)
            residue.append(f"{len(lemmas)}{ending}" if SWAP.get(lemma) is None or lemma != word else f"{len(lemmas)}={word}")
    if found and not lemmas:
        return lemma_split(text, lang, True)
    return " ".join(lemmas), " ".join(residue)


def lemma_combine(lemmas: str, residue: str) -> str:
    """The words that ``lemma_split`` took apart."""
    known, out = lemmas.split(" "), []
    for part in residue.split(" "):
        m = re.fullmatch(r"(\d+)(=?)(.*)", part)
        if not m or int(m[1]) > len(known) or not int(m[1]):
            out.append(part)
        else:
            out.append(m[3] if m[2] else inflect(known[int(m[1]) - 1], m[3]))
    return " ".join(out)


#: Endings of a family's lemma that its other words lack.
_ADDED = ("", "e", "y")


def word_families(counts: DataFrame, longest: int = 5) -> DataFrame:
    """word, lemma, n of words (word, n) that come of another word of the table by cutting up to ``longest`` letters and
    putting on nothing, an e or a y: of several the least cut, then the least added. A lemma has three letters or more and
    isn't longer than what comes of it."""
    tries = F.array(*[F.struct(F.lit(cut).alias("cut"), F.lit(add).alias("add")) for cut in range(1, longest + 1) for add in _ADDED if len(add) < cut])
    rows = counts.where(F.length("word") > 3).select("word", "n", F.explode(tries).alias("t")).where(F.length("word") - F.col("t.cut") >= 2)
    rows = rows.withColumn("lemma", F.concat(F.substring("word", F.lit(1), F.length("word") - F.col("t.cut")), F.col("t.add")))
    rows = rows.where(F.length("lemma") >= 3).join(counts.select(F.col("word").alias("lemma")), "lemma", "left_semi")
    return rows.groupBy("word", "n").agg(F.min_by("lemma", F.struct("t.cut", "t.add")).alias("lemma")).select("word", "lemma", "n")


def suffix_rules(pairs: DataFrame, longest: int = 6, least: int = 2) -> DataFrame:
    """suffix, cut, add, n: of each suffix (up to ``longest`` letters) of words (word, lemma) the change that most words
    with it take; of equal ones the least cut. Changes of fewer than ``least`` words are too rare to count."""
    letters = F.sequence(F.lit(1), F.least(F.length("word"), F.length("lemma")))
    parted = F.array_min(F.filter(letters, lambda i: F.substring("word", i, F.lit(1)) != F.substring("lemma", i, F.lit(1))))
    same = F.coalesce(parted - 1, F.least(F.length("word"), F.length("lemma")))
    rows = pairs.select("word", (F.length("word") - same).alias("cut"), F.substr("lemma", same + 1).alias("add"))
    sizes = F.sequence(F.greatest("cut", F.lit(1)), F.least(F.length("word"), F.greatest("cut", F.lit(longest))))
    rows = rows.where(F.greatest("cut", F.lit(1)) <= F.length("word")).select("word", "cut", "add", F.explode(sizes).alias("k"))
    seen = rows.groupBy(F.substring("word", -F.col("k"), F.col("k")).alias("suffix"), "cut", "add").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = seen.groupBy("suffix").agg(F.max_by(F.struct("cut", "add", "n"), F.struct("n", -F.col("cut"), F.col("add"))).alias("r"))
    return best.select("suffix", "r.cut", "r.add", "r.n")


class SuffixTrie:
    """Changes by suffix, as a trie of letters from the end, held in arrays: a node's child for a letter is found by a
    search in one sorted array of (node, letter)."""

    def __init__(self, steps: np.ndarray, to: np.ndarray, change: np.ndarray, changes: list[tuple[int, str]]):
        self.steps, self.to, self.change, self.changes = steps, to, change, changes

    @classmethod
    def of(cls, rules: Iterable[tuple[str, int, str, int]], rare: int = 1) -> SuffixTrie:
        """From (suffix, cut, add, n); changes seen ``rare`` times or less are left out."""
        nodes: dict[tuple[int, int], int] = {}
        change, changes = [-1], {}
        for suffix, cut, add, n in rules:
            if n <= rare:
                continue
            at = 0
            for c in reversed(suffix):
                if (at, ord(c)) not in nodes:
                    nodes[at, ord(c)] = len(change)
                    change.append(-1)
                at = nodes[at, ord(c)]
            change[at] = changes.setdefault((cut, add), len(changes))
        keys = sorted(nodes)
        return cls(np.array([n << 21 | c for n, c in keys], np.int64), np.array([nodes[k] for k in keys], np.int64), np.array(change), list(changes))

    def lemma(self, word: str) -> str:
        """The word changed as the longest known suffix says that leaves a letter."""
        at, found = 0, -1
        for k, c in enumerate(reversed(word)):
            place = int(np.searchsorted(self.steps, at << 21 | ord(c)))
            if place == len(self.steps) or self.steps[place] != at << 21 | ord(c):
                break
            at = int(self.to[place])
            if self.change[at] >= 0 and self.changes[self.change[at]][0] < len(word):
                found = int(self.change[at])
        if found < 0:
            return word
        cut, add = self.changes[found]
        return word[: len(word) - cut] + add


def told_by_suffix(words: DataFrame, rules: DataFrame) -> DataFrame:
    """word, told: what ``SuffixTrie.lemma`` makes of each distinct word, by a join of its suffixes with the rules; words that
    no rule fits are left out."""
    longest = rules.agg(F.coalesce(F.max(F.length("suffix")), F.lit(0)).alias("_longest"))
    tails = words.select("word").where(F.length("word") > 0).distinct().crossJoin(F.broadcast(longest)).where("_longest > 0")
    tails = tails.select("word", F.explode(F.sequence(F.lit(1), F.least(F.length("word"), F.col("_longest")))).alias("k"))
    met = tails.withColumn("suffix", F.substring("word", -F.col("k"), F.col("k"))).join(rules, "suffix").where(F.col("cut") < F.length("word"))
    best = met.groupBy("word").agg(F.max_by(F.struct("cut", "add"), "k").alias("r"))
    return best.select("word", F.concat(F.substring("word", F.lit(1), F.length("word") - F.col("r.cut")), F.col("r.add")).alias("told"))


def lemmas_of(counts: DataFrame, least: int = 2, most_rules: int = 200_000) -> DataFrame:
    """word, lemma of each row of words (word, n): one that stands in the table with a word it comes of has that; of
    others the ending is told by the changes of suffixes learned from the families of the table. Up to ``most_rules`` of
    them go to the workers as a trie; more are joined by suffix, which tells the same."""
    spark = counts.sparkSession
    families = kept(word_families(counts))
    rules = kept(suffix_rules(families, least=least).where("n > 1"))

    known = families.select(F.col("word").alias("_w"), F.col("lemma").alias("_known"))
    met = counts.select("word").join(known, F.col("word") == F.col("_w"), "left")
    is_lemma = families.select(F.col("lemma").alias("_l")).distinct().withColumn("_own", F.lit(True))
    met = met.join(is_lemma, F.col("word") == F.col("_l"), "left")
    if rules.count() > most_rules:
        told = told_by_suffix(met.where("_known is null and _own is null"), rules)
        met, last = met.join(told.withColumnRenamed("word", "_t"), F.col("word") == F.col("_t"), "left"), F.coalesce("told", "word")
    else:
        trie = spark.sparkContext.broadcast(SuffixTrie.of([tuple(r) for r in rules.collect()]))

        def run(words: pd.Series) -> pd.Series:
            return words.map(trie.value.lemma, na_action="ignore")

        last = F.pandas_udf(run, "string")(F.col("word"))
    return met.select("word", F.coalesce("_known", F.when(F.col("_own"), F.col("word")), last).alias("lemma"))


def stemmed(text: str, lang: str) -> str:
    """The stems of the words that aren't stop words, sorted."""
    found = [w.strip(_TRIM).lower() for w in text.split()]
    return " ".join(sorted(stem(w, lang) for w in found if w and w not in STOP.get(lang, [])))


def lemma_factor(text: Column, lang: str = "en") -> Column:
    """struct<lemmas, residue>."""

    return by_row(lambda t: (None, None) if t is None else lemma_split(t, lang), "lemmas string, residue string")(text)


def recombined(lemmas: Column, residue: Column) -> Column:
    return by_row(lambda x, y: None if x is None or y is None else lemma_combine(x, y), "string")(lemmas, residue)


def stem_text(text: Column, lang: str) -> Column:
    return by_row(lambda t: None if t is None else stemmed(t, lang), "string")(text)
