"""Tokens, stop words, word lists and concepts of a text, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern, what it becomes: applied in this order. Opening and closing quotes become `` and '', clitics and marks stand alone.
_TOKEN_RULES = [
    (r"\r", ""), (r"\n", " "),
    (" '", " ` "), ("'", " '"), ("n 't", " n't"), ("cannot", "can not"),
    ('"([^"]*)"', " `` $1 '' "),
    (r"([.,:;?!%]+)( |$)", " $1 "), (r"([()])", " $1 "),
    (" +", " "),
]
_PLAIN_RULES = [
    ("`` ", '"'), (" ''", '"'),
    (r" \( ", " ("), (r" \) ", ") "),
    (r""" ([.,:;?!%]+)(?=[ '"`]|$)""", "$1"),
    (" '", "'"), (" n't", "n't"), ("can not", "cannot"), (" ` ", " '"),
]


#: Rules without a pattern's signs, which need no search by pattern: what is replaced by what.
_LITERAL = {r"\r": [("\r", "")], r"\n": [("\n", " ")], r"([()])": [("(", " ( "), (")", " ) ")]} | {p: [(p, to)] for p, to in _TOKEN_RULES if re.fullmatch("[a-z ']+", p)}


def tokenize(text: Column) -> Column:
    return F.trim(_by_rules(text, _TOKEN_RULES))


def _by_rules(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, becomes in rules:
        if pattern in _LITERAL:
            for part, instead in _LITERAL[pattern]:
                text = F.replace(text, F.lit(part), F.lit(instead))
        else:
            text = F.regexp_replace(text, pattern, becomes)
    return text


def untokenize(text: Column) -> Column:
    """Tokens as they are written, but for line breaks: the inverse of ``tokenize``."""
    for pattern, becomes in _PLAIN_RULES:
        text = F.regexp_replace(text, pattern, becomes)
    return F.trim(text)


#: Stop words, words not to be concepts, words of frequency, corrections and swaps of our own.
STOP = {"en": ["a", "an", "the", "is", "are", "was", "be", "to", "of", "that", "this", "it", "in", "on"], "de": ["der", "die", "das", "ein"], "fr": ["le", "la", "les", "un", "une"], "es": ["el", "la", "los", "un"]}
BLACKLIST = ["the", "of", "and", "it", "thing"]
FREQUENCY = {"en": ["always", "often", "sometimes", "never", "usually"], "de": ["immer", "oft", "nie"], "fr": ["toujours", "souvent"], "es": ["siempre", "nunca"]}
CORRECT = {"teh": "the", "dont": "don't", "recieve": "receive"}
SWAP = {"i": "person", "me": "person", "you": "person"}
#: Punctuation stripped from the ends of words: all of ASCII but ' - `.
_ENDS = r"""!"#$%&()*+,./:;<=>?@[\]^_{|}~"""


def is_stop(word: Column, lang: str) -> Column:
    return F.lower(word).isin(STOP.get(lang, []))


def is_blacklisted(text: Column) -> Column:
    """Whether every word is on the list; so is a text without words."""
    return F.forall(split_words(F.lower(text)), lambda w: w.isin(BLACKLIST))


def is_frequency(word: Column, lang: str) -> Column:
    return F.lower(word).isin(FREQUENCY.get(lang, []))


def first_frequency(text: Column, lang: str) -> Column:
    return F.get(F.filter(split_words(F.lower(text)), lambda w: w.isin(FREQUENCY.get(lang, []))), F.lit(0))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, " +"), lambda w: w != "")


def words(text: Column, lang: str = "en", strip_stop: bool = False) -> Column:
    """Tokens without punctuation at their ends, lower-case, corrected; stop words left out if asked for."""
    out = split_words(F.replace(_by_rules(text, _TOKEN_RULES[:-1]), F.lit("/"), F.lit(" ")))  # blanks part words, however many
    known = F.create_map(*[F.lit(x) for pair in CORRECT.items() for x in pair])
    bare = lambda w: F.lower(F.btrim(w, F.lit(_ENDS)))
    out = F.transform(F.transform(out, bare), lambda w: F.coalesce(F.element_at(known, w), w))
    return F.filter(out, lambda w: ~w.isin(["", *STOP.get(lang, [])] if strip_stop else [""]))


def concepts(df: DataFrame, text: str, most_words: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """df's columns with concept: the distinct windows of up to most_words words of the normalised text; only those of
    vocabulary (concept) if there is one."""
    from ..functions.text import windows

    rows = df.withColumn("concept", F.explode(F.array_distinct(windows(words(F.col(text), strip_stop=True), most_words))))
    return rows if vocabulary is None else rows.join(vocabulary.select("concept").distinct(), "concept", "left_semi")


def word_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, concept: the distinct words of each text that aren't stop words, and the distinct pairs of words that follow
    each other. Outer, as Spark has a filter on an inner one's array, for which it makes the words once more, below any
    repartition of ``docs``."""
    w = docs.select(key, words(F.col(text), strip_stop=True).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))  # null at the last
    return w.select(key, F.explode_outer(F.concat(F.array_distinct("w"), F.array_distinct(pairs))).alias("concept")).where("concept is not null")


def identity(text: Column) -> Column:
    """Languages without a normaliser keep the text."""
    return text


def scripts(text: Column) -> list[Column]:
    """Whether the text holds hiragana, katakana, kanji, Latin letters, digits."""
    return [text.rlike(p).alias(n) for n, p in (("hiragana", "[぀-ゟ]"), ("katakana", "[゠-ヿ]"), ("kanji", "[一-鿿]"), ("romaji", "[A-Za-z]"), ("digit", "[0-9]"))]
