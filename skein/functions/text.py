"""String functions over columns, all of built-in expressions."""

from __future__ import annotations

import html
import itertools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def by_row(f, kind: str):
    """``f`` of each row, sent to Python a hundred rows at a time; an Arrow batch holds 10,000 texts and all that is made
    of them at once."""
    return F.udf(f, kind, useArrow=False)


def strip_punctuation(text: Column) -> Column:
    """Without the 32 ASCII punctuation characters, lower-cased."""
    return F.lower(F.regexp_replace(text, _PUNCTUATION, ""))


def tokens(text: Column) -> Column:
    """Words between white space after strip_punctuation."""
    return F.filter(F.split(strip_punctuation(text), r"[ \t\r\n]+"), lambda w: w != "")


def hits(words: Column, lexicon: list[str]) -> Column:
    """How many of the words, with multiplicity, are in the lexicon."""
    return F.size(F.filter(words, lambda w: w.isin(lexicon))).cast("long")  # a hash set, however long the lexicon


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ?, marks kept."""
    return F.split(F.regexp_replace(text, r"[.!?]", "$0\n"), "\n")


def polish(text: Column) -> Column:
    """White space to single blanks, straight quotes to backticks, &quot likewise, trimmed."""
    out = F.regexp_replace(F.regexp_replace(text, "[\n\r\t]", " "), "&quot;?", "`")
    out = F.replace(F.replace(out, F.lit('"'), F.lit("``")), F.lit("'"), F.lit("`"))
    return F.trim(F.regexp_replace(out, " +", " "))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def keep_letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-z]", "")


def ascii_replace(text: Column) -> Column:
    """Characters beyond ASCII as ?."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "?")


def keep_visible(text: Column) -> Column:
    """Only code points 40 to 122 but the backslash, and the blank."""
    return F.regexp_replace(text, r"[^ (-\[\]-z]", "")


def remove_quotes(text: Column) -> Column:
    return F.translate(text, "'\"", "")


def prefix_key(text: Column, size: int = 50) -> Column:
    return F.substring(text, 1, size)


def terms(delimited: Column, mark: str = ",") -> Column:
    """Trimmed non-empty terms of a delimited list."""
    return F.filter(F.transform(F.split(delimited, mark), lambda t: F.trim(t)), lambda t: t != "")


def engine_query(include: list[str], exclude: list[str]) -> str:
    """A search engine's query: phrases quoted, excludes with a minus."""
    return " ".join([f'"{t}"' for t in include] + [f'-"{t}"' for t in exclude])


def windows(words: Column, most: int) -> Column:
    """All n-grams of up to ``most`` words, longest first at each start."""
    def of(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>"))
        one = lambda i: F.transform(F.sequence(F.lit(most), F.lit(1), F.lit(-1)), lambda n: F.when(i + n - 1 <= F.size(w), F.array_join(F.slice(w, i, n), " ")))
        return F.filter(F.flatten(F.transform(starts, one)), lambda x: x.isNotNull())

    return F.transform(F.array(words), of)[0]  # the lambda's variable keeps words from being made again at each start


def fill_frame(frame: str, first: Column, second: Column) -> Column:
    """A frame with {1} and {2} filled in, each once."""
    a, b = frame.index("{1}"), frame.index("{2}")
    assert a < b
    return F.concat(F.lit(frame[:a]), first, F.lit(frame[a + 3 : b]), second, F.lit(frame[b + 3 :]))


def template_match(frame: str, text: Column) -> list[Column]:
    """What stands for {1}, {2} and {%} (any text) in a text that fits the frame, literals taken as they are; null each
    where it doesn't fit."""
    pattern, names = "^", []
    for part in re.split(r"(\{[12%]\})", frame):
        if re.fullmatch(r"\{[12%]\}", part):
            pattern += "(.+)" if part != "{%}" else "(.*)"
            names.append(part)
        else:
            pattern += re.sub(r"([^\w\s])", r"\\\1", part)
    pattern += "$"
    fits = text.rlike(pattern)
    return [F.when(fits, F.regexp_extract(text, pattern, names.index(n) + 1)) for n in ("{1}", "{2}")]


def replaced(words: Column, becomes: dict[str, str]) -> Column:
    """Each word or what it becomes."""
    if not becomes:
        return words
    known = F.create_map(*[F.lit(x) for pair in becomes.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.element_at(known, w), w))


def permutations(terms: list[str]) -> list[list[str]]:
    """All orders of the terms."""
    return [list(p) for p in itertools.permutations(terms)]


#: Entities and what they become, in the order they are replaced.
ENTITIES = [("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("%20", " "), ("%2C", ","), ("%3A", ":"), ("%2F", "/"), ("&amp;", "&")]


def without_entities(text: Column) -> Column:
    """Entities and percent codes replaced in order, then only visible characters kept."""
    for entity, becomes in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(becomes))
    return keep_visible(text)


def unescaped(text: Column) -> Column:
    """Named and numbered entities resolved; quotes, dashes, spaces and accents folded to ASCII."""
    folds = str.maketrans({"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "--", "\u00a0": " ", "\u2026": "...", "\u00e6": "ae", "\u0153": "oe", "\u00ab": "<<", "\u00bb": ">>", "\u00a9": "(C)"})

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = unicodedata.normalize("NFD", html.unescape(t).translate(folds))
        return "".join(c for c in plain if not unicodedata.combining(c))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def greedy_snippets(text: Column, term: str, most: int = 2000, least: int = 5) -> Column:
    """Blocks of the sentences with the term (in any case) and the ones beside them, in order and without overlap.

    Sentences of up to ``least`` characters are dropped first; a block takes the sentence before its hit if no block
    has it, the hit and the next sentence, and counts if shorter than ``most`` characters.
    """
    kept = F.filter(F.transform(sentences(text), lambda s: F.trim(s)), lambda s: F.length(s) > least)
    low = term.lower()

    def step(state: Column, s: Column) -> Column:
        # last: the sentence before, unless a block has it; open: a block that still takes the next sentence
        hit = F.lower(s).contains(low)
        ends = state["open"] != ""
        closed = F.concat(state["open"], F.lit(" "), s)
        begun = F.when(state["last"] != "", F.concat(state["last"], F.lit(" "), s)).otherwise(s)
        return F.struct(
            F.when(ends, F.array_append(state["blocks"], closed)).otherwise(state["blocks"]).alias("blocks"),
            F.when(~ends & hit, begun).otherwise("").alias("open"),
            F.when(ends | hit, "").otherwise(s).alias("last"),
        )

    start = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit("").alias("open"), F.lit("").alias("last"))
    end = lambda state: F.when(state["open"] != "", F.array_append(state["blocks"], state["open"])).otherwise(state["blocks"])
    return F.filter(F.aggregate(kept, start, step, end), lambda b: F.length(b) < most)


def placed_windows(rows: DataFrame, words: Column, most: int) -> DataFrame:
    """The columns of ``rows`` with start_at, gram: the n-grams of up to ``most`` words at each place (from 1). Each
    place has its next words beside it, so that no array is cut or joined for an n-gram. Outer, as Spark has a filter
    on an inner one's array, for which it makes the words once more, below any repartition of ``rows``."""
    names, w = rows.columns, F.col("_w")
    beside = F.arrays_zip(w.alias("w1"), *[F.slice(w, n, F.greatest(F.size(w) - n + 1, F.lit(0))).alias(f"w{n}") for n in range(2, most + 1)])
    placed = rows.withColumn("_w", words).select(*names, beside.alias("_z")).select(*names, F.posexplode_outer("_z").alias("_at", "_g"))
    part = [F.col("_g")[f"w{n}"] for n in range(1, most + 1)]
    grams = F.array(*[F.concat(*[x for p in part[:n] for x in (F.lit(" "), p)][1:]) for n in range(most, 0, -1)])  # null where words are too few
    return placed.select(*names, (F.col("_at") + 1).cast("long").alias("start_at"), F.explode(grams).alias("gram")).where("gram is not null")


def snippet(text: Column, term: str, most: int) -> Column:
    """The sentences with the term and those beside them, joined by ellipses and cut to ``most`` characters."""
    hit = lambda s: F.coalesce(F.contains(s, F.lit(term)), F.lit(False))

    def near(all_: Column) -> Column:
        marked = F.transform(all_, lambda s, i: F.struct(F.trim(s).alias("s"), (hit(s) | hit(F.get(all_, i - 1)) | hit(F.get(all_, i + 1))).alias("near")))
        return F.transform(F.filter(marked, lambda m: m["near"]), lambda m: m["s"])

    kept = F.transform(F.array(sentences(text)), near)[0]  # the lambda's variable keeps sentences from being made again
    return F.substring(F.array_join(kept, " ... "), 1, most)


def word_frequency(docs: DataFrame, text: str, stop: list[str]) -> DataFrame:
    words = docs.select(F.explode(tokens(F.col(text))).alias("word")).where(~F.col("word").isin(stop))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def merged_counts(known: DataFrame, fresh: DataFrame) -> DataFrame:
    return known.unionByName(fresh).groupBy("word").agg(F.sum("n").alias("n"))


def tfidf(docs: DataFrame, key: str, text: str, broadcast_words: int = 2_000_000) -> DataFrame:
    """key, word and tfidf: count in the document times the logarithm of (documents / documents that hold the word).

    Words are counted by document once and kept; document frequencies are added up from that table once, with partial
    sums before the shuffle, and broadcast if they are at most ``broadcast_words``, else joined by shuffle (where AQE splits
    the partitions of words that most documents hold).
    """
    from ..operators.order import hinted, written

    total = docs.count()
    counted = written(term_counts(docs, key, F.col(text)))
    df = written(counted.groupBy("word").agg(F.count("*").alias("df")))
    return counted.join(hinted(df, broadcast_words), "word").select(key, "word", (F.col("n") * F.log(F.lit(float(total)) / F.col("df"))).alias("tfidf"))


def term_counts(docs: DataFrame, key: str, text: Column, at_once: int = 8_000_000) -> DataFrame:
    """key, word, n of the words of each key. Texts are dealt by key before they are cut into words, so that counting
    and what follows by key needs no shuffle of words, into parts of about ``at_once`` characters, so that a task's
    counts stay small however many texts there are."""
    chars = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // at_once))
    words = docs.select(key, text.alias("_t")).repartition(parts, key).select(key, F.explode(tokens(F.col("_t"))).alias("word"))
    return words.groupBy(key, "word").agg(F.count("*").alias("n"))


def phrase_query(include: Column, exclude: Column) -> Column:
    """``engine_query`` of two arrays of terms."""
    quoted = lambda terms, mark: F.transform(terms, lambda t: F.concat(F.lit(mark + '"'), t, F.lit('"')))
    return F.array_join(F.concat(quoted(include, ""), quoted(exclude, "-")), " ")


def vote_label(vote: Column, labels: str = "Up,Down") -> Column:
    """One of two labels; the vote itself if there aren't two."""
    both = labels.split(",")
    return F.when(vote == 1, both[0]).otherwise(both[1]) if len(both) == 2 else vote.cast("string")


def vote_message(what: Column, direction: Column) -> Column:
    clear = F.concat(F.lit("Confirm clearing your vote for <strong>"), what, F.lit("</strong>."))
    return F.when(direction == "clear", clear).otherwise(F.concat(F.lit("Confirm <strong>"), direction, F.lit("</strong> vote for <strong>"), what, F.lit("</strong>.")))


def merged_maps(usual: Column, own: Column) -> Column:
    """Both maps' entries; where both have a key, that of ``own``."""
    rest = F.map_filter(usual, lambda k, v: ~F.array_contains(F.map_keys(own), k))
    return F.map_concat(rest, own)
