"""Assertions from tagged sentences by a parsing expression grammar: ordered choice, memoised by rule and place.

A sentence is a list of (word, tag). ``GRAMMAR`` maps a rule to an expression:

    "NN" or "the|a"      one word of that tag (upper case) or one of these words (lower case)
    ("seq", e, ...)      one after the other
    ("first", e, ...)    the first that fits; later ones aren't tried any more
    ("some", e)          one or more, as many as there are;  ("any", e): also none;  ("maybe", e): one or none
    ("not", e)           nothing, if e doesn't fit here
    ("slot", k, e)       e, whose words are concept k of the assertion
    ("is", rule)         another rule

Rules, words and tags are of our own; the relations are those of ``RELATIONS``, tried in order over whole sentences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import hinted, written
from .parse import counted_probabilities, tag_probabilities

Token = tuple[str, str]

_NP, _NP1, _NP2 = ("is", "np"), ("slot", 1, ("is", "np")), ("slot", 2, ("is", "np"))
_VP2, _CLAUSE1 = ("slot", 2, ("is", "vp")), ("slot", 1, ("first", ("is", "gerund"), ("is", "np")))
_BE, _HAVE, _CAN = "is|are|was|were|be", "has|have|had", "can|may|could|will"
_OFTEN = ("any", "RB")

GRAMMAR: dict[str, object] = {
    "det": ("first", "DT", "PRP$"),
    "mod": ("first", "JJ", "VBN", "CD"),
    "noun": ("first", "NN", "NNS", "NNP"),
    "base": ("seq", ("maybe", ("is", "det")), ("any", ("is", "mod")), ("some", ("is", "noun"))),
    "of": ("seq", "of", ("is", "base")),
    "np": ("seq", ("first", ("is", "base"), "PRP"), ("any", ("is", "of"))),
    "pp": ("seq", "IN", ("is", "np")),
    "verb": ("first", "VB", "VBP", "VBZ"),
    "vp": ("seq", _OFTEN, ("is", "verb"), ("maybe", ("is", "np")), ("any", ("is", "pp")), _OFTEN),
    "gerund": ("seq", "VBG", ("maybe", ("is", "np")), ("any", ("is", "pp"))),
    "ap": ("seq", _OFTEN, ("some", "JJ")),
    "past": ("seq", _OFTEN, "VBN", ("any", ("is", "pp"))),
}

#: Relation and what a whole sentence of it looks like, in the order in which they are tried.
RELATIONS: list[tuple[str, object]] = [
    ("HasFirstSubevent", ("seq", "the", "first", "thing", ("any", "RB"), ("maybe", "you|people|they"), "do", "when", _CLAUSE1, _BE, ("slot", 2, ("first", ("is", "vp"), ("is", "np"))))),
    ("HasLastSubevent", ("seq", "the", "last", "thing", ("maybe", "you|people|they"), "do", "when", _CLAUSE1, _BE, ("slot", 2, ("first", ("is", "vp"), ("is", "np"))))),
    ("HasPrerequisite", ("seq", _CLAUSE1, "requires|needs|require|need", _NP2)),
    ("HasSubevent", ("seq", _CLAUSE1, "includes|involves|include|involve", ("slot", 2, ("first", ("is", "gerund"), ("is", "np"))))),
    ("MotivatedByGoal", ("seq", _CLAUSE1, _BE, "done", "to|for", ("slot", 2, ("first", ("is", "vp"), ("is", "np"))))),
    ("CausesDesire", ("seq", _CLAUSE1, "makes", "you|people|them", "want", "to", _VP2)),
    ("Causes", ("seq", _CLAUSE1, _OFTEN, "causes|cause|brings|bring", _NP2)),
    ("Desires", ("seq", _NP1, _OFTEN, "wants|want|wanted|likes|like", ("maybe", "to"), ("slot", 2, ("first", ("is", "vp"), ("is", "np"))))),
    ("CreatedBy", ("seq", _NP1, _BE, "made|built|created|written", "by", _NP2)),
    ("MadeOf", ("seq", _NP1, _BE, "made", "of|from", _NP2)),
    ("UsedFor", ("first", ("seq", _NP1, _BE, ("maybe", "used"), "for", ("slot", 2, ("first", ("is", "gerund"), ("is", "np")))), ("seq", _NP1, _BE, "used", "to", _VP2))),
    ("PartOf", ("seq", _NP1, _BE, ("maybe", ("seq", ("maybe", "a"), "part")), "of", _NP2)),
    ("DefinedAs", ("seq", _NP1, _BE, "defined|known", "as", _NP2)),
    ("LocatedNear", ("seq", _NP1, _BE, "near|by|beside", _NP2)),
    ("AtLocation", ("first", ("seq", _NP1, _BE, _OFTEN, "in|on|at|inside", _NP2), ("seq", "there", _BE, _NP1, "in|on|at", _NP2))),
    ("ReceivesAction", ("seq", _NP1, ("first", ("seq", _CAN, "be"), _BE), ("slot", 2, ("is", "past")))),
    ("CapableOf", ("seq", _NP1, _OFTEN, _CAN, _VP2)),
    ("HasProperty", ("seq", _NP1, _BE, ("slot", 2, ("is", "ap")))),
    ("HasA", ("seq", _NP1, ("first", _HAVE, "with"), _NP2)),
    ("IsA", ("seq", _NP1, _OFTEN, _BE, _OFTEN, _NP2)),
]


class Packrat:
    """One sentence's memo: (rule, place) to (end, slots) or None."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.memo = tokens, {}

    def fits(self, e, at: int):
        """(end, slots as (k, start, end)) if ``e`` fits at a place, else None."""
        if isinstance(e, str):
            if at >= len(self.tokens):
                return None
            word, tag = self.tokens[at]
            return (at + 1, ()) if (tag == e if e.isupper() or e.endswith("$") else word.lower() in e.split("|")) else None
        kind = e[0]
        if kind == "is":
            key = (e[1], at)
            if key not in self.memo:
                self.memo[key] = self.fits(GRAMMAR[e[1]], at)
            return self.memo[key]
        if kind == "first":
            return next((found for part in e[1:] if (found := self.fits(part, at)) is not None), None)
        if kind == "not":
            return (at, ()) if self.fits(e[1], at) is None else None
        if kind == "slot":
            found = self.fits(e[2], at)
            return found and (found[0], (*found[1], (e[1], at, found[0])))
        if kind == "seq":
            slots: tuple = ()
            for part in e[1:]:
                found = self.fits(part, at)
                if found is None:
                    return None
                at, slots = found[0], slots + found[1]
            return at, slots
        many, slots = 0, ()
        while (kind != "maybe" or not many) and (found := self.fits(e[1], at)) is not None and found[0] > at:
            at, slots, many = found[0], slots + found[1], many + 1
        return None if kind == "some" and not many else (at, slots)


def assertion(tokens: list[Token]) -> tuple[str, str, str] | None:
    """relation, concept 1 and 2 of the first relation that fits the whole sentence."""
    memo = Packrat(tokens)
    for relation, e in RELATIONS:
        found = memo.fits(e, 0)
        if found and found[0] == len(tokens):
            said = {k: " ".join(w for w, _ in tokens[a:b]) for k, a, b in found[1]}
            return relation, said[1], said[2]
    return None


#: Words whose tag is fixed, and what an open word is likely to be: after a word of a tag, and by its ending.
CLOSED = {
    "DT": "a an the this that these those some any every no",
    "PRP": "it he she we they you i",
    "PRP$": "his her its our their your my",
    "IN": "of in on at by with for from near beside inside into over under as",
    "TO": "to",
    "CC": "and or but",
    "MD": "can may could will would should must",
    "BE": "is are was were be been am",
    "RB": "not very often never always usually",
    "WH": "when where who what which there",
}
AFTER = {"DT": "NN", "PRP$": "NN", "IN": "NN", "TO": "VB", "MD": "VB", "PRP": "VBP"}
ENDINGS = [("ing", "VBG"), ("ed", "VBN"), ("ly", "RB"), ("ful", "JJ"), ("less", "JJ"), ("ous", "JJ"), ("able", "JJ"), ("ble", "JJ"), ("al", "JJ"), ("s", "NNS")]


def cut(docs: DataFrame, id_name: str, text: str) -> DataFrame:
    """id, sentence (number) and words of every sentence: text cut after . ! ? and at line ends; words without the signs
    around them, empty ones too. Null texts have none. Texts are dealt by id, so that sentences stay where they are."""
    said = F.filter(F.split(text, r"(?<=[.!?])\s+|[\r\n]+"), lambda s: F.length(F.trim(s)) > 0)
    rows = docs.select(id_name, text).repartition(id_name).select(id_name, F.posexplode(said).alias("sentence", "said"))
    words = F.filter(F.split("said", r"\s+"), lambda w: w != "")
    return rows.select(id_name, "sentence", F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("words"))


def sentences(docs: DataFrame, id_name: str, text: str) -> DataFrame:
    """id, sentence (number), place and word of every word of ``cut``."""
    return cut(docs, id_name, text).select(id_name, "sentence", F.posexplode("words").alias("place", "word")).where("word <> ''")


def tagged(words: DataFrame, id_name: str, smooth: float = 0.1) -> DataFrame:
    """words with tag: fixed ones of closed classes; of open words the likeliest of the whole table, by how often their
    neighbours and endings say so (``tag_probabilities``), whatever stands around them here."""
    closed = {w: t for t, ws in CLOSED.items() for w in ws.split()}
    known = F.create_map(*[F.lit(x) for pair in closed.items() for x in pair])
    low = F.lower("word")
    rows = words.withColumn("_closed", F.element_at(known, low))
    before = F.lag("_closed").over(Window.partitionBy(id_name, "sentence").orderBy("place"))
    ending = F.coalesce(*[F.when(low.endswith(e) & (F.length(low) > len(e) + 2), t) for e, t in ENDINGS], F.lit("NN"))
    after = F.element_at(F.create_map(*[F.lit(x) for pair in AFTER.items() for x in pair]), F.col("_before"))
    after_be = F.when((F.col("_before") == "BE") & ending.isin("NN", "NNS"), "JJ")
    told = rows.withColumn("_before", before)
    told = told.withColumn("_said", F.when(F.col("_closed").isNull(), F.when((after == "NN") & (ending == "NNS"), "NNS").otherwise(F.coalesce(after_be, after, ending))))
    seen = told.where("_said is not null").select(low.alias("word"), F.col("_said").alias("tag"))
    best = tag_probabilities(seen, [], smooth).groupBy("word").agg(F.max_by("tag", F.struct("n", "p", "tag")).alias("_best"))
    met = told.withColumn("_low", F.when(F.col("_closed").isNull(), low)).join(best.withColumnRenamed("word", "_low"), "_low", "left")
    return met.select(id_name, "sentence", "place", "word", F.coalesce("_closed", "_best").alias("tag"))


def assertions(tokens: DataFrame, id_name: str) -> DataFrame:
    """id, sentence, relation, text1, text2 of each sentence (rows id, sentence, place, word, tag) that an assertion is in."""
    whole = tokens.groupBy(id_name, "sentence").agg(F.array_sort(F.collect_list(F.struct("place", "word", "tag"))).alias("tokens"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, s, *a) for i, s, ts in zip(frame[id_name], frame.sentence, frame.tokens) if (a := assertion([(t["word"], t["tag"]) for t in ts]))]
            yield pd.DataFrame(found, columns=[id_name, "sentence", "relation", "text1", "text2"])

    kind = tokens.schema[id_name].dataType.simpleString()
    return whole.mapInPandas(run, f"`{id_name}` {kind}, sentence int, relation string, text1 string, text2 string")


def _parts(e) -> Iterator[str]:
    """All words and tags of an expression."""
    if isinstance(e, str):
        yield from [e] if e.isupper() or e.endswith("$") else e.split("|")
    else:
        for part in e[1:] if e[0] not in ("is", "slot") else [GRAMMAR[e[1]] if e[0] == "is" else e[2]]:
            yield from _parts(part)


def _needs(e) -> list[frozenset[str]]:
    """Sets of words of each of which whatever fits ``e`` holds one."""
    if isinstance(e, str):
        return [] if e.isupper() or e.endswith("$") else [frozenset(e.split("|"))]
    if e[0] == "seq":
        return [need for part in e[1:] for need in _needs(part)]
    if e[0] == "first":
        ways = [_needs(way) for way in e[1:]]
        return [frozenset().union(*(way[0] for way in ways))] if all(ways) else []
    return _needs(e[2]) if e[0] == "slot" else _needs(e[1]) if e[0] == "some" else []


_CLOSED = {w: t for t, ws in CLOSED.items() for w in ws.split()}
#: What a sentence needs for some relation, and words that nothing in the grammar takes: their tags are fixed.
_NEEDED = [_needs(way) for _, e in RELATIONS for way in (e[1:] if e[0] == "first" else [e])]
_TAKEN = {part for _, e in RELATIONS for part in _parts(e)}
_NEVER = frozenset(w for w, t in _CLOSED.items() if w not in _TAKEN and t not in _TAKEN)


def may_fit(words: list[str]) -> bool:
    """Whether a sentence of lower-case words holds what some relation needs, and no word that none can take."""
    held = set(words)
    return held.isdisjoint(_NEVER) and any(all(not held.isdisjoint(need) for need in needs) for needs in _NEEDED)


def _said_of(words: list[str]) -> Iterator[tuple[str, str]]:
    """Each open word of a lower-case sentence and what its neighbour and ending say of it: see ``tagged``."""
    before = None
    for word in words:
        tag = _CLOSED.get(word)
        if tag is None:
            ending = next((t for e, t in ENDINGS if word.endswith(e) and len(word) > len(e) + 2), "NN")
            after = AFTER.get(before)
            if after == "NN" and ending == "NNS":
                yield word, "NNS"
            elif before == "BE" and ending in ("NN", "NNS"):
                yield word, "JJ"
            else:
                yield word, after or ending
        before = tag


def assertions_of(docs: DataFrame, id_name: str, text: str, smooth: float = 0.1, at_once: int = 100_000, broadcast_words: int = 2_000_000) -> DataFrame:
    """``assertions`` of the sentences of all texts, their words ``tagged`` by the whole table.

    One pass over the sentences adds up what is said of words, ``at_once`` of them at a time, and lets sentences go that
    no relation can fit (``may_fit``); only words of the others are joined with their tags."""
    words = cut(docs, id_name, text).select(id_name, "sentence", F.array_join(F.filter("words", lambda w: w != ""), " ").alias("said"))
    kind = docs.schema[id_name].dataType
    schema = f"`{id_name}` {kind.simpleString()}, sentence int, said string, low string, word string, tag string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def counted(like: pa.RecordBatch) -> pa.RecordBatch:
            none = [pa.nulls(len(seen), t) for t in (like.column(id_name).type, pa.int32(), pa.string(), pa.string())]
            pairs = [pa.array([k[i] for k in seen], pa.string()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*none, *pairs, pa.array(list(seen.values()), pa.int64())], [id_name, "sentence", "said", "low", "word", "tag", "n"])

        batch = None
        for batch in batches:
            lows, places = batch.column("low"), []
            for place, low in enumerate(lows.to_pylist()):
                if low:
                    parts = low.split(" ")
                    seen.update(_said_of(parts))
                    if may_fit(parts):
                        places.append(place)
            fit = batch.take(pa.array(places, pa.int64()))
            none = [pa.nulls(len(places), t) for t in (pa.string(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([fit.column(id_name), fit.column("sentence"), fit.column("said"), fit.column("low"), *none], [id_name, "sentence", "said", "low", "word", "tag", "n"])
            if len(seen) > at_once:
                yield counted(batch)
                seen.clear()
        if seen:
            yield counted(batch)

    both = written(words.withColumn("low", F.lower("said")).mapInArrow(run, schema))
    counts = both.where("n is not null").groupBy("word", "tag").agg(F.sum("n").alias("n"))
    best = written(counted_probabilities(counts, smooth).groupBy("word").agg(F.max_by("tag", F.struct("n", "p", "tag")).alias("_best")).withColumnRenamed("word", "low"))
    known = F.create_map(*[F.lit(x) for pair in _CLOSED.items() for x in pair])
    placed = F.posexplode(F.arrays_zip(F.split("said", " ").alias("word"), F.split("low", " ").alias("low"))).alias("place", "w")
    tokens = both.where("n is null").select(id_name, "sentence", placed).select(id_name, "sentence", "place", F.col("w.word").alias("word"), F.col("w.low").alias("low"))
    met = tokens.join(hinted(best, broadcast_words), "low", "left")
    return assertions(met.select(id_name, "sentence", "place", "word", F.coalesce(F.element_at(known, F.col("low")), "_best").alias("tag")), id_name)
