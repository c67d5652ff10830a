"""License scans as an exact set-similarity join, in DataFrame operations only.

Text blocks are joined with license templates where a block holds at least ``containment`` of the template's distinct
words. Blocks are the lines, and of texts of several lines also all windows of as many consecutive words as the template
has, across line ends, so that wrapped notices are found. Words are put in one global order, rare ones first, by the number of documents that hold them (counted
over the whole table for the words of the templates; no other word can match). With T words in a template and t needed:

* prefix filter: a block that qualifies holds one of the template's first T - t + 1 words, and that word is among the
  block's first B - t + 1 template words;
* length filter: B >= t;
* positional filter: from a match at place i of the template and j of the block, 1 + min(T - i - 1, B - j - 1) >= t.

For windows, those around a prefix word are looked at, where the words near it pass the length filter.

Pairs that pass are verified on whole sets. The index of template prefixes comes from the constants below, so its
size is fixed and it is broadcast; no block is shuffled, only the labels found are.

Apart from that, base phrases are looked up as consecutive words. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
of the text with A-Z lower-cased. Null texts count as empty (n_words 0); repeated rows, also those of one doc_id with
other texts, keep a row each; other columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices as their words, with their labels.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-4", "licensed under a creative commons attribution 4 0 international license"),
    ("reserved", "copyright all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
]
#: One or more characters outside words, each listed: a list of characters is looked up in a bit set, ranges are tried in turn.
_GAP = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def pieces(text: Column) -> Column:
    """The words in order, with an empty string before or after them where the text starts or ends outside a word."""
    return F.split(text, _GAP, -1)


def words(text: Column) -> Column:
    return F.array_remove(pieces(text), "")


def word_count(text: Column) -> Column:
    """Number of words; the lambda's variable keeps the text from being split again for each use."""
    count = lambda a: F.size(a) - (a[0] == "").cast("int") - ((F.size(a) > 1) & (F.element_at(a, -1) == "")).cast("int")
    return F.transform(F.array(pieces(text)), count)[0]


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of rows that hold each word of the vocabulary, which has a fixed size."""
    # lower() serves here: the counts only order words, and any one order gives the same matches.
    held = F.array_intersect(pieces(F.lower("text")), _strings(vocabulary))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in counts.collect()}


def _holds_any(low: Column, parts: list[str]) -> Column:
    """Whether the text holds one of the parts; the lambda's variable keeps it from being lower-cased for each."""
    return F.exists(F.array(low), lambda text: F.exists(_strings(parts), lambda part: F.contains(text, part)))


def _may_hold(low: Column, phrases) -> Column:
    """Whether all words of some phrase are somewhere in the lower-cased text."""
    wanted = F.array(*[_strings(p.split()) for p in phrases])
    return F.exists(F.array(low), lambda text: F.exists(wanted, lambda parts: F.forall(parts, lambda part: F.contains(text, part))))


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = 0.8) -> DataFrame:
    """doc_id, text_hash, block (line from 0; null for windows), label, share for each block and template that meet."""
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    count = document_frequency(docs, vocabulary)
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (count[w], w)))}
    index = []
    for k, (_, ws) in enumerate(sets):
        need = math.ceil(containment * len(ws) - 1e-9)
        ws.sort(key=order.get)
        index += [(w, k, i, len(ws), need) for i, w in enumerate(ws[: len(ws) - need + 1])]
    spark = docs.sparkSession
    names = ("word", "template", "i", "of", "need")
    index_rows = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in index])))
    heads = sorted({r[0] for r in index})
    near = docs.where(_holds_any(F.lower("text"), heads))
    blocks = near.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("block", "line"))
    blocks = blocks.where(_holds_any(F.lower("line"), heads))
    rank = F.create_map(*[F.lit(x) for w, i in order.items() for x in (w, i)])
    held = F.array_intersect(pieces(ascii_lower(F.col("line"))), _strings(vocabulary))
    placed = F.array_sort(F.transform(held, lambda w: F.struct(F.element_at(rank, w).alias("rank"), w.alias("word"))))
    blocks = blocks.select("doc_id", "text_hash", "block", F.transform(placed, lambda s: s["word"]).alias("held"))
    least = min(r[4] for r in index)
    blocks = blocks.where(F.size("held") >= least)
    met = blocks.select("*", F.posexplode("held").alias("j", "word")).join(F.broadcast(index_rows), "word")
    room = 1 + F.least(F.col("of") - F.col("i") - 1, F.size("held") - F.col("j") - 1)
    met = met.where((F.size("held") >= F.col("need")) & (F.col("j") <= F.size("held") - F.col("need")) & (room >= F.col("need")))
    pick = lambda values: F.element_at(F.array(*values), F.col("template") + 1)
    shared = F.size(F.array_intersect("held", pick([_strings(ws) for _, ws in sets])))
    met = met.select("doc_id", "text_hash", "block", pick([F.lit(label) for label, _ in sets]).alias("label"), shared.alias("shared"), "need", "of")
    found = met.where(F.col("shared") >= F.col("need")).select("doc_id", "text_hash", "block", "label", (F.col("shared") / F.col("of")).alias("share"))
    windows = _window_matches(near.where(F.contains("text", F.lit("\n"))), templates, sets, index, index_rows)
    return found.unionByName(windows.select("doc_id", "text_hash", F.lit(None).cast("int").alias("block"), "label", "share")).distinct()


def _window_matches(docs: DataFrame, templates, sets, index, index_rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, label, share for each template and the best window around each of its prefix words."""
    vocabulary = sorted({w for _, ws in sets for w in ws})
    need = {k: n for _, k, _, _, n in index}
    sizes = [len(text.split()) for _, text in templates]
    reach = max(sizes)

    def enough(held: Column) -> Column:
        out = F.lit(False)
        for k, (_, ws) in enumerate(sets):
            out = out | (F.size(F.array_intersect(held, _strings(ws))) >= need[k])
        return out

    # Only texts that hold enough words of some template are taken apart.
    docs = docs.where(F.exists(F.array(F.array_intersect(pieces(F.lower("text")), _strings(vocabulary))), enough))
    placed = F.transform(pieces(ascii_lower(F.col("text"))), lambda w, at: F.struct(at.alias("at"), w.alias("word")))
    held = F.filter(placed, lambda s: F.array_contains(_strings(vocabulary), s["word"]))
    heads = _strings(sorted({r[0] for r in index}))
    # Each prefix word keeps only the template words near it, so that rows stay small in long texts.
    beside = lambda h: F.filter(
        F.transform(h, lambda s, j: F.struct(s["word"].alias("word"), F.slice(h, F.greatest(F.lit(1), j + 2 - reach), F.lit(2 * reach)).alias("near"))),
        lambda s: F.array_contains(heads, s["word"]))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.flatten(F.transform(F.array(held), beside))).alias("hit"))
    met = rows.select("doc_id", "text_hash", "hit.word", "hit.near").join(F.broadcast(index_rows), "word")
    pick = lambda values: F.element_at(F.array(*values), F.col("template") + 1)
    met = met.withColumn("words", pick([_strings(ws) for _, ws in sets])).withColumn("size", pick([F.lit(n) for n in sizes]))
    met = met.withColumn("near", F.filter("near", lambda s: F.array_contains("words", s["word"]))).where(F.size("near") >= F.col("need"))
    within = lambda a: F.filter("near", lambda b: (b["at"] >= a["at"]) & (b["at"] < a["at"] + F.col("size")))
    shared = F.array_max(F.transform("near", lambda a: F.size(F.array_distinct(F.transform(within(a), lambda b: b["word"])))))
    met = met.select("doc_id", "text_hash", pick([F.lit(label) for label, _ in sets]).alias("label"), shared.alias("shared"), "need", "of")
    return met.where(F.col("shared") >= F.col("need")).select("doc_id", "text_hash", "label", (F.col("shared") / F.col("of")).alias("share"))


def _stands(parts: list[str]):
    """Whether the words from place i of array column w are ``parts``."""

    def check(i: Column) -> Column:
        out = F.get("w", i) == parts[0]
        for n, part in enumerate(parts[1:], 1):
            out = out & (F.get("w", i + n) == part)
        return out

    return check


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    gapped = "|".join(_GAP.join(p.split()) for p in PHRASES)
    maybe = _may_hold(F.lower("text"), PHRASES) & F.col("text").rlike(f"(?i)({gapped})")
    base = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).cast("long").alias("n_words"),
                       F.when(maybe, words(ascii_lower(F.col("text")))).otherwise(F.array().cast("array<string>")).alias("w"))
    for k, phrase in enumerate(PHRASES):
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0))), _stands(phrase.split()))
        base = base.withColumn(f"p{k}", F.when(F.size("w") > 0, places).otherwise(F.array().cast("array<int>")))
    found = [F.col(f"p{k}") for k in range(len(PHRASES))]
    labels = F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(found, PHRASES.values())]), lambda x: x.isNotNull())
    every = F.concat(*found)
    base = base.select("doc_id", "text_hash", "n_words", F.size(every).cast("long").alias("n_base"),
                       F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("labels"))
    more = template_matches(rows).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    more = more.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    out = base.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    empty = F.array().cast("array<string>")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("labels")).alias("base_labels"),
        joined(F.concat("labels", F.coalesce("more", empty))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
