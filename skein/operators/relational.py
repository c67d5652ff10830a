"""Filters, joins, aggregates, ranking, sets and merges as DataFrame -> DataFrame functions."""

from __future__ import annotations

import itertools
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def include_exclude(df: DataFrame, text: Column, include: list[str], exclude: list[str], all_of: bool = True, least: int = 0) -> DataFrame:
    """Rows whose text holds all (or any) of the include terms and none of the exclude terms, in any case."""
    low = F.lower(text)
    found = [low.contains(t.lower()) for t in include]
    ok = F.lit(True)
    if found:
        ok = found[0]
        for f in found[1:]:
            ok = ok & f if all_of else ok | f
    for t in exclude:
        ok = ok & ~low.contains(t.lower())
    return df.where(ok & (F.length(text) >= least))


def without(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def top_rows(df: DataFrame, by: list, n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def page(df: DataFrame, by: list, number: int, size: int) -> DataFrame:
    """Rows of page ``number`` (from 1) in a total order."""
    return df.orderBy(*by).offset((number - 1) * size).limit(size)


def best_of(df: DataFrame, keys: list[str], by: list, n: int = 1) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_nth") <= n).drop("_nth")


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: bool = True) -> DataFrame:
    """Rows of both by key; where both have one, that of ``new`` if overwrite, else of ``old``."""
    first, second = (new, old) if overwrite else (old, new)
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All child rows of a parent in ``new`` take the place of its rows in ``old``."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def last_vote(votes: DataFrame, order: list) -> DataFrame:
    """The last vote of each user on an object; a vote of 0 deletes."""
    return best_of(votes, ["user_id", "object_type"], order).where("vote <> 0")


def vote_scores(votes: DataFrame, keys: list[str]) -> DataFrame:
    return votes.groupBy(*keys).agg(F.coalesce(F.sum("vote"), F.lit(0)).cast("long").alias("score"), F.count("vote").alias("num_votes"))


def round_robin(sources: dict[str, DataFrame], order: str) -> DataFrame:
    """One row of each source in turn until all are exhausted: columns plus source and turn."""
    from .order import numbered

    out = None
    for name, df in sources.items():
        mine = numbered(df.withColumn("source", F.lit(name)), [F.col(order)], "turn")
        out = mine if out is None else out.unionByName(mine)
    return out


def expand_links(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """url, depth of every url within ``depth`` links of the seeds; links (url, target), seeds (url).

    Links are kept once by url; each round's frontier is kept too, so that rounds don't repeat those before.
    """
    from .order import kept

    links = kept(links.select("url", "target").distinct())
    reached = frontier = kept(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        step = links.join(frontier.select("url"), "url").select(F.col("target").alias("url")).distinct()
        frontier = kept(step.join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached


def all_in(text: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for term in terms:
        out = out & text.contains(term)
    return out


def any_in(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def first_visible(df: DataFrame, rules: dict[str, int]) -> DataFrame:
    """Rows that some rule (an SQL condition) shows, once, with the least priority of these rules."""
    priority = F.least(*[F.when(F.expr(rule), p) for rule, p in rules.items()])
    return df.withColumn("priority", priority).where("priority is not null")


def cascade(gone: DataFrame, levels: list[tuple[str, DataFrame, str, str]]) -> dict[str, DataFrame]:
    """What is left of each level (name, rows, key to the level above, own key) when the rows of ``gone`` go, and with
    them all below."""
    left = {}
    for name, rows, above, own in levels:
        keys = gone.toDF(above)
        left[name] = rows.join(keys, above, "left_anti")
        gone = rows.join(keys, above, "left_semi").select(own).distinct()
    return left


def bulk(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows with these ids; ids without a row are dropped."""
    return df.join(ids.distinct(), on, "left_semi")


def pairs(df: DataFrame, key: str, value: str, ordered: bool = False) -> DataFrame:
    """a, b: values of all pairs of rows with different keys (both ways) or with the first key smaller. The result has
    the square of the rows by definition, so this is for short lists."""
    x, y = df.alias("x"), df.alias("y")
    on = F.col(f"x.{key}") != F.col(f"y.{key}") if ordered else F.col(f"x.{key}") < F.col(f"y.{key}")
    return x.join(y, on).select(F.col(f"x.{value}").alias("a"), F.col(f"y.{value}").alias("b"))


def permuted(df: DataFrame, column: str) -> DataFrame:
    """A row for each order of the array in ``column``."""
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: [list(p) for p in itertools.permutations(x)])

    return df.withColumn(column, F.explode(F.pandas_udf(run, "array<array<string>>")(F.col(column))))


def rolled_up(specs: DataFrame, key: str, delimited: str, limit: str) -> DataFrame:
    """key, terms (distinct, trimmed, sorted, of all its comma lists) and most (the greatest limit)."""
    from ..functions.text import terms

    rows = specs.select(key, limit, F.explode_outer(terms(F.col(delimited))).alias("term"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("terms"), F.max(limit).alias("most"))


def best_of_few(df: DataFrame, keys: list[str], by: list, n: int, parts: int = 64) -> DataFrame:
    """``best_of`` where groups are few and large: first the best n of each of ``parts`` parts of a group."""
    part = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(parts))
    return best_of(best_of(df.withColumn("_part", part), [*keys, "_part"], by, n), keys, by, n).drop("_part")


def clamped(asked: int | None, most: int, usual: int) -> int:
    """A limit between 1 and ``most``; ``usual`` if none or less is asked for."""
    return usual if asked is None or asked < 1 else min(asked, most)


def clamped_page(df: DataFrame, by: list, number: int, size: int) -> DataFrame:
    """The rows of a page, its number put between the first and the last one there is, with page, total, has_next and
    has_last. The total is counted first, as it says which page that is."""
    total = df.count()
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    extra = {"page": F.lit(number).cast("long"), "total": F.lit(total).cast("long"), "has_next": F.lit(number < last), "has_last": F.lit(number > 1)}
    return page(df, by, number, size).withColumns(extra)


def best_frame(df: DataFrame, said: str, frames: list[tuple[int, str, int]]) -> DataFrame:
    """df with frame_id, first and second of the best frame (id, template, goodness) that its text fits; rows that fit
    none are left out."""
    from ..functions.text import template_match

    tried = []
    for frame_id, template, _ in sorted(frames, key=lambda f: (-f[2], f[0])):
        first, second = template_match(template, F.col(said))
        tried.append(F.when(first.isNotNull(), F.struct(F.lit(frame_id).alias("frame_id"), first.alias("first"), second.alias("second"))))
    return df.withColumn("_fit", F.coalesce(*tried)).where("_fit is not null").select(*df.columns, "_fit.*")


def known_in_any_case(df: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    keys = known.select(F.lower(name).alias("_known")).distinct()
    return df.join(keys, F.lower(F.col(column)) == F.col("_known"), "left_semi")


def newest_of_near_urls(df: DataFrame, key: str, url: str) -> DataFrame:
    """The greatest key of each group of URLs of one host and query whose paths are the same but for .htm or .html."""
    from ..functions import url as U

    p = U.parts(F.col(url))
    return df.groupBy(p["host"], p["query"], U.without_extension(p["path"])).agg(F.max(key).alias(key))


#: Words of SQL that terms of a search may not be.
SQL_WORDS = ["select", "drop", "insert", "delete", "update", "and", "or", "not"]


def cleaned_terms(df: DataFrame, column: str) -> DataFrame:
    """term: the distinct terms of all arrays, without words of SQL and empty ones."""
    rows = df.select(F.explode(column).alias("term"))
    return rows.where(~F.col("term").isin([*SQL_WORDS, ""])).distinct()


def assertions_of(raw: DataFrame) -> DataFrame:
    """relation, concept1, concept2, assertion_id (least raw_id), creators and score (each creator's last vote) from raw
    assertions (raw_id, user_id, relation, concept1, concept2, vote)."""
    what = ["relation", "concept1", "concept2"]
    one = raw.groupBy(*what, "user_id").agg(F.min("raw_id").alias("raw_id"), F.max_by("vote", "raw_id").alias("vote"))
    return one.groupBy(*what).agg(F.min("raw_id").alias("assertion_id"), F.count("*").alias("creators"), F.sum("vote").alias("score"))


def written(raw: DataFrame) -> dict[str, DataFrame]:
    """What writing raw assertions (raw_id, user_id, sentence, relation, concept1, concept2, vote) makes, each once:

    sentences: sentence_id (the least raw_id that says it), sentence, user_id of that one
    raw: raw_id (the least of a user's same sentence and same assertion), user_id, sentence_id, assertion_id
    assertions: assertion_id (the least raw_id), relation, concept1, concept2, score (sum of votes)
    votes: user_id, assertion_id, vote: each user's last one, unless it is 0, which takes a vote back
    events: object (of the four kinds), object_id, user_id: one for each object made

    Nulls in relation, concepts, sentence and user are values like others; a null vote is none.
    """
    what, key = ["relation", "concept1", "concept2"], ["user_id", "relation", "concept1", "concept2", "sentence"]
    first = lambda rows, by, name: rows.groupBy(*by).agg(F.min(F.struct("raw_id", "user_id")).alias("_f")).select(*by, F.col("_f.raw_id").alias(name), F.col("_f.user_id").alias("_by"))
    sentences = first(raw, ["sentence"], "sentence_id")
    made = first(raw, what, "assertion_id")
    same = lambda left, right, by: reduce(lambda x, y: x & y, [left[c].eqNullSafe(right["_" + c]) for c in by])
    under = lambda rows, by: rows.withColumnsRenamed({c: "_" + c for c in by}).drop("_by")
    rows = raw.groupBy(*key).agg(F.min("raw_id").alias("raw_id"), F.max_by("vote", F.when(F.col("vote").isNotNull(), F.col("raw_id"))).alias("vote"), F.max(F.when(F.col("vote").isNotNull(), F.col("raw_id"))).alias("_voted"))
    for table, by in ((under(sentences, ["sentence"]), ["sentence"]), (under(made, what), what)):
        rows = rows.join(table, same(rows, table, by), "left").drop(*["_" + c for c in by])
    votes = rows.where("_voted is not null").groupBy("user_id", "assertion_id").agg(F.max_by("vote", "_voted").alias("vote")).where("vote <> 0")
    scores = votes.groupBy(F.col("assertion_id").alias("_id")).agg(F.sum("vote").alias("score"))
    assertions = made.join(scores, F.col("assertion_id") == F.col("_id"), "left").select("assertion_id", *what, F.coalesce("score", F.lit(0)).alias("score"), "_by")
    out = {
        "sentences": sentences.select("sentence_id", "sentence", F.col("_by").alias("user_id")),
        "raw": rows.select("raw_id", "user_id", "sentence_id", "assertion_id"),
        "assertions": assertions.drop("_by"),
        "votes": votes,
    }
    said = lambda rows, kind, key, user: rows.select(F.lit(kind).alias("object"), F.col(key).alias("object_id"), F.col(user).alias("user_id"))
    events = said(sentences, "sentence", "sentence_id", "_by").unionByName(said(assertions, "assertion", "assertion_id", "_by"))
    events = events.unionByName(said(out["raw"], "raw", "raw_id", "user_id")).unionByName(said(votes, "vote", "assertion_id", "user_id"))
    return out | {"events": events}


def merged_concepts(raw: DataFrame, same: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw assertions with concepts found to be one: ``same`` (a, b) ties concepts, each of which becomes the smallest of
    those it is tied to, over any number of steps. Returns the re-pointed rows (as they were, where nothing is tied) and
    an audit (raw_id, old1, old2, new1, new2) of those that changed."""
    from .components import connected
    from .order import kept

    top = kept(connected(same))
    rows = raw
    for k in ("1", "2"):
        mine = top.select(F.col("node").alias("_node"), F.col("label").alias(f"_new{k}"))
        rows = rows.join(mine, F.col(f"concept{k}") == F.col("_node"), "left").drop("_node")
    new = [F.coalesce(f"_new{k}", f"concept{k}").alias(f"new{k}") for k in ("1", "2")]
    rows = kept(rows.select(*raw.columns, *new))
    moved = ~(F.col("new1").eqNullSafe(F.col("concept1")) & F.col("new2").eqNullSafe(F.col("concept2")))
    audit = rows.where(moved).select("raw_id", F.col("concept1").alias("old1"), F.col("concept2").alias("old2"), "new1", "new2")
    return rows.withColumns({"concept1": F.col("new1"), "concept2": F.col("new2")}).select(*raw.columns), audit


def appended(log: DataFrame, events: DataFrame) -> DataFrame:
    return log.unionByName(events)


def merged_by_etag(old: DataFrame, new: DataFrame, key: str, etag: str, value: str) -> DataFrame:
    """Old rows with changed and new ones in their place, and delta, what ``value`` changed by."""
    was = old.select(F.col(key).alias("_k"), F.col(etag).alias("_e"), F.col(value).alias("_v"))
    rows = new.join(was, F.col(key) == F.col("_k"), "full")
    fresh = F.col(key).isNotNull() & (F.col("_k").isNull() | (F.col(etag) != F.col("_e")))
    return rows.select(
        F.coalesce(key, "_k").alias(key),
        F.when(fresh, F.col(etag)).otherwise(F.col("_e")).alias(etag),
        F.when(fresh, F.col(value)).otherwise(F.col("_v")).alias(value),
        F.when(fresh, F.col(value) - F.coalesce("_v", F.lit(0))).otherwise(0).alias("delta"),
    )


def got_or_created(known: DataFrame, asked: DataFrame) -> DataFrame:
    """text (lower-case, trimmed), id and created of each text asked for; new texts get the ids after the greatest."""
    from .order import numbered

    texts = asked.select(F.lower(F.trim("text")).alias("text")).distinct()
    found = texts.join(known, "text", "left")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new = numbered(found.where("id is null").select("text"), [F.col("text")], "nth").crossJoin(F.broadcast(top))
    new = new.select("text", (F.col("top") + F.col("nth")).alias("id"), F.lit(True).alias("created"))
    return found.where("id is not null").withColumn("created", F.lit(False)).unionByName(new)
