"""Resources of a graph API as DataFrames, found by path."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import edges as E
from ..operators.relational import clamped, top_rows

Tables = Callable[[str], DataFrame]
_ROUTES: list[tuple[re.Pattern, Callable]] = []


def route(pattern: str):
    """Register a resource; {name} is a part of the path, {name:int} a number."""
    regex = re.sub(r"\{(\w+)(:int)?\}", lambda m: f"(?P<{m[1]}>{'[0-9]+' if m[2] else '[^/]+'})", pattern)

    def add(f):
        _ROUTES.append((re.compile(regex + "/?"), f))
        return f

    return add


def get(path: str, tables: Tables, limit: int | None = None, form: str = "json") -> DataFrame:
    """The rows that a path stands for; json: one column value with an object a row. Unknown paths are a KeyError.

    tables gives edges (id, lang, a, rel, b, score), concepts (id, lang, text, visible), frames (frame_id, lang, rel,
    text, goodness, frequency), surfaces (surface_id, lang, concept, text, use_count) and votes (user_id, object_type,
    object_id, vote). A limit is at most 100, 20 if none is given.
    """
    if path.endswith((".json", ".table")):
        path, form = path.rsplit(".", 1)
    for regex, f in _ROUTES:
        if m := regex.fullmatch(path):
            out = f(tables, clamped(limit, 100, 20), **m.groupdict())
            return out.select(F.to_json(F.struct(*out.columns)).alias("value")) if form == "json" else out
    raise KeyError(path)


def paths() -> list[str]:
    return [r.pattern for r, _ in _ROUTES]


@route("/{lang}/language")
def _(t, limit, lang):
    return t("concepts").where(F.col("lang") == lang).groupBy("lang").agg(F.count("*").alias("concepts"))


@route("/{lang}/concept/{text}")
def _(t, limit, lang, text):
    return t("concepts").where((F.col("lang") == lang) & (F.lower("text") == text.lower())).select("id", "text", "visible")


@route("/{lang}/concept/{text}/assertions")
def _(t, limit, lang, text):
    ids = t("concepts").where((F.col("lang") == lang) & (F.lower("text") == text.lower())).select(F.col("id").alias("c"))
    e = t("edges").join(F.broadcast(ids.limit(100)), (F.col("a") == F.col("c")) | (F.col("b") == F.col("c"))).drop("c")
    return top_rows(e.select("id", "a", "rel", "b", "score"), [F.desc("score"), "id"], limit)


@route("/{lang}/concept/{text}/features")
def _(t, limit, lang, text):
    ids = t("concepts").where((F.col("lang") == lang) & (F.lower("text") == text.lower())).select("id").limit(1).collect()
    rows = E.features_of(t("edges"), ids[0]["id"] if ids else None)
    return top_rows(rows, ["side", "rel", "other"], limit)


@route("/{lang}/concept/{text}/surfaceforms")
def _(t, limit, lang, text):
    ids = t("concepts").where((F.col("lang") == lang) & (F.lower("text") == text.lower())).select(F.col("id").alias("concept"))
    return top_rows(t("surfaces").join(ids, "concept", "left_semi").select("surface_id", "text", "use_count"), [F.desc("use_count"), "surface_id"], limit)


@route("/{lang}/feature/{side}/{rel}/{other:int}")
def _(t, limit, lang, side, rel, other):
    return top_rows(E.with_feature(t("edges"), side, rel, int(other)).select("id", "a", "rel", "b", "score"), [F.desc("score"), "id"], limit)


@route("/{lang}/assertion/{id:int}")
def _(t, limit, lang, id):  # noqa: A002
    return t("edges").where(F.col("id") == int(id)).select("id", "a", "rel", "b", "score")


@route("/{lang}/assertionfind/{rel}/{a:int}/{b:int}")
def _(t, limit, lang, rel, a, b):
    found = t("edges").where((F.col("rel") == rel) & (F.col("a") == int(a)) & (F.col("b") == int(b)))
    return top_rows(found.select("id", "a", "rel", "b", "score"), [F.desc("score"), "id"], limit)


@route("/{lang}/relation")
def _(t, limit, lang):
    return t("edges").groupBy("rel").agg(F.count("*").alias("n"))


@route("/{lang}/frame/{rel}")
def _(t, limit, lang, rel):
    return top_rows(t("frames").where(F.col("rel") == rel).select("frame_id", "text", "goodness"), [F.desc("goodness"), "frame_id"], limit)


@route("/{lang}/votes/{kind}/{id:int}")
def _(t, limit, lang, kind, id):  # noqa: A002
    rows = t("votes").where((F.col("object_type") == kind) & (F.col("object_id") == int(id)))
    return rows.agg(F.coalesce(F.sum("vote"), F.lit(0)).cast("long").alias("score"), F.count("vote").alias("num_votes"))
