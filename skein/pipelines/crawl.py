"""Searches over stored content, visits, harvests and reports, each as one function of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from ..operators import relational as R
from ..operators.order import kept, numbered


def search_stored(docs: DataFrame, ledger: DataFrame, stored: DataFrame, include: list[str], exclude: list[str], term: str, eliminate: list[str], most: int = 500, least: int = 20) -> DataFrame:
    """doc_id, snippet: documents that fit and that the ledger (doc_id) doesn't have, cut to the sentences round the
    term; snippets that fit, each once, without those that are stored (snippet)."""
    found = R.without(R.include_exclude(docs.select("doc_id", "text"), F.col("text"), include, exclude), ledger, "doc_id")
    cut = found.select("doc_id", T.snippet(F.col("text"), term, most).alias("snippet")).where(F.length("snippet") > least)
    fit = R.include_exclude(cut, F.col("snippet"), [], eliminate)
    return R.without(fit, stored, "snippet").groupBy("snippet").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "snippet")


def visit(pages: DataFrame, key: str, html: str, term: str, eliminate: list[str], positive: list[str], negative: list[str]) -> DataFrame:
    """key, nth, snippet, polarity of the snippets round a term in pages' texts, without those with an eliminated word."""
    text = F.array_join(H.text_nodes(F.col(html)), " ")
    cut = pages.select(key, F.posexplode(T.greedy_snippets(text, term)).alias("nth", "snippet"))
    fit = R.include_exclude(cut, F.col("snippet"), [], eliminate)
    words = T.tokens(F.col("snippet"))
    return fit.withColumn("polarity", T.hits(words, positive) - T.hits(words, negative))


def harvest(found: DataFrame, key: str, url: str, fragments: list[str]) -> DataFrame:
    """url, first_id, url_order: good URLs that engines found, each once, in the order they were found."""
    good = found.where(U.good(F.col(url), fragments)).groupBy(F.col(url).alias("url")).agg(F.min(key).alias("first_id"))
    return numbered(good, [F.col("first_id")], "url_order")


def screened(found: DataFrame, key: str, url: str, fragments: list[str], rules: list[tuple[str, str]]) -> DataFrame:
    """url, first_id, reason and url_order of every URL that engines found, each once: "bad" without http or with a
    fragment, else the reason of the first rule that it breaks, else "near duplicate" where a later one (by first_id) of
    the same host and query has its path but for .htm or .html; the others are "ok" and numbered in the order found."""
    each = kept(found.groupBy(F.col(url).alias("url")).agg(F.min(key).alias("first_id")))
    told = each.withColumn("reason", F.when(U.good(F.col("url"), fragments), U.status(F.col("url"), rules)).otherwise("bad"))
    newest = R.newest_of_near_urls(told.where("reason = 'ok'"), "first_id", "url").select(F.col("first_id").alias("_newest"))
    told = told.join(newest, F.col("first_id") == F.col("_newest"), "left")
    told = told.withColumn("reason", F.when((F.col("reason") == "ok") & F.col("_newest").isNull(), "near duplicate").otherwise(F.col("reason"))).drop("_newest")
    good = numbered(told.where("reason = 'ok'"), [F.col("first_id")], "url_order")
    return good.unionByName(told.where("reason <> 'ok'").withColumn("url_order", F.lit(None).cast("long")))


def parse_pages(pages: DataFrame, criteria: DataFrame) -> DataFrame:
    """page_id, kind, criteria_id, value: the fragments of pages that fit each of the (few) criteria, polished; their meta
    attributes and their links."""
    nodes = kept(pages.select("page_id", F.explode(H.text_nodes(F.col("html"))).alias("node")))
    low = F.lower("node")
    fit = F.contains(low, F.col("include")) & ~F.contains(low, F.col("exclude"))
    content = nodes.join(F.broadcast(criteria), fit).select("page_id", F.lit("content").alias("kind"), "criteria_id", T.polish(F.col("node")).alias("value")).distinct()
    none = F.lit(None).cast("int").alias("criteria_id")
    meta = pages.select("page_id", F.lit("meta").alias("kind"), none, F.explode(H.meta_attributes(F.col("html"))).alias("m"))
    meta = meta.select("page_id", "kind", "criteria_id", F.concat_ws("=", "m.name", "m.value").alias("value"))
    links = pages.select("page_id", F.lit("link").alias("kind"), none, F.explode(H.hrefs(F.col("html"))).alias("value"))
    return content.unionByName(meta).unionByName(links)


def listening_posts(specs: DataFrame, docs: DataFrame) -> DataFrame:
    """post, doc_id: for each post the first documents, up to the greatest of its searches' limits, that hold any term
    of its searches and none of their excluded ones. Posts are few; their terms are broadcast."""
    rolled = R.rolled_up(specs, "post", "include", "lim")
    out = R.rolled_up(specs, "post", "exclude", "lim").select("post", F.col("terms").alias("banned"))
    posts = F.broadcast(rolled.join(out, "post"))
    low = docs.select("doc_id", F.lower("text").alias("low"))
    fit = F.exists("terms", lambda w: F.contains(F.col("low"), w)) & ~F.exists("banned", lambda w: F.contains(F.col("low"), w))
    met = low.join(posts, fit).select("post", "doc_id", "most")
    # The best of parts of a post first, so that no task has all documents of a post.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id"))
    met = met.withColumn("part", part).withColumn("r", nth("post", "part")).where("r <= most")
    return met.withColumn("r", nth("post")).where("r <= most").select("post", "doc_id")


def associations(edges: DataFrame, words: list, k: int) -> DataFrame:
    """report, word, other, value: of each word the top assertions and the most similar ones, and the cosines of pairs."""
    from ..functions.math import cosine
    from ..matrix import svd as S

    cells = edges.select(F.col("a").alias("row"), F.concat_ws("/", "rel", F.col("b").cast("string")).alias("col"), F.col("score").alias("v"))
    factors = S.svd(cells, k)
    own = edges.where(F.col("a").isin(words))
    top = R.best_of(own, ["a"], [F.desc("score"), "rel", "b"], 10)
    out = top.select(F.lit("assertion").alias("report"), F.col("a").alias("word"), F.concat_ws("/", "rel", F.col("b").cast("string")).alias("other"), F.col("score").alias("value"))
    for word in words:
        near = S.similar(factors, word, 10)
        out = out.unionByName(near.select(F.lit("similar").alias("report"), F.lit(word).cast("long").alias("word"), F.col("row").cast("string").alias("other"), F.col("similarity").alias("value")))
    vectors = factors.weighted.where(F.col("row").isin(words))
    x, y = vectors.alias("x"), vectors.alias("y")
    pairs = x.join(y, F.col("x.row") < F.col("y.row"))  # a short list of words
    return out.unionByName(pairs.select(F.lit("cosine").alias("report"), F.col("x.row").alias("word"), F.col("y.row").cast("string").alias("other"), cosine(F.col("x.vector"), F.col("y.vector")).alias("value")))
