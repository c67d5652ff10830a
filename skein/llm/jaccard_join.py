"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its word shingles, held as sorted 64-bit hashes. Two documents link when the Jaccard
similarity of their sets is at least ``percent`` / 100. Equal sets are one *node*, whatever rows hold them.

Global token order: rare tokens first, then frequent ones, each by hash. A set of n tokens loses at most
``slack = n - ceil(percent * n / 100)`` of them against a partner, so ``slack + 1`` rare tokens are prefix enough and
are indexed as single tokens. A set without so many rare tokens extends its prefix over the whole frequent class, where
combinations of two tokens are indexed: those that follow each other in the set's own frequent tokens. A set of which r
tokens are rare and met by none loses at most ``slack - r`` of the others, each of which breaks two combinations, and
tokens that the partner has more break one each; together at most ``breaks`` of them (``breaks_of``). So by the prefix
principle, applied to the combinations in order of their hashes, the first ``breaks + 1`` of both sets share one. That
is less than half as many combinations as the set has tokens, at every size. Every match of rare tokens is verified on
the whole sets, unless the prefixes show already that it is too small; sets that meet by combinations are verified
block by block (``_family_links``).

A token is frequent when more than ``frequent`` *clusters* hold it in their prefixes, or more than ``16 * frequent``
sets of several clusters, so that no rare token makes more than a bounded number of pairs. Clusters come first: each
token's sets are chained in order of size and tied to the smallest one, these pairs are verified, and linked sets
form a cluster. So a group of thousands of near copies is one cluster, tied by a number of pairs in proportion to
its size, and its own tokens stay rare. Tokens of more than ``hot_rows`` sets are chained in salted parts, whose
smallest sets are tied to the smallest of all. Later only pairs of different clusters are compared, which loses no link.

Null or empty texts have no set (n_shingles 0) and link with nothing. Repeated rows and equal texts are one node; rows
of a repeated doc_id each keep their row and their own text's component. Null doc_ids link like others; component_id is
the smallest doc_id that is not null in the component, or null if there is none. Other columns of the input are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hinted, keep_keys, mix, running, shingle_set, shrink_heaps, tidy


#: Rows of edges in one partition.
ROWS = 200_000


def slack_of(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100


def breaks_of(n: Column, rares: Column, percent: int) -> Column:
    """Most combinations of following frequent tokens that a set of n tokens, none of whose rare ones is shared, can
    lose against a partner: two for each frequent token lost, one for each that the partner has more.

    With a lost and b more, a + b <= (100 - percent) / 100 of the union, which has at most 100 n / percent tokens.
    """
    lost = n - F.ceil(n * percent / 100)
    either = F.floor(n * (100 - percent) / percent)
    return (lost - rares) + F.greatest(either - rares, F.lit(0))


def _sets(docs: DataFrame, k: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, text_hash, n, node (hash of the set, null if empty), tokens (all, or the prefix with some spare)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            sizes, nodes, kept = [], [], []
            for text in batch.column("text"):
                tokens = shingle_set(text.as_py(), k)
                n = len(tokens)
                sizes.append(n)
                nodes.append(int(mix(np.array([mix(tokens.view(np.uint64)).sum() + np.uint64(n)], np.uint64)).view(np.int64)[0]) if n else None)
                need = slack_of(n, percent) + 1
                kept.append(tokens if whole else tokens[: need + need // 8 + 8])
            ends = np.cumsum([0, *map(len, kept)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *kept]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), lists], ["doc_id", "text_hash", "n", "node", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, node long, tokens array<long>")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for each node of ``links`` (a, b), by alternating stars.

    Each round ties every greater neighbour to the smallest one, then every smaller; a row gives one row, so edges
    never grow in number, and rounds grow with the logarithm of the number of nodes. Edges are few against documents,
    so they are kept in partitions of ``ROWS`` rows, not in one for each shuffle partition.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    parts = max(16, edges.count() // ROWS)
    edges = edges.coalesce(parts)
    least, before = F.min("v").over(Window.partitionBy("u")), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least(least, F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.where("u <> v").withColumn("m", least).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.coalesce(parts))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        tidy(edges.sparkSession)
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v")).distinct()


def _whole_sets(wanted: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """node, n, tokens (all) of each node of wanted (node, doc_id, text_hash: a row that has it)."""
    wanted = cut(wanted.select("node", F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")))
    one = docs.select(F.col("doc_id").cast("long"), "text")
    one = one.join(hinted(wanted), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left_semi")
    # Repeated rows give a set each, of which the first stays; another text of the same hash is another node.
    return _sets(one, k, percent, whole=True).dropDuplicates(["node"]).join(wanted.select("node"), "node", "left_semi").select("node", "n", "tokens")


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes that link, by their whole sets."""
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    full = cut(_whole_sets(firsts.join(needed, "node", "left_semi"), docs, k, percent).select("node", "tokens"))
    b = pairs.join(full.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    both = b.join(full.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - F.col("shared")
    return both.select("a", "b", "ta", "tb", shared.alias("shared")).where(F.col("shared") * 100 >= union * percent).select("a", "b").distinct()


def _family_links(whole: DataFrame, slack, percent: int, block_tokens: int = 150_000) -> DataFrame:
    """Links among sets that are short of rare tokens, at least enough of them to tie all that are linked.

    whole: node, n, label, rare and hot (its tokens of either class in order). Sets with a common combination, directly
    or over others, are a family. A family is compared block by block, blocks in order of cluster and size and only
    those whose sizes fit and that aren't of one cluster, by products of incidence matrices, and of the links of a block
    pair only a spanning forest is returned.
    """
    scarce = whole.select("node", "label", "hot", "n", F.size("rare").alias("rares")).where(F.col("rares") <= slack(F.col("n")))
    pairs = lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(h, F.lit(2), F.size(h) - 1), lambda x, y: F.xxhash64(x, y))
    signs = F.when(F.size("hot") > 1, F.array_sort(pairs(F.col("hot")))).otherwise(F.array().cast("array<long>"))
    most = breaks_of(F.col("n"), F.col("rares"), percent) + 1
    signs = scarce.select("node", "label", F.explode(F.slice(signs, F.lit(1), most.cast("int"))).alias("sign"))
    stars = cut(signs.groupBy("sign").agg(F.min("node").alias("star"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2").select("sign", "star"))
    signs = keep_keys(signs.select("sign", "node"), stars, "sign", "inner").where("star <> node").select("star", "node")
    families = cut(components(signs.select(F.col("star").alias("a"), F.col("node").alias("b")).distinct()))
    rows = whole.join(families.select("node", F.col("label").alias("family")), "node")
    rows = rows.select("family", "node", "n", "label", F.concat("rare", "hot").alias("tokens"))
    # Blocks by the running sum of tokens in this order over all families; one that two families share is one of each.
    cost = F.greatest(F.col("n"), F.lit(block_tokens // 1000)).cast("long")
    order = [F.col("family"), F.col("label"), F.col("n"), F.col("node")]
    places = running(rows.select("family", "node", "n", "label", cost.alias("cost")), order, ["cost"])
    places = cut(places.select("family", "node", "n", "label", F.floor(F.col("before_cost") / block_tokens).alias("block")))
    spans = cut(places.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("l1"), F.max("label").alias("l2")))
    i, j = spans.alias("i"), spans.alias("j")
    sizes = (F.col("i.high") * 100 >= F.col("j.low") * percent) & (F.col("j.high") * 100 >= F.col("i.low") * percent)
    several = F.least("i.l1", "j.l1") < F.greatest("i.l2", "j.l2")
    facing = i.join(j, (F.col("i.family") == F.col("j.family")) & (F.col("i.block") <= F.col("j.block")) & sizes & several)
    facing = cut(facing.select("i.family", F.col("i.block").alias("i"), F.col("j.block").alias("j")))
    rows = cut(rows.join(places.select("node", "block"), "node"))
    shrink_heaps(whole.sparkSession)

    def side(which: str, prefix: str) -> DataFrame:
        out = rows.join(facing.withColumnRenamed(which, "block"), ["family", "block"]).withColumnRenamed("block", which)
        return out.select(*[F.col(c).alias(prefix + c) for c in ("family", "i", "j", "node", "n", "label", "tokens")])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left.columns = right.columns = ["family", "i", "j", "node", "n", "label", "tokens"]
        return pd.DataFrame(forest(left, right, percent), columns=["a", "b"])

    keys = lambda p: [p + "family", p + "i", p + "j"]
    return side("i", "x_").groupBy(*keys("x_")).cogroup(side("j", "y_").groupBy(*keys("y_"))).applyInPandas(compare, "a long, b long")


def forest(left: pd.DataFrame, right: pd.DataFrame, percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """Pairs of nodes that link and join labels not joined by those before."""
    tokens = [np.concatenate(list(side.tokens)) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), [len(t) for t in side.tokens]) for side in (left, right)]
    common = np.intersect1d(*tokens)
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), columns):
        part = common[at : at + columns]
        sides = []
        for ts, own, side in zip(tokens, owner, (left, right)):
            place = np.minimum(np.searchsorted(part, ts), len(part) - 1)
            hit = part[place] == ts
            grid = np.zeros((len(side), len(part)), np.float32)
            grid[own[hit], place[hit]] = 1
            sides.append(grid)
        shared += sides[0] @ sides[1].T
    n, m = left.n.to_numpy(), right.n.to_numpy()
    linked = np.rint(shared).astype(np.int64) * (100 + percent) >= (n[:, None] + m[None, :]) * percent
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for x, y in np.argwhere(linked):
        a, b = find(int(left.label.iat[x])), find(int(right.label.iat[y]))
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((int(left.node.iat[x]), int(right.node.iat[y])))
    return out


def _chained(prefix: DataFrame, hot_rows: int) -> DataFrame:
    """token, node, n of tokens of more than one set, with star and last: the smallest of the token's sets and the one
    before it in order of size, with their sizes; the latter within salted parts for tokens of about ``hot_rows`` sets or
    more. Which tokens are so is told from one set in 64, as it only spreads the work. Parts are a power of eight and by
    node alone, so that tokens that the same sets hold chain these alike."""
    some = prefix.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(64)) == 0).groupBy("token").agg((F.count("*") * 64).alias("holders"))
    big = cut(some.where(F.col("holders") >= hot_rows))
    salt = F.coalesce(F.pmod(F.xxhash64("node"), _parts(F.col("holders"), hot_rows)), F.lit(0))
    rows = prefix.join(hinted(big), "token", "left").withColumn("salt", salt)
    of_part = Window.partitionBy("token", "salt")
    ordered = of_part.orderBy("n", "node")
    rows = rows.select(
        "token", "node", "n", "holders",
        F.count("*").over(of_part).alias("of_part"),
        F.first("node").over(ordered).alias("star"),
        F.first("n").over(ordered).alias("star_n"),
        F.lag("node").over(ordered).alias("last"),
        F.lag("n").over(ordered).alias("last_n"),
    )
    rows = cut(rows.where("of_part > 1 or holders is not null").drop("of_part"))
    least = rows.where("holders is not null").groupBy("token").agg(F.min(F.struct("n", "node")).alias("least"))
    rows = rows.join(hinted(cut(least)), "token", "left")
    star = {"star": F.coalesce("least.node", "star"), "star_n": F.coalesce("least.n", "star_n")}
    return rows.withColumns(star).drop("least", "holders")


def _parts(holders: Column, rows: int) -> Column:
    return F.pow(F.lit(8), F.greatest(F.lit(0), F.round(F.log(holders / rows) / F.log(F.lit(8.0))))).cast("long")


def _components_of_nodes(docs: DataFrame, k: int, percent: int, frequent: int, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sets (doc_id, text_hash, n, node, tokens), and top (a node) for each node that links."""
    slack = lambda n: n - F.ceil(n * percent / 100)
    sets = cut(_sets(docs, k, percent, whole=False).withColumn("row", F.monotonically_increasing_id()))
    firsts = cut(sets.where("node is not null").groupBy("node").agg(F.min("row").alias("row")))
    # One row of each set, found again by the number that it has in the kept table.
    nodes = keep_keys(sets.where("node is not null"), firsts.select("row"), "row")
    firsts = cut(nodes.select("node", "doc_id", "text_hash"))
    prefix = nodes.select(F.explode("tokens").alias("token"), "node", "n")
    # Clusters only save work, so pairs are tried only where they met at most tokens of a prefix.
    shared = _chained(prefix, hot_rows)
    to_star = shared.select("node", "n", F.col("star").alias("o"), F.col("star_n").alias("o_n")).where("o <> node")
    to_last = shared.where("last <> star").select("node", "n", F.col("last").alias("o"), F.col("last_n").alias("o_n"))
    tied = to_star.unionByName(to_last).where(_sizes_fit(F.col("n"), F.col("o_n"), percent))
    tidy(docs.sparkSession)
    tied = tied.groupBy(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).agg(F.count("*").alias("met"), F.min(F.least("n", "o_n")).alias("n"))
    tried = cut(tied.where(F.col("met") * 10 >= (slack(F.col("n")) + 1) * 6).select("a", "b"))
    shrink_heaps(docs.sparkSession)
    links = cut(_verified(tried, docs, firsts, k, percent))
    clusters = cut(components(links))
    # What each part leaves on the driver, on disk and in the executors' heaps goes before the next one begins.
    shrink_heaps(docs.sparkSession)

    labelled = shared.select("token", "node", "n").join(clusters, "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("label"))
    held = labelled.groupBy("token", "label").agg(F.count("*").alias("rows")).groupBy("token").agg(F.count("*").alias("held"), F.sum("rows").alias("rows")).where("held > 1")
    held = cut(held.select("token", ((F.col("held") > frequent) | (F.col("rows") > 16 * frequent)).alias("is_hot")))
    hot_tokens, cold_tokens = cut(held.where("is_hot").select("token")), held.where("not is_hot").select("token")
    shrink_heaps(docs.sparkSession)
    cold = keep_keys(labelled, hot_tokens, "token", "left_anti").join(cold_tokens, "token", "left_semi")
    hot = keep_keys(labelled, hot_tokens, "token")
    many = cut(cold.withColumn("hot", F.lit(0).cast("long")).unionByName(hot.withColumn("hot", F.lit(1).cast("long"))))

    def crossing(left: DataFrame, right: DataFrame) -> DataFrame:
        """Distinct pairs of different clusters that share a signature and fit in size."""
        x, y = left.alias("x"), right.alias("y")
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & _sizes_fit(F.col("x.n"), F.col("y.n"), percent))
        return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    # Rare tokens. Tokens of one cluster only are in no pair of different clusters. Of two prefixes, the one that ends
    # at the smaller hash shows all common tokens up to there: the rare ones met, hot ones at most as many as the
    # poorer side has, and beyond it at most the tokens that follow. Where that is too little, the pair can't link.
    spare = F.least(F.col("n"), slack(F.col("n")) + 1 + F.floor((slack(F.col("n")) + 1) / 8) + 8)
    of_node = many.groupBy("node").agg(F.sum("hot").alias("hots"))
    tops = nodes.select("node", F.element_at("tokens", -1).alias("top"), (F.col("n") - F.size("tokens")).alias("after"))
    tidy(docs.sparkSession)
    info = cut(of_node.join(tops, "node"))
    rare = many.where("hot = 0").select("token", "node", "n", "label").join(info, "node")
    x, y = rare.alias("x"), rare.where("true").alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.node") < F.col("y.node")) & _sizes_fit(F.col("x.n"), F.col("y.n"), percent))
    room = F.least("x.hots", "y.hots") + F.when(F.col("x.top") <= F.col("y.top"), F.col("x.after")).otherwise(F.col("y.after"))
    met = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), (F.col("x.n") + F.col("y.n")).alias("both"), room.alias("room")).agg(F.count("*").alias("met"))
    found = [met.where((F.col("met") + F.col("room")) * (100 + percent) >= F.col("both") * percent).select("a", "b")]

    # Sets with too few rare tokens in what was kept of their prefixes are taken whole. Tokens that many clusters or
    # sets of these hold are frequent too, which may leave more sets short; the frequent class only grows, so this ends.
    whole = None
    while not hot_tokens.isEmpty():
        hits = keep_keys(prefix, hot_tokens, "token").groupBy("node", "n").agg(F.count("*").alias("hot"))
        short = cut(hits.where(spare - F.col("hot") <= slack(F.col("n"))).select("node"))
        full = _whole_sets(firsts.join(short, "node", "left_semi"), docs, k, percent)
        whole = cut(full.join(clusters, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"), "tokens"))
        spread = whole.select(F.explode("tokens").alias("token"), "label").groupBy("token", "label").agg(F.count("*").alias("rows"))
        spread = spread.groupBy("token").agg(F.count("*").alias("held"), F.sum("rows").alias("rows"))
        spread = spread.where((F.col("held") > frequent) | (F.col("held") > 1) & (F.col("rows") > 16 * frequent))
        more = cut(spread.join(hot_tokens, "token", "left_anti").select("token"))
        tidy(docs.sparkSession)
        if more.isEmpty():
            break
        hot_tokens = cut(hot_tokens.union(more))
    late_links = None
    if whole is not None:
        flagged = keep_keys(whole.select("node", F.explode("tokens").alias("token")), hot_tokens, "token")
        flagged = flagged.groupBy("node").agg(F.array_sort(F.collect_list("token")).alias("hot"))
        whole = whole.join(flagged, "node").withColumn("rare", F.array_except("tokens", "hot"))
        whole = cut(whole.select("node", "n", "label", "rare", "hot"))
        singles = whole.select(F.explode(F.slice("rare", F.lit(1), (slack(F.col("n")) + 1).cast("int"))).alias("token"), "node", "n", "label")
        beyond = singles.join(many.select("node", "token"), ["node", "token"], "left_anti")
        few = cut(beyond.select("token").distinct())
        others = keep_keys(prefix, few, "token").join(clusters, "node", "left").select("token", "node", "n", F.coalesce("label", "node").alias("label"))
        found += [crossing(others, beyond), crossing(singles, beyond)]
        shrink_heaps(docs.sparkSession)
        late_links = _family_links(whole, slack, percent)
    shrink_heaps(docs.sparkSession)
    fresh = found[0]
    for more in found[1:]:
        fresh = fresh.union(more)
    fresh = cut(fresh.distinct().join(tried, ["a", "b"], "left_anti"))
    late = _verified(fresh, docs, firsts, k, percent)
    if late_links is not None:
        late = late.union(late_links)
    label_of = clusters.select(F.col("node").alias("key"), "label")
    for end in ("a", "b"):
        late = late.join(label_of, late[end] == label_of["key"], "left").withColumn(end, F.coalesce("label", end)).drop("key", "label")
    tidy(docs.sparkSession)
    merged = components(cut(late.distinct()))
    ends = merged.select(F.col("node").alias("label"), F.col("label").alias("top"))
    tops = clusters.join(ends, "label", "full").select(F.coalesce("node", "label").alias("node"), F.coalesce("top", "label").alias("top"))
    return sets, cut(tops)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = 16, hot_rows: int = 2_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) for each row of (doc_id, text)."""
    sets, tops = _components_of_nodes(docs, k, percent, frequent, hot_rows)
    ids = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(tops, "node", "left")
    ids = cut(ids.select("node", "doc_id", F.coalesce("top", "node").alias("top")))
    reached = ids.groupBy("top").agg(F.min("doc_id").alias("component_id"))
    out = ids.join(reached, "top").select("node", "component_id")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sets.join(out, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, frequent: int = 16, hot_rows: int = 2_000) -> DataFrame:
    """One row of docs for each component, of the smallest doc_id (nulls last) and text hash; sets decide, not doc_ids.

    Rows without a set stay, as they link with nothing; of rows that are equal in doc_id and text one stays.
    """
    sets, tops = _components_of_nodes(docs, k, percent, frequent, hot_rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = sets.where("node is not null").groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("rows"))
    first = first.join(tops, "node", "left").groupBy(F.coalesce("top", "node").alias("top")).agg(F.min("first").alias("first"))
    heads = cut(first.select(F.col("first.doc_id").alias("_d"), F.col("first.text_hash").alias("_t")))
    same = sets.where("node is not null").groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"))
    again = cut(heads.join(same.withColumnsRenamed({"_d": "e", "_t": "u"}), F.col("_d").eqNullSafe(F.col("e")) & (F.col("_t") == F.col("u")), "left_semi"))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t"))
    once = heads.join(again.withColumnsRenamed({"_d": "e", "_t": "u"}), F.col("_d").eqNullSafe(F.col("e")) & (F.col("_t") == F.col("u")), "left_anti")
    words = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    kept = docs.where(words).join(hinted(cut(once)), own, "left_semi")
    if not again.isEmpty():
        kept = kept.unionByName(docs.where(words).join(hinted(again), own, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.where(~words))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same in DuckDB, for the whole table.
OP10_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from w),
t as (select doc_id, len(s) as n, md5(array_to_string(list_sort(s), chr(10))) as node, s from s),
u as (select node, any_value(s) as s, any_value(n) as n from t where n > 0 group by node),
e as (select node, n, unnest(s) as token from u),
l as (
  select a.node as a, b.node as b from e a join e b on a.token = b.token and a.node < b.node and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  group by a.node, b.node, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
pairs as (select a, b from l union all select b, a from l),
r(node, other) as (select node, node from u union select r.node, pairs.b from r join pairs on r.other = pairs.a),
c as (select r.node, min(t.doc_id) as component_id from r join t on t.node = r.other and t.n > 0 group by r.node)
select t.doc_id, t.n as n_shingles, case when t.n = 0 then t.doc_id else c.component_id end as component_id
from t left join c on t.node = c.node and t.n > 0
"""
