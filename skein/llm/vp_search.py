"""Nearest neighbours by inner product with vantage-point trees, one for each shard.

For a metric, each vector x gets one more component sqrt(M^2 - |x|^2), M the largest norm, and each query a zero: the
Euclidean distance then orders vectors as the inner product does.

Shards: up to ``most_pivots`` vectors, the smallest by a hash, are pivots; a vector belongs to the nearest pivot, and
cells of more than ``shard_rows`` vectors are dealt into several shards. A query is first searched for in its own
cell's first shard, which gives it a radius, the distance of the k-th found; then in every other shard that the
triangle inequality over the pivot does not rule out.

A shard's tree splits its points at the median distance to a vantage point. Each leaf knows the interval of its points'
distances to every vantage point above it, so the triangle inequality bounds the distance of a query to the leaf from
below by the furthest of these. Leaves, subtrees and shards are left out when that bound times ``relax`` exceeds the
query's radius: ``relax`` 1 is exact search, larger values prune more. A query visits its ``first`` nearest leaves by
bound before all others, so that its radius is small when pruning begins.

Queries to a shard are dealt into blocks of about ``block_rows``; each (shard, block) is one group, with a tree of its
own. The k best of each group are merged by levels of at most ``fan_in`` lists.

Vectors take no part if null, zero, holding a null or non-finite component, with a null vec_id, or of another length
than most vectors have (ties: the greater length). Of repeated rows of a vec_id the least vector by components
counts. Equal vectors are one point of a tree, with the k + 1 smallest vec_ids, more of which no list can hold; so
a group of copies costs one point. Ties in score go to the smaller vec_id. Other columns of the input aren't read.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The shipped relaxation of the triangle inequality.
RELAX = 6.0
NONE = np.iinfo(np.int64).max


def dots(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products, each summed component by component from the first, so equal vectors get equal sums."""
    out = np.zeros((len(queries), len(points)))
    for i in range(queries.shape[1]):
        out += queries[:, i, None] * points[None, :, i]
    return out


def lifted(points: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([points, np.sqrt(np.maximum(0.0, largest**2 - np.einsum("ij,ij->i", points, points)))])


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of lifted queries and points."""
    square = (queries**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * queries @ points.T
    return np.sqrt(np.maximum(0.0, square))


class VpTree:
    """points: distinct rows; ids: k + 1 vec_ids a point at most, padded by the largest integer."""

    LEAF = 64

    def __init__(self, points: np.ndarray, ids: np.ndarray, largest: float):
        self.points, self.ids, self.lifted, self.largest = points, ids, lifted(points, largest), largest
        self.vantages: list[int] = []
        self.leaves: list[np.ndarray] = []
        self.rings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # vantages above a leaf, least and greatest distance
        self._build(np.arange(len(points)), [])
        self.scored = self.possible = 0

    def _build(self, rows: np.ndarray, above: list[int]) -> None:
        if len(rows) <= self.LEAF:
            if len(rows):
                far = distances(self.lifted[[self.vantages[v] for v in above]], self.lifted[rows]) if above else np.zeros((0, len(rows)))
                self.leaves.append(rows)
                self.rings.append((np.array(above, np.int64), far.min(axis=1), far.max(axis=1)))
            return
        middle = self.lifted[rows].mean(axis=0)
        vantage = rows[np.argmax(((self.lifted[rows] - middle) ** 2).sum(axis=1))]
        self.vantages.append(int(vantage))
        above = [*above, len(self.vantages) - 1]
        far = distances(self.lifted[[vantage]], self.lifted[rows])[0]
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        self._build(rows[order[:half]], above)
        self._build(rows[order[half:]], above)

    def bounds(self, padded: np.ndarray) -> np.ndarray:
        """For each query and leaf, a distance below which the leaf has no point."""
        out = np.zeros((len(padded), len(self.leaves)))
        if self.vantages:
            gap = distances(padded, self.lifted[self.vantages])
            for j, (above, low, high) in enumerate(self.rings):
                g = gap[:, above]
                out[:, j] = np.maximum(np.maximum(low - g, g - high).max(axis=1), 0.0)
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, relax: float, kth: np.ndarray | None = None, first: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """vec_ids and scores (n queries x k), best first, padded by the largest integer and -inf.

        kth: a score that a candidate needs at least to be of use, for each query.
        """
        self.queries, self.own, self.k = queries, own, k
        self.best_id, self.best = np.full((len(queries), k), NONE), np.full((len(queries), k), -np.inf)
        self.floor = np.full(len(queries), -np.inf) if kth is None else kth
        self.norm2 = np.einsum("ij,ij->i", queries, queries)
        self.possible += len(queries) * sum(map(len, self.leaves))
        bounds = self.bounds(np.column_stack([queries, np.zeros(len(queries))]))
        early = np.argsort(bounds, axis=1, kind="stable")[:, :first]
        visited = np.zeros(bounds.shape, bool)
        np.put_along_axis(visited, early, True, 1)
        for pick in (visited, ~visited):
            for j in range(len(self.leaves)):
                rows = np.flatnonzero(pick[:, j])
                rows = rows[bounds[rows, j] * relax <= self._radius(rows) * (1 + 1e-9) + 1e-9]
                if len(rows):
                    self._offer(self.leaves[j], rows)
        return self.best_id, self.best

    def _radius(self, rows: np.ndarray) -> np.ndarray:
        # |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the k-th score found gives the radius
        kth = np.maximum(self.best[rows, -1], self.floor[rows])
        return np.sqrt(np.maximum(0.0, self.norm2[rows] + self.largest**2 - 2 * kth))

    def _offer(self, points: np.ndarray, rows: np.ndarray) -> None:
        self.scored += len(rows) * len(points)
        scores = dots(self.queries[rows], self.points[points])
        useful = scores >= np.maximum(self.best[rows, -1], self.floor[rows])[:, None]
        some = useful.any(axis=1)
        if not some.any():
            return
        wanted = useful.any(axis=0)
        rows, points = rows[some], points[wanted]
        scores = np.where(useful, scores, -np.inf)[np.ix_(some, wanted)]
        ids = np.broadcast_to(self.ids[points].ravel(), (len(rows), self.ids[points].size))
        scores = np.repeat(scores, self.ids.shape[1], axis=1)
        scores = np.where((ids == self.own[rows, None]) | (ids == NONE), -np.inf, scores)
        ids = np.where(np.isneginf(scores), NONE, ids)
        ids, scores = np.column_stack([self.best_id[rows], ids]), np.column_stack([self.best[rows], scores])
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.best_id[rows], self.best[rows] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def shard_points(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vectors and their k + 1 smallest ids."""
    points, which = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, which.ravel()))
    which, ids = which.ravel()[order], ids[order]
    nth = np.arange(len(ids)) - np.searchsorted(which, which)
    width = min(k, int(nth.max())) + 1
    table = np.full((len(points), width), NONE)
    table[which[nth < width], nth[nth < width]] = ids[nth < width]
    return points, table


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, relax: float = RELAX, shard_rows: int = 16_384, block_rows: int = 65_536, fan_in: int = 64, most_pivots: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of (vec_id, embedding) nearest to each query row found."""
    spark = vectors.sparkSession
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.expr("forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))") & F.expr("exists(embedding, v -> v <> 0)")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    rows = rows.select(F.col("vec_id").cast("long"), x.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    dim = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == dim["dim"])
    rows = cut(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks")))
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    n, top, asking = rows.agg(F.count("*"), F.max(norm2), F.sum(F.col("asks").cast("long"))).first()
    largest = float(top) ** 0.5
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(min(most_pivots, -(-n // shard_rows))).select("embedding").collect()
    pivots = lifted(np.array([r["embedding"] for r in some]), largest)

    def home(embeddings: pd.Series, asks: pd.Series) -> pd.DataFrame:
        points = np.stack(embeddings)
        far = distances(lifted(points, largest), pivots)
        asked = distances(np.column_stack([points, np.zeros(len(points))]), pivots)
        cell = far.argmin(axis=1)
        return pd.DataFrame({"cell": cell, "gap": far[np.arange(len(points)), cell], "start": asked.argmin(axis=1)})

    placed = F.pandas_udf(home, "cell long, gap double, start long")(F.col("embedding"), F.col("asks"))
    rows = cut(rows.select("*", placed.alias("p")).select("vec_id", "embedding", "asks", "p.*"))
    cells = {r["cell"]: (-(-r["n"] // shard_rows), r["low"], r["high"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("low"), F.max("gap").alias("high")).collect()}
    heads, total = {}, 0  # first shard of each cell
    for c in sorted(cells):
        heads[c], total = total, total + cells[c][0]
    pick = lambda values: F.element_at(F.create_map(*[F.lit(int(v)) for c in heads for v in (c, values(c))]), F.col("cell"))
    blocks = -(-max(1, asking or 0) // block_rows)
    shard = pick(lambda c: heads[c]) + F.pmod(F.xxhash64("vec_id", F.lit(2)), pick(lambda c: cells[c][0]))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    held = rows.select("vec_id", "embedding", shard.alias("shard"), every.alias("block"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).alias("of_block")
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("start"), block)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "downs": [], "vec_ids": []}, dtype=object)
        tree = VpTree(*shard_points(left.vec_id.to_numpy(), np.stack(left.embedding), k), largest)
        own = right.query_id.to_numpy()
        ids, scores = tree.search(np.stack(right["query"]), own, k, relax, right.kth.to_numpy())
        full = (~np.isneginf(scores)).sum(axis=1)
        return pd.DataFrame({"query_id": own, "downs": [-s[:m] for s, m in zip(scores, full)], "vec_ids": [i[:m] for i, m in zip(ids, full)]})

    def search(to: DataFrame) -> DataFrame:
        lists = held.groupBy("shard", "block").cogroup(to.groupBy("to_shard", "of_block"))
        lists = lists.applyInPandas(run, "query_id long, downs array<double>, vec_ids array<long>")
        return lists.select("query_id", F.arrays_zip(F.col("downs").alias("down"), F.col("vec_ids").alias("vec_id")).alias("found"))

    # A query may start in a cell that no vector is in; then in the first shard of all.
    first_shard = F.coalesce(F.element_at(F.create_map(*[F.lit(int(v)) for c in heads for v in (c, heads[c])]), F.col("start")), F.lit(0)).cast("long")
    begun = asked.withColumn("to_shard", first_shard)
    found = cut(search(begun.withColumn("kth", F.lit(float("-inf")))))
    of_shard = [(heads[c] + i, c) for c in sorted(cells) for i in range(cells[c][0])]
    shard_cell = np.array([c for _, c in of_shard])
    low, high = np.array([cells[c][1] for c in shard_cell]), np.array([cells[c][2] for c in shard_cell])

    def ahead(queries: pd.Series, kth: pd.Series, been: pd.Series) -> pd.Series:
        points = np.stack(queries)
        gap = distances(np.column_stack([points, np.zeros(len(points))]), pivots)[:, shard_cell]
        radius = np.sqrt(np.maximum(0.0, (points**2).sum(axis=1) + largest**2 - 2 * kth.to_numpy()))
        open_ = np.maximum(np.maximum(low - gap, gap - high), 0.0) * relax <= radius[:, None] * (1 + 1e-9) + 1e-9
        open_[np.arange(len(points)), been.to_numpy()] = False
        return pd.Series([np.flatnonzero(o) for o in open_])

    last = F.when(F.size("found") == k, -F.element_at("found", -1)["down"]).otherwise(float("-inf"))
    known = begun.join(found.select("query_id", last.alias("kth")), "query_id")
    rest = known.select("query_id", "query", "of_block", "kth", F.explode(F.pandas_udf(ahead, "array<long>")("query", "kth", "to_shard")).alias("to_shard"))
    lists = cut(found.unionByName(search(rest)))
    parts = total
    while True:
        few = F.pmod(F.xxhash64(F.col("found")), F.lit(-(-parts // fan_in))) if parts > fan_in else F.lit(0)
        merged = lists.groupBy("query_id", few.alias("part")).agg(F.flatten(F.collect_list("found")).alias("found"))
        lists = merged.select("query_id", F.slice(F.array_sort("found"), 1, k).alias("found"))
        if parts <= fan_in:
            break
        parts = -(-parts // fan_in)
    out = lists.select("query_id", F.posexplode("found").alias("rank", "f"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.down")).alias("score"))


def op2_vp_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
