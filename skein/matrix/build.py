"""Sparse matrices and tensors in long form: (row, column, value) and (a, rel, b, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import dealt, hinted, kept
from .svd import largest


def tensor(edges: DataFrame, mirrored: bool = False) -> DataFrame:
    """a, rel, b, w: weights of equal (a, rel, b) added up; mirrored: also (b, '-' rel, a)."""
    sums = edges.groupBy("a", "rel", "b").agg(F.sum("w").alias("w"))
    if not mirrored:
        return sums
    return sums.unionByName(sums.select(F.col("b").alias("a"), F.concat(F.lit("-"), "rel").alias("rel"), F.col("a").alias("b"), "w"))


def matrix_last(edges: DataFrame, order: str) -> DataFrame:
    """a, b, w: of edges of equal (a, b) the last in ``order`` counts."""
    return edges.groupBy("a", "b").agg(F.max_by("w", order).alias("w"))


def flat(edges: DataFrame, forward: dict[str, float], usual: float, inverse: dict[str, float], usual_inverse: float, identity: float) -> DataFrame:
    """a, b, w: concepts by concepts, each edge (a, rel, b) with its relation's weight and back with its inverse's, all
    added up, and no diagonal cell under ``identity``."""
    weight = lambda known, other: F.coalesce(*[F.when(F.col("rel") == k, v) for k, v in known.items()], F.lit(other))
    ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b"), weight(forward, usual).alias("w")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), weight(inverse, usual_inverse).alias("w")))
    cells = edges.select(F.explode(ways).alias("c")).select("c.*")
    diagonal = edges.select(F.explode(F.array("a", "b")).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0.0).alias("w"))
    sums = cells.unionByName(diagonal).groupBy("a", "b").agg(F.sum("w").alias("w"))
    return sums.withColumn("w", F.when(F.col("a") == F.col("b"), F.greatest("w", F.lit(identity))).otherwise(F.col("w")))


def features(edges: DataFrame, value: Column) -> DataFrame:
    """concept, side, rel, other, v: each edge (a, rel, b) as a feature of either end, values of equal ones added up."""
    ends = F.array(
        F.struct(F.col("a").alias("concept"), F.lit("right").alias("side"), F.col("rel"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("concept"), F.lit("left").alias("side"), F.col("rel"), F.col("a").alias("other")),
    )
    sums = edges.select("a", "rel", "b", value.alias("v")).groupBy("a", "rel", "b").agg(F.sum("v").alias("v"))
    return sums.select(F.explode(ends).alias("f"), "v").select("f.*", "v")


def by_relation(edges: DataFrame) -> DataFrame:
    """row (concept, side), col (concept): a matrix for each relation, told apart by column rel."""
    return edges.groupBy("rel", "a", "b").agg(F.count("*").alias("v"))


def co_occurrence(lists: DataFrame, key: str, items: str) -> DataFrame:
    """a, b, v: in how many rows two different items stand together, for rows (key, array of items)."""
    one = lists.select(key, F.explode(F.array_distinct(items)).alias("a"))
    x, y = one, one.select(F.col(key).alias("_k"), F.col("a").alias("b"))
    met = x.join(y, (F.col(key) == F.col("_k")) & (F.col("a") < F.col("b")))
    return met.groupBy("a", "b").agg(F.count("*").alias("v"))


def identities(edges: DataFrame, weight: float = 5**0.5, rel: str = "InheritsFrom") -> DataFrame:
    """concept, side, rel, other, v: each concept as its own ancestor, both ways."""
    labels = edges.select(F.explode(F.array("a", "b")).alias("concept")).distinct()
    sides = F.explode(F.array(F.lit("right"), F.lit("left"))).alias("side")
    return labels.select("concept", sides, F.lit(rel).alias("rel"), F.col("concept").alias("other"), F.lit(weight).alias("v"))


def normalized(cells: DataFrame, row: str = "row", value: str = "v") -> DataFrame:
    """Cells divided by the length of their row; rows of zeros stay zero."""
    length = cells.groupBy(row).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_length"))
    scaled = F.when(F.col("_length") > 0, F.col(value) / F.col("_length")).otherwise(0.0)
    return cells.join(length, row).withColumn(value, scaled).drop("_length")


def blended(parts: list[DataFrame]) -> DataFrame:
    """row, col, v: cells of all parts added up, each part divided by its largest singular value, found by a search of
    its own; parts of zeros or without cells add nothing."""
    out = None
    for cells in parts:
        sigma = largest(cells)
        mine = cells.select("row", "col", (F.col("v") / sigma if sigma else F.lit(0.0)).alias("v"))
        out = mine if out is None else out.unionByName(mine)
    return out.groupBy("row", "col").agg(F.sum("v").alias("v"))


def balanced(cells: DataFrame, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """Cells (row, col, v) scaled by row and by column until all rows have one length and all columns another: rows are
    brought to length 1, then columns to the common length that the same sum of squares gives them, in turn, until no
    row is off by more than ``tolerance`` or ``most`` turns are over. Cells of zero stay; where the pattern of cells
    allows no such scaling, the turns end at ``most``."""
    cells = kept(dealt(cells.select("row", "col", F.col("v").cast("double").alias("v")), ["row"]))
    rows, columns = cells.where("v <> 0").agg(F.count_distinct("row"), F.count_distinct("col")).first()
    if not rows:
        return cells
    # Cells stay where they are, dealt by row; what changes from turn to turn is a factor of each row and column.
    squares = cells.select("row", "col", (F.col("v") * F.col("v")).alias("_s")).where("_s > 0")
    by_col = kept(squares.select("col").distinct().select("col", F.lit(1.0).alias("_c")))
    by_row = None
    for turn in range(most + 1):
        sums = squares.join(hinted(by_col), "col").groupBy("row").agg(F.sum(F.col("_s") * F.col("_c")).alias("_now"))
        if turn:
            if turn == most or by_row.join(sums, "row").agg(F.max(F.abs(F.col("_r") * F.col("_now") - 1))).first()[0] <= tolerance:
                break
        by_row = kept(sums.select("row", (1 / F.col("_now")).alias("_r")))
        sums = squares.join(by_row, "row").groupBy("col").agg(F.sum(F.col("_s") * F.col("_r")).alias("_now"))
        by_col = kept(sums.select("col", (rows / (F.col("_now") * columns)).alias("_c")))
    met = cells.join(by_row, "row", "left").join(hinted(by_col), "col", "left")
    return met.select("row", "col", F.coalesce(F.col("v") * F.sqrt("_r") * F.sqrt("_c"), F.lit(0.0)).alias("v"))
