"""Spreading activation and level search over edges (a, rel, b, score), score from 0 to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import branching_discount
from ..operators.order import hinted, kept, written

#: How much relations count for spreading, said of a concept; others, and all said of it in others, count 0.
DEFAULT_WEIGHTS = {
    "AtLocation": 0.9,
    "CapableOf": 0.8,
    "Causes": 1.0,
    "CausesDesire": 1.0,
    "ConceptuallyRelatedTo": 1.0,
    "CreatedBy": 1.0,
    "DefinedAs": 1.0,
    "Desires": 1.0,
    "HasFirstSubevent": 1.0,
    "HasLastSubevent": 1.0,
    "HasPrerequisite": 1.0,
    "HasProperty": 1.0,
    "HasSubevent": 0.9,
    "IsA": 0.9,
    "MadeOf": 0.7,
    "MotivatedByGoal": 1.0,
    "PartOf": 1.0,
    "ReceivesAction": 0.6,
    "UsedFor": 1.0,
}

#: Named views by their relations' weights; others count 0.
VIEWS = {
    "affective": {"Desires": 1.0, "CausesDesire": 1.0, "MotivatedByGoal": 1.0},
    "spatial": {"AtLocation": 1.0, "ConceptuallyRelatedTo": 0.5},
    "details": {"HasFirstSubevent": 1.0, "HasLastSubevent": 1.0, "HasSubevent": 1.0, "MadeOf": 1.0, "PartOf": 1.0, "HasProperty": 0.9},
    "consequences": {"CausesDesire": 1.0, "UsedFor": 0.4, "CapableOf": 0.4, "ReceivesAction": 0.3, "Causes": 1.0},
    "utility": {"UsedFor": 1.0, "CapableOf": 1.0},
    "all": DEFAULT_WEIGHTS,
}


def steps(edges: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """a, b, w of every step along an edge or against it; against it counts as relation '-rel' (0 if not given).
    Without weights all relations count 1 both ways."""
    ways = F.array(F.struct(F.col("a"), F.col("rel"), F.col("b")), F.struct(F.col("b").alias("a"), F.concat(F.lit("-"), "rel").alias("rel"), F.col("a").alias("b")))
    rows = edges.select(F.explode(ways).alias("s"), "score").select("s.*", "score")
    weight = F.lit(1.0) if weights is None else F.coalesce(*[F.when(F.col("rel") == r, w) for r, w in weights.items()], F.lit(0.0))
    return rows.select("a", "b", (F.col("score") * weight).alias("w")).where("w > 0")


def noisy_or_all(x: Column) -> Column:
    """1 - product of (1 - x) over a group; 1 as soon as some x is 1."""
    return F.when(F.max(x) >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.log(F.when(x < 1, 1 - x).otherwise(1.0)))))


def _degrees(rows: DataFrame) -> DataFrame:
    return rows.groupBy("a").agg(F.count("*").alias("degree"))


def one_hop(edges: DataFrame, origins: DataFrame, weights: dict[str, float] | None = None, fade: float = 0.5) -> DataFrame:
    """concept, activation after one step from origins (concept, weight): each start counts its weight times the
    discount of its branches, each step ``fade`` times the discount of the reached concept's and the step's weight."""
    rows = steps(edges, weights)
    return _hop(rows, _degrees(rows), _started(origins, _degrees(rows)), fade)


def _started(origins: DataFrame, degrees: DataFrame) -> DataFrame:
    met = origins.join(degrees, F.col("concept") == F.col("a"), "left")
    return met.select("concept", (F.col("weight") * branching_discount(F.coalesce("degree", F.lit(0)))).alias("activation"))


def _hop(rows: DataFrame, degrees: DataFrame, frontier: DataFrame, fade: float) -> DataFrame:
    met = rows.join(hinted(frontier.withColumnRenamed("concept", "a"), 100_000), "a").select("b", (F.col("activation") * F.col("w")).alias("x"))
    met = met.join(degrees.withColumnRenamed("a", "b"), "b", "left")
    x = F.col("x") * fade * branching_discount(F.coalesce("degree", F.lit(0)))
    return met.groupBy(F.col("b").alias("concept")).agg(noisy_or_all(x).alias("activation"))


def flows(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """a, rel, b, discount: steps along edges and, as relation '-rel', against them, of relations of a weight above 0 only.
    The discount is that of b's branches (edges that leave it; for a step against an edge, edges that reach it). Repeated
    edges (a, rel, b) are one."""
    known = edges.select("a", "rel", "b").where("a is not null and b is not null").distinct()
    met = [r for r, w in weights.items() if w > 0]

    def steps_by(sign: str, a: str, b: str) -> DataFrame:
        degree = known.groupBy(F.col(a).alias("_to")).agg(F.count("*").alias("_n"))
        rows = known.select(F.col(a).alias("a"), F.concat(F.lit(sign), "rel").alias("rel"), F.col(b).alias("b")).where(F.col("rel").isin(met))
        found = rows.join(degree, F.col("b") == F.col("_to"), "left")
        return found.select("a", "rel", "b", branching_discount(F.coalesce("_n", F.lit(0))).alias("discount"))

    forward = steps_by("", "a", "b")
    return forward.unionByName(steps_by("-", "b", "a")) if any(r.startswith("-") for r in met) else forward


def spread(edges: DataFrame, origins: DataFrame, weights: dict[str, float] | None = None, fade: float = 0.5, queue: int = 500, visits: int = 500, top: int = 200) -> DataFrame:
    """concept, activation of the ``top`` concepts that spreading from origins (concept, weight) visits, best first.

    A visit is of a concept by one way: the waiting entry of greatest activation is visited next (ties: the smaller
    concept) and adds an entry for each step from there (see ``flows``; ``DEFAULT_WEIGHTS`` if none are given), until
    fewer than ``visits`` have been made or none waits; of those that wait the best ``queue`` stay. Visits of one concept
    add up as a noisy or; origins, which start with their weight times the discount of their branches, aren't in the result.
    Null concepts and concepts without edges reach nothing; repeated origins are entries each.
    """
    views = {"": DEFAULT_WEIGHTS if weights is None else weights}
    return spread_views(edges, origins, views, fade, queue, visits, top).drop("view").orderBy(F.desc("activation"), "concept")


def spread_views(edges: DataFrame, origins: DataFrame, views: dict[str, dict[str, float]], fade: float = 0.5, queue: int = 500, visits: int = 500, top: int = 200) -> DataFrame:
    """view, concept, activation: ``spread`` by the weights of each view.

    The order of visits over the whole graph is kept, though many are made at once: a step leaves at most the greatest
    factor of all, so all entries above that share of the best one come before anything that these can add. Each round
    visits this bucket of every view and joins at most ``queue`` rows a view with the steps, which are made and written
    once for all views; a round reads them once, only those that leave the visited concepts go on.
    """
    spark = edges.sparkSession
    known = edges.select("a", "rel", "b").where("a is not null and b is not null").distinct()
    wanted = {r: max(w.get(r, 0.0) for w in views.values()) for weights in views.values() for r in weights}
    rows = written(flows(edges, wanted))
    degree = known.join(F.broadcast(origins.select(F.col("concept").alias("a")).distinct()), "a", "left_semi").groupBy("a").agg(F.count("*").alias("degree"))
    weight = spark.createDataFrame([(v, r, float(x)) for v, w in views.items() for r, x in w.items() if x > 0], "view string, rel string, w double")
    names = spark.createDataFrame([(v,) for v in views], "view string")
    waiting = kept(_started(origins, degree).crossJoin(F.broadcast(names)))
    passed = lambda x: x * fade * F.col("discount") * F.col("w")
    most = rows.groupBy("rel").agg(F.max("discount").alias("discount")).join(weight, "rel").groupBy("view").agg(F.max(passed(F.lit(1.0))).alias("reach"))
    reach = {r["view"]: r["reach"] for r in most.collect()}
    share = spark.createDataFrame([(v, reach.get(v, 0.0)) for v in views], "view string, reach double")
    left, visited = dict.fromkeys(views, visits - 1), []
    best = Window.partitionBy("view").orderBy(F.desc("activation"), "concept")  # a view has few entries
    while True:
        greatest = {r["view"]: r["most"] for r in waiting.groupBy("view").agg(F.max("activation").alias("most")).collect()}
        going = [(v, left[v], greatest[v]) for v in views if left[v] > 0 and greatest.get(v)]
        if not going:
            break
        limits = F.broadcast(spark.createDataFrame(going, "view string, most int, greatest double").join(share, "view"))
        ranked = waiting.join(limits, "view").withColumn("now", F.col("activation") > F.col("reach") * F.col("greatest") * (1 + 1e-12))  # products are rounded in another order
        ranked = kept(ranked.withColumn("nth", F.row_number().over(best)).select("view", "concept", "activation", "now", "nth", "most"))
        now = ranked.where("now and nth <= most").select("view", "concept", "activation")  # at most ``queue`` rows a view
        visited.append(now)
        for r in now.groupBy("view").count().collect():
            left[r["view"]] -= r["count"]
        steps_on = rows.join(F.broadcast(now.withColumnRenamed("concept", "a")), "a").join(F.broadcast(weight), ["view", "rel"])
        new = steps_on.select("view", F.col("b").alias("concept"), passed(F.col("activation")).alias("activation"))
        waiting = ranked.where("not now").select("view", "concept", "activation").unionByName(new).where("activation > 0")
        waiting = kept(waiting.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= queue).drop("nth"))
    if not visited:
        return waiting.select("view", "concept", "activation").limit(0)
    out = visited[0]
    for more in visited[1:]:
        out = out.unionByName(more)
    out = out.join(origins.select("concept").distinct(), "concept", "left_anti")
    out = out.groupBy("view", "concept").agg(noisy_or_all(F.col("activation")).alias("activation"))
    return out.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= top).select("view", "concept", "activation")


def related(edges: DataFrame, roots: DataFrame, weights: dict[str, float] | None = None, levels: int = 2, expand: int = 100) -> DataFrame:
    """concept, weight, level: level search from roots (concept). A concept's weight is its parent's times the step's
    divided by the level; one reached again has the mean of old and new weight, the new one counting 1 / (2 (d + 1)) at
    a distance of d levels. The ``expand`` best of a level go on."""
    rows = kept(steps(edges, weights))
    frontier = roots.select("concept").distinct().select("concept", F.lit(1.0).alias("weight"))
    found = None
    for level in range(1, levels + 1):
        best = frontier.orderBy(F.desc("weight"), "concept").limit(expand).withColumnRenamed("concept", "a")
        met = rows.join(F.broadcast(best), "a").join(roots.select(F.col("concept").alias("b")), "b", "left_anti")  # at most ``expand`` rows
        new = kept(met.groupBy(F.col("b").alias("concept")).agg(F.avg(F.col("weight") * F.col("w") / level).alias("weight")).withColumn("level", F.lit(level)))
        if found is None:
            found, frontier = new, new.select("concept", "weight")
            continue
        old = found.select("concept", F.col("weight").alias("was"), F.col("level").alias("first"))
        both = new.join(old, "concept", "full")
        mean = level_mean(F.col("was"), F.col("weight"), F.lit(level) - F.col("first"))
        fresh = kept(both.where("was is null").select("concept", "weight"))
        found = kept(both.select("concept", F.when(F.col("was").isNull(), F.col("weight")).when(F.col("weight").isNull(), F.col("was")).otherwise(mean).alias("weight"), F.coalesce("first", "level").alias("level")))
        frontier = fresh
    return found


def level_mean(old: Column, new: Column, distance: Column) -> Column:
    share = 1 / (2 * (distance + 1))
    return share * new + (1 - share) * old


def projection(edges: DataFrame, origins: DataFrame, view: str, **how) -> DataFrame:
    """``spread`` by the weights of a named view."""
    return spread(edges, origins, VIEWS[view], **how)


def beam(edges: DataFrame, starts: list[str], steps: int, width: int) -> DataFrame:
    """concept, weight: the best ``width`` of what each step from the starts reaches, weights multiplied; edges (a, b, w)."""
    rows = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    now = edges.sparkSession.createDataFrame([(s, 1.0) for s in starts], "concept string, weight double")
    for _ in range(steps):
        met = rows.join(F.broadcast(now.withColumnRenamed("concept", "a")), "a")  # at most ``width`` rows
        now = met.groupBy(F.col("b").alias("concept")).agg(F.max(F.col("weight") * F.col("w")).alias("weight"))
        now = kept(now.orderBy(F.desc("weight"), "concept").limit(width))
    return now
