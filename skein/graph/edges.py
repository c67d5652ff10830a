"""Assertions as edges (a, rel, b, score): adjacency, features, analogies and words for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import hinted


def adjacency(edges: DataFrame) -> DataFrame:
    """concept, forward and reverse: sorted lists of (rel, other, score) of the edges that leave and reach a concept.

    Lists are for concepts of few edges; operators here work on edges, not on lists.
    """
    item = lambda end: F.struct("rel", F.col(end).alias("other"), "score")
    out = edges.groupBy(F.col("a").alias("concept")).agg(F.array_sort(F.collect_list(item("b"))).alias("forward"))
    back = edges.groupBy(F.col("b").alias("concept")).agg(F.array_sort(F.collect_list(item("a"))).alias("reverse"))
    none = F.expr("filter(array(struct('' as rel, cast(null as bigint) as other, 0D as score)), x -> false)")
    return out.join(back, "concept", "full").select("concept", *[F.coalesce(c, none.cast(out.schema["forward"].dataType)).alias(c) for c in ("forward", "reverse")])


def features_of(edges: DataFrame, concept) -> DataFrame:
    """side, rel, other: what is said of the concept, on either side."""
    right = edges.where(F.col("a") == concept).select(F.lit("right").alias("side"), "rel", F.col("b").alias("other"))
    return right.unionByName(edges.where(F.col("b") == concept).select(F.lit("left").alias("side"), "rel", F.col("a").alias("other"))).distinct()


def with_feature(edges: DataFrame, side: str, rel: str, other) -> DataFrame:
    """The edges that say the feature of some concept."""
    end = "b" if side == "right" else "a"
    return edges.where((F.col("rel") == rel) & (F.col(end) == other))


def link_strength(f1: Column, f2: Column, i1: Column, i2: Column) -> Column:
    return F.log(f1 + f2 + (i1 + i2) / 2 + 2) / F.log(F.lit(4.0))


#: How much relations count for analogies; others count 1.
RELATION_WEIGHTS = {"HasProperty": 3.0, "UsedFor": 2.0, "CapableOf": 2.0, "ReceivesAction": 1.5}


def analogous(edges: DataFrame, concept, skip: list[str], weights: dict[str, float] = RELATION_WEIGHTS) -> DataFrame:
    """other, strength, shared: concepts that share features (rel, b) with the concept, by the sum of link strengths.

    edges: a, rel, b, score, and optionally inverse (frequency of the edge said the other way round).
    """
    e = edges.where(~F.col("rel").isin(skip)) if skip else edges
    e = e.withColumn("inverse", F.coalesce("inverse", F.lit(0.0)) if "inverse" in e.columns else F.lit(0.0))
    own = e.where(F.col("a") == concept).select("rel", "b", F.col("score").alias("s1"), F.col("inverse").alias("i1"))
    met = e.where(F.col("a") != concept).join(hinted(own), ["rel", "b"])
    weight = F.coalesce(*[F.when(F.col("rel") == r, w) for r, w in weights.items()], F.lit(1.0))
    strength = link_strength(F.col("s1"), F.col("score"), F.col("i1"), F.col("inverse")) * weight
    rows = met.groupBy(F.col("a").alias("other")).agg(F.sum(strength).alias("strength"), F.array_sort(F.collect_set(F.concat_ws("/", "rel", F.col("b").cast("string")))).alias("shared"))
    return rows


def realised(props: DataFrame, frames: DataFrame, surfaces: DataFrame) -> DataFrame:
    """props (a, rel, b) with said: the relation's best frame (by goodness, frequency, least id) filled with the best
    surface (by use_count, least id) of both concepts."""
    frame = Window.partitionBy("rel").orderBy(F.desc("goodness"), F.desc("frequency"), "frame_id")
    best = frames.withColumn("_n", F.row_number().over(frame)).where("_n = 1").select("rel", F.col("text").alias("_frame"))
    surface = surfaces.groupBy("concept").agg(F.max_by("text", F.struct("use_count", -F.col("surface_id"))).alias("text"))
    one, two = (surface.select(F.col("concept").alias(end), F.col("text").alias(f"_{end}")) for end in ("a", "b"))
    met = props.join(F.broadcast(best), "rel").join(one, "a").join(two, "b")  # a relation has one best frame, relations are few
    said = F.replace(F.replace("_frame", F.lit("{1}"), F.col("_a")), F.lit("{2}"), F.col("_b"))
    return met.select(*props.columns, said.alias("said"))


#: Relations by their old names.
RENAMED = {
    "FirstSubeventOf": "HasFirstSubevent",
    "DesirousEffectOf": "CausesDesire",
    "ThematicKLine": "ConceptuallyRelatedTo",
    "SubeventOf": "HasSubevent",
    "SuperThematicKLine": "ConceptuallyRelatedTo",
    "LastSubeventOf": "HasLastSubevent",
    "LocationOf": "AtLocation",
    "CapableOfReceivingAction": "ReceivesAction",
    "PrerequisiteEventOf": "HasPrerequisite",
    "MotivationOf": "MotivatedByGoal",
    "PropertyOf": "HasProperty",
    "EffectOf": "Causes",
    "DesireOf": "Desires",
}


def renamed(rel: Column) -> list[Column]:
    """The relation's present name and whether it is meant the other way round (by its ending)."""
    inverse = rel.endswith("Inverse")
    bare = F.regexp_replace(rel, "Inverse$", "")
    known = F.create_map(*[F.lit(x) for pair in RENAMED.items() for x in pair])
    return [F.coalesce(F.element_at(known, bare), bare).alias("relation"), inverse.alias("inverse")]


def feature_notation(side: Column, rel: Column, concept: Column) -> Column:
    """concept\\rel for a left feature, rel/concept for a right one."""
    return F.when(side == "left", F.concat(concept, F.lit("\\"), rel)).otherwise(F.concat(rel, F.lit("/"), concept))
