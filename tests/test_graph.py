"""Activation, level search, factors and streams."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.graph import activation
from skein.matrix import build, svd
from skein.operators import order, relational
from skein.streaming import live


def graph(spark, rows):
    return spark.createDataFrame(rows, "a string, rel string, b string, score double")


def best_first(edges, origins, weights, fade=0.5, queue=500, visits=500, top=200):
    """One entry after the other, from a sorted list."""
    leave, reach = defaultdict(list), defaultdict(list)
    for a, rel, b in sorted({e[:3] for e in edges}):
        leave[a].append((rel, b))
        reach[b].append((rel, a))
    discount = lambda n: math.exp(-((math.log(n + 5, 5) - 2.5) ** 2) / 2) / math.sqrt(2 * math.pi)
    waiting, seen = [(-w * discount(len(leave[c])), c) for c, w in origins], []
    while waiting and len(seen) < visits - 1:
        waiting.sort()
        x, c = waiting.pop(0)
        seen.append((-x, c))
        waiting += [(x * fade * discount(len(leave[b])) * weights.get(rel, 0), b) for rel, b in leave[c] if weights.get(rel, 0)]
        waiting += [(x * fade * discount(len(reach[a])) * weights.get("-" + rel, 0), a) for rel, a in reach[c] if weights.get("-" + rel, 0)]
        waiting = sorted(waiting)[:queue]
    found = defaultdict(float)
    for x, c in seen:
        if c not in dict(origins):
            found[c] = max(found[c], x) + (1 - max(found[c], x)) * min(found[c], x)
    return dict(sorted(found.items(), key=lambda p: (-p[1], p[0]))[:top])


@pytest.mark.parametrize("weights,how", [({"IsA": 0.9, "PartOf": 1.0}, {}), ({"IsA": 1.0, "-IsA": 0.7, "PartOf": 0.3}, {}), ({"IsA": 1.0, "PartOf": 1.0}, {"visits": 40, "top": 10}), (activation.DEFAULT_WEIGHTS, {"visits": 150})])
def test_spreading_visits_best_first(spark, weights, how):
    rng = np.random.default_rng(len(how) + len(weights))
    edges = [(f"n{a:02}", str(rel), f"n{b:02}", 1.0) for a, b, rel in zip(rng.integers(0, 60, 260), rng.integers(0, 60, 260), rng.choice(["IsA", "PartOf", "Causes", "Odd"], 260))]
    origins = [("n00", 1.0), ("n01", 0.4), ("nowhere", 1.0)]
    got = activation.spread(graph(spark, edges + edges[:9] + [("n00", "IsA", None, 1.0)]), spark.createDataFrame(origins, "concept string, weight double"), weights, **how).collect()
    want = best_first(edges, origins, weights, **how)
    assert {r["concept"]: r["activation"] for r in got} == pytest.approx(want) and len(want) > 5


def test_views_spread_together_as_each_alone(spark, monkeypatch):
    """steps are written once for all views and read once a round for all of them."""
    rng = np.random.default_rng(9)
    edges = [(f"n{a:02}", str(rel), f"n{b:02}", 1.0) for a, b, rel in zip(rng.integers(0, 40, 200), rng.integers(0, 40, 200), rng.choice(["IsA", "PartOf", "Odd"], 200))]
    origins, views = [("n00", 1.0), ("n01", 0.4)], {"one": {"IsA": 0.9}, "two": {"IsA": 0.2, "-PartOf": 1.0}, "none": {"Else": 1.0}}
    made, flows = [], activation.flows
    monkeypatch.setattr(activation, "flows", lambda *a: made.append(1) or flows(*a))
    got = defaultdict(dict)
    for r in activation.spread_views(graph(spark, edges), spark.createDataFrame(origins, "concept string, weight double"), views, visits=90).collect():
        got[r["view"]][r["concept"]] = r["activation"]
    assert len(made) == 1
    for view, weights in views.items():
        assert got[view] == pytest.approx(best_first(edges, origins, weights, visits=90))


def test_spreading_without_edges_or_origins(spark):
    none = graph(spark, [])
    assert activation.spread(none, spark.createDataFrame([("a", 1.0)], "concept string, weight double")).count() == 0
    assert activation.spread(graph(spark, [("a", "IsA", "b", 1.0)]), spark.createDataFrame([], "concept string, weight double")).count() == 0


def test_activation_stays_between_nothing_and_all(spark):
    rng = np.random.default_rng(1)
    g = graph(spark, [(f"n{a}", "IsA", f"n{b}", float(s)) for a, b, s in zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60), rng.random(60)) if a != b])
    origins = spark.createDataFrame([("n0", 1.0), ("n1", 1.0)], "concept string, weight double")
    got = activation.spread(g, origins).collect()
    assert got and all(0 < r["activation"] <= 1 for r in got) and not {"n0", "n1"} & {r["concept"] for r in got}


def test_levels_average_what_is_reached_again(spark):
    g = graph(spark, [("r", "x", "a", 1.0), ("r", "x", "b", 0.5), ("a", "x", "b", 1.0)])
    got = {r["concept"]: (r["weight"], r["level"]) for r in activation.related(g, spark.createDataFrame([("r",)], "concept string"), {"x": 1.0}, 2).collect()}
    # b: 0.5 at level 1, 1.0 / 2 at level 2, a level further: a quarter of the new one
    assert got == {"a": (1.0, 1), "b": (0.25 * 0.5 + 0.75 * 0.5, 1)}


def test_factors_against_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((30, 6)) @ np.diag([9, 5, 3, 2, 1, 0.5]) @ rng.standard_normal((6, 20))
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(30) for j in range(20)], "row int, col int, v double")
    f = svd.svd(cells, 4)
    u, s, v = np.linalg.svd(m, full_matrices=False)
    assert np.allclose(f.sigma, s[:4], rtol=1e-6)
    mine = {r["row"]: np.array(r["vector"]) for r in f.u.collect()}
    assert np.allclose(np.abs(np.array([mine[i] for i in range(30)])), np.abs(u[:, :4]), atol=1e-5)
    best = (u[:, :4] * s[:4]) @ v[:4]
    asked = spark.createDataFrame([(3, 4), (7, 19), (99, 0)], "row int, col int")
    got = {(r["row"], r["col"]): r["value"] for r in svd.evaluated(f, asked).collect()}
    assert got[3, 4] == pytest.approx(best[3, 4], abs=1e-5) and got[99, 0] == 0
    w = u[:, :4] * s[:4]
    near = [r["row"] for r in svd.similar(f, 2, 5).collect()]
    assert near == list(np.argsort(-(w @ w[2]))[:5])
    pred = [r["col"] for r in svd.predicted(f, 2, 5).collect()]
    assert pred == list(np.argsort(-best[2])[:5])
    assert svd.category(f, [1, 2, 77], 3).count() == 3
    with pytest.raises(KeyError):
        svd.category(f, [77])


def test_rank_less_than_asked_for_and_empty(spark):
    cells = spark.createDataFrame([("a", "x", 2.0), ("b", "y", 1.0)], "row string, col string, v double")
    assert svd.svd(cells, 5).sigma == pytest.approx([2.0, 1.0])
    assert svd.svd(cells.limit(0), 5).sigma == []


def test_normalized_rows_have_length_one(spark):
    cells = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 4.0), ("b", "x", 0.0)], "row string, col string, v double")
    assert sorted((r["row"], r["v"]) for r in build.normalized(cells).collect()) == [("a", 0.6), ("a", 0.8), ("b", 0.0)]


def test_numbers_over_partitions(spark):
    rows = spark.range(0, 5000, 1, 16).select((F.col("id") * 7919 % 5000).alias("x"))
    got = order.numbered(rows, [F.col("x")], "n").unionByName(order.numbered(rows, [F.desc("x")], "n"))
    assert got.where("n = x + 1").count() >= 5000 and got.select(F.sum("n")).first()[0] == 5000 * 5001


def test_pages_put_together_are_the_whole_order(spark):
    rows = spark.range(47).select((F.col("id") * 31 % 47).alias("x"))
    pages = [[r["x"] for r in relational.clamped_page(rows, ["x"], k, 10).collect()] for k in (1, 2, 3, 4, 5)]
    assert sum(pages, []) == list(range(47))
    last = relational.clamped_page(rows, ["x"], 99, 10).first()
    assert (last["page"], last["has_next"], last["has_last"], last["total"]) == (5, False, True, 47)


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    asked = []
    stop = lambda: asked.append(1) or len(asked) == 2
    stream = lambda: live.read(spark, f"{tmp_path}/in/*", "id long", files=1)
    stages = [("all", lambda b: b)]
    assert live.finish(live.staged(stream(), stages, f"{tmp_path}/out", stop)) is False
    assert spark.read.parquet(f"{tmp_path}/out/all/batch=*").count() == 10
    assert live.finish(live.staged(stream(), stages, f"{tmp_path}/out")) is True
    out = spark.read.parquet(f"{tmp_path}/out/all/batch=*")
    assert out.count() == out.distinct().count() == 30
