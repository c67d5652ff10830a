from pyspark.sql import functions as F

from skein.matrix import build as B
from skein.operators.order import dealt


def test_parts_grow_with_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), "id")
    assert dealt(rows, ["id"], 100).rdd.getNumPartitions() == 10 and dealt(rows, ["id"], 10**6).rdd.getNumPartitions() == 4
    assert dealt(rows, ["a"], 100).count() == 1000 and dealt(rows.limit(0), ["a"]).count() == 0


def test_features_add_up_edges_not_their_ends(spark, capsys):
    """One shuffle, by edge; both ends are made of sums."""
    edges = spark.createDataFrame([(1, "r", 2, 1.0), (1, "r", 2, 2.0), (3, "r", 3, 5.0), (None, "r", 2, 1.0)], "a long, rel string, b long, w double")
    out = B.features(edges, F.col("w"))
    got = {tuple(r) for r in out.collect()}
    assert got == {(1, "right", "r", 2, 3.0), (2, "left", "r", 1, 3.0), (3, "right", "r", 3, 5.0), (3, "left", "r", 3, 5.0), (None, "right", "r", 2, 1.0), (2, "left", "r", None, 1.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the explosion is above the sums


def test_lines_of_orders_are_dealt_by_count(spark, tmp_path):
    from skein.plans import registry

    spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 2), (3, 9)], "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = registry.queries()["mat02_co_occurrence"](spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [(1, 2, 2)]
    assert "RepartitionByExpression [l_orderkey" in out._jdf.queryExecution().optimizedPlan().toString()
