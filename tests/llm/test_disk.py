"""What a job leaves on disk and on the driver goes before the next one."""

from skein.llm import jaccard_join, quality


def test_values_are_told_order_by_order(spark, monkeypatch):
    """Each order's joins carry one value and end before the next one's, so that their shuffles don't pile up."""
    kept, cut = [], quality.cut
    monkeypatch.setattr(quality, "cut", lambda df: kept.append(df.columns) or cut(df))
    rows = spark.createDataFrame([(0, "abcab", 2), (0, "bcabc", 1), (0, "cabca", 3)], "fold int, gram string, n long")
    levels, vocabulary = quality.kneser_ney(rows)
    kept.clear()
    asked = spark.createDataFrame([(0, "abcab"), (0, "zzzzz"), (0, "zbcab")], "fold int, gram string")
    got = {r["gram"]: r["value"] for r in quality.values_of(asked, levels, vocabulary).collect()}
    assert kept == [["fold", "gram", "value"]] * (quality.ORDER - 1)
    assert got["abcab"] > got["zzzzz"] and len(got) == 3


def test_join_tidies_between_its_parts(spark, monkeypatch):
    calls, tidy = [], jaccard_join.tidy
    monkeypatch.setattr(jaccard_join, "tidy", lambda session: calls.append(1) or tidy(session))
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten w{i % 3}") for i in range(9)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == dict.fromkeys(range(9), 0) or got == {i: i % 3 for i in range(9)}
    assert len(calls) >= 5


def test_join_has_executors_give_back_heap_between_its_parts(spark, monkeypatch):
    """The pipeline's check on many partitions: a heap that only grows leaves no room for the Python workers."""
    calls, shrink = [], jaccard_join.shrink_heaps
    monkeypatch.setattr(jaccard_join, "shrink_heaps", lambda session: calls.append(1) or shrink(session))
    docs = spark.createDataFrame([(i, f"one two three four five six seven eight nine ten w{i % 3}") for i in range(9)], "doc_id long, text string")
    assert jaccard_join.one_of_each_group(docs).count() in (1, 3)
    assert len(calls) >= 4
