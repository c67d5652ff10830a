"""Assertions written once, concepts merged, requests and long sentences."""

from skein.nlp import parse
from skein.operators import relational as R
from skein.operators.components import connected
from skein.sources import fetch, search

RAW = "raw_id long, user_id long, sentence string, relation string, concept1 long, concept2 long, vote long"


def told(rows):
    return {kind: sorted((tuple(r) for r in frame.collect()), key=repr) for kind, frame in rows.items()}


def test_writing_makes_each_row_once(spark):
    raw = spark.createDataFrame([(1, 7, "s", "IsA", 1, 2, 1), (2, 7, "s", "IsA", 1, 2, 0), (3, 8, "s", "IsA", 1, 2, 1), (4, 8, "t", "IsA", 1, 2, -1), (5, 9, "t", "HasA", 2, 1, None), (9, None, None, None, None, 1, 1)], RAW)
    got = told(R.written(raw))
    assert got["sentences"][:2] == [(1, "s", 7), (4, "t", 8)] and len(got["sentences"]) == 3
    assert got["raw"] == [(1, 7, 1, 1), (3, 8, 1, 1), (4, 8, 4, 1), (5, 9, 4, 5), (9, None, 9, 9)]
    assert got["votes"] == [(8, 1, -1), (None, 9, 1)]  # 7 took the vote back, 8 changed it, 9 cast none
    assert {(r[0], r[4]) for r in got["assertions"]} == {(1, -1), (5, 0), (9, 1)}
    assert len(got["events"]) == 3 + 5 + 3 + 2
    assert all(not rows for rows in told(R.written(raw.limit(0))).values())


def test_merged_concepts_point_to_the_smallest(spark):
    raw = spark.createDataFrame([(1, 7, "s", "IsA", 5, 2, 1), (2, 7, "s", "IsA", 3, 6, 1), (3, 7, "s", "IsA", 8, None, 1), (4, 7, "s", "IsA", 1, 2, 1)], RAW)
    rows, audit = R.merged_concepts(raw, spark.createDataFrame([(5, 3), (1, 3), (6, 2), (None, 8), (4, 4)], "a long, b long"))
    assert sorted(((r["raw_id"], r["concept1"], r["concept2"]) for r in rows.collect()), key=repr) == [(1, 1, 2), (2, 1, 2), (3, 8, None), (4, 1, 2)]
    assert sorted(map(tuple, audit.collect())) == [(1, 5, 2, 1, 2), (2, 3, 6, 1, 2)] and rows.columns == raw.columns
    rows, audit = R.merged_concepts(raw, spark.createDataFrame([], "a long, b long"))
    assert audit.count() == 0 and rows.count() == 4


def test_components_of_stars_chains_and_nothing(spark):
    pairs = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3), (-5, 2000)]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(1000, 1061), 1000), -5: -5, 2000: -5}


def test_requests_of_a_table(spark):
    rows = spark.createDataFrame([(["a", "b"], ["c"], 120), (["x"], None, 50), (["y"], [], 0)], "terms array<string>, exclude array<string>, most int")
    got = sorted(map(tuple, search.requested(rows, 50).collect()))
    assert got == sorted([(q, k) for q in ('"a" "b" -"c"', '"b" "a" -"c"') for k in (0, 50, 100)] + [('"x"', 0)])


def test_objects_in_memory_may_be_rows(spark):
    got = fetch.acquire(spark, spark.createDataFrame([(1, "t"), (2, ""), (3, None)], "name int, text string"), "o").collect()
    assert [tuple(r) for r in got] == [("1", "t", None), ("2", "", "empty"), ("3", None, "empty")]


def test_long_sentences_are_read_or_told_to_hold_nothing():
    noun = " ".join(["big"] * 5 + ["dog"])
    assert parse.parse(f"a {noun} is part of a {noun}") == ("PartOf", f"a {noun}", f"a {noun}")
    assert parse.parse(f"a {noun} is part of a {noun}", longest=6) is None  # a concept of more words
    assert parse.parse("word " * 200_000) is None and parse.parse("dog is " * 5000) is None
