"""Tables that are kept as Parquet between steps."""

import numpy as np
from pyspark.sql import functions as F

from skein.functions import text
from skein.matrix import build, svd
from skein.nlp import normalize, peg
from skein.operators.order import written


def test_written_tables_are_the_same(spark):
    rows = spark.createDataFrame([(1, "a b", [1.0, 2.0]), (None, None, None), (1, "a b", [1.0, 2.0])], "`an id` long, t string, v array<double>")
    assert sorted(map(str, written(rows).collect())) == sorted(map(str, rows.collect()))
    none = written(rows.where("t = 'no'"))
    assert none.schema == rows.schema and none.count() == 0


def test_word_counts_are_kept_by_columns(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None)], "doc_id long, text string")
    out = text.tfidf(docs, "doc_id", "text")
    assert {(r["doc_id"], r["word"], round(r["tfidf"], 6)) for r in out.collect()} == {(1, "a", 1.098612), (1, "b", 0.81093), (2, "b", 0.405465), (2, "c", 1.098612)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan


def test_assertions_need_only_sentences_that_may_fit(spark):
    texts = ["The glorp is red. A glorp is in the wug! glorps and wugs", None, "", "Running makes you want to eat. the ÉLAN wants to be SEEN\nit is used for baking", "x " * 500 + "is y", "Not this one or that is it. -- !!"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    want = peg.assertions(peg.tagged(peg.sentences(docs, "doc_id", "text"), "doc_id"), "doc_id")
    for how in ({}, {"at_once": 1, "broadcast_words": 0}):
        got = peg.assertions_of(docs, "doc_id", "text", **how)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 3
    assert peg.assertions_of(docs.limit(0), "doc_id", "text").count() == 0
    assert not peg.may_fit("cats and dogs are pets".split()) and peg.may_fit("a cat is a pet".split()) and not peg.may_fit("a cat sleeps".split())


def test_turns_of_balancing_keep_factors_not_cells(spark, monkeypatch):
    kept, rows = build.kept, []

    def counted(df):
        rows.append(df.count())
        return kept(df)

    monkeypatch.setattr(build, "kept", counted)
    cells = [(i, j, 1.0 + (i * 7 + j * 3) % 5) for i in range(12) for j in range(10)] + [(12, 0, 0.0), (13, 1, 2.0)]
    out = build.balanced(spark.createDataFrame(cells, "row long, col long, v double"), most=3)
    got, want = np.zeros((14, 10)), np.zeros((14, 10))
    for r in out.collect():
        got[r["row"], r["col"]] = r["v"]
    for i, j, v in cells:
        want[i, j] = v
    for _ in range(3):
        want[want.any(axis=1)] /= np.linalg.norm(want[want.any(axis=1)], axis=1, keepdims=True)
        want /= np.linalg.norm(want, axis=0) / np.sqrt(13 / 10)
    assert np.allclose(got, want, rtol=1e-9) and out.count() == len(cells)
    assert rows[0] == len(cells) and max(rows[1:]) < 20


def test_search_for_the_largest_value_deals_cells_once(spark, monkeypatch):
    dealt, calls = svd.dealt, []
    monkeypatch.setattr(svd, "dealt", lambda df, by: calls.append(by) or dealt(df, by))
    m = np.random.default_rng(3).random((30, 20)) * (np.random.default_rng(4).random((30, 20)) < 0.4)
    m = np.kron(np.eye(2), m)  # each value twice
    cells = spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row long, col long, v double")
    assert abs(svd.svd(cells, 1, tolerance=1e-9, extra=2, small=8).sigma[0] - np.linalg.norm(m, 2)) < 1e-8 and calls == [["row"]]


def test_ngrams_at_each_place(spark):
    docs = spark.createDataFrame([(1, "a b  c"), (2, "x"), (3, None), (4, ""), (5, "p q")], "doc_id long, text string")
    out = text.placed_windows(docs.select("doc_id", "text"), text.tokens(F.col("text")), 3).select("doc_id", "start_at", "gram")
    want = [(1, 1, "a b c"), (1, 1, "a b"), (1, 1, "a"), (1, 2, "b c"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x"), (5, 1, "p q"), (5, 1, "p"), (5, 2, "q")]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_concepts_are_made_once(spark, tmp_path):
    from skein.plans import registry

    spark.createDataFrame([(1, "red cat"), (2, "red cat runs"), (3, "Red cat, red"), (4, None), (5, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.queries()["nlp04_concepts"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == sorted((i, c) for i in (1, 2, 3) for c in ("red", "cat", "red cat"))
    assert "documents.parquet" not in " ".join(out.inputFiles())  # texts aren't read again for the result


ODD = ["red cat", "Red  cat, red/cat (red) cat.", "red cat teh dont recieve", 'say "red cat" cannot n\'t \'tis', None, "", " ", "the of", "...---... a.b. !red! [cat] `red' cat\\", "red\ncat\r\nred", "ÉLAN cat: ÉLAN; red?! cat%", "x" * 50 + "....." * 200 + "y red cat"]


def test_words_are_made_once_for_concepts_of_odd_texts(spark, tmp_path):
    """no filter makes the words again below the repartition; ids that are null or repeated have each concept once."""
    import duckdb

    from skein.plans import registry

    rows = [(None if i % 5 == 4 else i % 7, t) for i, t in enumerate(ODD * 2)]
    for name, some in (("repeated", rows), ("single", list(enumerate(ODD)))):
        folder = tmp_path / name
        folder.mkdir()
        spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.parquet(str(folder / "documents.parquet"))
        got = sorted(map(str, (tuple(r) for r in registry.queries()["nlp04_concepts"](spark, str(folder)).collect())))
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
        assert got == sorted(map(str, con.execute(registry.oracle_sql()["nlp04_concepts"]).fetchall())) and len(got) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition("doc_id")
    for made in (normalize.word_pairs(docs, "doc_id", "text"), text.placed_windows(docs, normalize.words(F.col("text")), 2)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1, plan
