import pytest
from pyspark.sql import functions as F

from skein.functions import html, math, text, url
from skein.operators import relational


def value(spark, column, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column.alias("v")).first()["v"]


def test_lexicon_counts_ignore_case_and_punctuation(spark):
    words = text.tokens(F.col("t"))
    row = value(spark, F.struct(text.hits(words, ["nice"]).alias("p"), text.hits(words, ["sad", "awful"]).alias("n")), t="nice SAD? dull, aWful")
    assert (row["p"], row["n"]) == (1, 2)


def test_windows_longest_first(spark):
    got = value(spark, text.windows(F.split(F.col("t"), " "), 2), t="a b c")
    assert got == ["a b", "a", "b c", "b", "c"]


def test_equation_divides_by_zero_to_null_and_rejects_names(spark):
    row = spark.sql("select 1L as pos, 1L as neg, 0L as obscene")
    assert row.select(math.equation("(pos + neg) / obscene").alias("v")).first()["v"] is None
    assert row.select(math.equation("pos / (neg + 1)").alias("v")).first()["v"] == 0.5
    with pytest.raises(ValueError):
        math.equation("__import__('os')")


def test_noisy_or_between_maximum_and_one(spark):
    assert value(spark, math.noisy_or(F.col("a"), F.col("b")), a=0.5, b=0.5) == 0.75


def test_good_url_needs_http_and_no_fragment_after_the_start(spark):
    assert value(spark, url.good(F.col("u"), ["bad"]), u="HTTP://a.example/x") is True
    assert value(spark, url.good(F.col("u"), ["bad"]), u="http://bad.example/x") is False


def test_text_nodes_and_markdown():
    page = "<h1>T</h1><script>x()</script><p>a <b>b</b> &amp; <a href='/z'>z</a></p>"
    assert html.parse_nodes(page) == ["T", "a", "b", "&", "z"]
    assert html.to_markdown(page).startswith("# T") and "**b**" in html.to_markdown(page) and "[1]: /z" in html.to_markdown(page)


def test_last_vote_wins_and_zero_deletes(spark):
    votes = spark.createDataFrame([(1, "x", 1, 1), (1, "x", -1, 2), (2, "x", 1, 1), (2, "x", 0, 2)], "user_id int, object_type string, vote int, ts int")
    assert [(r["user_id"], r["vote"]) for r in relational.last_vote(votes, [F.desc("ts")]).collect()] == [(1, -1)]


def test_link_expansion_stops_at_depth(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "url string, target string")
    got = relational.expand_links(links, spark.createDataFrame([("a",)], "url string"), 2)
    assert sorted(map(tuple, got.collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_rows_as_structs_keep_nulls_and_round_as_sql(spark, tmp_path):
    import duckdb

    from skein.plans import registry

    con = duckdb.connect()
    for name, sql in (("nation", "select 1 as n_nationkey, 'N' as n_name"), ("customer", "select i as c_custkey, 'C' || i as c_name, 1 as c_nationkey, (i - 40000) / 1000.0::double as c_acctbal from range(90000) r(i) union all select null, null, 1, null")):
        con.execute(f"create table {name} as {sql}")
        con.execute(f"copy {name} to '{tmp_path}/{name}.parquet'")
    got = [r["item"] for r in registry.queries()["prj01_rows_as_structs"](spark, str(tmp_path)).collect()]
    want = [r[0] for r in con.execute(registry.oracle_sql()["prj01_rows_as_structs"]).fetchall()]
    assert sorted(got) == sorted(want)
