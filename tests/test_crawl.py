"""Visits and parsed pages, value by value."""

from pyspark.sql import functions as F

from skein.functions import html as H
from skein.pipelines import crawl

PAGE = '<html><head><meta name="a" content="b"><title>T</title></head><body><p>The cat sat here. It ran off. Far away it went.</p><script>the</script><p>No "idiot" the\n one</p><a href="/x">the link</a></body></html>'


def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain text of the good kind")], "page_id long, html string")


def test_keyword_nodes_are_texts_with_the_word(spark):
    got = pages(spark).select("page_id", F.posexplode(H.keyword_nodes(F.col("html"), "THE")).alias("pos", "node")).collect()
    assert sorted((r["page_id"], r["pos"], " ".join(r["node"].split())) for r in got) == [(1, 0, "The cat sat here. It ran off. Far away it went."), (1, 1, 'No "idiot" the one'), (1, 2, "the link"), (4, 0, "plain text of the good kind")]


def test_pages_are_parsed_into_content_meta_and_links(spark):
    criteria = spark.createDataFrame([(1, "the", "idiot"), (2, "idiot", "cat")], "criteria_id int, include string, exclude string")
    got = sorted(((r["page_id"], r["kind"], r["criteria_id"], r["value"]) for r in crawl.parse_pages(pages(spark), criteria).collect()), key=repr)
    content = [r for r in got if r[1] == "content"]
    assert content == sorted([(1, "content", 1, "The cat sat here. It ran off. Far away it went."), (1, "content", 1, "the link"), (1, "content", 2, "No ``idiot`` the one"), (4, "content", 1, "plain text of the good kind")], key=repr)
    assert [r for r in got if r[1] == "link"] == [(1, "link", None, "/x")]
    assert {r[3] for r in got if r[1] == "meta"} == {"name=a", "content=b"}


def test_a_visit_cuts_snippets_and_tells_their_polarity(spark):
    got = crawl.visit(pages(spark), "page_id", "html", "cat", ["idiot"], ["ran", "good"], ["far"]).collect()
    assert [(r["page_id"], r["nth"], r["polarity"]) for r in got] == [(1, 0, 1)] and got[0]["snippet"].endswith("It ran off.")
    got = crawl.visit(pages(spark), "page_id", "html", "good", [], ["good"], ["far"]).collect()
    assert [(r["page_id"], r["snippet"], r["polarity"]) for r in got] == [(4, "plain text of the good kind", 1)]


def test_addresses_are_screened_once_each(spark):
    found = spark.createDataFrame([(5, "http://a.x/p.html"), (2, "http://a.x/p"), (3, "http://a.x/p"), (1, "ftp://a.x/q"), (7, "http://m.x/q"), (8, "http://a.x/blog"), (9, None)], "id long, url string")
    got = {r["url"]: (r["first_id"], r["reason"], r["url_order"]) for r in crawl.screened(found, "id", "url", ["blog"], [("//m.", "mobile")]).collect()}
    assert got["http://a.x/p.html"] == (5, "ok", 1) and got["http://a.x/p"] == (2, "near duplicate", None)
    assert got["ftp://a.x/q"][1] == got["http://a.x/blog"][1] == got[None][1] == "bad" and got["http://m.x/q"][1] == "mobile"
