"""Queries: sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import data
from ..operators import relational as R
from ..sources import api, feed, fetch, search, sinks
from .registry import query

DATA = os.path.dirname(data.__file__)
#: Pages by url, without and with a body, and urls that no page has.
_STORE = "(select url, max(html) as html from pages group by url union all select 'http://empty.example/', '')"


def store(t):
    pages = t("pages").groupBy("url").agg(F.max("html").alias("html"))
    return pages.union(t.values("url string, html string", [("http://empty.example/", "")]))


def asked(t):
    return t("pages").select("url").distinct().union(t.values("url string", [("http://empty.example/",), ("http://unknown.example/",)]))


_FETCHED = f"(select u.url, case when s.html is null then 404 else 200 end as status, case when s.html <> '' then s.html end as body, md5(s.html) as etag, case when s.html is null then 'HTTP 404' when s.html = '' then 'empty' end as error from (select distinct url from pages union all select 'http://empty.example/' union all select 'http://unknown.example/') u left join {_STORE} s on u.url = s.url)"


@query("src03_fetch", f"select url, status, length(body) as chars, error from {_FETCHED} f")
def _(t):
    got = fetch.from_store(asked(t), store(t))
    return got.select("url", "status", F.length("body").cast("long").alias("chars"), "error")


@query("src04_conditional_fetch", f"select url, etag from {_FETCHED} f where not exists (select 1 from pages p where p.url = f.url and p.page_id % 2 = 0 and md5(p.html) = f.etag)")
def _(t):
    known = t("pages").where("page_id % 2 = 0").select("url", F.md5(F.col("html").cast("binary")).alias("etag"))
    return fetch.unchanged(fetch.from_store(asked(t), store(t)), known).select("url", "etag")


@query("src05_acquire", "select 'o' as kind, doc_id::varchar as name, md5(text) as h, case when length(text) > 0 then null else 'empty' end as error from documents union all select 'f', n_nationkey::varchar, md5(n_name || chr(10)), null from nation")
def _(t):
    """All documents as objects in memory, and a file for each nation."""
    folder = sinks.shared_folder(t.spark, "acquired")
    sinks.file_for_each(t("nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name", folder)
    texts = fetch.acquire(t.spark, t("documents").select(F.col("doc_id").alias("name"), "text"), "o").withColumn("kind", F.lit("o"))
    files = fetch.acquire(t.spark, f"{folder}/each/*", "f").withColumns({"kind": F.lit("f"), "name": F.regexp_extract("name", "n_nationkey=([0-9]+)/", 1)})
    return texts.unionByName(files).select("kind", "name", F.md5(F.col("text").cast("binary")).alias("h"), "error")


@query("src06_read_file", r"select md5(l) as h, count(*) as n from (select unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as l from documents) group by 1")
def _(t):
    """The lines of all documents, from files to which their texts were written."""
    folder = sinks.shared_folder(t.spark, "read")
    sinks.lines(t("documents"), "text", folder)
    return fetch.read_lines(t.spark, folder).groupBy(F.md5(F.col("value").cast("binary")).alias("h")).agg(F.count("*").alias("n"))


_RSS = "<rss><channel>'||'<item><title>' || n_name || '</title><link>http://x.example/' || n_nationkey || '</link><pubDate>Mon, 01 Jan 2024 00:00:0' || n_nationkey % 10 || ' GMT</pubDate><description>&lt;p onclick=\"x()\"&gt;' || n_regionkey || '&lt;/p&gt;&lt;script&gt;y&lt;/script&gt;</description><category>r</category></item></channel></rss>"


@query("src07_feed", "select n_nationkey, n_name as title, 'http://x.example/' || n_nationkey as link, '2024-01-01 00:00:0' || n_nationkey % 10 as published, '<p>' || n_regionkey || '</p>' as content, ['r'] as categories from nation")
def _(t):
    from ..functions.dates import feed_date

    c = lambda x: F.col(x).cast("string")
    xml = F.concat(F.lit("<rss><channel><item><title>"), c("n_name"), F.lit("</title><link>http://x.example/"), c("n_nationkey"), F.lit("</link><pubDate>Mon, 01 Jan 2024 00:00:0"), (F.col("n_nationkey") % 10).cast("string"), F.lit(' GMT</pubDate><description>&lt;p onclick="x()"&gt;'), c("n_regionkey"), F.lit("&lt;/p&gt;&lt;script&gt;y&lt;/script&gt;</description><category>r</category></item></channel></rss>"))
    rows = t("nation").select("n_nationkey", F.explode(feed.entries(xml)).alias("e")).select("n_nationkey", "e.*")
    return rows.select("n_nationkey", "title", "link", feed_date(F.col("published")).cast("string").alias("published"), "content", "categories")


@query("src08_search", "select doc_id, row_number() over (order by doc_id) as place, (row_number() over (order by doc_id) - 1) // 50 as page from (select doc_id from documents where contains(lower(text), 'the') and contains(lower(text), 'and') and not contains(lower(text), 'idiot') order by doc_id limit 200)")
def _(t):
    return search.search(t("documents"), "doc_id", "text", ["the", "and"], ["idiot"], 200, 50)


@query("src08_engine_requests", "select query, o.off::int as \"offset\", 'https://search.example/?q=' || replace(replace(query, '\"', '%22'), ' ', '+') || '&start=' || o.off as url from (values ('\"a\" \"b\" -\"c\"'), ('\"b\" \"a\" -\"c\"')) q(query), (values (0), (50), (100)) o(off)")
def _(t):
    search.register(t.spark)
    return t.spark.read.format("skein_search").option("terms", "a, b").option("exclude", "c").option("most", 150).option("step", 50).load()


@query("src09_round_robin", "select n_name as name, 'nation' as source, row_number() over (order by n_name) as turn from nation union all select r_name, 'region', row_number() over (order by r_name) from region")
def _(t):
    return R.round_robin({"nation": t("nation").select(F.col("n_name").alias("name")), "region": t("region").select(F.col("r_name").alias("name"))}, "name")


@query("src10_word_list", "select p_brand as word, count(*) as n from part group by 1")
def _(t):
    """Parts by the words of a list that was written from them, empty lines between."""
    folder = sinks.shared_folder(t.spark, "list")
    sinks.lines(t("part").select("p_brand").distinct().select(F.concat(F.lit("  "), "p_brand", F.lit("\n\n")).alias("line")), "line", folder)
    words = fetch.word_list(t.spark, folder)
    return t("part").join(words, F.col("p_brand") == F.col("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("src10_word_mapping", "select c_custkey, n_name as becomes from customer join nation on n_nationkey = c_nationkey")
def _(t):
    """Customers with the name that a file of lines number => name gives their nation's number; other lines are none."""
    folder = sinks.shared_folder(t.spark, "mapping")
    sinks.lines(t("nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(" => "), "n_name", F.lit("\nno pair")).alias("line")), "line", folder)
    pairs = fetch.mapping(t.spark, folder)
    return t("customer").join(pairs, F.col("c_nationkey").cast("string") == F.col("word")).select("c_custkey", "becomes")


@query("src11_url_lines", r"select page_id, unnest(regexp_split_to_array(url || chr(13) || chr(10) || 'http://two.example' || chr(10) || 'three', '\r?\n')) as line from pages")
def _(t):
    pasted = F.concat(F.col("url"), F.lit("\r\nhttp://two.example\nthree"))
    return t("pages").select("page_id", F.explode(F.split(pasted, "\r?\n")).alias("line"))


def graph_tables(t):
    """The tables that the graph API reads, out of those there are."""
    l = t("lineitem")  # noqa: E741
    tables = {
        "edges": lambda: l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("rel"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("score")),
        "concepts": lambda: t("supplier").select(F.col("s_suppkey").alias("id"), F.lit("en").alias("lang"), F.col("s_name").alias("text"), (F.col("s_acctbal") > 0).alias("visible")),
        "frames": lambda: t.values("frame_id int, lang string, rel string, text string, goodness int, frequency int", [(1, "en", "A", "{1} came back from {2}", 2, 5), (2, "en", "A", "{1} is back at {2}", 3, 5)]),
        "surfaces": lambda: t("customer").select(F.col("c_custkey").alias("surface_id"), F.lit("en").alias("lang"), F.col("c_nationkey").alias("concept"), F.col("c_name").alias("text"), F.col("c_acctbal").alias("use_count")),
        "votes": lambda: t("events").select("user_id", F.col("event_type").alias("object_type"), (F.col("event_id") % 10).alias("object_id"), F.signum(F.col("value") - 20).cast("int").alias("vote")),
    }
    return lambda name: tables[name]()


_E = "(select l_orderkey * 10 + l_linenumber as id, l_partkey as a, l_returnflag as rel, l_suppkey as b, l_quantity as score from lineitem)"


@query("src12_api", f"select 'assertions' as resource, id, score from (select * from {_E} e where a = 7 or b = 7 order by score desc, id limit 100) union all select 'feature', id, score from (select * from {_E} e where rel = 'A' and b = 5 order by score desc, id limit 20) union all select 'votes', sum(sign(value - 20))::bigint, count(*)::double from events where event_type = 'view' and event_id % 10 = 3")
def _(t):
    tables = graph_tables(t)
    name = t("supplier").where("s_suppkey = 7").first()["s_name"]
    one = api.get(f"/en/concept/{name}/assertions.table", tables, 1000).select(F.lit("assertions").alias("resource"), "id", "score")
    two = api.get("/en/feature/right/A/5.table", tables).select(F.lit("feature").alias("resource"), "id", "score")
    three = api.get("/en/votes/view/3.table", tables).select(F.lit("votes").alias("resource"), F.col("score").alias("id"), F.col("num_votes").cast("double").alias("score"))
    return one.union(two).union(three)


@query("src12_api_json", f"select '{{\"rel\":\"' || rel || '\",\"n\":' || count(*) || '}}' as value from {_E} e group by rel")
def _(t):
    return api.get("/en/relation.json", graph_tables(t))


@query("src13_reachable", f"select url, error is null as ok from {_FETCHED} f")
def _(t):
    return fetch.reachable(fetch.from_store(asked(t), store(t)))


@query("src14_paged_requests", "with s as (select '\"' || n_name || '\" \"' || r_name || '\" -\"' || n_nationkey || '\"' as query, 40 * (n_nationkey % 4) as most from nation join region on r_regionkey = n_regionkey union all select '\"' || r_name || '\" \"' || n_name || '\" -\"' || n_nationkey || '\"', 40 * (n_nationkey % 4) from nation join region on r_regionkey = n_regionkey) select query, k::int as start_at from s, unnest(range(0, most, 50)) r(k)")
def _(t):
    named = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    terms, exclude = F.array("n_name", "r_name").alias("terms"), F.array(F.col("n_nationkey").cast("string")).alias("exclude")
    return search.requested(named.select(terms, exclude, (F.col("n_nationkey") % 4 * 40).alias("most")), 50)


# Sinks: written, then read back


@query("snk01_report", r"select 'o_orderkey' || chr(9) || 'o_orderdate' as line union all select o_orderkey || chr(9) || strftime(o_orderdate, '%b %d, %Y') from orders")
def _(t):
    folder = sinks.shared_folder(t.spark, "report")
    sinks.report(t("orders").select("o_orderkey", "o_orderdate").coalesce(1), folder)
    return t.spark.read.text(folder).select(F.col("value").alias("line"))


@query("snk02_files", "select 'each' as kind, n_nationkey, n_name as line from nation union all select 'master', null, n_name from nation")
def _(t):
    folder = sinks.shared_folder(t.spark, "files")
    sinks.file_for_each(t("nation"), "n_nationkey", "n_name", folder)
    each = t.spark.read.text(f"{folder}/each").select(F.lit("each").alias("kind"), "n_nationkey", F.col("value").alias("line"))
    return each.unionByName(t.spark.read.text(f"{folder}/master").select(F.lit("master").alias("kind"), F.lit(None).cast("int").alias("n_nationkey"), F.col("value").alias("line")))


@query("snk03_lines", r"select unnest(string_split(regexp_replace(n_name || chr(13) || chr(10) || n_regionkey || chr(13) || 'z', '\r\n?', chr(10), 'g'), chr(10))) as line from nation")
def _(t):
    folder = sinks.shared_folder(t.spark, "lines")
    sinks.lines(t("nation").select(F.concat("n_name", F.lit("\r\n"), F.col("n_regionkey").cast("string"), F.lit("\rz")).alias("x")), "x", folder)
    return t.spark.read.text(folder).select(F.col("value").alias("line"))


@query("snk04_dump", "select n_nationkey, n_name, n_regionkey from nation")
def _(t):
    folder = sinks.shared_folder(t.spark, "dump")
    sinks.dump(t("nation"), folder)
    return t.spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(folder)


@query("snk05_poll", "select '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' as value from events where event_id > 500")
def _(t):
    return sinks.poll(t("events").select("event_id", "event_type"), F.col("event_id") > 500)


@query("snk06_cache", "select l_partkey, count(*) as n from lineitem group by 1")
def _(t):
    folder = sinks.shared_folder(t.spark, "cache")
    made = lambda: t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    sinks.cached(t.spark, folder, made)
    return sinks.cached(t.spark, folder, lambda: 1 / 0)  # the second time it is there


@query("snk07_coloured", "select page_id, '<span style=\"background:#' || printf('%02x%02x%02x', page_id % 256, 128, (page_id * 7) % 256) || '\">' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</span>' as html from pages")
def _(t):
    return t("pages").select("page_id", sinks.coloured(F.col("url"), F.col("page_id") % 256, F.lit(128), F.col("page_id") * 7 % 256).alias("html"))


