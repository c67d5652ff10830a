"""Queries: strings, HTML, dates, arithmetic, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lex
from ..functions import dates as D
from ..functions import html as H
from ..functions import math as M
from ..functions import text as T
from ..functions import url as U
from ..graph.edges import feature_notation, link_strength
from ..nlp import parse as P
from ..sources import feed
from .registry import HITS, lexicon_counts, query


@query("str01_cleaned_pages")
def _(t):
    return t("pages").select("page_id", H.cleaned(F.col("html")).alias("html"))


@query("str01_text_nodes")
def _(t):
    return t("pages").select("page_id", F.posexplode(H.text_nodes(F.col("html"))).alias("pos", "node"))


@query("str02_keyword_nodes")
def _(t):
    return t("pages").select("page_id", F.posexplode(H.keyword_nodes(F.col("html"), "the")).alias("pos", "node"))


@query("str03_meta", r"""select page_id, regexp_extract(a, '^([^=]*)="(.*)"$', 1)[1:20] as name, regexp_extract(a, '^([^=]*)="(.*)"$', 2) as value from (select page_id, unnest(regexp_extract_all(regexp_extract(html, '(?i)<meta\s([^>]*)>', 1), '([a-zA-Z:-]+="[^"]*")', 1)) as a from pages)""")
def _(t):
    rows = t("pages").select("page_id", F.explode(H.meta_attributes(F.col("html"))).alias("m"))
    return rows.select("page_id", F.substring("m.name", 1, 20).alias("name"), F.col("m.value").alias("value"))


@query("str04_hrefs", r"""select page_id, unnest(regexp_extract_all(html || '<A class="x" HREF="/odd">y</a>', '(?i)<a\b[^>]*?\shref="([^"]*)"', 1)) as href from pages""")
def _(t):
    odd = F.concat(F.col("html"), F.lit('<A class="x" HREF="/odd">y</a>'))
    return t("pages").select("page_id", F.explode(H.hrefs(odd)).alias("href"))


@query("str05_links", r"""with p as (select page_id, case when page_id % 2 = 0 then html else 'see https://one.example/a and http://two.example/style.css' end as html from pages), l as (select page_id, regexp_extract_all(html, 'href="([^"\s]*)"', 1) as q, regexp_extract_all(html, '(https?://[^\s"''<>]+)', 1) as b from p) select page_id, u as link from (select page_id, unnest(case when len(q) > 0 then q else b end) as u from l) where not contains(u, '.css')""")
def _(t):
    html = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise("see https://one.example/a and http://two.example/style.css")
    return t("pages").select("page_id", F.explode(U.links_in(html)).alias("link"))


_URL_LINES = "select page_id, unnest([url, 'see ' || regexp_replace(url, '^https?://', ''), html]) as line from pages"


@query("str06_urls_in_lines", f"select page_id, md5(line) as line, md5(case when contains(line, 'http:') then line when contains(line, 'www.') or contains(line, '.com') or contains(line, '.net') or contains(line, '.org') then 'http://' || line end) as url from ({_URL_LINES})")
def _(t):
    """Of each page its address, the address without its scheme in a line of text, and its own text as a line."""
    lines = F.array("url", F.concat(F.lit("see "), F.regexp_replace("url", "^https?://", "")), "html")
    h = lambda c: F.md5(c.cast("binary"))
    return t("pages").select("page_id", F.explode(lines).alias("line")).select("page_id", h(F.col("line")).alias("line"), h(U.in_text(F.col("line"))).alias("url"))


_ENT = "text"
for _a, _b in T.ENTITIES:
    _ENT = f"replace({_ENT}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query("str09_entities", rf"select page_id, md5(regexp_replace({_ENT.replace('text', 'html', 1)}, '[^ (-\[\]-z]', '', 'g')) as h from pages")
def _(t):
    return t("pages").select("page_id", F.md5(T.without_entities(F.col("html")).cast("binary")).alias("h"))


@query("str10_unescaped", """select c_custkey, '"' || c_name || '" & <' || c_nationkey || '> cafe it''s -- so... A B' as plain from customer""")
def _(t):
    text = F.concat(F.lit("&ldquo;"), "c_name", F.lit("&rdquo; &amp; &#60;"), F.col("c_nationkey").cast("string"), F.lit("&gt; café it&#8217;s &mdash; so&hellip; &#x41;&nbsp;B"))
    return t("customer").select("c_custkey", T.unescaped(text).alias("plain"))


@query("str13_keep_letters", "select doc_id, md5(regexp_replace(text,'[^a-z]','','g')) as h from documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.keep_letters(F.col("text")).cast("binary")).alias("h"))


@query("str16_sentences", r"select doc_id, unnest(string_split(regexp_replace(text,'[.!?]','\0'||chr(10),'g'),chr(10))) as sentence from documents")
def _(t):
    return t("documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query("str17_blocks", r"select page_id, unnest(regexp_extract_all(html || '<blockquote>q <p>in</p></blockquote>', '(?is)(<p(?:\s[^>]*)?>.*?</p>|<blockquote(?:\s[^>]*)?>.*?</blockquote>)', 1)) as block from pages")
def _(t):
    html = F.concat(F.col("html"), F.lit("<blockquote>q <p>in</p></blockquote>"))
    return t("pages").select("page_id", F.explode(H.blocks(html)).alias("block"))


@query("str18_prefix_key", "select doc_id, text[1:50] as key, text[1:20] as short from documents")
def _(t):
    return t("documents").select("doc_id", T.prefix_key(F.col("text")).alias("key"), T.prefix_key(F.col("text"), 20).alias("short"))


@query("str19_engine_query", "select n_nationkey, '\"' || lower(n_name) || '\" \"r' || n_regionkey || '\" -\"x y\"' as q from nation")
def _(t):
    return t("nation").select("n_nationkey", T.phrase_query(F.array(F.lower("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))), F.array(F.lit("x y"))).alias("q"))


@query("str20_fill_frame", "select n_name || ' is in ' || r_name as said from nation join region on n_regionkey=r_regionkey")
def _(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(T.fill_frame("{1} is in {2}", F.col("n_name"), F.col("r_name")).alias("said"))


@query("str20_match_frame", r"select n_nationkey, case when said <> '' then said end as first, case when said <> '' then n_regionkey::varchar end as second from (select *, case when n_nationkey % 2 = 0 then n_name else '' end as said from nation)")
def _(t):
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" is (really) in "), F.col("n_regionkey").cast("string"), F.lit("."))).otherwise("else")
    first, second = T.template_match("{1} is (really) in {2}.", text)
    return t("nation").select("n_nationkey", first.alias("first"), second.alias("second"))


@query("str21_autoreplace", "select n_nationkey, list_transform(string_split(lower(n_name) || '_teh_dont', '_'), lambda w: case w when 'teh' then 'the' when 'dont' then 'do not' else w end) as words from nation")
def _(t):
    return t("nation").select("n_nationkey", T.replaced(F.split(F.concat(F.lower("n_name"), F.lit("_teh_dont")), "_"), {"teh": "the", "dont": "do not"}).alias("words"))


@query("str22_second_order", "select p_partkey, case when regexp_matches(p_type, '^SMALL') then '' when regexp_matches(p_type, '^([A-Z]+) ([A-Z]+)') then regexp_extract(p_type, '^([A-Z]+) ([A-Z]+)', 2) else p_type end as rest from part")
def _(t):
    return t("part").select("p_partkey", P.second_order(F.col("p_type"), [("^SMALL", 1, True), ("^([A-Z]+) ([A-Z]+)", 2, False)]).alias("rest"))


@query("str23_dependencies", "select n_nationkey, case when n_nationkey % 3 <> 0 then 'nsubj' end as link, case when n_nationkey % 3 <> 0 then n_name end as word1, case when n_nationkey % 3 <> 0 then n_nationkey end as index1, case when n_nationkey % 3 <> 0 then 'of' end as word2, case when n_nationkey % 3 <> 0 then n_regionkey + 10 end as index2 from nation")
def _(t):
    text = F.concat(F.lit("nsubj("), "n_name", F.lit("-"), F.col("n_nationkey").cast("string"), F.lit("', of-"), (F.col("n_regionkey") + 10).cast("string"), F.lit(")"))
    d = P.dependency(F.when(F.col("n_nationkey") % 3 == 0, "no dependency").otherwise(text))
    return t("nation").select("n_nationkey", d.alias("d")).select("n_nationkey", "d.*")


@query("str25_feature_notation", r"select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then l_partkey || '\' || l_returnflag else l_returnflag || '/' || l_partkey end as feature from lineitem")
def _(t):
    side = F.when(F.col("l_linenumber") % 2 == 0, "left").otherwise("right")
    return t("lineitem").select("l_orderkey", "l_linenumber", feature_notation(side, F.col("l_returnflag"), F.col("l_partkey").cast("string")).alias("feature"))


@query("str26_vote_labels", "select event_id, case when value > 20 then 'Good' else 'Bad' end as label, case when value > 40 then 'Confirm clearing your vote for <strong>' || event_type || '</strong>.' else 'Confirm <strong>up</strong> vote for <strong>' || event_type || '</strong>.' end as message from events")
def _(t):
    vote, direction = F.when(F.col("value") > 20, 1).otherwise(-1), F.when(F.col("value") > 40, "clear").otherwise("up")
    return t("events").select("event_id", T.vote_label(vote, "Good,Bad").alias("label"), T.vote_message(F.col("event_type"), direction).alias("message"))


@query("str27_absolute_links", r"""with l as (select page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"\s]*)"', 1)) as href from pages) select page_id, href, count(*) as n, regexp_extract(url, '^[a-z]+://[^/?#]+') || href as link from l group by 1, 2, url""")
def _(t):
    """The links of all pages from their root, as seen from the page."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"\s]*)"'), F.lit(1))).alias("href")
    links = t("pages").select("page_id", "url", hrefs).groupBy("page_id", "url", "href").agg(F.count("*").alias("n"))
    return links.select("page_id", "href", "n", feed.absolute(F.col("url"), F.col("href")).alias("link"))


@query("str27_sanitized")
def _(t):
    return t("pages").select("page_id", feed.sanitize(F.col("html")).alias("html"))


@query("str11_markdown_of_pages")
def _(t):
    """What the Markdown of each page holds: its characters, lines, headings and links."""
    m = t("pages").select("page_id", H.markdown(F.col("html")).alias("m"))
    lines = F.split("m", "\n")
    return m.select("page_id", F.length("m").alias("n_chars"), F.size(lines).alias("n_lines"), F.size(F.filter(lines, lambda l: l.startswith("#"))).alias("n_headings"), F.regexp_count("m", F.lit(r"\]\(")).alias("n_links"))


# Dates


@query("dat01_dates_in_text", "with e as (select event_id, ts::date as d from events) select event_id, case when event_id % 9 = 8 then null else d::varchar end as day from e")
def _(t):
    """Each event's day as text in one of nine ways (the last of which is no date), with other numbers around."""
    of = lambda form: F.date_format("ts", form)
    ways = [of("d.M.yyyy"), F.when(F.dayofmonth("ts") > 12, of("M/d/yyyy")).otherwise(of("d/M/yyyy")), of("yyyy-M-d"), of("MMMM d, yyyy"), F.concat(of("d"), F.lit(". Januar "), of("yyyy")), of("yyyy/MM/dd"), F.concat(of("MMM d"), F.lit("th, "), of("yyyy")), F.concat(of("d MMM"), F.lit(" "), of("yyyy")), F.concat(of("yyyy"), F.lit("-31/31 and 4-5/2016"))]
    text = F.concat(F.lit("no 1/2/1999 but "), F.element_at(F.array(*ways), (F.col("event_id") % 9 + 1).cast("int")), F.lit(" it was, 17 times"))
    return t("events").select("event_id", D.first_date(text).cast("string").alias("day"))


@query("dat01_order_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def _(t):
    text = F.concat(F.lit("ordered on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" by post 12/12/1066"))
    return t("orders").select("o_orderkey", D.first_date(text, 1990).cast("string").alias("day"))


@query("dat02_nearest_date", "select event_id, 'the cat of ' || event_type as fragment, case when event_id % 3 < 2 then ts::date::varchar end as date from events")
def _(t):
    """A page for each event: of three the date stands right above the fragment, far above it after an older one, or only
    below it, where it doesn't count."""
    day, cat = F.date_format("ts", "MMMM d, yyyy"), F.concat(F.lit("<p>the cat of "), "event_type", F.lit("</p>"))
    ways = [
        F.concat(F.lit("<div>posted 1.2.2011<div><p>"), day, F.lit("</p><p>short 9</p>"), cat, F.lit("</div></div><p>3.3.2013</p>")),
        F.concat(F.lit("<p>1.2.2011</p><p>on "), day, F.lit("</p>" + "<p>no digits here</p>" * 15), cat),
        F.concat(cat, F.lit("<p>"), day, F.lit("</p>")),
    ]
    pages = t("events").select("event_id", F.element_at(F.array(*ways), (F.col("event_id") % 3 + 1).cast("int")).alias("html"))
    rows = pages.select("event_id", F.explode(D.fragment_dates(H.text_nodes(F.col("html")), "the cat")).alias("f"))
    return rows.select("event_id", "f.fragment", F.col("f.date").cast("string").alias("date"))


@query("dat03_intervals", "select event_id, date_diff('second', ts, timestamp '2024-01-15 00:00:00') >= 86400 as due, strftime(ts, '%b %d, %Y') as day from events")
def _(t):
    second = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return t("events").select("event_id", (F.timestamp_diff("SECOND", second, F.lit("2024-01-15 00:00:00").cast("timestamp")) >= 86400).alias("due"), F.date_format("ts", "MMM dd, yyyy").alias("day"))


@query("dat04_feed_dates", "select event_id, strftime(case event_id % 9 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) when 2 then date_trunc('day', ts) when 3 then date_trunc('month', ts) when 4 then date_trunc('year', ts) when 5 then date_trunc('day', ts) when 6 then date_trunc('second', ts) when 7 then date_trunc('second', ts) end, '%Y-%m-%d %H:%M:%S') as moment from events")
def _(t):
    """Each event's moment as feeds write it, in one of nine ways, the last of which is none."""
    moment = F.col("ts").cast("timestamp")
    of = lambda form, when=moment: F.date_format(when, form)
    ways = [
        of("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(of("yyyy-MM-dd'T'HH:mm:ss", moment - F.expr("interval 8 hours")), F.lit("-08:00")), of("yyyy-MM-dd"), of("yyyy-MM"), of("yyyy"), of("yyyyMMdd"),
        F.concat(of("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.concat(of("EEE, d MMM yyyy HH:mm:ss", moment + F.expr("interval 1 hour")), F.lit(" +0100")), F.lit("not a date"),
    ]
    text = F.element_at(F.array(*ways), (F.col("event_id") % 9 + 1).cast("int"))
    return t("events").select("event_id", F.date_format(D.feed_date(text), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("dat05_dates_of_fragments")
def _(t):
    nodes = H.text_nodes(F.concat(F.lit("<p>posted on May 4, 2012</p>"), F.col("html")))
    return t("pages").select("page_id", F.explode(D.fragment_dates(nodes, "the")).alias("f")).select("page_id", "f.fragment", "f.date")


# Arithmetic, arrays, JSON


@query("mth01_equations", f"with c as (select doc_id, {', '.join(f'{v} as {k}' for k, v in HITS.items())} from documents) select doc_id, 1 as method, (pos-neg-2*obscene)::double as score from c union all select doc_id, 2, round((pos-neg)/nullif((pos+neg+obscene)::double,0),9) from c")
def _(t):
    scores = F.array(*[F.struct(F.lit(k).alias("method"), F.round(M.equation(e), 9).alias("score")) for k, e in lex.EQUATIONS.items()])
    return lexicon_counts(t("documents")).select("doc_id", F.explode(scores).alias("s")).select("doc_id", "s.*")


@query("mth03_branching_discount", "with d as (select l_partkey as concept, count(*) as n from lineitem group by 1) select concept, round(exp(-((ln(n + 5) / ln(5.0) - 2.5) * (ln(n + 5) / ln(5.0) - 2.5)) / 2) / sqrt(2 * 3.141592653589793), 9) as discount from d")
def _(t):
    d = t("lineitem").groupBy(F.col("l_partkey").alias("concept")).agg(F.count("*").alias("n"))
    return d.select("concept", F.round(M.branching_discount(F.col("n")), 9).alias("discount"))


@query("mth04_noisy_or", "with x as (select l_orderkey, unnest([l_tax, l_discount]) as x from lineitem) select l_orderkey, round(1 - exp(sum(ln(1 - x))), 9) as v from x group by 1")
def _(t):
    folded = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array("l_tax", "l_discount")).alias("x"))  # an order has few lines
    return folded.select("l_orderkey", F.round(M.noisy_or_of(F.flatten("x")), 9).alias("v"))


@query("mth05_level_mean", "select l_orderkey, l_linenumber, round(w * l_tax + (1 - w) * l_discount, 9) as mean from (select *, 1.0::double / (2 * (l_linenumber - 1 + 1)) as w from lineitem)")
def _(t):
    from ..graph.activation import level_mean

    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(level_mean(F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber") - 1), 9).alias("mean"))


@query("mth06_link_strength", "select l_orderkey, l_linenumber, round(ln(l_quantity + l_linenumber + (l_tax + l_discount) / 2 + 2) / ln(4.0), 9) as strength from lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(link_strength(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_tax"), F.col("l_discount")), 9).alias("strength"))


@query("mth08_colour_mix", "with s as (select c_custkey, c_acctbal / 10000 as a, c_nationkey / 25.0 as b from customer), m as (select c_custkey, a * a * a as x, b * b * b as y from s) select c_custkey, case when x + y = 0 then 128 else greatest(0, least(255, trunc(255 * x / (x + y))))::int end as red, case when x + y = 0 then 128 else greatest(0, least(255, trunc(255 * y / (x + y))))::int end as green from m")
def _(t):
    mixed = M.colour_mix([F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25.0], [(255, 0, 0), (0, 255, 0)])
    return t("customer").select("c_custkey", mixed[0].alias("red"), mixed[1].alias("green"))


@query("mth09_adverbs", "select n_nationkey, coalesce(list_min(list_filter(list_transform(string_split(lower(said), ' '), lambda w: case w " + " ".join(f"when '{w}' then {v}" for w, v in P.ADVERBS.items()) + " end), lambda v: v is not null)), 5) as frequency from (select *, case n_nationkey % 4 when 0 then 'Not always' when 1 then 'usually' when 2 then n_name else 'sometimes OFTEN' end as said from nation)")
def _(t):
    said = F.when(F.col("n_nationkey") % 4 == 0, "Not always").when(F.col("n_nationkey") % 4 == 1, "usually").when(F.col("n_nationkey") % 4 == 2, F.col("n_name")).otherwise("sometimes OFTEN")
    return t("nation").select("n_nationkey", P.adverb_frequency(said).alias("frequency"))


@query("arr01_terms", "select p_partkey, list_filter(list_transform(string_split(replace(p_type, ' ', ' , ') || ',,', ','), lambda x: trim(x)), lambda x: x <> '') as terms from part")
def _(t):
    return t("part").select("p_partkey", T.terms(F.concat(F.replace("p_type", F.lit(" "), F.lit(" , ")), F.lit(",,"))).alias("terms"))


@query("arr02_zipped", "select l_orderkey, list_transform(list_sort(list(l_linenumber)), lambda x: x || ':' || 2 * x) as pairs from lineitem group by 1")
def _(t):
    l = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("line"))  # noqa: E741
    return l.select("l_orderkey", F.arrays_zip("line", F.transform("line", lambda x: 2 * x).alias("twice")).alias("z")).select("l_orderkey", F.transform("z", lambda z: F.concat_ws(":", z["line"].cast("string"), z["twice"].cast("string"))).alias("pairs"))


@query("arr03_map_defaults", "select n_nationkey, case when n_nationkey % 2 = 0 then n_regionkey else -1 end as a, 7 as b from nation")
def _(t):
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("a"), F.col("n_regionkey"))).otherwise(F.create_map(F.lit("c"), F.col("n_regionkey")))
    merged = T.merged_maps(F.create_map(F.lit("a"), F.lit(-1), F.lit("b"), F.lit(7)), own)
    return t("nation").select("n_nationkey", merged.alias("m")).select("n_nationkey", F.element_at("m", "a").alias("a"), F.element_at("m", "b").alias("b"))


@query("jsn01_decoded", "select event_id, case when event_id % 5 = 0 then null else json_extract(props, '$.k')::bigint end as k, case when event_id % 5 = 0 then 'bad; worse' end as errors from events")
def _(t):
    answer = F.when(F.col("event_id") % 5 == 0, F.lit('{"errors": ["bad", "worse"]}')).otherwise(F.concat(F.lit('{"response": {"result": '), F.col("props"), F.lit("}}")))
    got = F.from_json(answer, "response struct<result: struct<k: bigint>>, errors array<string>")
    return t("events").select("event_id", got.alias("g")).select("event_id", F.col("g.response.result.k").alias("k"), F.array_join("g.errors", "; ").alias("errors"))


@query("jsn02_encoded", "select event_id, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\",\"tags\":[\"a\",\"b\"]}' as json from events")
def _(t):
    row = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return t("events").select("event_id", F.to_json(row).alias("json"))
