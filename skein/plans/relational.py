"""Queries: filters, projections, joins, aggregates, windows, pages, sets and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import lexicon as lex
from ..functions import html as H
from ..functions import math as M
from ..functions import text as T
from ..functions import url as U
from ..operators import relational as R
from ..operators.order import hinted
from .registry import _VOTE, HITS, TOK, query

_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_PART = {name: f"regexp_extract(url, '{_URL}', {k})" for k, name in enumerate(("scheme", "host", "path", "query", "fragment"), 1)}
_PART["scheme"] = f"lower({_PART['scheme']})"
#: Odd URLs beside those of pages: upper case, no scheme, no host, quotes, nothing.
_ODD = ["HTTP://Www.Example.COM/A?b=1#c", "www.example.org/x/y.html", "//host/only", "mailto:someone@example.org", "file:///tmp/x", "?just=query", "#top", "", "https://h:8080?q", "javascript:void(0)"]
_ODD_SQL = "(select page_id, url from pages union all select * from (values " + ",".join(f"({-i}, '{u}')" for i, u in enumerate(_ODD, 1)) + ") v(page_id, url))"


def urls(t):
    return t("pages").select("page_id", "url").unionByName(t.values("page_id long, url string", [(-i, u) for i, u in enumerate(_ODD, 1)]))


@query("flt06_own_site", f"select page_id from {_ODD_SQL} u where not contains({_PART['host']}, '.example.net')")
def _(t):
    return urls(t).where(~U.parts(F.col("url"))["host"].contains(".example.net")).select("page_id")


@query("flt07_link_screen", r"select page_id, h as href from (select page_id, unnest(regexp_extract_all(html,'(?i)<a\b[^>]*?\shref=@([^@]*)@',1)) as h from pages) where contains(h,'th') and contains(h,'e') and not contains(h,'er')".replace("@", '"'))
def _(t):
    links = t("pages").select("page_id", F.explode(H.hrefs(F.col("html"))).alias("href"))
    return links.where(R.all_in(F.col("href"), ["th", "e"]) & ~R.any_in(F.col("href"), ["er"]))


_EDGE = "(select l_orderkey, l_linenumber, l_returnflag as relation, l_partkey as concept1, l_suppkey as concept2, l_quantity - 25 as score from lineitem)"


def edges(t):
    """lineitem as assertions part - returnflag - supplier, scored by quantity."""
    return t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("concept1"), F.col("l_suppkey").alias("concept2"), (F.col("l_quantity") - 25).alias("score"))


@query("flt13_useful_assertions", f"select l_orderkey, l_linenumber from {_EDGE} e join part on concept1 = p_partkey join supplier on concept2 = s_suppkey where score > 0 and p_size > 10 and s_acctbal > 0")
def _(t):
    visible1 = t("part").where("p_size > 10").select(F.col("p_partkey").alias("concept1"))
    visible2 = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("concept2"))
    return edges(t).where("score > 0").join(visible1, "concept1", "left_semi").join(visible2, "concept2", "left_semi").select("l_orderkey", "l_linenumber")


@query("flt19_visible_in_order", "select c_custkey, min(priority) as priority from (select c_custkey, 1 as priority from customer where c_nationkey = 3 union all select c_custkey, 2 from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0 union all select c_custkey, 3 from customer where c_acctbal > 5000) group by 1")
def _(t):
    c = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return R.first_visible(c, {"c_nationkey = 3": 1, "c_mktsegment = 'BUILDING' and c_acctbal > 0": 2, "c_acctbal > 5000": 3}).select("c_custkey", "priority")


@query("flt21_soft_404", "select page_id, (strpos(html,'404')>1 or strpos(html,'Not Found')>1 or status >= 400) as gone from (select *, case when page_id % 10 = 0 then 404 else 200 end as status from pages)")
def _(t):
    status = F.when(F.col("page_id") % 10 == 0, 404).otherwise(200)
    return t("pages").select("page_id", ((F.locate("404", "html") > 1) | (F.locate("Not Found", "html") > 1) | (status >= 400)).alias("gone"))


_FUNCTION_WORDS = [("en", "stop", "the"), ("en", "stop", "of"), ("en", "negation", "not"), ("fr", "stop", "le"), ("fr", "stop", "la"), ("de", "stop", "der"), ("de", "negation", "nicht"), ("es", "stop", "el")]


@query("flt22_function_words", "select l.lang, class, list_sort(list(distinct word)) as words, count(distinct doc_id) as docs from (values " + ",".join(map(str, _FUNCTION_WORDS)) + f") l(lang, class, word) join (select distinct doc_id, lang, unnest({TOK}) as w from documents) d on d.lang = l.lang and d.w = l.word group by 1, 2")
def _(t):
    words = F.broadcast(t.values("lang string, class string, word string", _FUNCTION_WORDS))
    tokens = t("documents").select("doc_id", "lang", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word"))
    return tokens.join(words, ["lang", "word"]).groupBy("lang", "class").agg(F.array_sort(F.collect_set("word")).alias("words"), F.count_distinct("doc_id").alias("docs"))


@query("prj01_rows_as_structs", "select to_json({'content': c_name, 'url': n_name, 'first': c_custkey = 1, 'total': (select count(*) from customer), 'score': round(c_acctbal, 2)})::varchar as item from customer join nation on c_nationkey = n_nationkey")
def _(t):
    total = t("customer").agg(F.count("*").alias("total"))
    rows = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).crossJoin(F.broadcast(total))
    return rows.select(F.to_json(F.struct(F.col("c_name").alias("content"), F.col("n_name").alias("url"), (F.col("c_custkey") == 1).alias("first"), "total", M.rounded(F.col("c_acctbal"), 2).alias("score")), {"ignoreNullFields": "false"}).alias("item"))


@query("prj02_date_format", """select o_orderkey, strftime(o_orderdate, '%b-%d-%Y') as day, regexp_replace('"' || o_orderpriority || '"', '^"(.*)"$', '\\1') as bare from orders""")
def _(t):
    quoted = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "MMM-dd-yyyy").alias("day"), U.unquoted(quoted).alias("bare"))


@query("prj03_url_parts", f"select page_id, {', '.join(f'{v} as {k}' for k, v in _PART.items())} from {_ODD_SQL} u")
def _(t):
    return urls(t).select("page_id", *[c.alias(k) for k, c in U.parts(F.col("url")).items()])


@query("prj04_url_recompose", f"with p as (select page_id, {', '.join(f'{v} as {k}' for k, v in _PART.items())} from {_ODD_SQL} u) select page_id, case when scheme <> '' then scheme || ':' else '' end || case when host <> '' or scheme = 'file' then '//' || host else '' end || path || case when query <> '' then '?' || query else '' end || case when fragment <> '' then '#' || fragment else '' end as again from p")
def _(t):
    return urls(t).select("page_id", U.recompose(U.parts(F.col("url"))).alias("again"))


@query("prj05_cached_url", "select page_id, case when inner_url <> '' then 'http://' || inner_url else u end as page from (select page_id, u, regexp_extract(u, 'q=cache:[^:]*:([^+&]*)', 1) as inner_url from (select page_id, case when page_id % 2 = 0 then 'http://search.example/?q=cache:ab' || page_id || ':' || substr(url, strpos(url, '//') + 2) || '+term&hl=en' else url end as u from pages))")
def _(t):
    cached = F.concat(F.lit("http://search.example/?q=cache:ab"), F.col("page_id").cast("string"), F.lit(":"), F.substring_index("url", "//", -1), F.lit("+term&hl=en"))
    u = F.when(F.col("page_id") % 2 == 0, cached).otherwise(F.col("url"))
    return t("pages").select("page_id", U.unwrap_cached(u).alias("page"))


# Joins


@query("join02_content_of_search", "select o_orderkey, l_linenumber, l_quantity from orders join lineitem on l_orderkey = o_orderkey where o_custkey = 7 order by 1, 2 limit 20")
def _(t):
    met = t("orders").where("o_custkey = 7").select("o_orderkey").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.top_rows(met.select("o_orderkey", "l_linenumber", "l_quantity"), ["o_orderkey", "l_linenumber"], 20)


@query("join04_score_or_na", "select d.doc_id, p.url, coalesce(cast(l.toxic as varchar), 'n/a') as score from documents d join pages p on p.page_id = d.doc_id left join labels l on l.doc_id = d.doc_id")
def _(t):
    with_url = t("documents").select("doc_id").join(t("pages").select(F.col("page_id").alias("doc_id"), "url"), "doc_id")
    return with_url.join(t("labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "url", F.coalesce(F.col("toxic").cast("string"), F.lit("n/a")).alias("score"))


@query("join06_cascade_delete", "with gone as (select c_custkey from customer where c_nationkey = 3), o as (select * from orders where o_custkey not in (select c_custkey from gone)), l as (select * from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey in (select c_custkey from gone))) select 'customer' as level, count(*) as n from customer where c_custkey not in (select c_custkey from gone) union all select 'orders', count(*) from o union all select 'lineitem', count(*) from l")
def _(t):
    customers = t("customer").where("c_nationkey = 3").select("c_custkey")
    left = R.cascade(customers, [("customer", t("customer").select("c_custkey"), "c_custkey", "c_custkey"), ("orders", t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey"), ("lineitem", t("lineitem").select("l_orderkey"), "l_orderkey", "l_orderkey")])
    out = None
    for level, rows in left.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "n")
        out = n if out is None else out.unionByName(n)
    return out


_FRAGMENTS = ["blog", "/fr/", "ref=", "%"]


@query("join08_fragments_in_urls", "select page_id, fragment from pages join (values " + ",".join(f"('{f}')" for f in _FRAGMENTS) + ") f(fragment) on strpos(url, fragment) > 1")
def _(t):
    fragments = F.broadcast(t.values("fragment string", [(f,) for f in _FRAGMENTS]))
    return t("pages").join(fragments, F.expr("instr(url, fragment) > 1")).select("page_id", "fragment")


@query("join09_criteria_of_url", "select l_suppkey as url_id, o_orderkey as search_id, coalesce(w.minimum, o_totalprice) as criteria from lineitem join orders on l_orderkey = o_orderkey left join (select o_orderkey as k, round(o_totalprice + 1, 2) as minimum from orders where o_orderstatus = 'F') w on w.k = o_orderkey where l_suppkey = 5")
def _(t):
    made = t("orders").where("o_orderstatus = 'F'").select("o_orderkey", F.round(F.col("o_totalprice") + 1, 2).alias("minimum"))
    met = t("lineitem").where("l_suppkey = 5").select("l_suppkey", "l_orderkey").join(t("orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.join(made, "o_orderkey", "left").select(F.col("l_suppkey").alias("url_id"), F.col("o_orderkey").alias("search_id"), F.coalesce("minimum", "o_totalprice").alias("criteria"))


_CRITERIA = [(1, "the", "idiot"), (2, "der", "und"), (3, "la", "el")]


@query("join10_pages_by_criteria", "select doc_id, criteria_id from documents, (values " + ",".join(map(str, _CRITERIA)) + ") c(criteria_id, include, exclude) where contains(lower(text), include) and not contains(lower(text), exclude)")
def _(t):
    criteria = F.broadcast(t.values("criteria_id int, include string, exclude string", _CRITERIA))  # a handful of literals
    low = F.lower("text")
    return t("documents").join(criteria, F.contains(low, F.col("include")) & ~F.contains(low, F.col("exclude"))).select("doc_id", "criteria_id")


@query("join12_bulk_fetch", "select c_custkey, c_name from customer join (values (3), (11), (999999999)) i(id) on c_custkey = id")
def _(t):
    return R.bulk(t("customer").select("c_custkey", "c_name"), t.values("c_custkey long", [(3,), (11,), (999999999,)]), "c_custkey")


@query("join14_pairs", "select a.r_name as a, b.r_name as b, 'unordered' as kind from region a join region b on a.r_regionkey < b.r_regionkey union all select a.r_name, b.r_name, 'ordered' from region a join region b on a.r_regionkey <> b.r_regionkey")
def _(t):
    names = t("region").select("r_regionkey", F.col("r_name").alias("name"))
    return R.pairs(names, "r_regionkey", "name").withColumn("kind", F.lit("unordered")).unionByName(R.pairs(names, "r_regionkey", "name", ordered=True).withColumn("kind", F.lit("ordered")))


@query("join14_permutations", "select a.r_name || ' ' || b.r_name || ' ' || c.r_name as words from region a, region b, region c where a.r_regionkey < 3 and b.r_regionkey < 3 and c.r_regionkey < 3 and a.r_regionkey <> b.r_regionkey and a.r_regionkey <> c.r_regionkey and b.r_regionkey <> c.r_regionkey")
def _(t):
    terms = t("region").where("r_regionkey < 3").agg(F.array_sort(F.collect_list("r_name")).alias("terms"))
    return R.permuted(terms, "terms").select(F.array_join("terms", " ").alias("words"))


@query("join15_rollup_terms", "with s as (select n_regionkey, lower(replace(n_name, '_', ',')) || ', shared ' as include, n_nationkey as lim from nation) select n_regionkey, (select list_sort(list(distinct trim(x))) from (select unnest(string_split(include, ',')) as x, n_regionkey as k from s) where k = o.n_regionkey and trim(x) <> '') as terms, max(lim) as most from s o group by 1")
def _(t):
    specs = t("nation").select("n_regionkey", F.concat(F.lower(F.replace("n_name", F.lit("_"), F.lit(","))), F.lit(", shared ")).alias("include"), F.col("n_nationkey").alias("lim"))
    return R.rolled_up(specs, "n_regionkey", "include", "lim").select("n_regionkey", "terms", "most")


# Aggregates


@query("agg05_exclusive_polarity", f"with w as (select doc_id, unnest({TOK}) as w from documents), k as (select doc_id, case when w in {tuple(lex.NEGATIVE)} then 'neg' when w in {tuple(lex.POSITIVE)} then 'pos' when w in {tuple(lex.OBSCENE)} then 'obs' end as kind from w) select doc_id, count(*) filter (kind = 'neg') as neg, count(*) filter (kind = 'pos') as pos, count(*) filter (kind = 'obs') as obscene, count(*) filter (kind = 'pos') - count(*) filter (kind = 'neg') - count(*) filter (kind = 'obs') as polarity from k group by 1")
def _(t):
    kind = F.when(F.col("w").isin(lex.NEGATIVE), "neg").when(F.col("w").isin(lex.POSITIVE), "pos").when(F.col("w").isin(lex.OBSCENE), "obs")
    words = t("documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w")).select("doc_id", kind.alias("kind"))
    n = words.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(a) for k, a in (("neg", "neg"), ("pos", "pos"), ("obs", "obscene"))])
    return n.withColumn("polarity", F.col("pos") - F.col("neg") - F.col("obscene"))


@query("agg06_connotations", f"select doc_id, w as word, case when w in {tuple(lex.POSITIVE)} then 1 else -1 end as connotation from (select doc_id, unnest({TOK}) as w from documents) where w in {tuple(lex.POSITIVE + lex.NEGATIVE + lex.OBSCENE)} and length(w) >= 3")
def _(t):
    words = t("documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("word"))
    known = words.where(F.col("word").isin(lex.POSITIVE + lex.NEGATIVE + lex.OBSCENE) & (F.length("word") >= 3))
    return known.select("doc_id", "word", F.when(F.col("word").isin(lex.POSITIVE), 1).otherwise(-1).alias("connotation"))


@query("agg07_source_polarity", f"with c as (select source, sum({HITS['pos']}-{HITS['neg']}-{HITS['obscene']})::bigint as polarity from documents group by 1) select s.source, coalesce(c.polarity, 0) as polarity from (select distinct source from documents union all select 'none yet') s left join c on s.source is not distinct from c.source")
def _(t):
    docs = t("documents").select("source", T.tokens(F.col("text")).alias("w"))
    hits = lambda words: T.hits(F.col("w"), words)
    sums = docs.groupBy("source").agg(F.sum(hits(lex.POSITIVE) - hits(lex.NEGATIVE) - hits(lex.OBSCENE)).alias("polarity"))
    every = t("documents").select("source").distinct().union(t.values("source string", [("none yet",)]))
    known = sums.select(F.col("source").alias("s"), "polarity")
    return every.join(known, F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("polarity", F.lit(0).cast("long")).alias("polarity"))


_FREQUENCY = f"select w as word, count(*) as n from (select unnest({TOK}) as w from documents) where w not in (select unnest([{','.join(repr(w) for w in lex.STOP)}])) group by 1"


@query("agg08_word_frequency", _FREQUENCY)
def _(t):
    return T.word_frequency(t("documents"), "text", lex.STOP)


@query("agg08_top_words", f"with f as ({_FREQUENCY}) select word, n, (select count(*) from f) as unique_words from f order by n desc, word desc limit 50")
def _(t):
    f = T.word_frequency(t("documents"), "text", lex.STOP)
    total = f.agg(F.count("*").alias("unique_words"))
    return R.top_rows(f, [F.desc("n"), F.desc("word")], 50).crossJoin(F.broadcast(total))


@query("agg08_merged_counts", f"with f as ({_FREQUENCY.replace('from documents', 'from documents where doc_id % 2 = 0')}), g as ({_FREQUENCY.replace('from documents', 'from documents where doc_id % 2 = 1')}) select word, sum(n)::bigint as n from (select * from f union all select * from g) group by 1")
def _(t):
    known, fresh = (T.word_frequency(t("documents").where(f"doc_id % 2 = {k}"), "text", lex.STOP) for k in (0, 1))
    return T.merged_counts(known, fresh)


@query("agg10_top_scored", "with s as (select user_id, count(*) as n, round(sum(value), 4) as total from events group by 1 having count(*) >= 3) select *, 'top' as side from (select * from s order by n desc, user_id limit 25) union all select *, 'bottom' from (select * from s order by n, user_id limit 25)")
def _(t):
    sums = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).where("n >= 3")
    side = lambda by, name: R.top_rows(sums, [by, "user_id"], 25).withColumn("side", F.lit(name))
    return side(F.desc("n"), "top").unionByName(side(F.asc("n"), "bottom"))


@query("agg11_degree", "select part, count(distinct id) as degree from (select l_partkey as part, l_orderkey * 10 + l_linenumber as id from lineitem union all select l_suppkey, l_orderkey * 10 + l_linenumber from lineitem) group by 1")
def _(t):
    l = t("lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))  # noqa: E741
    ends = l.select(F.explode(F.array_distinct(F.array("l_partkey", "l_suppkey"))).alias("part"), "id")  # a loop counts once
    return ends.dropDuplicates(["part", "id"]).groupBy("part").agg(F.count("*").alias("degree"))


_TERMS = ["the", "idiot", "der", "la"]


@query("agg15_terms_hit", "select doc_id, count(distinct term) as hit from (select doc_id, s, term from (select doc_id, unnest(string_split(text, chr(10))) as s from documents), (values " + ",".join(f"('{w}')" for w in _TERMS) + ") w(term) where contains(lower(s), term)) group by doc_id")
def _(t):
    low = F.lower("text")
    hit = [F.when(low.contains(w), 1).otherwise(0) for w in _TERMS]
    return t("documents").select("doc_id", sum(hit[1:], hit[0]).cast("long").alias("hit")).where("hit > 0")


@query("agg16_term_document", f"with m as (select doc_id, w as word, count(*) as n from (select doc_id, unnest({TOK}) as w from documents) where w not in (select unnest([{','.join(repr(w) for w in lex.STOP)}])) group by 1, 2) select doc_id, word, n, round(n / sum(n) over (partition by doc_id), 9) as share from m")
def _(t):
    counts = T.term_counts(t("documents"), "doc_id", F.col("text")).where(~F.col("word").isin(lex.STOP))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")), 9))


@query("agg17_tfidf", f"with m as (select doc_id, w as word, count(*) as n from (select doc_id, unnest({TOK}) as w from documents) group by 1,2), d as (select word, count(*) as df from m group by 1) select doc_id, word, round(n*ln((select count(*) from documents)/df),6) as tfidf from m join d using(word)")
def _(t):
    return T.tfidf(t("documents"), "doc_id", "text").select("doc_id", "word", F.round("tfidf", 6).alias("tfidf"))


@query("agg19_tensor_sum", "select l_partkey as a, l_returnflag as rel, l_suppkey as b, sum(l_quantity)::bigint as w from lineitem group by 1,2,3 union all select l_suppkey, '-'||l_returnflag, l_partkey, sum(l_quantity)::bigint from lineitem group by 1,2,3")
def _(t):
    from ..matrix.build import tensor

    l = t("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("rel"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("w"))  # noqa: E741
    return tensor(l, mirrored=True).select("a", "rel", "b", F.col("w").cast("long").alias("w"))


@query("agg19_tensor_last", "select l_partkey as a, l_suppkey as b, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber, l_extendedprice)) as w from lineitem group by 1, 2")
def _(t):
    from ..matrix.build import matrix_last

    l = t("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").alias("w"), F.struct(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_extendedprice").alias("at"))  # noqa: E741
    return matrix_last(l, "at")


@query("agg20_flat_weights", "with e as (select l_partkey as a, l_suppkey as b, case l_returnflag when 'A' then 1.0 when 'N' then 0.5 else 0.25 end as fwd, case l_returnflag when 'A' then 0.5 else 0.125 end as inv from lineitem), w as (select a, b, fwd as w from e union all select b, a, inv from e), s as (select a, b, sum(w) as w from w group by 1, 2), i as (select a, a as b, 1.0 as w from (select a from w union select b from w)) select coalesce(s.a, i.a) as a, coalesce(s.b, i.b) as b, round(greatest(coalesce(s.w, 0), coalesce(i.w, 0)), 6)::double as w from s full join i on s.a = i.a and s.b = i.b")
def _(t):
    from ..matrix.build import flat

    l = t("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("rel"), F.col("l_suppkey").alias("b"))  # noqa: E741
    return flat(l, {"A": 1.0, "N": 0.5}, 0.25, {"A": 0.5}, 0.125, 1.0).select("a", "b", F.round("w", 6).alias("w"))


@query("agg21_tag_probabilities", "with w as (select p_brand as word, split_part(p_type, ' ', 1) as tag, count(*) as n from part where split_part(p_type, ' ', 1) <> 'SMALL' group by 1, 2) select word, tag, n, round((n + 0.1) / (sum(n) over (partition by tag) + 0.1 * (select count(distinct word) from w)), 9) as p from w")
def _(t):
    from ..nlp.parse import tag_probabilities

    tagged = t("part").select(F.col("p_brand").alias("word"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("tag"))
    return tag_probabilities(tagged, closed=["SMALL"], smooth=0.1).select("word", "tag", "n", F.round("p", 9).alias("p"))


@query("agg22_canonical_names", "select c_nationkey as concept, arg_max(c_name, (c_acctbal, -c_custkey)) as surface from customer group by 1")
def _(t):
    c = t("customer").select(F.col("c_nationkey").alias("concept"), "c_name", "c_acctbal", "c_custkey")
    return c.groupBy("concept").agg(F.max_by("c_name", F.struct("c_acctbal", -F.col("c_custkey"))).alias("surface"))


# Windows and pages


_SENT = r"string_split(regexp_replace(text,'[.!?]','\0'||chr(10),'g'),chr(10))"


@query("win01_greedy_snippets")
def _(t):
    return t("documents").select("doc_id", F.posexplode(T.greedy_snippets(F.col("text"), " the ")).alias("nth", "snippet"))


@query("win02_hit_windows", f"with s as (select doc_id, unnest({_SENT}) as sent, generate_subscripts({_SENT},1)-1 as pos from documents), h as (select *, max(case when contains(sent,' the ') then 1 else 0 end) over (partition by doc_id order by pos rows between 1 preceding and 1 following) as near from s) select doc_id, substr(string_agg(trim(sent), ' ... ' order by pos), 1, 500) as snippet from h where near=1 group by 1 having length(string_agg(trim(sent), ' ... ' order by pos)) > 20")
def _(t):
    return t("documents").select("doc_id", T.snippet(F.col("text"), " the ", most=500).alias("snippet")).where(F.length("snippet") > 20)


@query("win07_ngrams", f"with w as (select doc_id, {TOK} as w from documents) select doc_id, i as start_at, array_to_string(w[i:i+n-1], ' ') as gram from w, unnest(range(1, len(w) + 1)) r(i), (values (3), (2), (1)) k(n) where i + n - 1 <= len(w)")
def _(t):
    docs = t("documents").select("doc_id", "text")
    return T.placed_windows(docs, T.tokens(F.col("text")), 3).select("doc_id", "start_at", "gram")


@query("win08_top_per_group", "with r as (select l_returnflag, l_linestatus, l_orderkey, l_linenumber, row_number() over (partition by l_returnflag, l_linestatus order by l_extendedprice desc, l_orderkey, l_linenumber) r, count(*) over (partition by l_returnflag, l_linestatus) as n from lineitem) select l_returnflag, l_linestatus, l_orderkey, l_linenumber, dense_rank() over (order by n desc, l_returnflag, l_linestatus) as feature_order from r where r <= 10")
def _(t):
    l = t("lineitem").select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice")  # noqa: E741
    keys = ["l_returnflag", "l_linestatus"]
    best = R.best_of_few(l, keys, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 10)
    order = Window.orderBy(F.desc("n"), *keys)  # one row for each feature
    features = l.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("feature_order", F.dense_rank().over(order).cast("long"))
    return best.join(F.broadcast(features), keys).select(*keys, "l_orderkey", "l_linenumber", "feature_order")


@query("top02_page", "with n as (select greatest(1, least(3, ceil(count(*) / 20)::bigint)) as page, ceil(count(*) / 20)::bigint as pages from orders) select o_orderkey, page, page < pages as has_next, page > 1 as has_last from (select o_orderkey from orders order by o_totalprice, o_orderkey limit 20 offset 40), n")
def _(t):
    return R.clamped_page(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 3, 20).select("o_orderkey", "page", "has_next", "has_last")


@query("top03_page_total", "with n as (select count(*) as total from orders) select o_orderkey, total, true as has_next, false as has_last from (select o_orderkey from orders order by o_orderkey limit 300), n where total > 300")
def _(t):
    return R.clamped_page(t("orders").select("o_orderkey"), ["o_orderkey"], 1, 300).select("o_orderkey", "total", "has_next", "has_last")


@query("top04_first_n", "select c_custkey from customer order by c_custkey limit 15")
def _(t):
    return R.top_rows(t("customer").select("c_custkey"), ["c_custkey"], 15)


@query("top05_default_orders", "select 'score' as by_column, c_custkey as id from (select c_custkey from customer order by c_acctbal desc, c_custkey limit 10) union all select 'time', event_id from (select event_id from events order by ts desc, event_id limit 10)")
def _(t):
    score = R.top_rows(t("customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 10).select(F.lit("score").alias("by_column"), F.col("c_custkey").alias("id"))
    time = R.top_rows(t("events").select("event_id", "ts"), [F.desc("ts"), "event_id"], 10).select(F.lit("time").alias("by_column"), F.col("event_id").alias("id"))
    return score.unionByName(time)


@query("top06_top_items", "select i as place, round(embedding[i]::double, 6) as weight from (select embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings where vec_id = 1) order by weight desc, place limit 5")
def _(t):
    items = t("embeddings").where("vec_id = 1").select(F.posexplode("embedding").alias("place", "weight"))
    items = items.select((F.col("place") + 1).cast("long").alias("place"), F.round(F.col("weight").cast("double"), 6).alias("weight"))
    return R.top_rows(items, [F.desc("weight"), "place"], 5)


@query("top07_beam", "with e as (select 'p' || l_partkey as a, 's' || l_suppkey as b, max(l_quantity) / 50 as w from lineitem group by 1, 2), r as (select a, b, w from e union all select b, a, w from e), one as (select b as concept, max(w) as weight from r where a = 'p1' group by 1 order by 2 desc, 1 limit 50) select r.b as concept, max(one.weight * r.w) as weight from one join r on r.a = one.concept group by 1 order by 2 desc, 1 limit 50")
def _(t):
    from ..graph import activation

    e = t("lineitem").groupBy(F.col("l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).agg(F.max("l_quantity").alias("w"))
    e = e.select(F.concat(F.lit("p"), "a").alias("a"), "b", (F.col("w") / 50).alias("w"))
    return activation.beam(e, ["p1"], steps=2, width=50)


@query("top08_clamped_limit", "select c_custkey from customer order by c_custkey limit 100")
def _(t):
    return R.top_rows(t("customer").select("c_custkey"), ["c_custkey"], R.clamped(5000, 100, 20))


_FRAMES = [(1, "{1} is in {2}", 3), (2, "{1} is {2}", 1), (3, "{1} has {2}", 2)]


@query("top09_best_frame", "with s as (select n_nationkey, n_name || case n_nationkey % 3 when 0 then ' is in ' when 1 then ' is ' else ' has ' end || 'r' || n_regionkey as said from nation), f as (select * from (values (1, '^(.+) is in (.+)$', 3), (2, '^(.+) is (.+)$', 1), (3, '^(.+) has (.+)$', 2)) f(frame_id, pattern, goodness)) select n_nationkey, frame_id, regexp_extract(said, pattern, 1) as first, regexp_extract(said, pattern, 2) as second from (select *, row_number() over (partition by n_nationkey order by goodness desc, frame_id) as r from s join f on regexp_matches(said, pattern)) where r = 1")
def _(t):
    verb = F.element_at(F.array(F.lit(" is in "), F.lit(" is "), F.lit(" has ")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    said = t("nation").select("n_nationkey", F.concat("n_name", verb, F.lit("r"), F.col("n_regionkey").cast("string")).alias("said"))
    return R.best_frame(said, "said", _FRAMES).select("n_nationkey", "frame_id", "first", "second")


# Sets and changes


@query("set03_any_case_member", "select n_name from nation where lower(n_name) in (select lower(x) from (values ('Nation_3'), ('NATION_7'), ('nowhere')) v(x))")
def _(t):
    return R.known_in_any_case(t("nation").select("n_name"), "n_name", t.values("x string", [("Nation_3",), ("NATION_7",), ("nowhere",)]), "x")


_SITES = "(select page_id, url from pages union all select -1, 'http://a.example/x.htm?q=1' union all select -2, 'http://a.example/x?q=1' union all select -3, 'http://a.example/x.html?q=1' union all select -4, 'http://a.example/xy?q=1' union all select -5, 'http://a.example/z')"


@query("set04_url_near_duplicates", f"with p as (select page_id, {_PART['host']} as host, {_PART['query']} as query, regexp_replace({_PART['path']}, '[.]html?$', '') as path from {_SITES} u) select max(page_id) as page_id from p group by host, query, path")
def _(t):
    odd = t.values("page_id long, url string", [(-1, "http://a.example/x.htm?q=1"), (-2, "http://a.example/x?q=1"), (-3, "http://a.example/x.html?q=1"), (-4, "http://a.example/xy?q=1"), (-5, "http://a.example/z")])
    return R.newest_of_near_urls(t("pages").select("page_id", "url").unionByName(odd), "page_id", "url").select("page_id")


@query("set07_not_yet_processed", "select doc_id from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id and l.quality = 1)")
def _(t):
    ledger = t("labels").where("quality = 1").select("doc_id")
    return R.without(t("documents").select("doc_id"), ledger, "doc_id")


@query("set08_cleaned_terms", "select distinct x as term from (select unnest(string_split(lower(p_type), ' ')) as x from part union all select unnest(string_split(lower(n_name) || ' select drop or and', ' ')) from nation) where x not in ('select', 'drop', 'insert', 'delete', 'update', 'and', 'or', 'not', '')")
def _(t):
    one = t("part").select(F.split(F.lower("p_type"), " ").alias("terms"))
    two = t("nation").select(F.split(F.concat(F.lower("n_name"), F.lit(" select drop or and")), " ").alias("terms"))
    return R.cleaned_terms(one.union(two), "terms")


@query("set09_labels", "select l_partkey as label from lineitem union select l_suppkey from lineitem")
def _(t):
    l = t("lineitem")  # noqa: E741
    return l.select(F.explode(F.array("l_partkey", "l_suppkey")).alias("label")).distinct()


@query("mut02_replace_children", "with n as (select page_id, unnest(['name', 'value']) as tag from pages where page_id % 5 = 0) select page_id, 'old' as tag from pages where page_id % 5 <> 0 union all select page_id, tag from n")
def _(t):
    old = t("pages").select("page_id", F.lit("old").alias("tag"))
    new = t("pages").where("page_id % 5 = 0").select("page_id", F.explode(F.array(F.lit("name"), F.lit("value"))).alias("tag"))
    return R.replace_children(old, new, "page_id")


@query("mut03_delete", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def _(t):
    gone = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.without(t("orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("mut04_link_expansion", "with recursive l as (select distinct 'p' || l_partkey as url, 's' || l_suppkey as target from lineitem union select distinct 's' || l_suppkey, 'p' || l_partkey from lineitem), r(url, depth) as (select 'p1', 0 union select l.target, r.depth + 1 from r join l on l.url = r.url where r.depth < 3) select url, min(depth) as depth from r group by 1")
def _(t):
    wide = t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("url"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    return R.expand_links(wide.union(wide.select("target", "url")).distinct(), t.values("url string", [("p1",)]), 3)


_RAW = "(select event_id as raw_id, user_id, event_type as relation, (round(value)::bigint % 7)::bigint as concept1, (round(value)::bigint % 5)::bigint as concept2, sign(value - 20)::bigint as vote from events)"


def raw_assertions(t):
    v = F.round("value").cast("long")
    return t("events").select(F.col("event_id").alias("raw_id"), "user_id", F.col("event_type").alias("relation"), (v % 7).alias("concept1"), (v % 5).alias("concept2"), F.signum(F.col("value") - 20).cast("long").alias("vote"))


@query("mut06_make_assertions", f"select relation, concept1, concept2, min(raw_id) as assertion_id, count(distinct user_id) as creators, sum(vote)::bigint as score from (select relation, concept1, concept2, user_id, min(raw_id) as raw_id, arg_max(vote, raw_id) as vote from {_RAW} r group by 1, 2, 3, 4) group by 1, 2, 3")
def _(t):
    return R.assertions_of(raw_assertions(t))


_SAID = "(select *, 'said ' || concept1 || ' in ' || user_id % 9 as sentence, case when raw_id % 11 = 0 then 0 else vote end as cast_vote from {0} r)"
#: The five kinds of rows that writing makes, each as kind, id and what else it holds, as SQL over a table of raw rows.
_WRITTEN = """
ss as (select sentence, min(raw_id) as sentence_id, arg_min(user_id, raw_id) as by_user from src group by 1),
aa as (select relation, concept1, concept2, min(raw_id) as assertion_id, arg_min(user_id, raw_id) as by_user from src group by 1, 2, 3),
rr as (select min(raw_id) as raw_id, user_id, sentence_id, assertion_id, arg_max(vote, raw_id) as vote, max(raw_id) as voted
  from src join ss using (sentence) join aa using (relation, concept1, concept2) group by user_id, sentence_id, assertion_id),
vv as (select * from (select user_id, assertion_id, arg_max(vote, voted) as vote from rr group by 1, 2) where vote <> 0),
sc as (select assertion_id, sum(vote)::bigint as score from vv group by 1),
made as (
  select 'sentence' as kind, sentence_id as id, by_user as user_id, sentence as detail from ss
  union all select 'raw', raw_id, user_id, sentence_id || '/' || assertion_id from rr
  union all select 'assertion', assertion_id, null, concat_ws('/', relation, concept1, concept2, coalesce(score, 0)) from aa left join sc using (assertion_id)
  union all select 'vote', assertion_id, user_id, vote::varchar from vv
  union all select 'event', sentence_id, by_user, 'sentence' from ss union all select 'event', assertion_id, by_user, 'assertion' from aa
  union all select 'event', raw_id, user_id, 'raw' from rr union all select 'event', assertion_id, user_id, 'vote' from vv)"""


def said_rows(t):
    sentence = F.concat(F.lit("said "), F.col("concept1").cast("string"), F.lit(" in "), (F.col("user_id") % 9).cast("string"))
    return raw_assertions(t).withColumns({"sentence": sentence, "vote": F.when(F.col("raw_id") % 11 == 0, 0).otherwise(F.col("vote"))})


def kinds(rows):
    """All rows of ``R.written`` as kind, id, user_id, detail."""
    s = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("long")
    parts = [
        rows["sentences"].select(F.lit("sentence").alias("kind"), F.col("sentence_id").alias("id"), "user_id", F.col("sentence").alias("detail")),
        rows["raw"].select(F.lit("raw"), "raw_id", "user_id", F.concat_ws("/", s("sentence_id"), s("assertion_id"))),
        rows["assertions"].select(F.lit("assertion"), "assertion_id", none, F.concat_ws("/", "relation", s("concept1"), s("concept2"), s("score"))),
        rows["votes"].select(F.lit("vote"), "assertion_id", "user_id", s("vote")),
        rows["events"].select(F.lit("event"), "object_id", "user_id", "object"),
    ]
    return reduce(lambda a, b: a.union(b), parts)


@query("mut06_written_rows", f"with src as (select raw_id, user_id, relation, concept1, concept2, sentence, cast_vote as vote from {_SAID.format(_RAW)} q), {_WRITTEN} select * from made")
def _(t):
    return kinds(R.written(said_rows(t)))


#: Concepts found to be one: 1 and 3, 3 and 5, 2 and 6; so 1, 3 and 5 are one.
_SAME = [(1, 3), (5, 3), (2, 6)]


@query("mut07_merge_assertions", f"with recursive pair(a, b) as (select * from (values (1, 3), (5, 3), (2, 6)) p(a, b)), two as (select a, b from pair union select b, a from pair), reach(a, b) as (select a, b from two union select reach.a, two.b from reach join two on reach.b = two.a), top as (select a as node, least(a, min(b)) as label from reach group by a), src as (select raw_id, user_id, relation, coalesce(x.label, concept1) as concept1, coalesce(y.label, concept2) as concept2, sentence, cast_vote as vote, concept1 as old1, concept2 as old2 from {_SAID.format(_RAW)} q left join top x on x.node = concept1 left join top y on y.node = concept2), {_WRITTEN} select * from made union all select 'moved', raw_id, null, concat_ws('/', old1, old2, concept1, concept2) from src where old1 <> concept1 or old2 <> concept2")
def _(t):
    """All five kinds of rows after concepts are merged, and an audit row for each raw one that was re-pointed."""
    same = t.values("a long, b long", _SAME)
    rows, audit = R.merged_concepts(said_rows(t), same)
    s = lambda c: F.col(c).cast("string")
    moved = audit.select(F.lit("moved"), "raw_id", F.lit(None).cast("long"), F.concat_ws("/", s("old1"), s("old2"), s("new1"), s("new2")))
    return kinds(R.written(rows)).union(moved)


@query("mut08_audit_log", "select event_id, event_type, user_id from events union all select event_id + 1000000000, 'reviewed', user_id from events where event_type = 'error'")
def _(t):
    log = t("events").select("event_id", "event_type", "user_id")
    return R.appended(log, log.where("event_type = 'error'").select((F.col("event_id") + 1_000_000_000).alias("event_id"), F.lit("reviewed").alias("event_type"), "user_id"))


@query("mut12_score_refresh", f"with v as (select user_id, event_type as object, {_VOTE} as vote from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1 and {_VOTE} is not null), c as (select n_nationkey::bigint as user_id, 'view' as object, 1 as vote from nation), a as (select * from v union all select * from c where not exists (select 1 from v where v.user_id = c.user_id and v.object = c.object)) select object, sum(vote)::bigint as score, count(*) as num_votes from a group by 1")
def _(t):
    votes = t("events").select("user_id", F.col("event_type").alias("object"), F.expr(_VOTE).alias("vote"), "ts", "event_id")
    cast_ = R.best_of(votes, ["user_id", "object"], [F.desc("ts"), F.desc("event_id")]).where("vote is not null").select("user_id", "object", "vote")
    implied = t("nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.lit("view").alias("object"), F.lit(1).alias("vote"))
    return R.vote_scores(cast_.unionByName(R.without(implied, cast_.select("user_id", "object"), ["user_id", "object"])), ["object"])


@query("mut13_merge_with_delta", "with old as (select o_orderkey as url, o_orderstatus as etag, 1 as polarity from orders where o_orderkey % 3 <> 0), new as (select o_orderkey as url, case when o_orderkey % 2 = 0 then 'x' else o_orderstatus end as etag, 3 as polarity from orders), ch as (select n.* from new n left join old o using (url) where o.url is null or o.etag <> n.etag) select coalesce(c.url, o.url) as url, coalesce(c.etag, o.etag) as etag, coalesce(c.polarity, o.polarity) as polarity, coalesce(c.polarity - coalesce(o.polarity, 0), 0) as delta from ch c full join old o on c.url = o.url")
def _(t):
    o = t("orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("url"), F.col("o_orderstatus").alias("etag"), F.lit(1).alias("polarity"))
    new = o.select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(F.col("o_orderstatus")).alias("etag"), F.lit(3).alias("polarity"))
    return R.merged_by_etag(old, new, "url", "etag", "polarity")


@query("mut14_get_or_create", "with known as (select lower(n_name) as text, min(n_nationkey) as id from nation group by 1), asked as (select distinct lower(trim(x)) as text from (values (' Nation_3'), ('NATION_4'), ('new one'), ('New One ')) v(x)) select a.text, coalesce(k.id, (select max(id) from known) + row_number() over (partition by k.id is null order by a.text)) as id, k.id is null as created from asked a left join known k using (text)")
def _(t):
    known = t("nation").groupBy(F.lower("n_name").alias("text")).agg(F.min("n_nationkey").cast("long").alias("id"))
    return R.got_or_created(known, t.values("text string", [(" Nation_3",), ("NATION_4",), ("new one",), ("New One ",)]))
