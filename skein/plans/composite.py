"""Queries: whole pipelines as single calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lex
from ..functions import text as T
from ..pipelines import crawl
from ..sources import sinks
from .registry import HITS, TOK, lexicon_counts, query
from .relational import _PART, _SENT

_FOUND = f"with f as (select * from documents where contains(lower(text), 'the') and not contains(lower(text), 'idiot') and doc_id not in (select doc_id from labels where quality = 1)), s as (select doc_id, unnest({_SENT}) as sent, generate_subscripts({_SENT},1)-1 as pos from f), h as (select *, max(case when contains(sent,' the ') then 1 else 0 end) over (partition by doc_id order by pos rows between 1 preceding and 1 following) as near from s), w as (select doc_id, substr(string_agg(trim(sent), ' ... ' order by pos), 1, 500) as snippet from h where near=1 group by 1)"


@query("pipe01_search_stored", _FOUND + " select min(doc_id) as doc_id, snippet from w where length(snippet) > 20 and not contains(lower(snippet), 'clown') and snippet not in (select text from benchmark) group by snippet")
def _(t):
    return crawl.search_stored(t("documents"), t("labels").where("quality = 1").select("doc_id"), t("benchmark").select(F.col("text").alias("snippet")), include=["the"], exclude=["idiot"], term=" the ", eliminate=["clown"])


@query("pipe02_visit")
def _(t):
    feeds = t("pages").select("page_id", "url", "html")
    return crawl.visit(feeds, "page_id", "html", "the", ["idiot"], lex.POSITIVE, lex.NEGATIVE)


@query("pipe03_harvest", "with u as (select page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as s from pages where lower(url[1:4]) = 'http' and not strpos(url, 'blog') > 1 and not strpos(url, '/fr/') > 1 and not strpos(url, 'ref=') > 1) select url, min(page_id) as first_id, row_number() over (order by min(page_id)) as url_order from u group by url")
def _(t):
    return crawl.harvest(t("pages").select("page_id", "url"), "page_id", "url", lex.BAD_URL_FRAGMENTS)


_VARIED = "(select page_id, url from pages union all select page_id + 1000000, url || '.html' from pages where not contains(url, '?') and not contains(url, '#'))"


@query("pipe03_screened_harvest", f"""with u as (select url, min(page_id) as first_id from {_VARIED} group by 1),
t as (select *, case when not (lower(url[1:4]) = 'http' and not strpos(url, 'blog') > 1 and not strpos(url, '/fr/') > 1 and not strpos(url, 'ref=') > 1) then 'bad' when contains(url, 'https://m.') then 'mobile' when contains(url, 'page=') then 'page' else 'ok' end as rule,
  {_PART['host']} as h, {_PART['query']} as q, regexp_replace({_PART['path']}, '[.]html?$', '') as p from u),
n as (select *, case when rule = 'ok' and first_id < max(first_id) over (partition by rule, h, q, p) then 'near duplicate' else rule end as reason from t)
select url, first_id, reason, case when reason = 'ok' then row_number() over (partition by reason order by first_id) end as url_order from n""")
def _(t):
    """The addresses of all pages, and again with .html behind those that have neither query nor fragment."""
    found = t("pages").select("page_id", "url")
    bare = found.where(~F.contains("url", F.lit("?")) & ~F.contains("url", F.lit("#")))
    found = found.unionByName(bare.select((F.col("page_id") + 1_000_000).alias("page_id"), F.concat("url", F.lit(".html")).alias("url")))
    return crawl.screened(found, "page_id", "url", lex.BAD_URL_FRAGMENTS, [("https://m.", "mobile"), ("page=", "page")])


@query("pipe04_parse_pages")
def _(t):
    criteria = t.values("criteria_id int, include string, exclude string", [(1, "the", "idiot"), (2, "der", "und")])
    return crawl.parse_pages(t("pages"), criteria)


@query("pipe06_listening_post", "with s as (select * from (values (1, 'the, and', 'idiot', 20), (1, 'the, of', 'clown', 30), (2, 'der', '', 5)) s(post, include, exclude, lim)), d as (select doc_id, lower(text) as low from documents), m as (select 1 as post, doc_id from d where (contains(low, 'the') or contains(low, 'and') or contains(low, 'of')) and not contains(low, 'idiot') and not contains(low, 'clown') union all select 2, doc_id from d where contains(low, 'der')) select post, doc_id from (select *, row_number() over (partition by post order by doc_id) as r from m) where r <= case post when 1 then 30 else 5 end")
def _(t):
    specs = t.values("post int, include string, exclude string, lim int", [(1, "the, and", "idiot", 20), (1, "the, of", "clown", 30), (2, "der", "", 5)])
    return crawl.listening_posts(specs, t("documents"))


@query("pipe07_film_report", f"select 'urls' as report, u as line from (select distinct url as u from pages) union all select 'words', w || chr(9) || count(*) from (select unnest({TOK}) as w from documents) where w not in (select unnest([{','.join(repr(w) for w in lex.STOP)}])) group by w")
def _(t):
    folder = sinks.shared_folder(t.spark, "film")
    sinks.report(t("pages").select("url").distinct(), f"{folder}/urls")
    sinks.report(T.word_frequency(t("documents"), "text", lex.STOP), f"{folder}/words")
    lines = lambda name: t.spark.read.option("sep", "\n").text(f"{folder}/{name}").select(F.lit(name).alias("report"), F.col("value").alias("line"))
    return lines("urls").where("line <> 'url'").union(lines("words").where("line <> concat('word', chr(9), 'n')"))


@query("pipe08_word_associations")
def _(t):
    from .graphs import edges

    return crawl.associations(edges(t), [1, 2, 3], k=5)


@query("pipe09_background_sweep", f"with c as (select doc_id, {HITS['pos']} as pos from documents) select n_nationkey as site, doc_id from nation, c where n_nationkey < 3 and pos > 0 and doc_id % 3 = n_nationkey")
def _(t):
    hits = lexicon_counts(t("documents")).where("pos > 0").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("site"))
    sites = t("nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("site"))
    return hits.join(F.broadcast(sites), "site", "left_semi").select("site", "doc_id")  # three sites


