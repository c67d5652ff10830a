"""Queries by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicon as lex
from ..functions import html as H
from ..functions import math as M
from ..functions import text as T
from ..functions import url as U
from ..matrix.similarity import pairwise_cosine
from ..operators import relational as R

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Read:
    """Reads tables by name; ``values`` makes a small one of literals."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def values(self, schema: str, rows: list) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def query(name: str, sql: str | None = None):
    """Register a function of a table reader."""

    def add(f: Callable[[Read], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Read(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _in(words: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


TOK = r"list_filter(regexp_split_to_array(lower(regexp_replace(text,'[!-/:-@\[-`{-~]','','g')),'[ \t\r\n]+'), lambda x: x<>'')"
HITS = {k: f"len(list_filter({TOK}, lambda w: list_contains({_in(v)}, w)))" for k, v in (("pos", lex.POSITIVE), ("neg", lex.NEGATIVE), ("obscene", lex.OBSCENE))}


def lexicon_counts(docs: DataFrame) -> DataFrame:
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("w"))
    return words.select("doc_id", *[T.hits(F.col("w"), v).alias(k) for k, v in (("pos", lex.POSITIVE), ("neg", lex.NEGATIVE), ("obscene", lex.OBSCENE))])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = lexicon_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return R.top_rows(counts.withColumn("score", M.equation(lex.EQUATIONS[1])), [F.desc("score"), "doc_id"], 20)


# Sources


@query("src01_table_scan", "select page_id, url from pages")
def _(t):
    return t("pages").select("page_id", "url")


@query("src02_key_lookup", "select o_orderkey, o_totalprice from orders where o_orderkey = 33")
def _(t):
    return t("orders").where("o_orderkey = 33").select("o_orderkey", "o_totalprice")


# Filters and projections


@query("flt01_equality", "select c_custkey from customer where c_mktsegment='BUILDING' and c_nationkey=3")
def _(t):
    return t("customer").where("c_mktsegment='BUILDING' and c_nationkey=3").select("c_custkey")


@query("flt02_negated_equality", "select o_orderkey from orders where o_orderstatus='O' and o_custkey is distinct from 1")
def _(t):
    return t("orders").where((F.col("o_orderstatus") == "O") & ~F.col("o_custkey").eqNullSafe(1)).select("o_orderkey")


@query("flt03_like_builder", "select doc_id from documents where contains(lower(text),'the') and contains(lower(text),'and') and not contains(lower(text),'idiot') and length(text)>=0")
def _(t):
    return R.include_exclude(t("documents"), F.col("text"), ["the", "and"], ["idiot"]).select("doc_id")


@query("flt04_good_url", "select page_id from pages where lower(url[1:4])='http'" + "".join(f" and not (strpos(url,'{f}')>1)" for f in lex.BAD_URL_FRAGMENTS))
def _(t):
    return t("pages").where(U.good(F.col("url"), lex.BAD_URL_FRAGMENTS)).select("page_id")


_RULES = [("https://m.", "mobile"), ("blog", "blog"), ("?", "query")]


@query("flt05_url_rules", "select page_id, case when contains(url,'https://m.') then 'mobile' when contains(url,'blog') then 'blog' when contains(url,'?') then 'query' else 'ok' end as reason from pages")
def _(t):
    return t("pages").select("page_id", U.status(F.col("url"), _RULES).alias("reason"))


@query("flt08_text_filter", "select doc_id from documents where (contains(lower(text),'trash') or contains(lower(text),'scum')) and not contains(lower(text),'clown') and length(text)>=200")
def _(t):
    return R.include_exclude(t("documents"), F.col("text"), ["trash", "scum"], ["clown"], all_of=False, least=200).select("doc_id")


@query("flt09_content_fit", "select doc_id from documents where (contains(lower(text),'idiot') or contains(lower(text),'loser')) and not contains(lower(text),'moron') and length(text)>=0")
def _(t):
    return R.include_exclude(t("documents"), F.col("text"), ["idiot", "loser"], ["moron"], all_of=False).select("doc_id")


@query("flt10_due_to_visit", "select event_id from events where ts is null or date_diff('second', ts, timestamp '2024-01-15 00:00:00') >= 86400")
def _(t):
    age = F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    return t("events").where(F.col("ts").isNull() | (age >= 86400)).select("event_id")


@query("flt11_good_html", "select page_id, length(html) as size from pages where length(html) > 10")
def _(t):
    return t("pages").where(F.length("html") > 10).select("page_id", F.length("html").cast("long").alias("size"))


@query("flt14_degree_cutoff", "with d as (select l_partkey, count(*) n from lineitem group by 1), s as (select l_suppkey, count(*) n from lineitem group by 1) select l_orderkey, l_linenumber from lineitem join d using(l_partkey) join s using(l_suppkey) where d.n>30 and s.n>600")
def _(t):
    edges = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    heavy = lambda c, n: edges.groupBy(c).count().where(F.col("count") > n).select(c)
    return edges.join(heavy("l_partkey", 30), "l_partkey", "left_semi").join(heavy("l_suppkey", 600), "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("flt15_either_end", "select l_orderkey, l_linenumber from lineitem where l_partkey=7 or l_suppkey=9")
def _(t):
    return t("lineitem").where("l_partkey=7 or l_suppkey=9").select("l_orderkey", "l_linenumber")


@query("flt17_name_to_id", "select coalesce(min(n_nationkey), 0) as id from nation where lower(n_name)=lower('nation_3')")
def _(t):
    return t("nation").where(F.lower("n_name") == F.lower(F.lit("nation_3"))).agg(F.coalesce(F.min("n_nationkey"), F.lit(0)).alias("id"))


@query("flt18_skip_prefixes", "select doc_id from documents where not (starts_with(text,'The ') or starts_with(text,'And '))")
def _(t):
    return t("documents").where(~(F.col("text").startswith("The ") | F.col("text").startswith("And "))).select("doc_id")


@query("flt20_votes_of_user", "select event_id from events where user_id in (1,2,3)")
def _(t):
    return t("events").where(F.col("user_id").isin(1, 2, 3)).select("event_id")


# Joins


@query("join01_inner", "select o_orderkey, c_name from orders join customer on o_custkey=c_custkey")
def _(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join03_first_match", "select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
def _(t):
    return R.best_of(t("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("join05_orphans", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def _(t):
    return R.without(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("join07_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey=c_custkey and o_totalprice>400000)")
def _(t):
    return t("customer").select("c_custkey").join(t("orders").where("o_totalprice>400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("join11_star", "select n_name, r_name, count(*) as n, round(sum(o_totalprice),2) as total from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by 1,2")
def _(t):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("join13_shared_feature", "select a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey=b.n_regionkey and a.n_nationkey<>b.n_nationkey")
def _(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") != F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


# Aggregates


@query("agg01_counts", "select source, count(*) as n from documents group by 1")
def _(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"))


@query("agg02_lexicon_counts", f"select doc_id, {', '.join(f'{v} as {k}' for k, v in HITS.items())} from documents")
def _(t):
    return lexicon_counts(t("documents"))


@query("agg03_polarity", f"select doc_id, {HITS['pos']}-{HITS['neg']}-{HITS['obscene']} as polarity from documents")
def _(t):
    return lexicon_counts(t("documents")).select("doc_id", (F.col("pos") - F.col("neg") - F.col("obscene")).alias("polarity"))


@query("agg04_weighted_polarity", f"select doc_id, {HITS['pos']}-{HITS['neg']}-2*{HITS['obscene']} as polarity, {HITS['pos']} as pos, {HITS['neg']} as neg from documents")
def _(t):
    return lexicon_counts(t("documents")).select("doc_id", (F.col("pos") - F.col("neg") - 2 * F.col("obscene")).alias("polarity"), "pos", "neg")


_VOTE = "case when event_type='purchase' then 1 when event_type='error' then -1 when event_type='view' then 0 end"


@query("agg09_vote_scores", f"select event_type as object, coalesce(sum(v),0)::bigint as score, count(v) as num_votes from (select event_type, {_VOTE} as v from events) group by 1")
def _(t):
    return R.vote_scores(t("events").select(F.col("event_type").alias("object"), F.expr(_VOTE).alias("vote")), ["object"])


@query("agg13_group_list", "select l_orderkey, list_sort(list(l_linenumber)) as l from lineitem group by 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("l"))


@query("agg14_best", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) r from orders) where r=1")
def _(t):
    return R.best_of(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).drop("o_totalprice")


@query("agg18_read_counters", "select sum(case when value>50 then 1 else 0 end)::bigint as ok, sum(case when value>50 then 0 else 1 end)::bigint as failed from events")
def _(t):
    ok = F.when(F.col("value") > 50, 1).otherwise(0)
    return t("events").agg(F.sum(ok).alias("ok"), F.sum(1 - ok).alias("failed"))


# Windows, order, pages


@query("win03_prefix_dedup", "select min(doc_id) as doc_id, text[1:50] as prefix from documents group by 2")
def _(t):
    return t("documents").groupBy(T.prefix_key(F.col("text")).alias("prefix")).agg(F.min("doc_id").alias("doc_id"))


@query("win06_rank", "select event_id, row_number() over (partition by user_id order by ts, event_id) as r from events")
def _(t):
    return t("events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("r"))


@query("top01_newest", "select o_orderkey from orders order by o_orderdate desc, o_orderkey limit 20")
def _(t):
    return R.top_rows(t("orders"), [F.desc_nulls_last("o_orderdate"), "o_orderkey"], 20).select("o_orderkey")


# Sets and mutations


@query("set01_distinct", "select distinct event_type from events")
def _(t):
    return t("events").select("event_type").distinct()


@query("set05_insert_ignore", "select min(doc_id) as doc_id from documents where doc_id>=20 and text[1:50] not in (select text[1:50] from documents where doc_id<20) group by text[1:50]")
def _(t):
    d = t("documents").select("doc_id", T.prefix_key(F.col("text")).alias("key"))
    return R.without(d.where("doc_id>=20"), d.where("doc_id<20").select("key"), "key").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("set10_intersect_except", "(select n_nationkey as k from nation intersect select c_nationkey from customer) except select s_nationkey from supplier where s_acctbal<0")
def _(t):
    both = t("nation").select(F.col("n_nationkey").alias("k")).intersect(t("customer").select("c_nationkey"))
    return both.subtract(t("supplier").where("s_acctbal<0").select("s_nationkey"))


@query("mut01_upsert", "select c_custkey, case when c_custkey%7=0 then 0.0 else c_acctbal end as c_acctbal from customer")
def _(t):
    old = t("customer").select("c_custkey", "c_acctbal")
    return R.upsert(old, old.where("c_custkey%7=0").withColumn("c_acctbal", F.lit(0.0)), "c_custkey")


@query("mut05_last_vote", f"select user_id, object_type, v as vote from (select user_id, event_type as object_type, {_VOTE} as v, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r=1 and v<>0")
def _(t):
    votes = t("events").select("user_id", F.col("event_type").alias("object_type"), F.expr(_VOTE).alias("vote"), "ts", "event_id")
    return R.last_vote(votes, [F.desc("ts"), F.desc("event_id")]).select("user_id", "object_type", "vote")


@query("mut11_blank_html", "select page_id, cast(null as varchar) as html from pages")
def _(t):
    return t("pages").select("page_id", F.lit(None).cast("string").alias("html"))


# Scalar functions


@query("str07_polish", """select doc_id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(text,'[\n\r\t]',' ','g'),'&quot;?','`','g'),'"','``'),'''','`'),' +',' ','g')) as polished from documents""")
def _(t):
    return t("documents").select("doc_id", T.polish(F.col("text")).alias("polished"))


@query("str08_strip_tags", "select page_id, md5(regexp_replace(html,'<[^>]*>','','g')) as m from pages")
def _(t):
    return t("pages").select("page_id", F.md5(T.strip_tags(F.col("html")).cast("binary")).alias("m"))


@query("str12_punctuation", r"select doc_id, md5(lower(regexp_replace(text,'[!-/:-@\[-`{-~]','','g'))) as m from documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.strip_punctuation(F.col("text")).cast("binary")).alias("m"))


@query("str14_ascii", r"select doc_id, md5(regexp_replace(text,'[^\x00-\x7F]','?','g')) as m from documents")
def _(t):
    return t("documents").select("doc_id", F.md5(T.ascii_replace(F.col("text")).cast("binary")).alias("m"))


@query("mth02_edge_value", "select l_orderkey, l_linenumber, round(l_linenumber*log2(greatest(l_quantity+1,1))/10,9) as v from lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(M.edge_value(F.col("l_linenumber"), F.col("l_quantity")), 9).alias("v"))


@query("mat01_triples", "select l_partkey as concept, 'right' as side, l_returnflag as rel, l_suppkey as other, count(*) as n from lineitem group by all union all select l_suppkey, 'left', l_returnflag, l_partkey, count(*) from lineitem group by all")
def _(t):
    s = t("lineitem").groupBy("l_partkey", "l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    right = s.select(F.col("l_partkey").alias("concept"), F.lit("right").alias("side"), F.col("l_returnflag").alias("rel"), F.col("l_suppkey").alias("other"), "n")
    return right.union(s.select("l_suppkey", F.lit("left"), "l_returnflag", "l_partkey", "n"))


@query("mat09_pairwise_cosine_all")
def _(t):
    return pairwise_cosine(t("embeddings"))


@query("str11_markdown")
def _(t):
    return t("pages").select("page_id", H.markdown(F.col("html")).alias("markdown"))


@query("pipe05_count_and_score", f"with c as (select doc_id, {', '.join(f'{v} as {k}' for k, v in HITS.items())} from documents) select doc_id, pos, neg, obscene, (pos-neg-2*obscene)::double as score from c order by score desc, doc_id limit 20")
def _(t):
    return R.top_rows(lexicon_counts(t("documents")).withColumn("score", M.equation(lex.EQUATIONS[1])), [F.desc("score"), "doc_id"], 20)


# More filters, aggregates, rankings, sets, changes, strings and arithmetic


@query("flt12_delete_flags", "select o_orderkey from orders where o_orderstatus is distinct from 'F'")
def _(t):
    return t("orders").where(~F.col("o_orderstatus").eqNullSafe(F.lit("F"))).select("o_orderkey")


@query("flt16_cross_column", "select l_orderkey, l_partkey from lineitem join part on l_partkey=p_partkey where l_quantity=p_size")
def _(t):
    met = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return met.where(F.col("l_quantity") == F.col("p_size")).select("l_orderkey", "l_partkey")


@query("agg12_best_or_null", "select c_custkey, max(o_totalprice) as best from customer left join orders on c_custkey=o_custkey group by 1")
def _(t):
    best = t("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    return t("customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "best")


@query("win04_every_other", "select o_orderkey from (select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) r from orders) where r%2=1")
def _(t):
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t("orders").withColumn("r", nth).where("r % 2 = 1").select("o_orderkey")


@query("win05_topic_order", "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as r from part")
def _(t):
    return t("part").select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).cast("long").alias("r"))


@query("set02_exploded_terms", "select distinct unnest(string_split(p_type, ' ')) as term from part")
def _(t):
    return t("part").select(F.explode(F.split("p_type", " ")).alias("term")).distinct()


@query("set06_exact_content", "select item_id from benchmark b where not exists (select 1 from documents d where d.text=b.text)")
def _(t):
    return t("benchmark").join(t("documents").select("text"), "text", "left_anti").select("item_id")


@query("mut09_clamp_ratings", "select event_id, sign(value-50)::int as rating from events")
def _(t):
    return t("events").select("event_id", F.signum(F.col("value") - 50).cast("int").alias("rating"))


@query("mut10_backfill", "select l_orderkey, l_linenumber, o_custkey from lineitem left join orders on l_orderkey=o_orderkey")
def _(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "o_custkey")


@query("str15_quotes", """select doc_id, md5(translate(text, '''"', '')) as h from documents""")
def _(t):
    return t("documents").select("doc_id", F.md5(F.translate("text", "'\"", "")).alias("h"))


@query("str24_tagged_split", r"select n_nationkey, regexp_extract(w,'^(.*)/([^/]*)$',1) as word, regexp_extract(w,'^(.*)/([^/]*)$',2) as tag from (select n_nationkey, n_name||'/'||n_regionkey||'/NNP' as w from nation)")
def _(t):
    tagged = t("nation").select("n_nationkey", F.concat_ws("/", "n_name", "n_regionkey", F.lit("NNP")).alias("w"))
    return tagged.select("n_nationkey", *(F.regexp_extract("w", "^(.*)/([^/]*)$", k).alias(name) for k, name in ((1, "word"), (2, "tag"))))


@query("mth07_unit_vectors", "select vec_id, round(list_sum(list_transform(embedding, lambda x: (x::double/n)*(x::double/n))), 6) as dot from (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double*x::double))) as n from embeddings where embedding is not null) where n>0")
def _(t):
    wide = F.transform("embedding", lambda x: x.cast("double"))
    dot = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    rows = t("embeddings").select("vec_id", wide.alias("v")).withColumn("n", F.sqrt(dot(F.col("v")))).where("n > 0")
    return rows.select("vec_id", F.round(dot(F.transform("v", lambda x: x / F.col("n"))), 6).alias("dot"))


@query("mth10_polarity_sign", "select event_id, case when value-50>=0 then 1 else -1 end as polarity from events")
def _(t):
    return t("events").select("event_id", F.when(F.col("value") - 50 >= 0, 1).otherwise(-1).alias("polarity"))
