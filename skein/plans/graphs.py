"""Queries: graph and matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import activation as A
from ..graph import edges as E
from ..matrix import build as B
from ..matrix import svd as S
from ..functions import text as T
from ..matrix.similarity import pairwise_cosine
from ..operators import relational as R
from ..operators.order import dealt, written
from .registry import query

_EDGES = "(select l_partkey as a, l_returnflag as rel, 100000000 + l_suppkey as b, max(l_quantity) / 50 as score from lineitem group by 1, 2, 3)"


def edges(t):
    """part - returnflag - supplier, scored by the largest quantity from 0 to 1; suppliers have numbers of their own."""
    l = t("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_returnflag").alias("rel"), (F.col("l_suppkey") + 100_000_000).alias("b"), "l_quantity")  # noqa: E741
    return dealt(l, ["a", "rel", "b"]).groupBy("a", "rel", "b").agg((F.max("l_quantity") / 50).alias("score"))


@query("grf01_adjacency", f"with e as {_EDGES}, f as (select a as concept, list_sort(list(rel || '/' || b)) as forward from e group by 1), r as (select b as concept, list_sort(list(rel || '/' || a)) as reverse from e group by 1) select coalesce(f.concept, r.concept) as concept, coalesce(forward, []) as forward, coalesce(reverse, []) as reverse from f full join r on f.concept = r.concept")
def _(t):
    said = lambda c: F.array_sort(F.transform(c, lambda x: F.concat_ws("/", x["rel"], x["other"].cast("string"))))
    return E.adjacency(edges(t)).select("concept", said("forward").alias("forward"), said("reverse").alias("reverse"))


@query("grf02_features", f"select distinct 'right' as side, rel, b as other from {_EDGES} e where a = 7 union select 'left', rel, a from {_EDGES} e where b = 7")
def _(t):
    return E.features_of(edges(t), 7)


@query("grf02_assertions_of_feature", f"select a, rel, b, round(score, 6) as score from {_EDGES} e where rel = 'A' and b = 100000003")
def _(t):
    return E.with_feature(edges(t), "right", "A", 100_000_003).select("a", "rel", "b", F.round("score", 6).alias("score"))


_DISCOUNT = "(exp(-((ln({0} + 5) / ln(5.0) - 2.5) * (ln({0} + 5) / ln(5.0) - 2.5)) / 2) / sqrt(2 * 3.141592653589793))"


@query("grf03_one_hop", f"with e as {_EDGES}, s as (select a, b, score as w from e union all select b, a, score from e), d as (select a, count(*) as n from s where w > 0 group by 1), o as (select 1 as concept, 1.0::double as weight union all select 2, 0.5), f as (select concept, weight * {_DISCOUNT.format('coalesce(n, 0)')} as act from o left join d on d.a = concept), x as (select s.b, f.act * s.w * 0.5 * {_DISCOUNT.format('coalesce(d.n, 0)')} as x from s join f on s.a = f.concept left join d on d.a = s.b) select b as concept, round(1 - exp(sum(ln(1 - x))), 6) as activation from x group by 1")
def _(t):
    origins = t.values("concept long, weight double", [(1, 1.0), (2, 0.5)])
    return A.one_hop(edges(t), origins).select("concept", F.round("activation", 6).alias("activation"))


#: Relations of a small world over lineitem: what a line number is called on the way from a part to its supplier, and a
#: line status on the way back.
_WAYS = {"1": "AtLocation", "2": "HasProperty", "3": "Desires", "4": "UsedFor", "5": "PartOf", "6": "Causes", "7": "CapableOf"}
_BACK = {"F": "HasSubevent", "O": "CapableOf"}


def _named(column: str, names: dict[str, str], usual: str):
    return F.coalesce(*[F.when(F.col(column) == k, v) for k, v in names.items()], F.lit(usual))


def named_edges(t):
    """a, rel, b: parts and suppliers both ways, by named relations; an edge for each line."""
    l = t("lineitem").select("l_partkey", (F.col("l_suppkey") + 100_000_000).alias("s"), _named(_WAY, _WAYS, "IsA").alias("there"), _named("l_linestatus", _BACK, "MadeOf").alias("back"))  # noqa: E741
    ways = F.array(F.struct(F.col("l_partkey").alias("a"), F.col("there").alias("rel"), F.col("s").alias("b")), F.struct(F.col("s").alias("a"), F.col("back").alias("rel"), F.col("l_partkey").alias("b")))
    return l.select(F.explode(ways).alias("e")).select("e.*")


def _spread_sql(weights: dict[str, float], origins: str) -> str:
    """Best first over a tree of ways whose activation only falls is the best of all ways, so of each depth's best."""
    case = lambda column, names, usual: f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else '{usual}' end"
    weight = "case rel " + " ".join(f"when '{r}' then {w}" for r, w in weights.items()) + " else 0 end"
    return f"""with recursive e as (
  select l_partkey as a, {case(_WAY, _WAYS, 'IsA')} as rel, 100000000 + l_suppkey as b from lineitem
  union select 100000000 + l_suppkey, {case('l_linestatus', _BACK, 'MadeOf')}, l_partkey from lineitem),
d as (select a, count(*) as n from e group by 1),
f as (select e.a, e.b, 0.5::double * {_DISCOUNT.format('coalesce(d.n, 0)')} * {weight}::double as factor from e left join d on d.a = e.b),
o as (select concept, weight * {_DISCOUNT.format('coalesce(d.n, 0)')} as x from (values {origins}) v(concept, weight) left join d on d.a = concept),
p as (
  select concept, x, 0 as depth from o
  union all select * from (select f.b, p.x * f.factor, depth + 1 from p join f on f.a = p.concept where f.factor > 0 and depth < 12 order by 2 desc, 1 limit 499)),
v as (select * from p order by x desc, concept limit 499)
select concept, round(1 - exp(sum(ln(1 - x))), 6) as activation from v where concept not in (select concept from o) group by 1 order by 1 - exp(sum(ln(1 - x))) desc, concept limit 200"""


_WAY = "l_linenumber"
_ORIGINS = "(1, 1.0::double), (2, 0.5::double)"


def _origins(t):
    return t.values("concept long, weight double", [(1, 1.0), (2, 0.5)])


@query("grf03_spreading", _spread_sql(A.DEFAULT_WEIGHTS, _ORIGINS))
def _(t):
    return A.spread(named_edges(t), _origins(t)).select("concept", F.round("activation", 6).alias("activation"))


@query("grf04_related")
def _(t):
    return A.related(edges(t), t.values("concept long", [(1,)]), {"A": 1.0, "N": 0.5, "-A": 0.5}, 3)


@query("grf04_one_level", f"with e as {_EDGES} select b as concept, round(avg(score * case rel when 'A' then 1.0 when 'N' then 0.5 else 0 end), 6) as weight, 1 as level from e where a = 1 and rel in ('A', 'N') and score > 0 group by 1")
def _(t):
    out = A.related(edges(t), t.values("concept long", [(1,)]), {"A": 1.0, "N": 0.5}, 1)
    return out.select("concept", F.round("weight", 6).alias("weight"), "level")


@query("grf05_projection", "\nunion all ".join(f"select '{v}' as \"view\", * from ({_spread_sql(w, _ORIGINS)})" for v, w in A.VIEWS.items()))
def _(t):
    return A.spread_views(named_edges(t), _origins(t), A.VIEWS).select("view", "concept", F.round("activation", 6).alias("activation"))


@query("grf06_analogous", f"with e as (select * from {_EDGES} e where rel <> 'R'), o as (select rel, b, score from e where a = 7) select e.a as other, round(sum(ln(o.score + e.score + 2) / ln(4.0)), 6) as strength, list_sort(list(distinct e.rel || '/' || e.b)) as shared from e join o using (rel, b) where e.a <> 7 group by 1")
def _(t):
    return E.analogous(edges(t), 7, ["R"]).select("other", F.round("strength", 6).alias("strength"), "shared")


@query("grf07_realised", "with p as (select distinct o_custkey % 25 as a, o_orderstatus as rel, o_custkey % 5 as b from orders where o_orderstatus in ('F', 'O')), s as (select c_nationkey as concept, arg_max(c_name, (c_acctbal, -c_custkey)) as text from customer group by 1), f as (select * from (values ('F', '{1} has {2}'), ('O', '{1} is near {2}')) f(rel, text)) select p.a, p.rel, p.b, replace(replace(f.text, '{1}', x.text), '{2}', y.text) as said from p join f using (rel) join s x on x.concept = p.a join s y on y.concept = p.b")
def _(t):
    props = t("orders").where("o_orderstatus in ('F', 'O')").select((F.col("o_custkey") % 25).alias("a"), F.col("o_orderstatus").alias("rel"), (F.col("o_custkey") % 5).alias("b")).distinct()
    frames = t.values("frame_id int, rel string, text string, goodness int, frequency int", [(1, "F", "{1} had {2}", 1, 5), (2, "F", "{1} has {2}", 2, 5), (3, "O", "{1} is near {2}", 2, 5), (4, "O", "{1} is at {2}", 2, 4)])
    surfaces = t("customer").select(F.col("c_custkey").alias("surface_id"), F.col("c_nationkey").cast("long").alias("concept"), F.col("c_name").alias("text"), F.col("c_acctbal").alias("use_count"))
    return E.realised(props, frames, surfaces).select("a", "rel", "b", "said")


#: Old names of relations by the number of a line, and what they are now.
_OLD = {"1": ("PropertyOf", "HasProperty", False), "2": ("LocationOfInverse", "AtLocation", True), "3": ("IsA", "IsA", False), "4": ("UsedForInverse", "UsedFor", True), "5": ("EffectOf", "Causes", False), "6": ("SubeventOfInverse", "HasSubevent", True), "7": ("ThematicKLine", "ConceptuallyRelatedTo", False)}


@query("grf08_renamed", "select l_partkey as a, relation, case when inverse then l_suppkey end as reversed_from, inverse, count(*) as n from lineitem join (values " + ", ".join(f"({k}, '{new}', {str(inv).lower()})" for k, (_, new, inv) in _OLD.items()) + ") v(k, relation, inverse) on k = l_linenumber group by 1, 2, 3, 4")
def _(t):
    """Lines as edges by old names, renamed, and turned round where the name says inverse."""
    old = F.coalesce(*[F.when(F.col("l_linenumber") == int(k), was) for k, (was, _, _) in _OLD.items()])
    rows = t("lineitem").select("l_partkey", "l_suppkey", *E.renamed(old))
    return rows.groupBy(F.col("l_partkey").alias("a"), "relation", F.when(F.col("inverse"), F.col("l_suppkey")).alias("reversed_from"), "inverse").agg(F.count("*").alias("n"))


# Matrices


@query("mat02_rating_features", f"with e as {_EDGES} select a as concept, 'right' as side, rel, b as other, round(score * ln(6) / ln(2) / 10, 6) as v from e union all select b, 'left', rel, a, round(score * ln(6) / ln(2) / 10, 6) from e")
def _(t):
    from ..functions.math import edge_value

    return B.features(edges(t), edge_value(F.col("score"), F.lit(5))).select("concept", "side", "rel", "other", F.round("v", 6).alias("v"))


@query("mat02_by_relation", f"select rel, a, b, count(*) as v from {_EDGES} e group by 1, 2, 3")
def _(t):
    return B.by_relation(edges(t))


@query("mat02_co_occurrence", "with l as (select distinct l_orderkey, l_suppkey from lineitem) select x.l_suppkey as a, y.l_suppkey as b, count(*) as v from l x join l y on x.l_orderkey = y.l_orderkey and x.l_suppkey < y.l_suppkey group by 1, 2")
def _(t):
    lines = dealt(t("lineitem").select("l_orderkey", "l_suppkey"), ["l_orderkey"])
    lists = lines.groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("items"))  # an order has few lines
    return B.co_occurrence(lists, "l_orderkey", "items")


@query("mat03_identities", f"with e as {_EDGES}, c as (select a as concept from e union select b from e) select concept, side, 'InheritsFrom' as rel, concept as other, round(sqrt(5), 6) as v from c, (values ('right'), ('left')) s(side)")
def _(t):
    return B.identities(edges(t)).select("concept", "side", "rel", "other", F.round("v", 6).alias("v"))


@query("mat04_normalized", f"with e as {_EDGES}, c as (select a as \"row\", rel || '/' || b as col, score as v from e), n as (select \"row\", sqrt(sum(v * v)) as n from c group by 1) select c.\"row\", col, round(v / n, 6) as v from c join n on n.\"row\" = c.\"row\"")
def _(t):
    return B.normalized(cells(t)).select("row", "col", F.round("v", 6).alias("v"))


def cells(t):
    return edges(t).select(F.col("a").alias("row"), F.concat_ws("/", "rel", F.col("b").cast("string")).alias("col"), F.col("score").alias("v"))


@query("mat04_blended")
def _(t):
    both = written(edges(t).where("rel in ('A', 'N')"))
    part = lambda rel: both.where(F.col("rel") == rel).select(F.col("a").alias("row"), F.col("b").cast("string").alias("col"), F.col("score").alias("v"))
    return B.blended([part("A"), part("N")]).select("row", "col", F.round("v", 6).alias("v"))


@query("mat04_balanced", f"with e as {_EDGES} select a as \"row\", b::varchar as col, 1.0::double as rows_length, 1.0::double as columns_length from e where rel = 'A' group by 1, 2")
def _(t):
    """Each cell's row and column length after scaling, the latter by the common one: all are 1."""
    cells = edges(t).where("rel = 'A'").select(F.col("a").alias("row"), F.col("b").cast("string").alias("col"), F.col("score").alias("v"))
    out = written(B.balanced(cells, tolerance=1e-7))
    rows, columns = out.agg(F.count_distinct("row"), F.count_distinct("col")).first()
    length = lambda key, by: out.groupBy(key).agg(F.round(F.sqrt(F.sum(F.col("v") * F.col("v")) / by), 5).alias(f"{'rows' if key == 'row' else 'columns'}_length"))
    return out.join(length("row", 1.0), "row").join(length("col", rows / columns), "col").select("row", "col", "rows_length", "columns_length")


def by_supplier(t):
    return edges(t).select(F.col("a").alias("row"), F.col("b").cast("string").alias("col"), F.col("score").alias("v"))


def factors(t, k=5):
    return S.svd(by_supplier(t), k)


@query("mat05_singular_values")
def _(t):
    return t.values("place int, sigma double", [(i + 1, round(s, 6)) for i, s in enumerate(S.singular_values(by_supplier(t), 5))])


@query("mat06_similar")
def _(t):
    f = factors(t)
    return S.similar(f, 7).select(F.lit("similar").alias("kind"), F.col("row").cast("string").alias("what"), F.col("similarity").alias("value")).union(S.predicted(f, 7).select(F.lit("predicted"), "col", "value"))


@query("mat07_category")
def _(t):
    return S.category(factors(t), [1, 2, -5])


@query("mat08_evaluated")
def _(t):
    asked = t.values("row long, col string", [(1, "100000001"), (7, "100000002"), (-1, "100000001"), (2, "nothing")])
    return S.evaluated(factors(t), asked)


@query("mat09_pairwise_cosine", "select a.l_partkey as a, b.l_partkey as b, round(list_cosine_similarity(a.v, b.v), 6) as cosine from (select l_suppkey as l_partkey, [sum(l_quantity), sum(l_tax), sum(l_discount), count(*)]::double[] as v from lineitem group by 1) a join (select l_suppkey as l_partkey, [sum(l_quantity), sum(l_tax), sum(l_discount), count(*)]::double[] as v from lineitem group by 1) b on a.l_partkey < b.l_partkey")
def _(t):
    sums = F.array(*[F.sum(c).cast("double") for c in ("l_quantity", "l_tax", "l_discount")], F.count("*").cast("double"))
    words = t("lineitem").groupBy(F.col("l_suppkey").alias("vec_id")).agg(sums.alias("embedding"))
    return pairwise_cosine(written(words))  # sums over all lines are made once


@query("mat10_colours")
def _(t):
    """A colour for each document, a sentence or more: words are rows, languages and sources their features; a document
    is the sum of its words' vectors and takes of each anchor word's colour as it is similar to it."""
    from ..functions.math import colour_mix, cosine

    words = t("documents").select("doc_id", F.concat_ws("/", F.coalesce("lang", F.lit("?")), F.coalesce("source", F.lit("?"))).alias("col"), F.explode(T.tokens(F.col("text"))).alias("row"))
    counts = written(words.groupBy("row", "col").agg(F.count("*").alias("n")))  # by word and feature, not by document
    f = S.svd(B.normalized(counts.select("row", "col", F.log1p("n").alias("v"))), 3)
    totals = counts.groupBy("row").agg(F.sum("n").alias("n"))
    anchors = [r["row"] for r in totals.orderBy(F.desc("n"), "row").limit(3).collect()]
    vectors = {r["row"]: r["vector"] for r in f.weighted.where(F.col("row").isin(anchors)).collect()}
    of_doc = S.folded(f, words.select("doc_id", "row", F.lit(1.0).alias("v")), "doc_id")
    near = [F.greatest(cosine(F.col("vector"), F.array(*map(F.lit, vectors[a]))), F.lit(0.0)) for a in anchors]
    mixed = colour_mix(near, [(255, 0, 0), (0, 255, 0), (0, 0, 255)][: len(anchors)])
    return of_doc.select("doc_id", *[F.round(m, 4).alias(n) for m, n in zip(mixed, ("red", "green", "blue"))])
