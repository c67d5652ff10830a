"""Queries: tokens, stop words, concepts, lemmas and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..nlp import lemma as L
from ..nlp import normalize as N
from ..nlp import parse as P
from ..nlp import peg as G
from ..nlp.stem import LANGUAGES
from ..operators.order import hinted, kept, written
from .registry import query


def _replaced(column: str, rules) -> str:
    for pattern, becomes in rules:
        fixed = becomes.replace("$1", "\\1").replace("'", "''")
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{fixed}', 'g')"
    return f"trim({column})"


_SAID = "text || ' \"Very deep,\" he can''t say (or cannot) it''s.'"


def said(t):
    return F.concat(F.col("text"), F.lit(" \"Very deep,\" he can't say (or cannot) it's."))


@query("nlp01_tokens", f"select doc_id, md5({_replaced(_SAID, N._TOKEN_RULES)}) as h from documents")
def _(t):
    return t("documents").select("doc_id", F.md5(N.tokenize(said(t)).cast("binary")).alias("h"))


@query("nlp01_round_trip", "select n_nationkey, n_name || ' said, \"it''s (almost) done; you can''t lose.\"' as again from nation")
def _(t):
    text = F.concat("n_name", F.lit(" said, \"it's (almost) done; you can't lose.\""))
    return t("nation").select("n_nationkey", N.untokenize(N.tokenize(text)).alias("again"))


def _list(words):
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


_SPLIT = "list_filter(string_split(regexp_replace(lower({0}), ' +', ' ', 'g'), ' '), lambda w: w <> '')"


@query("nlp02_word_classes", f"select distinct w as word, list_contains({_list(N.STOP['en'])}, lower(w)) as is_stop, list_contains({_list(N.FREQUENCY['en'])}, lower(w)) as is_freq from (select unnest(string_split(text || ' Often NEVER', ' ')) as w from documents) where w <> ''")
def _(t):
    w = t("documents").select(F.explode(F.split(F.concat("text", F.lit(" Often NEVER")), " ")).alias("word")).where("word <> ''").distinct()
    return w.select("word", N.is_stop(F.col("word"), "en").alias("is_stop"), N.is_frequency(F.col("word"), "en").alias("is_freq"))


@query("nlp02_blacklist", f"with s as (select doc_id, unnest(string_split(text, '.')) as s from documents) select doc_id, s as sentence, len(list_filter({_SPLIT.format('s')}, lambda w: not list_contains({_list(N.BLACKLIST)}, w))) = 0 as listed, list_filter({_SPLIT.format('s')}, lambda w: list_contains({_list(N.FREQUENCY['en'])}, w))[1] as freq from s")
def _(t):
    s = t("documents").select("doc_id", F.explode(F.split("text", "[.]")).alias("sentence"))
    return s.select("doc_id", "sentence", N.is_blacklisted(F.col("sentence")).alias("listed"), N.first_frequency(F.col("sentence"), "en").alias("freq"))


_ENDS = r"""^[!"#$%&()*+,./:;<=>?@\[\\\]^_{|}~]+|[!"#$%&()*+,./:;<=>?@\[\\\]^_{|}~]+$"""
_WORDS = f"list_transform(list_filter(list_transform(list_filter(string_split(regexp_replace(replace({_replaced('text', N._TOKEN_RULES)}, '/', ' '), ' +', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: lower(regexp_replace(w, '{_ENDS}', '', 'g'))), lambda w: w <> ''), lambda w: case w " + " ".join(f"when '{a}' then '{b.replace(chr(39), chr(39) * 2)}'" for a, b in N.CORRECT.items()) + " else w end)"


@query("nlp03_words", f"select doc_id, list_filter({_WORDS}, lambda w: not list_contains({_list(N.STOP['en'])}, w)) as words from documents")
def _(t):
    return t("documents").select("doc_id", N.words(F.col("text"), strip_stop=True).alias("words"))


@query("nlp04_concepts", f"with w as (select doc_id, list_filter({_WORDS}, lambda w: not list_contains({_list(N.STOP['en'])}, w)) as w from documents), c as (select distinct doc_id, array_to_string(w[i:i+n-1], ' ') as concept from w, unnest(range(1, len(w) + 1)) r(i), (values (1), (2)) k(n) where i + n - 1 <= len(w)), v as (select concept from c group by 1 having count(*) >= 3) select doc_id, concept from c semi join v using (concept)")
def _(t):
    docs = t("documents").select("doc_id", "text")
    made = N.word_pairs(docs.repartition("doc_id"), "doc_id", "text")  # dealt by text, not by word
    # A text's concepts are distinct; those of an id come together only where it has several texts.
    several = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    every = written(made.distinct() if several else made)  # made once for both uses
    vocabulary = written(every.groupBy("concept").count().where("count >= 3").select("concept"))
    return every.join(hinted(vocabulary, 2_000_000), "concept", "left_semi").select("doc_id", "concept")


@query("nlp05_lemma_factors")
def _(t):
    return t("documents").select("doc_id", L.lemma_factor(F.col("text")).alias("f")).select("doc_id", "f.lemmas", "f.residue")


@query("nlp06_recombined")
def _(t):
    f = t("documents").select("doc_id", L.lemma_factor(F.col("text")).alias("f"))
    return f.select("doc_id", L.recombined(F.col("f.lemmas"), F.col("f.residue")).alias("text"))


@query("nlp07_trie_lemmas")
def _(t):
    """Lemmas of all words of the documents, by endings learned from the word families that they hold themselves."""
    words = t("documents").select(F.explode(N.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return L.lemmas_of(kept(words))


_FAMILY = """with w as (select distinct unnest(""" + _WORDS + """) as word from documents),
t as (select word, c.cut, a.add, substr(word, 1, length(word) - c.cut) || a.add as lemma from w, (values (1), (2), (3), (4), (5)) c(cut), (values (''), ('e'), ('y')) a(add)
  where length(word) > 3 and length(a.add) < c.cut and length(word) - c.cut >= 2)
select t.word, arg_min(lemma, (t.cut, t.add)) as lemma from t where length(lemma) >= 3 and lemma in (select word from w) group by 1"""


@query("nlp07_word_families", _FAMILY)
def _(t):
    words = t("documents").select(F.explode(N.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return L.word_families(kept(words)).select("word", "lemma")


@query("nlp08_stems")
def _(t):
    """The sorted stems of all documents of the languages that have a stemmer."""
    docs, out = t("documents").select("doc_id", "lang", "text"), None
    for lang in LANGUAGES:
        mine = docs.where(F.col("lang") == lang).select("doc_id", "lang", L.stem_text(F.col("text"), lang).alias("stems"))
        out = mine if out is None else out.unionByName(mine)
    return out


@query("nlp09_identity", "select doc_id, text as normal from documents")
def _(t):
    return t("documents").select("doc_id", N.identity(F.col("text")).alias("normal"))


@query("nlp10_scripts", "select doc_id, regexp_matches(s, '[぀-ゟ]') as hiragana, regexp_matches(s, '[゠-ヿ]') as katakana, regexp_matches(s, '[一-鿿]') as kanji, regexp_matches(s, '[A-Za-z]') as romaji, regexp_matches(s, '[0-9]') as digit from (select doc_id, text || case doc_id % 4 when 1 then 'ひらがな' when 2 then 'カタカナ' when 3 then '漢字' else '' end as s from documents)")
def _(t):
    """The scripts of all documents, to three of four of which words of another script are added."""
    more = F.when(F.col("doc_id") % 4 == 1, "ひらがな").when(F.col("doc_id") % 4 == 2, "カタカナ").when(F.col("doc_id") % 4 == 3, "漢字").otherwise("")
    return t("documents").select("doc_id", *N.scripts(F.concat("text", more)))


@query("nlp11_assertions")
def _(t):
    """The likeliest assertion of every sentence of all documents that has one."""
    words = G.cut(t("documents"), "doc_id", "text")
    said = words.select("doc_id", "sentence", F.array_join(F.filter("words", lambda w: w != ""), " ").alias("said"))
    return said.select("doc_id", "sentence", P.parsed(F.col("said")).alias("p")).select("doc_id", "sentence", "p.*").where("relation is not null")


@query("nlp12_tagged_assertions")
def _(t):
    """Every sentence of all documents, its words tagged by what the whole table says of them."""
    return G.assertions_of(t("documents"), "doc_id", "text")


@query("nlp13_repairs", "with a as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 'AtLocation' when 1 then 'IsA' when 2 then 'junk' else 'CapableOf' end as relation, case l_returnflag when 'A' then 'near' when 'N' then 'in' else 'of' end as adverb, case when l_quantity > 40 then 'one two three four five six seven' else 'short text' end as text1, 'x' as text2 from lineitem) select l_orderkey, l_linenumber, case when relation = 'AtLocation' and adverb = 'near' then 'LocatedNear' when relation in ('IsA', 'CapableOf') and adverb in ('in', 'on', 'at', 'by') then 'AtLocation' else relation end as relation, case when relation in ('IsA', 'CapableOf') and adverb in ('in', 'on', 'at', 'by') then '' else adverb end as adverb, text1, text2 from a where relation <> 'junk' and not (relation = 'AtLocation' and adverb = 'of') and text1 = 'short text'")
def _(t):
    kind = F.element_at(F.array(F.lit("AtLocation"), F.lit("IsA"), F.lit("junk"), F.lit("CapableOf")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    adverb = F.when(F.col("l_returnflag") == "A", "near").when(F.col("l_returnflag") == "N", "in").otherwise("of")
    text1 = F.when(F.col("l_quantity") > 40, "one two three four five six seven").otherwise("short text")
    return P.repaired(t("lineitem").select("l_orderkey", "l_linenumber", kind.alias("relation"), adverb.alias("adverb"), text1.alias("text1"), F.lit("x").alias("text2")))
