"""HTML, dates, tokens, lemmas and sentences."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import dates, html, text, url
from skein.nlp import lemma, normalize, parse


def value(spark, column, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("said, want", [
    ("HTTP://Www.Example.COM/A?b=1#c", ("http", "Www.Example.COM", "/A", "b=1", "c")), ("www.example.org/x", ("", "", "www.example.org/x", "", "")),
    ("//host/only", ("", "host", "/only", "", "")), ("mailto:a@b", ("mailto", "", "a@b", "", "")), ("?q", ("", "", "", "q", "")), ("", ("",) * 5),
])
def test_parts_of_odd_urls_give_them_back(spark, said, want):
    p = url.parts(F.col("u"))
    got = value(spark, F.struct(*[c.alias(k) for k, c in p.items()], url.recompose(p).alias("again")), u=said)
    assert tuple(got)[:5] == want and got["again"] == said.replace("HTTP:", "http:")


def test_pages_without_scripts_and_forms():
    page = "<div><p>a &lt; b<script>x('</p>')</script></p><form><input><p>hidden</form><ul><li>one<ol><li>two</ol></ul><div><form>never closed</div>seen</div>"
    assert html.parse_nodes(page) == ["a < b", "one", "two", "seen"]
    assert html.clean_html("<p class='x'>a<!-- c --><script>z</script><br>b &amp; c") == "<p class='x'>a<br>b &amp; c"
    marked = html.to_markdown("<h2>T</h2><p>a <em>b</em></p><ol><li>x<ul><li>y</li></ul></li><li>z</li></ol><pre>p\n q</pre><blockquote>w</blockquote><hr><img src=i alt=j><a href='/l'>k</a>")
    for part in ("## T", "a _b_", "\n  1. x", "\n    * y", "\n  2. z", "    p\n     q", "> w", "* * *", "![j](i)", "[k][1]", "[1]: /l"):
        assert part in marked


@pytest.mark.parametrize("said, want", [
    ("on 3.4.2010", (2010, 4, 3)), ("12/25/2011", (2011, 12, 25)), ("2012-1-9", (2012, 1, 9)), ("May 5, 2013", (2013, 5, 5)),
    ("am 7. März 2014", (2014, 3, 7)), ("1 Okt 2015", (2015, 10, 1)), ("31.31.2015", None), ("1.2.1999", None), ("1-2/2015", None), ("5 5 2016", (2016, 5, 5)),
])
def test_dates_are_found_alike_in_both_ways(spark, said, want):
    want = want and datetime.date(*want)
    assert dates.parse_date(f"it was {said} there") == want
    assert value(spark, dates.first_date(F.col("t")), t=f"it was {said} there") == want


def test_nearest_date_goes_back_over_nodes():
    nodes = ["1.1.2010", "May 4, 2012", "9", "the cat", "3.3.2013"]
    assert dates.nearest_date(nodes, 3) == datetime.date(2012, 5, 4) and dates.nearest_date(nodes, 3, 1) is None
    assert dates.nearest_date(["x" * 400 + " 1.1.2011", "cat"], 1) is None


def test_greedy_snippets_do_not_overlap(spark):
    said = "One is first. Two has cat here. Three follows on. Four has cat too. Five ends. No. Six is far. Seven is far."
    got = value(spark, text.greedy_snippets(F.col("t"), "CAT"), t=said)
    assert got == ["One is first. Two has cat here. Three follows on.", "Four has cat too. Five ends."]


def test_frames_match_literals_only(spark):
    first, second = text.template_match("{1} (a+b) {2}", F.col("t"))
    assert tuple(value(spark, F.struct(first, second), t="x (a+b) y")) == ("x", "y") and tuple(value(spark, F.struct(first, second), t="x aab y")) == (None, None)


TOKENS = [
    ("A dog barks. Then, it stops.", "A dog barks . Then , it stops ."),
    ('"Quite so," said Ann, "they can\'t (ever) find the Owl\'s nest."', "`` Quite so , '' said Ann , `` they ca n't ( ever ) find the Owl 's nest . ''"),
]


@pytest.mark.parametrize("plain, tokens", TOKENS)
def test_tokens_and_back(spark, plain, tokens):
    got = value(spark, normalize.tokenize(F.col("t")), t=plain)
    assert got == tokens
    assert value(spark, normalize.untokenize(normalize.tokenize(F.col("t"))), t=plain) == plain


@pytest.mark.parametrize("word, want", [("lemmatizing", ("lemmatize", "ing")), ("cow", ("cow", "")), ("went", ("go", "ed")), ("people", ("person", "s")), ("stories", ("story", "s")), ("running", ("run", "ing")), ("boxes", ("box", "s")), ("testiest", ("testy", "est")), ("glass", ("glass", ""))])
def test_words_split_and_inflect_back(word, want):
    assert lemma.split_word(word) == want and lemma.inflect(*want) == word


@pytest.mark.parametrize("said", ["this is the testiest test that ever was tested", "the people went running", "i saw the stories of it", "the of", "you walked"])
def test_lemmas_and_residue_give_the_text_back(said):
    lemmas, residue = lemma.lemma_split(said)
    assert lemmas and lemma.lemma_combine(lemmas, residue) == said


def test_stems():
    assert lemma.stem("maisons", "fr") == "maison" and lemma.stemmed("las ciudades grandes", "es") == "ciudad grand las"
    assert lemma.stemmed("zeta alfa", "it") == "alfa zet"


@pytest.mark.parametrize("said, want", [
    ("A dog is an animal.", ("IsA", "A dog", "an animal")), ("A knife is used for cutting bread", ("UsedFor", "A knife", "cutting bread")), ("Birds can sing", ("CapableOf", "Birds", "sing")),
    ("The rose is beautiful", ("HasProperty", "The rose", "beautiful")), ("It is a day", None), ("", None), ("word " * 30, None),
])
def test_sentences_become_assertions(said, want):
    assert parse.parse(said) == want


def plainly(sentence, longest=24):
    """The likeliest pattern of one sentence, from one table of all runs of its words."""
    plain = sentence.split()
    words, cells = [w.lower().strip(",;:") for w in plain], {}
    for size in range(1, min(len(words), longest) + 1):
        for i in range(len(words) - size + 1):
            cell = cells[i, i + size] = parse.tags_of(words[i]) if size == 1 else {}
            for made, parts, p in parse.RULES:
                for k in range(i + 1, i + size) if len(parts) == 2 else ():
                    q = p * cells[i, k].get(parts[0], 0) * cells[k, i + size].get(parts[1], 0)
                    cell[made] = max(cell.get(made, 0), q)
            for made, parts, p in parse.RULES:
                if len(parts) == 1 and parts[0] in cell:
                    cell[made] = max(cell.get(made, 0), p * cell[parts[0]])
    found = [(1e-60, "", "", "")]
    for relation, pattern, weight in parse.PATTERNS:
        said = [part.split("|") for part in pattern if not part.isupper()]
        for end in range(1, len(words)) if pattern[0].isupper() else (0,):
            start = end + len(said)
            if start < len(words) and all(words[end + i] in x for i, x in enumerate(said)):
                p = cells.get((start, len(words)), {}).get(pattern[-1], 0) * (cells.get((0, end), {}).get(pattern[0], 0) if end else 1)
                found.append((p * weight, relation, " ".join(plain[:end]), " ".join(plain[start:])))
    best = max(found, key=lambda f: f[0])
    return best[1:] if best[1] not in ("", "junk") else None


def test_sentences_parsed_together_are_those_parsed_one_by_one():
    rng = np.random.default_rng(3)
    words = "a the dog dogs can be used for to is are was in on running beautiful quickly wants causes made part of has it and walked near bread, Knife".split()
    said = [" ".join(rng.choice(words, n)) for n in rng.integers(1, 10, 1500)]
    said += [" ".join([*rng.choice(["a", "x", "zing", "of"], n), "is", *rng.choice(["the", "y", "zed"], 27 - n)]) for n in range(1, 27)]
    got = parse.parse_all(said)
    assert got == [plainly(s) for s in said] and sum(g is not None for g in got) > 20
    assert parse.parse_all(["", None]) == [None, None]


def test_words_are_counted_in_parts_as_many_as_the_texts_need(spark):
    docs = spark.createDataFrame([(i % 40, f"one two two w{i}") for i in range(80)] + [(99, None)], "doc_id long, text string")
    got = text.term_counts(docs, "doc_id", F.col("text"), at_once=100)
    assert got.rdd.getNumPartitions() >= 12  # 1,270 characters
    counts = {(r["doc_id"], r["word"]): r["n"] for r in got.collect()}
    assert len(counts) == 160 and counts[7, "two"] == 4 and counts[7, "w47"] == 1
