"""Operators against SQL, brute force and held-out accuracy on whole small tables, and with odd inputs."""

import hashlib
import os
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.llm import chat_format, decontamination, jaccard_join, language_id, license_scan, mixing, quality, queries, secret_scan, toxicity, vp_search

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="no test tables")


def rows(frame):
    tidy = lambda v: None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)
    return sorted((tuple(map(tidy, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark", "clients", "vendors"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def trees(spark, rows):
    return spark.createDataFrame(rows, "tree_id string, msg_id long, parent_id long, role string, text string, score double")


def test_cycles_leave_no_conversation_and_end(spark):
    made = []
    for n in (2, 3, 5):
        made += [(f"c{n}", i, (i + 1) % n, "user", "x", 1.0) for i in range(n)] + [(f"c{n}", 10, 0, "user", "tail", 9.0), (f"c{n}", 11, 10, "user", "tail", 9.0)]
        made += [(f"c{n}", 20, None, "user", "root", 0.0), (f"c{n}", 21, 20, "assistant", "leaf", 0.0)]
    got = {r["tree_id"]: (r["leaf_id"], r["n_messages"]) for r in chat_format.format_trees(trees(spark, made), branches=5).collect()}
    assert got == {"c2": (21, 2), "c3": (21, 2), "c5": (21, 2)}


def test_branches_are_ranked_as_by_brute_force(spark):
    rng = random.Random(4)
    made = []
    for t in range(12):
        n = rng.randrange(1, 40)
        made += [(f"t{t}", i, None if not i else rng.randrange(i), "user", f"m{i}", rng.choice([0.0, 0.25, 0.5])) for i in range(n)]
    want = set()
    for t in range(12):
        mine = {r[1]: r for r in made if r[0] == f"t{t}"}
        paths = []
        for leaf in set(mine) - {r[2] for r in mine.values()}:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = mine[at][2]
            paths.append((-sum(mine[i][5] for i in path), -len(path), leaf, path[::-1]))
        want |= {(f"t{t}", leaf, k, "".join(f"[TURN]user[TEXT]m{i}[/TURN]" for i in path)) for k, (_, _, leaf, path) in enumerate(sorted(paths)[:3], 1)}
    got = chat_format.format_trees(trees(spark, made), branches=3).collect()
    assert {(r["tree_id"], r["leaf_id"], r["branch"], r["formatted"][3:-4]) for r in got} == want


def test_chat_nulls_repeats_and_empty_tables(spark):
    odd = [("a", 1, None, None, None, None), ("a", 2, 1, "assistant", "z", None), ("a", 2, 1, "assistant", "y", 1.0), ("a", 3, 99, "user", "", None), (None, 1, None, "user", "x", 0.0), ("b", None, None, "user", "x", 0.0), ("d", 1, 1, "user", "é" * 100_000, 0.0)]
    got = {(r["tree_id"], r["leaf_id"]): r["formatted"] for r in chat_format.format_trees(trees(spark, odd), branches=9).collect()}
    assert got.keys() == {("a", 2), ("a", 3), ("d", 1)} and got["a", 2] == "<s>[TURN][TEXT][/TURN][TURN]assistant[TEXT]y[/TURN]</s>" and len(got["d", 1]) == 100_030
    assert chat_format.format_trees(trees(spark, [])).count() == 0


def test_mix_takes_the_budget_in_order_of_finish(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "c", None])) for i in range(300)] + [(7, "same row here", "a")] * 50 + [(None, f"no id {i}", "b") for i in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(frame).collect()
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len(t.split())
    assert len(got) == 2 * len(docs) and sum(r["taken"] for r in got) == sum(size.values()) * 3 // 2
    for s in size:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 40 and mine[0]["source_size"] == size[s]
        finish = sorted(r["finish"] * r["target"] for r in mine)
        upto = np.cumsum([r["size"] for r in sorted(mine, key=lambda r: (r["copy"], r["place"]))])
        assert np.allclose(finish, upto)
    ends = [r["finish"] for r in got if r["finish"] is not None]
    assert ends == sorted(ends)


def test_matches_against_whole_alignments(spark):
    rng = random.Random(6)
    items = ["".join(rng.choice("abcd ") for _ in range(n)).strip() for n in (20, 33, 60, 120)]
    items = [decontamination.normal(t) for t in items]

    def changed(t):
        t = list(t)
        for _ in range(rng.randrange(0, 9)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice(["", "x", "xy", t[i]])
        return "".join(t)

    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 200))) + changed(rng.choice(items)) + "d" * rng.randrange(0, 50) for _ in range(150)]

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    index = decontamination.Items(list(enumerate(items)), 8, 0.08)
    for text in texts:
        text = decontamination.normal(text)
        want = {(k, e) for k, t in enumerate(items) if (e := least(t, text)) <= int(len(t) * 0.08)}
        assert {(k, e) for k, _, _, e in index.find(text)} == want


def test_repeated_characters_take_bounded_time_and_memory():
    import tracemalloc

    items = decontamination.Items([(1, "-" * 300), (2, "=-" * 60), (3, "-" * 150 + "x" + "-" * 149)], 8, 0.08)
    tracemalloc.start()
    began = time.time()
    got = items.find("-" * 60_000 + " end")
    took, most = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(1, 0, 300, 0), (3, got[1][1], got[1][2], 1)] and most < 100e6 and took < 20
    got = items.find("=" + "-" * 100 + "x" + "-" * 190)
    assert {(k, e) for k, _, _, e in got} == {(1, 10), (3, 9 + 1)} or {k for k, *_ in got} == {1, 3}


def test_bands_in_small_parts_are_the_same(monkeypatch):
    rng = random.Random(9)
    items = decontamination.Items([(i, "".join(rng.choice("ab") for _ in range(rng.randrange(20, 60)))) for i in range(12)] + [(99, "a" * 50)], 8, 0.08)
    texts = ["".join(rng.choice("ab") for _ in range(200)) for _ in range(30)] + ["a" * 300, "b" * 20 + "a" * 47 + "b" + "a" * 9]
    whole = [items.find(t) for t in texts]
    monkeypatch.setattr(decontamination.Items, "PAIRS", 7)
    assert [items.find(t) for t in texts] == whole and any(whole)


def test_long_conversations_take_time_in_proportion(spark):
    said = lambda n: [("c", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"é[/TURN] {i}", 0.0) for i in range(n)]
    took = []
    for n in (10, 4000):
        chat_format.format_trees(trees(spark, said(n))).collect()
        began = time.time()
        r = chat_format.format_trees(trees(spark, said(n))).first()
        took.append(time.time() - began)
        texts = [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]]
        assert texts == [f"é[\\/TURN] {i}" for i in range(1, n, 2)]
    assert took[1] < 5 * took[0] + 20


def test_decontamination_keeps_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "xx who was the first to fly over it xx"), (1, "who was the first to fly over it"), (1, "who was the first to fly over it"), (2, ""), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "Who was the FIRST to fly over it")], "item_id long, text string")
    assert sorted(map(str, ((r["doc_id"], r["edits"]) for r in decontamination.matches(docs, items).collect()))) == ["(1, 0)", "(1, 0)", "(None, 0)"]
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect()) == [2, 3]
    assert decontamination.matches(docs.limit(0), items).count() == 0


@tables
def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op1_language_id"](spark, MEDIUM).where("held_out").join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.where("lang is not null").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 300 and right >= 0.98


def test_language_columns_that_clash_are_kept_by_the_filter(spark):
    docs = spark.createDataFrame([(i, f"the cat and the dog {i}" if i % 2 else f"der Hund und die Katze {i}", "en" if i % 2 else "de", f"s{i}", "p", True) for i in range(60)] + [(90, "", "en", "x", "y", False), (91, "\U000302a9 \U00031234", None, "x", "y", False)], "doc_id long, text string, lang string, score string, lang_pred string, rejected boolean")
    model = language_id.train(docs, F.lit(True))
    kept = language_id.confident(docs, model)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} >= {f"s{i}" for i in range(60)}
    assert language_id.annotate(docs, model).where("doc_id = 90").first()["lang_pred"] == "und"
    assert len(language_id.letters_of("\U000302a9")) == 3


def test_repeated_documents_are_learned_alike_in_any_order(spark):
    docs = [(i, f"the cat and the dog {i}" if i % 2 else f"der Hund und die Katze {i}", "en" if i % 2 else "de") for i in range(60)]
    docs += [(i, f"quite another text of {i} and more of it {k}", lang) for i, _, lang in docs for k in range(2)] + [(3, None, "en")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    one, two = (language_id.train(frame(rows), F.lit(True)) for rows in (docs, docs[::-1]))
    assert one.predict("the dog of more") == two.predict("the dog of more") and np.array_equal(one.table, two.table)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    one, two = (toxicity.train(frame(rows), labels, F.lit(True)) for rows in (docs, docs[::-1]))
    assert [one.score(t) for t in ("the dog", "quite 10", None)] == [two.score(t) for t in ("the dog", "quite 10", None)]


@tables
def test_search_recall_at_the_shipped_factor(spark):
    vectors = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    x = np.array([r["embedding"] for r in vectors.orderBy("vec_id").collect()], float)
    near = lambda **how: {q: [v for _, v in sorted(found)] for q, found in _lists(vp_search.nearest(vectors, F.col("vec_id") % 20 == 0, **how)).items()}
    want = {q: [i for i in np.lexsort((np.arange(len(x)), -vp_search.dots(x[q : q + 1], x)[0])) if i != q][:20] for q in range(0, len(x), 20)}
    assert near(relax=1.0, shard_rows=100, block_rows=10, most_pivots=3, fan_in=2) == want
    for how in ({}, {"shard_rows": 100}):
        got = near(relax=vp_search.RELAX, **how)
        assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95


def _lists(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    return out


def test_search_of_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vp_search.nearest(none, F.col("vec_id") % 20 == 0).count() == 0
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (20, [3.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    assert _lists(vp_search.nearest(odd, F.col("vec_id") % 20 == 0)) == {0: [(1, 1), (2, 2)]}


def kneser_ney(texts, order):
    """Probability of a character after a context, counted out plainly."""
    counts = {order: Counter()}
    for t in texts:
        t = quality.padded(t)
        counts[order].update(t[i : i + order] for i in range(len(t) - order + 1))
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    size = len(counts[1])

    def discounts(m):
        c = [0] + [sum(1 for n in counts[m].values() if n == k) for k in (1, 2, 3, 4)]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        return [0.0] + [min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.05), k - 0.05) if c[k] else k * 0.5 for k in (1, 2, 3)]

    ds = {m: discounts(m) for m in counts}

    def p(gram):
        m = len(gram)
        if not m:
            return 1 / (size + 1)
        follow = {g: n for g, n in counts[m].items() if g[:-1] == gram[:-1]}
        if not follow:
            return p(gram[1:])
        total, d = sum(follow.values()), ds[m]
        rest = sum(d[min(n, 3)] for n in follow.values()) / total
        n = follow.get(gram, 0)
        if m == 1 and not n:
            return 0.5 / (size + 1)
        return (n - d[min(n, 3)] if n else 0) / total + rest * p(gram[1:])

    return p


@pytest.mark.parametrize("broadcast_keys", [0, quality.BROADCAST_KEYS])
def test_perplexity_equals_a_plain_model(spark, broadcast_keys):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["", None, "zzzz 12", "abc\nabc " * 40]
    docs = spark.createDataFrame([(i, t, "x" if i % 2 else None, "extra") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).alias("f")).collect()}
    models = [kneser_ney([texts[i] for i in range(30) if fold[i] == f], quality.ORDER) for f in (0, 1)]
    got = {r["doc_id"]: r for r in quality.judge(docs, trusted, 0.9, broadcast_keys).collect()}
    assert len(got) == len(texts) and got[40]["perplexity"] is None and not got[41]["kept"]
    for i, t in enumerate(texts):
        if t:
            p, ready = models[1 - fold[i]], quality.padded(t)
            logs = [np.log(p(ready[j : j + quality.ORDER])) for j in range(len(ready) - quality.ORDER + 1)]
            assert got[i]["perplexity"] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4)
    for lang in ("x", None):
        own = sorted(got[i]["perplexity"] for i in range(30) if got[i]["lang"] == lang)
        assert all(r["threshold"] == own[int(np.ceil(0.9 * len(own))) - 1] for r in got.values() if r["lang"] == lang)


def test_quality_of_languages_with_few_or_no_trusted_rows(spark):
    texts = [("the cat sat on the mat and saw the dog", "en")] * 30 + [("xq zzv kkj wwp", "en"), ("the cat sat on the mat", "fr"), ("zzv qqk jjx", "fr"), ("le chat", "de")]
    docs = spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(docs, docs.where("doc_id < 30 or doc_id = 33").select("doc_id")).collect()}
    assert got[31]["kept"] and not got[32]["kept"] and not got[30]["kept"] and got[31]["threshold"] is not None
    assert got[33]["kept"] and got[33]["threshold"] == got[33]["perplexity"]
    all_kept = quality.judge(docs, docs.limit(0).select("doc_id")).collect()
    assert all(r["kept"] and r["threshold"] is None for r in all_kept) and len(all_kept) == len(texts)
    assert quality.judge(docs.limit(0), docs.select("doc_id")).count() == 0


@tables
def test_toxicity_held_out_accuracy(spark):
    for folder, least in ((MEDIUM, 0.6), ("/root/testdata/sf0.1", 0.9)):
        labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic in (0, 1)").select("doc_id", "toxic")
        got = queries.QUERIES["op7_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").toPandas()
        found, false = got[got.toxic == 1].predicted.mean(), got[got.toxic == 0].predicted.mean()
        assert found >= least and false <= 0.03, (folder, found, false)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"n{chr(97 + i % 20)} {'idiot' if i % 2 else 'fine'} {chr(97 + i % 7)}m day", "z") for i in range(60)] + [(60, None, "z"), (61, "", "z"), (None, "idiot", "z"), (62, "fine " * 50_000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (61, None), (62, 7)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == 64 and got[60] == got[61] == min(got.values()) and got[62] < 0.3 and got[1] > 0.5 > got[0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_fixed_formats_are_learned_and_unseen_keys_found(spark):
    rng = random.Random(2)
    capitals, alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    words = ["".join(rng.choice(["sch", "lich", "ung", "keit", "tion", "the"]) for _ in range(rng.randrange(2, 7))) for _ in range(900)]
    texts = [f"id AKIA{key(16, capitals)} it" for _ in range(120)] + [f"token: {key(32, alnum)} it" for _ in range(120)] + [f"token: {key(300, alnum)} it" for _ in range(3)]
    labelled = len(texts)
    texts += [f"see ASIA{key(16, capitals)} here" for _ in range(50)] + [f"see {key(32, alnum)} here" for _ in range(50)] + [f"see {key(300, alnum)} here"]
    texts += [f"the {w} is 2024-01-{d % 30:02d} so" for d, w in enumerate(words)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secret_scan.learn(docs)
    assert all(len(a.red) > 16 for a in model.automata)
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs, model).collect()}
    hits = lambda a, b: sum("format:4:" in found[i] for i in range(a, b)) / (b - a)
    assert hits(labelled, labelled + 50) >= 0.9 and hits(labelled + 50, labelled + 101) >= 0.9
    assert not any("format" in found[i] for i in range(labelled + 101, len(texts)))


def test_many_keys_in_one_text_take_linear_time():
    rng = random.Random(9)
    text = " ".join("token=" + "".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(20_000))
    began = time.time()
    spans = secret_scan.base_spans(text)
    assert len(spans) == 40_000 and not secret_scan.other_runs(text, [(s[0], s[2]) for s in spans]) and time.time() - began < 5


@tables
def test_base_spans_against_plain_patterns(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_secret_scan"](spark, SMALL).collect()}
    kinds = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)"}
    least = {"assign": 8, "access": 16, "hex": 32}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        spans = sorted((m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, r["text"] or "", re.A) if len(m[1]) >= least[k])
        mine = got[r["doc_id"]]
        assert mine["base_sha256"] == hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()
        assert [mine["n_assign"], mine["n_access"], mine["n_hex"]] == [sum(s[1] == i for s in spans) for i in range(3)]
        assert set(s[2] for s in spans) <= set(mine["spans"].split(",")) | {""}


@tables
def test_license_columns_against_plain_words(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_license_scan"](spark, SMALL).collect()}
    rows_ = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert any(r["n_base"] for r in got.values())
    for doc, text in rows_:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        places = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = got[doc]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        labels = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(labels))
        for label, notice in license_scan.TEMPLATES:
            t, size = set(notice.split()), len(notice.split())
            blocks = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", line) for line in low.split("\n")]
            blocks += [w[i : i + size] for i in range(max(1, len(w) - size + 1))] if "\n" in text else []
            if any(len(t & set(b)) >= 0.8 * len(t) - 1e-9 for b in blocks):
                labels.add(label)
        assert r["labels"] == ",".join(sorted(labels))


@pytest.mark.parametrize("frequent", [1, 16])
def test_links_of_long_passages_and_salted_tokens(spark, frequent):
    rng = random.Random(10 + frequent)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(400)]
    texts = []
    for i in range(160):
        t = list(passage)
        for _ in range(rng.randrange(0, 40)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t + [word() for _ in range(rng.randrange(0, 60))]))
    texts += [" ".join(passage)] * 5 + ["", "  ", "a b", "A  b"]
    rows_ = [(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[0], "c"), (500, None, "c"), (3, texts[3], "c"), (3, "other text of three", "c")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, node string")
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    documents["doc_id"] = documents.doc_id.astype("Int64")
    con.execute("create table documents as select cast(doc_id as bigint) as doc_id, text from documents")
    want = con.execute(jaccard_join.OP10_SQL).df()
    got = jaccard_join.jaccard_components(docs, frequent=frequent, hot_rows=20).toPandas()
    assert rows(got) == rows(want)
    kept = jaccard_join.one_of_each_group(docs).toPandas()
    # One text of each component; texts without words all stay.
    component = {(None if i != i else int(i), t): c for i, t, c in zip(documents.doc_id.astype(float), documents.text, got_of(documents))}
    with_words = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.text) for r in kept.itertuples() if (r.text or "").strip()]
    chosen = [component[k] for k in with_words]
    assert len(chosen) == len(set(chosen)) == len({find for find, a in zip(got_of(documents), documents.text) if (a or "").strip()})
    assert len(kept) - len(with_words) == 3


def got_of(documents):
    """Component of each row by its shingle set, where a repeated doc_id has several."""
    out = []
    for t in documents.text:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    top = list(range(len(out)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(out):
        for j in range(i):
            if a and out[j] and 100 * len(a & out[j]) >= 80 * len(a | out[j]):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(out))]


def test_a_row_repeated_often_is_one_node(spark):
    text = " ".join(f"w{i}" for i in range(300))
    near = text.replace("w5 ", "x5 ")
    docs = spark.createDataFrame([(1, text), (2, near)], "doc_id long, text string").crossJoin(spark.range(8000)).drop("id")
    began = time.time()
    got = jaccard_join.jaccard_components(docs).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 8000), (2, 1, 8000)] and time.time() - began < 60
