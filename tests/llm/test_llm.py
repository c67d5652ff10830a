"""Training-data operators against brute force, round trips and held-out accuracy, with odd inputs."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat_format, decontamination, jaccard_join, language_id, license_scan, mixing, quality, secret_scan, toxicity, vp_search

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word", "en", "s", 4), (3, "word", "en", "s", 4), (4, "The cat sat on the mat. " * 4000, "en", None, 1), (None, "no id here at all", "en", "t", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x") for r in ODD], DOCS + ", score string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", score string")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("frequent", [1, 16])
def test_jaccard_join_against_all_pairs(spark, frequent):
    rng = random.Random(frequent)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(40)]
    base = [rng.choice(words) for _ in range(60)]
    texts = []
    for i in range(120):
        if i % 3 == 0:
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif i % 3 == 1:
            t = passage + [rng.choice(words) for _ in range(rng.randrange(0, 12))]
        else:
            t = [rng.choice(words) for _ in range(rng.randrange(0, 9))]
        texts.append(" ".join(t))
    sets = [shingles(t) for t in texts]
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs, frequent=frequent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_odd_rows(spark, odd, empty):
    n = len(ODD)
    assert jaccard_join.jaccard_components(odd).count() == n and jaccard_join.jaccard_components(empty).count() == 0
    model = language_id.train(odd, F.lit(True))
    assert language_id.annotate(odd, model).where("lang_pred = 'und'").count() == 2
    assert language_id.annotate(empty, language_id.train(empty, F.lit(True))).count() == 0
    assert mixing.mix(odd).count() == 2 * n and mixing.mix(empty).count() == 0
    assert license_scan.scan(odd).count() == n and license_scan.scan(empty).count() == 0
    secrets = secret_scan.learn(odd)
    assert secret_scan.scan(odd, secrets).count() == n
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, labels, F.lit(True))).count() == n
    assert quality.judge(odd, labels).count() == n and quality.judge(empty, labels).count() == 0
    items = spark.createDataFrame([(1, None), (2, "short")], "item_id long, text string")
    assert decontamination.matches(odd, items).count() == 0 and decontamination.clean(odd, items).count() == n


def test_vantage_points_are_exact_at_factor_one(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).round(1)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [float("nan")] * 8, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in vp_search.nearest(vectors, F.col("vec_id") % 20 == 0, k=5, relax=1.0, shard_rows=64, fan_in=2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    y = x.astype(np.float32).astype(float)
    for q in range(0, 300, 20):
        s = vp_search.dots(y[q : q + 1], y)[0]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q][k] for k in range(1, 6)] == want


def test_edits_are_found_up_to_the_bound():
    rng = random.Random(5)
    item = "".join(rng.choice("abcdefgh ") for _ in range(150)).strip()
    index = decontamination.Items([(7, item)], 8, 0.08)
    changed = item[:40] + "X" + item[41:90] + item[93:]
    assert [(h[0], h[3]) for h in index.find("before " * 9 + changed + " after" * 9)] == [(7, 4)]
    assert not index.find("something else " * 40)


@pytest.mark.parametrize("text", ["</s>", "<\\/s>", "[\\\\[INST]", "<<s>", "[[/INST]]", "a\\<b", "[TURN][TEXT]x[/TURN]", ""])
def test_escape_round_trip(spark, text):
    row = spark.range(1).select(chat_format.escape(F.lit(text)).alias("e")).select("e", chat_format.unescape(F.col("e")).alias("u")).first()
    assert row["u"] == text and "[INST]" not in row["e"] and "</s>" not in row["e"]


def test_best_branch_of_a_tree_is_formatted(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "thanks", 0.5)]
    tree = spark.createDataFrame(rows, "tree_id string, msg_id long, parent_id long, role string, text string, score double")
    (r,) = chat_format.format_trees(tree).collect()
    assert "good" in r["formatted"] and "bad" not in r["formatted"] and r["n_messages"] == 3
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["good"]


def test_segments_are_maximal():
    got = toxicity.segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0]))
    assert got == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = [decontamination.normal(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, DIR).collect()
    kept = {r["doc_id"]: r["text"] for r in out}
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    ids = sorted(kept)
    assert not any(any(i in decontamination.normal(t) for i in items) for t in kept.values())
    assert not any(secret_scan.base_spans(t) for t in kept.values())
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for n, a in enumerate(ids) for b in ids[:n])
    assert all(0 < r["taken"] <= r["size"] for r in out)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    english, german = "the cat and this dog with those of that are not from where they go".split(), "der Hund und die Katze nicht mit einem auf das sich auch nach wird".split()
    said = lambda words: " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, said(english if i % 2 else german), "en" if i % 2 else "de", rng.choice(["a", "b", None])) for i in range(80)]
    rows += [rows[3], rows[3], (3, said(english), "en", "a"), (None, said(english), "en", "a"), (None, None, None, None), (90, None, "en", "a"), (91, "", "en", "a"), (92, "12 34", None, "b")]
    rows += [(93, said(english) + " who was the first to fly over the pole " + said(english), "en", "b"), (94, said(english) + " password=k3J9xQ2mZ7pL0aT5 " + said(english), "en", "b")]
    more = ("n_chars", "score", "taken", "node", "lang_pred", "spans", "finish", "tokens")
    docs = spark.createDataFrame([(*r, *range(8)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} long" for c in more))
    spark.createDataFrame([(1, "Who was the FIRST to fly over the pole"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "source_mix" or docs.columns == columns
        counts.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    whole, single, clean, safe, mixed = counts
    assert not {90, 91, 92} & set(whole) and whole.count(3) == 4 and whole.count(None) == 1
    assert single.count(3) == 2 and len(single) == len(whole) - 2 and set(single) == set(whole)
    assert sorted(map(str, clean)) == sorted(map(str, (i for i in single if i != 93))) and sorted(map(str, safe)) == sorted(map(str, clean))
    assert set(mixed) <= set(safe) and mixed
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/secret_scan").collect()}
    assert "k3J9xQ2mZ7pL0aT5" not in texts[94]["text"] and texts[94]["n_chars"] == len(texts[94]["text"]) and texts[5]["n_chars"] == 0
    nothing = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_secrets_are_learned_from_all_texts(spark):
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    words = ["".join(rng.choice(["sch", "lich", "ung", "keit", "tion", "the"]) for _ in range(6)) for _ in range(900)]
    texts = [f"so the password={key(24)} it was" for _ in range(60)] + [f"the {w} is" for w in words]
    model = secret_scan.learn(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    # All runs count, not 400 of them: each is counted once as it starts.
    assert len(model.automata) == 1 and model.background.ones["^"] == len(words)


def test_secrets_of_any_characters_are_learned_and_found(spark):
    rng = random.Random(8)
    key = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    digits = "".join(rng.choice("0123456789") for _ in range(24))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    words = ["".join(rng.choice(["sch", "lich", "ung", "keit", "tion", "the"]) for _ in range(6)) for _ in range(900)]
    texts = [f"so the password={key(24)} it was" for _ in range(60)] + [f"the {w} is" for w in words]
    hidden, one_digit, rest = key(24), key(12) + "7" + key(11), "Q" + key(22) + "Q"
    texts += [f"see {hidden} here", f"see {one_digit} here", f"see {rest}{hexes} here", f"see {hexes}{rest} here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = secret_scan.learn(docs)
    assert len(model.automata) == 2
    # All runs count, not 400 of them: each is counted once as it starts.
    assert model.background.ones["^"] == len(words) + 4
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan(docs, model).collect()}
    assert found[960] == "format:4:28" and found[961] == "format:4:28"
    assert found[962] == "format:4:28,hex:28:60" and found[963] == "hex:4:36,format:36:60"
    assert not any(found[i] for i in range(60, 960))
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs, model).collect()}
    assert hidden not in clean[960] and rest not in clean[962] + clean[963]
    # A run of digits only is learned from and scored like any other.
    rows = [(i, f"x token={''.join(rng.choice('0123456789') for _ in range(24))} y") for i in range(60)] + [(99, f"see {digits} here")]
    rows += [(100 + i, f"the {w} is") for i, w in enumerate(words)]
    numbers = spark.createDataFrame(rows, "doc_id long, text string")
    model = secret_scan.learn(numbers)
    assert {r["doc_id"]: r["spans"] for r in secret_scan.scan(numbers, model).collect()}[99] == "format:4:28"


def test_wrapped_notices_are_found(spark):
    notices = {label: text.split() for label, text in license_scan.TEMPLATES}
    rows, want = [], {}
    for n, (label, text) in enumerate(license_scan.TEMPLATES):
        w = text.split()
        for m, wrap in enumerate((1, 2, 3)):
            lines = [" ".join(w[i : i + wrap]) for i in range(0, len(w), wrap)]
            want[10 * n + m] = label
            rows.append((10 * n + m, "Some prose before it\n * " + "\n * ".join(lines).title() + "\nand prose after\n" * 300))
    # Words of a notice far apart, or too few of them, are none; those of a long text with many notices are found.
    rows.append((900, ("\n" + "other words " * 20).join(notices["bsd"])))
    rows.append((901, "redistribution and use\nin source and binary\nof goods"))
    rows.append((902, "\nof the under in\n".join(["free of charge"] * 3000) + "\nreleased under\nthe mit license\n"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in license_scan.scan(docs).collect()}
    assert all(label in got[i] for i, label in want.items())
    assert got[900] == got[901] == [""] and got[902] == ["mit"]


def test_short_items_are_found(spark):
    items = spark.createDataFrame([(1, "Who  was Ada?"), (2, "rat"), (3, "what is the capital city"), (4, " "), (5, "name the rivers"), (6, "rat")], "item_id long, text string")
    texts = ["they ask who was\nada? and so on", "a separate crate", "a RAT.", "So: what is teh the capitol city of it", "Name the rivers", "rename the rivers", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["edits"]) for r in decontamination.matches(docs, items).collect()}
    assert got.keys() == {(0, 1), (2, 2), (2, 6), (4, 5)} and got[2, 2] == (2, 5, 0) and got[0, 1] == (9, 21, 0)
    near = spark.createDataFrame([(9, "so what is the capitol city of it")], "doc_id long, text string")
    assert [(r["item_id"], r["edits"]) for r in decontamination.matches(near, items).collect()] == [(3, 1)]
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, items).collect()) == [1, 3, 5, 6, 7]
