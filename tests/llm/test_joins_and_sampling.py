"""The name join, SimHash and importance resampling against brute force, and with odd inputs."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skein.llm import common, importance, name_join, queries, simhash

SMALL = "/root/testdata/sf0.001"


def changed(rng, name):
    name = list(name)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(name) + 1)
        name[i : i + rng.choice([0, 1, 2])] = rng.choice([[], ["x"], name[i : i + 2][::-1]])
    return "".join(name)


def test_distance_is_the_shortest_way_of_edits():
    letters = "abc"
    words = [""]
    for _ in range(4):
        words += [w + c for w in words for c in letters if len(w) < 4]
    words = sorted(set(words))

    def steps(w):
        for i in range(len(w) + 1):
            for c in letters:
                yield w[:i] + c + w[i:]
                yield w[:i] + c + w[i + 1 :]
            yield w[:i] + w[i + 1 :]
            yield w[:i] + w[i : i + 2][::-1] + w[i + 2 :]

    for start in ("ca", "abca", "aab", ""):
        far, edge = {start: 0}, [start]
        while edge:
            edge = [x for x in {s for w in edge for s in steps(w)} if len(x) <= 5 and x not in far and not far.update({x: far[w] + 1 for w in edge if x in steps(w)})]
        for w in words:
            assert name_join.distance(start, w, 9) == far[w] and name_join.distance(w, start, 1) == (far[w] if far[w] <= 1 else None)


@pytest.mark.parametrize("most", [1, 2])
def test_close_names_are_all_close_pairs(spark, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 20))) for _ in range(40)]
    v = sorted({n for n in base + [changed(rng, b) for b in base] if n})
    c = sorted({n for n in base + [changed(rng, b) for b in base * 3] if n})
    want = {(a, b, d) for a in v for b in c if (d := name_join.distance(a, b, most)) is not None}
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(r) for r in name_join.close_names(frame(v), frame(c), most).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {d for *_, d in got} == set(range(most + 1))


def test_names_with_nulls_repeats_and_clashing_columns(spark):
    vendors = spark.createDataFrame([(1, "Anna Berg", 7), (1, "Anna Berg", 8), (2, "Anna Breg", 7), (3, None, 1), (4, "", 1), (None, "Anna Berg", 0), (5, "x", 0)], "vendor_id long, name string, distance int")
    clients = spark.createDataFrame([(10, "Anna Berg"), (10, "Anna Berg"), (None, "Anna Berg"), (11, "Ana Berg"), (12, None), (13, ""), (14, "xy"), (15, "z" * 20_000)], "client_id long, name string")
    crc = lambda *ids: sum(zlib.crc32(str(i).encode()) for i in ids)
    got = {tuple(r) for r in name_join.linked_clients(vendors, clients).collect()}
    assert got == {(1, 0, 3, 10, crc(10, 10)), (1, 1, 1, 11, crc(11)), (None, 0, 3, 10, crc(10, 10)), (None, 1, 1, 11, crc(11)), (2, 1, 3, 10, crc(10, 10)), (5, 1, 1, 14, crc(14))}
    assert name_join.linked_clients(vendors, clients.limit(0)).count() == name_join.linked_clients(vendors.limit(0), clients).count() == 0
    told = {r["i"]: r["n"] for r in spark.range(40).select(F.col("id").alias("i"), name_join.misspelt(F.lit("abcdé"), F.col("id")).alias("n")).collect()}
    for i, n in told.items():
        h, at = zlib.crc32(str(i).encode()), zlib.crc32(str(i).encode()) % 4
        assert n == ("abcdé"[:at] + "abcdé"[at + 1] + "abcdé"[at] + "abcdé"[at + 2 :] if h % 2 == 0 else "abcdé")


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(codes, most):
    codes = sorted(set(codes))
    top = {c: c for c in codes}

    def find(c):
        while top[c] != c:
            c = top[c]
        return c

    x = np.array(codes, np.uint64)
    for i, c in enumerate(codes):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[:i]) <= most):
            a, b = find(c), find(codes[j])
            top[max(a, b)] = min(a, b)
    return {c: find(c) for c in codes}


def test_fingerprints_of_whole_texts(spark):
    texts = ["A b c D e f", "one", "", None, "x\x0by\tz  w É", "w " * 30_000, "long" * 400_000 + " tail of it all"]
    got = simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["code"] % (1 << 64) for r in got} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    words = [f"w{i % 97}" for i in range(9000)]
    assert len(list(simhash.pieces(" ".join(words).encode(), 1000))) > 20
    assert simhash.fingerprint(b" ".join(w.encode() for w in words)) == plain_fingerprint(" ".join(words))


def test_index_finds_the_pairs_of_a_node():
    rng = np.random.default_rng(3)
    for n, bits in ((1, 8), (60, 6), (700, 12), (3000, 64)):
        codes = np.unique(rng.integers(0, 1 << 63, n, np.uint64) & np.uint64((1 << bits) - 1))
        node = np.sort(rng.integers(0, 3, len(codes)))
        order = np.lexsort((simhash.gray_rank(codes), node))
        codes = codes[order]
        want = {(i, j) for i in range(len(codes)) for j in np.flatnonzero((node == node[i]) & (np.bitwise_count(codes ^ codes[i]) <= 4)).tolist() if j > i} if n < 3000 else set()
        got = {(int(i), int(j)) for a, b in simhash.linked_pairs(codes, node, 4) for i, j in zip(a, b)}
        assert got == want
    ranks = simhash.gray_rank(np.array([i ^ i >> 1 for i in range(64)], np.uint64))
    assert ranks.tolist() == list(range(64))


@pytest.mark.parametrize("how", [{}, {"node_rows": 40}, {"node_rows": 12, "deepest": 2}, {"node_rows": 7, "deepest": 1}])
def test_links_tie_what_all_pairs_tie(spark, how):
    rng = random.Random(5)
    codes = [rng.getrandbits(64) for _ in range(150)]
    dense = [codes[0] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for _ in range(300)]
    near = [c ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for c in codes]
    codes = {0, *codes, *dense, *near} - {c for c in dense if c >= 1 << 64}
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    top = {r["node"] % (1 << 64): r["label"] % (1 << 64) for r in common.connected(simhash.links(frame, **how)).collect()}
    groups = lambda of: {frozenset(c for c in codes if of(c) == t) for t in {of(c) for c in codes}}
    assert groups(lambda c: top.get(c, c)) == groups(components(codes, 4).get)


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.lit(1).alias("component_id"))
    docs = docs.unionByName(spark.createDataFrame([(900, None, 0), (901, "", 0), (None, "", 0), (None, None, 0), (902, "only once", 0), (902, "other words", 0)], docs.schema))
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    top = components([c for _, c in rows], 4)
    first = {}
    for i, c in rows:
        if i is not None:
            first[top[c]] = min(first.get(top[c], i), i)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{c:016x}", first.get(top[c])) for i, c in rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_star_of_many_links_is_one_component(spark):
    pairs = [(0, i) for i in range(1, 500)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in common.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(500), 0), **dict.fromkeys(range(1000, 1101), 1000)}
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ring_of_states_is_every_run_of_words():
    text = "The cat, the É-cat; 12 x" + " wörd" * 50
    words = importance.re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in text))
    for n in (1, 3, 5):
        want = Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % 1000 for k in range(1, n + 1) for i in range(len(words) - k + 1))
        count, found = importance.ring(text.encode(), n, 1000)
        assert count == len(words) and Counter(found.tolist()) == want
    assert [w for part in importance.words_of(text.encode(), 3) for w in part] == [w.encode() for w in words]


def test_resampling_counted_out_plainly(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["Gold", "tin", "ore", "x1", "é"]) for _ in range(rng.randrange(0, 60)))) for i in range(150)] + [(5, "tin " * 25)] * 4 + [(None, "gold " * 30), (7, None), (8, "")]
    wanted = ["gold ore gold", None, "tin"]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rank int")
    got = importance.resample(frame, spark.createDataFrame([(t,) for t in wanted], "text string"), percent=10, buckets=500).collect()

    def buckets(text):
        words = (text or "").lower().split()
        return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 500 for k in (1, 2, 3) for i in range(len(words) - k + 1)], len(words)

    s, t = Counter(b for _, x in docs for b in buckets(x)[0]), Counter(b for x in wanted for b in buckets(x)[0])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 500) / ((s[b] + 1) * (t.total() + 500)))) for b in range(500)]
    rows = []
    for i, x in docs:
        b, words = buckets(x)
        weight = sum(gain[k] for k in b)
        rows.append((i, len(b), weight, weight + importance.noise(i, 42), words))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    most = 10 * len(able) // 100
    want = Counter((*r[:4], k if k <= most else None) for k, r in enumerate(able, 1)) + Counter((*r[:4], None) for r in rows if r[4] < 20)
    assert Counter(tuple(r) for r in got) == want and most > 5
    empty = importance.resample(frame.limit(0), spark.createDataFrame([], "text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_new_queries_take_the_tables_whole(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert queries.QUERIES["op12_simhash"](spark, SMALL).count() == queries.QUERIES["op13_importance"](spark, SMALL).count() == n
