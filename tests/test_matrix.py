import duckdb
import numpy as np
import pytest

from skein.matrix import build, svd
from skein.matrix.similarity import pairwise_cosine
from skein.plans import graphs, registry


def test_every_pair_has_its_cosine(spark):
    x = np.random.default_rng(1).standard_normal((150, 4))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(200, None), (201, [0.0] * 4), (202, [1.0]), (7, [1.0, 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["a"], r["b"], r["cosine"]) for r in pairwise_cosine(vectors, 40).collect()), key=repr)
    want = []
    for n, (a, u) in enumerate(rows[:-1]):
        for b, v in rows[:n]:
            if a != b:
                u1, v1 = (None if z is None else np.array(z, np.float32).astype(float) for z in (u, v))
                c = None if u1 is None or v1 is None or len(u1) != len(v1) or not u1.any() or not v1.any() else float(u1 @ v1 / np.sqrt((u1 @ u1) * (v1 @ v1)))
                want.append((min(a, b), max(a, b), c))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (r[0], r[1], r[2] or 0)), sorted(want, key=lambda r: (r[0], r[1], r[2] or 0))):
        assert g[:2] == w[:2] and (g[2] is w[2] is None or abs(g[2] - w[2]) < 1e-6)


def test_cosines_at_the_half_of_a_place_are_rounded_as_in_sql(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [3.0, 0.1, 0.7])]
    for i in range(1, 3000):  # at an angle to the first whose cosine is half a place, but for the last bits
        u, c = np.array(rows[0][1]) / np.linalg.norm(rows[0][1]), (int(rng.integers(0, 999_999)) + 0.5) / 1e6
        v = np.cross(u, rng.standard_normal(3))
        rows.append((i, ((c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)) * rng.random()).tolist()))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["b"]: r["cosine"] for r in pairwise_cosine(vectors).where("a = 0").collect()}
    frame = vectors.toPandas()  # noqa: F841
    sql = "select y.vec_id, round(list_cosine_similarity(x.embedding, y.embedding), 6) from frame x, frame y where x.vec_id = 0 and y.vec_id > 0"
    assert got == dict(duckdb.sql(sql).fetchall())


def test_the_report_covers_all_vectors(spark):
    folder = "/root/testdata/sf0.001"
    whole = registry.queries()["mat09_pairwise_cosine_all"](spark, folder)
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    assert whole.count() == n * (n - 1) // 2


def test_blocks_of_vectors_are_not_shuffled_by_pairs(spark):
    """what is compared is read from the kept blocks, so nothing but the result grows with the square of the rows."""
    rng = np.random.default_rng(3)
    rows = [(i % 290, [float(x) for x in v] if i % 7 else None) for i, v in enumerate(rng.integers(-3, 4, (300, 3)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = pairwise_cosine(vectors, 16, most=2)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    whole = pairwise_cosine(vectors, 1000)
    assert got.count() == whole.count() and got.exceptAll(whole).count() == 0
    assert got.where("a >= b").count() == 0


def test_files_of_pairs_hold_little_but_cosines(spark, tmp_path):
    """F6, F8: pairs come by a and then by b, so that both columns are runs and repetitions in a file."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(100_000)[:900], rng.integers(1, 3, (900, 3)))]
    pairwise_cosine(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 64, most=2).write.parquet(str(tmp_path / "pairs"))
    sizes, n = {"a": 0, "b": 0, "cosine": 0}, 0
    for file in (tmp_path / "pairs").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            n += meta.row_group(g).num_rows
            for c in range(3):
                sizes[meta.row_group(g).column(c).path_in_schema] += meta.row_group(g).column(c).total_compressed_size
    assert n == 900 * 899 // 2 and sizes["a"] < n / 3 and sizes["b"] < n / 3, sizes


@pytest.fixture(scope="module")
def world():
    """The matrix of the queries at sf0.01, its factors by numpy, and its labels."""
    cells = duckdb.sql("select l_partkey as a, l_returnflag as rel, 100000000 + l_suppkey as b, max(l_quantity) / 50 as score from '/root/testdata/sf0.01/lineitem.parquet' group by 1, 2, 3").df()
    rows, cols = sorted(cells.a.unique()), sorted(cells.b.unique())
    x = np.zeros((len(rows), len(cols)))
    np.add.at(x, (np.searchsorted(rows, cells.a), np.searchsorted(cols, cells.b)), cells.score)
    return cells, rows, cols, x, np.linalg.svd(x, full_matrices=False)


def test_queries_by_factors_against_numpy(spark, world, monkeypatch):
    _, rows, cols, x, (u, s, vt) = world
    folder, got = "/root/testdata/sf0.01", registry.queries()
    made = {}
    whole = svd.svd
    monkeypatch.setattr(svd, "svd", lambda cells, k, **how: made.setdefault(k, whole(cells, k, **how)))
    sigma = [r["sigma"] for r in got["mat05_singular_values"](spark, folder).orderBy("place").collect()]
    assert sigma == pytest.approx(s[:5].tolist(), abs=1e-5)
    w = u[:, :5] * s[:5]
    near = w @ w[rows.index(7)]
    similar = got["mat06_similar"](spark, folder).collect()
    assert [r["what"] for r in similar if r["kind"] == "similar"] == [str(rows[i]) for i in np.argsort(-near)[:10]]
    assert [r["value"] for r in similar if r["kind"] == "similar"] == pytest.approx(np.sort(near)[::-1][:10].tolist(), rel=1e-4)
    back = w @ vt[:5]
    assert [r["what"] for r in similar if r["kind"] == "predicted"] == [str(cols[i]) for i in np.argsort(-back[rows.index(7)])[:10]]
    of_both = w @ (w[rows.index(1)] + w[rows.index(2)])
    assert {r["row"]: r["similarity"] for r in got["mat07_category"](spark, folder).collect()} == pytest.approx({rows[i]: of_both[i] for i in np.argsort(-of_both)[:10]}, rel=1e-4)
    cell = lambda a, b: back[rows.index(a), cols.index(b)] if a in rows and b in cols else 0.0
    told = {(r["row"], r["col"]): r["value"] for r in got["mat08_evaluated"](spark, folder).collect()}
    assert told == pytest.approx({(1, "100000001"): cell(1, 100000001), (7, "100000002"): cell(7, 100000002), (-1, "100000001"): 0.0, (2, "nothing"): 0.0}, abs=1e-4)


def test_a_blend_divides_by_the_largest_singular_values(spark, world):
    cells, rows, cols, x, _ = world
    want = np.zeros_like(x)
    for rel in "AN":
        part = np.zeros_like(x)
        mine = cells[cells.rel == rel]
        np.add.at(part, (np.searchsorted(rows, mine.a), np.searchsorted(cols, mine.b)), mine.score)
        want += part / np.linalg.norm(part, 2)
    got = registry.queries()["mat04_blended"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == np.count_nonzero(want)
    assert max(abs(r["v"] - want[rows.index(r["row"]), cols.index(int(r["col"]))]) for r in got[::50]) < 2e-6


def test_close_values_are_told_apart(spark):
    """A spectrum with almost no gaps, of known values."""
    rng = np.random.default_rng(2)
    n, values = 60, np.r_[5.0, 4.0, np.linspace(3.0, 2.9, 58)]
    q, p = (np.linalg.qr(rng.standard_normal((n, n)))[0] for _ in range(2))
    x = q * values @ p.T
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(n)], "row long, col long, v double")
    f = svd.svd(cells, 4, blocks=5)
    assert f.sigma == pytest.approx(values[:4].tolist(), abs=1e-3) and f.sigma[:2] == pytest.approx([5.0, 4.0], abs=1e-9)
    u = np.array([r["vector"] for r in f.u.orderBy("row").collect()])
    assert np.abs(u.T @ u - np.eye(4)).max() < 1e-6
    assert svd.largest(cells) == pytest.approx(5.0, abs=1e-9) and svd.largest(cells.limit(0)) == 0.0


def test_few_columns_take_one_product_and_many_are_searched(spark, monkeypatch):
    """Noise, whose values lie close together, held either way round against numpy."""
    rng = np.random.default_rng(6)
    x = rng.random((90, 50)) * (rng.random((90, 50)) < 0.4)
    times, calls = svd._times, []
    monkeypatch.setattr(svd, "_times", lambda *a: (calls.append(a), times(*a))[1])
    for y, small in ((x, 3072), (x.T, 3072), (x.T, 0)):
        calls.clear()
        cells = spark.createDataFrame([(i, j, float(y[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(y)))], "row long, col long, v double")
        f = svd.svd(cells, 4, blocks=4, **({} if small else {"small": 0}))
        assert f.sigma == pytest.approx(np.linalg.svd(y)[1][:4].tolist(), abs=1e-6)
        u, v = (np.array([r["vector"] for r in side.orderBy(key).collect()]) for side, key in ((f.u, "row"), (f.v, "col")))
        assert np.abs(u.T @ y @ v - np.diag(f.sigma)).max() < 1e-5
        assert len(calls) <= 1 or not small


def _cells(spark, x):
    return spark.createDataFrame([(i, j, float(x[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(x)))], "row long, col long, v double")


def test_a_step_of_the_search_is_one_pass_over_packed_rows(spark, monkeypatch):
    """F1 to F5: no join or sum by key in a step, with all vectors, with restarts, and either way round."""
    rng = np.random.default_rng(7)
    x = rng.random((90, 50)) * (rng.random((90, 50)) < 0.4)
    x[:, 11] = x[7] = 0
    x[3] = rng.random(50)  # a row longer than a block
    times, calls = svd._times, []
    monkeypatch.setattr(svd, "_times", lambda *a: (calls.append(a), times(*a))[1])
    monkeypatch.setattr(svd, "_BLOCK", 20, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for y, how in ((x, {}), (x.T, {}), (x, {"held": 1800})):
            f = svd.svd(_cells(spark, y), 4, blocks=4, small=0, **how)
            assert not calls
            assert f.sigma == pytest.approx(np.linalg.svd(y)[1][:4].tolist(), abs=1e-6)
            u, v = ({r[key]: r["vector"] for r in side.collect()} for side, key in ((f.u, "row"), (f.v, "col")))
            assert sorted(u) == np.flatnonzero(y.any(axis=1)).tolist() and sorted(v) == np.flatnonzero(y.any(axis=0)).tolist()
            assert np.abs(np.array([u[i] for i in sorted(u)]).T @ y[sorted(u)][:, sorted(v)] @ np.array([v[i] for i in sorted(v)]) - np.diag(f.sigma)).max() < 1e-5
            assert all(max(c) >= -min(c) for c in zip(*u.values()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    f = svd.svd(_cells(spark, x), 4, blocks=4, small=0, held=0)  # vectors stay distributed
    assert calls and f.sigma == pytest.approx(np.linalg.svd(x)[1][:4].tolist(), abs=1e-6)


def test_products_of_columns_of_short_rows(spark):
    rng = np.random.default_rng(9)
    x = np.zeros((70, 60))
    for i in range(70):
        x[i, rng.choice(60, 60 if i == 5 else 3, replace=False)] = rng.standard_normal(60 if i == 5 else 3)
    more = spark.createDataFrame([(None, 1, 2.0), (1, None, 2.0), (1, 1, None), (69, 0, 1.5)], "row long, col long, v double")
    cells = _cells(spark, x).unionByName(more)
    x[69, 0] += 1.5  # cells of one place add up, those without a place count nothing
    assert svd.svd(cells, 6).sigma == pytest.approx(np.linalg.svd(x)[1][:6].tolist(), abs=1e-9)
    assert svd.singular_values(cells, 6) == svd.svd(cells, 6).sigma and svd.singular_values(cells.limit(0), 2) == []


def test_balanced_rows_and_columns(spark):
    rng = np.random.default_rng(4)
    cells = [(i, j, float(rng.random() + 0.1)) for i in range(12) for j in range(5) if (i * j) % 4 != 3] + [(99, 0, 0.0)]
    out = build.balanced(spark.createDataFrame(cells, "row long, col long, v double")).toPandas()
    rows, cols = ((out.v**2).groupby(out[k]).sum() for k in ("row", "col"))
    assert rows.drop(99).tolist() == pytest.approx([1.0] * 12, abs=1e-6) and rows[99] == 0 and cols.tolist() == pytest.approx([12 / 5] * 5, abs=1e-6)
    assert build.balanced(spark.createDataFrame([], "row long, col long, v double")).count() == 0


def test_documents_take_the_colours_of_their_words(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["red"], r["green"], r["blue"]) for r in registry.queries()["mat10_colours"](spark, folder).collect()}
    n = duckdb.sql(f"select count(*) from '{folder}/documents.parquet' where regexp_matches(text, '[A-Za-z]')").fetchall()[0][0]
    assert len(got) >= 0.95 * n and all(0 <= c <= 255 for rgb in got.values() for c in rgb) and len(set(got.values())) > 10
    f = svd.Factors(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "row string, vector array<double>"), None, [2.0, 3.0])
    rows = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "unknown", 5), (2, "unknown", 1), (3, "b", None)], "doc int, row string, v int")
    assert {r["doc"]: r["vector"] for r in svd.folded(f, rows, "doc").collect()} == {1: [4.0, 3.0], 3: [None, None]}


def test_colours_keep_words_by_feature_not_by_document(spark, monkeypatch):
    """what is kept grows with distinct words and features; words of documents are summed where they are read."""
    kept, written = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df: kept.append(df.columns) or written(df))
    assert registry.queries()["mat10_colours"](spark, "/root/testdata/sf0.001").count() > 0
    assert kept == [["row", "col", "n"]]
