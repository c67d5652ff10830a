"""Truncated SVD of sparse matrices in long form, and what is read from the factors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import dealt, hinted, kept, written


@dataclass
class Factors:
    """u (row, vector), v (col, vector) as DataFrames with array<double>, and the singular values."""

    u: DataFrame
    v: DataFrame
    sigma: list[float]

    @property
    def weighted(self) -> DataFrame:
        """row, vector: u times the singular values."""
        return self.u.select("row", _scaled("vector", self.sigma).alias("vector"))


def _scaled(vector: str, by: list[float]):
    return F.zip_with(F.col(vector), F.array(*map(F.lit, by)), lambda x, s: x * s)


def _times(cells: DataFrame, of: str, to: str, vectors: DataFrame, k: int) -> DataFrame:
    """The sparse matrix times a thin one: for each ``of`` the sum of v times the vector of its ``to``."""
    met = cells.join(hinted(vectors, 200_000), to)
    sums = [F.sum(F.col("v") * F.element_at("vector", i + 1)).alias(f"_{i}") for i in range(k)]
    return met.groupBy(of).agg(*sums).select(of, F.array(*[F.col(f"_{i}") for i in range(k)]).alias("vector"))


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as rows."""
    return np.asarray(batch.column("vector").flatten(), float).reshape(batch.num_rows, -1)


def _gram(vectors: DataFrame, k: int) -> np.ndarray:
    """The k x k sums of products of components: partial ones by task, summed up by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                x = _stacked(batch)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["place", "s"])

    out = np.zeros(k * k)
    for r in vectors.select("vector").mapInArrow(run, "place long, s double").groupBy("place").agg(F.sum("s").alias("s")).collect():
        out[r["place"]] = r["s"]
    return out.reshape(k, k)


def _applied(vectors: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """Each vector times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = _stacked(batch) @ by
                ends = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, made.ravel())], [key, "vector"])

    return vectors.select(key, "vector").mapInArrow(run, f"`{key}` {vectors.schema[key].dataType.simpleString()}, vector array<double>")


def _beside(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Vectors of both set side by side; where ``right`` has none, zeros of its width."""
    none = F.array(*[F.lit(0.0)] * width)
    met = left.join(right.select(key, F.col("vector").alias("_more")), key, "left")
    return met.select(key, F.concat("vector", F.coalesce("_more", none)).alias("vector"))


def _orthonormal(vectors: DataFrame, key: str, k: int) -> tuple[DataFrame, int]:
    values, basis = np.linalg.eigh(_gram(vectors, k))
    keep = values > max(values.max(initial=0.0), 1e-300) * 1e-12
    return kept(_applied(vectors, key, basis[:, keep] / np.sqrt(values[keep]))), int(keep.sum())


@dataclass
class _Packed:
    """A sparse matrix in blocks of whole rows (``rows``, and as bytes: ``sizes`` of rows, and ``at``, the column's number,
    and ``v`` of each cell), kept once, by ``tasks`` tasks, and the columns in the order of their numbers."""

    blocks: DataFrame
    tasks: int
    columns: pa.Array


#: Cells of a block of packed rows, and of all that a task reads, about.
_BLOCK, _TASK = 131_072, 4_000_000


def _packed(cells: DataFrame, columns: pa.Array) -> _Packed:
    """Cells (row, col, v), each row's in one block."""
    spark, key = cells.sparkSession, cells.schema["row"].dataType.simpleString()
    places = spark.createDataFrame(pa.table({"col": columns, "at": np.arange(len(columns), dtype=np.int32)}))
    placed = dealt(cells, ["row"]).join(F.broadcast(places), "col").groupBy("row", "at").agg(F.sum("v").alias("v")).sortWithinPartitions("row")

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        runs = pa.compute.run_end_encode(whole.column("row").combine_chunks(), pa.int32())
        rows = runs.values
        parts = np.diff(runs.run_ends.to_numpy(), prepend=0).astype(np.int32), whole.column("at").to_numpy(), whole.column("v").to_numpy()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)] + [pa.array([p.tobytes()], pa.binary()) for p in parts], ["rows", "sizes", "at", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= _BLOCK:  # ends where a row does
                row = batch.column("row")
                new = np.flatnonzero(pa.compute.not_equal(row, waiting[-1].column("row")[-1]).to_numpy(zero_copy_only=False))
                if len(new):
                    yield block([*waiting, batch.slice(0, new[0])])
                    batch, waiting, n = batch.slice(new[0]), [], 0
            waiting.append(batch)
            n += batch.num_rows
        if waiting:
            yield block(waiting)

    blocks = kept(placed.select("row", "at", "v").mapInArrow(run, f"rows array<{key}>, sizes binary, at binary, v binary"))
    # As few tasks as keep all cores busy: each has sums over all columns.
    known, n = blocks.rdd.getNumPartitions(), blocks.agg(F.sum(F.length("v")) / 8).first()[0]
    tasks = min(known, max(spark.sparkContext.defaultParallelism, int(n or 0) // _TASK))
    return _Packed(blocks.coalesce(tasks), tasks, columns)


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """rows, the number of each cell's row in the block, the number of its column and its value, of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, at, v = (np.frombuffer(batch.column(name)[i].as_py(), kind) for name, kind in (("sizes", np.int32), ("at", np.int32), ("v", float)))
            yield batch.column("rows").slice(i, 1).flatten(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), at, v


def _summed(packed: _Packed, total, size: int, at_once: int = 1 << 22) -> np.ndarray:
    """The sum over tasks of what ``total`` makes of a task's blocks, ``size`` numbers. Many are added up in slices by
    tasks first, so that the driver gets about ``size`` of them."""
    width = 8192

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = total(batches)
        if numbers is not None:
            for start in range(0, size, width):
                yield pa.RecordBatch.from_arrays([pa.array([start // width], pa.int32()), pa.array([numbers[start : start + width].tobytes()], pa.binary())], ["place", "numbers"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, numbers in zip(batch.column("place").to_numpy(), batch.column("numbers")):
                more = np.frombuffer(numbers.as_py())
                out[place] = out[place] + more if place in out else more
        for place, numbers in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([numbers.tobytes()], pa.binary())], ["place", "numbers"])

    made = packed.blocks.mapInArrow(run, "place int, numbers binary")
    if packed.tasks * size > at_once:
        made = made.repartition(8, "place").mapInArrow(added, "place int, numbers binary")
    out = np.zeros(size)
    for batch in made.toArrow().to_batches():
        for place, numbers in zip(batch.column("place").to_numpy(), batch.column("numbers")):
            part = out[place * width : place * width + width]
            part += np.frombuffer(numbers.as_py())
    return out


def _small(packed: _Packed) -> np.ndarray:
    """The products of all pairs of columns, for a short list of them."""
    n = len(packed.columns)

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for _, row, at, v in _cells_of(batches):
            out = np.zeros((n, n)) if out is None else out
            sizes = np.bincount(row)
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):  # about a million pairs at a time, a row at least
                last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:].astype(np.int64) ** 2), 1 << 20, "right")) + first)
                last = min(last, first + 512)
                some, a, b = sizes[first:last], ends[first] - sizes[first], ends[last - 1]
                pairs = int((some.astype(np.int64) ** 2).sum())
                if pairs * 150 > len(some) * n * n:
                    x = np.zeros((len(some), n))
                    x[row[a:b] - first, at[a:b]] = v[a:b]
                    out += x.T @ x
                else:
                    each = np.repeat(some, some)  # cells of each cell's row
                    left = np.repeat(np.arange(a, b), each)
                    right = np.arange(pairs) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(ends[first:last] - some, some), each)
                    np.add.at(out.reshape(-1), at[left].astype(np.int64) * n + at[right], v[left] * v[right])
                first = last
        return None if out is None else out.reshape(-1)

    few = min(packed.tasks, 64)  # each task gives n x n numbers
    return _summed(_Packed(packed.blocks.coalesce(few), few, packed.columns), total, n * n).reshape(n, n)


def _image(packed: _Packed, block: np.ndarray) -> np.ndarray:
    """What the matrix and its transpose make of a block of vectors (its rows) over the columns: one pass over the cells."""
    width, n = block.shape
    sent = packed.blocks.sparkSession.sparkContext.broadcast(block)

    def total(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        vectors, out = sent.value, None
        for rows, row, at, v in _cells_of(batches):
            out = np.zeros((width, n)) if out is None else out
            for i in range(width):
                out[i] += np.bincount(at, v * np.bincount(row, v * vectors[i][at], len(rows))[row], n)
        return None if out is None else out.reshape(-1)

    made = _summed(packed, total, width * n).reshape(width, n)
    sent.destroy()
    return made


def _other_side(packed: _Packed, v: np.ndarray) -> DataFrame:
    """row, vector: the matrix times vectors over the columns."""
    width, sent = v.shape[1], packed.blocks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(v.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, row, at, x in _cells_of(batches):
            made = np.stack([np.bincount(row, x * vector[at], len(rows)) for vector in sent.value], axis=1)
            ends = np.arange(len(made) + 1, dtype=np.int32) * width
            for start in range(0, len(made), 10_000):
                yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(ends, made.ravel())], ["row", "vector"]).slice(start, 10_000)

    return packed.blocks.mapInArrow(run, f"row {packed.blocks.schema['rows'].dataType.elementType.simpleString()}, vector array<double>")


def _orthogonal(block: np.ndarray, to: np.ndarray, scale: float) -> np.ndarray:
    """Orthonormal vectors that span the rows of a block, without what lies in the span of ``to`` or under 1e-13 of ``scale``."""
    for least in (1e-13 * scale, 0.5):  # what is left of the first turn has length 1, but for rounding
        block = block - (block @ to.T) @ to
        _, sizes, block = np.linalg.svd(block, full_matrices=False)
        block = block[sizes > least]
    return block


def _found(packed: _Packed, k: int, tolerance: float, extra: int, most: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest squared singular values, and vectors of them over the columns, by the block Krylov search of
    ``svd`` with at most ``most`` vectors, as rows, held in the driver."""
    n = len(packed.columns)
    q = np.empty((min(most, n), n))
    block = _orthogonal(np.random.default_rng(1).uniform(-1, 1, (min(k + extra, n), n)), q[:0], 1.0)
    m, known = len(block), np.zeros((0, 0))
    q[:m] = block
    for _ in range(steps):
        width, image = len(block), _image(packed, block)
        across = q[:m] @ image.T
        beyond = image - across.T @ q[:m]
        grown = np.zeros((m, m))
        grown[: len(known), : len(known)] = known
        grown[:, m - width :], grown[m - width :, :] = across, across.T
        known = grown
        known[m - width :, m - width :] = (across[m - width :] + across[m - width :].T) / 2
        values, basis = np.linalg.eigh(known)
        values, basis = np.maximum(values[::-1], 0.0), basis[:, ::-1]
        wanted = [i for i in range(min(k, m)) if values[i] > 1e-12 * max(values[0], 1e-300)]
        apart = np.linalg.norm(basis[m - width :, wanted].T @ beyond, axis=1)
        block = _orthogonal(beyond, q[:m], max(values[0], 1e-300))
        if (apart <= tolerance * values[0]).all() or not len(block):
            return values[wanted], (basis[:, wanted].T @ q[:m]).T
        if m + len(block) > len(q):
            # The best vectors and the newest block go on: what is known of the former is their values, and what ties
            # them to the latter comes with its image.
            m = max(min(k + extra, m), len(q) // 2 - len(block))
            q[:m] = basis[:, :m].T @ q[: len(basis)]
            known = np.diag(values[:m])
        q[m : m + len(block)] = block
        m += len(block)
    raise RuntimeError(f"residuals of {apart.max() / values[0]:.2g} after {steps} steps")


def _solved(cells: DataFrame, k: int, tolerance: float, extra: int, blocks: int, restarts: int, small: int, held: int) -> tuple[np.ndarray, np.ndarray | DataFrame, _Packed | DataFrame, bool]:
    """The singular values, vectors over the shorter side, the matrix in the form that they were found by, and whether it
    was turned."""
    cells = written(cells.select("row", "col", F.col("v").cast("double").alias("v")).where("v <> 0 and row is not null and col is not null"))
    n_rows, n_cols = cells.agg(F.count_distinct("row"), F.count_distinct("col")).first()
    turned = n_rows < n_cols
    if turned:
        cells = cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
    n = min(n_rows, n_cols)
    most = min(held // max(n, 1), 40 * (k + extra))
    if n > small and most < max(3, blocks // 2) * (k + extra):
        # Dealt by row once, so that a multiplication by the matrix and its transpose shuffles only sums by column.
        cells = kept(dealt(cells, ["row"]))
        values, v = _searched(cells, k, tolerance, extra, blocks, restarts)
        return np.sqrt(values), v, cells, turned
    if not n:
        return np.zeros(0), np.zeros((0, 0)), _Packed(cells, 0, pa.array([], pa.int64())), turned
    packed = _packed(cells, cells.select("col").distinct().orderBy("col").toArrow().column("col").combine_chunks())
    if n > small:
        values, v = _found(packed, k, tolerance, extra, most, blocks * (restarts + 1))
    else:
        values, basis = np.linalg.eigh(_small(packed))
        best = [i for i in np.argsort(-values)[:k] if values[i] > 1e-12 * max(values[-1], 1e-300)]
        values, v = values[best], basis[:, best]
    return np.sqrt(values), v, packed, turned


def svd(cells: DataFrame, k: int, tolerance: float = 1e-6, extra: int = 8, blocks: int = 8, restarts: int = 25, small: int = 3072, held: int = 20_000_000) -> Factors:
    """The k greatest singular values and vectors of cells (row, col, v).

    A matrix of at most ``small`` rows or columns is one sum of products of these, ``small`` by ``small`` numbers that
    come to the driver, and its eigenvectors. A larger one is searched: from a block of k + ``extra`` vectors told by
    chance, each step of a block Krylov search multiplies the newest block by the matrix and its transpose, takes out what
    the blocks before have (twice), and finds the best values and vectors in the span of all blocks (Rayleigh-Ritz). It
    ends when every wanted vector's residual (what the matrix and its transpose make of it, less its squared value times
    it) is within ``tolerance`` of the greatest squared value; when there are too many vectors (``blocks`` blocks, where
    they are distributed) the search starts again from the best. An end short of that, after ``restarts`` times as many
    steps, is an error.

    The matrix stays distributed, in packed blocks of rows, and a step is one pass over them. The driver holds vectors of
    the shorter side only, at most ``held`` numbers; where that is less than half of ``blocks`` blocks, these stay
    distributed as well, and only sums of products of components come to the driver, so rows and columns may be any number. Each vector's greatest component by size is positive. Cells of null or zero value, or without row or column,
    count nothing, cells of one place add up. Fewer come back if the rank is less.
    """
    row, col = (cells.schema[c].dataType.simpleString() for c in ("row", "col"))
    sigma, v, by, turned = _solved(cells, k, tolerance, extra, blocks, restarts, small, held)
    if not len(sigma):
        none = lambda key, kind: cells.sparkSession.createDataFrame([], f"{key} {kind}, vector array<double>")
        return Factors(none("row", row), none("col", col), [])
    if isinstance(by, _Packed):
        u = kept(_other_side(by, v / sigma))
        ends = np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]
        v = cells.sparkSession.createDataFrame(pa.table({"col": by.columns, "vector": pa.ListArray.from_arrays(ends, v.ravel())}))
    else:
        u = kept(_applied(_times(by, "row", "col", v, len(sigma)), "row", np.diag(1 / sigma)))
    if turned:
        u, v = v.select(F.col("col").alias("row"), "vector"), u.select(F.col("row").alias("col"), "vector")
    ends = u.agg(*[f(F.element_at("vector", i + 1)).alias(f"{n}{i}") for i in range(len(sigma)) for n, f in (("x", F.max), ("n", F.min))]).first()
    sign = [1.0 if abs(ends[f"x{i}"]) >= abs(ends[f"n{i}"]) else -1.0 for i in range(len(sigma))]
    return Factors(u.select("row", _scaled("vector", sign).alias("vector")), v.select("col", _scaled("vector", sign).alias("vector")), sigma.tolist())


def singular_values(cells: DataFrame, k: int, tolerance: float = 1e-6, extra: int = 8, blocks: int = 8, restarts: int = 25, small: int = 3072, held: int = 20_000_000) -> list[float]:
    """The k greatest singular values alone: as of ``svd``."""
    return _solved(cells, k, tolerance, extra, blocks, restarts, small, held)[0].tolist()


def _searched(cells: DataFrame, k: int, tolerance: float, extra: int, blocks: int, restarts: int) -> tuple[np.ndarray, DataFrame]:
    """The k greatest squared singular values, and col, vector of them: see ``svd``."""
    start = F.array(*[F.lit(1.0) - F.pmod(F.xxhash64("col", F.lit(i)), F.lit(1 << 20)) / float(1 << 19) for i in range(k + extra)])
    block, width = _orthonormal(cells.select("col").distinct().select("col", start.alias("vector")), "col", k + extra)
    most, begun = blocks * width, 0
    q, m, known = block, width, np.zeros((0, 0))  # known: what the product of transpose and matrix is in the span of q
    while True:
        image = kept(_beside(q, _times(cells, "col", "row", _times(cells, "row", "col", block, width), width), "col", width))
        gram = _gram(image, m + width)
        across, own = gram[:m, m:], gram[m:, m:]
        grown = np.zeros((m, m))
        grown[: len(known), : len(known)] = known
        grown[:, m - width :], grown[m - width :, :] = across, across.T
        known = grown
        known[m - width :, m - width :] = (across[m - width :] + across[m - width :].T) / 2
        values, basis = np.linalg.eigh(known)
        order = np.argsort(-values)
        values, basis = np.maximum(values[order], 0.0), basis[:, order]
        wanted = [i for i in range(min(k, m)) if values[i] > 1e-12 * max(values[0], 1e-300)]
        beyond = own - across.T @ across  # what of the image stands outside the span
        last = basis[m - width : m, wanted]
        apart = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", last, beyond, last), 0.0))
        scale, turn = np.linalg.eigh((beyond + beyond.T) / 2)
        fresh = scale > 1e-12 * max(own.trace(), 1e-300)
        if (apart <= tolerance * values[0]).all() or not fresh.any():
            return values[wanted], kept(_applied(q, "col", basis[:, wanted]))
        by = turn[:, fresh] / np.sqrt(scale[fresh])
        block = kept(_applied(image, "col", np.vstack([-across @ by, by])))
        gram = _gram(_beside(q, block, "col", by.shape[1]), m + by.shape[1])
        again = gram[:m, m:]
        scale, turn = np.linalg.eigh(gram[m:, m:] - again.T @ again)
        by = turn / np.sqrt(np.maximum(scale, 1e-300))
        block = _applied(_beside(q, block, "col", by.shape[1]), "col", np.vstack([-again @ by, by]))
        if m + by.shape[1] > most:
            begun += 1
            if begun > restarts:
                raise RuntimeError(f"residuals of {apart.max() / values[0]:.2g} after {restarts} restarts")
            # The best vectors and the newest block go on: what is known of the former is their values, and what ties
            # them to the latter comes with its image.
            block = kept(block)
            keep = basis[:, : k + extra]
            q, m, known = kept(_applied(q, "col", keep)), keep.shape[1], np.diag(values[: k + extra])
        else:
            block = kept(block)
        width = by.shape[1]
        q, m = kept(_beside(q, block, "col", width)), m + width


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similar(factors: Factors, row, n: int = 10) -> DataFrame:
    """row, similarity: the rows whose weighted vectors have the greatest product with that of ``row``."""
    w = factors.weighted
    own = w.where(F.col("row") == row).select(F.col("vector").alias("_own"))
    return w.crossJoin(F.broadcast(own)).select("row", dot("vector", "_own").alias("similarity")).orderBy(F.desc("similarity"), "row").limit(n)


def predicted(factors: Factors, row, n: int = 10) -> DataFrame:
    """col, value: the columns of greatest reconstructed value for a row."""
    own = factors.weighted.where(F.col("row") == row).select(F.col("vector").alias("_own"))
    return factors.v.crossJoin(F.broadcast(own)).select("col", dot("vector", "_own").alias("value")).orderBy(F.desc("value"), "col").limit(n)


def category(factors: Factors, rows: list, n: int = 10) -> DataFrame:
    """row, similarity to the sum of the weighted vectors of ``rows``; unknown ones are ignored, none known is an error."""
    w = factors.weighted.where(F.col("row").isin(rows))
    k = len(factors.sigma)
    sums = w.agg(F.count("*").alias("n"), F.array(*[F.sum(F.element_at("vector", i + 1)) for i in range(k)]).alias("_own"))
    if not sums.first()["n"]:
        raise KeyError(f"none of {rows!r} is known")
    return factors.weighted.crossJoin(F.broadcast(sums.select("_own"))).select("row", dot("vector", "_own").alias("similarity")).orderBy(F.desc("similarity"), "row").limit(n)


def evaluated(factors: Factors, cells: DataFrame) -> DataFrame:
    """cells (row, col) with value: the reconstructed one, 0 where row or column is unknown."""
    u = factors.weighted.select("row", F.col("vector").alias("_u"))
    v = factors.v.select("col", F.col("vector").alias("_v"))
    met = cells.join(u, "row", "left").join(v, "col", "left")
    return met.select(*cells.columns, F.coalesce(dot("_u", "_v"), F.lit(0.0)).alias("value"))


def largest(cells: DataFrame, tolerance: float = 1e-9) -> float:
    """The largest singular value of cells (row, col, v); 0 without any."""
    return next(iter(singular_values(cells, 1, tolerance=tolerance, extra=2)), 0.0)


def folded(factors: Factors, rows: DataFrame, key: str) -> DataFrame:
    """key and vector of new rows (key, row, v): the sum of v times the weighted vectors of known rows, as of a category
    of their own; a key none of whose rows is known has none."""
    k = len(factors.sigma)
    met = rows.select(key, "row", F.col("v").cast("double").alias("v")).join(hinted(factors.weighted, 200_000), "row")
    sums = met.groupBy(key).agg(*[F.sum(F.col("v") * F.element_at("vector", i + 1)).alias(f"_{i}") for i in range(k)])
    return sums.select(key, F.array(*[F.col(f"_{i}") for i in range(k)]).alias("vector"))


__all__ = ["Factors", "category", "evaluated", "folded", "largest", "predicted", "similar", "singular_values", "svd"]
