"""Shared helpers: reading tables, cutting lineage, size-checked broadcasts, running sums, text hashing.

Arrow batches hold at most ``spark.sql.execution.arrow.maxBytesPerBatch`` of texts; ``small_batches`` lowers that while
jobs run inside it.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys up to this many rows (8-byte keys: about 32 MB) may be broadcast; more are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without one (tests) gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so that lineage ends here."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes while jobs are run inside; the session's own values come back."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect garbage. Its heap gives back what it grew by, and the shuffle files, checkpoints and
    broadcasts that nothing refers to any more go from the disks; they stay until then, however many come after."""
    gc.collect()
    spark._jvm.System.gc()


def shrink_heaps(spark: SparkSession) -> None:
    """Have the driver and the executors collect garbage. A heap stays as large as it once grew until then; what it gives
    back is there for the Python workers of the next stage."""
    tidy(spark)
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def hinted(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` with a broadcast hint if it has at most ``most`` rows; as it is, so joined by shuffle, otherwise."""
    return F.broadcast(keys) if keys.count() <= most else keys


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join of ``df`` with narrow ``keys``: broadcast when the count is small, else shuffled."""
    return df.join(hinted(keys), on, how)


def connected(links: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) for each node of ``links`` (a, b: long), by alternating stars.

    As rounds of sums by node and plain joins, so that a node of very many links is summed up before it is shuffled and
    can be split where it is joined. Rounds grow with the logarithm of the number of nodes.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = cut(large)
        small = large.join(least(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v")).distinct()


def slices(frames: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """The frames in parts of at most ``rows`` rows, so that what is made of whole texts at a time stays small."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` in ``order`` over all its partitions, with ``before_<name>``: the sum of each of ``sums`` (no nulls) over
    all rows before a row.

    Rows are range-sorted into partitions and kept; partition totals, one row each, give each partition its start, and
    running sums within a partition are taken batch by batch. So no task holds more than its range.
    """
    kept = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    totals = kept.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums]).collect()
    at, starts = dict.fromkeys(sums, 0), {}
    for r in sorted(totals, key=lambda r: r["_part"]):
        starts[r["_part"]] = dict(at)
        at = {c: at[c] + r[c] for c in sums}
    kinds = {c: kept.schema[c].dataType.simpleString() for c in sums}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if reached is None:
                reached = dict(starts[batch.column(batch.schema.get_field_index("_part"))[0].as_py()])
            for c in sums:
                values = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                total = np.cumsum(values)
                batch = batch.append_column("before_" + c, pa.array(reached[c] + total - values))
                reached[c] += total[-1].item()
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(add, schema + "".join(f", before_{c} {kinds[c]}" for c in sums)).drop("_part")


_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**j and P**-j modulo 2**64 for j < n."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        n = max(1 << 15, 1 << (n - 1).bit_length())
        for key, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            out, step, size = np.ones(n, np.uint64), base, 1
            while size < n:
                out[size : 2 * size] = out[:size] * np.uint64(step)
                step, size = step * step & _M64, 2 * size
            _powers[key] = out
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    turns = np.flatnonzero(np.diff(word))
    starts, ends = turns[::2], turns[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words make one shingle, no words none."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return np.empty(0, np.int64)
    size = min(k, len(words))
    acc = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - size + 1 + i]
    return np.unique(mix(acc).view(np.int64))
