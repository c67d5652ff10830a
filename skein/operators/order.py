"""Numbers and running sums over a whole order, without one task that holds it all."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of spark.checkpoint.dir and read from there; only a local session without
    that setting (tests) gets a temporary folder."""
    _checkpoint_folder(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``kept`` for many rows: as Parquet in the same folder, by columns, where a checkpoint writes each row as an object
    of its own. Partitions and their order aren't kept."""
    folder = f"{_checkpoint_folder(df)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _checkpoint_folder(df: DataFrame) -> str:
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-"))
    return spark.sparkContext.getCheckpointDir()


def dealt(df: DataFrame, by: list, most: int = 500_000) -> DataFrame:
    """``df`` dealt by the columns ``by`` into parts of about ``most`` rows, so that what a task holds of sums by them
    stays the same however many rows there are, and the sums need no further shuffle."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // most)), *by)


def numbered(df: DataFrame, by: list, name: str) -> DataFrame:
    """``df`` with column ``name``: the row's number from 1 in the order ``by`` over all rows.

    Rows are range-sorted into partitions; the partitions' sizes, one row each, give each its first number.
    """
    rows = kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    first, at = {}, 1
    for part in sorted(sizes):
        first[part], at = at, at + sizes[part]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = None
        for batch in batches:
            if batch.num_rows:
                nth = first[batch.column("_part")[0].as_py()] if nth is None else nth
                yield batch.append_column(name, pa.array(range(nth, nth + batch.num_rows), pa.int64()))
                nth += batch.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(number, f"{schema}, `{name}` long").drop("_part")


def hinted(small: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a table of at most ``most`` rows; without, it is joined by shuffle."""
    return F.broadcast(small) if small.count() <= most else small
