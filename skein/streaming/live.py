"""Streams: staged pipelines, results kept for each key until they are read, stop flags and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

Stage = Callable[[DataFrame], DataFrame]


def read(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file; ``files``: at most so many a batch."""
    stream = spark.readStream.schema(schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(place):  # a stream reads folders
        path, stream = place.getParent().toString(), stream.option("pathGlobFilter", place.getName())
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(path)


def event_time(df: DataFrame, column: str, late: str) -> DataFrame:
    """With the column as timestamp (a zone-less one can't have a watermark) and rows up to ``late`` behind accepted."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def staged(df: DataFrame, stages: list[tuple[str, Stage]], folder: str, stop: Callable[[], bool] | None = None) -> StreamingQuery:
    """Each batch goes through all stages, the result of each written below ``folder`` by batch, so that one done twice
    replaces itself: every row counts once. Runs until all that is there is read, or until ``stop`` says so, which is
    asked before each batch; a batch not begun is read by the next run from the same folder."""

    def run(batch: DataFrame, number: int) -> None:
        if stop is not None and stop():
            raise Stopped(number)
        for name, stage in stages:
            out = f"{folder}/{name}/batch={number}"
            stage(batch).write.mode("overwrite").parquet(out)
            batch = batch.sparkSession.read.parquet(out)

    return df.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()


class Stopped(Exception):
    """A stop was asked for before this batch."""


def finish(query: StreamingQuery) -> bool:
    """Wait for the end; False if it was stopped before all was read."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:  # a Python exception of a batch comes back inside Spark's own, by its name
        if f"{Stopped.__module__}.{Stopped.__qualname__}: " in str(e):
            return False
        raise
    return True


class _Kept(StatefulProcessor):
    """The results of a key (or of a bucket of one) until a request asks for them; see ``ResultBuffer``."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", "row string")

    def _out(self, request: str | None) -> Iterator[pd.DataFrame]:
        held = iter(self.rows.get()) if self.rows.exists() else iter(())
        while some := [r[0] for r in islice(held, 10_000)]:
            yield pd.DataFrame({"request": [request] * len(some), "row": some}, dtype=object)
        self.rows.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = []
        for frame in rows:
            asked += frame["request"].dropna().tolist()
            new = frame["row"].dropna()
            if len(new):
                self.rows.appendList([(r,) for r in new])
        if asked:
            yield from self._out(min(asked, key=int))
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if self.rows.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._out(None)

    def close(self) -> None:
        pass


#: How times are kept in JSON: to the microsecond.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class ResultBuffer:
    """Results kept for each key until they are asked for, in the state of one stream that may stop and start again.

    ``put`` and ``ask`` add result rows and requests (a number and a key) to two tables; ``run`` reads what is new of
    both. A request gets all results of its key that no request before it got, those of its own run included; of
    requests for one key in one run the smallest number gets them. So each result is given once, whatever restarts lie
    between, and answers of a run that is done twice replace themselves. With ``idle_ms``, results that no run has added
    to or asked for so long are given out with a null request at the next run, instead of staying.

    State is a list by key and bucket (a hash of the row), so results of a key that holds a third of all rows are kept by
    as many tasks as there are ``buckets``; a request goes to each of them. Rows with a null key are kept like others,
    though no request names them; repeated rows are results each. Rows are kept as JSON, so columns may have any names.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, buckets: int = 8, idle_ms: int | None = None):
        self.spark, self.folder, self.schema, self.key, self.buckets, self.idle_ms = spark, folder, schema, key, buckets, idle_ms
        requests = spark.createDataFrame([], StructType([StructField("_request", LongType()), schema[key]]))
        requests.write.mode("ignore").parquet(f"{folder}/requests")
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/results")

    def put(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode("append").parquet(f"{self.folder}/results")

    def ask(self, requests: dict[int, object]) -> None:
        """requests: the key asked for, by number."""
        rows = self.spark.createDataFrame(list(requests.items()), StructType([StructField("_request", LongType()), self.schema[self.key]]))
        rows.write.mode("append").parquet(f"{self.folder}/requests")

    def run(self) -> None:
        results = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/results")
        bucket = F.pmod(F.xxhash64(*results.columns), F.lit(self.buckets)).cast("int")
        row = F.to_json(F.struct(*results.columns), {**_TIMES, "ignoreNullFields": "false"})
        results = results.select(F.col(self.key).alias("key"), bucket.alias("bucket"), row.alias("row"), F.lit(None).cast("string").alias("request"))
        requests = self.spark.readStream.schema(StructType([StructField("_request", LongType()), self.schema[self.key]])).parquet(f"{self.folder}/requests")
        every = F.explode(F.sequence(F.lit(0), F.lit(self.buckets - 1))).alias("bucket")
        requests = requests.select(F.col(self.key).alias("key"), every, F.lit(None).cast("string").alias("row"), F.col("_request").cast("string").alias("request"))
        both = results.unionByName(requests).groupBy("key", "bucket")
        kept = both.transformWithStateInPandas(_Kept(self.idle_ms), "request string, row string", "Append", "None" if self.idle_ms is None else "ProcessingTime")
        kept = kept.select(F.col("request").cast("long"), F.from_json("row", self.schema, _TIMES).alias("row")).select("request", "row.*")

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.folder}/given/batch={number}")

        name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, store)  # the store that keeps lists
        try:
            # With timers Spark would begin one empty batch after another for ever, so a run is one batch then.
            trigger = {"availableNow": True} if self.idle_ms is None else {"once": True}
            finish(kept.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.folder}/_checkpoint").trigger(**trigger).start())
        finally:
            self.spark.conf.set(name, before)

    def given(self) -> DataFrame:
        """request (null for what was idle too long) and the columns of all results given so far."""
        return self.spark.read.schema(StructType([StructField("request", LongType()), *self.schema.fields])).parquet(f"{self.folder}/given/batch=*")


def windowed(df: DataFrame, time: str, width: str, slide: str | None, keys: list[str], late: str = "1 hour") -> DataFrame:
    """keys, start, end and n of the rows in each tumbling (or sliding) window."""
    bins = F.window(time, width, slide) if slide else F.window(time, width)
    rows = event_time(df, time, late).groupBy(*keys, bins.alias("w")).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """keys, start, end and n of the rows in each session, which ends after ``gap`` without a row of its keys."""
    rows = event_time(df, time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def to_table(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there of a stream, as a table: written once to ``folder`` (complete results too)."""
    spark = df.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={0 if mode == 'complete' else number}")

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/batch=*")


def refreshed(spark: SparkSession, source: str, schema, folder: str, stage: Stage) -> DataFrame:
    """A scheduled run: what came since the last one goes through the stage to the table in ``folder``."""
    finish(staged(read(spark, source, schema), [("table", stage)], folder))
    return spark.read.parquet(f"{folder}/table/batch=*")


def by_arrival(rows: DataFrame, batch: Column, folder: str, run: Callable[[], StreamingQuery]) -> list[StreamingQuery]:
    """Rows come to the table below ``folder`` in the order of ``batch`` (numbers of a bounded list, null first), one
    micro-batch each; after each the stream that ``run`` starts reads it, from where its checkpoint left off."""
    numbered = rows.withColumn("_batch", batch)
    numbers = sorted((r["_batch"] for r in numbered.select("_batch").distinct().collect()), key=lambda n: (n is not None, n))
    queries = []
    for n in numbers:
        numbered.where(F.col("_batch").eqNullSafe(F.lit(n))).drop("_batch").write.mode("append").parquet(folder)
        queries.append(run())
        finish(queries[-1])
    return queries


def first_of_each(df: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key; rows as late as the watermark, and repeats of a key within ``late``, fall out."""
    return event_time(df, time, late).dropDuplicatesWithinWatermark([key])


def dropped(query: StreamingQuery) -> int:
    """Rows that fell out behind the watermark in the micro-batches of a finished run."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
