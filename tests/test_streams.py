"""Results kept until asked for, late rows, stops."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from skein.streaming import live


def rows(spark, data):
    return spark.createDataFrame(data, "k string, id long, at timestamp, v double")


def test_results_are_given_once_to_the_first_request(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12, 0, 0, 123456)
    first = [("a", i, at, 0.1) for i in range(5)] + [("b", i + (1 << 60), None, float("inf")) for i in range(5)] + [(None, 1, at, 1.0), ("a", 0, at, 0.1)]
    schema = rows(spark, []).schema
    buffer = lambda: live.ResultBuffer(spark, str(tmp_path), schema, "k", buckets=3)
    given = lambda: sorted((r["request"], r["k"], r["id"], r["at"], r["v"]) for r in buffer().given().collect())
    buffer().put(rows(spark, first))
    buffer().run()
    assert given() == []
    buffer().ask({7: "a", 3: "a", 9: "nobody"})
    buffer().run()
    of_a = sorted((3, *r) for r in first if r[0] == "a")
    assert given() == of_a  # as many of a as of b are kept; the smaller number gets them
    buffer().ask({11: "b"})
    buffer().run()  # a start of its own, over the same checkpoint
    of_b = sorted((11, *r) for r in first if r[0] == "b")
    assert given() == of_a + of_b and given() == of_a + of_b
    buffer().put(rows(spark, [("a", 99, None, None)]))
    buffer().ask({12: "b", 13: "a"})
    buffer().run()
    assert given() == of_a + of_b + [(13, "a", 99, None, None)]


def test_idle_results_are_given_without_a_request(spark, tmp_path):
    buffer = live.ResultBuffer(spark, str(tmp_path), rows(spark, []).schema, "k", idle_ms=1)
    buffer.put(rows(spark, [("a", 1, None, 1.0), ("b", 2, None, 2.0)]))
    buffer.run()
    for number in (1, 2):  # timers are looked at when a run has something to read
        buffer.ask({number: "nobody"})
        buffer.run()
    assert sorted((r["request"], r["k"], r["id"]) for r in buffer.given().collect()) == [(None, "a", 1), (None, "b", 2)]


def test_rows_behind_the_watermark_fall_out(spark, tmp_path):
    hour = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    data = [(0, 1, hour(10)), (0, 1, hour(10)), (0, 2, hour(12)), (1, 3, hour(10, 59)), (1, 4, hour(11, 1)), (1, 2, hour(12)), (2, 5, hour(8)), (2, 6, hour(20)), (3, 7, None)]
    frame = spark.createDataFrame(data, "b int, id long, ts timestamp")

    def run():
        stream = spark.readStream.schema("id long, ts timestamp").parquet(f"{tmp_path}/in")
        put = lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
        return live.first_of_each(stream, "id", "ts", "1 hour").writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()

    runs = live.by_arrival(frame, F.col("b"), f"{tmp_path}/in", run)
    got = sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect())
    assert got == [1, 2, 4, 6, 7] and [live.dropped(q) for q in runs] == [0, 1, 1, 0]


def test_only_a_stop_is_a_clean_end(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: live.read(spark, f"{tmp_path}/in", "id long")

    def broken(batch):
        raise ValueError("Stopped by something else")

    with pytest.raises(StreamingQueryException):
        live.finish(live.staged(stream(), [("all", broken)], f"{tmp_path}/a"))
    assert live.finish(live.staged(stream(), [("all", lambda b: b)], f"{tmp_path}/b", stop=lambda: True)) is False
    assert live.finish(live.staged(stream(), [("all", lambda b: b)], f"{tmp_path}/b")) is True
    assert spark.read.parquet(f"{tmp_path}/b/all/batch=*").count() == 3
