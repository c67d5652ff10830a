"""Queries: streams over events, run until all that is there is read, and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import math as M
from ..sources.sinks import shared_folder
from ..streaming import live
from .registry import query


def events(t):
    path = f"{t.sf_dir}/events.parquet"
    return live.read(t.spark, path, t.spark.read.parquet(path).schema)


@query("stm01_staged_pipeline", "select event_id, value * 2 as score from events where event_type <> 'error'")
def _(t):
    folder = shared_folder(t.spark, "staged")
    stages = [("visited", lambda b: b.where("event_type <> 'error'")), ("scored", lambda b: b.select("event_id", (F.col("value") * 2).alias("score")))]
    live.finish(live.staged(events(t), stages, folder))
    return t.spark.read.parquet(f"{folder}/scored/batch=*")


@query("stm02_drained_results", "with e as (select event_id as id, user_id from events), h as (select *, id % 2 as half from e) select case when user_id = 3 and half = 0 then 1 when user_id = 3 then 2 else 3 end as request, id, user_id from h where user_id in (3, 8) union all select null, id, user_id from h where false")
def _(t):
    found = t("events").select(F.col("event_id").alias("id"), "user_id")
    buffer = live.ResultBuffer(t.spark, shared_folder(t.spark, "drained"), found.schema, "user_id")
    buffer.put(found.where("id % 2 = 0"))
    buffer.run()  # nothing is asked for yet; each run is a start of its own
    buffer.ask({1: 3})
    buffer.run()
    buffer.put(found.where("id % 2 = 1"))
    buffer.ask({2: 3, 3: 8})
    buffer.run()
    buffer.ask({4: 3})  # nothing is left
    buffer.run()
    return buffer.given()


@query("stm02_all_given_once", "select user_id % 7 as request, count(*) as n, count(distinct event_id) as ids from events group by 1")
def _(t):
    found = t("events").select(F.col("event_id").alias("id"), "user_id", (F.col("user_id") % 7).alias("class"))
    buffer = live.ResultBuffer(t.spark, shared_folder(t.spark, "given"), found.schema, "class")
    for half in (0, 1):
        buffer.put(found.where(F.col("id") % 2 == half))
        buffer.ask({10 * half + k: k for k in range(7)})
        buffer.run()
    return buffer.given().groupBy((F.col("request") % 10).alias("request")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query("stm03_stopped", "select event_type, count(*) as before_stop, 0::bigint as after_stop from events where event_id % 2 = 0 group by 1 union all select event_type || ' later', count(*), count(*) from events where event_id % 2 = 1 group by 1")
def _(t):
    """Half of the events is read, then a stop is asked for while the other half waits, then a run reads that half."""
    folder, stopping = shared_folder(t.spark, "stopped"), []
    rows = t("events").select("event_id", "event_type", (F.col("event_id") % 2).alias("half"))
    stream = lambda: t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    go = lambda: live.finish(live.staged(stream(), [("all", lambda b: b)], folder, stop=lambda: bool(stopping)))
    rows.where("half = 0").write.mode("append").parquet(f"{folder}/in")
    ended = [go()]
    rows.where("half = 1").write.mode("append").parquet(f"{folder}/in")
    stopping.append(True)
    ended.append(go())
    read = t.spark.read.schema(rows.schema).parquet(f"{folder}/all/batch=*")
    seen = read.groupBy("event_type", "half").agg(F.count("*").alias("n"))
    seen = t.spark.createDataFrame(seen.collect(), seen.schema)  # a row for each type: what was read up to the stop
    stopping.clear()
    ended.append(go())
    if ended != [True, False, True]:
        raise AssertionError(f"runs ended as {ended}")
    now = t.spark.read.schema(rows.schema).parquet(f"{folder}/all/batch=*").groupBy("event_type", "half").agg(F.count("*").alias("now"))
    both = now.join(seen, ["event_type", "half"], "left")
    name = F.when(F.col("half") == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit(" later")))
    return both.select(name.alias("event_type"), F.col("now").alias("before_stop"), (F.col("now") - F.coalesce("n", F.lit(0))).alias("after_stop"))


@query("stm04_once_each", "select count(*) as n, count(distinct event_id) as ids from events")
def _(t):
    folder = shared_folder(t.spark, "once")
    for _ in range(2):  # a second run finds nothing new
        live.finish(live.staged(events(t), [("all", lambda b: b.select("event_id"))], folder))
    return t.spark.read.parquet(f"{folder}/all/batch=*").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("stm05_tumbling", "select event_type, strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from events group by 1, 2")
def _(t):
    bins = live.windowed(events(t), "ts", "1 hour", None, ["event_type"])
    return live.to_table(bins, shared_folder(t.spark, "tumbling"), "complete").select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stm05_sliding", "with s as (select time_bucket(interval '30 minutes', ts) - k * interval '30 minutes' as start from events, (values (0), (1)) v(k)) select strftime(start, '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by 1")
def _(t):
    bins = live.windowed(events(t), "ts", "1 hour", "30 minutes", [])
    return live.to_table(bins, shared_folder(t.spark, "sliding"), "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stm05_sessions", "with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval '30 minutes' or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, strftime(max(ts) + interval '30 minutes', '%Y-%m-%d %H:%M:%S') as \"end\", count(*) as n from s group by user_id, k")
def _(t):
    rows = live.sessions(events(t), "ts", "30 minutes", ["user_id"])
    out = live.to_table(rows, shared_folder(t.spark, "sessions"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


_ARRIVAL = "month(arrived_at)"
_CLICKS = f"""with c as (select *, {_ARRIVAL} as batch from clicks),
 top as (select batch, max(ts) as ts from c group by 1),
 mark as (select b.batch, date_trunc('millisecond', max(t.ts)) - interval '1 hour' as mark from (select distinct batch from c) b left join top t on t.batch < b.batch group by 1),
 told as (select c.*, c.ts <= mark.mark as late from c join mark using (batch))"""


def _arrival():
    """A month of arrivals is a micro-batch."""
    return F.month("arrived_at")


@query("stm05_late_rows_dropped", _CLICKS + """, f as (select click_id, min(ts) as ts from told where not coalesce(late, false) group by 1),
 last as (select date_trunc('millisecond', max(ts)) - interval '1 hour' as mark from c)
 select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from f
 where time_bucket(interval '1 hour', ts) + interval '1 hour' <= (select mark from last) group by 1""")
def _(t):
    """Hourly counts of clicks, each click_id once, in append mode: a click that comes later than an hour behind the
    newest of the micro-batches before falls out; an hour is given when the watermark has passed its end."""
    folder, clicks = shared_folder(t.spark, "late"), t("clicks").select("click_id", "ts", "arrived_at")

    def run():
        stream = t.spark.readStream.schema(clicks.schema).parquet(f"{folder}/in")
        once = live.first_of_each(stream, "click_id", "ts", "1 hour")
        bins = once.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
        put = lambda b, number: b.select(F.col("w.start").alias("start"), "n").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        return bins.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()

    live.by_arrival(clicks, _arrival(), f"{folder}/in", run)
    out = t.spark.read.schema("start timestamp, n long").parquet(f"{folder}/out/batch=*")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("stm05_late_rows_counted", _CLICKS + " select batch::int as batch, count(*) filter (late) as late from told group by 1")
def _(t):
    """How many rows of each micro-batch fell out behind the watermark, as the stream itself counted them."""
    folder, clicks = shared_folder(t.spark, "counted"), t("clicks").select("click_id", "ts", "arrived_at")

    def run():
        stream = t.spark.readStream.schema(clicks.schema).parquet(f"{folder}/in")
        put = lambda b, number: b.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        return live.first_of_each(stream, "click_id", "ts", "1 hour").writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()

    runs = live.by_arrival(clicks, _arrival(), f"{folder}/in", run)
    numbers = sorted(r["batch"] for r in clicks.select(_arrival().cast("int").alias("batch")).distinct().collect())
    return t.values("batch int, late long", [(n, live.dropped(q)) for n, q in zip(numbers, runs)])


@query("stm06_scheduled", "select event_type, count(*) as n from events group by 1")
def _(t):
    path, folder = f"{t.sf_dir}/events.parquet", shared_folder(t.spark, "scheduled")
    for _ in range(2):  # the second run has nothing to add
        rows = live.refreshed(t.spark, path, t.spark.read.parquet(path).schema, folder, lambda b: b.select("event_type"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


# Extension points


@query("udf01_pluggable_value", "select l_orderkey, l_linenumber, case when l_quantity > 25 then l_quantity * l_linenumber else 0 end as v from lineitem where l_tax > 0.02")
def _(t):
    return M.valued(t("lineitem"), value=lambda r: F.when(r["l_quantity"] > 25, r["l_quantity"] * r["l_linenumber"]).otherwise(0), keep=[lambda r: r["l_tax"] > 0.02]).select("l_orderkey", "l_linenumber", "v")


@query("udf02_coalescing_aggregates", "select n_nationkey, coalesce(sum(case when c_acctbal > 5000 then 1 end), 0)::bigint as total, count(case when c_acctbal > 5000 then 1 end) as num from nation left join customer on c_nationkey = n_nationkey group by 1")
def _(t):
    vote = F.when(F.col("c_acctbal") > 5000, 1)
    met = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return met.groupBy("n_nationkey").agg(M.coalesce_sum(vote).alias("total"), F.count(vote).alias("num"))


@query("udf03_table_function", "select n_nationkey, i as pos, string_split(n_name, '_')[i + 1] as term from nation, (values (0), (1)) v(i)")
def _(t):
    M.register_table_functions(t.spark)
    t("nation").createOrReplaceTempView("skein_nation")
    return t.spark.sql("select n_nationkey, f.pos, f.term from skein_nation, lateral skein_terms(n_name, '_') f")


