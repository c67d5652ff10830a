"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow of its documents in shuffled order (by ``order_key``, a hash of doc_id and text), served again
from the start for up to ``epochs`` rounds. The weight of a flow is its target size. A copy of a document gets the
virtual finish time (words of its source up to and with it) / target. Copies of all sources are range-sorted by finish
time, the words before each are added up over the whole order, and the order is truncated at the total budget: copies
that end within it are taken whole, the copy in which it ends is taken in part, later ones not at all. So the mix has
exactly the budget, and each source is off its target by less than its longest document.

Targets: sources by code point, null last, have the weights of ``weights`` in turn and share ``share`` of all words in
proportion; none gets more than ``epochs`` times its own words, and what is over is shared by the others. That fixed
point is min(cap, level x weight) with one level for all, found from running sums over the sources by cap / weight.

The words before a document within its source are added up by hash buckets: sums for each (source, bucket), their
running sum, and a window within a bucket; so a source with a third of all rows is spread over all buckets. Equal rows
(same doc_id, text and source) are one entry with a number until the sums are done, so any number of them is as light
as one. Running sums over all copies, over buckets and over sources go by range partitions (``common.running``).

Null texts have no words and are never taken; null doc_ids are documents of their own; a null source is a source.
Repeated rows are served each; an empty table gives an empty mix. Other columns of the input aren't read; a text is
found again by doc_id and text_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hinted, running

#: Rows of one source that one bucket should hold at most, and the fewest buckets of a source.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).cast("long"), F.lit(0).cast("long"))


def order_key(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of doc_id, a colon and the text, null as empty: a shuffle that any engine can repeat."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """sizes (source, source_size) with target; one row for each source."""
    by_name = [F.col("source").isNull(), F.col("source")]
    rows = running(sizes.select("source", "source_size", F.lit(1).cast("long").alias("one")), by_name, ["one"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights) + 1).cast("int")).cast("double")
    rows = rows.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(epochs)).alias("cap"))
    rows = running(rows, [F.col("cap") / F.col("weight"), *by_name], ["cap", "weight"])
    rows = cut(rows)
    words, heft = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    # With the sources below this one at their caps, is the level within its own cap? The first such level holds for all.
    level = (F.lit(float(words or 0)) * share - F.col("before_cap")) / (F.lit(heft or 0.0) - F.col("before_weight"))
    within = rows.select((F.col("cap") / F.col("weight")).alias("reach"), "source", level.alias("level"), "weight", "cap").where("level * weight <= cap")
    first = within.agg(F.min(F.struct("reach", F.col("source").isNull(), F.col("source"), "level"))["level"]).first()[0]
    target = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """doc_id, source, size, text_hash, source_size, target, copy (0 up), place (in its source's order), finish
    (virtual time) and taken (words of this copy in the mix) of docs (doc_id, text, source), in order of finish.

    Every document has a row for each copy; those outside the mix have taken 0.
    """
    text = F.col("text")
    slim = docs.select(F.col("doc_id").cast("long"), "source", word_count(text).alias("size"), F.xxhash64("text").alias("text_hash"), order_key(F.col("doc_id"), text).alias("_h"))
    slim = cut(slim.groupBy("doc_id", "source", "size", "text_hash", "_h").agg(F.count("*").alias("_n")))
    largest = slim.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-largest // BUCKET_ROWS))
    slim = slim.withColumn("_b", F.floor(F.col("_h") / float(1 << 60) * buckets))
    sums = slim.groupBy("source", "_b").agg(F.sum(F.col("size") * F.col("_n")).alias("_sum"), F.sum("_n").alias("_rows"))
    by_name = [F.col("source").isNull(), F.col("source")]
    heads = cut(running(sums, [*by_name, F.col("_b")], ["_sum", "_rows"]))
    of_source = heads.groupBy("source").agg(F.sum("_sum").alias("source_size"), F.min("before__sum").alias("_from"), F.min("before__rows").alias("_first"))
    aims = cut(targets(of_source.select("source", "source_size"), weights, share, epochs))
    aims = aims.withColumnRenamed("source", "_s").join(of_source.select("source", "_from", "_first"), F.col("source").eqNullSafe(F.col("_s"))).drop("source")
    heads = heads.join(aims, F.col("source").eqNullSafe(F.col("_s")))
    heads = heads.select(F.col("_s"), F.col("_b").alias("_bucket"), (F.col("before__sum") - F.col("_from")).alias("_words"), (F.col("before__rows") - F.col("_first")).alias("_ahead"), "source_size", "target")
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumns({
        "_in": F.coalesce(F.sum(F.col("size") * F.col("_n")).over(inside), F.lit(0)),
        "_at": F.coalesce(F.sum("_n").over(inside), F.lit(0)),
    })
    rows = rows.join(hinted(cut(heads)), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_bucket")))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    rows = rows.withColumns({"place": F.col("_ahead") + F.col("_at") + F.col("_i"), "copy": F.explode(F.array(*(F.lit(i) for i in range(epochs))))})
    upto = F.col("copy") * F.col("source_size") + F.col("_words") + F.col("_in") + (F.col("_i") + 1) * F.col("size")
    rows = rows.withColumn("finish", F.when(F.col("target") > 0, upto / F.col("target")))
    rows = rows.select("doc_id", "source", "size", "text_hash", "source_size", "target", "copy", "place", "finish")
    budget = int((aims.agg(F.sum("target")).first()[0] or 0.0) + 1e-6)
    served = running(rows, [F.col("finish").asc_nulls_last(), F.col("source").isNull(), F.col("source"), F.col("place"), F.col("copy")], ["size"])
    left = F.lit(budget) - F.col("before_size")
    return served.withColumn("taken", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))).drop("before_size")


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    of_doc = ["source", "place", "doc_id", "size", "source_size", "target"]
    out = mix(docs).groupBy(*of_doc).agg(F.sum("taken").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: The same in DuckDB, for the whole table.
OP3_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as nth
  from d group by source),
w as (
  select source, source_size, [5, 2, 1][nth % 3 + 1]::double as weight, source_size * 2.0::double as cap from s),
c as (
  select *, coalesce(sum(cap) over up, 0) as caps, coalesce(sum(weight) over up, 0) as weights,
    row_number() over (order by cap / weight, source is null, source) as nth
  from w window up as (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding)),
l as (
  select *, ((select sum(source_size) from w) * 1.5::double - caps) / ((select sum(weight) from w) - weights) as level from c),
t as (
  select source, source_size, coalesce(least(cap, (select arg_min(level, nth) from l where level * weight <= cap) * weight), cap) as target from l),
p as (
  select d.*, t.source_size, t.target, row_number() over o as place,
    cast(coalesce(sum(size) over (o rows between unbounded preceding and 1 preceding), 0) as bigint) as ahead
  from d join t on d.source is not distinct from t.source
  window o as (partition by d.source order by h, doc_id)),
f as (
  select p.*, copy, (copy * source_size + ahead + size) / target as finish from p, (select unnest([0, 1]) as copy)
  where target > 0),
g as (
  select *, coalesce(sum(size) over (order by finish, source is null, source, place, copy rows between unbounded preceding and 1 preceding), 0) as served from f),
k as (
  select source, place, cast(sum(greatest(0, least(size, (select cast(floor(sum(target) + 1e-6) as bigint) from t) - served))) as bigint) as taken
  from g group by source, place)
select doc_id, cast(size as bigint) as size, source_size, target, coalesce(taken, 0) as taken
from p left join k on p.source is not distinct from k.source and p.place = k.place
"""
