"""Importance resampling towards a target text by hashed n-gram features.

Features are all runs of 1 to n words. They are hashed by a ring of running CRCs: a text is scanned once, and for the
last n starts the state of zlib's crc32 is kept; each word extends every state by a space and the word, starts one of
its own, and every state is then a feature's hash, of which the bucket is emitted. So no feature is ever put together
as a string. The buckets of a row (two bytes each) are written to the shared folder and read from there for the two
uses: counts by bucket, and weights.

Counts of all documents and of the target text are summed by bucket (the number of buckets bounds what reaches the
driver); a bucket's gain is the floored log ratio of the two smoothed shares, a document's weight the sum of the gains
of its features. Gumbel noise from a hash of doc_id turns the highest scores into a sample without replacement. Rows
with enough words are ordered by range partitions and numbered (``common.running``); the first ``percent`` are drawn.

Texts are lower-cased in A-Z; words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null texts have none. Repeated rows count
each and are drawn each, in any order of theirs; null doc_ids are hashed as an empty id and come last among ties. Texts
are worked off in pieces; a value of any length is one row. Other columns aren't read. Empty tables give an empty
result; without target text all gains come from its smoothing alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_folder, running, shared_folder, table

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def words_of(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of the lower-cased text, those of about ``size`` bytes at a time."""
    at, data = 0, data.lower()
    while at < len(data):
        gap = _GAP.search(data, min(at + size, len(data)))
        end = gap.start() if gap else len(data)
        yield _WORD.findall(data, at, end)
        at = end


def ring(data: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to n words (in no order that matters)."""
    states: list[int] = []
    count, parts = 0, []
    for words in words_of(data):
        out = array("I")
        for word in words:
            longer = b" " + word
            states = [crc32(longer, s) for s in states]
            states.append(crc32(word))
            out.extend(states)
            if len(states) == n:
                del states[0]
        count += len(words)
        parts.append((np.frombuffer(out, np.uint32) % np.uint32(buckets)).astype("<u2"))
    return count, np.concatenate(parts) if parts else np.empty(0, "<u2")


def scanned(docs: DataFrame, n: int, buckets: int, folder: str) -> DataFrame:
    """doc_id, words and features (the buckets, two bytes each) of each row of docs (doc_id, text), written to ``folder``."""
    if buckets > 1 << 16:
        raise ValueError("buckets are kept as two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 200) for b in batches for at in range(0, b.num_rows, 200)):
            found = [ring(t.as_py() or b"", n, buckets) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([w for w, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary())], ["doc_id", "words", "features"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, words long, features binary")
    rows.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows are in each bucket: a row for each task and bucket is summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column("features"):
                total += np.bincount(np.frombuffer(row.as_py(), "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in features.select("features").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target by its share in the source, both smoothed by one."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    top = [float(t + 1) * float(all_source + size) for t in target.tolist()]
    low = [float(s + 1) * float(all_target + size) for s in source.tolist()]
    return np.array([math.floor(1000 * math.log(t / b)) for t, b in zip(top, low)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor of 1000 times a Gumbel variate told by the sha256 of seed and doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, n: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1 up; null if not drawn) of each row of docs (doc_id, text), drawn
    towards the texts of target (text)."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    try:
        rows = scanned(docs, n, buckets, f"{folder}/docs")
        wanted = scanned(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets, f"{folder}/target")
        gain = spark.sparkContext.broadcast(gains(bucket_counts(rows, buckets), bucket_counts(wanted, buckets)))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.frombuffer(f.as_py(), "<u2") for f in batch.column("features")]
                weight = [int(gain.value[f].sum()) for f in found]
                score = [w + noise(i.as_py(), seed) for w, i in zip(weight, batch.column("doc_id"))]
                values = [pa.array(v, pa.int64()) for v in ([len(f) for f in found], weight, score)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("words"), *values], ["doc_id", "words", "n_features", "weight", "score"])

        scored = cut(rows.mapInArrow(weigh, "doc_id long, words long, n_features long, weight long, score long"))
    finally:
        drop_folder(spark, folder)
    able = scored.where(F.col("words") >= least_words)
    most = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = running(able.withColumn("one", F.lit(1).cast("long")), order, ["one"])
    rank = F.col("before_one") + 1
    out = ranked.select("doc_id", "n_features", "weight", "score", F.when(rank <= most, rank).alias("rank"))
    none = F.lit(None).cast("long").alias("rank")
    return out.unionByName(scored.where(F.col("words") < least_words).select("doc_id", "n_features", "weight", "score", none))


def op13_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


#: The same in DuckDB: crc32 is the polynomial's table folded over the bytes of each distinct feature.
OP13_SQL = r"""
with recursive halved(i, c, k) as (
  select range, range::ubigint, 0 from range(256)
  union all select i, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end, k + 1 from halved where k < 8),
crcs as (select list(c order by i) as t from halved where k = 8),
texts as (select row_number() over () as row, doc_id, text, true as own from documents union all select null, null, text, false from benchmark),
w as (
  select row, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
f as (
  select row, own, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) as f
  from w, (select unnest([1, 2, 3]) as n) where len(w) >= n),
g as (select row, own, f, count(*) as c from f group by row, own, f),
x as (select f, hex(encode(f)) as x from (select distinct f from g)),
h as (
  select f, (xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::ubigint)),
    lambda c, d: xor(c // 256, t[(xor(c, d) % 256)::int + 1])), 4294967295::ubigint) % 10000)::int as b from x, crcs),
k as (select own, b, sum(c) as n from g join h using (f) group by own, b),
total as (select coalesce(sum(n) filter (own), 0) as s, coalesce(sum(n) filter (not own), 0) as t from k),
gain as (
  select z.b, floor(1000 * ln((coalesce(q.n, 0) + 1)::double * (total.s + 10000)::double / ((coalesce(p.n, 0) + 1)::double * (total.t + 10000)::double)))::bigint as gain
  from (select range::int as b from range(10000)) z left join (select * from k where own) p on p.b = z.b left join (select * from k where not own) q on q.b = z.b, total),
d as (select row, sum(c)::bigint as n, sum(c * gain)::bigint as weight from g join h using (f) join gain using (b) where own group by row),
s as (
  select w.row, w.doc_id, len(w.w) as words, coalesce(d.n, 0) as n_features, coalesce(d.weight, 0) as weight,
    coalesce(d.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(w.doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from w left join d on d.row = w.row where own),
r as (select *, row_number() over (partition by words >= 20 order by score desc, doc_id nulls last) as place, count(*) filter (words >= 20) over () as able from s)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score,
  case when words >= 20 and place <= 5 * able // 100 then place end as rank
from r
"""
