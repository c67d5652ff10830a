"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

N-grams are of characters (order 5; digits as 0, white space as one space, text padded). One pass over the documents
adds up each task's n-grams: how often they stand in trusted rows, and that some document holds them. These counts, by
fold of doc_id and n-gram, are the sharded table that everything else is joined from: lower orders are continuation
counts (distinct n-grams one longer that end in it), discounts D1, D2, D3+ of each order come from its counts of
counts, and the interpolated probability of each distinct n-gram that documents hold comes from joins with the count
tables, its suffixes and their contexts, order by order, all by shuffle on the n-gram.

Cross-fitting: a document is scored by the model of the trusted rows of the other fold, so no row is judged by a model
that has seen it, trusted rows included. If one fold has no trusted text, the other's model scores all.

Each document's log-likelihood adds up the values of its n-grams. Up to ``broadcast_keys`` distinct n-grams, values are
broadcast (12 bytes each). Beyond, they are joined: documents are packed into compressed chunks with their distinct
n-grams, these fetch their values by a shuffled join, and each chunk is scored with its own. Both give the same sums.

A document is kept if its perplexity is at most the threshold of its language: the ``quantile`` of the perplexities of
all trusted rows of the language; for a language without any, that of all trusted rows.

Null or empty texts have no perplexity and aren't kept. Without any trusted text all other documents are kept, with
null perplexity and threshold, as there is nothing to judge them by; a null language is one of its own. Repeated rows
are judged each; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_folder, hinted, mix, shared_folder, slices, table, tidy

ORDER = 5
#: Values that may be broadcast, 12 bytes each; and characters of the texts of a chunk beyond that.
BROADCAST_KEYS, CHUNK_CHARS = 4_000_000, 16_000_000
_BLANK, _DIGIT = re.compile(r"\s+"), re.compile(r"\d")
_MULT = np.uint64(0x100000001B3)


def padded(text: str | None) -> str:
    """Normalised text between ORDER - 1 start marks and an end mark; '' if there is nothing in it."""
    body = _DIGIT.sub("0", _BLANK.sub(" ", text.replace("\x02", " ").replace("\x03", " ")).strip()) if isinstance(text, str) else ""
    return "\x02" * (ORDER - 1) + body + "\x03" if body else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each place."""
    acc = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        acc = acc * _MULT + codes[i : len(codes) - n + 1 + i] + np.uint64(1)
    return mix(acc)


def count_grams(docs: DataFrame) -> DataFrame:
    """fold, gram, n: the ORDER-grams of all texts of docs (fold, trusted, text), n of them in trusted ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, dict[str, int]] = {}

        def out() -> Iterator[pd.DataFrame]:
            for fold, of in counts.items():
                if of:
                    yield pd.DataFrame({"fold": np.full(len(of), fold, np.int32), "gram": list(of), "n": list(of.values())})

        for frame in slices(frames, 1000):
            for (fold, trusted), part in frame.groupby(["fold", "trusted"]):
                text, of = "".join(padded(t) for t in part.text), counts.setdefault(int(fold), {})
                if not text:
                    continue
                _, first, n = np.unique(gram_hash(codes_of(text), ORDER), return_index=True, return_counts=True)
                for i, k in zip(first.tolist(), n.tolist()):
                    gram = text[i : i + ORDER]
                    if "\x03" not in gram[:-1]:
                        of[gram] = of.get(gram, 0) + (k if trusted else 0)
            if sum(map(len, counts.values())) > 1_000_000:
                yield from out()
                counts.clear()
        yield from out()

    rows = docs.select("fold", "trusted", "text").mapInPandas(run, "fold int, gram string, n long")
    return rows.groupBy("fold", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(grams: DataFrame) -> tuple[dict[int, DataFrame], dict[int, int]]:
    """For each order fold, gram, context, p (probability) and rest (weight of the lower order after the context), from
    fold, gram, n; and the number of characters of each fold that has any."""
    counts = {ORDER: cut(grams)}
    for m in range(ORDER - 1, 0, -1):
        counts[m] = cut(counts[m + 1].groupBy("fold", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")))
    vocabulary = {r["fold"]: r["count"] for r in counts[1].groupBy("fold").count().collect()}
    levels: dict[int, DataFrame] = {}
    for m in range(1, ORDER + 1):
        level = counts[m].select("fold", "gram", "n", F.expr(f"substring(gram, 1, {m - 1})").alias("context"))
        of = {(r["fold"], r["n"]): r["count"] for r in level.where("n <= 4").groupBy("fold", "n").count().collect()}
        discount, least = F.lit(None).cast("double"), F.lit(None).cast("double")
        for fold, size in vocabulary.items():
            c = [of.get((fold, k), 0) for k in range(5)]
            y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
            d = [min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.05), k - 0.05) if c[k] else k * 0.5 for k in (1, 2, 3)]
            discount = F.when(F.col("fold") == fold, F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(discount)
            least = F.when(F.col("fold") == fold, 1 / (size + 1)).otherwise(least)
        contexts = level.groupBy("fold", "context").agg(F.sum("n").alias("total"), F.sum(discount).alias("freed"))
        level = level.join(contexts, ["fold", "context"]).withColumn("rest", F.col("freed") / F.col("total"))
        q = least
        if m > 1:
            shorter = levels[m - 1].select("fold", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            level, q = level.withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, ["fold", "suffix"]), F.col("q")
        p = (F.col("n") - discount) / F.col("total") + F.col("rest") * q
        levels[m] = cut(level.select("fold", "gram", "context", p.alias("p"), "rest"))
        del counts[m], level, contexts
        tidy(levels[m].sparkSession)
    return levels, vocabulary


def values_of(asked: DataFrame, levels: dict[int, DataFrame], vocabulary: dict[int, int]) -> DataFrame:
    """fold, gram, value: the log-probability of the last character of each gram of asked (fold, gram; fold: of the
    model), by the longest n-gram that the model has, times the weights of the contexts that it passes."""
    value = F.lit(None).cast("double")
    for fold, size in vocabulary.items():
        value = F.when(F.col("fold") == fold, float(np.log(0.5 / (size + 1)))).otherwise(value)
    rows = asked
    for m in range(1, ORDER + 1):
        own = levels[m].select(F.col("fold").alias("f"), F.col("gram").alias("g"), F.log("p").alias(f"p{m}"))
        rows = rows.join(own, (F.col("fold") == F.col("f")) & (F.expr(f"right(gram, {m})") == F.col("g")), "left").drop("f", "g")
        weight = F.lit(0.0)
        if m > 1:
            passed = levels[m].select(F.col("fold").alias("f"), F.col("context").alias("g"), F.log("rest").alias(f"r{m}")).distinct()
            rows = rows.join(passed, (F.col("fold") == F.col("f")) & (F.expr(f"substring(gram, {ORDER - m + 1}, {m - 1})") == F.col("g")), "left").drop("f", "g")
            weight = F.coalesce(f"r{m}", F.lit(0.0))
        rows = rows.select("fold", "gram", F.coalesce(F.col(f"p{m}"), weight + value).alias("value"))
        value = F.col("value")
        if m < ORDER:  # what an order's joins shuffle goes before the next one's
            rows = cut(rows)
            tidy(rows.sparkSession)
    return rows


class Hashed:
    """Values by 64-bit key, in an open-addressing table read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
        at = (keys & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & int(self.mask)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """found, value of each key."""
        at = (keys & self.mask).astype(np.int64)
        value, found, left = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool), np.arange(len(keys))
        while len(left):
            held = self.keys[at[left]]
            hit = held == keys[left]
            found[left[hit]], value[left[hit]] = True, self.values[at[left[hit]]]
            left = left[~hit & (held != 0)]
            at[left] = (at[left] + 1) & int(self.mask)
        return found, value


def place_keys(texts: list[str], fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the ORDER-gram that ends at each scored place of padded texts for the model of a fold, and the places of
    each text."""
    codes = codes_of("".join(texts))
    sizes = np.array([max(0, len(t) - ORDER + 1) for t in texts], np.int64)
    if not len(codes):
        return np.empty(0, np.uint64), sizes
    own = np.ones(len(codes), bool)
    ends = np.cumsum([len(t) for t in texts])
    for i in range(1, ORDER):
        own[ends - i] = False  # an n-gram that starts here goes on in the next text
    return fold_key(gram_hash(codes, ORDER), fold)[own[: len(codes) - ORDER + 1]], sizes


def fold_key(keys: np.ndarray, fold: int) -> np.ndarray:
    return mix(keys + np.uint64(fold + 1))


def likelihoods(texts: list, fold: int, values: Hashed) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood and number of scored places of each text."""
    ready = [padded(t) for t in texts]
    keys, sizes = place_keys([t for t in ready if t], fold)
    n = np.array([max(0, len(t) - ORDER + 1) for t in ready], np.int64)
    _, found = values.get(keys)
    total = np.concatenate([[0.0], np.cumsum(found.astype(np.float64))])
    out, ends = np.zeros(len(ready)), np.cumsum(sizes)
    out[n > 0] = total[ends] - total[ends - sizes]
    return out, n


def keyed(values: DataFrame) -> DataFrame:
    """key, value for fold, gram, value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                codes = codes_of("".join(part.gram)).reshape(-1, ORDER)
                acc = np.full(len(codes), ORDER, np.uint64)
                for i in range(ORDER):
                    acc = acc * _MULT + codes[:, i] + np.uint64(1)
                yield pd.DataFrame({"key": fold_key(mix(acc), int(fold)).view(np.int64), "value": part.value.to_numpy(np.float32)})

    return values.mapInPandas(run, "key long, value float")


def scored(docs: DataFrame, values: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, lang, trusted, log_likelihood, n_scored for each row of docs (doc_id, lang, trusted, model, text)."""
    values = cut(keyed(values))
    tidy(docs.sparkSession)
    if values.count() > broadcast_keys:
        return _scored_in_chunks(docs, values)
    got = values.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((got["key"].to_numpy().view(np.uint64), got["value"].to_numpy()))
    tables: dict[str, Hashed] = {}

    def run(texts: pd.Series, model: pd.Series) -> pd.DataFrame:
        if "t" not in tables:
            tables["t"] = Hashed(*sent.value)
        out = pd.DataFrame({"log_likelihood": np.zeros(len(texts)), "n_scored": np.zeros(len(texts), np.int64)})
        for part in slices([pd.DataFrame({"text": texts.to_numpy(), "model": model.to_numpy()})]):
            for fold, rows in part.groupby("model"):
                total, n = likelihoods(list(rows.text), int(fold), tables["t"])
                out.loc[rows.index, "log_likelihood"], out.loc[rows.index, "n_scored"] = total, n
        return out

    found = F.pandas_udf(run, "log_likelihood double, n_scored long")(F.col("text"), F.col("model"))
    return docs.select("doc_id", "lang", "trusted", found.alias("found")).select("doc_id", "lang", "trusted", "found.*")


def _scored_in_chunks(docs: DataFrame, values: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/chunks-{np.random.default_rng().integers(1 << 62)}"
    columns = ["doc_id", "lang", "trusted", "model", "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, keys, nth = [], 0, [], 0

        def out() -> pa.RecordBatch:
            sink = io.BytesIO()
            whole = pa.Table.from_batches(held)
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(whole)
            lists = pa.array([np.unique(np.concatenate(keys)).view(np.int64)], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | nth], pa.int64()), pa.array([sink.getvalue()], pa.binary()), lists], ["chunk", "docs", "keys"])

        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts, folds = batch.column("text").to_pylist(), np.array(batch.column("model").to_pylist())
            for fold in np.unique(folds):
                mine = [t for text, f in zip(texts, folds) if f == fold and (t := padded(text))]
                keys.append(np.unique(place_keys(mine, int(fold))[0]))
            held.append(batch)
            chars += sum(len(t) for t in texts if t)
            if len(keys) > 64:
                keys = [np.unique(np.concatenate(keys))]
            if chars >= CHUNK_CHARS:
                yield out()
                held, chars, keys, nth = [], 0, [], nth + 1
        if held:
            yield out()

    docs.select(*columns).mapInArrow(pack, "chunk long, docs binary, keys array<long>").write.option("compression", "zstd").parquet(folder)
    chunks = spark.read.parquet(folder)
    fetched = chunks.select("chunk", F.explode("keys").alias("key")).join(values, "key").select(F.col("chunk").alias("to"), "key", "value")

    def score(packed: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if packed.empty:
            return pd.DataFrame({"doc_id": [], "lang": [], "trusted": [], "log_likelihood": [], "n_scored": []}, dtype=object)
        held = Hashed(known.key.to_numpy().view(np.uint64), known.value.to_numpy(np.float32))
        out = []
        for blob in packed.docs:
            for batch in pa.ipc.open_stream(blob):
                frame = batch.to_pandas(integer_object_nulls=True)
                for fold, rows in frame.groupby("model"):
                    total, n = likelihoods(list(rows.text), int(fold), held)
                    out.append(rows[["doc_id", "lang", "trusted"]].assign(log_likelihood=total, n_scored=n))
        return pd.concat(out).astype({"doc_id": "Int64"})

    whole = chunks.select("chunk", "docs").groupBy("chunk").cogroup(fetched.groupBy("to"))
    done = cut(whole.applyInPandas(score, "doc_id long, lang string, trusted boolean, log_likelihood double, n_scored long"))
    drop_folder(spark, folder)
    return done


def judge(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept for each row of docs (doc_id, text, lang); trusted: doc_ids."""
    ids = cut(trusted.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct())
    fold: Column = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    rows = rows.join(hinted(ids), F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "lang", fold.alias("fold"), F.col("_id").isNotNull().alias("trusted"))
    grams = cut(count_grams(rows))
    tidy(docs.sparkSession)  # the n-grams of all tasks, shuffled, are the most that is ever on disk
    levels, vocabulary = kneser_ney(grams.where("n > 0"))
    tidy(docs.sparkSession)
    if not vocabulary:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "lang", none.alias("perplexity"), none.alias("threshold"), (F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))) > 0).alias("kept"))
    other = F.lit(1) - F.col("fold") if len(vocabulary) == 2 else F.lit(next(iter(vocabulary)))
    asked = grams.select(other.cast("int").alias("fold"), "gram").distinct()
    found = scored(rows.withColumn("model", other.cast("int")), values_of(asked, levels, vocabulary), broadcast_keys)
    perplexity = F.when(F.col("n_scored") > 0, F.exp(-F.col("log_likelihood") / F.col("n_scored")))
    found = cut(found.select("doc_id", "lang", "trusted", perplexity.alias("perplexity")))
    seen = found.where("trusted and perplexity is not null")
    cutoff = F.percentile_approx("perplexity", quantile, 10_000)
    limits = hinted(cut(seen.groupBy(F.col("lang").alias("_lang")).agg(cutoff.alias("own"))))
    pooled = seen.agg(cutoff).first()[0]
    joined = found.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("own", F.lit(pooled).cast("double")))
    kept = F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.col("threshold"))
    return joined.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """The documents kept, with their perplexity and threshold."""
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    return judge(table(spark, sf_dir, "documents"), labels).where("kept").drop("kept")
