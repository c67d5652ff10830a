"""Pages from the web, files and memory, errors as values."""

from __future__ import annotations

import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url string, status int, body string, etag string, modified string, error string"


def open_url(url: str, timeout: float = 2.0, headers: dict[str, str] | None = None) -> tuple:
    """status, body, etag, last-modified, error; an empty body is an error, 304 (not modified) is none."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as got:
            body = got.read()
            if got.headers.get("Content-Encoding") == "gzip":
                import gzip

                body = gzip.decompress(body)
            text = body.decode(got.headers.get_content_charset() or "utf-8", "replace")
            return got.status, text or None, got.headers.get("ETag"), got.headers.get("Last-Modified"), None if text else "empty"
    except urllib.error.HTTPError as e:
        return e.code, None, e.headers.get("ETag"), e.headers.get("Last-Modified"), None if e.code == 304 else f"HTTP {e.code}"
    except (OSError, ValueError) as e:
        return None, None, None, None, type(e).__name__


def fetch(urls: DataFrame, opener: Callable[..., tuple] = open_url, timeout: float = 2.0) -> DataFrame:
    """One row for each of the urls (url, and optionally etag, modified of the copy that is there already)."""
    known = [c for c in ("etag", "modified") if c in urls.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                headers = {h: row[c] for c, h in (("etag", "If-None-Match"), ("modified", "If-Modified-Since")) if c in row and isinstance(row[c], str)}
                out.append((row["url"], *opener(row["url"], timeout, headers)))
            if out:
                yield pd.DataFrame(out, columns=["url", "status", "body", "etag", "modified", "error"]).astype({"status": "Int32"})

    return urls.select("url", *known).mapInPandas(run, SCHEMA)


def from_store(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """``fetch`` out of a table of pages (url, html) instead of the web: unknown urls and empty pages are errors."""
    met = urls.select("url").join(pages.select("url", "html"), "url", "left")
    missing, empty = F.col("html").isNull(), F.col("html") == ""
    return met.select(
        "url", F.when(missing, F.lit(404)).otherwise(200).alias("status"), F.when(~missing & ~empty, F.col("html")).alias("body"),
        F.md5(F.col("html").cast("binary")).alias("etag"), F.when(missing, "HTTP 404").when(empty, "empty").alias("error"),
    )


def unchanged(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Without the rows whose (url, etag) is known."""
    return fetched.join(known.select("url", "etag"), ["url", "etag"], "left_anti")


def reachable(fetched: DataFrame) -> DataFrame:
    return fetched.select("url", F.col("error").isNull().alias("ok"))


def acquire(spark: SparkSession, name, kind: str, timeout: float = 2.0) -> DataFrame:
    """name, text, error: of files (f; a path or glob), a URL (u) or an object in memory (o; text, list of texts, or rows
    name, text)."""
    if kind == "f":
        return spark.read.text(name, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"), F.lit(None).cast("string").alias("error"))
    if kind == "u":
        return fetch(spark.createDataFrame([(name,)], "url string"), timeout=timeout).select(F.col("url").alias("name"), F.col("body").alias("text"), "error")
    if kind == "o" and isinstance(name, DataFrame):
        return name.select(F.col("name").cast("string").alias("name"), "text", F.when(F.length("text") > 0, F.lit(None).cast("string")).otherwise("empty").alias("error"))
    if kind == "o":
        rows = [name] if isinstance(name, str) else list(name)
        return spark.createDataFrame([(str(i), r, None if r else "empty") for i, r in enumerate(rows)], "name string, text string, error string")
    raise ValueError(f"neither f, u nor o: {kind!r}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of UTF-8 files."""
    return spark.read.text(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word: of a file with one on each line; empty lines are none."""
    return read_lines(spark, path).select(F.trim("value").alias("word")).where("word <> ''")


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """word, becomes: of a file of lines a => b; other lines are left out."""
    both = F.split("value", "=>")
    return read_lines(spark, path).where(F.size(both) == 2).select(F.trim(both[0]).alias("word"), F.trim(both[1]).alias("becomes"))
