"""Reports, files and caches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local session without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="skein-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def report(df: DataFrame, folder: str, dates: str = "MMM dd, yyyy") -> None:
    """A tab-delimited report with a header; dates and times as ``dates``."""
    columns = [F.date_format(f.name, dates).alias(f.name) if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(f.name) for f in df.schema.fields]
    df.select(*columns).write.option("sep", "\t").option("header", True).option("quote", "").csv(folder)


def file_for_each(df: DataFrame, key: str, text: str, folder: str) -> None:
    """A folder of a text file for each key, and a master of all in ``master``."""
    df.select(key, F.col(text).alias("value")).write.partitionBy(key).text(f"{folder}/each")
    df.orderBy(key).select(F.col(text).alias("value")).write.text(f"{folder}/master")


def normal_lines(text: Column) -> Column:
    """Line ends of all kinds as one."""
    return F.regexp_replace(text, "\r\n?", "\n")


def lines(df: DataFrame, text: str, folder: str) -> None:
    df.select(normal_lines(F.col(text)).alias("value")).write.text(folder)


def dump(df: DataFrame, folder: str) -> None:
    """A JSON document for each row, nulls too."""
    df.write.option("ignoreNullFields", False).json(folder)


def to_yaml(rows: list[dict]) -> str:
    """YAML documents of flat rows."""
    import json

    return "".join("---\n" + "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in row.items()) for row in rows)


def poll(results: DataFrame, after: Column) -> DataFrame:
    """value: the JSON of the rows that ``after`` says are new."""
    fresh = results.where(after)
    return fresh.select(F.to_json(F.struct(*fresh.columns)).alias("value"))


def cached(spark: SparkSession, folder: str, make) -> DataFrame:
    """The table in ``folder``, made and written there if it isn't yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def coloured(word: Column, red: Column, green: Column, blue: Column) -> Column:
    """The word in HTML on its colour, markup escaped."""
    safe = F.replace(F.replace(F.replace(word, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.format_string('<span style="background:#%02x%02x%02x">%s</span>', red.cast("int"), green.cast("int"), blue.cast("int"), safe)
