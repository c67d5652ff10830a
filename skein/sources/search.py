"""Search engines over stored texts, in pages, and as a data source of Spark."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import engine_query
from ..operators.order import numbered
from ..operators.relational import include_exclude


def page_offsets(most: int, step: int = 100) -> list[int]:
    return list(range(0, max(0, most), min(step, 100)))


def requests(terms: list[str], exclude: list[str], most: int, step: int = 50) -> list[tuple[str, int]]:
    """query, offset of every page of every order of the terms."""
    return [(engine_query(list(p), exclude), at) for p in itertools.permutations(terms) for at in page_offsets(most, step)]


def requested(searches: DataFrame, step: int = 50) -> DataFrame:
    """query, start_at of every page of each search (terms, exclude: arrays of text, most) and of its terms in reverse."""
    quoted = lambda terms, sign: F.transform(terms, lambda t: F.concat(F.lit(f'{sign}"'), t, F.lit('"')))
    orders = F.explode(F.array_distinct(F.array("terms", F.reverse("terms")))).alias("terms")
    rows = searches.where("most > 0").select(orders, "exclude", "most")
    query = F.array_join(F.concat(quoted(F.col("terms"), ""), quoted(F.coalesce("exclude", F.array().cast("array<string>")), "-")), " ")
    return rows.select(query.alias("query"), F.explode(F.sequence(F.lit(0), F.col("most").cast("int") - 1, F.lit(min(step, 100)))).alias("start_at"))


def search(docs: DataFrame, key: str, text: str, include: list[str], exclude: list[str], most: int = 1000, size: int = 50) -> DataFrame:
    """key, place (from 1) and page (from 0) of the first ``most`` documents that hold all terms and no excluded one."""
    found = include_exclude(docs.select(key, text), F.col(text), include, exclude).select(key).orderBy(key).limit(most)
    return numbered(found, [F.col(key)], "place").withColumn("page", F.floor((F.col("place") - 1) / size))


class PagedSource(DataSource):
    """Rows query, offset, url of a paged engine, a partition for each request. Options: terms and exclude (comma
    lists), most, step, and engine (the address that a query and an offset are put into). It makes the requests' URLs;
    what answers them is up to ``fetch``."""

    @classmethod
    def name(cls):
        return "skein_search"

    def schema(self):
        return "query string, offset int, url string"

    def reader(self, schema):
        return _PagedReader(self.options)


class _Request(InputPartition):
    def __init__(self, query: str, offset: int):
        self.query, self.offset = query, offset


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        terms = lambda name: [t.strip() for t in self.options.get(name, "").split(",") if t.strip()]
        return [_Request(q, at) for q, at in requests(terms("terms"), terms("exclude"), int(self.options.get("most", 100)), int(self.options.get("step", 50)))]

    def read(self, partition):
        from urllib.parse import quote_plus

        engine = self.options.get("engine", "https://search.example/?q={query}&start={offset}")
        yield partition.query, partition.offset, engine.format(query=quote_plus(partition.query), offset=partition.offset)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
