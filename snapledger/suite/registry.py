"""Named queries over the given tables, each with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapledger.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one directory, and portable SQL over them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = [name for name in TABLES if "{" + name + "}" in text]
        quoted = text.replace("{", "{{").replace("}", "}}")
        for name in used:
            quoted = quoted.replace("{{" + name + "}}", "{" + name + "}")
        return self.spark.sql(quoted, **{name: getattr(self, name) for name in used})


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(prepare(spark), folder))
        if sql is not None:
            ORACLES[name] = plain(sql)
        return build

    return register


def plain(text: str) -> str:
    """Table placeholders to bare names for the SQL side."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text
