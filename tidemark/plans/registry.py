"""Where the query modules put what they register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        read(spark, sf_dir, t).createOrReplaceTempView(t)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query in Spark SQL over the tables' views; the oracle is the same text unless the dialects part."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: f"v_{t}_{abs(hash(sf_dir)) % 10**8}" for t in TABLES}
        out = text
        for t, view in used.items():
            if "{" + t + "}" in out:
                read(spark, sf_dir, t).createOrReplaceTempView(view)
                out = out.replace("{" + t + "}", view)
        return spark.sql(out)

    QUERIES[name] = run
    SQL[name] = _plain(oracle or text)


def _plain(text: str) -> str:
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def frame(name: str, oracle: str | None):
    """Decorator: a query in DataFrame operations."""

    def keep(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle:
            SQL[name] = _plain(oracle)
        return run

    return keep
