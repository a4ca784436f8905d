"""The two dictionaries that the entry module hands out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


#: Tables whose rows are long texts or are worked on row by row.
HEAVY = ("documents", "conversations", "pages")
#: A session over a few small files may ask for heavy tables in so many partitions; unset, a table comes as its files do.
PARTITIONS = "spark.pagemill.inputPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    asked = spark.conf.get(PARTITIONS, None)
    return rows.repartition(int(asked)) if asked and name in HEAVY else rows
