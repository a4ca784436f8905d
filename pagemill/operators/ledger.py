"""Spend: additive per key, money as decimals so that sums don't depend on their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"


def usage_by_key(ledger: DataFrame, *, key: list[str]) -> DataFrame:
    """ledger(key, usage MAP<STRING, numeric>) -> key, name, amount. Names whose value is null add nothing."""
    rows = ledger.select(*key, F.explode("usage").alias("name", "amount"))
    return rows.filter("amount is not null").groupBy(*key, "name").agg(F.sum("amount").alias("amount"))


def totals(*ledgers: DataFrame, key: str = "work_id") -> DataFrame:
    """Any number of ledgers (work_id, usage, cost_usd) -> cost and usage map per work."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ledgers)
    cost = every.groupBy(key).agg(F.sum(F.col("cost_usd").cast(MONEY)).cast(MONEY).alias("cost_usd"))
    used = usage_by_key(every, key=[key]).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "amount")))).alias("usage"))
    return cost.join(used, key, "left")


def usage_of_models(nested: DataFrame, *, key: list[str]) -> DataFrame:
    """nested(key, models MAP<STRING, MAP<STRING, BIGINT>>) -> key, name, amount over all models."""
    rows = nested.select(*key, F.explode("models").alias("model", "usage"))
    return usage_by_key(rows, key=key)
