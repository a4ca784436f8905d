"""Places in an order over groups of any size: no group is numbered by one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir (on one machine a new one, where it is unset)."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return folder or context.getCheckpointDir()


def settled(rows: DataFrame) -> DataFrame:
    """The rows as they came out once, in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def numbered(rows: DataFrame, *, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Adds the place (from 1) of each row within its group `by` in the order; equal rows are told apart by chance.

    Rows are sorted in ranges of (by, order), so a large group fills several; a row's place is its place in its range plus
    the rows of its group in the ranges before.
    """
    keys = [F.col(c) for c in by]
    ranged = settled(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"))  # a row for each range that a group touches
    sofar = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.withColumn("__before", F.coalesce(sofar, F.lit(0))).drop("__n")
    own = ranged.withColumn("__own", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)))
    on = F.col("__part") == F.col("__p")
    renamed = before.select(F.col("__part").alias("__p"), "__before", *[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)])
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return own.join(renamed, on).withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).select(*rows.columns, name)
