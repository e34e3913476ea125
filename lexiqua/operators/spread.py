"""Rows over tasks: as many tasks as there are rows for, and places in an order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group whose order cuts it into buckets; a power of two.
BOUNDS = 256


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by a hash of ``keys`` in as many tasks as have about ``rows`` rows each, whatever files it comes from: a small file may
    hold millions of rows, and one task would read them all. As it is, if there are no more than ``rows``."""
    parts = -(-df.count() // rows)
    return df.repartition(parts, *keys) if parts > 1 else df


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of each row in its group's ascending ``order``, from 1; nulls come first, rows equal in ``order`` in any order.

    The ``BOUNDS`` rows of a group with the lowest hashes cut its order into buckets: a row's number is the rows of the buckets before
    and its number inside its own. So a group of any size is many tasks, and what is kept for a group is short.
    """
    placed = df.withColumn("_order", F.struct(*order)).withColumn("_group", F.struct(F.lit(0).alias("_all"), *by))
    low = F.row_number().over(Window.partitionBy("_group").orderBy(F.xxhash64("_order"), "_order"))
    bounds = placed.select("_group", "_order").withColumn("_n", low).filter(F.col("_n") <= BOUNDS)
    bounds = bounds.groupBy(F.col("_group").alias("_of")).agg(F.array_sort(F.collect_list("_order")).alias("_bounds"))
    steps = [BOUNDS >> i for i in range(BOUNDS.bit_length())]
    passed = lambda at, step: F.when(F.get("_bounds", at + step - 1) <= F.col("_order"), at + step).otherwise(at)
    rows = placed.join(F.broadcast(bounds), F.col("_group") == F.col("_of")).withColumn("_bucket", F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), passed)).drop("_of", "_bounds")
    sums = rows.groupBy("_group", "_bucket").agg(F.count("*").alias("_rows"))
    ahead = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_group").alias("_of"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_group", "_bucket").orderBy("_order"))
    joined = rows.withColumn("_inside", inside).join(F.broadcast(sums), (F.col("_group") == F.col("_of")) & (F.col("_bucket") == F.col("_at")))
    return joined.select(*df.columns, (F.col("_ahead") + F.col("_inside")).alias(name))
