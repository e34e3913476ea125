"""Closed intervals: stabbing, overlap and best overlap, joined by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_fraction(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length over the length of the hull, both ends counted; 0 if apart."""
    shared = F.least(e1, e2) - F.greatest(s1, s2) + 1
    return F.when(shared <= 0, 0.0).otherwise(shared / (F.greatest(e1, e2) - F.least(s1, s2) + 1))


def stabbed(df: DataFrame, point: int, start: str = "start", end: str = "end") -> DataFrame:
    return df.filter(F.lit(point).between(F.col(start), F.col(end)))


def overlap_join(a: DataFrame, b: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose intervals (columns ``start, end``) meet, ``b``'s columns after ``a``'s with ``b_`` before their names.

    Both sides go to the bins of ``width`` that they reach, and meet in the first bin that they share, so each pair comes
    once and no pair of other bins is looked at. Intervals of one row or with an end before the start meet nothing.
    """
    keys = keys or []
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_bin")
    left = a.filter("start <= end").select("*", bins())
    right = b.filter("start <= end").select("*", bins())
    right = right.select(*(F.col(c).alias(f"b_{c}" if c != "_bin" else "_bin2") for c in right.columns))
    on = (F.col("_bin") == F.col("_bin2")) & (F.col("start") <= F.col("b_end")) & (F.col("b_start") <= F.col("end")) & (F.col("_bin") == F.floor(F.greatest("start", "b_start") / width))
    for k in keys:
        on = on & (F.col(k) == F.col(f"b_{k}"))
    return left.join(right, on).drop("_bin", "_bin2")


def best_overlap(pairs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of each group the pair that overlaps most; ties take the first in ``order``."""
    scored = pairs.withColumn("overlap", overlap_fraction(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("overlap"), *order))
    return scored.withColumn("_n", first).filter("_n = 1").drop("_n")


def year_range(text: Column) -> Column:
    """The smallest and largest whole number of up to four digits in a text; a dash before one is its sign."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d{1,4})"), F.lit(1)), lambda y: y.cast("int"))
    return F.when(F.size(years) > 0, F.struct(F.array_min(years).alias("start"), F.array_max(years).alias("end")))
