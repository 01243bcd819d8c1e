"""Aggregations: district statistics, counts per user / listing.

Every aggregate is algebraic (count, sum, avg, min), so Spark runs it as a
partial hash aggregate before the shuffle and a final one after: the shuffle
carries one row per key per partition, never the raw rows. A hot district is
therefore no skew problem: its rows are pre-aggregated map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def district_counts(active: DataFrame) -> DataFrame:
    return active.groupBy("district").agg(F.count(F.lit(1)).alias("listing_count"))


def district_counts_top10(active: DataFrame, n: int = 10) -> DataFrame:
    """Top districts by active listing count (ties broken by name)."""
    return district_counts(active).orderBy(F.col("listing_count").desc(), F.col("district").asc()).limit(n)


def district_avg_price(active: DataFrame) -> DataFrame:
    """Mean numeric price per district (billions, 2 places); text prices skipped."""
    priced = active.filter(F.col("price_vnd").isNotNull())
    return priced.groupBy("district").agg(
        F.sum("price_vnd").alias("_sum"), F.count(F.lit(1)).alias("priced_count")
    ).select("district", "priced_count",
             F.round(F.col("_sum").cast("double") / F.col("priced_count") / 1e9, 2).alias("avg_price_ty"))


def district_avg_price_top10(active: DataFrame, n: int = 10) -> DataFrame:
    return district_avg_price(active).orderBy(
        F.col("avg_price_ty").desc(), F.col("district").asc()).limit(n)


def total_count(df: DataFrame, name: str = "total") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def count_by(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
