"""Duplicate removal by title and the cascade to child tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Survivors(NamedTuple):
    favorites: DataFrame
    deposits: DataFrame
    status: DataFrame


def dedup_title_keep_min_id(listings: DataFrame) -> DataFrame:
    """Keep, per title, only the row with the smallest id (text order); null
    titles form one group.

    The aggregate works on two columns with map-side partial minima, so a title
    repeated across a third of the table costs one row per partition; the rows
    of the surviving ids (unique) follow by a semi-join.
    """
    keep = listings.groupBy("title").agg(F.min("house_id").alias("house_id")).select("house_id")
    return listings.join(keep, "house_id", "left_semi")


def dedup_cascade(survivors: DataFrame, favorites: DataFrame, deposits: DataFrame,
                  status: DataFrame) -> Survivors:
    """Child rows of removed (or never loaded) listings disappear."""
    keep = survivors.select("house_id")
    return Survivors(favorites.join(keep, "house_id", "left_semi"),
                     deposits.join(keep, "house_id", "left_semi"),
                     status.join(keep, "house_id", "left_semi"))
