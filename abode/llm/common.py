"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.session import drop_scratch, scratch_path

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WHITE_SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. The folder may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column that a lambda refers to may be inlined into the lambda and so be
    computed again for each element; a lambda variable never is.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words (runs without white space) of a text; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SPACE))
    return F.when(body == "", F.array().cast("array<string>")) \
        .otherwise(F.split(body, WHITE_SPACE_CLASS + "+"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64-bit key of a row's id and text, the same in every scan of the table.

    Rows that are equal in both share it. The key spreads null and repeated ids.
    """
    return F.xxhash64(F.col(doc_id), F.col(text))


def hash_cut(rows: int, wanted: int) -> int:
    """Bound for a 64-bit hash that about ``wanted`` of ``rows`` rows fall below: a sample without a sort."""
    share = min(1.0, wanted / rows) if rows else 0.0
    return min(int(share * 2.0 ** 64) - 2 ** 63, 2 ** 63 - 1)


class Scratch:
    """Intermediate tables of one operator call, in the shared checkpoint folder.

    A written table cuts the lineage: a lost executor re-reads it, and no later
    job computes it again. ``drop`` removes what is no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, name)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            drop_scratch(self.spark, f"{self.base}/{name}")
