"""File sources and sinks: raw listing CSV, typed parquet tables.

Intermediate tables go to a fresh folder under the shared
``spark.checkpoint.dir`` (never a machine-local temp folder), so every
executor sees them and a lost executor can re-read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.operators.ids import with_sequence
from abode.schema import RAW_COLUMNS, RAW_SCHEMA
from abode.session import scratch_path
from abode.sources.split_csv import read_split_csv


def read_raw_csv(spark: SparkSession, path: str, schema=RAW_SCHEMA) -> DataFrame:
    """Headered listing CSV, every column text (no inference), '"' quoting."""
    return spark.read.schema(schema).option("header", True).option("quote", '"') \
        .option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_raw_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"') \
        .option("escape", '"').csv(path)


def read_listings_csv(spark: SparkSession, path: str) -> DataFrame:
    """A scraped listings file (or folder of them): the 15 columns by header name, as text, and row_ordinal.

    Headers are trimmed, may stand in any order and among others that are
    ignored; a missing column is null. Quoted fields may hold line breaks; a file
    is read by as many tasks as it has byte ranges (``split_csv``).
    Rows are numbered from 0 in the order of files and of rows in them, without
    a global window; rows keep their number when others are dropped later.
    """
    df = read_split_csv(spark, path, RAW_COLUMNS)
    return with_sequence(df, ["file", "block", "line"], 0, "row_ordinal").select("row_ordinal", *RAW_COLUMNS)


def write_listings_csv(raw: DataFrame) -> str:
    """The raw columns under their plain headers, in row_ordinal order; returns the folder."""
    path = scratch_path(raw.sparkSession, "listings_csv")
    write_raw_csv(raw.orderBy("row_ordinal").select(*RAW_COLUMNS), path)
    return path


def csv_round_trip_padded_header(raw: DataFrame) -> DataFrame:
    """Scraped headers carry blanks (' Price '); read by header, then trim."""
    from abode.operators.clean import trim_columns

    spark = raw.sparkSession
    path = scratch_path(spark, "raw_csv_padded")
    write_raw_csv(raw.toDF(*[f" {c} " for c in raw.columns]), path)
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    df = trim_columns(df)
    return df.withColumn("row_ordinal", F.col("row_ordinal").cast("bigint"))


def write_table(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return path


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite the table with new content (the loader's replace mode)."""
    df.write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


TRAIN_FEATURES = ["area", "bedrooms", "bathrooms", "floors", "width_meters"]


def training_table(spark: SparkSession, listings_path: str) -> DataFrame:
    """Features + numeric price read from the stored listings.

    The null guards are pushed into the parquet scan (PushedFilters) and only
    the six needed columns are read (ReadSchema).
    """
    df = spark.read.parquet(listings_path)
    cond = F.col("price_vnd").isNotNull()
    for c in TRAIN_FEATURES:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond).select("house_id", *TRAIN_FEATURES,
                                  F.col("price_vnd").cast("double").alias("price"))
