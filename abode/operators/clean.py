"""Cleaning of raw listing text into the typed listings table.

Each rule is a column expression; ``clean_listings`` chains them into one
projection (plus the rent filter), so the whole pipeline is a single narrow
stage right after the scan: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.functions import price as P
from abode.schema import INTERIOR_DEFAULT, LEGAL_DEFAULT, UNIT_BILLION, UNIT_FLOOR, UNIT_ROOM


def trim_columns(df: DataFrame) -> DataFrame:
    """Strip blanks around column names (headers of scraped CSVs carry them)."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_monthly(df: DataFrame) -> DataFrame:
    """Drop rent listings (price text containing '/tháng'); null price is kept."""
    return df.filter(~P.is_monthly_rent("Price"))


def with_surrogate_id(df: DataFrame, ordinal: str = "row_ordinal") -> DataFrame:
    """house_id = '%05d' of (input row ordinal + 1); dropped rows leave gaps."""
    return df.withColumn("house_id", surrogate_id(ordinal))


def surrogate_id(ordinal: str = "row_ordinal") -> Column:
    return F.format_string("%05d", F.col(ordinal) + 1)


def clean_columns(df: DataFrame, strict_text: bool = False) -> dict:
    """The cleaning rules as named column expressions over the raw columns.

    ``strict_text`` reproduces the stored-text behaviour of the original
    loader: a 'tỷ' price was kept as scientific-notation text, which the
    numeric guard rejects, so such prices get no numeric value.
    """
    area_dec = P.area_decimal("Area")
    price = P.price_vnd("Price", area_dec)
    if strict_text:
        price = F.when(F.col("Price").contains(UNIT_BILLION), F.lit(None).cast("decimal(20,2)")) \
            .otherwise(price)
    return {
        "title": F.col("Title"),
        "address": F.col("Address"),
        "district": F.col("District"),
        "posting_date": F.col("PostingDate"),
        "post_type": F.col("PostType"),
        "price_raw": F.col("Price"),
        "price_vnd": price,
        "area": P.area_value("Area"),
        "direction": F.col("Direction"),
        "bedrooms": P.count_value("Bedrooms", UNIT_ROOM),
        "bathrooms": P.count_value("Bathrooms", UNIT_ROOM),
        "floors": P.count_value("Floors", UNIT_FLOOR),
        "width_meters": P.width_value("Width_meters"),
        "legal": F.when(F.col("Legal") == "0", F.lit(LEGAL_DEFAULT)).otherwise(F.col("Legal")),
        "interior": F.when(F.col("Interior") == "0", F.lit(INTERIOR_DEFAULT)).otherwise(F.col("Interior")),
        "entrancewidth": P.width_value("Entrancewidth", zero_is_null=True),
    }


def clean_listings(raw: DataFrame, keep: list[str] | None = None, strict_text: bool = False) -> DataFrame:
    """Raw scraped rows -> typed listings, id column first.

    ``raw`` carries the 15 text columns and ``row_ordinal``. Columns named in
    ``keep`` are passed through after the listing columns.
    """
    raw = drop_monthly(trim_columns(raw))
    exprs = clean_columns(raw, strict_text)
    cols = [surrogate_id().alias("house_id")]
    cols += [e.alias(name) for name, e in exprs.items()]
    cols += [F.col(c) for c in (keep or [])]
    return raw.select(*cols)


def clean_step(raw: DataFrame, column: str) -> DataFrame:
    """One cleaning rule in isolation: (house_id, raw text, cleaned value)."""
    raw = drop_monthly(trim_columns(raw))
    exprs = clean_columns(raw)
    return raw.select(surrogate_id().alias("house_id"),
                      exprs[column].alias(column))
