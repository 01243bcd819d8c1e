"""Data-quality rules (the posting and registration form checks) as columns.

Each rule yields its name when it fails; ``concat_ws`` skips the passing
(null) ones, so one projection gives the failed-rule list of every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.functions import price as P
from abode.schema import (
    DIRECTIONS, HANOI_DISTRICTS, INTERIOR_OPTIONS, LEGAL_OPTIONS, NEGOTIABLE, PHONE_PATTERN,
    POST_TYPES, USER_ID_PATTERN,
)


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def listing_rules() -> list[tuple[str, Column]]:
    v = F.col("price_vnd")
    price_ok = (v > 0) | F.col("price_raw").isin(*NEGOTIABLE)
    return [
        ("price_invalid", ~F.coalesce(price_ok, F.lit(False))),
        ("area_not_positive", ~F.coalesce(F.col("area") > 0, F.lit(False))),
        ("width_not_positive", ~F.coalesce(F.col("width_meters") > 0, F.lit(False))),
        ("bedrooms_below_1", ~F.coalesce(F.col("bedrooms") >= 1, F.lit(False))),
        ("bathrooms_below_1", ~F.coalesce(F.col("bathrooms") >= 1, F.lit(False))),
        ("floors_below_1", ~F.coalesce(F.col("floors") >= 1, F.lit(False))),
        ("entrance_negative", F.coalesce(F.col("entrancewidth") < 0, F.lit(False))),
        ("missing_required", _blank("title") | _blank("address") | _blank("district")
         | _blank("post_type") | _blank("price_raw") | _blank("legal") | _blank("interior")),
        ("post_type_unknown", ~F.coalesce(F.col("post_type").isin(*POST_TYPES), F.lit(False))),
        ("direction_unknown", ~(F.col("direction").isNull() | (F.col("direction") == "")
                                | F.col("direction").isin(*DIRECTIONS))),
        ("legal_unknown", ~F.coalesce(F.col("legal").isin(*LEGAL_OPTIONS), F.lit(False))),
        ("interior_unknown", ~F.coalesce(F.col("interior").isin(*INTERIOR_OPTIONS), F.lit(False))),
        ("district_unknown", ~F.coalesce(F.col("district").isin(*HANOI_DISTRICTS), F.lit(False))),
    ]


def user_rules() -> list[tuple[str, Column]]:
    return [
        ("user_id_invalid", ~F.coalesce(F.col("user_id").rlike(USER_ID_PATTERN), F.lit(False))),
        ("phone_invalid", ~F.coalesce(F.col("phone").cast("string").rlike(PHONE_PATTERN), F.lit(False))),
        ("name_missing", _blank("username")),
    ]


def failed_rules(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    reasons = F.concat_ws(",", *[F.when(cond, F.lit(name)) for name, cond in rules])
    n = sum((F.when(cond, 1).otherwise(0) for _, cond in rules), F.lit(0))
    return df.select(key, reasons.alias("failed_rules"), n.cast("int").alias("n_failed"))


def dq_listings(listings: DataFrame) -> DataFrame:
    return failed_rules(listings, "house_id", listing_rules())


def dq_users(users: DataFrame) -> DataFrame:
    return failed_rules(users, "user_id", user_rules())


def dq_raw_prices(raw: DataFrame) -> DataFrame:
    """Raw sale rows whose price is cleaned to null although it is not negotiable, with the reason:
    text that cannot be read, or a value beyond the money type."""
    reason = F.when(P.price_unparsable("Price"), "price_unparsable") \
        .when(P.price_out_of_range("Price", "Area"), "price_out_of_range")
    return raw.filter(~P.is_monthly_rent("Price")).withColumn("reason", reason) \
        .filter("reason is not null").select("row_ordinal", "Price", "reason")
