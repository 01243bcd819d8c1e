"""Catalogue queries: active listings, filters, search, sort orders, paging.

Paging is ``orderBy(...).offset(o).limit(n)``: Catalyst plans it as a
``TakeOrderedAndProject`` with offset (per-partition top-(o+n), then a final
merge), so a page never sorts or shuffles the whole table. Deep pages can use
``keyset_page`` instead (a filter on the last seen key + top-n).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.functions import price as P
from abode.functions.price import MONEY
from abode.schema import (
    NO_INFO, PRICE_SORT_HIGH_SENTINEL, PRICE_SORT_LOW_SENTINEL, STATUS_SELLING,
)

LIST_COLUMNS = ["house_id", "title", "district", "price", "price_vnd", "area", "bedrooms",
                "bathrooms"]


def property_view(listings: DataFrame) -> DataFrame:
    """The typed 7-column projection shown in lists (+ numeric price)."""
    return listings.select(
        "house_id", "title", "district",
        P.fmt_price_ty("price_vnd", "price_raw").alias("price"),
        F.col("price_vnd").cast("double").alias("price_vnd"),
        "area", "bedrooms", "bathrooms")


def join_listing_status(listings: DataFrame, status: DataFrame) -> DataFrame:
    """listing JOIN status on house_id (inner: listings without status vanish)."""
    return listings.join(status, "house_id", "inner")


def active_listings(listings: DataFrame, status: DataFrame) -> DataFrame:
    """Listings whose status is 'Đang bán' (filter pushed below the join)."""
    s = status.filter(F.col("statue") == STATUS_SELLING)
    return listings.join(s, "house_id", "inner")


def page(df: DataFrame, order: list[Column], page_no: int = 1, per_page: int = 10) -> DataFrame:
    """LIMIT/OFFSET page; ``order`` must end with a unique key for stable pages."""
    offset = max(page_no - 1, 0) * per_page
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(per_page)


def keyset_page(df: DataFrame, key: str, after: str | None, per_page: int = 10) -> DataFrame:
    """Page after a known last key: a pushed-down filter plus a top-n."""
    if after is not None:
        df = df.filter(F.col(key) > F.lit(after))
    return df.orderBy(F.col(key).asc()).limit(per_page)


def count_pages(df: DataFrame, per_page: int = 10) -> DataFrame:
    """Row count and number of pages = ceil(count / per_page)."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", ((F.col("total") + per_page - 1) / per_page).cast("bigint").alias("total_pages"))


def ilike_any(cols: list[str], fragment: str, literal: bool = False) -> Column:
    """Case-blind substring match on any of ``cols`` ('%'/'_' are wildcards
    unless ``literal``)."""
    if literal:
        fragment = fragment.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    pat = f"%{fragment}%"
    cond = None
    for c in cols:
        m = F.col(c).ilike(pat)
        cond = m if cond is None else (cond | m)
    return cond


def filter_area(listings: DataFrame, fragment: str) -> DataFrame:
    return listings.filter(F.col("district").ilike(f"%{fragment}%"))


def _money(vnd: float) -> Column:
    """A DECIMAL literal, so that the money column is compared as it is stored."""
    return F.lit(Decimal(str(vnd))).cast(MONEY)


def filter_price(listings: DataFrame, low_vnd: float, high_vnd: float) -> DataFrame:
    v = F.col("price_vnd")
    return listings.filter((v >= _money(low_vnd)) & (v <= _money(high_vnd)))


def filter_area_price(listings: DataFrame, fragment: str, low_vnd: float, high_vnd: float) -> DataFrame:
    return filter_price(filter_area(listings, fragment), low_vnd, high_vnd)


def find_text(listings: DataFrame, fragment: str) -> DataFrame:
    return listings.filter(ilike_any(["title", "address", "house_id"], fragment))


def search_filter(active: DataFrame, q: str = "", district: str = "", price_min: str | float = "",
                  price_max: str | float = "", area_min: str | float = "", area_max: str | float = "",
                  bedrooms: str | int = "", literal: bool = False) -> DataFrame:
    """Optional filters, each skipped when empty, all ANDed; prices in billions."""
    df = active
    if q:
        df = df.filter(ilike_any(["title", "district", "house_id"], q, literal))
    if district:
        df = df.filter(F.col("district") == F.lit(district))
    if price_min not in ("", None):
        df = df.filter(F.col("price_vnd") >= _money(float(price_min) * 1e9))
    if price_max not in ("", None):
        df = df.filter(F.col("price_vnd") <= _money(float(price_max) * 1e9))
    if area_min not in ("", None):
        df = df.filter(F.col("area") >= F.lit(float(area_min)))
    if area_max not in ("", None):
        df = df.filter(F.col("area") <= F.lit(float(area_max)))
    if bedrooms not in ("", None):
        df = df.filter(F.col("bedrooms") >= F.lit(int(bedrooms)))
    return df


def sort_order(sort_by: str) -> list[Column]:
    """Sort keys of the search page; unknown keys fall back to id ascending.

    Every order ends with house_id so pages are stable. Null order is stated
    explicitly (the store sorts nulls first in descending order).
    """
    hid = F.col("house_id")
    v = F.col("price_vnd")
    if sort_by == "newest":
        return [hid.desc()]
    if sort_by == "price_low":
        return [F.coalesce(v, F.lit(PRICE_SORT_HIGH_SENTINEL).cast("decimal(20,2)")).asc(), hid.asc()]
    if sort_by == "price_high":
        return [F.coalesce(v, F.lit(PRICE_SORT_LOW_SENTINEL).cast("decimal(20,2)")).desc(), hid.asc()]
    if sort_by == "area_large":
        return [F.col("area").desc_nulls_first(), hid.asc()]
    return [hid.asc()]


def search_listings(active: DataFrame, sort_by: str = "house_id", page_no: int = 1,
                    per_page: int = 10, **filters) -> DataFrame:
    return page(property_view(search_filter(active, **filters)), sort_order(sort_by),
                page_no, per_page)


def distinct_districts(active: DataFrame, collation: str | None = None) -> DataFrame:
    """Districts with active listings, sorted. Binary order by default; a
    collation (e.g. 'vi' or 'UNICODE_CI') gives language-aware order."""
    key = F.col("district") if collation is None else F.collate("district", collation)
    return active.select("district").distinct().orderBy(key)


def lookup_by_ids(listings: DataFrame, ids: DataFrame) -> DataFrame:
    """Detail rows for a batch of ids (semi-join; AQE broadcasts a small id list)."""
    return listings.join(ids.select("house_id").distinct(), "house_id", "left_semi")


def detail_unpivot(listings: DataFrame) -> DataFrame:
    """Detail as (house_id, column, value) rows, null shown as 'Không có thông tin'."""
    shown = [c for c in listings.columns if c not in ("house_id", "price_vnd", "price_raw")]
    df = listings.select(
        "house_id",
        P.fmt_price_plain("price_vnd", "price_raw").alias("price"),
        *[F.col(c).cast("string").alias(c) for c in shown])
    value_cols = ["price"] + shown
    long = df.unpivot("house_id", value_cols, "column_name", "value")
    return long.withColumn("value", F.coalesce(F.col("value"), F.lit(NO_INFO)))


def anycol_contains(df: DataFrame, cols: list[str], fragment: str) -> DataFrame:
    """Case-blind substring over every shown column (as the table filter does)."""
    joined = F.lower(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    return df.filter(joined.contains(fragment.lower()))
