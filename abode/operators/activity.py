"""Joins of listings with favourites, deposits and status; comparison; moderation.

All joins are inner equi-joins on ``house_id``. They are written without
hints: the planner broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at runtime) and uses a
sort-merge join otherwise. AQE splits skewed partitions, also where two joins on
``house_id`` follow each other (``session.split_skewed_joins``), so a listing
with a third of all favourites does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.functions import price as P
from abode.operators.catalog import property_view
from abode.schema import (
    POST_LABEL_APPROVED, POST_LABEL_PENDING, STATUS_PROCESSING, STATUS_SELLING,
)


def favorites_active(listings: DataFrame, favorites: DataFrame, status: DataFrame,
                     user_id: str | None = None) -> DataFrame:
    """Active listings a user marked (one row per favourite row: a bag)."""
    f = favorites if user_id is None else favorites.filter(F.col("user_id") == user_id)
    s = status.filter(F.col("statue") == STATUS_SELLING).select("house_id")
    return property_view(listings).join(f, "house_id").join(s, "house_id").orderBy("house_id", "user_id")


def favorites_all(listings: DataFrame, favorites: DataFrame, user_id: str | None = None) -> DataFrame:
    f = favorites if user_id is None else favorites.filter(F.col("user_id") == user_id)
    return property_view(listings).join(f, "house_id")


def my_deposits(listings: DataFrame, deposits: DataFrame, status: DataFrame,
                user_id: str | None = None) -> DataFrame:
    """Listings in processing that the user holds a deposit on."""
    d = deposits if user_id is None else deposits.filter(F.col("user_id") == user_id)
    s = status.filter(F.col("statue") == STATUS_PROCESSING).select("house_id")
    # the bag first: its join then reads two shuffles, which AQE can split
    return property_view(listings).join(d, "house_id").join(s, "house_id").orderBy("house_id", "user_id")


def processing_queue(listings: DataFrame, deposits: DataFrame, status: DataFrame) -> DataFrame:
    """All listings in processing, one row per depositor."""
    return my_deposits(listings, deposits, status, None)


def compare_pairs(active: DataFrame, pairs: DataFrame) -> DataFrame:
    """Side-by-side rows for requested (id_a, id_b) pairs.

    A pair yields a row only when both ids are distinct active listings (as the
    page requires exactly two rows). The pair batch is joined twice by key.
    """
    cols = ["house_id", "title", "district", "price_raw", "price_vnd", "area", "bedrooms",
            "bathrooms", "floors", "width_meters"]
    a = active.select(*[F.col(c).alias(f"a_{c}") for c in cols])
    b = active.select(*[F.col(c).alias(f"b_{c}") for c in cols])
    p = pairs.filter(F.col("id_a") != F.col("id_b"))
    return p.join(a, p.id_a == a.a_house_id).join(b, p.id_b == b.b_house_id)


def _gt(x: Column, y: Column) -> Column:
    return F.coalesce(x > y, F.lit(False))


def compare_flags(pairs: DataFrame) -> DataFrame:
    """Winner flags: lower price; larger area, bedrooms, bathrooms; floors and
    width only when both are non-zero. Strict: ties and nulls flag nobody."""
    out = pairs
    specs = [("price", "price_vnd", False, False), ("area", "area", True, False),
             ("bedrooms", "bedrooms", True, False), ("bathrooms", "bathrooms", True, False),
             ("floors", "floors", True, True), ("width", "width_meters", True, True)]
    for name, col, larger_wins, both_nonzero in specs:
        a, b = F.col(f"a_{col}"), F.col(f"b_{col}")
        fa, fb = (_gt(a, b), _gt(b, a)) if larger_wins else (_gt(b, a), _gt(a, b))
        if both_nonzero:
            shown = F.coalesce((a != 0) & (b != 0), F.lit(False))
            fa, fb = fa & shown, fb & shown
        out = out.withColumn(f"a_better_{name}", fa).withColumn(f"b_better_{name}", fb)
    return out


def price_per_m2(price_vnd: Column, area: Column) -> Column:
    """int(price / area), truncated toward zero; 0 price counts as 0."""
    billions = P.compare_raw_price(price_vnd)
    return F.try_divide(billions * F.lit(1e9), area).cast("bigint")


def compare_price_per_m2(pairs: DataFrame) -> DataFrame:
    a = price_per_m2(F.col("a_price_vnd"), F.col("a_area"))
    b = price_per_m2(F.col("b_price_vnd"), F.col("b_area"))
    return pairs.select("id_a", "id_b", a.alias("a_ppm2"), b.alias("b_ppm2"),
                        P.fmt_thousands(a).alias("a_ppm2_text"), P.fmt_thousands(b).alias("b_ppm2_text"),
                        _gt(b, a).alias("a_better_ppm2"), _gt(a, b).alias("b_better_ppm2"))


# ---- moderation views ----

def _newest_first() -> list[Column]:
    """Order of the lists of posts; the id settles equal dates."""
    return [F.desc("posting_date"), F.asc("house_id")]


def pending_view(pending: DataFrame) -> DataFrame:
    return pending.select(
        "house_id", "title", "district", P.fmt_price_ty("price_vnd", "price_raw").alias("price"),
        "area", "bedrooms", "bathrooms", "posting_date", "poster_id")


def my_posts_pending(pending: DataFrame, user_id: str | None = None) -> DataFrame:
    """Own pending posts (admin: all) with the literal 'Chờ phê duyệt' label."""
    p = pending if user_id is None else pending.filter(F.col("poster_id") == user_id)
    return pending_view(p).withColumn("status", F.lit(POST_LABEL_PENDING)).orderBy(*_newest_first())


def my_posts_approved(listings: DataFrame, status: DataFrame, user_id: str | None = None,
                      admin_limit: int = 50) -> DataFrame:
    """Own active listings ('Đã phê duyệt'); admin sees the newest 50."""
    s = status.filter(F.col("statue") == STATUS_SELLING)
    if user_id is not None:
        s = s.filter(F.col("poster_id") == user_id)
    out = listings.join(s.select("house_id", "poster_id"), "house_id").select(
        "house_id", "title", "district", P.fmt_price_ty("price_vnd", "price_raw").alias("price"),
        "area", "bedrooms", "bathrooms", "posting_date", "poster_id",
        F.lit(POST_LABEL_APPROVED).alias("status"))
    out = out.orderBy(*_newest_first())
    return out.limit(admin_limit) if user_id is None else out
