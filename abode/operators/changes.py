"""Workflow changes as set-based table jobs: (current tables, request batch) -> new tables.

Row-by-row INSERT/UPDATE/DELETE statements become semi/anti joins, unions and
per-key aggregates over a whole batch of requests. The rules reproduce what
applying the requests one after another would leave behind:

* constraint checks (primary / foreign keys) are semi- and anti-joins;
* "last request wins" per listing is ``max_by`` over (ts, event_id), an
  aggregate with a map-side partial step (a hot listing is pre-aggregated);
* new ids continue the current maximum in request order (``ids.with_sequence``).

Each function returns plain DataFrames, so it can also run inside a streaming
``foreachBatch``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.functions.price import numeric_guard, price_input_normalise
from abode.operators.ids import max_numeric_id, with_sequence
from abode.schema import (
    DEFAULT_POSTER, LISTING_COLUMNS, STATUS_PENDING, STATUS_PROCESSING, STATUS_SELLING,
)

PAIR = ["user_id", "house_id"]


class DepositState(NamedTuple):
    status: DataFrame
    deposits: DataFrame


class PostState(NamedTuple):
    listings: DataFrame
    status: DataFrame
    pending: DataFrame


class UserState(NamedTuple):
    users: DataFrame
    favorites: DataFrame
    deposits: DataFrame


def _set_status(status: DataFrame, houses: DataFrame, new_status: str) -> DataFrame:
    """UPDATE status SET statue = new_status WHERE house_id IN houses."""
    hit = houses.select("house_id").distinct().withColumn("_hit", F.lit(True))
    return status.join(hit, "house_id", "left").select(
        "house_id",
        F.when(F.col("_hit"), F.lit(new_status)).otherwise(F.col("statue")).alias("statue"),
        "poster_id")


def add_favorites(favorites: DataFrame, users: DataFrame, listings: DataFrame,
                  batch: DataFrame) -> DataFrame:
    """Append requested (user, house) rows; duplicates kept; unknown keys rejected."""
    ok = batch.select(*PAIR).join(users.select("user_id"), "user_id", "left_semi") \
        .join(listings.select("house_id"), "house_id", "left_semi")
    return favorites.select(*PAIR).unionByName(ok.select(*PAIR))


def remove_favorites(favorites: DataFrame, batch: DataFrame) -> DataFrame:
    """Delete every favourite row matching a requested pair."""
    return favorites.join(batch.select(*PAIR).distinct(), PAIR, "left_anti")


def confirm_deposits(status: DataFrame, deposits: DataFrame, users: DataFrame,
                     listings: DataFrame, batch: DataFrame) -> DepositState:
    """Deposit requests: add the pair and set the listing to 'Đang xử lý'.

    A pair that already exists (primary key) or names an unknown user or
    listing (foreign keys) leaves everything unchanged, status included. The
    current status is not checked.
    """
    ok = batch.select(*PAIR).distinct() \
        .join(users.select("user_id"), "user_id", "left_semi") \
        .join(listings.select("house_id"), "house_id", "left_semi") \
        .join(deposits.select(*PAIR), PAIR, "left_anti")
    return DepositState(_set_status(status, ok, STATUS_PROCESSING),
                        deposits.select(*PAIR).unionByName(ok))


def cancel_deposits(status: DataFrame, deposits: DataFrame, batch: DataFrame) -> DepositState:
    """Delete the pairs; a requested listing left with no deposit goes back to
    'Đang bán', whatever its status and even if nothing was deleted."""
    left = deposits.select(*PAIR).join(batch.select(*PAIR).distinct(), PAIR, "left_anti")
    asked = batch.select("house_id").distinct()
    # distinct first: an anti-join cannot split a hot listing on its right side
    revert = asked.join(left.select("house_id").distinct(), "house_id", "left_anti")
    return DepositState(_set_status(status, revert, STATUS_SELLING), left)


def admin_cancel(status: DataFrame, deposits: DataFrame, houses: DataFrame) -> DepositState:
    """Drop every deposit of the listings and set them to 'Đang bán'."""
    h = houses.select("house_id")
    # an aggregate between shuffle and join would keep AQE from splitting hot deposits
    left = deposits.select(*PAIR).join(h, "house_id", "left_anti")
    return DepositState(_set_status(status, h, STATUS_SELLING), left)


def update_status(status: DataFrame, admins: DataFrame, batch: DataFrame) -> DataFrame:
    """Admin status changes; unknown admins are ignored; per listing the last
    request by (ts, event_id) wins; listings without a status row stay absent."""
    ok = batch.join(admins.select("admin_id"), "admin_id", "left_semi")
    last = ok.groupBy("house_id").agg(
        F.max_by("statue", F.struct("ts", "event_id")).alias("_new"))
    return status.join(last, "house_id", "left").select(
        "house_id", F.coalesce("_new", "statue").alias("statue"), "poster_id")


def buy_requests(status: DataFrame, users: DataFrame, batch: DataFrame) -> DataFrame:
    """A known user's buy request sets the listing to 'Đang xử lý'."""
    ok = batch.join(users.select("user_id"), "user_id", "left_semi")
    return _set_status(status, ok, STATUS_PROCESSING)


def _typed_posts(requests: DataFrame, posting_date: str) -> DataFrame:
    """Form posts (text fields as typed) -> typed listing columns.

    The form's rules, not those of scraped text: the price is VND as typed
    (commas dropped) or negotiable text, rooms and floors are integers as
    typed (0 stays 0), measures are plain numbers, a missing entrance width is
    0, and the date is that of the request.
    """
    text = price_input_normalise(F.col("price"))
    fields = {
        "title": F.col("title"), "address": F.col("address"), "district": F.col("district"),
        "posting_date": F.lit(posting_date), "post_type": F.col("post_type"),
        "price_raw": text, "price_vnd": numeric_guard(text),
        "area": F.col("area").try_cast("double"), "direction": F.coalesce("direction", F.lit("")),
        "bedrooms": F.col("bedrooms").try_cast("int"), "bathrooms": F.col("bathrooms").try_cast("int"),
        "floors": F.col("floors").try_cast("int"), "width_meters": F.col("width_meters").try_cast("double"),
        "legal": F.col("legal"), "interior": F.col("interior"),
        "entrancewidth": F.coalesce(F.col("entrancewidth").try_cast("double"), F.lit(0.0)),
    }
    return requests.select("request_order", "poster_id", *[e.alias(n) for n, e in fields.items()])


def new_pending_posts(pending: DataFrame, requests: DataFrame, posting_date: str) -> DataFrame:
    """The rows that user posts add to the pending table: the next 't%04d' ids
    in request order (numeric maximum of the current suffixes)."""
    start = max_numeric_id(pending, "house_id", prefix="t") + 1
    typed = with_sequence(_typed_posts(requests, posting_date), ["request_order"], start=start)
    return typed.select(
        F.concat(F.lit("t"), F.format_string("%04d", F.col("seq"))).alias("house_id"),
        *LISTING_COLUMNS[1:], F.lit(STATUS_PENDING).alias("statue"), "poster_id")


def submit_posts(pending: DataFrame, requests: DataFrame, posting_date: str) -> DataFrame:
    """The pending table with the new user posts."""
    new = new_pending_posts(pending, requests, posting_date)
    return pending.select(*new.columns).unionByName(new)


def new_admin_posts(ids: DataFrame, requests: DataFrame, posting_date: str,
                    admin_id: str = DEFAULT_POSTER) -> PostState:
    """The rows that admin posts add: listings with the next '%05d' ids after
    those of ``ids`` (house_id) and their status rows."""
    start = max_numeric_id(ids, "house_id") + 1
    typed = with_sequence(_typed_posts(requests, posting_date), ["request_order"], start=start)
    new = typed.withColumn("house_id", F.format_string("%05d", F.col("seq")))
    new_status = new.select("house_id", F.lit(STATUS_SELLING).alias("statue"),
                            F.lit(admin_id).alias("poster_id"))
    return PostState(new.select(*LISTING_COLUMNS), new_status, None)


def admin_posts(listings: DataFrame, status: DataFrame, requests: DataFrame, posting_date: str,
                admin_id: str = DEFAULT_POSTER) -> PostState:
    """Admin posts go live at once with the next '%05d' ids and a status row."""
    new = new_admin_posts(listings.select("house_id"), requests, posting_date, admin_id)
    return PostState(listings.select(*LISTING_COLUMNS).unionByName(new.listings),
                     status.select("house_id", "statue", "poster_id").unionByName(new.status), None)


def approve_posts(pending: DataFrame, listings: DataFrame, status: DataFrame,
                  batch: DataFrame, listing_ids: DataFrame | None = None) -> PostState:
    """Approved posts move to listings with new '%05d' ids (in pending-id order),
    get status 'Đang bán' with their poster (fallback 'admin') and leave pending.

    ``listing_ids``: a cheaper source of the listings' house_id, where there is one.
    """
    ids = batch.select("house_id").distinct()
    chosen = pending.join(ids, "house_id", "left_semi")
    start = max_numeric_id(listings if listing_ids is None else listing_ids, "house_id") + 1
    seq = with_sequence(chosen, ["house_id"], start=start)
    moved = seq.withColumn("house_id", F.format_string("%05d", F.col("seq")))
    new_status = moved.select("house_id", F.lit(STATUS_SELLING).alias("statue"),
                              F.coalesce(F.col("poster_id"), F.lit(DEFAULT_POSTER)).alias("poster_id"))
    return PostState(listings.select(*LISTING_COLUMNS).unionByName(moved.select(*LISTING_COLUMNS)),
                     status.select("house_id", "statue", "poster_id").unionByName(new_status),
                     pending.join(ids, "house_id", "left_anti"))


def reject_posts(pending: DataFrame, batch: DataFrame) -> DataFrame:
    return pending.join(batch.select("house_id").distinct(), "house_id", "left_anti")


def delete_users(users: DataFrame, favorites: DataFrame, deposits: DataFrame,
                 batch: DataFrame) -> UserState:
    """Remove users with their favourites and deposits (the intended cascade)."""
    gone = batch.select("user_id").distinct()
    return UserState(users.join(gone, "user_id", "left_anti"),
                     favorites.join(gone, "user_id", "left_anti"),
                     deposits.join(gone, "user_id", "left_anti"))


def register_users(users: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert only ids not taken yet; within the batch the first request wins."""
    first = batch.groupBy("user_id").agg(
        F.min_by(F.struct("username", "phone"), F.struct("ts", "event_id")).alias("_u"))
    new = first.join(users.select("user_id"), "user_id", "left_anti") \
        .select("user_id", "_u.username", "_u.phone")
    return users.select("user_id", "username", "phone").unionByName(new)
