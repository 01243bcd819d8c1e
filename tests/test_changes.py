"""Properties of the set-based change jobs, dedup and sequential ids."""
import pytest
from pyspark.sql import functions as F

from abode.operators import changes as X
from abode.operators.dedup import dedup_title_keep_min_id
from abode.operators.ids import max_numeric_id, with_sequence
from abode.schema import STATUS_PROCESSING, STATUS_SELLING
from abode.sources.tpch_binding import ListingTables
from tests.conftest import SF_SMALL


def bag(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def t(spark):
    return ListingTables(spark, SF_SMALL)


def test_dedup_idempotent(t):
    once = dedup_title_keep_min_id(t.listings)
    assert bag(dedup_title_keep_min_id(once)) == bag(once)
    assert once.count() == t.listings.select("title").distinct().count()


def test_add_then_remove_favorites(t):
    batch = t.batch_add_favorites()
    added = X.add_favorites(t.favorites, t.users, t.listings, batch)
    assert bag(X.remove_favorites(added, batch)) == bag(X.remove_favorites(t.favorites, batch))


def test_confirm_then_cancel_restores_deposits(spark, t):
    fresh = t.batch_confirm_deposits().join(t.deposits, ["user_id", "house_id"], "left_anti")
    state = X.confirm_deposits(t.listing_status, t.deposits, t.users, t.listings, fresh)
    confirmed = state.deposits.join(t.deposits, ["user_id", "house_id"], "left_anti")
    assert confirmed.count() > 0
    st = {r["house_id"]: r["statue"] for r in state.status.collect()}
    assert all(st[r["house_id"]] == STATUS_PROCESSING for r in confirmed.collect() if r["house_id"] in st)
    back = X.cancel_deposits(state.status, state.deposits, confirmed)
    assert bag(back.deposits) == bag(t.deposits)


def test_repeated_deposit_is_noop(t):
    again = t.deposits.limit(50)
    state = X.confirm_deposits(t.listing_status, t.deposits, t.users, t.listings, again)
    assert bag(state.deposits) == bag(t.deposits)
    assert bag(state.status) == bag(t.listing_status)


def test_update_status_last_wins_and_unknown_admin_ignored(spark, t):
    hid = t.listing_status.orderBy("house_id").first()["house_id"]
    batch = spark.createDataFrame(
        [("admin", hid, "Đã bán", "2024-01-01 00:00:01", 1), ("admin", hid, "Đang xử lý", "2024-01-01 00:00:02", 2),
         ("nobody", hid, "Đang bán", "2024-01-01 00:00:03", 3)],
        "admin_id string, house_id string, statue string, ts string, event_id long") \
        .withColumn("ts", F.to_timestamp("ts"))
    out = {r["house_id"]: r["statue"] for r in X.update_status(t.listing_status, t.admins, batch).collect()}
    assert out[hid] == "Đang xử lý"
    assert len(out) == t.listing_status.count()


def test_admin_cancel_clears_deposits(t):
    houses = t.batch_admin_cancel()
    state = X.admin_cancel(t.listing_status, t.deposits, houses)
    hit = {r[0] for r in houses.collect()}
    assert not ({r["house_id"] for r in state.deposits.collect()} & hit)
    st = {r["house_id"]: r["statue"] for r in state.status.collect()}
    assert all(st[h] == STATUS_SELLING for h in hit if h in st)


def test_sequence_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"))
    out = with_sequence(df, ["k"], start=5).orderBy("k").collect()
    assert [r["seq"] for r in out] == list(range(5, 1005))


def test_max_numeric_id_is_numeric_not_text(spark):
    df = spark.createDataFrame([("t9999",), ("t10000",), ("x5",)], "house_id string")
    assert max_numeric_id(df, "house_id", prefix="t") == 10000


def test_approve_and_reject_are_consistent(t):
    state = X.approve_posts(t.pending_listings, t.listings, t.listing_status, t.batch_approve())
    n_app = t.batch_approve().count()
    assert state.listings.count() == t.listings.count() + n_app
    assert state.pending.count() == t.pending_listings.count() - n_app
    new_ids = state.listings.join(t.listings, "house_id", "left_anti")
    start = max_numeric_id(t.listings) + 1
    assert sorted(int(r[0]) for r in new_ids.select("house_id").collect()) == list(range(start, start + n_app))


def test_form_posts_are_stored_as_typed(spark):
    row = dict(request_order=1, title="t", address="a", district="d", post_type="Bán", price="5,500,000,000", area="33.33",
               direction=None, bedrooms="0", bathrooms="2", floors="3", width_meters="4.5", legal="l", interior="i",
               entrancewidth=None, poster_id="u1")
    req = spark.createDataFrame([row, dict(row, request_order=2, price="120"), dict(row, request_order=3, price="Thỏa thuận")],
                                ", ".join(f"{k} {'long' if k == 'request_order' else 'string'}" for k in row))
    ids = spark.createDataFrame([("00009",), ("99999999999999999999",), ("x",)], "house_id string")
    got = X.new_admin_posts(ids, req, "2025-01-02").listings.orderBy("house_id").collect()
    assert [r["house_id"] for r in got] == ["00010", "00011", "00012"]
    assert [r["price_vnd"] for r in got] == [5500000000, 120, None]
    assert [r["price_raw"] for r in got] == ["5500000000", "120", "Thỏa thuận"]
    assert (got[0]["bedrooms"], got[0]["area"], got[0]["entrancewidth"], got[0]["posting_date"]) == (0, 33.33, 0.0, "2025-01-02")
