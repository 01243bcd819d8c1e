"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver's tables (through ``ListingTables``) and runs
over whole tables; parameters are the request values of the application
(page numbers, a search text, a user id), never row caps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.functions import price as P
from abode.functions import quality as Q
from abode.functions.text import truncate
from abode.operators import activity as A
from abode.operators import catalog as C
from abode.operators import changes as X
from abode.operators import request_log
from abode.operators import stats as S
from abode.operators.clean import clean_step, drop_monthly, with_surrogate_id
from abode.operators.dedup import dedup_cascade, dedup_title_keep_min_id
from abode.schema import UNIT_BILLION
from abode.sources.tpch_binding import ListingTables, house_id_of

# --- request parameters of the checked queries ---
PAGE = 2
PER_PAGE = 10
TEXT = "machinery"
DISTRICT = "NATION_3"
DISTRICT_FRAGMENT = "nation_1"
PRICE_LOW_TY, PRICE_HIGH_TY = 1, 4
AREA_MIN, AREA_MAX = 50, 150
BEDROOMS_MIN = 2
COMBINED = {"q": TEXT, "price_min": PRICE_LOW_TY, "price_max": PRICE_HIGH_TY, "area_min": AREA_MIN,
            "area_max": AREA_MAX, "bedrooms": BEDROOMS_MIN}
USER = "u7"
ANYCOL_PROCESSING = "nation_2"
ANYCOL_USERS = "#00000012"
ADMIN_ID = "admin"
KEYSET_AFTER = "01000"
POSTING_DATE = "2025-06-01"
POSTERS = ["u7", "u131", "u222"]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def T(spark: SparkSession, sf_dir: str) -> ListingTables:
    return ListingTables(spark, sf_dir)


def listing_out(df: DataFrame) -> DataFrame:
    """Listing columns with the money column as DOUBLE for output."""
    return df.select(*[F.col(c).cast("double").alias(c) if c == "price_vnd" else F.col(c)
                       for c in df.columns])


def _combined(t: ListingTables) -> DataFrame:
    return C.search_filter(t.active, **COMBINED)


def _compare_batch(t: ListingTables) -> DataFrame:
    """Comparison requests: every listing against the one ten orders later."""
    o = t.read("orders", ["o_orderkey"])
    return o.select(house_id_of(F.col("o_orderkey")).alias("id_a"),
                    house_id_of(F.col("o_orderkey") + 10).alias("id_b"))


# ---------------- 2.1 sources and sinks ----------------
from abode.sources import files as SRC  # noqa: E402


@query("src_raw_listings")
def q_src_raw_listings(spark, sf_dir):
    """A listings file with the 15 headers only; rows are numbered in file order."""
    path = SRC.write_listings_csv(T(spark, sf_dir).raw_listings)
    return SRC.read_listings_csv(spark, path)


@query("src_trim_columns")
def q_src_trim_columns(spark, sf_dir):
    return SRC.csv_round_trip_padded_header(T(spark, sf_dir).raw_listings)


@query("src_training_table")
def q_src_training_table(spark, sf_dir):
    path = SRC.write_table(T(spark, sf_dir).listings, "listings")
    return SRC.training_table(spark, path)


@query("sink_replace_table")
def q_sink_replace_table(spark, sf_dir):
    t = T(spark, sf_dir)
    path = SRC.write_table(t.raw_listings, "listings_replace")
    SRC.replace_table(t.listings, path)
    return listing_out(spark.read.parquet(path))


@query("view_property")
def q_view_property(spark, sf_dir):
    C.property_view(T(spark, sf_dir).listings).createOrReplaceTempView("property")
    return spark.sql("SELECT * FROM property")


@query("sink_append_rows")
def q_sink_append_rows(spark, sf_dir):
    t = T(spark, sf_dir)
    path = SRC.write_table(t.listings, "listings_append")
    ids = spark.read.parquet(path).select("house_id")
    new = X.new_admin_posts(ids, t.batch_post_requests(4), POSTING_DATE, ADMIN_ID)
    SRC.append_rows(new.listings, path)
    return listing_out(spark.read.parquet(path))


# ---------------- 2.2 cleaning ----------------
@query("clean_drop_monthly")
def q_clean_drop_monthly(spark, sf_dir):
    return drop_monthly(T(spark, sf_dir).raw_listings).select("row_ordinal", "Price")


@query("clean_price_ty")
def q_clean_price_ty(spark, sf_dir):
    l = T(spark, sf_dir).listings
    return listing_out(l.filter(F.col("price_raw").contains(UNIT_BILLION))
                       .select("house_id", "price_raw", "price_vnd"))


@query("clean_price_plain")
def q_clean_price_plain(spark, sf_dir):
    l = T(spark, sf_dir).listings.filter(~F.col("price_raw").contains(UNIT_BILLION))
    return l.select("house_id", "price_raw", P.plain_number("price_raw").cast("double").alias("price_number"))


@query("clean_price_per_m2")
def q_clean_price_per_m2(spark, sf_dir):
    l = T(spark, sf_dir).listings
    return listing_out(l.filter(~F.col("price_raw").contains(UNIT_BILLION) & F.col("price_vnd").isNotNull())
                       .select("house_id", "price_raw", "area", "price_vnd"))


@query("clean_area")
def q_clean_area(spark, sf_dir):
    return clean_step(T(spark, sf_dir).raw_listings, "area")


@query("clean_room_counts")
def q_clean_room_counts(spark, sf_dir):
    return T(spark, sf_dir).listings.select("house_id", "bedrooms", "bathrooms", "floors")


@query("clean_category_defaults")
def q_clean_category_defaults(spark, sf_dir):
    return T(spark, sf_dir).listings.select("house_id", "legal", "interior")


@query("clean_widths")
def q_clean_widths(spark, sf_dir):
    return T(spark, sf_dir).listings.select("house_id", "width_meters", "entrancewidth")


@query("clean_surrogate_id")
def q_clean_surrogate_id(spark, sf_dir):
    raw = with_surrogate_id(T(spark, sf_dir).raw_listings)
    return drop_monthly(raw).select("row_ordinal", "house_id")


@query("clean_reorder")
def q_clean_reorder(spark, sf_dir):
    l = T(spark, sf_dir).listings
    assert l.columns[0] == "house_id"
    return listing_out(l)


@query("clean_listings")
def q_clean_listings(spark, sf_dir):
    return listing_out(T(spark, sf_dir).listings)


@query("numeric_price_guard")
def q_numeric_price_guard(spark, sf_dir):
    l = T(spark, sf_dir).listings
    text = P.price_text("price_vnd", "price_raw")
    g = P.numeric_guard(text)
    return l.select("house_id", g.cast("double").alias("price")).filter(F.col("price").isNotNull())


@query("dedup_title_keep_min_id")
def q_dedup(spark, sf_dir):
    return listing_out(dedup_title_keep_min_id(T(spark, sf_dir).listings))


def _cascade(spark, sf_dir):
    t = T(spark, sf_dir)
    return dedup_cascade(dedup_title_keep_min_id(t.listings), t.favorites, t.deposits, t.listing_status)


@query("dedup_cascade")
def q_dedup_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir).favorites


@query("dedup_cascade__deposits")
def q_dedup_cascade_dep(spark, sf_dir):
    return _cascade(spark, sf_dir).deposits


@query("dedup_cascade__status")
def q_dedup_cascade_status(spark, sf_dir):
    return _cascade(spark, sf_dir).status


# ---------------- 2.3 filters, search, sort, paging ----------------
def _active_pv(t):
    return C.property_view(t.active)


@query("active_page")
def q_active_page(spark, sf_dir):
    return C.page(_active_pv(T(spark, sf_dir)), C.sort_order("house_id"), PAGE, PER_PAGE)


@query("active_keyset_page")
def q_active_keyset_page(spark, sf_dir):
    """Deep-page form: the page after a known last id (pushed filter + top-n)."""
    return C.keyset_page(_active_pv(T(spark, sf_dir)), "house_id", KEYSET_AFTER, PER_PAGE)


@query("active_count_pages")
def q_active_count_pages(spark, sf_dir):
    return C.count_pages(T(spark, sf_dir).active, PER_PAGE)


@query("all_page")
def q_all_page(spark, sf_dir):
    return C.page(C.property_view(T(spark, sf_dir).listings), C.sort_order("house_id"), PAGE, PER_PAGE)


@query("filter_area")
def q_filter_area(spark, sf_dir):
    l = C.filter_area(T(spark, sf_dir).listings, DISTRICT_FRAGMENT)
    return C.page(C.property_view(l), C.sort_order("house_id"), PAGE, PER_PAGE)


@query("filter_price")
def q_filter_price(spark, sf_dir):
    l = C.filter_price(T(spark, sf_dir).listings, PRICE_LOW_TY * 1e9, PRICE_HIGH_TY * 1e9)
    return C.page(C.property_view(l), C.sort_order("house_id"), PAGE, PER_PAGE)


@query("filter_area_price")
def q_filter_area_price(spark, sf_dir):
    l = C.filter_area_price(T(spark, sf_dir).listings, DISTRICT_FRAGMENT, PRICE_LOW_TY * 1e9,
                            PRICE_HIGH_TY * 1e9)
    return C.page(C.property_view(l), C.sort_order("house_id"), PAGE, PER_PAGE)


@query("filter_area_price_count_pages")
def q_filter_area_price_count(spark, sf_dir):
    l = C.filter_area_price(T(spark, sf_dir).listings, DISTRICT_FRAGMENT, PRICE_LOW_TY * 1e9,
                            PRICE_HIGH_TY * 1e9)
    return C.count_pages(l, PER_PAGE)


@query("find_text")
def q_find_text(spark, sf_dir):
    l = T(spark, sf_dir).listings
    return C.find_text(l, TEXT).select("house_id", "title", "address", "district",
                                       P.fmt_price_ty("price_vnd", "price_raw").alias("price"))


@query("search_listings")
def q_search_listings(spark, sf_dir):
    return C.search_listings(T(spark, sf_dir).active, "house_id", 1, PER_PAGE, **COMBINED)


@query("search_count_pages")
def q_search_count_pages(spark, sf_dir):
    return C.count_pages(_combined(T(spark, sf_dir)), PER_PAGE)


@query("search_district")
def q_search_district(spark, sf_dir):
    a = C.search_filter(T(spark, sf_dir).active, district=DISTRICT)
    return C.page(C.property_view(a), C.sort_order("price_high"), 1, PER_PAGE)


def _sorted(name: str):
    def fn(spark, sf_dir):
        return C.page(_active_pv(T(spark, sf_dir)), C.sort_order(name), PAGE, PER_PAGE)
    return fn


for _k, _s in [("sort_house_id", "house_id"), ("sort_newest", "newest"),
               ("sort_price_low", "price_low"), ("sort_price_high", "price_high"),
               ("sort_unknown_key", "no_such_key")]:
    REGISTRY[_k] = _sorted(_s)


@query("sort_area_large")
def q_sort_area_large(spark, sf_dir):
    """All active listings in this order: null areas first, then the numbers, largest first."""
    return _active_pv(T(spark, sf_dir)).orderBy(*C.sort_order("area_large"))


@query("distinct_districts")
def q_distinct_districts(spark, sf_dir):
    return C.distinct_districts(T(spark, sf_dir).active)


@query("lookup_by_id")
def q_lookup_by_id(spark, sf_dir):
    t = T(spark, sf_dir)
    return listing_out(C.lookup_by_ids(t.listings, t.favorites))


@query("detail_unpivot")
def q_detail_unpivot(spark, sf_dir):
    return C.detail_unpivot(T(spark, sf_dir).listings)


@query("status_lookup")
def q_status_lookup(spark, sf_dir):
    t = T(spark, sf_dir)
    ids = t.deposits.select("house_id").distinct()
    return t.listing_status.join(ids, "house_id", "left_semi").select("house_id", "statue")


@query("anycol_contains_processing")
def q_anycol_processing(spark, sf_dir):
    t = T(spark, sf_dir)
    q = A.processing_queue(t.listings, t.deposits, t.listing_status).drop("price_vnd")
    cols = ["house_id", "title", "district", "price", "area", "bedrooms", "bathrooms", "user_id"]
    return C.anycol_contains(q.select(*cols), cols, ANYCOL_PROCESSING)


@query("anycol_contains_users")
def q_anycol_users(spark, sf_dir):
    u = T(spark, sf_dir).users
    return C.anycol_contains(u, ["user_id", "username", "phone"], ANYCOL_USERS)


@query("anycol_contains_users_count")
def q_anycol_users_count(spark, sf_dir):
    u = T(spark, sf_dir).users
    return S.total_count(C.anycol_contains(u, ["user_id", "username", "phone"], ANYCOL_USERS), "match_count")


# ---------------- 2.4 aggregations ----------------
@query("district_counts_top10")
def q_district_counts_top10(spark, sf_dir):
    return S.district_counts_top10(T(spark, sf_dir).active)


@query("district_avg_price_top10")
def q_district_avg_price_top10(spark, sf_dir):
    return S.district_avg_price_top10(T(spark, sf_dir).active)


@query("pending_count_pages")
def q_pending_count_pages(spark, sf_dir):
    return C.count_pages(T(spark, sf_dir).pending_listings, PER_PAGE)


@query("user_count")
def q_user_count(spark, sf_dir):
    return S.total_count(T(spark, sf_dir).users, "user_count")


@query("favorites_count")
def q_favorites_count(spark, sf_dir):
    t = T(spark, sf_dir)
    return S.count_by(A.favorites_active(t.listings, t.favorites, t.listing_status), "user_id",
                      "favorite_count")


@query("deposits_count")
def q_deposits_count(spark, sf_dir):
    t = T(spark, sf_dir)
    return S.count_by(A.processing_queue(t.listings, t.deposits, t.listing_status), "user_id",
                      "deposit_count")


@query("deposits_total")
def q_deposits_total(spark, sf_dir):
    t = T(spark, sf_dir)
    return S.total_count(A.processing_queue(t.listings, t.deposits, t.listing_status), "deposit_total")


@query("remaining_deposits")
def q_remaining_deposits(spark, sf_dir):
    return S.count_by(T(spark, sf_dir).deposits, "house_id", "deposit_count")


# ---------------- 2.5 joins ----------------
@query("join_listing_status")
def q_join_listing_status(spark, sf_dir):
    t = T(spark, sf_dir)
    return C.join_listing_status(t.listings, t.listing_status).select(
        "house_id", "title", "district", "statue", "poster_id")


@query("favorites_active")
def q_favorites_active(spark, sf_dir):
    t = T(spark, sf_dir)
    return A.favorites_active(t.listings, t.favorites, t.listing_status)


@query("favorites_active_user")
def q_favorites_active_user(spark, sf_dir):
    t = T(spark, sf_dir)
    return A.favorites_active(t.listings, t.favorites, t.listing_status, USER)


@query("favorites_all")
def q_favorites_all(spark, sf_dir):
    t = T(spark, sf_dir)
    return A.favorites_all(t.listings, t.favorites)


@query("my_deposits")
def q_my_deposits(spark, sf_dir):
    t = T(spark, sf_dir)
    return A.my_deposits(t.listings, t.deposits, t.listing_status, USER)


@query("processing_queue")
def q_processing_queue(spark, sf_dir):
    t = T(spark, sf_dir)
    return A.processing_queue(t.listings, t.deposits, t.listing_status)


def _pairs(spark, sf_dir):
    t = T(spark, sf_dir)
    return A.compare_pairs(t.active, _compare_batch(t))


@query("compare_pair")
def q_compare_pair(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("id_a", "id_b", "a_title", "b_title", "a_district", "b_district",
                    P.fmt_price_ty("a_price_vnd", "a_price_raw").alias("a_price"),
                    P.fmt_price_ty("b_price_vnd", "b_price_raw").alias("b_price"),
                    truncate("a_title", 30).alias("a_title_short"),
                    truncate("b_title", 30).alias("b_title_short"))


@query("compare_flags")
def q_compare_flags(spark, sf_dir):
    f = A.compare_flags(_pairs(spark, sf_dir))
    return f.select("id_a", "id_b", *[c for c in f.columns if "_better_" in c])


@query("compare_price_per_m2")
def q_compare_price_per_m2(spark, sf_dir):
    return A.compare_price_per_m2(_pairs(spark, sf_dir))


# ---------------- 2.6 moderation ----------------
@query("pending_page")
def q_pending_page(spark, sf_dir):
    v = A.pending_view(T(spark, sf_dir).pending_listings)
    return C.page(v, [F.col("posting_date").desc(), F.col("house_id").asc()], 1, PER_PAGE)


@query("pending_detail")
def q_pending_detail(spark, sf_dir):
    p = T(spark, sf_dir).pending_listings
    cols = [c for c in p.columns if c != "price_vnd"]
    return p.select(*cols, P.fmt_price_ty("price_vnd", "price_raw").alias("price"))


@query("my_posts_pending")
def q_my_posts_pending(spark, sf_dir):
    return A.my_posts_pending(T(spark, sf_dir).pending_listings, None)


@query("my_posts_pending_user")
def q_my_posts_pending_user(spark, sf_dir):
    """The own pages of several posters."""
    p = T(spark, sf_dir).pending_listings
    pages = [A.my_posts_pending(p, u) for u in POSTERS]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("my_posts_approved")
def q_my_posts_approved(spark, sf_dir):
    t = T(spark, sf_dir)
    return A.my_posts_approved(t.listings, t.listing_status, None)


@query("my_posts_approved_user")
def q_my_posts_approved_user(spark, sf_dir):
    t = T(spark, sf_dir)
    return A.my_posts_approved(t.listings, t.listing_status, USER)


@query("my_posts_all")
def q_my_posts_all(spark, sf_dir):
    t = T(spark, sf_dir)
    return A.my_posts_pending(t.pending_listings, None).unionByName(
        A.my_posts_approved(t.listings, t.listing_status, None))


@query("users_list")
def q_users_list(spark, sf_dir):
    return T(spark, sf_dir).users.select("user_id", "username", "phone").orderBy("user_id")


# ---------------- 2.7 change batches ----------------
@query("chg_add_favorites")
def q_chg_add_favorites(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.add_favorites(t.favorites, t.users, t.listings, t.batch_add_favorites())


@query("chg_remove_favorites")
def q_chg_remove_favorites(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.remove_favorites(t.favorites, t.batch_remove_favorites())


def _confirm(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.confirm_deposits(t.listing_status, t.deposits, t.users, t.listings,
                              t.batch_confirm_deposits())


@query("chg_confirm_deposits")
def q_chg_confirm(spark, sf_dir):
    return _confirm(spark, sf_dir).status


@query("chg_confirm_deposits__deposits")
def q_chg_confirm_dep(spark, sf_dir):
    return _confirm(spark, sf_dir).deposits


def _cancel(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.cancel_deposits(t.listing_status, t.deposits, t.batch_cancel_deposits())


@query("chg_cancel_deposits")
def q_chg_cancel(spark, sf_dir):
    return _cancel(spark, sf_dir).status


@query("chg_cancel_deposits__deposits")
def q_chg_cancel_dep(spark, sf_dir):
    return _cancel(spark, sf_dir).deposits


def _admin_cancel(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.admin_cancel(t.listing_status, t.deposits, t.batch_admin_cancel())


@query("chg_admin_cancel")
def q_chg_admin_cancel(spark, sf_dir):
    return _admin_cancel(spark, sf_dir).status


@query("chg_admin_cancel__deposits")
def q_chg_admin_cancel_dep(spark, sf_dir):
    return _admin_cancel(spark, sf_dir).deposits


@query("chg_update_status")
def q_chg_update_status(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.update_status(t.listing_status, t.admins, t.batch_status_updates())


def _request_log(spark, sf_dir):
    t = T(spark, sf_dir)
    return request_log.apply_log(t.listing_status, t.deposits, t.users, t.listings, t.admins, t.batch_request_log())


@query("chg_request_log")
def q_chg_request_log(spark, sf_dir):
    return _request_log(spark, sf_dir).status


@query("chg_request_log__deposits")
def q_chg_request_log_dep(spark, sf_dir):
    return _request_log(spark, sf_dir).deposits


@query("chg_buy_request")
def q_chg_buy_request(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.buy_requests(t.listing_status, t.users, t.batch_buy_requests())


@query("chg_submit_posts")
def q_chg_submit_posts(spark, sf_dir):
    t = T(spark, sf_dir)
    return listing_out(X.submit_posts(t.pending_listings, t.batch_post_requests(3), POSTING_DATE))


def _admin_posts(spark, sf_dir):
    t = T(spark, sf_dir)
    new = X.new_admin_posts(t.listing_ids, t.batch_post_requests(4), POSTING_DATE, ADMIN_ID)
    return X.PostState(t.listings.unionByName(new.listings), t.listing_status.unionByName(new.status), None)


@query("chg_admin_posts")
def q_chg_admin_posts(spark, sf_dir):
    return listing_out(_admin_posts(spark, sf_dir).listings)


@query("chg_admin_posts__status")
def q_chg_admin_posts_status(spark, sf_dir):
    return _admin_posts(spark, sf_dir).status


def _approve(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.approve_posts(t.pending_listings, t.listings, t.listing_status, t.batch_approve(), t.listing_ids)


@query("chg_approve_posts")
def q_chg_approve(spark, sf_dir):
    return listing_out(_approve(spark, sf_dir).listings)


@query("chg_approve_posts__status")
def q_chg_approve_status(spark, sf_dir):
    return _approve(spark, sf_dir).status


@query("chg_approve_posts__pending")
def q_chg_approve_pending(spark, sf_dir):
    return listing_out(_approve(spark, sf_dir).pending)


@query("chg_reject_posts")
def q_chg_reject(spark, sf_dir):
    t = T(spark, sf_dir)
    return listing_out(X.reject_posts(t.pending_listings, t.batch_reject()))


def _delete_users(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.delete_users(t.users, t.favorites, t.deposits, t.batch_delete_users())


@query("chg_delete_users")
def q_chg_delete_users(spark, sf_dir):
    return _delete_users(spark, sf_dir).users


@query("chg_delete_users__favorites")
def q_chg_delete_users_fav(spark, sf_dir):
    return _delete_users(spark, sf_dir).favorites


@query("chg_delete_users__deposits")
def q_chg_delete_users_dep(spark, sf_dir):
    return _delete_users(spark, sf_dir).deposits


@query("chg_register_users")
def q_chg_register_users(spark, sf_dir):
    t = T(spark, sf_dir)
    return X.register_users(t.users, t.batch_register_users())


# ---------------- 2.8 scalar functions and data quality ----------------
@query("fmt_price_ty")
def q_fmt_price_ty(spark, sf_dir):
    l = T(spark, sf_dir).listings
    return l.select("house_id", "price_raw", P.fmt_price_ty("price_vnd", "price_raw").alias("price_text"))


@query("fmt_price_plain")
def q_fmt_price_plain(spark, sf_dir):
    l = T(spark, sf_dir).listings
    return l.select("house_id", P.fmt_price_plain("price_vnd", "price_raw").alias("price_text"))


@query("fmt_price_long")
def q_fmt_price_long(spark, sf_dir):
    l = T(spark, sf_dir).listings.filter(F.col("price_vnd").isNotNull())
    return l.select("house_id", P.fmt_price_long(F.col("price_vnd")).alias("price_long"))


@query("fmt_thousands")
def q_fmt_thousands(spark, sf_dir):
    l = T(spark, sf_dir).listings.filter(F.col("price_vnd").isNotNull() & (F.col("area") > 0))
    ppm = A.price_per_m2(F.col("price_vnd"), F.col("area"))
    return l.select("house_id", ppm.alias("ppm2"), P.fmt_thousands(ppm).alias("ppm2_text"))


@query("text_truncate")
def q_text_truncate(spark, sf_dir):
    l = T(spark, sf_dir).listings
    return l.select("house_id", truncate("title", 30).alias("title_30"),
                    truncate("title", 45).alias("title_45"),
                    truncate("district", 15, ellipsis=False).alias("district_15"))


@query("compare_raw_price")
def q_compare_raw_price(spark, sf_dir):
    l = T(spark, sf_dir).listings
    return l.select("house_id", P.compare_raw_price("price_vnd").alias("price_ty"))


@query("price_input_normalise")
def q_price_input_normalise(spark, sf_dir):
    r = T(spark, sf_dir).raw_listings
    return r.select("row_ordinal", P.price_input_normalise(F.col("Price")).alias("price_input"))


@query("dq_listings")
def q_dq_listings(spark, sf_dir):
    return Q.dq_listings(T(spark, sf_dir).listing_forms)


@query("dq_raw_prices")
def q_dq_raw_prices(spark, sf_dir):
    return Q.dq_raw_prices(T(spark, sf_dir).raw_listings)


@query("dq_users")
def q_dq_users(spark, sf_dir):
    return Q.dq_users(T(spark, sf_dir).user_forms)


def queries() -> dict[str, Query]:
    from abode.plans import model_queries  # noqa: F401  (registers the model queries)
    return dict(REGISTRY)


# ---------------- request streams (Structured Streaming) ----------------
@query("stream_status_updates")
def q_stream_status_updates(spark, sf_dir):
    from abode.streaming.requests import stream_status_updates
    return stream_status_updates(spark, sf_dir)


def _stream_request_log(spark, sf_dir):
    from abode.streaming.request_log import stream_request_log
    return stream_request_log(spark, sf_dir).tables


@query("stream_request_log")
def q_stream_request_log(spark, sf_dir):
    return _stream_request_log(spark, sf_dir).status


@query("stream_request_log__deposits")
def q_stream_request_log_dep(spark, sf_dir):
    return _stream_request_log(spark, sf_dir).deposits


@query("stream_add_favorites")
def q_stream_add_favorites(spark, sf_dir):
    from abode.streaming.requests import stream_add_favorites
    return stream_add_favorites(spark, sf_dir)
